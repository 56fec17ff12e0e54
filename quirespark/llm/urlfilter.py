"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The labelled URLs are those a rule decides. The trees learn from a bounded sample of them (``TRAIN_ROWS``, least
hashes first, so the same URLs are drawn however the table is dealt) and become one CASE expression, which scores
every URL in the scan. One fold of the URLs is held out to measure them.

Statistics of host suffixes are those of all URLs, labelled or not: how many a site (a suffix of ``SITE`` labels) has, and how
deep, parametrised and full of digits they are. Shares of labels are not among them. Rules name hosts, so above a site
the host says which rules could apply, and trees that know the labels' share there learn the rules' hosts and nothing
else. Statistics are joined, by broadcast if they have at most ``BROADCAST_SUFFIXES`` rows, else by a shuffle in which a
suffix has ``SALTS`` places. Training compresses the sample to distinct vectors of bin numbers and then asks, a tree level
at a time, for one histogram of gradients per node, feature and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import ascii_lower, let, released, settled, small_enough, table, text_of

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Bound of the training sample.
TRAIN_ROWS = 20_000
#: So many rows of suffix statistics may be broadcast; beyond, each is dealt to so many places.
BROADCAST_SUFFIXES = 200_000
SALTS = 16
BINS = 16
TREES = 8
DEPTH = 3
RATE = 0.3
#: Regularisation of leaf weights.
LAMBDA = 1.0
#: Folds of URLs, of which the first is held out.
FOLDS = 10
#: Labels of the suffix that stands for a site.
SITE = 3


@dataclass(frozen=True)
class Model:
    """``cuts``: bin edges by feature; ``trees``: lists of (feature, cut or None, value) in heap order."""

    bias: float
    cuts: dict[str, list[float]]
    trees: list[list[tuple[str | None, float, float]]]
    suffixes: DataFrame
    held_out: float | None = None  # share of the held-out sample that the trees decide as the rules do
    larger_class: float | None = None  # share that the larger class alone would get right there

    def margin(self) -> Column:
        """The log odds of blocking, from the feature columns."""
        out = F.lit(self.bias)
        for tree in self.trees:
            out = out + _tree(tree, 0)
        return out


def _tree(tree: list, at: int) -> Column:
    feature, cut, value = tree[at]
    if feature is None:
        return F.lit(value)
    return F.when(F.col(feature) <= cut, _tree(tree, 2 * at + 1)).otherwise(_tree(tree, 2 * at + 2))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return ascii_lower(F.regexp_extract(text_of(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(text_of(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, ties by code point; else null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _entropy(text: Column) -> Column:
    """Bits a character, over the characters of the text: from runs of the sorted characters."""

    def of(c: Column) -> Column:
        bits = lambda n: n * F.log2(n)
        start = F.struct(F.lit("").alias("last"), F.lit(1.0).alias("run"), F.lit(0.0).alias("sum"))
        step = lambda a, x: F.when(x == a["last"], F.struct(x.alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(
            F.struct(x.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + bits(a["run"])).alias("sum"))
        )
        n = F.size(c).cast("double")
        return F.aggregate(F.array_sort(c), start, step, lambda a: F.log2(n) - (a["sum"] + bits(a["run"])) / n)

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(let(F.filter(F.split(text, ""), lambda x: x != ""), of))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Feature columns, all double."""
    u = text_of(url)
    count = lambda pattern, x: (F.length(x) - F.length(F.regexp_replace(x, pattern, ""))).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "url_length": F.length(u).cast("double"),
        "host_length": F.length(host).cast("double"),
        "host_depth": count("[.]", host),
        "path_depth": count("/", path),
        "digit_ratio": count("[0-9]", u) / F.greatest(F.length(u), F.lit(1)),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "n_params": F.when(query == "", F.lit(0.0)).otherwise(count("&", query) + 1),
        "n_hyphens": count("-", host),
    }


SUFFIX_FEATURES = ("site_urls", "site_depth", "site_params", "site_digits")


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path, the rule's struct ``_rule`` and the lexical features."""
    out = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return out.withColumns({"_rule": rule_of(F.col("host"), F.col("path")), **lexical(F.col(url), F.col("host"), F.col("path"))})


def _fold() -> Column:
    """Of a row with host and path; URLs that differ in neither are of one fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), "host", "path"), F.lit(FOLDS)).cast("int")


def site_statistics(urls: DataFrame) -> DataFrame:
    """By suffix of ``SITE`` labels what all URLs (with features) of the site are like."""
    of = {"site_urls": F.log2(F.count("*") + 1), "site_depth": F.avg("path_depth"), "site_params": F.avg("n_params"), "site_digits": F.avg("digit_ratio")}
    return urls.groupBy(suffix_of(F.col("host"), SITE).alias("suffix")).agg(*(c.alias(n) for n, c in of.items()))


def _with_sites(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Rows with the statistics of their sites; an unknown site has zeros."""
    on = suffix_of(F.col("host"), SITE) == F.col("_s")
    stats = suffixes.withColumnRenamed("suffix", "_s")
    if small_enough(suffixes, BROADCAST_SUFFIXES):
        out = rows.join(F.broadcast(stats), on, "left")
    else:  # repeated URLs are dealt apart, too
        rows = rows.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        out = rows.join(stats.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (F.col("_salt") == F.col("_place")), "left").drop("_salt", "_place")
    return out.drop("_s").fillna(0.0, list(SUFFIX_FEATURES))


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, suffixes: DataFrame | None = None) -> Model:
    """A model from rows with host, lexical features and ``y`` (1: block); trees are learnt from ``rows`` of them at most.

    ``suffixes`` are the statistics of the sites of all URLs, those to be judged among them; without them those of the labelled ones. Without rows of both
    kinds there are no trees: the model says what it has seen, or allow if it has seen none.
    """
    names = [c for c in lexical(F.lit(""), F.lit(""), F.lit(""))]
    drawn = labelled.select("host", "path", "y", *names, F.xxhash64("host", "path", *names).alias("_hash")).orderBy("_hash").limit(rows)
    sample = settled(drawn)
    suffixes = settled(site_statistics(labelled)) if suffixes is None else suffixes
    n, positive = labelled.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < positive < n:
        return Model(1.0 if positive else -1.0, {}, [], suffixes)
    rate = positive / n
    names += SUFFIX_FEATURES
    sample = _with_sites(sample, suffixes).withColumn("_fold", _fold())
    judged_by, sample = sample.filter("_fold = 0"), sample.filter("_fold > 0")
    edges = sample.agg(*(F.percentile_approx(c, [i / BINS for i in range(1, BINS)], 10_000).alias(c) for c in names)).first()
    if edges[names[0]] is None:  # no URL is left to learn from
        return Model(1.0 if rate > 0.5 else -1.0, {}, [], suffixes)
    cuts = {c: sorted(set(edges[c])) for c in names}
    bins = [sum(((F.col(c) > x).cast("int") for x in cuts[c]), F.lit(0)).alias(c) for c in names]
    # Rows with equal bins are one row from here on.
    vectors = settled(sample.select("y", *bins).groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("pos")).coalesce(1))
    bias = math.log(rate / (1 - rate))
    trees, binned = [], []
    for _ in range(TREES):
        margin = F.lit(bias)
        for t in binned:
            margin = margin + _tree(t, 0)
        tree = _grow(vectors.withColumn("p", 1 / (1 + F.exp(-margin))), names)
        if len(tree) == 1 and abs(tree[0][2]) < 1e-6:
            break
        binned.append(tree)
        trees.append([(f, float(cuts[f][int(cut)]) if f else 0.0, value) for f, cut, value in tree])
    model = Model(bias, cuts, trees, suffixes)
    right, blocked = judged_by.agg(F.avg(((model.margin() > 0).cast("double") == F.col("y")).cast("double")), F.avg("y")).first()
    released(vectors)
    return replace(model, held_out=right, larger_class=None if blocked is None else max(blocked, 1 - blocked))


def _grow(vectors: DataFrame, names: list[str]) -> list[tuple[str | None, float, float]]:
    """One tree over bin numbers, in heap order, from a histogram a level."""
    leaf = lambda g, h: (None, 0.0, RATE * g / (h + LAMBDA))
    tree: dict[int, tuple[str | None, float, float]] = {}
    graded = vectors.withColumn("g", F.col("pos") - F.col("p") * F.col("n")).withColumn("h", F.col("p") * (1 - F.col("p")) * F.col("n"))
    live = {0}
    for _ in range(DEPTH):
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in names))).alias("x")
        counts = graded.withColumn("_node", _place(tree, 0)).filter(F.col("_node").isin(*live)).select("_node", "g", "h", pairs)
        # Nodes x features x bins rows at most.
        rows = counts.groupBy("_node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        split: set[int] = set()
        for node in sorted(live):
            own = [r for r in rows if r["_node"] == node]
            found = _best(own, names)
            if found is None:
                tree.setdefault(node, leaf(*_sums(own, names[0])))
                continue
            feature, cut, left, right = found
            tree[node] = (feature, cut, 0.0)
            tree[2 * node + 1], tree[2 * node + 2] = leaf(*left), leaf(*right)
            split.add(node)
        live = {c for node in split for c in (2 * node + 1, 2 * node + 2)}
        if not live:
            break
    return [tree.get(i, (None, 0.0, 0.0)) for i in range(max(tree) + 1)]


def _sums(rows: list, name: str) -> tuple[float, float]:
    own = [r for r in rows if r["f"] == name]
    return math.fsum(r["g"] for r in own), math.fsum(r["h"] for r in own)


def _place(tree: dict, at: int) -> Column:
    """The node a row has come to in a tree that is still growing."""
    if at not in tree or tree[at][0] is None:
        return F.lit(at)
    feature, cut, _ = tree[at]
    return F.when(F.col(feature) <= cut, _place(tree, 2 * at + 1)).otherwise(_place(tree, 2 * at + 2))


def _best(rows: list, names: list[str]) -> tuple[str, int, tuple[float, float], tuple[float, float]] | None:
    """The (feature, bin) whose split gains most, first in order of ``names`` on a tie, and the sums of gradients
    on either side; None if none gains."""
    best, gain = None, 1e-6
    for name in names:
        own = sorted((r["b"], r["g"], r["h"]) for r in rows if r["f"] == name)
        g, h = _sums(rows, name)
        left_g = left_h = 0.0
        for b, dg, dh in own[:-1]:
            left_g, left_h = left_g + dg, left_h + dh
            won = left_g**2 / (left_h + LAMBDA) + (g - left_g) ** 2 / (h - left_h + LAMBDA) - g**2 / (h + LAMBDA)
            if won > gain + 1e-12:
                best, gain = (name, b, (left_g, left_h), (g - left_g, h - left_h)), won
    return best


def judged(urls: DataFrame, url: str = "url", model: Model | None = None) -> DataFrame:
    """``urls`` with host, path, rule, verdict and ``block_margin``, the trees' log odds.

    A URL that is null or has no ``://`` has an empty host and path, fits no rule and is judged by its features.
    Repeated URLs are judged alike, and very long ones whole. The new columns replace columns of their names, in any case.
    """
    rows = urls.withColumn("_url", F.col(url))
    full = with_features(rows.select("_url", F.struct(*urls.columns).alias("_own")), "_url")
    if model is None:
        known = full.filter("_rule IS NOT NULL").withColumn("y", (F.col("_rule.verdict") == "block").cast("double"))
        model = fit(known, suffixes=settled(site_statistics(full)))
    scored = _with_sites(full, model.suffixes).withColumn("block_margin", model.margin())
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("block_margin") > 0, F.lit("block")).otherwise(F.lit("allow")))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("_rule.rule"), "verdict": verdict, "block_margin": F.col("block_margin")}
    return scored.select(*(F.col(f"_own.`{c}`").alias(c) for c in urls.columns if c.lower() not in new), *(c.alias(n) for n, c in new.items()))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_margin")
