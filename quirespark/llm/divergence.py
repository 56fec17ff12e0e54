"""How the sources of a language differ in their words: a two-pass vocabulary automaton.

Pass 1 counts in how many documents of a language each term stands, which fixes its vocabulary. Pass 2 counts the
occurrences of the vocabulary in every source, with one Aho-Corasick automaton a language over texts in which all but
letters is a space; a term is put in with a space on either side, so that only whole terms are found. Tasks hold the
``AUTOMATON_TERMS`` terms that stand in most documents, at most ``TERM_BYTES`` bytes long: some 13 MB to send. What a
vocabulary has beyond that is counted by exploding terms that meet it in a join.

The counts are sparse postings (language, source, term, n > 0). A term that a source lacks has the share that
smoothing gives to a count of 0, so a distance over the whole vocabulary comes from what is not 0: each posting
against the other source's empty share, by the number of postings of each count, corrected where both have the term.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm import terms
from quirespark.llm.common import UPPER, measured, settled, table

MIN_DOCS = 30
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
AUTOMATON_TERMS = 200_000
TERM_BYTES = 64

_GROUP = ["lang", "source"]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of a slice of texts that have the term."""
    for b in batches:
        at = 0
        for texts in terms.slices(b.column(2)):
            langs = b.column(0).slice(at, len(texts)).dictionary_encode()
            at += len(texts)
            flat, offsets = terms.words(texts, terms.LETTERS)
            if not len(flat):
                continue
            codes = flat.dictionary_encode()
            size, owner = len(codes.dictionary), np.repeat(np.arange(len(texts)), np.diff(offsets))
            once = np.unique(owner * size + codes.indices.to_numpy())
            both, n = np.unique(langs.indices.to_numpy()[once // size].astype(np.int64) * size + once % size, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(both // size)), codes.dictionary.take(pa.array(both % size)).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "term", "n"])


class Vocabulary:
    """Some terms of each language, as automata that a worker builds once."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.terms = defaultdict(list)
        for lang, term in rows:
            self.terms[lang].append(term)
        self.automata: dict = {}

    def automaton(self, lang: str):
        if lang not in self.automata:
            import ahocorasick

            own = ahocorasick.Automaton()
            for i, term in enumerate(self.terms[lang]):
                own.add_word(f" {term} ", i)
            own.make_automaton()
            self.automata[lang] = own
        return self.automata[lang]

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "automata": {}}


def _occurrences(batches: Iterator[pa.RecordBatch], own: Vocabulary) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n): occurrences of the vocabulary in a slice of texts."""
    names = ["lang", "source", "term", "n"]
    for b in batches:
        at = 0
        for texts in terms.slices(b.column(2)):
            groups: dict = defaultdict(list)
            keys = zip(b.column(0).slice(at, len(texts)).to_pylist(), b.column(1).slice(at, len(texts)).to_pylist(), strict=True)
            at += len(texts)
            for key, text in zip(keys, terms.mapped(texts, terms.LETTERS).to_pylist(), strict=True):
                if own.terms.get(key[0]):
                    groups[key].append(text)
            for (lang, source), held in groups.items():
                found = np.fromiter((i for _, i in own.automaton(lang).iter(f" {' '.join(held)} ")), np.int64)
                n = np.bincount(found)
                seen, known = np.flatnonzero(n), own.terms[lang]
                if len(seen):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array([source] * len(seen)), pa.array([known[i] for i in seen], pa.string()), pa.array(n[seen])], names=names)


def vocabulary(texts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, n): the terms that ``n >= min_docs`` rows of (lang, source, text) have."""
    return texts.mapInArrow(_frequencies, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)


def postings(texts: DataFrame, kept: DataFrame, size: int, most: int = AUTOMATON_TERMS) -> DataFrame:
    """(lang, source, term, n > 0): occurrences of ``kept``, a settled vocabulary of ``size`` terms, in each source."""
    short = kept.filter(F.octet_length("term") <= TERM_BYTES)
    ranked = short if size <= most else short.orderBy(F.desc("n"), "lang", "term").limit(most)
    head = [(r.lang, r.term) for r in ranked.collect()]  # at most ``most`` terms of ``TERM_BYTES`` bytes
    own = Vocabulary(head)
    found = texts.mapInArrow(lambda batches: _occurrences(batches, own), "lang string, source string, term string, n long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    if len(head) == size:
        return counts
    tail = kept.select("lang", "term").exceptAll(texts.sparkSession.createDataFrame(head, "lang string, term string"))
    letters = F.regexp_replace("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " ")
    every = texts.select("lang", "source", F.explode(F.split(F.translate(letters, UPPER, UPPER.lower()), " ")).alias("term")).groupBy("lang", "source", "term").agg(F.count("*").alias("n"))
    return counts.unionByName(every.join(tail, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))


def _share(n: Column, total: Column, size: Column) -> Column:
    """The smoothed share in billionths, exactly: products have up to 31 digits."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    over, under = whole(n + PRIOR, 20) * whole(F.lit(SCALE), 10), whole(total + PRIOR * size, 20)
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every source of every language.

    Part ``pair`` ranks the other sources of the language by the sum of differences of shares over its vocabulary, part
    ``term`` the terms that the source has more of than the language as a whole, ``top`` of them. Ties go by the bytes
    of the item. Each row counts as a document, also if it repeats another; null columns are ''. A language without
    vocabulary has pairs of distance 0 and no terms; an empty table gives no row. Texts are read whole, other
    columns not at all.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    kept, seen = measured(vocabulary(texts, min_docs))
    counts = settled(postings(texts, kept, seen["rows"]))

    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"))
    total = counts.groupBy(*_GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    groups = texts.select(*_GROUP).distinct().join(total, _GROUP, "left").join(sizes, "lang", "left")
    groups = groups.select(*_GROUP, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "held", "size")))
    groups = settled(groups.withColumn("base", F.when(F.col("size") > 0, _share(F.lit(0), F.col("total"), F.col("size"))).otherwise(F.lit(0).cast("long"))))
    shares = counts.join(groups, _GROUP).withColumn("p", _share(F.col("n"), F.col("total"), F.col("size"))).select(*_GROUP, "term", "n", "p", "base")

    def renamed(frame: DataFrame, **names: str) -> DataFrame:
        return frame.select("lang", *(F.col(c).alias(n) for c, n in names.items()))

    # what each source's postings differ from another's empty share: by the few values that a share takes
    spread = shares.groupBy(*_GROUP, "p").agg(F.count("*").alias("terms"))
    others = renamed(groups, source="item", base="other_base")
    alone = spread.join(others, "lang").filter(F.col("source") != F.col("item")).groupBy(*_GROUP, "item").agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("other_base"))).alias("alone"))
    one, two = renamed(shares, term="term", source="one", p="p", base="a"), renamed(shares, term="term", source="two", p="q", base="b")
    both = one.join(two, ["lang", "term"]).filter("one < two").groupBy("lang", "one", "two")
    both = both.agg(F.count("*").alias("shared"), F.sum(F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("b")) - F.abs(F.col("q") - F.col("a"))).alias("together"))

    of = lambda frame, old, new: frame.select("lang", *(F.col(o).alias(n) for o, n in zip(old, new, strict=True)))
    left, right = (of(groups, ["source", "held", "base", "size"], [x, f"held_{x}", f"base_{x}", f"size_{x}"]) for x in ("one", "two"))
    pairs = left.join(right, "lang").filter("one < two").join(both, ["lang", "one", "two"], "left")
    pairs = pairs.join(of(alone, ["source", "item", "alone"], ["one", "two", "alone_one"]), ["lang", "one", "two"], "left")
    pairs = pairs.join(of(alone, ["source", "item", "alone"], ["two", "one", "alone_two"]), ["lang", "one", "two"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    neither = F.col("size_one") - F.col("held_one") - F.col("held_two") + zero("shared")
    value = zero("alone_one") + zero("alone_two") + zero("together") + neither * F.abs(F.col("base_one") - F.col("base_two"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("s"), value.cast("long").alias("value"))
    pairs = pairs.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    whole = whole.join(of_lang, "lang").select("lang", "term", _share(F.col("all"), F.col("total"), F.col("size")).alias("q"))
    most = shares.join(whole, ["lang", "term"]).filter("p > q").select(*_GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy(*_GROUP, "part").orderBy(F.desc("value"), "item"))
    ranked = lambda frame: frame.withColumn("rank", rank)
    return ranked(pairs).unionByName(ranked(most).filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
n AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS total, v
  FROM groups JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, c, 1 + ({SCALE}::HUGEINT * (c + {PRIOR})) // (total + {PRIOR} * v) AS p FROM cells),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (c + {PRIOR})) // (total + {PRIOR} * v) AS q
      FROM (SELECT lang, term, any_value(v) AS v, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS total FROM cells GROUP BY lang, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS d FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= {TOP}"""
