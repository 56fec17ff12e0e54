"""Quality rules: a threshold table compiled into one projection.

Every text is judged in place, whole, without a shuffle. The rules are data (``Rule``); ``judged`` turns
them into column expressions over a handful of counts, each made once per text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import SPACE, WORD, let, table, text_of, words_of

#: Function words of the four languages, any of which marks running prose.
STOP_WORDS = (
    "a and are as at be by for from have in is it of on or that the this to was with "
    "au avec dans de des du en est et la le les par pas pour que qui sur un une "
    "das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "con del el en la las los no para por que se su un una"
).split()


@dataclass(frozen=True)
class Rule:
    """``least <= 100 * metric / per <= most``, compared in whole numbers; without ``per``, the metric itself."""

    metric: str
    per: str | None = None
    least: int | None = None
    most: int | None = None

    def holds(self, m: Column) -> Column:
        value, unit = (m[self.metric] * 100, m[self.per]) if self.per else (m[self.metric], F.lit(1))
        out = F.lit(True)
        if self.least is not None:
            out = out & (value >= unit * self.least)
        if self.most is not None:
            out = out & (value <= unit * self.most)
        return out


#: A text that breaks one of these has failed whatever the other rules say.
BASE = (Rule("n_words", least=50), Rule("n_repeat_words", "n_words", most=50))
#: The method's own table.
RULES = (
    Rule("word_chars", "n_words", least=200, most=2000),
    Rule("n_symbols", "n_words", most=10),
    Rule("n_shouts", "n_words", most=20),
    Rule("n_dup_lines", "n_lines", most=60),
    Rule("n_stop_words", least=2),
)


def _repeat_words(w: Column) -> Column:
    """How many words stand in a window of three words that the text has twice or more.

    Windows are told apart by a 64-bit hash within their own text. Sorting (hash, position) brings equal
    windows together, so the cost is n log n in the length of the text.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def starts(s: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gain = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3)))
        return F.aggregate(gain, F.lit(0), lambda a, x: a + x)

    def counted(t: Column) -> Column:
        ordered = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(ordered, lambda s: let(starts(s), covered))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(found)

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows, counted))


def _chars(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _metrics(text: Column) -> Column:
    by_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    by_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    )
    return let(
        text,
        lambda t: let(
            F.struct(let(words_of(t), by_words).alias("w"), let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), by_lines).alias("l")),
            lambda p: F.struct(
                p["w"]["n_words"].alias("n_words"),
                p["w"]["word_chars"].alias("word_chars"),
                _chars(t, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
                p["l"]["n_dup_lines"].alias("n_dup_lines"),
                p["w"]["n_repeat_words"].alias("n_repeat_words"),
                p["l"]["n_lines"].alias("n_lines"),
                p["w"]["n_stop_words"].alias("n_stop_words"),
                _chars(t, "!").cast("long").alias("n_shouts"),
            ),
        ),
    )


def judged(text: Column, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the counts of a text, ``base_failed`` and ``kept``.

    A null text counts as an empty one: no words, so the base rules fail it. Words are runs of anything but
    ASCII white space, lines are split at \\n, and only lines with a word count as lines here.
    """

    def verdict(m: Column) -> Column:
        failed = ~_all(r.holds(m) for r in base)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_shouts")
        return F.struct(*(m[n].alias(n) for n in names), failed.alias("base_failed"), (~failed & _all(r.holds(m) for r in rules)).alias("kept"))

    return let(_metrics(text_of(text)), verdict)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_quality(docs: DataFrame, text: str = "text", into: str = "quality", **tables) -> DataFrame:
    """``docs`` with the struct of ``judged``; it replaces a column already called ``into``."""
    return docs.withColumn(into, judged(F.col(text), **tables))


def keep_good(docs: DataFrame, text: str = "text", **tables) -> DataFrame:
    """The rows of ``docs`` that every rule lets through, with their own columns."""
    return docs.filter(judged(F.col(text), **tables)["kept"])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", judged(F.col("text")).alias("q"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return docs.select("doc_id", *(F.col("q")[c].alias(c) for c in columns))


def keep_good_sql(docs: str) -> str:
    """The rows of ``keep_good`` as DuckDB SQL, from the counts of ``judge_sql``."""
    return f"SELECT d.* FROM {docs} d SEMI JOIN (SELECT * FROM ({judge_sql(docs)}) WHERE kept) k USING (doc_id)"


def judge_sql(docs: str = "documents") -> str:
    """The counts and verdicts as DuckDB SQL; for tables whose doc_id is unique."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    space, word = (x.replace(r"\x20", " ").replace(r"\x09-\x0D", r"\x09-\x0D") for x in (SPACE, WORD))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
      FROM w WHERE len(w) >= 3),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
             len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
             length(text) - length(replace(text, '!', '')) AS n_shouts
      FROM w LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND 100 * word_chars BETWEEN 200 * n_words AND 2000 * n_words
        AND 100 * n_symbols <= 10 * n_words AND 100 * n_shouts <= 20 * n_words AND 100 * n_dup_lines <= 60 * n_lines AND n_stop_words >= 2) AS kept
FROM m"""


SQL = judge_sql()
