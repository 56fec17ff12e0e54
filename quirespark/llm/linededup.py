"""Line dedup: drop the lines that many documents share.

Lines are exploded as 128-bit hashes of their normalised form with their position, never as text. Distinct
(hash, document) pairs are counted per hash, which leaves at most one row a hash and task for the second
shuffle, so a line that every document holds costs no task more than another. The hashes over the threshold are
counted; up to ``BROADCAST_KEYS`` they are broadcast and occurrences meet them in the scan, beyond that both sides
are salted by position and shuffled, so that occurrences of a hot line meet in many tasks. Positions are gathered
per text, and each text is put together from the stretches between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import SPACE_CHARS, UPPER, ascii_lower, fresh, let, measured, place_of, table, text_of


#: So many hashes (two longs each, 8 MB) may be broadcast; beyond, each is dealt to so many places.
BROADCAST_KEYS = 500_000
SALTS = 32


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = text_of(text)
    return docs.select(F.col(doc_id).alias("_id"), F.xxhash64(body).alias("_text"), body.alias("_body"))


def frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(id, text hash, position) of every line whose key has ``min_chars`` and stands in ``min_docs`` documents.

    Documents are told apart by id: rows that repeat an id add nothing to a count, and all rows without an id
    count as one document.
    """
    key = lambda x: let(line_key(x), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))
    lines = (
        _rows(docs, doc_id, text)
        .select("_id", "_text", F.posexplode(F.transform(F.split("_body", "\n"), key)).alias("_pos", "_key"))
        .filter("_key IS NOT NULL")
        .select("_id", "_text", "_pos", "_key.a", "_key.b")
    )
    often, seen = measured(lines.select("a", "b", "_id").distinct().groupBy("a", "b").count().filter(F.col("count") >= min_docs).select("a", "b"))
    if seen["rows"] <= BROADCAST_KEYS:
        found = lines.join(F.broadcast(often), ["a", "b"], "left_semi")
    else:
        salted = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.withColumn("_salt", F.pmod(F.xxhash64("_id", "_pos"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "_salt"], "left_semi")
    return found.select("_id", "_text", "_pos")


def _without(text: Column, positions: Column) -> Column:
    """The lines of ``text`` but those at the sorted ``positions``, in time linear in their number."""

    def between(lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), positions, F.array(F.size(lines)))
        return let(
            edges,
            lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda j: F.slice(lines, F.get(e, j) + 2, F.get(e, j + 1) - F.get(e, j) - 1))),
        )

    return let(F.split(text, "\n"), lambda lines: F.array_join(between(lines), "\n"))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, prefix: str = "_line_") -> DataFrame:
    """``docs`` with frequent lines taken out of ``text``, and ``<prefix>n`` and ``<prefix>dropped`` added.

    A null text is an empty one: a single empty line, whose key is too short to be dropped. A text that loses
    all its lines becomes empty; a very long one is judged line by line like any other. Rows with equal id and text get
    the same result. Columns of the two new names are replaced, all others stay.
    """
    n, dropped = f"{prefix}n", f"{prefix}dropped"
    own = [c for c in docs.columns if c.lower() not in (n.lower(), dropped.lower())]
    i, t, g = (fresh([*docs.columns, n, dropped], f"{prefix}{x}") for x in ("id", "text", "gone"))
    gone = frequent_lines(docs, doc_id, text, min_docs, min_chars).groupBy(F.col("_id").alias(i), F.col("_text").alias(t)).agg(F.sort_array(F.collect_set("_pos")).alias(g))
    body, at, name = text_of(text), F.col(g), docs.columns[place_of(docs, text)]
    joined = docs.select(*own).join(gone, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(body) == F.col(t)), "left")
    kept = F.when(at.isNull(), body).otherwise(_without(body, at))
    return joined.select(
        *(kept.alias(c) if c == name else F.col(f"`{c}`") for c in own),
        (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(n),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias(dropped),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", F.col("_line_n").alias("n_lines"), F.col("_line_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def lines_sql(docs: str) -> str:
    """(doc_id, pos, line, gone) of every line; for tables whose doc_id is unique."""
    space = " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS)
    return f"""
SELECT doc_id, pos, line, length(k) >= 1 AND n >= 10 AS gone
FROM (SELECT *, count(DISTINCT doc_id) OVER (PARTITION BY k) AS n
      FROM (SELECT doc_id, pos, line, translate(trim(line, {space}), '{UPPER}', '{UPPER.lower()}') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM {docs})))"""


SQL = f"""
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM ({lines_sql('documents')}) GROUP BY doc_id"""
