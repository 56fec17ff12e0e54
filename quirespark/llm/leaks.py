"""Benchmark decontamination by a prefix-filtered set join.

Every item becomes parts: its windows of ``window`` words, or the whole item if it is shorter. A part is a set of word
shingles. Two passes over the documents find where a part occurs:

1. Shingles of parts are counted in the documents, which orders the shingles of each part by rarity. A document
   window that holds a share ``threshold`` of a part's shingles must hold one of its rarest ``n - ceil(threshold * n) + 1``:
   these are the part's prefix.
2. Documents meet the prefixes only, in a join on the shingle. A meeting fixes where the part would lie, which has
   to be inside the document (length and position), and the words around it, which came along, say whether it does.

No task holds all items: a bitmap of at most ``2 ** SIEVE_BITS`` bits keeps most document shingles out of the join,
and what passes by chance is lost in it. A join key holds a shingle of the parts on one side, so a passage that many
documents share is split by AQE's skew join; a part that many items share is one part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import terms
from quirespark.llm.common import UPPER, measured, released, settled, table

WINDOW = 10
SHINGLE = 5
#: 16 MB; smaller for fewer shingles, 32 bits for each.
SIEVE_BITS = 27


class Sieve:
    """A bitmap of shingles for the tasks: most shingles it lacks are told at once."""

    def __init__(self, grams: DataFrame, n: int):
        """Of column ``gram``, ``n`` of them at most."""
        self.bits = min(SIEVE_BITS, max(15, math.ceil(math.log2(32 * max(n, 1)))))
        place = F.shiftrightunsigned("gram", 64 - self.bits)
        rows = grams.groupBy(F.shiftright(place, 15).alias("k")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << 15))).alias("bits")).collect()
        blank = bytes(1 << 12)
        found = {r.k: bytes(r.bits) for r in rows}  # 2 ** (bits - 15) rows of 4 KB
        self.data = b"".join(found.get(k, blank) for k in range(1 << (self.bits - 15)))

    def holds(self, grams: np.ndarray) -> np.ndarray:
        place = grams >> np.uint64(64 - self.bits)
        byte = np.frombuffer(self.data, np.uint8)[(place >> np.uint64(3)).astype(np.int64)]
        return (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _joined(words: list[str]) -> str:
    return "".join(f"{w} " for w in words)


def _windows(batches: Iterator[pa.RecordBatch], window: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(item, part, n, grams) of every part of every item."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        item, part, n, grams = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(part, pa.string()), pa.array(n, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["item", "part", "n", "grams"])

    rows: list[tuple] = []
    for b in batches:
        items = iter(b.column(0).to_pylist())
        for texts in terms.slices(b.column(1)):
            flat, offsets = terms.words(texts, terms.LETTERS_DIGITS)
            each, plain = terms.hashes(flat), flat.to_pylist()
            grams = {k: terms.gram_hashes(each, k).view(np.int64) for k in range(1, shingle + 1)}
            for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                item, n = next(items), min(window, high - low)
                k = min(shingle, n)
                for s in range(low, high - n + 1) if n else ():
                    rows.append((item, _joined(plain[s : s + n]), n, grams[k][s : s + n - k + 1]))
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
    if rows:
        yield batch(rows)


def _found(texts: pa.Array, sieve: Sieve, sizes: list[int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words and offsets of ``texts``; where the shingles of ``sizes`` words begin that the sieve holds, and they."""
    flat, offsets = terms.words(texts, terms.LETTERS_DIGITS)
    each, at, held = terms.hashes(flat), [], []
    for k in sizes:
        places = terms.inside_texts(offsets, k)
        grams = terms.gram_hashes(each, k)[places]
        kept = sieve.holds(grams)
        at.append(places[kept])
        held.append(grams[kept])
    return flat, offsets, np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*held, np.zeros(0, np.uint64)])


def _counted(batches: Iterator[pa.RecordBatch], sieve: Sieve, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for texts in terms.slices(b.column(1)):
            grams, n = np.unique(_found(texts, sieve, sizes)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])


def _met(batches: Iterator[pa.RecordBatch], sieve: Sieve, sizes: list[int], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (row, id, n_words) and one for each of its shingles that may be in a prefix, with the
    words that a part around it could have."""
    row = (TaskContext.get().partitionId() << 33) - 1
    for b in batches:
        at = 0
        for texts in terms.slices(b.column(1)):
            flat, offsets, places, grams = _found(texts, sieve, sizes)
            ids = np.arange(row + 1, row + 1 + len(texts))
            none = lambda n, kind: pa.nulls(n, kind)
            size = len(texts)
            heads = [pa.array(ids), b.column(0).slice(at, size), pa.array(np.diff(offsets)), none(size, pa.int32()), none(size, pa.int64()), none(size, pa.string()), none(size, pa.string())]
            names = ["_row", "_id", "n_words", "at", "gram", "before", "after"]
            yield pa.RecordBatch.from_arrays(heads, names=names)
            row, at = row + size, at + size
            if not len(places):
                continue
            spelt = pc.binary_join_element_wise(flat, *(pa.scalar(x, pa.large_string()) for x in (" ", "")))  # every word with a space after it, one after another
            bounds, data = (np.frombuffer(x, kind) for x, kind in zip(spelt.buffers()[1:], (np.int64, np.uint8), strict=True))
            data = data.tobytes()
            owner = np.searchsorted(offsets, places, "right") - 1
            for low in range(0, len(places), 20_000):
                own, where = owner[low : low + 20_000], places[low : low + 20_000]
                n, middle = len(own), bounds[where].tolist()
                first, last = bounds[np.maximum(offsets[own], where - window)].tolist(), bounds[np.minimum(offsets[own + 1], where + window)].tolist()
                rows = [pa.array(ids[own]), none(n, b.column(0).type), none(n, pa.int64()), pa.array((where - offsets[own]).astype(np.int32)), pa.array(grams[low : low + 20_000].view(np.int64))]
                before, after = ([data[i:j] for i, j in zip(x, y, strict=True)] for x, y in ((first, middle), (middle, last)))
                yield pa.RecordBatch.from_arrays([*rows, pa.array(before, pa.binary()).cast(pa.string()), pa.array(after, pa.binary()).cast(pa.string())], names=names)


def _placed(at: Column, start: Column, n: Column) -> Column:
    return F.struct((at - start).alias("start"), (at - start + n).alias("stop"))


def _whole(met: DataFrame) -> DataFrame:
    """Meetings where the document has all words of the part in its order."""
    tail = F.expr("substring_index(part, ' ', offset - n - 1)")  # without the first ``offset`` words; each ends with a space
    head = F.expr("substring_index(part, ' ', offset)")
    head = F.when(F.col("offset") == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), head, F.lit(" ")))
    held = F.startswith("after", tail) & F.endswith(F.concat(F.lit(" "), "before"), head)
    return met.filter((F.col("at") >= F.col("offset")) & held).withColumn("span", _placed(F.col("at"), F.col("offset"), F.col("n")))


def _shared(met: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Meetings where a window as long as the part, with the shingle anywhere in it, holds a share of its shingles."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    k = F.least(F.lit(shingle), F.col("n"))
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " ")))
    met = met.withColumn("_before", words("before")).withColumn("_around", F.concat("_before", words("after"))).withColumn("_own", grams(words("part")))
    first = F.greatest(F.lit(0), F.size("_before") - F.col("n") + k)
    last = F.least(F.size("_before"), F.size("_around") - F.col("n"))
    share = lambda a: F.size(F.array_intersect(grams(F.slice("_around", a + 1, F.col("n"))), F.col("_own"))) / F.size("_own")
    tried = F.when(last >= first, F.transform(F.sequence(first, last), lambda a: F.struct((-share(a)).alias("share"), a.alias("a"))))
    met = met.withColumn("_best", F.array_min(tried)).filter(-F.col("_best.share") >= F.lit(threshold - 1e-9))
    return met.withColumn("span", _placed(F.col("at"), F.size("_before") - F.col("_best.a"), F.col("n")))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, threshold: float = 1.0
) -> DataFrame:
    """For every row of ``docs`` (doc_id, n_words, n_hit, items, spans): the items with parts in its text, sorted as
    strings, and the stretches of words [start, stop) that parts cover, ``n_hit`` words in all.

    With ``threshold`` 1 a part occurs where all its words stand in its order; below, in each window of as many words
    that holds this share of its distinct shingles, of which the best around each meeting counts. Null and empty texts
    have no words; rows that repeat an id or a text each get their own result; an item without words has no part,
    without an id it is called '', and items of one id are one. Other columns of either table are not read. Without
    items nothing is hit. Very long texts are read whole.
    """
    spread = partial(_windows, window=window, shingle=shingle)
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("_text"))
    held, _ = measured(own.mapInArrow(spread, "item string, part string, n int, grams array<long>").distinct())
    parts, seen = measured(held.groupBy("part").agg(F.first("n").alias("n"), F.first("grams").alias("grams")).withColumn("id", F.monotonically_increasing_id()), grams=F.sum(F.size("grams")))
    sizes = sorted(r[0] for r in parts.select(F.least(F.lit(shingle), "n")).distinct().collect())  # at most ``shingle``
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))

    every = parts.select("id", F.posexplode("grams").alias("offset", "gram"))
    counted = partial(_counted, sieve=Sieve(every, seen["grams"] or 0), sizes=sizes)
    often = texts.mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("often"))
    order = F.sort_array(F.collect_list(F.struct("often", "gram", "offset")))
    needed = lambda n: n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1
    rarest = every.groupBy("id", "gram").agg(F.min("offset").alias("offset")).join(often, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    chosen = rarest.groupBy("id").agg(order.alias("o")).select("id", F.explode(F.slice("o", F.lit(1), needed(F.size("o")).cast("int"))).alias("o"))
    prefixes, kept = measured(chosen.filter("o.often > 0").join(parts.select("id", "part", "n"), "id").select("id", "part", "n", "o.offset", "o.gram"))

    id_type = texts.schema["_id"].dataType.simpleString()
    meets = partial(_met, sieve=Sieve(prefixes, kept["rows"]), sizes=sizes, window=window)
    rows = settled(texts.mapInArrow(meets, f"_row long, _id {id_type}, n_words long, at int, gram long, before string, after string"))
    met = rows.filter("gram IS NOT NULL").drop("_id", "n_words").join(prefixes, "gram")
    occurs = _whole(met) if threshold >= 1 else _shared(met, shingle, threshold)
    occurs = settled(occurs.select("_row", "id", "span").distinct())
    released(prefixes)

    names = occurs.select("_row", "id").distinct().join(held.join(parts.select("id", "part"), "part").select("id", "item"), "id")
    names = names.groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = occurs.groupBy("_row").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("edge"))
    grown = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["edge"]))).alias("n"), F.greatest(s["edge"], x["stop"]).alias("edge"))
    out = rows.filter("gram IS NULL").join(spans.join(names, "_row"), "_row", "left")
    found = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", F.aggregate(found, start, grown)["n"].alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), found.alias("spans"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH item AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
parts AS (
  SELECT DISTINCT item, array_to_string(w[s : s + n - 1], ' ') AS part, n
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM item) WHERE n > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
spots AS (
  SELECT r, s, n, array_to_string(w[s : s + n - 1], ' ') AS part
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, (SELECT DISTINCT n FROM parts) WHERE len(w) >= n)),
found AS (SELECT r, s, spots.n, item FROM spots JOIN parts USING (part)),
hit AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
names AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN names USING (r)"""
