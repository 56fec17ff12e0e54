"""A stored inverted index that is searched by upper bounds and brought up to date by deltas.

A folder holds segments, each of the documents of one update:

* ``forward``: (number, doc_id, digest, length, terms): documents in the order of their length, dealt to ranges of ``SPAN``;
* ``postings``, by ``bucket`` of the term's hash and sorted by (term, range): a row is a block, the postings of one term in one
  range. Documents are the bits of a number, frequencies and lengths arrays beside it. ``max_tf`` and ``min_length`` bound what
  the block can give to a score, whatever the average length is.

``deltas`` count, for each update, the documents that a term has gained or lost, and ``dead`` names documents that were
replaced or deleted. Statistics are sums of deltas, equal to those of an index made anew. An update counts once its row in
``commits`` is there, which is written last; what an update that failed has left is not read.

``search`` gives the rows of BM25 over all documents, but reads few postings of frequent terms:

1. the strongest terms of a query give candidates, whose whole scores are looked up; the k-th best is a bound;
2. ranges are skipped whose block maxima cannot reach the bound together; so are, everywhere, terms that cannot lift a
   document over it together; documents are kept if what they have and the best of what was set aside reach the bound;
3. for these the terms set aside are looked up.

Blocks of asked terms are sent once to where their ranges are scored, and the terms of the queries go to every task. More than
``BROADCAST_TERMS`` terms of queries, or ``BROADCAST_BYTES``, meet blocks and candidates in joins instead.

How much that spares depends on the queries. Where all of a query's terms are frequent and documents score alike, most of
the postings are needed, by any order of reading.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirespark.functions.text import tokens
from quirespark.operators.retrieve import B, DIGITS, EPSILON, K1, SLICE_TOKENS, _slices, ranked
from quirespark.sources import store

#: Documents of a range, 62 at most.
SPAN = 16
#: Ranges whose documents lie in one task while postings are made.
STRETCH = 4
BUCKETS = 32
#: Up to so many distinct query terms go into the scan's filter, so that row groups without them are skipped.
PUSHED_TERMS = 2000
#: So many terms of queries, of so many bytes in all with 24 for each besides, may be broadcast.
BROADCAST_TERMS, BROADCAST_BYTES = 50_000, 8 << 20
#: Candidates that give a query its bound, in multiples of k, counted by document frequencies.
EAGER = 2
_SLACK = 1e-6


_SEGMENT = {
    "forward": "number long, doc_id string, digest string, length int, terms array<struct<term:string,tf:int>>",
    "postings": "term string, range long, bits long, ats array<int>, tfs array<int>, lengths array<int>, max_tf int, min_length int, bucket int",
    "deltas": "term string, n long",
    "dead": "of int, number long",
}


class Stats(NamedTuple):
    n_docs: int = 0
    total_length: int = 0
    n_terms: int = 0
    mean_idf: float | None = None

    @property
    def avg_length(self) -> float | None:
        return self.total_length / self.n_docs if self.n_docs else None


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _updates(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the updates that are whole."""
    return sorted(int(n) for n in store.children(spark, f"{path}/commits") if store.exists(spark, f"{path}/commits/{n}/_SUCCESS"))


def _read(spark: SparkSession, path: str, part: str, updates: list[int]) -> DataFrame:
    """A part of all segments, with the number of each."""
    out = spark.createDataFrame([], f"{_SEGMENT[part]}, segment int")
    for n in updates:
        out = out.unionByName(spark.read.schema(_SEGMENT[part]).parquet(f"{path}/{part}/{n}").withColumn("segment", F.lit(n)))
    return out


def live(spark: SparkSession, path: str) -> DataFrame:
    """(segment, number, doc_id, digest, length, terms) of the documents that the index stands for."""
    updates = _updates(spark, path)
    dead = _read(spark, path, "dead", updates).select(F.col("of").alias("segment"), "number")
    return _read(spark, path, "forward", updates).join(dead, ["segment", "number"], "left_anti")


def stats(spark: SparkSession, path: str) -> Stats:
    """Of the documents that the index stands for."""
    updates = _updates(spark, path)
    return Stats(*spark.read.parquet(f"{path}/commits/{updates[-1]}").select(*Stats._fields).first()) if updates else Stats()


def update(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> dict[str, int]:
    """Brings the index in ``path`` in line with ``docs``, all documents there are now; says how many were ``added``
    (new or with another text) and how many entries went ``dead``.

    Ids are compared as strings; a null id is '', and of rows that repeat an id the least text counts; a null text is an
    empty one. Unchanged documents are neither split nor written again. Without changes there is no update.
    """
    spark, updates = docs.sparkSession, _updates(docs.sparkSession, path)
    n = updates[-1] + 1 if updates else 0
    at = lambda part: f"{path}/{part}/{n}"
    now, known = _distinct(docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))), live(spark, path)
    gone = known.join(now.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti") if updates else known
    gone = store.written(gone.select(F.col("segment").alias("of"), "number"), at("dead"))

    # Known digests are hashed, so that no texts are sorted to meet them.
    fresh = now.join(known.select("doc_id", "digest").hint("shuffle_hash"), ["doc_id", "digest"], "left_anti") if updates else now
    counted = fresh.select("doc_id", "digest", tokens(F.col("text"))).mapInArrow(_counted, "doc_id string, digest string, length int, terms array<struct<term:string,tf:int>>")
    forward = _numbered(store.written(counted), at("forward"))  # written, as ranges are sampled before they are dealt
    added, length = forward.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    less = _read(spark, path, "forward", updates).join(gone.withColumnRenamed("of", "segment"), ["segment", "number"], "left_semi")
    dead, lost = less.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not added and not dead:
        return {"added": 0, "dead": 0}
    before = stats(spark, path)
    _segment(forward, less, path, [*updates, n], before.n_docs + added - dead, before.total_length + length - lost)
    return {"added": added, "dead": dead}


def _distinct(rows: DataFrame) -> DataFrame:
    """(doc_id, text, digest) with the least text of an id. Texts of ids that stand there once are not shuffled if all do."""
    again = store.written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if not again.isEmpty():
        least = rows.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        rows = rows.join(again, "doc_id", "left_anti").unionByName(least)
    return rows.withColumn("digest", F.sha2("text", 256))


def compacted(spark: SparkSession, path: str, into: str) -> None:
    """Writes the documents that the index in ``path`` stands for as an index of one segment, a new folder; no text is needed."""
    own = stats(spark, path)
    forward = _numbered(live(spark, path).select("doc_id", "digest", "length", "terms"), f"{into}/forward/0")
    store.written(spark.createDataFrame([], _SEGMENT["dead"]), f"{into}/dead/0")
    _segment(forward, forward.limit(0), into, [0], own.n_docs, own.total_length)


def _numbered(rows: DataFrame, path: str) -> DataFrame:
    """Documents in the order of their length, with their places in it."""
    ordered = rows.repartitionByRange("length", "doc_id").sortWithinPartitions("length", "doc_id")
    return store.written(ordered.select(F.monotonically_increasing_id().alias("number"), "doc_id", "digest", "length", "terms"), path)


def _segment(forward: DataFrame, less: DataFrame, path: str, updates: list[int], n_docs: int, total_length: int) -> None:
    """Postings and deltas of a segment of ``forward`` documents, with which those of ``less`` go, and the commit."""
    spark, n = forward.sparkSession, updates[-1]
    _blocks(forward).write.mode("overwrite").option("parquet.block.size", 4 << 20).partitionBy("bucket").parquet(f"{path}/postings/{n}")
    gained = _read(spark, path, "postings", [n]).select("term", F.bit_count("bits").cast("long").alias("n"))
    lost = less.select(F.explode("terms.term").alias("term"), F.lit(-1).cast("long").alias("n"))
    store.written(gained.unionByName(lost).groupBy("term").agg(F.sum("n").alias("n")).filter("n != 0"), f"{path}/deltas/{n}")
    _committed(spark, path, updates, n_docs, total_length)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, digest, words) with the distinct terms of each and how often they stand there, a slice at a time."""
    for batch in batches:
        at = 0
        for words, length in _slices(batch.column(2)):
            n, flat = len(words), words.flatten().dictionary_encode()
            size = max(1, len(flat.dictionary))
            pair, tf = np.unique(np.repeat(np.arange(n), length) * size + flat.indices.to_numpy(), return_counts=True)
            entries = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(pair % size)), pa.array(tf.astype(np.int32))], ["term", "tf"])
            terms = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair // size, np.arange(n + 1)).astype(np.int32)), entries)
            columns = [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(length.astype(np.int32)), terms]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "length", "terms"])
            at += n


def _blocks(forward: DataFrame) -> DataFrame:
    """A task has the documents of whole ranges one after another, so blocks are made where they are and no posting is shuffled."""
    near = forward.select("number", "length", "terms").repartition(F.expr(f"number div {SPAN * STRETCH}")).sortWithinPartitions("number")
    blocks = near.mapInArrow(_packed, _SEGMENT["postings"].removesuffix(", bucket int")).withColumn("bucket", _bucket(F.col("term")))
    return blocks.sortWithinPartitions("bucket", "term", "range")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (number, length, terms) in the order of their numbers."""
    held = None  # documents of a range that may go on in the next batch
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows.cast(held.schema)]) if held is not None else rows
        if rows.num_rows:
            span = rows["number"].to_numpy() // SPAN
            cut = int(np.searchsorted(span, span[-1]))
            yield from _blocks_of(rows.slice(0, cut))
            held = rows.slice(cut)
    if held is not None:
        yield from _blocks_of(held)


def _blocks_of(docs: pa.Table) -> Iterator[pa.RecordBatch]:
    """Blocks of whole ranges, made for so many documents at a time as have ``SLICE_TOKENS`` entries; of a range at least."""
    number = docs["number"].to_numpy()
    total = np.cumsum(pc.list_value_length(docs["terms"]).to_numpy())
    begins = np.append(np.flatnonzero(np.diff(number // SPAN, prepend=-1)), len(number))  # where ranges begin
    first = 0
    while first < len(begins) - 1:
        start = begins[first]
        last = int(np.searchsorted(total, (total[start - 1] if start else 0) + SLICE_TOKENS, "right"))
        first = max(first + 1, int(np.searchsorted(begins, last, "right")) - 1)
        yield _block_rows(docs.slice(start, begins[first] - start).combine_chunks())


def _block_rows(docs: pa.Table) -> pa.RecordBatch:
    number, length = docs["number"].to_numpy(), docs["length"].to_numpy()
    lists = pa.concat_arrays(docs["terms"].chunks)
    entries = lists.flatten()
    doc = np.repeat(np.arange(len(number)), pc.list_value_length(lists).to_numpy())
    terms, tf = entries.field("term").dictionary_encode(), entries.field("tf").to_numpy()
    span = number // SPAN
    place = np.cumsum(np.diff(span, prepend=span[0]) > 0)[doc]  # of a document's range
    key = terms.indices.to_numpy().astype(np.int64) * len(number) + place
    order = np.argsort(key, kind="stable")  # documents of a block stay in their order
    begins = np.flatnonzero(np.diff(key[order], prepend=-1))
    doc, tf, one = doc[order], tf[order].astype(np.int32), order[begins]
    at, of, ends = (number[doc] % SPAN).astype(np.int32), length[doc].astype(np.int32), pa.array(np.append(begins, len(order)).astype(np.int32))
    reduced = lambda f, x: f.reduceat(x, begins) if len(begins) else x[:0]
    columns = {
        "term": terms.dictionary.take(terms.indices.take(pa.array(one))),
        "range": pa.array(span[doc[begins]]),
        "bits": pa.array(reduced(np.bitwise_or, np.int64(1) << at.astype(np.int64))),
        **{name: pa.ListArray.from_arrays(ends, pa.array(x)) for name, x in (("ats", at), ("tfs", tf), ("lengths", of))},
        "max_tf": pa.array(reduced(np.maximum, tf)),
        "min_length": pa.array(reduced(np.minimum, of)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _part(tf: Column, length: Column, average: float, k1: float, b: float) -> Column:
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b / average) * length))


def _committed(spark: SparkSession, path: str, updates: list[int], n_docs: int, total_length: int) -> None:
    """Writes the document frequencies of all terms, then the row that makes the update valid."""
    df = _read(spark, path, "deltas", updates).groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
    totals = store.written(df.select("term", "df", _bucket(F.col("term")).alias("bucket")), f"{path}/totals/{updates[-1]}")
    idf = F.log(F.lit(n_docs) - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    terms, mean = totals.agg(F.count("*"), F.avg(idf)).first()
    row = spark.createDataFrame([(n_docs, total_length, terms, mean)], "n_docs long, total_length long, n_terms long, mean_idf double")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{updates[-1]}")


class Found(NamedTuple):
    """``rows`` (query_id, doc_id, bm25, rank); ``reads``: the postings of all query terms, once a query, and how many of
    them were looked at to find the bounds and the candidates, and looked up for candidates."""

    rows: DataFrame
    reads: dict[str, int]


def _seen(rows: Observation) -> int:
    """How many rows were observed; none if the optimizer found their table empty and left it out."""
    try:
        return rows.get["n"]
    except Py4JJavaError:
        return 0


def search(path: str, queries: DataFrame, k: int, query_id: str = "query_id", text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> Found:
    """The ``k`` best documents of each query, as BM25 over all documents of the index ranks them; among equals the greater
    id, as a string, comes first. A term repeated in a query counts again; documents without a term of the query are not ranked."""
    spark, updates = queries.sparkSession, _updates(queries.sparkSession, path)
    own = stats(spark, path)
    kind = queries.select(F.col(query_id)).schema[0].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    if not own.total_length:
        return Found(spark.createDataFrame([], f"query_id {kind}, doc_id string, bm25 double, rank int"), {})
    totals = spark.read.parquet(f"{path}/totals/{updates[-1]}")
    asked = store.written(asked.join(totals, "term"))
    part = lambda tf, length: _part(tf, length, own.avg_length, k1, b)

    blocks = _read(spark, path, "postings", updates)
    blocks = blocks.filter(F.col("bucket").isin([r[0] for r in asked.select("bucket").distinct().collect()]))  # ``BUCKETS`` at most
    terms = [r[0] for r in asked.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(terms) <= PUSHED_TERMS:
        blocks = blocks.filter(F.col("term").isin(terms))
    blocks = blocks.join(asked.select("term").distinct(), "term", "left_semi").withColumn("top", part(F.col("max_tf"), F.col("min_length")))
    blocks = store.written(blocks.select("segment", "bucket", "term", "range", "bits", "ats", "tfs", "lengths", "top"))  # read four times
    peaks = blocks.groupBy("term").agg(F.max("top").alias("peak"))
    idf = F.log(F.lit(own.n_docs) - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    weight = F.col("qtf") * F.when(idf < 0, F.lit(epsilon * own.mean_idf)).otherwise(idf)
    asked = asked.join(peaks, "term").withColumn("w", weight).withColumn("most", F.greatest(F.lit(0.0), F.col("w") * F.col("peak")))
    by = Window.partitionBy("query_id")  # a window is one query's terms
    asked = store.written(asked.select("query_id", "bucket", "term", "df", "w", "most", F.sum("most").over(by).alias("all")))
    seen = {n: Observation() for n in ("bound", "looked_up", "candidates")}
    dead = _read(spark, path, "dead", updates).select(F.col("of").alias("segment"), "number")

    def scored(some: DataFrame, name: str, within: DataFrame | None = None) -> DataFrame:
        """(query_id, segment, number, score) from the postings of ``some`` terms, if need be of some ranges only."""
        met = some.join(blocks, ["bucket", "term"])
        if within is not None:
            met = met.join(within, ["query_id", "segment", "range"], "left_semi")
        each = met.select("query_id", "segment", "range", "w", F.inline(F.arrays_zip("ats", "tfs", "lengths"))).observe(seen[name], F.count("*").alias("n"))
        score = F.sum(F.col("w") * part(F.col("tfs"), F.col("lengths"))).alias("score")
        return each.groupBy("query_id", "segment", (F.col("range") * SPAN + F.col("ats")).alias("number")).agg(score).join(dead, ["segment", "number"], "left_anti")

    def looked_up(docs: DataFrame, some: DataFrame, name: str | None) -> DataFrame:
        """(query_id, segment, number, score) of ``docs``, with what ``some`` terms add to their score."""
        wanted = docs.withColumn("range", F.expr(f"number div {SPAN}")).withColumn("at", (F.col("number") % SPAN).cast("int"))
        wanted = store.written(wanted.join(some.select("query_id", "bucket", "term", "w"), "query_id"))  # of a known size when it meets blocks
        met = wanted.join(blocks, ["bucket", "term", "segment", "range"])
        met = met.filter("getbit(bits, at) = 1").withColumn("i", F.expr("cast(bit_count(bits & (shiftleft(1L, at) - 1)) as int)"))
        if name:
            met = met.observe(seen[name], F.count("*").alias("n"))
        more = met.select("query_id", "segment", "number", (F.col("w") * part(F.get("tfs", F.col("i")), F.get("lengths", F.col("i")))).alias("score"))
        return docs.select("query_id", "segment", "number", "score").unionByName(more).groupBy("query_id", "segment", "number").agg(F.sum("score").alias("score"))

    strong = asked.withColumn("before", F.sum("df").over(by.orderBy(F.desc("most"), "df", "term").rowsBetween(Window.unboundedPreceding, -1)))
    strong = strong.filter(F.coalesce("before", F.lit(0)) < EAGER * k)
    first = ranked(scored(strong, "bound"), "score", k, F.col("number").asc()).select("query_id", "segment", "number", F.lit(0.0).alias("score"))
    best = store.written(looked_up(store.written(first), asked, "looked_up"))
    least = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("query_id", (F.col("least") - _SLACK).alias("least"))

    small = F.sum("most").over(by.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    parted = asked.join(least, "query_id", "left").withColumn("together", small)
    parted = store.written(parted.withColumn("aside", F.coalesce(F.col("together") < F.col("least"), F.lit(False))).select("query_id", "bucket", "term", "w", "most", "least", "aside"))
    n, size = parted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()
    if n <= BROADCAST_TERMS and size <= BROADCAST_BYTES:
        near = blocks.repartition("segment", F.expr(f"range div {STRETCH}")).sortWithinPartitions("segment", "range")
        near = near.select("term", "segment", "range", "top", "ats", "tfs", "lengths")
        kind_of = parted.schema["query_id"].dataType
        made = store.written(near.mapInArrow(_ranges_scored(parted.collect(), to_arrow_type(kind_of), own.avg_length, k1, b), f"query_id {kind}, segment int, number long, score double, reads long"))
        full = made.filter("reads IS NULL").select("query_id", "segment", "number", "score").join(dead, ["segment", "number"], "left_anti")
        reads = {n: _seen(seen[n]) for n in ("bound", "looked_up")} | {"candidates": made.agg(F.coalesce(F.sum("reads"), F.lit(0))).first()[0]}
    else:
        rest = parted.filter("aside").groupBy("query_id").agg(F.sum("most").alias("rest"))
        reach = F.sum(F.greatest(F.lit(0.0), F.col("w") * F.col("top")))
        within = parted.join(blocks.select("bucket", "term", "segment", "range", "top"), ["bucket", "term"]).groupBy("query_id", "segment", "range").agg(reach.alias("reach"), F.first("least").alias("least"))
        within = store.written(within.filter("least IS NULL OR reach >= least").select("query_id", "segment", "range"))
        kept = scored(parted.filter("NOT aside").select("query_id", "bucket", "term", "w"), "candidates", within).join(least, "query_id", "left").join(rest, "query_id", "left")
        kept = store.written(kept.filter("least IS NULL OR score + coalesce(rest, 0) >= least").select("query_id", "segment", "number", "score"))
        reads = {n: _seen(o) for n, o in seen.items()}
        full = looked_up(kept, parted.filter("aside"), None)
    reads["all"] = asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]

    ids = _read(spark, path, "forward", updates).select("segment", "number", "doc_id")
    named = full.join(ids, ["segment", "number"]).select("query_id", "doc_id", F.round("score", DIGITS).alias("bm25"))
    return Found(ranked(named, "bm25", k), reads)


def _ranges_scored(rows: list, kind: pa.DataType, average: float, k1: float, b: float):
    """What scores blocks (term, segment, range, top, ats, tfs, lengths), sorted by segment and range, for queries ``rows``
    (query_id, term, w, most, least, aside): documents that may reach ``least`` (query_id, segment, number, score), and a
    row that says how many postings of terms not set aside were looked at."""
    terms = sorted({r["term"] for r in rows})
    place = {t: i for i, t in enumerate(terms)}
    asked: dict = {}
    for r in rows:
        asked.setdefault(r["query_id"], []).append(r)
    queries = []
    for own in asked.values():
        aside = np.array([r["aside"] for r in own])
        rest = sum(r["most"] for r in own if r["aside"])
        queries.append((np.array([place[r["term"]] for r in own]), np.array([r["w"] for r in own]), aside, own[0]["least"], rest))
    ids, terms = pa.array(list(asked), kind), pa.array(terms, pa.string())

    def gathered(first: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Places of stretches that begin at ``first`` and are so many long, one after another."""
        return np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())

    def found(rows: pa.Table) -> Iterator[tuple[pa.RecordBatch, int]]:
        """For whole ranges."""
        term = pc.index_in(rows["term"], value_set=terms).to_numpy()
        order = np.argsort(term, kind="stable")
        rows, term = rows.take(pa.array(order)), term[order]
        segment, range_, top = rows["segment"].to_numpy(), rows["range"].to_numpy(), rows["top"].to_numpy()
        names, of = np.unique(np.stack([segment, range_]), axis=1, return_inverse=True)
        of = of.ravel()
        n = pc.list_value_length(rows["ats"]).to_numpy()
        at, tf, length = (pc.list_flatten(rows[c]).to_numpy() for c in ("ats", "tfs", "lengths"))
        starts, doc = np.cumsum(n) - n, np.repeat(of * SPAN, n) + at
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b / average * length))
        ends, n_docs = np.searchsorted(term, np.arange(len(terms) + 1)), names.shape[1] * SPAN
        for q, (own, w, aside, least, rest) in enumerate(queries):
            many = ends[own + 1] - ends[own]
            block = gathered(ends[own], many)
            if not len(block):
                continue
            weight, later, read = np.repeat(w, many), np.repeat(aside, many), 0
            near = np.ones(len(block), bool)
            if least is not None:
                near = (np.bincount(of[block], np.maximum(0, weight * top[block]), names.shape[1]) >= least)[of[block]]
            use = near & ~later
            which = gathered(starts[block[use]], n[block[use]])
            if not len(which):
                continue
            read = len(which)
            score = np.bincount(doc[which], np.repeat(weight[use], n[block[use]]) * part[which], n_docs)
            there = np.bincount(doc[which], minlength=n_docs) > 0
            if least is not None:
                there &= score + rest >= least
            use = near & later & there.reshape(-1, SPAN).any(axis=1)[of[block]]
            which = gathered(starts[block[use]], n[block[use]])
            score += np.bincount(doc[which], np.repeat(weight[use], n[block[use]]) * part[which], n_docs)
            if least is not None:
                there &= score >= least
            x = np.flatnonzero(there)
            columns = [ids.take(pa.array(np.full(len(x), q))), pa.array(names[0][x // SPAN].astype(np.int32)), pa.array(names[1][x // SPAN] * SPAN + x % SPAN), pa.array(score[x]), pa.nulls(len(x), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "segment", "number", "score", "reads"]), read

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads, held, size = 0, [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            segment, range_ = rows["segment"].to_numpy(), rows["range"].to_numpy()
            held.append(rows)
            size += pc.sum(pc.list_value_length(rows["ats"])).as_py() or 0
            cut = int(np.flatnonzero((segment != segment[-1]) | (range_ != range_[-1]))[-1]) + 1 if len(segment) and (segment[0], range_[0]) != (segment[-1], range_[-1]) else 0
            if size > SLICE_TOKENS and cut:  # the last range may go on
                for out, read in found(pa.concat_tables([*held[:-1], rows.slice(0, cut)])):
                    reads += read
                    yield out
                held = [rows.slice(cut)]
                size = pc.sum(pc.list_value_length(held[0]["ats"])).as_py() or 0
        if sum(map(len, held)):
            for out, read in found(pa.concat_tables(held)):
                reads += read
                yield out
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([reads])], names=["query_id", "segment", "number", "score", "reads"])

    return scored
