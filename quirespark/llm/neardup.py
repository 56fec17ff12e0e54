"""MinHash near-dedup with BagMinHash signatures of word shingles.

A text is the multiset of its shingles of five words. Equal multisets of words in equal order are one node of the
graph from the start, so thousands of copies cost one signature comparison each at most. A signature has, in each
register, the least point of Poisson processes that belong to the shingles: a shingle of weight w has a process
over (0, w], made of intervals whose bounds double, (0, 1], (1, 2], (2, 4] ..., each a process of its own with a
rate in proportion to its length; a point goes down the halves of its interval, a bit of its hash a level, and
counts if it ends up at or below w. Points come in order and stop at the largest register, which makes a text
cost about its length plus a constant. Two signatures agree in a register with the probability of the weighted
Jaccard similarity.

Signatures are cut into bands. Within a band's bucket, all nodes are paired with the least one only, its hub, and
every pair is verified by the multiset overlap of its texts: they are sorted by hub, whose text goes before those it
meets and is sent once for so many of them, not once a pair. Buckets whose other nodes do not end up in one class are
tested on, first by signatures alone, in tasks of two blocks of a bucket's nodes each: what counts are pairs between
classes that meet in no earlier band and whose sizes and signatures make the threshold possible (the latter within five
standard errors). Only the texts of nodes with such a partner travel, to tasks of two blocks of those, and what comes
back is a spanning forest of verified links between classes. So no bucket is cut off and none emits its pairs.
Components are searched once over the links of nodes and once over those of classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import fresh, measured, released, settled, small_enough, table, text_of
from quirespark.llm.graph import components

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** 5) ** 25 = 0.00005.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Shingles whose processes run at a time.
BATCH = 200_000
#: So many ids (a long each) may be broadcast.
BROADCAST_IDS = 500_000
#: So many nodes of a bucket meet one copy of their hub's text.
HUB_NODES = 1024
#: Bounds of a block of a bucket's nodes whose signatures are compared, and of one whose texts are.
SCREEN_NODES = 4096
BLOCK_NODES, BLOCK_WORDS = 1024, 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, A-Z lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    real = pc.not_equal(words, "")
    coded = words.filter(real).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return hashes[coded.indices.to_numpy()], np.bincount(doc[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def shingled(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) arrays, sorted; a text of fewer words than a shingle has all of them as its one."""
    hashes, sizes = word_hashes(texts)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(hashes)) - first[owner]
    run, length = np.zeros(len(hashes), np.uint64), np.minimum(sizes, words)[owner]
    for k in range(words):
        here = (k < length) & (place + length <= sizes[owner])
        at = np.flatnonzero(here)
        run[at] = _mixed(run[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    starts = np.flatnonzero(place + length <= sizes[owner])
    text, shingle = owner[starts], run[starts]
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[new], shingle[new], np.diff(np.append(new, len(text)))


def bag_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_texts x registers, uint32) of weighted sets given as (text, shingle, weight) arrays."""
    low = np.zeros(len(text), np.int64)
    parts = [(text, shingle, weight, low, low + 1)]
    while len(parts[-1][0]):  # the next interval, of those whose weight reaches into it
        t, s, w, _, high = parts[-1]
        more = w > high
        parts.append((t[more], s[more], w[more], high[more], 2 * high[more]))
    doc, seed, weight, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = _mixed(seed + high.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    found = np.full(n_texts * registers, np.inf)
    point, turn = np.zeros(len(doc)), 0
    span = (high - low).astype(np.float64)
    while len(doc):
        turn += 1
        draw = _mixed(seed + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
        point = point - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (registers * span)
        other = _mixed(draw ^ np.uint64(0xA0761D6478BD642F))
        register = ((other >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        level = low + 1 + (other & (high - low - 1).astype(np.uint64)).astype(np.int64)  # the bits lead down the halves
        counts = level <= weight
        np.minimum.at(found, (doc * registers + register)[counts], point[counts])
        live = point <= found.reshape(n_texts, registers).max(axis=1)[doc]
        doc, seed, weight, low, high, point, span = (x[live] for x in (doc, seed, weight, low, high, point, span))
    return (_mixed(found.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(n_texts, registers)


def _pieces(sizes: np.ndarray) -> list[np.ndarray]:
    held = np.cumsum(sizes) // BATCH
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(held)) + 1) if len(sizes) else []


SIGNED = "doc_id long, row long, raw long, key_a long, key_b long, n_words long, signature array<int>"


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, ids = b.column(3).cast(pa.string()), b.column(0).to_pylist()
        rough = pc.binary_length(texts).to_numpy(zero_copy_only=False) // 6
        for part in _pieces(rough):
            at, n = int(part[0]), len(part)
            own = texts.slice(at, n)
            hashes, sizes = word_hashes(own)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            raw = hashes.tobytes()
            # A text without words is like no other: its key is its id.
            keys = [xxhash.xxh128_intdigest(raw[8 * x : 8 * y]) if y > x else ids[at + i] & (2**64 - 1) for i, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))]
            distinct = {k: i for i, k in enumerate(keys)}  # copies in one batch get one signature
            rows = np.array(sorted(distinct.values()), np.int64)
            signed = bag_minhash(*shingled(own.take(pa.array(rows)), words), len(rows))
            where = {keys[r]: j for j, r in enumerate(rows.tolist())}
            full = signed[[where[k] for k in keys]].view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * REGISTERS, pa.int32()), pa.array(full.ravel()))
            halves = [np.array([(k >> s) & (2**64 - 1) for k in keys], np.uint64).view(np.int64) for s in (0, 64)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, n) for i in range(3)), *map(pa.array, halves), pa.array(sizes, pa.int64()), lists], names=[x.split()[0] for x in SIGNED.split(", ")])


def _shared(one: tuple[np.ndarray, np.ndarray], texts: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """By text, 0 to n, the overlap of its (shingle, weight) with those of ``one``, which are sorted."""
    at = np.searchsorted(one[0], shingles)
    at[at == len(one[0])] = 0
    same = one[0][at] == shingles
    return np.bincount(texts[same], weights=np.minimum(one[1][at[same]], weights[same]), minlength=n)


def _near_hubs(batches: Iterator[pa.RecordBatch], words: int, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of weighted Jaccard similarity of ``least`` or more, of rows (a, b, text) in which a hub's own text,
    whose b is null, goes before those it meets. Between batches only a hub's shingles are kept."""
    hub, size = (np.zeros(1, np.uint64), np.zeros(1, np.int64)), 0
    for batch in batches:
        for part in _pieces(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 6):
            own = batch.slice(int(part[0]), len(part))
            text, shingle, weight = shingled(own.column(2).cast(pa.string()), words)
            edges = np.searchsorted(text, np.arange(len(part) + 1))
            total = np.bincount(text, weights=weight, minlength=len(part))
            shared, against = np.zeros(len(part)), np.zeros(len(part))
            starts = np.flatnonzero(own.column(1).is_null().to_numpy(zero_copy_only=False))
            for first, end in zip([-1, *starts.tolist()], [*starts.tolist(), len(part)], strict=True):
                if first >= 0:
                    x, y = edges[first], edges[first + 1]
                    hub, size = (shingle[x:y], weight[x:y]), total[first]
                x, y = edges[first + 1], edges[end]
                if x < y:
                    shared[first + 1 : end] = _shared(hub, text[x:y] - (first + 1), shingle[x:y], weight[x:y], end - first - 1)
                    against[first + 1 : end] = size
            good = (shared > 0) & (shared >= least * (total + against - shared) - 1e-9)
            good[starts] = False
            yield own.select([0, 1]).filter(pa.array(good))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, raw, text) of the rows with an id; ``raw`` tells the texts of an id apart."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).filter("doc_id IS NOT NULL")
    return rows.select("doc_id", F.xxhash64("text").alias("raw"), "text")


def signatures(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, row, raw, key, n_words, signature) of ``_texts``; key is a 128-bit hash of all words, row a number."""
    return texts.select("doc_id", F.monotonically_increasing_id().alias("row"), "raw", "text").mapInArrow(lambda b: _signed(b, words), SIGNED)


def _thinned(texts: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The texts of the distinct ``ids`` (doc_id), which are ``most`` at most; few ids are broadcast."""
    ids = ids.distinct()
    return texts.join(F.broadcast(ids) if most <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _wanted(texts: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(node, raw, text), once each, of the at most ``most`` nodes that ``asked`` names."""
    return _thinned(texts, asked.select(F.col("node").alias("doc_id")), most).withColumnRenamed("doc_id", "node").dropDuplicates(["node", "raw"])


def _verified(in_buckets: DataFrame, texts: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of a hub and a node of its buckets that are similar enough, and the settled frame they are read from."""
    pairs = in_buckets.groupBy("a", "raw_a", "b", "raw_b").agg(F.ceil(F.max("n") / HUB_NODES).cast("int").alias("parts"))
    pairs, seen = measured(pairs.withColumn("part", F.pmod(F.xxhash64("b", "raw_b"), F.col("parts")).cast("int")))
    group = ["a", "raw_a", "parts", "part"]
    hubs = pairs.select(F.col("a").alias("node"), F.col("raw_a").alias("raw"), *group, F.lit(None).cast("long").alias("b")).distinct()
    asked = pairs.select(F.col("b").alias("node"), F.col("raw_b").alias("raw"), *group, "b").unionByName(hubs)
    met = asked.join(_wanted(texts, asked, 2 * seen["rows"]), ["node", "raw"]).repartition(*group)
    rows = met.sortWithinPartitions(*group, F.col("b").asc_nulls_first()).select("a", "b", "text")
    return rows.mapInArrow(lambda x: _near_hubs(x, words, least), "a long, b long"), pairs


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` with an id: doc_id, component_id (the least id of its class) and kept.

    Texts of ``least`` similarity or more are linked, and classes are what links connect. Words are split at
    ASCII white space with A-Z lower-cased. A text without words, null or empty, is linked with nothing. Rows
    that share an id are one document, linked by any of their texts; rows without an id are left out. Very long
    texts are signed and compared whole; a task holds a few of them at a time. Other columns play no part.
    """
    texts = _texts(docs, doc_id, text)
    signed = settled(signatures(texts, words))
    # One row of each text, a row of its least id, carries the signature on. Aggregates are settled before they are joined:
    # a join splits a hot key only where nothing stands between it and the shuffle.
    first = settled(signed.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("node"), F.min_by("row", "doc_id").alias("first")))
    carried = F.when((F.col("row") == F.col("first")) & (F.col("n_words") > 0), F.col("signature"))
    rows = settled(signed.join(first, ["key_a", "key_b"]).select("doc_id", "raw", "node", "n_words", carried.alias("signature")))
    released(signed)
    released(first)
    nodes = rows.filter("signature IS NOT NULL").select("node", "raw", "n_words", "signature")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * ROWS + 1, F.lit(ROWS))))
    banded = nodes.select("node", "raw", F.posexplode(band).alias("k", "band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("a"), F.min_by("raw", "node").alias("raw_a"), F.count("*").alias("n"))
    hubs = settled(hubs.filter("n > 1"))
    others = banded.join(hubs, "band").filter("node != a OR raw != raw_a")
    in_buckets = settled(others.select("band", "n", "k", "a", "raw_a", F.col("node").alias("b"), F.col("raw").alias("raw_b")))
    released(hubs)
    links, pairs = _verified(in_buckets, texts, words, least)
    # An id of several texts ties them together.
    several = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("node").alias("a"), F.max("node").alias("_z")).filter("a < _z")
    links = links.unionByName(rows.join(several, F.col("doc_id") == F.col("_id")).select("a", F.col("node").alias("b")))
    classes = components(links)
    released(pairs)
    between, read = _between_classes(in_buckets, nodes, classes, texts, words, least)
    joined = components(between)
    for frame in (in_buckets, *read):
        released(frame)
    named = rows.select("doc_id", "node").join(classes, "node", "left").select("doc_id", F.coalesce("component", "node").alias("node"))
    named = named.join(joined, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _between_classes(in_buckets: DataFrame, nodes: DataFrame, classes: DataFrame, texts: DataFrame, words: int, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) between classes, of nodes that share a bucket of which neither is the hub, and the settled frames they
    are read from."""
    named = in_buckets.filter("n > 2").join(classes.withColumnRenamed("node", "b"), "b", "left")
    named = named.select("band", "k", F.col("b").alias("node"), F.col("raw_b").alias("raw"), F.coalesce("component", "b").alias("class"))
    mixed = named.groupBy("band").agg(F.min("class").alias("_l"), F.max("class").alias("_h"), F.ceil(F.count("*") / SCREEN_NODES).cast("int").alias("screens"))
    mixed, seen = measured(mixed.filter("_l < _h").select("band", "screens"))
    none = mixed.select(F.col("band").alias("a"), F.col("band").alias("b")).limit(0)
    if not seen["rows"]:
        return none, [mixed]
    signed = named.join(mixed, "band").join(nodes, ["node", "raw"]).withColumn("screen", F.pmod(F.xxhash64("node", "raw"), F.col("screens")).cast("int"))
    tasks = signed.select("*", F.explode(_pairs_with("screens", "screen", "i", "j")).alias("pair")).select("band", "k", "pair.i", "pair.j", "screen", "class", "node", "raw", "n_words", "signature")
    open_, seen = measured(tasks.groupBy("band", "i", "j").applyInArrow(lambda t: _screened(t, words, least), OPEN))
    if not seen["rows"]:
        return none, [mixed, open_]
    size = F.greatest(F.count("*") / F.lit(BLOCK_NODES), F.sum("n_words") / F.lit(BLOCK_WORDS))
    sized = settled(open_.groupBy("band", "i", "j").agg(F.ceil(size).cast("int").alias("blocks")))
    dealt = open_.join(sized, ["band", "i", "j"]).withColumn("block", F.pmod(F.xxhash64("raw", "node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(_pairs_with("blocks", "block", "p", "q")).alias("pair"))
    own = _wanted(texts, open_, seen["rows"]).join(nodes.drop("n_words"), ["node", "raw"])
    tasks = dealt.join(own, ["node", "raw"]).select("band", "k", "i", "j", "pair.p", "pair.q", "screen", "block", "class", "signature", "text")
    return tasks.groupBy("band", "i", "j", "p", "q").applyInArrow(lambda t: _forest(t, words, least), "a long, b long"), [mixed, open_, sized]


def _pairs_with(n: str, own: str, i: str, j: str) -> Column:
    """The pairs of blocks, of ``n``, that a row of the block ``own`` goes to."""
    return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda x: F.struct(F.least(x, F.col(own)).alias(i), F.greatest(x, F.col(own)).alias(j)))


OPEN = "band long, k int, i int, j int, screen int, class long, node long, raw long, n_words long"


class _Nodes:
    """The nodes of a task, and which of them can be alike enough by size and signature and have met in no band before ``k``."""

    def __init__(self, task: pa.Table, total: np.ndarray, least: float):
        self.total, self.least, self.k = total, least, task["k"][0].as_py()
        self.signature = task["signature"].combine_chunks().flatten().to_numpy().reshape(len(task), -1)
        self.possible = (least - 5 * (least * (1 - least) / REGISTERS) ** 0.5) * REGISTERS

    def alike(self, x: int, others: np.ndarray) -> np.ndarray:
        small, large = (f(self.total[others], self.total[x]) for f in (np.minimum, np.maximum))
        others = others[small >= self.least * large - 1e-9]
        agree = self.signature[others] == self.signature[x]
        others, agree = (v[agree.sum(axis=1) >= self.possible] for v in (others, agree))
        return others[~agree[:, : self.k * ROWS].reshape(len(others), self.k, ROWS).all(axis=2).any(axis=1)]


def _screened(task: pa.Table, words: int, least: float) -> pa.Table:
    """The nodes of two blocks of a bucket that may be alike with one of the other block and of another class."""
    group, screen = (task[c].to_numpy() for c in ("class", "screen"))
    i, j = task["i"][0].as_py(), task["j"][0].as_py()
    nodes = _Nodes(task, np.maximum(task["n_words"].to_numpy() - words + 1, 1), least)
    left, right = np.flatnonzero(screen == i), np.flatnonzero(screen == j)
    open_ = np.zeros(len(task), bool)
    for x in left.tolist():
        near = right[(right > x) if i == j else slice(None)]
        near = nodes.alike(x, near[group[near] != group[x]])
        if len(near):
            open_[x] = open_[near] = True
    return task.filter(pa.array(open_)).select([f.split()[0] for f in OPEN.split(", ")])


def _forest(task: pa.Table, words: int, least: float) -> pa.Table:
    """Links between classes, among the nodes of two blocks of what a screen left, as few as join all they can."""
    group, screen, block = (task[c].to_numpy() for c in ("class", "screen", "block"))
    i, j, p, q = (task[c][0].as_py() for c in "ijpq")
    text, shingle, weight = shingled(task["text"].combine_chunks().cast(pa.string()), words)
    edges = np.searchsorted(text, np.arange(len(group) + 1))
    total = np.bincount(text, weights=weight, minlength=len(group))
    nodes = _Nodes(task, total, least)
    left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
    label = np.unique(group, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for x in left.tolist():
        near = right[(right > x) if p == q else slice(None)]
        near = nodes.alike(x, near[(label[near] != label[x]) & ((i == j) | (screen[near] != screen[x]))])
        own = shingle[edges[x] : edges[x + 1]], weight[edges[x] : edges[x + 1]]
        for y in near.tolist():
            if label[x] == label[y]:
                continue
            at = slice(edges[y], edges[y + 1])
            shared = _shared(own, text[at] - y, shingle[at], weight[at], 1)[0]
            if shared >= least * (total[x] + total[y] - shared) - 1e-9:
                out.append((int(group[x]), int(group[y])))
                label[label == label[y]] = label[x]
    return pa.table({c: pa.array([e[n] for e in out], pa.int64()) for n, c in enumerate("ab")})


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` but those whose class has a lesser id; rows without an id stay, as do all columns."""
    gone = fresh(docs.columns, "_gone")
    ids = settled(near_duplicates(docs, doc_id, **options).filter("NOT kept").select(F.col("doc_id").alias(gone)).distinct())
    if small_enough(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(doc_id).cast("long") == F.col(gone), "left_anti")


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
