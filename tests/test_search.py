"""The stored index and the stored cells against plain scores."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirespark.operators import index, models, nearest, retrieve
from quirespark.plans import catalog
from quirespark.sources import store


def texts(rng, n, vocabulary=300):
    """Words of very different frequency, so that bounds have something to cut."""
    return [" ".join(f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randint(0, 40))) for _ in range(n)]


def by_scan(docs, asked, k):
    docs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return {(r.query_id, r.doc_id, r["rank"]): r.bm25 for r in retrieve.ranked(retrieve.bm25(docs, asked), "bm25", k).collect()}


def by_index(path, asked, k):
    found = index.search(path, asked, k)
    return {(r.query_id, r.doc_id, r["rank"]): r.bm25 for r in found.rows.collect()}, found.reads


def full_stats(docs):
    own = retrieve.corpus_stats(docs).first()
    return (own.n_docs, own.n_terms, pytest.approx(own.avg_length), pytest.approx(own.mean_idf))


def stats_of(spark, path):
    own = index.stats(spark, path)
    return own.n_docs, own.n_terms, own.avg_length, own.mean_idf


def test_index_ranks_as_a_scan_does(spark, tmp_path):
    rng = random.Random(1)
    rows = list(enumerate([*texts(rng, 600), None, "", "w1 w1 w1", "w1 w1 w1"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([("a", "w299 w250 w0"), ("b", "w280 w7 w7 W100"), ("c", "nowhere"), ("d", None), ("e", "w0 w1 w2"), ("f", "w299 nowhere")], "query_id string, text string")
    assert index.update(docs, str(tmp_path)) == {"added": 604, "dead": 0}
    for k in (1, 5, 1000):
        got, reads = by_index(str(tmp_path), asked, k)
        want = by_scan(docs, asked, k)
        assert got.keys() == want.keys() and got == pytest.approx(want, abs=2e-6)
        assert k > 5 or sum(n for name, n in reads.items() if name != "all") < reads["all"]
    assert by_index(str(tmp_path), asked.limit(0), 3)[0] == {}
    assert by_index(f"{tmp_path}/none", asked, 3)[0] == {}


def test_rare_terms_spare_most_postings(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(["the"] * rng.randint(1, 3) + ["of"] * rng.randint(1, 3) + [f"rare{i % 200}"] + [f"x{rng.randint(0, 5000)}" for _ in range(5)])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, f"the rare{q} of") for q in range(20)], "query_id long, text string")
    index.update(docs, str(tmp_path))
    got, reads = by_index(str(tmp_path), asked, 10)
    assert got == pytest.approx(by_scan(docs, asked, 10), abs=2e-6)
    assert sum(n for name, n in reads.items() if name != "all") < 0.05 * reads["all"]


def test_index_updates_equal_a_full_build(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "i")
    first = spark.createDataFrame(list(enumerate(texts(rng, 120))) + [(None, "w1 w2")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w5 w80 w200"), (2, "w0 w1 brand")], "query_id long, text string")
    assert index.update(first, path)["added"] == 121 and index.update(first, path) == {"added": 0, "dead": 0}
    changed = first.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" brand new w0"))).otherwise(F.col("text"))).filter("doc_id IS NULL OR doc_id % 9 <> 1")
    assert index.update(changed, path) == {"added": 10, "dead": 24}
    assert stats_of(spark, path) == full_stats(changed)
    assert by_index(path, asked, 8)[0] == pytest.approx(by_scan(changed, asked, 8), abs=2e-6)
    back = changed.filter("doc_id < 60").unionByName(spark.createDataFrame([(500, "w5 w5"), (500, "w9")], "doc_id long, text string"))
    index.update(back, path)
    least = back.filter("text <> 'w9'")  # of rows that repeat an id the least text counts
    assert stats_of(spark, path) == full_stats(least) and by_index(path, asked, 8)[0] == pytest.approx(by_scan(least, asked, 8), abs=2e-6)
    index.compacted(spark, path, f"{path}-one")
    assert index._updates(spark, f"{path}-one") == [0] and stats_of(spark, f"{path}-one") == full_stats(least)
    assert by_index(f"{path}-one", asked, 8)[0] == by_index(path, asked, 8)[0] and index.update(back, f"{path}-one") == {"added": 0, "dead": 0}
    index.update(first.limit(0), path)
    assert index.stats(spark, path)[:3] == (0, 0, 0) and by_index(path, asked, 8)[0] == {}


def test_update_that_failed_is_not_read(spark, tmp_path):
    path = str(tmp_path)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    index.update(docs, path)
    store.written(docs.limit(0).select(F.lit(0).alias("of"), F.lit(0).cast("long").alias("number")), f"{path}/dead/1")  # and no commit
    assert index.stats(spark, path).n_docs == 2 and index.live(spark, path).count() == 2
    assert index.update(docs.filter("doc_id = 1"), path) == {"added": 0, "dead": 1}
    assert index.live(spark, path).count() == 1


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 12)) * 4
    rows = [(i, (centers[i % 30] + rng.normal(size=12) * 0.3).tolist()) for i in range(1500)]
    rows += [(2000 + i, rng.normal(size=3).tolist()) for i in range(20)] + [(3000, [1.0]), (3001, [-2.0]), (3002, None), (3003, []), (3004, [0.0] * 12), (3005, [float("nan")] * 12), (3006, [None, 1.0, 2.0]), (3007, [1e200, 0.0, 1e-200])]
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>")


@pytest.mark.parametrize("rows,queries", [(nearest.CELL_ROWS, nearest.CELL_QUERIES), (7, 2)])
def test_nearest_equals_a_scan(spark, tmp_path, monkeypatch, clusters, rows, queries):
    monkeypatch.setattr(nearest, "CELL_ROWS", rows)
    monkeypatch.setattr(nearest, "CELL_QUERIES", queries)
    docs = clusters.filter("doc_id <> 3007")  # a plain square of its components is too large
    nearest.build(docs, str(tmp_path))
    asked = docs.filter("doc_id % 100 = 0 OR doc_id > 2015").withColumnRenamed("doc_id", "query_id")
    for k in (1, 9, 40):
        found = nearest.search(str(tmp_path), asked, k)
        assert {tuple(r) for r in found.rows.collect()} == {tuple(r) for r in retrieve.dense(docs, asked, k).collect()}
        assert k > 1 or found.spared > 0.8


def test_nearest_in_small_parts_equals_a_scan(spark, tmp_path, monkeypatch, clusters):
    for name, n in (("PART_ROWS", 400), ("BLOCK_QUERIES", 9), ("SCORES", 1000)):
        monkeypatch.setattr(nearest, name, n)
    docs = clusters.filter("doc_id <> 3007")
    nearest.build(docs, str(tmp_path))
    asked = docs.filter("doc_id % 100 = 0 OR doc_id > 2015").withColumnRenamed("doc_id", "query_id")
    found = nearest.search(str(tmp_path), asked, 40)
    assert {tuple(r) for r in found.rows.collect()} == {tuple(r) for r in retrieve.dense(docs, asked, 40).collect()}


def test_nearest_of_nothing(spark, tmp_path, clusters):
    nearest.build(clusters.limit(0), str(tmp_path))
    asked = clusters.limit(2).withColumnRenamed("doc_id", "query_id")
    assert nearest.search(str(tmp_path), asked, 3).rows.collect() == []
    nearest.build(clusters.filter("doc_id >= 3002"), f"{tmp_path}/odd")
    assert nearest.search(f"{tmp_path}/odd", asked.limit(0), 3).rows.collect() == []
    assert {(r.doc_id, r.dense) for r in nearest.search(f"{tmp_path}/odd", asked.limit(1), 2).rows.collect()} == {(3007, 0.0), (3006, 0.0)}


def test_widths_do_not_depend_on_order(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 1.0])]
    asked = spark.createDataFrame(rows, "query_id long, embedding array<double>")
    docs = asked.withColumnRenamed("query_id", "doc_id")
    got = {tuple(r)[:3] for r in retrieve.dense(docs, asked, 3).collect()}
    assert got == {tuple(r)[:3] for r in retrieve.dense(docs.orderBy(F.desc("doc_id")), asked.orderBy(F.desc("query_id")), 3).collect()}
    assert {(q, d) for q, d, s in got if s == 1} == {(1, 1), (2, 2), (3, 3)}


def test_lexical_norms_equal_those_of_all_documents(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame(list(enumerate(texts(rng, 90))) + [(900, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "w5 w80 w2"), ("b", "w0"), ("c", "none")], "query_id string, text string")
    n = F.lit(docs.count())
    best, _ = retrieve.lexical(docs, retrieve.weighted(docs, asked), n, 7)
    want = retrieve.ranked(retrieve.min_max(retrieve.bm25(docs, asked), "bm25", n), "bm25", 7)
    assert {tuple(r) for r in best.collect()} == {tuple(r) for r in want.select(best.columns).collect()}
    pairs = docs.select("doc_id").filter("doc_id < 12").crossJoin(asked.select("query_id"))
    every = {(r.query_id, r.doc_id): r.bm25 for r in retrieve.bm25(docs, asked).collect() if r.doc_id < 12}
    assert {(r.query_id, r.doc_id): r.bm25 for r in retrieve.scored_pairs(docs, retrieve.weighted(docs, asked), pairs).collect()} == pytest.approx(every, abs=2e-6)


def test_hybrid_sorts_no_query_by_all_documents(spark):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i}") for i in range(30)], "doc_id long, text string")
    vectors = docs.select("doc_id", F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"))
    asked = docs.filter("doc_id < 2").join(vectors, "doc_id").withColumnRenamed("doc_id", "query_id")
    plan = retrieve.hybrid(docs, vectors, asked, top_k=4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # what the windows see was cut and written before


def contexts_by_hand(rows, budget):
    out = {}
    for q in {r[0] for r in rows}:
        own = sorted((rank, s) for p, rank, s in rows if p == q and s is not None)
        kept, total = [], 0
        for k, (_, s) in enumerate(own):
            total += len(s)
            if total <= budget or k == 0:
                kept.append(s[:budget])
        if own:
            out[q] = ("\n".join(kept).strip(), len(kept))
    return out


@pytest.mark.parametrize("held", [retrieve.HELD_CHARS, 100])
def test_contexts_cut_in_the_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(retrieve, "HELD_CHARS", held)
    rng = random.Random(6)
    rows = [(q, rank, None if rng.random() < 0.05 else chr(97 + rank % 26) * rng.choice([1, 5, 50, 400])) for q in (0, 1, None) for rank in rng.sample(range(300), 200)]
    rows += [(2, 1, "x" * 900), (2, 2, "y"), (3, 4, "  short "), (4, 1, None)]
    frame = spark.createDataFrame(rows, "query_id long, rank int, segment string").repartition(6)
    got = {r.query_id: (r.context, r.used) for r in retrieve.contexts(frame, 500).collect()}
    assert got == contexts_by_hand(rows, 500)
    sent = frame.mapInArrow(lambda b: retrieve._prefixes(b, 500), "query_id long, rank int, _length long, segment string")
    if held > 100:  # a query's segments of one task fit the budget
        size = sent.groupBy("query_id", F.spark_partition_id()).agg(F.sum(F.length("segment")).alias("n")).agg(F.max("n")).first()[0]
        assert size <= 500


def test_embeddings_are_made_for_new_texts_only(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def encode(texts):
        asked.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    embed = models.vectors(encode)
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, "")], "id long, text string")
    run = lambda d, model="m": models.maintained_embeddings(d, embed, str(tmp_path), model)
    rows, n = run(docs)
    assert n == 3 == asked.value and {(r.id, r.embedding[0] > 0) for r in rows.collect()} == {(1, True), (2, True), (3, True), (4, False), (5, False)}
    assert run(docs)[1] == 0 and asked.value == 3
    changed = docs.filter("id <> 1").unionByName(spark.createDataFrame([(6, "ccc")], "id long, text string")).withColumn("embedding", F.lit("own"))
    rows, n = run(changed)
    assert n == 1 and asked.value == 4 and all(len(r.embedding) == 2 for r in rows.collect())
    assert run(docs)[1] == 0 and run(docs, "other")[1] == 3
    assert run(docs.limit(0))[0].collect() == []


def test_index_terms_beyond_a_broadcast_give_the_same(spark, tmp_path, monkeypatch):
    rng, path = random.Random(7), str(tmp_path)
    docs = spark.createDataFrame(list(enumerate(texts(rng, 150))), "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w5 w80 w200"), (2, "w0 w1 w2")], "query_id long, text string")
    monkeypatch.setattr(index, "SLICE_TOKENS", 50)
    index.update(docs, path)
    got, reads = by_index(path, asked, 4)
    monkeypatch.setattr(index, "BROADCAST_TERMS", 0)
    assert by_index(path, asked, 4) == (pytest.approx(got, abs=2e-6), reads)
    assert got == pytest.approx(by_scan(docs, asked, 4), abs=2e-6)


def test_blocks_of_ranges_that_batches_part():
    docs = [(n, 3, [{"term": t, "tf": 1 + n % 2} for t in ("a", f"b{n % 3}")]) for n in range(40)]
    kind = pa.schema([("number", pa.int64()), ("length", pa.int32()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))])
    whole = pa.Table.from_pylist([dict(zip(kind.names, d, strict=True)) for d in docs], kind).combine_chunks()
    rows = lambda batches: sorted((tuple(r.items()) for b in index._packed(iter(batches)) for r in b.to_pylist()), key=repr)
    blocks = rows(whole.to_batches())
    assert blocks == rows(whole.to_batches(max_chunksize=7)) and len(blocks) == 12
    first = dict(next(r for r in blocks if r[0] == ("term", "a") and r[1] == ("range", 0)))
    assert (first["bits"], first["ats"], first["tfs"], first["max_tf"], first["min_length"]) == ((1 << 16) - 1, list(range(16)), [1, 2] * 8, 2, 3)


def test_diversified_candidates_make_no_rows_of_postings(spark, monkeypatch):
    """What only dense search has found is scored where its texts are."""
    monkeypatch.setattr(retrieve, "_postings", None)
    rows = catalog.QUERIES["mmr_select"](spark, "/root/testdata/sf0.001").groupBy("query_id").agg(F.max("mmr_rank").alias("n")).collect()
    assert rows and {r.n for r in rows} == {20}
