"""What only larger tables show: segments of a query in many tasks, and what driver and tasks hold."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirespark.operators import chunk, retrieve
from quirespark.plans import catalog


def test_a_segment_that_a_task_cannot_fit_ends_the_context(spark):
    """Rank 4 does not fit beside rank 3 in its task; rank 5, in another, must not take its place."""
    rows = spark.sparkContext.parallelize([(1, k, chr(96 + k) * n) for k, n in ((3, 1000), (4, 800), (1, 200), (5, 100))], 2)
    (got,) = retrieve.contexts(spark.createDataFrame(rows, "query_id long, rank int, segment string"), 1600).collect()
    assert (got.used, got.context) == (2, "a" * 200 + "\n" + "c" * 1000)


def test_words_parted_from_their_marks_are_covered(spark, tmp_path):
    """Splitting at ``. `` leaves the mark with what follows."""
    texts = ["first there is an end. " + "nd " * 1500, "so!! " + "x" * 5000 + " y. z", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in catalog.QUERIES["chunk_properties"](spark, str(tmp_path)).collect())
    assert rows == [(0, True, True, True, True), (1, True, True, True, True), (2, True, True, True, False)]


def test_blocks_of_queries_and_documents_equal_one_pass(spark, monkeypatch):
    """Beyond the bounds neither the terms nor copies of them go through the driver, and tasks keep their best only."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', 'w' || id % 3, 'w' || id % 7, 'w' || id % 50, 'w' || id) AS text")
    asked = docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    weights = retrieve.weighted(docs, asked)
    rows = lambda **how: sorted(map(str, retrieve.ranked(retrieve.scored(docs, weights, top=5, **how), "bm25", 5).collect()))
    ends = lambda: sorted(map(str, retrieve.lexical(docs, weights, retrieve.F.lit(300), 5)[1].collect()))
    want = rows(), ends()
    for name, least in (("BROADCAST_TERMS", 3), ("QUERY_BYTES", 100), ("DOC_BYTES", 5000), ("SLICE_TOKENS", 20), ("ROWS", 4)):
        monkeypatch.setattr(retrieve, name, least)
    assert (rows(), ends()) == want and len(want[0]) == 30
    plan = retrieve.scored(docs, weights, top=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_dense_scores_stay_within_their_bound(monkeypatch):
    rng = np.random.default_rng(1)
    asked, docs = retrieve._by_width(list(rng.normal(size=(9, 4)))), list(rng.normal(size=(20, 4)))
    want = [r for f in retrieve._best(np.arange(9), asked, np.arange(20), docs, 3) for r in f.itertuples(index=False)]
    monkeypatch.setattr(retrieve, "MATRIX_CELLS", 40)
    got = list(retrieve._best(np.arange(9), asked, np.arange(20), docs, 3))
    assert [len(f) for f in got] == [6, 6, 6, 6, 3] and sorted(want) == sorted(r for f in got for r in f.itertuples(index=False))


def test_chunks_leave_a_task_in_bounded_frames(monkeypatch):
    """A batch of documents makes several times its own text in chunks."""
    monkeypatch.setattr(chunk, "HELD_CHARS", 25)
    batch = pd.DataFrame({"source_file": list("abcdefg"), "text": ["x" * 10] * 6 + [None]})
    got = list(chunk._frames([batch], lambda s, t: [{"source_file": s, "text": t}], ["source_file", "text"]))
    assert [len(f) for f in got] == [3, 3, 1] and "".join(pd.concat(got)["source_file"]) == "abcdefg"


def by_hand(docs, asked, k1=1.5, b=0.75):
    """Scores of all pairs that share a term: (query, doc) to score, by plain sums."""
    words = {d: (t or "").lower().split() for d, t in docs}
    n, average = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    mean = sum(idf.values()) / len(idf)
    weight = {t: x if x >= 0 else 0.25 * mean for t, x in idf.items()}
    out = {}
    for q, text in asked:
        for d, w in words.items():
            tf, shared = Counter(w), [t for t in (text or "").lower().split() if t in w]
            if shared:
                out[q, d] = sum(weight[t] * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / average)) for t in shared)
    return out


@pytest.mark.parametrize("gain", [0, 256, 1 << 30])
def test_products_of_matrices_and_postings_make_the_same_scores(spark, monkeypatch, gain):
    """All terms by postings, all by the matrix, or some; w1 is in half of the documents, so it weighs nothing."""
    rng = random.Random(gain)
    docs = [(i, " ".join(["w1"] * (i % 2) + [f"w{int(2 + 40 * rng.random() ** 3)}" for _ in range(rng.randint(0, 9))])) for i in range(60)] + [(60, None), (61, "w1")]
    asked = [("a", "w1"), ("b", "w1 w2 w3 w3"), ("c", "w9 w2 w30 w11 w5 w7"), ("d", "none"), ("e", None), ("f", "W40")]
    for name, least in (("DENSE_GAIN", gain), ("SCORE_CELLS", 30), ("DENSE_CELLS", 100), ("FLAT_POSTINGS", 7), ("SLICE_TOKENS", 60), ("ROWS", 4)):
        monkeypatch.setattr(retrieve, name, least)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id string, text string")
    want, weights = by_hand(docs, asked), retrieve.weighted(left, right)
    assert 0.0 in want.values() and {(r.query_id, r.doc_id): r.bm25 for r in retrieve.scored(left, weights).collect()} == pytest.approx(want, abs=2e-6)
    found = retrieve.scored(left, weights, top=4, edges=True).collect()
    best = {(r.query_id, r.doc_id): r.bm25 for r in retrieve.ranked(retrieve.scored(left, weights, top=4), "bm25", 4).collect()}
    for q in "abcf":
        own = sorted(((round(s, 6), d) for (of, d), s in want.items() if of == q), reverse=True)
        assert {(q, d): s for s, d in own[:4]} == pytest.approx({k: s for k, s in best.items() if k[0] == q}, abs=2e-6)
        ends = [r for r in found if r.query_id == q and r.n]
        assert (min(r.low for r in ends), max(r.high for r in ends), sum(r.n for r in ends)) == pytest.approx((own[-1][0], own[0][0], len(own)), abs=2e-6)
    pairs = spark.createDataFrame([(q, d) for q in "abcdefz" for d in range(0, 62, 3)] + [("c", 99)], "query_id string, doc_id long")
    some = {k: s for k, s in want.items() if k[1] % 3 == 0}
    for most in (0, 1000):
        monkeypatch.setattr(retrieve, "BROADCAST_PAIRS", most)
        assert {(r.query_id, r.doc_id): r.bm25 for r in retrieve.scored_pairs(left, weights, pairs).collect()} == pytest.approx(some, abs=2e-6)


def test_many_terms_of_queries_are_no_reason_to_shuffle_texts(spark):
    """Copies of all documents for each block of queries, and postings of the pairs that only dense search finds, filled the disk."""
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('t', id, ' t', id * 7) AS text")
    weights = spark.range(60_000).selectExpr("id % 300 AS query_id", "concat('t', id) AS term", "1.0D AS w", "2.0D AS avg_length")
    pairs = docs.selectExpr("doc_id % 300 AS query_id", "doc_id")
    for made in (retrieve.scored(docs, weights, top=5), retrieve.scored_pairs(docs, weights, pairs)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" not in plan and "inline" not in plan and "MapInArrow" in plan
    assert retrieve.scored(docs, weights, top=5).count() > 0


def test_answers_shuffle_the_texts_that_were_picked_only(spark, monkeypatch):
    docs = spark.range(30).selectExpr("id AS doc_id", "concat('t', id) AS text", "'x' AS other")
    rows = docs.filter("doc_id % 7 = 0").select("doc_id", F.lit(1).alias("query_id"))
    plan = lambda: retrieve.with_texts(rows, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    asked = catalog.QUERIES["rag_answers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in asked
    want = {(7 * k, f"t{7 * k}", 1) for k in range(5)}
    assert {tuple(r) for r in retrieve.with_texts(rows, docs).collect()} == want
    monkeypatch.setattr(retrieve, "BROADCAST_PAIRS", 3)
    assert "strategy=broadcast" not in plan() and {tuple(r) for r in retrieve.with_texts(rows, docs).collect()} == want
