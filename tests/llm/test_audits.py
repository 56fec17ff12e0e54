"""Divergence of sources, decontamination and quantile summaries against plain versions."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirespark.llm import divergence, leaks, linededup, pieces, quantiles, terms, tokencount, urlfilter

ODD = [None, "", " \n\t ", "one", "É é x", "a\n\nb\n", "Ünïcode wörds \U0001f600 fine", "x" * 5000, "tab\tand\x0bfeed\x0c here\r\n", "MiXed Case\x00nul\x7fdel", "7 up 7up"]
SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# words -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_words_are_those_of_the_pattern(monkeypatch, size):
    monkeypatch.setattr(terms, "SLICE", size)
    texts = [*ODD, "a  b", " c", "d "] * 3
    for table, pattern in ((terms.LETTERS, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), (terms.LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for part in terms.slices(pa.array(texts).slice(1)):
            flat, offsets = terms.words(part, table)
            got += [flat.to_pylist()[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [re.findall(pattern, lower(t)) for t in texts[1:]]
    assert list(terms.slices(pa.array([], pa.string()))) == []


def test_gram_hashes_tell_grams_apart():
    each = terms.hashes(pa.array(["a", "b", "a", "b", "a"], pa.large_string()))
    two = terms.gram_hashes(each, 2)
    assert two[0] == two[2] and two[1] == two[3] and two[0] != two[1]
    assert len({*two.tolist(), *terms.gram_hashes(each, 1).tolist()}) == 4
    assert len(terms.gram_hashes(each, 6)) == 0
    assert terms.inside_texts(np.array([0, 2, 2, 5]), 2).tolist() == [0, 2, 3]


# 11 --------------------------------------------------------------------------------------------------------------


def divergence_by_hand(rows, min_docs, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [(s, w) for a, s, w in rows if a == lang]
        seen = Counter(t for _, w in own for t in set(w))
        kept = {t for t, n in seen.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for s, w in own:
            counts[s].update(t for t in w if t in kept)

        def shares(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        q = shares(sum(counts.values(), Counter()))
        p = {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", more, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)}
    return out


def texts_of_sources(rng):
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None, "só"]), " ".join(rng.choice("the und Ünder eel Zoo x-ray ab a b don't 3d ß".split()) for _ in range(rng.randint(0, 12)))) for _ in range(200)]
    rows += [("en", "s1", t) for t in ODD] + rows[:10] + [("xx", "lone", "never kept"), ("xx", None, None), ("fr", "only", "")]
    return rows


@pytest.mark.parametrize("most", [divergence.AUTOMATON_TERMS, 3, 0])
def test_divergence(spark, monkeypatch, most):
    monkeypatch.setattr(divergence.postings, "__defaults__", (most,))
    rows = texts_of_sources(random.Random(3))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, TEXT string, term int, n int")
    got = divergence.divergence(docs, min_docs=12, top=4).collect()
    assert {tuple(r) for r in got} == divergence_by_hand(rows, 12, 4)
    assert len(got) == len({tuple(r) for r in got})


def test_divergence_of_large_counts_is_exact(spark):
    n = 987_654_321_987
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(n * 3 + 1), F.lit(77_777)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (n * 3 + 1 + 5 * 77_777)


def test_divergence_of_long_terms_and_empty_tables(spark):
    rows = [("en", f"s{i % 2}", f"{'long' * 40} short{'' if i % 2 else ' short'}") for i in range(12)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in divergence.divergence(frame, min_docs=5).collect()} == divergence_by_hand(rows, 5, 50)
    assert divergence.divergence(frame.limit(0)).collect() == []


# 12 --------------------------------------------------------------------------------------------------------------


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def parts_by_hand(items, window):
    out = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1) if n else ():
            out[tuple(w[s : s + n])].add("" if item is None else str(item))
    return out


def leaks_by_hand(docs, items, window=10, shingle=5, threshold=1.0):
    parts, out = parts_by_hand(items, window), []
    grams = lambda w: {tuple(w[i : i + min(shingle, len(w))]) for i in range(len(w) - min(shingle, len(w)) + 1)}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in parts}:
            for s in range(len(w) - n + 1):
                for p, names in parts.items():
                    if len(p) == n and (tuple(w[s : s + n]) == p if threshold >= 1 else len(grams(w[s : s + n]) & grams(p)) >= threshold * len(grams(p)) - 1e-9):
                        hit |= set(range(s, s + n))
                        found |= names
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def planted(rng):
    say = lambda n: " ".join(f"w{rng.randint(0, 60)}" for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate([30, 12, 10, 9, 5, 4, 1, 25])] + [(8, None), (9, ""), (None, "zz yy xx"), (10, "b b b b b b b b b b b b"), (11, "Café ÉCOLE 7")]
    items += [(12, items[0][1]), (13, items[0][1] + " and more"), (2, "another text of item two here"), (2, items[2][1])]
    texts = [say(rng.randint(0, 40)) for _ in range(20)] + [*ODD]
    for _, t in items:
        w = words(t)
        texts += [f"{say(3)}, {' '.join(w[2:14]).upper()}! {say(3)}", f"{say(8)} {t}", " ".join(w), " ".join(w[:-1]), " ".join(w[1:4] + ["?"] + w[4:])]
    texts += ["b " * 200, "b " * 9, "café École 7", "CAFé ÉCOLE 7", say(3000) + " " + items[0][1] + " " + say(3000)]
    return [(k, t) for k, t in enumerate(texts)] + [(0, texts[-1]), (None, texts[25]), (3, texts[3])], items


@pytest.mark.parametrize("window,shingle,threshold,bits", [(10, 5, 1.0, 27), (10, 5, 1.0, 15), (4, 2, 1.0, 27), (3, 5, 1.0, 27), (10, 3, 0.7, 27), (6, 2, 0.5, 27)])
def test_contamination(spark, monkeypatch, window, shingle, threshold, bits):
    monkeypatch.setattr(leaks, "SIEVE_BITS", bits)
    docs, items = planted(random.Random(window))
    docs = docs if threshold >= 1 else docs[:80]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, Text string, n_hit int, items string")
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, TEXT string, part int")
    got = leaks.contamination(frame, bench, window=window, shingle=shingle, threshold=threshold).collect()
    want = leaks_by_hand(docs, items, window, shingle, threshold)
    if threshold >= 1:
        assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=str) == want
        assert all(r.n_hit == len({p for s in r.spans for p in range(s.start, s.stop)}) for r in got)
    else:  # of windows around one meeting the best counts, so words may be fewer; items are all found
        assert sorted([(r.doc_id, r.n_words, r["items"]) for r in got], key=str) == [(i, n, found) for i, n, _, found in want]
        assert all((r.n_hit > 0) == (r["items"] != []) for r in got)


def test_contamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert sorted([tuple(r) for r in leaks.contamination(docs, items.limit(0)).collect()], key=str) == [(1, 2, 0, [], []), (None, 0, 0, [], [])]
    assert leaks.contamination(docs.limit(0), items).collect() == []


def test_sieve_holds_what_was_put_in(spark):
    values = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    sieve = leaks.Sieve(spark.createDataFrame([(int(v),) for v in values], "gram long"), len(values))
    assert sieve.holds(values.view(np.uint64)).all()
    assert sieve.holds(np.random.default_rng(2).integers(0, 2**63, 100_000).view(np.uint64)).mean() < 0.06


def test_contamination_joins_no_texts(spark):
    plan = leaks.op12_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


# 13 --------------------------------------------------------------------------------------------------------------


def test_collapse_keeps_weight_extremes_and_ranks():
    rng = np.random.default_rng(5)
    for size, most in ((5000, 100), (300, 8), (401, 400), (50, 60)):
        for turn in (0, 1):
            x, w = rng.integers(0, 900, size), rng.integers(1, 50, size)
            values, weights, error = quantiles.collapsed(x, w, most, turn)
            assert len(values) <= most and weights.sum() == w.sum() and (np.diff(values) > 0).all()
            distinct = np.unique(x)
            assert {*values[:2], *values[-2:]} == {*distinct[:2], *distinct[-2:]}
            for v in distinct:
                assert abs(w[x <= v].sum() - weights[values <= v].sum()) <= error
            assert (error == 0) == (len(distinct) <= most)


def test_even_spans_take_both_middles_by_turns():
    x, w = np.arange(1000), np.ones(1000, np.int64)
    low, high = (quantiles.collapsed(x, w, 104, turn)[0] for turn in (0, 1))
    assert (high[2:-2] - low[2:-2] == 1).all()


def test_tracked_error_bounds_ranks():
    rng, own = np.random.default_rng(6), quantiles.Summary()
    x = rng.integers(0, 10**6, 300_000)
    for part in np.array_split(x, 37):
        own.feed(part, np.ones(len(part), np.int64))
    assert sum(len(v) for level in own.levels.values() for v, _ in level) <= quantiles.BUFFER * quantiles.BUFFERS * len(own.levels)
    values, weights = own.pruned(400)
    assert weights.sum() == len(x) and 0 < own.error < 0.01 * len(x)
    ranks = np.sort(x)
    assert all(abs(int(np.searchsorted(ranks, v, "right")) - int(weights[values <= v].sum())) <= own.error for v in values)


def shop_rows(rng):
    rows = [("a", rng.randint(0, 7), int(rng.gauss(0, 1000))) for _ in range(9000)]
    rows += [("b", k % 3, 5) for k in range(400)] + [("b", 0, v) for v in (1, 2, 9)] + [("c", 1, k) for k in range(19)] + [("d", 4, k) for k in range(20)]
    rows += [(f"e{k % 40}", k % 8, rng.randint(0, 9)) for k in range(3000)]
    return rows + rows[:50]


@pytest.mark.parametrize("buffer,fan_in,parts", [(1024, 64, 4), (16, 2, 23), (64, 3, 11)])
def test_quantile_summaries(spark, monkeypatch, buffer, fan_in, parts):
    monkeypatch.setattr(quantiles, "BUFFER", buffer)
    monkeypatch.setattr(quantiles, "FAN_IN", fan_in)
    rows = shop_rows(random.Random(7))
    broken = [(None, 1, 1), ("a", None, 1), ("a", 1, None)]
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows + broken], "grp string, Batch int, x long, part string, level int")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = quantiles.summaries(frame, ["grp"], budget=100)
        points, found = own.points.collect(), quantiles.verified(own, 20).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    values = defaultdict(list)
    for g, b, x in rows:
        values[g, b].append(x)
        values[g, -1].append(x)
    assert {(r.grp, r.batch) for r in points} == set(values) and len(points) == len(values)
    for r in points:
        own = values[r.grp, r.batch]
        assert r.n == len(own) == sum(r.ws) and min(4, len(set(own))) <= len(r.xs) <= min(len(own), 100)
        assert (r.xs[0], r.xs[-1]) == (min(own), max(own)) and r.xs == sorted(r.xs)
        for x, upto in zip(r.xs, np.cumsum(r.ws), strict=True):
            assert abs(sum(v <= x for v in own) - upto) <= r.error
    assert {(r.grp, r.batch, r.i) for r in found} == {(*k, i) for k, v in values.items() if len(v) >= 20 for i in range(1, 10)}
    for r in found:
        own = sorted(values[r.grp, r.batch])
        assert r.target == math.ceil(r.i * len(own) / 10) and r.exact_x == own[r.target - 1]
        assert (r.n_below, r.n_upto) == (bisect_left(own, r.answer), bisect_right(own, r.answer))


def test_weights_and_empty_summaries(spark):
    frame = spark.createDataFrame([("a", 0, 1, 30), ("a", 0, 2, 10), ("a", 1, 2, 0), ("a", 1, 7, None)], "g string, b int, x long, n long")
    own = quantiles.summaries(frame, ["g"], batch="b", weight="n")
    assert sorted((r.batch, r.n, r.xs, r.ws) for r in own.points.collect()) == [(-1, 40, [1, 2], [30, 10]), (0, 40, [1, 2], [30, 10])]
    none = quantiles.summaries(frame.limit(0), ["g"], batch="b")
    assert none.points.collect() == [] and quantiles.verified(none, 1).collect() == []


def test_quantile_query(spark):
    got = quantiles.op13_quantile_summaries(spark, SF).collect()
    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    items, values = {r.item_id: r for r in table("items")}, defaultdict(list)

    def put(stream, grp, ident, money):
        if grp is not None and money is not None:
            batch = zlib.crc32(str(ident).encode()) % 8
            for b in (batch, -1):
                values[stream, str(grp), b].append(math.floor(100 * money + 0.5) + 1000 * batch)

    for r in {r.click_id: r for r in table("clicks")}.values():
        put("value", r.client_id, r.click_id, r.value)
    for r in table("sale_lines"):
        if r.item_id in items:
            put("price", items[r.item_id].brand, r.vendor_id, items[r.item_id].price)
    assert {(r.stream, r.grp, r.batch, r.i) for r in got} == {(*k, i) for k, v in values.items() if len(v) >= 20 for i in range(1, 10)}
    for r in got:
        own = sorted(values[r.stream, r.grp, r.batch])
        assert (r.n, r.exact_x) == (len(own), own[r.target - 1]) and own[0] <= r.answer <= own[-1]
        assert r.rank_error == max(0, bisect_left(own, r.answer) + 1 - r.target, r.target - bisect_right(own, r.answer)) and r.within
    answers = defaultdict(list)
    for r in sorted(got, key=lambda r: r.i):
        answers[r.stream, r.grp, r.batch].append(r.answer)
    assert all(a == sorted(a) for a in answers.values())


def test_contamination_digest(spark):
    got = {r.doc_id: r for r in leaks.op12_decontamination(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    parts = parts_by_hand(items, 10)
    for i, text in docs:
        w = words(text)
        found = {n for k in {len(p) for p in parts} for s in range(len(w) - k + 1) for n in parts.get(tuple(w[s : s + k]), ())}
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() and got[i].contaminated == bool(found)


# names in another case -------------------------------------------------------------------------------------------


def test_columns_in_another_case(spark):
    rows = [(1, "one two three four", "en", 7), (2, None, "xyz", 8)]
    docs = spark.createDataFrame(rows, "Doc_ID long, TEXT string, lang string, N_Tokens int")
    path = tokencount.path_of("word_bpe_49k.json")
    own = tokencount.with_token_counts(docs, path)
    assert own.columns == ["Doc_ID", "TEXT", "lang", "n_tokens"]
    assert {r.n_tokens for r in own.filter("lang = 'en'").select("n_tokens").collect()} == {tokencount.encoder(path).counts(["one two three four"])[0]}

    model = tokencount.path_of(pieces.MODEL)
    named = docs.withColumnsRenamed({"N_Tokens": "Pieces"})
    ids = pieces.encoded(named, model)
    assert ids.columns == ["Doc_ID", "TEXT", "lang", "pieces"]
    back = pieces.decoded(ids.select(F.col("pieces").alias("PIECES"), "TEXT", F.lit(1).alias("Decoded")), model)
    assert [(r.decoded, r.TEXT) for r in back.select("decoded", "TEXT").collect()] == [("one two three four",) * 2, ("", None)]
    trip = pieces.round_trip(named, model)
    assert [(r.decoded, r.pieces == p.pieces) for r, p in zip(trip.collect(), ids.collect(), strict=True)] == [("one two three four", True), ("", True)]

    lines = spark.createDataFrame([(k, "common\nown") for k in range(12)], "Doc_Id long, Text string")
    assert {r.Text for r in linededup.drop_lines(lines).collect()} == {""}
    assert linededup.drop_lines(lines).columns == ["Doc_Id", "Text", "_line_n", "_line_dropped"]

    urls = spark.createDataFrame([("http://a.net/x", "own", 1)], "URL string, HOST string, Rule int")
    out = urlfilter.judged(urls)
    assert out.columns == ["URL", "host", "path", "rule", "verdict", "block_margin"]
    assert out.select("host", "rule", "verdict").first() == ("a.net", "net/", "block")
