"""Hybrid retrieval: BM25 and dense scores, fusion, diversification, parents, context. Ranks are windows per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quirespark.functions.text import let, tokens
from quirespark.sources import store

K1, B, EPSILON = 1.5, 0.75, 0.25
LEXICAL, DENSE = 0.4, 0.6
#: So many terms of queries (a string and a double each) may go to every task, as arrays of numbers; beyond it rows are shuffled.
BROADCAST_TERMS = 6_000_000
DIGITS = 6


def term_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df, docs, length): in how many documents a term is; how many documents there are and how long they are stands
    at the null term, so that one pass gives all of the corpus statistics. Tasks count a slice of documents at a time."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, length in _slices(batch.column(0)):
                terms = words.flatten().dictionary_encode()
                pairs = np.unique(terms.indices.to_numpy().astype(np.int64) * len(words) + np.repeat(np.arange(len(words)), length))
                df = np.bincount(pairs // len(words), minlength=len(terms.dictionary))
                none = np.zeros(len(df), np.int64)
                columns = [pa.concat_arrays([terms.dictionary, pa.nulls(1, terms.dictionary.type)]), *(pa.array(np.append(x, y)) for x, y in ((df, 0), (none, len(words)), (none, length.sum())))]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "docs", "length"])

    rows = docs.select(tokens(F.col(text))).mapInArrow(counted, "term string, df long, docs long, length long")
    return rows.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "docs", "length")))


def _slices(words: pa.ListArray) -> Iterator[tuple[pa.ListArray, np.ndarray]]:
    """Lists of words, and how long they are, in stretches of ``SLICE_TOKENS`` words; a longer list is one by itself."""
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(length), 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_TOKENS, "right")))
        yield words.slice(at, end - at), length[at:end]
        at = end


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs, avg_length, n_terms and the mean inverse document frequency over all terms."""
    return _stats(store.written(term_table(docs, text)))


def _stats(terms: DataFrame) -> DataFrame:
    totals = terms.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"), (F.sum("length") / F.sum("docs")).alias("avg_length"))
    rated = terms.filter("term IS NOT NULL").crossJoin(F.broadcast(totals.select("n_docs")))  # one row
    return totals.crossJoin(rated.agg(F.count("*").alias("n_terms"), F.avg(_idf(F.col("n_docs"), F.col("df"))).alias("mean_idf")))


def _idf(n: Column, df: Column) -> Column:
    return F.log(n - df + F.lit(0.5)) - F.log(df + F.lit(0.5))


def _weights(docs: DataFrame, terms: DataFrame, text: str, epsilon: float) -> DataFrame:
    """(term, avg_length, idf) of those of ``terms`` (term) that the corpus has."""
    found = store.written(term_table(docs, text))  # read three times
    weights = found.join(terms, "term", "left_semi").crossJoin(F.broadcast(_stats(found).select("n_docs", "avg_length", "mean_idf")))  # one row
    idf = _idf(F.col("n_docs"), F.col("df"))
    return weights.select("term", "avg_length", F.when(idf < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(idf).alias("idf"))


#: A task scores documents of so many tokens at a time, and hands on rows in batches of so many.
SLICE_TOKENS, ROWS = 1 << 20, 1 << 16
#: And of so many bytes in all, with 24 for each besides.
BROADCAST_BYTES = 192 << 20
#: Beyond that, queries of so many bytes of terms and documents of so many bytes of text meet in a task.
QUERY_BYTES, DOC_BYTES = 16 << 20, 32 << 20


def weighted(docs: DataFrame, queries: DataFrame, query_id: str = "query_id", text: str = "text", query_text: str = "text", epsilon: float = EPSILON) -> DataFrame:
    """(query_id, term, w, avg_length) of the terms of each query that the corpus has: how often it is asked for times
    its weight. Terms in more than half of the documents weigh ``epsilon`` times the mean instead of less than nothing."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weights = _weights(docs, asked.select("term").distinct(), text, epsilon)
    return store.written(asked.join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avg_length"))


def bm25(
    docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text", query_text: str = "text",
    k1: float = K1, b: float = B, epsilon: float = EPSILON, top: int | None = None,
) -> DataFrame:
    """(query, doc, bm25) of all pairs that share a term, or with ``top`` of at least the ``top`` best of each query; a term
    repeated in a query counts again. ``index`` answers from a stored index that need not be read whole."""
    return scored(docs, weighted(docs, queries, query_id, text, query_text, epsilon), doc_id, text, k1, b, top).select("query_id", "doc_id", "bm25")


def scored(docs: DataFrame, weights: DataFrame, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, top: int | None = None, edges: bool = False) -> DataFrame:
    """(query, doc, bm25) for queries that are ``weighted``; with ``edges`` also (query, null, null, low, high, n) of the
    scores of all n documents that share a term with the query, in parts to be merged.

    Query terms, counted first, go to every task, which scores documents whole, a slice of an Arrow batch at a time, and
    keeps its own best and extremes; nothing is shuffled. With ``top`` a core has a few tasks at most, as each hands on its best of every query.
    Beyond ``BROADCAST_TERMS`` or ``BROADCAST_BYTES`` blocks of queries and parts of the documents, both bounded by bytes, meet in
    tasks that do the same, and the driver sees none of them.
    """
    id_type, doc_type = weights.schema["query_id"].dataType, docs.select(F.col(doc_id)).schema[0].dataType
    kinds = f"query_id {id_type.simpleString()}, doc_id {doc_type.simpleString()}, bm25 double"
    kinds += ", low double, high double, n long" if edges else ""
    own, context = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), docs.sparkSession.sparkContext
    size = _beyond(weights)
    if size:
        return _scored_in_blocks(own, weights, size, kinds, k1, b, top, edges)
    asked = _sent(weights)
    if asked is None:
        return docs.sparkSession.createDataFrame([], kinds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(asked.value, k1, b, top, edges)
        for batch in batches:
            yield from scores.add(batch.column(0), batch.column(1))
        yield from scores.end()

    if top is not None:
        own = own.coalesce(TASKS_A_CORE * context.defaultParallelism)
    return own.select("doc_id", tokens(F.col("text"))).mapInArrow(score, kinds)


#: Tasks a core that each keep their own best of every query.
TASKS_A_CORE = 4


def _beyond(weights: DataFrame) -> int:
    """The bytes of the terms of queries, if they are too many to go to every task; else 0."""
    n, size = weights.agg(F.count("*"), F.sum(F.octet_length("term") + 24)).first()
    return size if n > BROADCAST_TERMS or (size or 0) > BROADCAST_BYTES else 0


def _sent(weights: DataFrame):
    """``weights``, which are within the bounds, as a broadcast ``_Asked``; None if there are none."""
    rows = weights.select("query_id", "term", "w", "avg_length").orderBy("query_id", "term").toArrow()
    if not rows.num_rows:
        return None
    return weights.sparkSession.sparkContext.broadcast(_Asked(rows.drop_columns("avg_length"), rows["avg_length"][0].as_py()))


class _Asked:
    """Terms of queries (query_id, term, w), sorted by the query, as arrays: ``terms`` once each, and for each row the ``place`` of its term
    there, the place ``of`` its query among ``ids``, and its weight; rows of a query lie between two ``cuts``."""

    def __init__(self, rows: pa.Table, average: float):
        def encoded(name: str) -> pa.DictionaryArray:
            made = rows[name].combine_chunks().dictionary_encode(null_encoding="encode")
            return made.chunk(0) if isinstance(made, pa.ChunkedArray) else made

        place, ids = encoded("term"), encoded("query_id")
        self.terms, self.place, self.w = place.dictionary, place.indices.to_numpy(), rows["w"].to_numpy()
        self.ids, self.of = ids.dictionary, ids.indices.to_numpy()
        self.cuts, self.average = np.searchsorted(self.of, np.arange(len(self.ids) + 1)), average


def _scored_in_blocks(docs: DataFrame, weights: DataFrame, size: int, kinds: str, k1: float, b: float, top: int | None, edges: bool) -> DataFrame:
    text_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks, parts = -(-size // QUERY_BYTES), max(1, -(-text_bytes // DOC_BYTES))
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = weights.withColumn("_i", dealt(blocks, "query_id")).withColumn("_j", every(parts))
    right = docs.select("doc_id", tokens(F.col("text")).alias("words"), dealt(parts, "doc_id", "text").alias("_j")).withColumn("_i", every(blocks))
    names = [f.strip().split()[0] for f in kinds.split(", ")]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            asked = _Asked(left.sort_by([("query_id", "ascending"), ("term", "ascending")]), left["avg_length"][0].as_py())
            scores = _Scores(asked, k1, b, top, edges)
            for batch in right.select(["doc_id", "words"]).to_batches():
                out += scores.add(batch.column(0), batch.column(1))
            out += scores.end()
        if out:
            return pa.Table.from_batches(out)
        kind = [left.schema.field("query_id").type, right.schema.field("doc_id").type, *[pa.float64()] * (len(names) - 2)]
        return pa.table([pa.array([], pa.int64() if name == "n" else k) for name, k in zip(names, kind, strict=True)], names=names)

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(score, kinds)


#: Scores that a slice has at a time, cells of its dense terms, and postings that are looked into at a time.
SCORE_CELLS, DENSE_CELLS, FLAT_POSTINGS = 1 << 19, 1 << 22, 1 << 20
#: A product in a matrix costs that much less than a posting.
DENSE_GAIN = 256


class _Scores:
    """Scores of documents for the queries ``asked``, as record batches: all pairs as they come, or at the end the ``top`` best of each
    query; and with ``edges`` the extremes of all.

    Terms that many queries and many documents of a slice share are summed as a product of two matrices, all others by their postings.
    """

    def __init__(self, asked: _Asked, k1: float, b: float, top: int | None, edges: bool):
        self.asked, self.ids, self.k1, self.b, self.top, self.edges = asked, asked.ids, k1, b, top, edges
        n = len(self.ids)
        self.low, self.high, self.n = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
        self.least, self.held = np.full(n, -np.inf), []  # what a document has to reach; (query, doc, score) so far
        self.queries = np.bincount(asked.place, minlength=len(asked.terms))  # with each term
        self.odd = np.zeros(n, bool)  # a weight may be zero, or less: then a score says nothing of a common term
        self.odd[asked.of[asked.w <= 0]] = True

    def add(self, docs: pa.Array, words: pa.ListArray) -> Iterator[pa.RecordBatch]:
        self.doc_type, at = docs.type, 0
        for some, length in _slices(words):
            yield from self._slice(docs.slice(at, len(some)), some, length)
            at += len(some)

    def _slice(self, docs: pa.Array, words: pa.ListArray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, asked = len(docs), self.asked
        t, d, part = _parts(words, length, asked, self.k1, self.b)
        last = pc.sort_indices(docs, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()
        order = np.empty(n, np.int64)
        order[last] = np.arange(n)  # among equal scores the greater id comes first
        many = np.bincount(t, minlength=len(asked.terms))  # postings of the slice, by term
        first = np.cumsum(many) - many
        gain = self.queries * many
        dense = np.flatnonzero(gain * DENSE_GAIN > len(self.ids) * n)
        dense = dense[np.argsort(-gain[dense], kind="stable")[: DENSE_CELLS // n]]
        column = np.full(len(asked.terms), -1, np.int32)
        column[dense] = np.arange(len(dense))
        matrix, here = np.zeros((len(dense), n)), column[t] >= 0
        matrix[column[t[here]], d[here]] = part[here]
        rare = np.flatnonzero((many[asked.place] > 0) & (column[asked.place] < 0))
        block, found, rows = max(1, min(SCORE_CELLS // n, DENSE_CELLS // max(1, len(dense)))), [], 0
        for q in range(0, len(self.ids), block):
            z = min(q + block, len(self.ids))
            own = slice(asked.cuts[q], asked.cuts[z])
            column_of = column[asked.place[own]]
            there = np.flatnonzero(column_of >= 0)
            weights = np.zeros((z - q, len(dense)))
            weights[asked.of[own][there] - q, column_of[there]] = asked.w[own][there]
            score = weights @ matrix
            few = rare[slice(*np.searchsorted(rare, (asked.cuts[q], asked.cuts[z])))]
            for e, which in _flat(first[asked.place[few]], many[asked.place[few]]):
                cell = (asked.of[few[e]] - q) * n + d[which]
                score += np.bincount(cell, asked.w[few[e]] * part[which], score.size).reshape(score.shape)
            shared = score > 0
            for i in np.flatnonzero(self.odd[q:z]):
                mine = asked.place[asked.cuts[q + i] : asked.cuts[q + i + 1]]
                shared[i] = False
                for _, which in _flat(first[mine], many[mine]):
                    shared[i, d[which]] = True
            if self.edges:
                self.low[q:z] = np.minimum(self.low[q:z], np.round(np.where(shared, score, np.inf).min(1), DIGITS))
                self.high[q:z] = np.maximum(self.high[q:z], np.round(np.where(shared, score, -np.inf).max(1), DIGITS))
                self.n[q:z] += shared.sum(1)
            if self.top is not None:
                shared &= score >= (self.least[q:z] - 10.0**-DIGITS)[:, None]
            i, x = np.nonzero(shared)
            score, i = np.round(score[i, x], DIGITS), i + q
            if self.top is not None:
                i, x, score = self._reached(i, x, score, order)
            if len(x):
                found.append((i, x, score))
                rows += len(x)
            if rows > ROWS:
                yield from self._taken(found, docs)
                found, rows = [], 0
        yield from self._taken(found, docs)

    def _reached(self, q: np.ndarray, x: np.ndarray, score: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (query, doc, score) by query the ``top`` best of each query, as far as they reach its least."""
        some = np.flatnonzero(score >= self.least[q])
        q, x, score = q[some], x[some], score[some]
        asked, cuts, n = np.unique(q, return_index=True, return_counts=True)
        if not (n > self.top).any():
            return q, x, score
        kept = np.ones(len(q), bool)
        for k, a, m in zip(asked[n > self.top], cuts[n > self.top], n[n > self.top], strict=True):
            own = slice(a, a + m)
            kept[own] = np.isin(x[own], _best_of(x[own], score[own], order, self.top, -np.inf)[0], assume_unique=True)
            self.least[k] = max(self.least[k], score[own][kept[own]].min())
        return q[kept], x[kept], score[kept]

    def _taken(self, found: list, docs: pa.Array) -> Iterator[pa.RecordBatch]:
        if found:
            q, x, score = (np.concatenate(c) for c in zip(*found, strict=True))
            rows = pa.table({"q": q, "doc": docs.take(pa.array(x)), "bm25": score})
            if self.top is None:
                yield self._batch(rows)
            else:
                self.held.append(rows)
                if sum(map(len, self.held)) > max(4 * ROWS, 2 * self.top * len(self.ids)):
                    self._cut()

    def _cut(self) -> None:
        rows = pa.concat_tables(self.held)
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("bm25", "descending"), ("doc", "descending")]))
        q, score = rows["q"].to_numpy(), rows["bm25"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.held = [rows.take(pa.array(np.flatnonzero(place < self.top))).combine_chunks()]
        full = place == self.top - 1
        self.least[q[full]] = score[full]

    def _batch(self, rows: pa.Table) -> pa.RecordBatch:
        doc = rows["doc"].combine_chunks()
        columns = [self.ids.take(pa.array(rows["q"].to_numpy())), doc.chunk(0) if isinstance(doc, pa.ChunkedArray) else doc, pa.array(rows["bm25"].to_numpy())]
        return _batch([*columns, *([pa.nulls(len(rows), k) for k in (pa.float64(), pa.float64(), pa.int64())] if self.edges else [])])

    def end(self) -> Iterator[pa.RecordBatch]:
        has = np.flatnonzero(self.n)
        if self.held:
            self._cut()
            yield from (self._batch(self.held[0].slice(at, ROWS)) for at in range(0, len(self.held[0]), ROWS))
        if len(has):
            yield _batch([self.ids.take(pa.array(has)), pa.nulls(len(has), self.doc_type), pa.nulls(len(has), pa.float64()), pa.array(self.low[has]), pa.array(self.high[has]), pa.array(self.n[has])])


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "bm25", "low", "high", "n"][: len(columns)])


def _parts(words: pa.ListArray, length: np.ndarray, asked: _Asked, k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, what its frequency there counts) for terms that queries have, by term and document."""
    n = len(words)
    at = pc.fill_null(pc.index_in(words.flatten(), value_set=asked.terms), -1).to_numpy()
    there = np.flatnonzero(at >= 0)
    pair, tf = np.unique(at[there].astype(np.int64) * n + np.repeat(np.arange(n), length)[there], return_counts=True)
    t, d = np.divmod(pair, n)
    return t, d, tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[d] / asked.average))


def _flat(first: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, first[i] + 0, 1, ... below many[i]) for all i, some ``FLAT_POSTINGS`` at a time."""
    total, at = np.cumsum(many), 0
    while at < len(many):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FLAT_POSTINGS, "right")))
        n = many[at:end]
        i = np.repeat(np.arange(at, end), n)
        yield i, np.arange(len(i)) + np.repeat(first[at:end] - np.cumsum(n) + n, n)
        at = end


def _best_of(x: np.ndarray, score: np.ndarray, order: np.ndarray, top: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of documents ``x`` the ``top`` best, as far as they reach ``least``."""
    if len(x) > top:
        least = max(least, np.partition(score, len(x) - top)[len(x) - top])
    some = np.flatnonzero(score >= least)
    if len(some) > top:  # equal scores
        some = some[np.lexsort((-order[x[some]], -score[some]))[:top]]
    return x[some], score[some]


def _postings(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, length, tf) of rows with a ``text``."""
    # The length goes along with each token: computed beside the explode, it would be computed for every token again.
    body = let(tokens(F.col("text")), lambda w: F.transform(w, lambda t: F.struct(t.alias("term"), F.size(w).alias("length"))))
    return rows.select(*keys, F.inline(body)).groupBy(*keys, "term", "length").agg(F.count("*").alias("tf"))


def _sum(k1: float, b: float) -> Column:
    part = F.col("w") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.col("avg_length")))
    return F.round(F.sum(part), DIGITS).alias("bm25")


def scored_pairs(docs: DataFrame, weights: DataFrame, pairs: DataFrame, doc_id: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(query, doc, bm25) of the ``pairs`` (query_id, doc_id) that share a term, for queries that are ``weighted``.

    Within the bounds of ``scored`` query terms go to every task, too, and a text is joined once with all of its queries; pairs, if
    they are fewer than ``BROADCAST_PAIRS``, go to the texts. Nothing made of the texts is shuffled.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if _beyond(weights):
        rows = own.join(pairs.select("query_id", "doc_id"), "doc_id")
        return _postings(rows, "query_id", "doc_id").join(weights, ["query_id", "term"]).groupBy("query_id", "doc_id").agg(_sum(k1, b))
    asked, pairs = _sent(weights), store.written(pairs.select("query_id", "doc_id"))
    kinds = ", ".join(f"{c} {t}" for c, t in [("query_id", weights.schema["query_id"].dataType.simpleString()), ("doc_id", own.schema["doc_id"].dataType.simpleString()), ("bm25", "double")])
    if asked is None:
        return docs.sparkSession.createDataFrame([], kinds)
    few, wanted = pairs.count() <= BROADCAST_PAIRS, pairs.groupBy("doc_id").agg(F.collect_list("query_id").alias("queries"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, length in _slices(batch.column(1)):
                yield from _pairs_scored(*(batch.column(c).slice(at, len(words)) for c in (0, 2)), words, length, asked.value, k1, b)
                at += len(words)

    return own.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", tokens(F.col("text")), "queries").mapInArrow(score, kinds)


#: So many pairs of a query and a document go to every task.
BROADCAST_PAIRS = 2_000_000


def _pairs_scored(docs: pa.Array, queries: pa.ListArray, words: pa.ListArray, length: np.ndarray, asked: _Asked, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    t, d, part = _parts(words, length, asked, k1, b)
    by_doc = np.argsort(d, kind="stable")
    t, part, many = t[by_doc], part[by_doc], np.bincount(d, minlength=len(docs))
    known = pc.fill_null(pc.index_in(queries.flatten(), value_set=asked.ids), -1).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), pc.list_value_length(queries).to_numpy())[known >= 0]
    query = known[known >= 0]
    keys = asked.of.astype(np.int64) * len(asked.terms) + asked.place
    by_key = np.argsort(keys, kind="stable")
    keys, w = keys[by_key], asked.w[by_key]
    score, shared = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
    for pair, which in _flat((np.cumsum(many) - many)[doc], many[doc]):
        key = query[pair] * len(asked.terms) + t[which]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        score += np.bincount(pair[hit], w[at[hit]] * part[which[hit]], len(doc))
        shared += np.bincount(pair[hit], minlength=len(doc))
    some = np.flatnonzero(shared)
    if len(some):
        yield _batch([asked.ids.take(pa.array(query[some])), docs.take(pa.array(doc[some])), pa.array(np.round(score[some], DIGITS))])


def _norm(score: str, low: Column, high: Column) -> Column:
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0))


def lexical(docs: DataFrame, weights: DataFrame, n_docs: Column, top: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The ``top`` documents of each ``weighted`` query (query_id, doc_id, bm25, bm25_norm, rank), and for each query the
    (low, high) that norm all of its scores: extremes over ``n_docs`` documents, of which those without a common term score 0.

    One pass over the texts cuts to the best of a batch and merges its extremes; no window sees more than these.
    """
    found = store.written(scored(docs, weights, doc_id, text, top=top, edges=True))
    ends = found.filter("n IS NOT NULL").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    zero = F.when(F.col("n") < n_docs, F.lit(0.0))
    ends = ends.select("query_id", F.least("low", zero).alias("low"), F.greatest("high", zero).alias("high"))
    best = ranked(found.filter("n IS NULL"), "bm25", top).select("query_id", "doc_id", "bm25", "rank").join(ends, "query_id")
    return best.select("query_id", "doc_id", "bm25", _norm("bm25", F.col("low"), F.col("high")).alias("bm25_norm"), "rank"), ends


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, top: int = 50, top_k: int = 100, weights: tuple[float, float] = (LEXICAL, DENSE)) -> DataFrame:
    """``fused`` candidates of ``queries`` (query_id, text, embedding) among ``docs`` (doc_id, text) and their ``vectors``
    (doc_id, embedding). Both sides are cut to ``top_k`` before they meet; the lexical scores of what only the dense side
    has found are made for those pairs alone."""
    n_docs, terms = F.lit(docs.count()), weighted(docs, queries)
    lex, ends = lexical(docs, terms, n_docs, top_k)
    lex, den = store.written(lex), store.written(dense(vectors, queries, top_k))
    more = store.written(scored_pairs(docs, terms, den.join(lex, ["query_id", "doc_id"], "left_anti"))).join(ends, "query_id")
    more = more.select("query_id", "doc_id", "bm25", _norm("bm25", F.col("low"), F.col("high")).alias("bm25_norm"))
    return fused(lex.select(more.columns).unionByName(more), den, n_docs, top, top_k, weights)


def ranked(scores: DataFrame, score: str, k: int, tie: Column | str = "doc_id") -> DataFrame:
    """The ``k`` best rows of each query with ``rank`` from 1; among equals the greater id comes first."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(tie).desc() if isinstance(tie, str) else tie)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def min_max(scores: DataFrame, score: str, n_docs: Column | None = None) -> DataFrame:
    """``scores`` with ``<score>_norm`` in [0, 1] per query; all equal gives 1. With ``n_docs``, documents without a row
    count as zeros. Extremes are aggregated and joined, so that no task sorts a query's scores; ``scores`` are read twice."""
    ends = scores.groupBy(F.col("query_id").alias("_query")).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count("*").alias("_rows"))
    if n_docs is not None:
        zero = F.when(F.col("_rows") < n_docs, F.lit(0.0))
        ends = ends.select("_query", F.least("_low", zero).alias("_low"), F.greatest("_high", zero).alias("_high"))
    out = scores.join(ends, F.col("query_id").eqNullSafe(F.col("_query")))
    return out.select(*scores.columns, _norm(score, F.col("_low"), F.col("_high")).alias(f"{score}_norm"))


def cosine(a: Column, b: Column) -> Column:
    """In [0, 1], in double precision; a zero vector has a cosine of 0 with all."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    length = lambda x: F.when(norm(x) == 0, F.lit(1.0)).otherwise(norm(x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (length(a) * length(b))))


#: A block of query vectors and an Arrow batch make so many scores at a time.
MATRIX_CELLS = 1 << 21
#: So many query vectors go to every task as one matrix; beyond that, so many and so many corpus vectors meet in a task.
MATRIX_QUERIES, MATRIX_DOCS = 4096, 65_536


def _matrix(vectors: list, dims: int) -> np.ndarray:
    """Unit vectors; one that is null, of another length or has a null component is zero, alike to nothing."""
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims:
            out[i] = np.asarray(v, dtype=float)
    return _unit(np.where(np.isfinite(out).all(axis=1, keepdims=True), out, 0.0))


def _by_width(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors where they are, and they as unit vectors."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            places.setdefault(len(v), []).append(i)
    return {w: (np.array(at), _matrix([vectors[i] for i in at], w)) for w, at in places.items()}


def _best(ids: np.ndarray, asked: dict, docs: np.ndarray, vectors: list, k: int) -> Iterator[pd.DataFrame]:
    """The best ``k`` of ``docs`` for each query, ``MATRIX_CELLS`` scores at a time."""
    own = _by_width(vectors)
    last = np.argsort(docs, kind="stable")
    order = np.empty(len(docs), np.int64)
    order[last] = np.arange(len(docs))  # among equal scores the greater id comes first
    block = max(1, MATRIX_CELLS // max(1, len(docs)))
    for low in range(0, len(ids), block):
        found = np.zeros((min(block, len(ids) - low), len(docs)))
        for w in asked.keys() & own.keys():
            (q, a), (d, b) = asked[w], own[w]
            here = slice(*np.searchsorted(q, (low, low + block)))
            found[np.ix_(q[here] - low, d)] = np.round(np.clip(a[here] @ b.T, 0, 1), DIGITS)
        kept = []
        for q, score in enumerate(found):
            x, score = _best_of(np.arange(len(docs)), score, order, k, -np.inf)
            kept.append((np.full(len(x), ids[low + q]), docs[x], score))
        q, d, score = (np.concatenate(c) for c in zip(*kept, strict=True))
        yield pd.DataFrame({"query_id": q, "doc_id": d, "dense": score})


def dense(corpus: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query, doc, dense, rank) of the ``k`` nearest documents of each query; ids are whole numbers.

    Vectors of different lengths have a cosine of 0, as has one that is null or not finite with all. Few queries, which is
    counted, go to every task, which multiplies them with each Arrow batch of the corpus and keeps only its own best ``k``
    per query before the final rank. More meet the corpus block by block, each pair of blocks in a task of its own with
    the same kernel. ``nearest`` answers from a stored table that need not be read whole.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("vector"))
    own = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(vector).alias("_d"))
    schema = "query_id long, doc_id long, dense double"
    rows = asked.limit(MATRIX_QUERIES + 1).collect()
    if len(rows) <= MATRIX_QUERIES:
        ids, matrices = np.array([r["query_id"] for r in rows], np.int64), _by_width([r["vector"] for r in rows])

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(ids):
                    yield from _best(ids, matrices, batch["doc_id"].to_numpy(), batch["_d"].tolist(), k)

        return ranked(own.mapInPandas(best, schema), "dense", k)

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "doc_id": [], "dense": []})
        return pd.concat(_best(left["query_id"].to_numpy(), _by_width(left["vector"].tolist()), right["doc_id"].to_numpy(), right["_d"].tolist(), k))

    n, m = -(-asked.count() // MATRIX_QUERIES), -(-own.count() // MATRIX_DOCS)
    dealt = lambda side, key, parts: side.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1)))
    left = dealt(asked, "query_id", n).withColumn("j", every(m)).withColumnRenamed("_own", "i")
    right = dealt(own, "doc_id", max(m, 1)).withColumn("i", every(n)).withColumnRenamed("_own", "j")
    return ranked(left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(met, schema), "dense", k)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def fused(lexical: DataFrame, dense_ranked: DataFrame, n_docs: Column, top: int = 50, top_k: int = 100, weights: tuple[float, float] = (LEXICAL, DENSE)) -> DataFrame:
    """The ``top`` candidates of each query by weighted normalised scores; lexical: (query, doc, bm25, bm25_norm) of the
    ``top_k`` best documents and of whatever dense has found; dense: (query, doc, dense, rank), which are normalised as if the other of ``n_docs`` documents had 0; give
    all scores, and ranks beyond ``top_k`` count in the norm only. Candidates are the best of either; their order there
    breaks ties.
    """
    lex = ranked(lexical, "bm25", top_k).select("query_id", "doc_id", F.col("rank").alias("lex_rank"))
    den = min_max(dense_ranked, "dense", n_docs).withColumnRenamed("rank", "dense_rank").filter(F.col("dense_rank") <= top_k)
    both = lex.join(den, ["query_id", "doc_id"], "full").join(lexical.select("query_id", "doc_id", "bm25", "bm25_norm"), ["query_id", "doc_id"], "left")
    score = F.lit(weights[0]) * F.coalesce("bm25_norm", F.lit(0.0)) + F.lit(weights[1]) * F.coalesce("dense_norm", F.lit(0.0))
    place = F.coalesce(F.col("lex_rank"), F.lit(top_k) + F.col("dense_rank"))
    out = both.withColumns({"fused": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), DIGITS), "place": place})
    order = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "place")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mmr_order(relevance: list[float], vectors: np.ndarray, target: int, weight: float = 0.7) -> list[int]:
    """Indices by maximal marginal relevance, ties to the earliest."""
    unit = _unit(np.asarray(vectors, float))
    alike = np.clip(unit @ unit.T, 0, 1)
    rel, out = np.asarray(relevance, float), []
    nearest = np.zeros(len(rel))
    left = list(range(len(rel)))
    while left and len(out) < target:
        gain = weight * rel[left] - (1 - weight) * nearest[left] if out else rel[left]
        out.append(left.pop(int(np.argmax(gain))))
        nearest = np.maximum(nearest, alike[out[-1]]) if len(out) > 1 else alike[out[-1]].copy()
    return out


def diversified(candidates: DataFrame, target: int = 20, weight: float = 0.7) -> DataFrame:
    """``candidates`` (query_id, doc_id, rank, fused, embedding) reordered by MMR, at most ``target`` of each query; a
    group is one query's candidates, which the fusion has cut to its top. One without a vector is alike to none."""

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        order = mmr_order(group["fused"].tolist(), _matrix(group["embedding"].tolist(), max((len(v) for v in group["embedding"] if v is not None), default=1)), target, weight)
        return pd.DataFrame({"query_id": group["query_id"].iloc[order], "doc_id": group["doc_id"].iloc[order], "fused": group["fused"].iloc[order], "mmr_rank": range(1, len(order) + 1)})

    return candidates.select("query_id", "doc_id", "rank", "fused", "embedding").groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, fused double, mmr_rank int")


def parents(children: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` distinct parents of ranked ``children`` (query_id, child_id, parent_id, rank, text), with the child
    that found each; children whose parent is not in ``corpus`` (chunk_id, ...) are skipped."""
    known = children.join(corpus.select(F.col("chunk_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))
    one = known.withColumn("_first", first).filter("_first = 1").drop("_first")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return one.withColumn("parent_rank", place).filter(F.col("parent_rank") <= k).withColumn("matched_text", F.substring("text", 1, 240)).drop("text")


def orphans(children: DataFrame, corpus: DataFrame) -> DataFrame:
    return children.join(corpus.select(F.col("chunk_id").alias("parent_id")), "parent_id", "left_anti")


def with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ...) with the ``text`` of their document. Rows, computed once, go to the texts if they are fewer than
    ``BROADCAST_PAIRS``, so that texts of documents that no row names are not shuffled."""
    rows = store.written(rows)
    return docs.select("doc_id", "text").join(F.broadcast(rows) if rows.count() <= BROADCAST_PAIRS else rows, "doc_id")


def annotated(candidates: DataFrame, weights: tuple[float, float] = (LEXICAL, DENSE)) -> DataFrame:
    """``candidates`` (..., bm25, bm25_norm, dense, dense_norm, rerank) with the scores that a retrieved document shows:
    bm25_score, dense_score, fused_score (not clipped) and rerank_score; what was not scored is 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fused_score = F.lit(weights[0]) * zero("bm25_norm") + F.lit(weights[1]) * zero("dense_norm")
    return candidates.withColumns({"bm25_score": zero("bm25"), "dense_score": zero("dense"), "fused_score": F.round(fused_score, DIGITS), "rerank_score": zero("rerank")})


def segment(rank: Column, source: Column, text: Column, section: Column | None = None, score: Column | None = None, child: Column | None = None) -> Column:
    parts = [F.concat(F.lit("["), rank, F.lit("] From "), source)]
    if section is not None:
        parts.append(F.when(section != "", F.concat(F.lit(" | section="), section)).otherwise(F.lit("")))
    if score is not None:
        parts.append(F.when(score.isNotNull(), F.format_string(" | rerank=%.4f", score)).otherwise(F.lit("")))
    if child is not None:
        parts.append(F.coalesce(F.concat(F.lit(" | matched_child="), F.when(child != "", child)), F.lit("")))
    return F.concat(*parts, F.lit("\n"), text, F.lit("\n"))


def _prefixes(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Of rows (query, rank, segment) those that can be among the first of their query within the budget, as far as the
    task knows: what the segments of lesser rank in the same task leave room for, and the first one, cut to the budget.
    The first that does not fit comes without its text: its length ends the query's context, whatever other tasks hold."""
    held: dict = {}  # query: sorted (rank, length, segment), the budget and one segment at most
    size, names = 0, None

    def cut(own: list) -> list:
        own.sort(key=lambda x: x[0])
        fits = int(np.searchsorted(np.cumsum([n for _, n, _ in own]), budget, "right"))
        return own[: max(1, fits)] + [(rank, n, "") for rank, n, _ in own[max(1, fits) : fits + 1]]

    def batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["query_id", "rank", "_length", "segment"])

    def flushed() -> Iterator[pa.RecordBatch]:
        rows = [(q, *x) for q, own in held.items() for x in cut(own)]
        for at in range(0, len(rows), 1000):
            yield batch(rows[at : at + 1000], names)

    for b in batches:
        names = [b.column(0).type, b.column(1).type, pa.int64(), pa.string()]
        touched = set()
        for q, rank, segment in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if segment is not None:
                held.setdefault(q, []).append((rank, len(segment), segment[:budget]))
                touched.add(q)
        for q in touched:
            held[q] = cut(held[q])
        size = sum(len(s) for own in held.values() for _, _, s in own)
        if size > HELD_CHARS:
            yield from flushed()
            held = {}
    if held:
        yield from flushed()


#: So many characters of segments a task holds before it hands on what it has.
HELD_CHARS = 64 << 20


def contexts(segments: DataFrame, budget: int = 10_000) -> DataFrame:
    """(query_id, context, used): ranked segments while they fit the budget; a first one that does not fit is cut.

    Tasks cut what they hold of a query to its budget before anything is shuffled, so that a query's window sees at most
    the budget from each, and the length of the first segment beyond it. Segments of null are left out; ranks of a query are distinct.
    """
    budget = max(320, budget)
    kinds = ", ".join(f"`{c}` {k}" for c, k in segments.select("query_id", "rank").dtypes)
    cut = segments.select("query_id", "rank", "segment").mapInArrow(lambda batches: _prefixes(batches, budget), f"{kinds}, _length long, segment string")
    own = Window.partitionBy("query_id").orderBy("rank")
    running = cut.withColumns({"_sum": F.sum("_length").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.row_number().over(own) == 1})
    kept = running.filter((F.col("_sum") <= budget) | F.col("_first"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "segment"))), lambda s: s["segment"]), "\n")
    return kept.groupBy("query_id").agg(F.regexp_replace(joined, r"(?U)^\s+|\s+$", "").alias("context"), F.count("*").alias("used"))
