"""Registered queries of the library, each over whole driver tables, and their SQL.

Markdown is rendered from base tables inside a query, the operator takes it apart, and the SQL looks at the base
tables alone. Floats are rounded to six digits; every tie is broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.functions import text as T
from quirespark.functions.kernels import equations_udf, table_rows_udf
from quirespark.operators import chunk, enrich, figures, index, models, nearest, normalize, retrieve
from quirespark.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Retrieval -----------------------------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s]+'), lambda x: x <> '')"
_BM25 = f"""
d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY term),
i AS (SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM f, s),
m AS (SELECT avg(idf) AS mean_idf FROM i),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) GROUP BY doc_id, term),
b AS (SELECT query_id, doc_id,
             round(sum(qtf * (CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean_idf ELSE idf END) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / avgdl))), 6) AS bm25
      FROM q JOIN p USING (term) JOIN i USING (term), s, m GROUP BY query_id, doc_id)"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id DESC) AS rank FROM b QUALIFY rank <= 100")
def bm25_topk(spark, sf):
    return retrieve.ranked(retrieve.bm25(corpus(spark, sf), questions(spark, sf), top=100), "bm25", 100)


@query(f"""WITH {_BM25} SELECT query_id, doc_id::VARCHAR AS doc_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id::VARCHAR DESC) AS rank FROM b QUALIFY rank <= 10""")
def index_topk(spark, sf):
    """The ten best documents of each passage, from a stored index."""
    path = store.workspace(spark)
    index.update(corpus(spark, sf), path)
    return index.search(path, questions(spark, sf), 10).rows.select("query_id", "doc_id", "bm25", "rank")


@query(f"""WITH {_BM25}, u AS (SELECT count(*) FILTER (WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0) AS added, count(*) FILTER (WHERE doc_id % 7 > 0 AND doc_id % 5 = 0 OR doc_id % 11 = 0) AS dead FROM documents)
SELECT added, dead, n AS n_docs, round(avgdl, 6) AS avg_length, (SELECT count(*) FROM f) AS n_terms, round(mean_idf, 6) AS mean_idf FROM s, m, u""")
def index_update(spark, sf):
    """Statistics of an index of an older corpus (less a seventh of the documents, a fifth with other texts, some that went)
    after it was brought up to date."""
    now, path = corpus(spark, sf), store.workspace(spark)
    fifth = F.when(F.col("doc_id") % 5 == 0, F.concat(F.reverse("text"), F.lit(" old"))).otherwise(F.col("text"))
    older = now.filter("doc_id % 7 > 0 AND doc_id % 11 > 0").withColumn("text", fifth)
    gone = now.filter("doc_id % 11 = 0").select((-F.col("doc_id") - 1).alias("doc_id"), F.concat("text", F.lit(" gone")).alias("text"))
    index.update(older.unionByName(gone), path)
    done = index.update(now, path)
    own = index.stats(spark, path)
    row = (done["added"], done["dead"], own.n_docs, round(own.avg_length, 6), own.n_terms, round(own.mean_idf, 6))
    return spark.createDataFrame([row], "added long, dead long, n_docs long, avg_length double, n_terms long, mean_idf double")


_MINMAX = """
r AS (SELECT *, count(*) OVER w < n AS rest, min(bm25) OVER w AS lo, max(bm25) OVER w AS hi FROM b, s WINDOW w AS (PARTITION BY query_id)),
x AS (SELECT query_id, doc_id, bm25, CASE WHEN rest THEN least(lo, 0) ELSE lo END AS lo, CASE WHEN rest THEN greatest(hi, 0) ELSE hi END AS hi FROM r),
nb AS (SELECT query_id, doc_id, bm25, CASE WHEN hi > lo THEN (bm25 - lo) / (hi - lo) ELSE 1.0::DOUBLE END AS bm25_norm FROM x)"""


def _normalized(spark, sf) -> DataFrame:
    n = corpus(spark, sf).count()
    return retrieve.min_max(store.written(retrieve.bm25(corpus(spark, sf), questions(spark, sf))), "bm25", F.lit(n))


@query(f"WITH {_BM25}, {_MINMAX} SELECT query_id, doc_id, round(bm25_norm, 6) AS bm25_norm FROM nb")
def bm25_minmax(spark, sf):
    return _normalized(spark, sf).select("query_id", "doc_id", F.round("bm25_norm", 6).alias("bm25_norm"))


@query(f"WITH {_BM25} SELECT n AS n_docs, round(avgdl, 6) AS avg_length, (SELECT count(*) FROM f) AS n_terms, round(mean_idf, 6) AS mean_idf FROM s, m")
def corpus_stats(spark, sf):
    return retrieve.corpus_stats(corpus(spark, sf)).select("n_docs", F.round("avg_length", 6).alias("avg_length"), "n_terms", F.round("mean_idf", 6).alias("mean_idf"))


#: Search takes every fiftieth vector as a query, against all.
def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    all_ = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return all_, all_.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


_DENSE = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
             round(greatest(0, least(1, list_dot_product(a.e, b.e) / ((CASE WHEN a.n = 0 THEN 1 ELSE a.n END) * (CASE WHEN b.n = 0 THEN 1 ELSE b.n END)))), 6) AS dense
      FROM v a, v b WHERE a.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id DESC) AS rank FROM c QUALIFY rank <= 100)"""


@query(f"WITH {_DENSE} SELECT query_id, doc_id, dense, rank FROM t")
def dense_topk(spark, sf):
    return retrieve.dense(*_vectors(spark, sf), 100)


@query(f"WITH {_DENSE} SELECT query_id, doc_id, dense, rank FROM t")
def nearest_topk(spark, sf):
    """The same from a stored table of cells."""
    path, (vectors, asked) = store.workspace(spark), _vectors(spark, sf)
    nearest.build(vectors, path)
    return nearest.search(path, asked, 100).rows.select("query_id", "doc_id", "dense", "rank")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 7 > 0 AS was, CASE WHEN doc_id % 5 = 0 THEN reverse(coalesce(text, '')) || ' old' ELSE coalesce(text, '') END AS before FROM documents)
SELECT (SELECT count(DISTINCT text) FROM t WHERE text NOT IN (SELECT before FROM t WHERE was)) AS embedded, count(*) AS rows, count(DISTINCT text) AS texts FROM t""")
def maintained_vectors(spark, sf):
    """A second run over a corpus of which a seventh is new and a fifth has changed embeds the texts it has not seen."""
    now, path = corpus(spark, sf), store.workspace(spark)
    older = now.filter("doc_id % 7 > 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.reverse(F.coalesce("text", F.lit(""))), F.lit(" old"))).otherwise(F.col("text")))
    embed = lambda rows: rows.withColumn("embedding", models.hashed_embedding(F.col("text"), 16))
    models.maintained_embeddings(older, embed, path, "stub")
    rows, made = models.maintained_embeddings(now, embed, path, "stub")
    found = rows.filter("embedding IS NOT NULL")
    return found.agg(F.lit(made).cast("long").alias("embedded"), F.count("*").alias("rows"), F.countDistinct(F.coalesce("text", F.lit(""))).alias("texts"))


def _hybrid(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents; the vectors that some of them have; and queries: every fiftieth document of those, asked with its
    own text and vector."""
    docs, vectors = corpus(spark, sf), table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    vectors = vectors.join(docs.select("doc_id"), "doc_id", "left_semi")
    return docs, vectors, docs.filter("doc_id % 50 = 0").join(vectors, "doc_id").withColumnRenamed("doc_id", "query_id")


def _fused(spark, sf) -> DataFrame:
    return retrieve.hybrid(*_hybrid(spark, sf))


_HYBRID_BM25 = _BM25.replace(
    "SELECT item_id AS query_id, unnest(" + _TOKENS + ") AS term FROM benchmark", "SELECT doc_id AS query_id, unnest(w) AS term FROM d WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)"
)


@query(f"""WITH {_HYBRID_BM25}, {_MINMAX},
{_DENSE.replace("FROM embeddings)", "FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents))")},
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id DESC) AS lr FROM nb QUALIFY lr <= 100),
o AS (SELECT query_id, doc_id, rank AS dr, dense, max(dense) OVER w AS hi, CASE WHEN count(*) OVER w < n THEN least(0, min(dense) OVER w) ELSE min(dense) OVER w END AS lo
      FROM t, s WINDOW w AS (PARTITION BY query_id)),
e AS (SELECT query_id, doc_id, dr, CASE WHEN hi > lo THEN (dense - lo) / (hi - lo) ELSE 1.0::DOUBLE END AS dn FROM o),
u AS (SELECT coalesce(l.query_id, e.query_id) AS query_id, coalesce(l.doc_id, e.doc_id) AS doc_id, lr, dr, dn FROM l FULL JOIN e ON l.query_id = e.query_id AND l.doc_id = e.doc_id),
z AS (SELECT u.query_id, u.doc_id, round(greatest(0, least(1, 0.4::DOUBLE * coalesce(bm25_norm, 0) + 0.6::DOUBLE * coalesce(dn, 0))), 6) AS fused, coalesce(lr, 100 + dr) AS place
      FROM u LEFT JOIN nb ON u.query_id = nb.query_id AND u.doc_id = nb.doc_id)
SELECT query_id, doc_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, place) AS rank FROM z QUALIFY rank <= 50""")
def hybrid_fused(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", "fused", "rank")


_FUSED_SQL = SQL["hybrid_fused"]
# Each turn every query picks the candidate of the greatest gain among those left, and likeness to it is carried on.
_MMR = f"""
z0 AS ({_FUSED_SQL}),
cand AS (SELECT query_id, doc_id, fused, rank, embedding::DOUBLE[] AS e FROM z0 LEFT JOIN embeddings ON vec_id = doc_id),
unit AS (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM cand),
alike AS (SELECT a.query_id, a.rank AS i, b.rank AS j, CASE WHEN a.n * b.n > 0 THEN greatest(0, least(1, list_dot_product(a.e, b.e) / (a.n * b.n))) ELSE 0 END AS c FROM unit a JOIN unit b USING (query_id)),
mmr AS (
  SELECT query_id, doc_id, fused, rank, 0::DOUBLE AS near, NULL::INT AS place, 0 AS turn FROM cand
  UNION ALL
  SELECT r.query_id, r.doc_id, r.fused, r.rank, greatest(near, c), CASE WHEN place IS NULL AND rank = pick THEN turn + 1 ELSE place END, turn + 1
  FROM (SELECT *, first_value(rank) OVER (PARTITION BY query_id ORDER BY CASE WHEN place IS NULL THEN 0 ELSE 1 END, 0.7::DOUBLE * fused - (1 - 0.7::DOUBLE) * near DESC, rank) AS pick FROM mmr WHERE turn < 20) r
  JOIN alike a ON a.query_id = r.query_id AND a.i = r.rank AND a.j = r.pick),
picked AS (SELECT query_id, doc_id, fused, place AS mmr_rank FROM mmr WHERE turn = 20 AND place IS NOT NULL)"""


@query(f"WITH RECURSIVE {_MMR.lstrip()} SELECT query_id, doc_id, fused, mmr_rank FROM picked")
def mmr_select(spark, sf):
    _, vectors, _ = _hybrid(spark, sf)
    return retrieve.diversified(_fused(spark, sf).select("query_id", "doc_id", "fused", "rank").join(vectors, "doc_id", "left"))


@query(f"""WITH RECURSIVE {_MMR.lstrip()},
w AS (SELECT doc_id, text, {_TOKENS} AS w FROM documents),
s0 AS (SELECT p.query_id, p.doc_id, mmr_rank, d.text, round(CASE WHEN len(list_distinct(q.w)) = 0 THEN 0 ELSE len(list_intersect(list_distinct(q.w), d.w)) / len(list_distinct(q.w)) END, 6) AS score
       FROM picked p JOIN w d ON d.doc_id = p.doc_id JOIN w q ON q.doc_id = p.query_id),
s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mmr_rank) AS rank FROM s0 QUALIFY rank <= 5),
s2 AS (SELECT query_id, rank, '[' || rank || '] From ' || doc_id || ' | rerank=' || printf('%.4f', score) || chr(10) || text || chr(10) AS segment FROM s1),
s3 AS (SELECT *, sum(length(segment)) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM s2),
s4 AS (SELECT query_id, rank, substr(segment, 1, 10000) AS segment FROM s3 WHERE n <= 10000 OR rank = 1)
SELECT query_id, count(*) AS used, length(regexp_replace(string_agg(segment, chr(10) ORDER BY rank), '^\\s+|\\s+$', '', 'g'))::INT AS answer_chars FROM s4 GROUP BY query_id""")
def rag_answers(spark, sf):
    """The whole cascade with stub models: fusion, MMR, rerank, context, answer."""
    docs, _, asked = _hybrid(spark, sf)
    picked = retrieve.with_texts(mmr_select(spark, sf), docs).join(asked.select("query_id", F.col("text").alias("question")), "query_id")
    scored = picked.withColumn("rerank", F.round(models.overlap_score(F.col("question"), F.col("text")), 6))
    best = retrieve.ranked(scored, "rerank", 5, F.col("mmr_rank").asc())
    parts = best.select("query_id", "rank", retrieve.segment(F.col("rank"), F.col("doc_id").cast("string"), F.col("text"), score=F.col("rerank")).alias("segment"))
    prompts = retrieve.contexts(parts).withColumn("prompt", F.concat(F.lit("Answer from this context.\n\n"), F.col("context")))
    return models.echo(prompts).select("query_id", "used", F.length("output").alias("answer_chars"))


_CHILDREN = """
c AS (SELECT o_custkey % 100 AS query_id, l_orderkey AS parent_id, l_orderkey * 10 + l_linenumber AS child_id,
             row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey) AS rank
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _children(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    child = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child_id")
    rows = rows.select((F.col("o_custkey") % 100).alias("query_id"), F.col("l_orderkey").alias("parent_id"), child, "l_extendedprice", "l_partkey", "l_suppkey")
    order = Window.partitionBy("query_id").orderBy(F.col("l_extendedprice").desc(), "child_id", "l_partkey", "l_suppkey")
    return rows.select("query_id", "parent_id", "child_id", F.row_number().over(order).alias("rank"), F.lit("").alias("text"))


@query(f"""WITH {_CHILDREN}, k AS (SELECT * FROM c WHERE parent_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) = 1)
SELECT query_id, parent_id, child_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS parent_rank FROM f QUALIFY parent_rank <= 5""")
def parent_resolve(spark, sf):
    known = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return retrieve.parents(_children(spark, sf), known).select("query_id", "parent_id", "child_id", "parent_rank")


@query(f"WITH {_CHILDREN} SELECT child_id, parent_id FROM c WHERE parent_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def orphan_children(spark, sf):
    known = table(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return retrieve.orphans(_children(spark, sf), known).select("child_id", "parent_id")


@query("""WITH r AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, text FROM documents),
s AS (SELECT query_id, rank, '[' || rank || '] From doc' || doc_id || chr(10) || text || chr(10) AS segment FROM r),
c AS (SELECT *, sum(length(segment)) OVER (PARTITION BY query_id ORDER BY rank) AS n FROM s),
k AS (SELECT query_id, rank, substr(segment, 1, 16000) AS segment FROM c WHERE n <= 16000 OR rank = 1)
SELECT query_id, md5(regexp_replace(string_agg(segment, chr(10) ORDER BY rank), '^\\s+|\\s+$', '', 'g')) AS context_md5, count(*) AS used FROM k GROUP BY query_id""")
def context_budget(spark, sf):
    # A segment has eight characters and more, so a source needs no more of its documents than this.
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    first = table(spark, sf, "documents").select("source", "doc_id").withColumn("rank", rank).filter(F.col("rank") <= 16_000 // 8)
    rows = table(spark, sf, "documents").join(first, ["source", "doc_id"]).select(F.col("source").alias("query_id"), "rank", "doc_id", "text")
    parts = rows.select("query_id", "rank", retrieve.segment(F.col("rank"), F.concat(F.lit("doc"), "doc_id"), F.col("text")).alias("segment"))
    return retrieve.contexts(parts, 16_000).select("query_id", F.md5("context").alias("context_md5"), "used")


# Chunks --------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, 'chunk_' || substr(md5(source || '::' || substr(text, 1, 120)), 1, 12) AS chunk_id,
       'c' || substr(md5(source), 1, 4) || lower(CASE WHEN doc_id >= 46656 THEN substr(d, (doc_id // 46656) % 36 + 1, 1) ELSE '' END || CASE WHEN doc_id >= 1296 THEN substr(d, (doc_id // 1296) % 36 + 1, 1) ELSE '' END
           || CASE WHEN doc_id >= 36 THEN substr(d, (doc_id // 36) % 36 + 1, 1) ELSE '' END || substr(d, doc_id % 36 + 1, 1)) AS short_id
FROM (SELECT *, '0123456789abcdefghijklmnopqrstuvwxyz' AS d FROM documents)""")
def chunk_ids(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"), T.indexed_id(F.col("source"), F.col("doc_id")).alias("short_id"))


@query("SELECT doc_id, md5(substr(text, 1, 120)) AS chunk_id FROM documents QUALIFY row_number() OVER (PARTITION BY md5(substr(text, 1, 120)) ORDER BY doc_id) = 1")
def dedup_first(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.substring("text", 1, 120)).alias("chunk_id"))
    return chunk._first_of(rows, "doc_id")


_TYPE = "CASE WHEN contains(text, '$$') OR regexp_matches(text, '\\$[^$\\n]+\\$') THEN CASE WHEN regexp_matches(text, '(?m)^\\|') THEN 'mixed' ELSE 'equation' END WHEN regexp_matches(text, '(?m)^\\|') THEN 'table' ELSE 'text' END"


@query(f"SELECT doc_id, greatest(1, length(text) // 4)::INT AS token_estimate, {_TYPE} AS content_type FROM documents")
def token_estimate(spark, sf):
    return corpus(spark, sf).select("doc_id", T.token_estimate(F.col("text")).alias("token_estimate"), chunk.content_type(F.col("text")).alias("content_type"))


@query(f"""SELECT count(*) AS total, count(DISTINCT source) AS files, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, count(*) FILTER (WHERE {_TYPE} = 'text') AS text,
       count(*) FILTER (WHERE {_TYPE} = 'equation') AS equation, round_even(avg(greatest(1, length(text) // 4)), 1) AS mean_tokens FROM documents""")
def chunk_summary(spark, sf):
    out = chunk.summary(table(spark, sf, "documents").select(F.col("source").alias("source_file"), "text"))
    of = lambda k: F.coalesce(F.col("by_type")[k], F.lit(0)).alias(k)
    return out.select("total", "files", "tokens", of("text"), of("equation"), "mean_tokens")


_NUMBERS = "(o_orderkey % 9 + 1)::VARCHAR || CASE WHEN o_orderkey % 3 > 0 THEN '.' || (o_orderkey % 5) ELSE '' END || CASE WHEN o_orderkey % 3 > 1 THEN '.' || (o_orderkey % 4) ELSE '' END"


def _numbers(key: str = "o_orderkey"):
    k = F.col(key)
    part = lambda c, n: F.when(c, F.concat(F.lit("."), (k % n).cast("string"))).otherwise(F.lit(""))
    return F.concat((k % 9 + 1).cast("string"), part(k % 3 > 0, 5), part(k % 3 > 1, 4))


@query(f"""SELECT o_orderkey, {_NUMBERS} AS section, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN (o_orderkey % 9 + 1)::VARCHAR ELSE (o_orderkey % 9 + 1)::VARCHAR || '.' || (o_orderkey % 5) END AS parent_section FROM orders""")
def section_numbers(spark, sf):
    heading = F.concat(F.lit(" **"), _numbers(), F.lit(" Orders** of "), "o_orderpriority")
    found = chunk.section_number(heading)
    return table(spark, sf, "orders").select("o_orderkey", found.alias("section"), chunk.parent_section(found).alias("parent_section"))


# Headings ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'non-numbered' ELSE 'numbered' END AS category FROM orders")
def heading_category(spark, sf):
    k = F.col("o_orderkey")
    heading = (
        F.when(k % 4 == 0, F.concat(F.lit("**"), _numbers(), F.lit(" Title**")))
        .when(k % 4 == 1, F.concat(F.lit("<b>"), _numbers(), F.lit("</b> Scope")))
        .when(k % 4 == 2, F.concat(F.lit("> - "), _numbers(), F.lit(") Loads")))
        .otherwise(F.concat(F.lit("Order "), "o_orderpriority"))
    )
    return table(spark, sf, "orders").select("o_orderkey", normalize.heading_category(heading).alias("category"))


def _heading_docs(spark, sf) -> DataFrame:
    """A document per customer: a heading per order, numbered if urgent or high, with a fence in between."""
    line = F.when(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.concat(F.lit("## "), F.col("o_orderkey"), F.lit(".1 Order"))
    ).otherwise(F.concat(F.lit("### Order "), F.col("o_orderkey"), F.lit(" ###")))
    body = F.concat(line, F.lit("\n\ntext of "), F.col("o_orderkey"), F.lit("\n```\n# not a heading\n```\n"))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", body.alias("b")))).alias("x"))
    return rows.select("o_custkey", F.array_join(F.transform("x", lambda r: r["b"]), "\n").alias("text"))


@query("""SELECT o_custkey, CASE WHEN 2 * count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) >= count(*) THEN 'numbered' ELSE 'non-numbered' END AS format,
       (count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')))::INT AS numbered, count(*)::INT AS total FROM orders GROUP BY o_custkey""")
def doc_format(spark, sf):
    found = _heading_docs(spark, sf).select("o_custkey", normalize.headings(F.col("text")).alias("h"))
    return found.select("o_custkey", normalize.document_format(F.transform("h", lambda x: x["text"])).alias("f")).select("o_custkey", "f.*")


@query("""SELECT o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 7)::INT AS line_index, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2 ELSE 3 END AS level,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderkey || '.1 Order' ELSE 'Order ' || o_orderkey END AS text FROM orders""")
def headings_roundtrip(spark, sf):
    return _heading_docs(spark, sf).select("o_custkey", F.inline(normalize.headings(F.col("text"))))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '# ' ELSE '## ' END || c_name AS heading FROM customer")
def hierarchy_shift(spark, sf):
    level = (F.col("c_custkey") % 6).cast("int")
    deep = F.when(level > 2, level).otherwise(level + 1)
    text = F.concat(F.lit("# Title\n\n"), F.repeat(F.lit("#"), deep), F.lit(" "), "c_name", F.lit("\n"))
    out = normalize.with_hierarchy(F.when(deep == 1, F.concat(F.repeat(F.lit("#"), deep), F.lit(" "), "c_name")).otherwise(text))
    return table(spark, sf, "customer").select("c_custkey", F.element_at(T.lines(out), -1).alias("heading"))


@query(f"SELECT o_orderkey, repeat('#', (o_orderkey % 3 + 1)::INT) || ' ' || {_NUMBERS} || ' Order ' || o_orderpriority AS heading FROM orders")
def promoted_headings(spark, sf):
    text = F.concat(F.lit("- **"), _numbers(), F.lit(": Order "), "o_orderpriority", F.lit("**"))
    return table(spark, sf, "orders").select("o_orderkey", normalize.promoted(text).alias("heading"))


@query("SELECT o_orderkey, 'Order ' || o_orderpriority AS text FROM orders")
def front_matter(spark, sf):
    text = F.concat(F.lit("## **Order "), "o_orderpriority", F.lit("**\n# 1 First\n## kept"))
    return table(spark, sf, "orders").select("o_orderkey", F.get(T.lines(normalize.demoted_front_matter(text)), 0).alias("text"))


@query("SELECT o_orderkey, o_orderpriority || chr(10) || 'after' AS text FROM orders")
def context_labels(spark, sf):
    text = F.concat(F.lit("Formula context for RAG:\n"), "o_orderpriority", F.lit("\n  RAG enrichment block\nafter"))
    return table(spark, sf, "orders").select("o_orderkey", normalize.without_context_labels(text).alias("text"))


@query("""SELECT o_custkey, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS agreement,
       CASE WHEN avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) >= 0.65 THEN 'model' ELSE 'heuristic' END AS taken FROM orders GROUP BY o_custkey""")
def label_reconciliation(spark, sf):
    own = F.transform("s", lambda _: F.lit("a"))
    model = F.transform("s", lambda s: F.when(s == "F", "a").otherwise("b"))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"))
    rows = rows.select("o_custkey", own.alias("own"), F.concat(model, F.array(F.lit("end"))).alias("model"), F.concat(own, F.array(F.lit("end"))).alias("_o"))
    cut = F.slice("model", F.lit(1), F.size("own"))
    chosen = normalize.reconciled(F.col("own"), cut, cut)
    taken = F.when(normalize.agreement(F.col("own"), cut) >= 0.65, "model").otherwise("heuristic")
    return rows.select("o_custkey", F.round(normalize.agreement(F.col("own"), cut), 6).alias("agreement"), F.when(chosen == F.when(taken == "model", cut).otherwise(F.col("own")), taken).alias("taken"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT o_orderpriority FROM orders WHERE o_orderkey = l_orderkey) AS heading FROM lineitem""")
def nearest_heading(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), F.concat(F.lit("## "), "o_orderpriority").alias("text"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("s"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.lit("item").alias("text"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    rows = chunk.nearest_headings(orders.unionByName(items), "k", "line", "p", "s").filter("line > 0")
    return rows.select(F.col("k").alias("l_orderkey"), F.col("line").alias("l_linenumber"), F.col("p").alias("l_partkey"), F.col("s").alias("l_suppkey"), "heading")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a b' ELSE 'a <span id=\"n\">keep</span>b' END AS text, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS removed FROM orders")
def page_spans(spark, sf):
    k = F.col("o_orderkey")
    first = F.concat(F.lit("a <span id='page-"), k, F.lit("-0'>Page "), k % 1000, F.lit("</span>"))
    second = F.when(k % 2 == 0, F.lit('<SPAN class="x" id="section-1"> &nbsp;</SPAN>')).otherwise(F.lit('<span id="n">keep</span>'))
    out = normalize.without_page_spans(F.concat(first, second, F.lit("b")))
    return table(spark, sf, "orders").select("o_orderkey", out.alias("o")).select("o_orderkey", "o.*")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '## **' || o_orderpriority || '**' WHEN 1 THEN o_orderpriority ELSE o_orderpriority || ' in 1999' END || chr(10) AS text, 1 AS unwrapped FROM orders""")
def page_links(spark, sf):
    k = F.col("o_orderkey")
    link = F.concat(F.lit("["), F.when(k % 3 == 0, F.concat(F.lit("**"), "o_orderpriority", F.lit("**"))).otherwise(F.col("o_orderpriority")), F.lit("](#page-"), k % 90, F.lit("-0)"))
    line = F.concat(F.when(k % 3 == 0, "## ").otherwise(""), link, F.when(k % 3 == 1, F.concat(F.lit("  "), (k % 500).cast("string"))).when(k % 3 == 2, " in 1999").otherwise(""), F.lit("\n"))
    return table(spark, sf, "orders").select("o_orderkey", normalize.without_page_links(line).alias("o")).select("o_orderkey", "o.*")


# Tables and formulas -------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supplier, l_linenumber::VARCHAR AS line FROM lineitem")
def table_roundtrip(spark, sf):
    row = F.concat(F.lit("| "), "l_partkey", F.lit(" | "), "l_suppkey", F.lit(" | "), "l_linenumber", F.lit(" |"))
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    docs = docs.select("l_orderkey", F.concat(F.lit("| part | supplier | line |\n|:---|---|---:|\n"), "body").alias("text"))
    rows = docs.select("l_orderkey", F.explode(table_rows_udf()(F.col("text"))).alias("r"))
    return rows.select("l_orderkey", F.col("r")["part"].alias("part"), F.col("r")["supplier"].alias("supplier"), F.col("r")["line"].alias("line"))


@query("SELECT p_partkey, '$$' || chr(10) || 'x_{' || p_size || '} = ' || p_partkey || chr(10) || '$$' || chr(10) || 'where x = ' || p_brand AS equation FROM part")
def equation_roundtrip(spark, sf):
    text = F.concat(F.lit("Intro\n\n$$\nx_{"), "p_size", F.lit("} = "), "p_partkey", F.lit("\n$$\nwhere x = "), "p_brand", F.lit("\n\nOutro $5"))
    return table(spark, sf, "part").select("p_partkey", F.explode(equations_udf()(text)).alias("equation"))


@query("SELECT p_partkey, 2 AS n, '$x_' || p_size || '$' AS first FROM part")
def math_scan(spark, sf):
    found = enrich.formulas(F.concat(F.lit("a $x_"), "p_size", F.lit("$ b $$y$$ c $z")))
    return table(spark, sf, "part").select("p_partkey", F.size(found).alias("n"), F.get(found, 0).alias("first"))


@query("""WITH n AS (SELECT n_regionkey, greatest(3, max(length(n_name)), 4)::INT AS a FROM nation GROUP BY n_regionkey)
SELECT n_regionkey, '| ' || rpad('name', a, ' ') || ' | key |' || chr(10) || '|' || repeat('-', a + 2) || '|-----|' || chr(10) ||
       string_agg('| ' || rpad(n_name, a, ' ') || ' | ' || rpad(n_nationkey::VARCHAR, 3, ' ') || ' |', chr(10) ORDER BY n_nationkey) AS text
FROM nation JOIN n USING (n_regionkey) GROUP BY n_regionkey, a""")
def table_widths(spark, sf):
    row = F.concat(F.lit("|"), "n_name", F.lit("|"), "n_nationkey", F.lit("|"))
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))).alias("x"))
    text = F.concat(F.lit("\n|name|key|\n|-|-|\n"), F.array_join(F.transform("x", lambda r: r["r"]), "\n"))
    return rows.select("n_regionkey", enrich.tables_widened(text).alias("text"))


@query("SELECT p_partkey, length(p_name) > 0 AND p_partkey % 2 = 0 AS collapsed FROM part")
def collapsed_headers(spark, sf):
    wide = F.concat(F.lit("| "), F.rpad("p_name", 40, "x"), F.lit(" | "), F.rpad("p_type", 40, "y"), F.lit(" |\n| 1 | 2 |"))
    plain = F.lit("| a | b |\n| 1 | 2 |")
    return table(spark, sf, "part").select("p_partkey", enrich.has_collapsed_headers(F.when(F.col("p_partkey") % 2 == 0, wide).otherwise(plain)).alias("collapsed"))


@query("SELECT p_partkey, '| ' || p_brand || ' x | y |' || chr(10) || 'two  spaces' AS text FROM part")
def preprocessed_cells(spark, sf):
    text = F.concat(F.lit('<span id="page-1-0"> </span>| '), "p_brand", F.lit("<BR />   x | y |\ntwo  spaces"))
    return table(spark, sf, "part").select("p_partkey", enrich.preprocessed(text).alias("text"))


@query("""WITH p AS (SELECT doc_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
n AS (SELECT *, (length(a) - length(replace(a, '$$', ''))) // 2 AS ma, (length(b) - length(replace(b, '$$', ''))) // 2 AS mb, length(a) - length(replace(a, '|', '')) AS pa, length(b) - length(replace(b, '|', '')) AS pb FROM p)
SELECT doc_id, coalesce(length(b) >= length(a) * 0.7::DOUBLE AND (ma = 0 OR mb >= ma) AND (pa <= 10 OR pb >= pa * 0.8::DOUBLE), false) AS safe FROM n""")
def enhancement_valid(spark, sf):
    after = F.lead("text").over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf, "documents").select("doc_id", "text", after.alias("b")).select("doc_id", enrich.is_safe(F.col("text"), F.col("b")).alias("safe"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '**Domain keywords:** ' || p_type || chr(10) || 'Step 3: Open the valve' ELSE '## ' || p_type || chr(10) || 'Step 3: Open the valve' END AS text,
       1 AS steps, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS labels FROM part""")
def step_cleanup(spark, sf):
    label = F.when(F.col("p_partkey") % 2 == 0, "#### **Domain keywords:** ").otherwise("## ")
    text = F.concat(F.lit("### STEP 2 — Add RAG enrichment block\n"), label, "p_type", F.lit("\nStep 3: Open the valve"))
    return table(spark, sf, "part").select("p_partkey", enrich.without_echoes(text).alias("o")).select("p_partkey", "o.text", "o.steps", "o.labels")


@query("SELECT p_partkey, 'see $Y' || p_size || '$ and $$X' || p_partkey || '$$ end' AS text FROM part")
def log_replay(spark, sf):
    docs = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("see $y"), "p_size", F.lit("$ and $$x"), "p_partkey", F.lit("$$ end")).alias("text"))
    asked = enrich.elements(docs, "p_partkey").filter("task = 'math'")
    log = enrich.answered(asked, lambda rows: rows.withColumn("output", F.upper("input")))
    return enrich.replayed(docs, log, "p_partkey").select("p_partkey", "text")


# Figures -------------------------------------------------------------------------------------------------------------


def _figure_docs(spark, sf) -> DataFrame:
    """A document per part: a heading, a figure, a caption, the same figure, a link to the web and one to a page."""
    k = F.col("p_partkey").cast("string")
    ref = F.concat(F.lit("![alt]( _page_"), k, F.lit("_Figure_0.JPEG )"))
    text = F.concat(F.lit("## "), "p_name", F.lit("\n\n"), ref, F.lit("\nFigure 1: "), "p_type", F.lit("\n\n$a=b$\n\n"), ref, F.lit("![w](http://x.y/z.png)![t](notes.txt)"))
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_type", text.alias("text"))


@query("""SELECT p_partkey, ordinal, p_partkey::INT AS page, 'Fig_page_' || p_partkey || '_Figure_0' || CASE WHEN ordinal > 0 THEN '_1' ELSE '' END AS figure_id,
       CASE WHEN ordinal = 0 THEN length(p_name) + 5 ELSE length(p_name) + 5 + 30 + length(p_partkey::VARCHAR) + length(p_type) + 20 END AS offset FROM part, (VALUES (0), (1)) o(ordinal)""")
def figure_refs(spark, sf):
    return figures.references(_figure_docs(spark, sf), "p_partkey").select("p_partkey", "ordinal", "page", "figure_id", "offset")


@query("SELECT p_partkey, ordinal, '## ' || p_name AS section_heading, p_type AS caption, 1 AS n_equations, 0 AS n_tables FROM part, (VALUES (0), (1)) o(ordinal)")
def figure_context(spark, sf):
    docs = _figure_docs(spark, sf)
    refs = figures.references(docs, "p_partkey").join(docs.select("p_partkey", "text"), "p_partkey")
    out = refs.select("p_partkey", "ordinal", figures.context(F.col("text"), F.col("offset"), F.col("original_ref")).alias("c"))
    return out.select("p_partkey", "ordinal", "c.section_heading", "c.caption", F.size("c.nearby_equations").alias("n_equations"), F.size("c.nearby_tables").alias("n_tables"))


@query("SELECT p_partkey, '## ' || p_name || chr(10) || chr(10) || '[Fig_page_' || p_partkey || '_Figure_0]' || chr(10) || 'Figure 1: ' || p_type || chr(10) || chr(10) || '$a=b$' || chr(10) || chr(10) || '[Fig_page_' || p_partkey || '_Figure_0_1]![w](http://x.y/z.png)![t](notes.txt)' AS text FROM part")
def figure_reinsertion(spark, sf):
    docs = _figure_docs(spark, sf)
    blocks = figures.references(docs, "p_partkey").withColumn("block", F.concat(F.lit("["), "figure_id", F.lit("]")))
    return figures.reinserted(docs, blocks, "p_partkey").select("p_partkey", "text")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round(greatest(0, least(1, (CASE WHEN value BETWEEN 0 AND 1 THEN value ELSE 0.5 END)
       - 0.1 * (CASE WHEN value = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) - CASE WHEN event_id % 3 = 0 THEN 0.15 ELSE 0 END)), 6) END::DOUBLE AS confidence FROM events""")
def confidence(spark, sf):
    k = F.col("event_id")
    fields = F.to_json(
        F.struct(
            F.lit("f").alias("figure_id"),
            F.lit("plot").alias("figure_type"),
            F.when(k % 2 == 0, "").otherwise("said").alias("caption_summary"),
            F.col("value").alias("confidence"),
            F.when(k % 3 == 0, "short").otherwise("a longer text").alias("extracted_text"),
        )
    )
    raw = F.when(k % 5 == 0, "no json at all").when(k % 5 == 1, F.concat(F.lit("```json\n"), fields, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure: "), fields, F.lit(" done")))
    rows = table(spark, sf, "events").select("event_id", figures.parsed(raw).alias("p"))
    return rows.select("event_id", F.round(figures.confidence(F.col("p.fields"), F.col("p.valid")), 6).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'fig' || p_partkey END || CASE WHEN p_partkey % 3 = 0 AND row_number() OVER (PARTITION BY p_size, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'fig' || p_partkey END ORDER BY p_partkey) > 1 THEN '__fig' || p_partkey ELSE '' END AS registry_id FROM part")
def figure_registry(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select("p_partkey", "p_size", k.alias("ordinal"), F.concat(F.lit("fig"), k).alias("figure_id"), F.when(k % 3 == 0, F.col("p_brand")).alias("model_id"))
    return figures.registry(rows, "p_size").select("p_partkey", "registry_id")


# Answers, results, housekeeping ----------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Yes' ELSE '' END AS verdict FROM conversations")
def judge_parse(spark, sf):
    block = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("**Result Accuracy**: No, first\n "), F.replace("text", F.lit("*"), F.lit("")), F.lit("\n **Result Accuracy**: Yes , because, of that"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", models.judged(block).alias("verdict"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return models.pending(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, md5(CASE WHEN len(w) > 50 THEN array_to_string(w[1:50], ' ') ELSE text END) AS text_md5, least(len(w), 50)::INT AS count, len(w) > 50 AS truncated FROM w""")
def word_truncate(spark, sf):
    out = corpus(spark, sf).select("doc_id", T.first_words(F.col("text"), 50).alias("t"))
    return out.select("doc_id", F.md5("t.text").alias("text_md5"), "t.count", "t.truncated")


@query("SELECT conv_id, turn, md5(replace(text, chr(11), '')) AS text_md5 FROM conversations")
def excel_sanitize(spark, sf):
    dirty = F.concat(F.lit("\x01"), "text", F.lit("\x1f"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.without_controls(dirty)).alias("text_md5"))


@query("SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._()\\- +]+', '_', 'g'), 1, 160) AS name FROM pages")
def path_sanitize(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.path_part(F.col("url")).alias("name"))


from quirespark.plans import stages  # noqa: E402, F401  (registers its queries)
