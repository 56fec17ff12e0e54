"""Exact nearest neighbours by cells: a stored table of vectors that is read only where it can matter.

Vectors of one width are dealt to the nearest of some of their own number, the pivots; a cell knows the widest angle of its
vectors to its pivot. The angle between a query and any vector of the cell is at least that to the pivot less this
radius. ``search`` goes two rounds: the nearest cells that hold k vectors together give the k-th best cosine, then only cells
that can hold a better one are compared. In the second round blocks of queries and parts of the table, of whole or parted
cells, meet in tasks, which tell from the pivots what a query has to be compared with: no query is sent once for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirespark.operators.retrieve import DIGITS, ranked
from quirespark.sources import store

#: Pivots of a width at most; a few MB that every task holds.
PIVOTS = 2048
#: So many vectors and queries of a cell meet in one task.
CELL_ROWS, CELL_QUERIES = 32_768, 4096
#: So many vectors and queries meet in a task of the second round, whose scores are made so many at a time.
PART_ROWS, BLOCK_QUERIES, SCORES = 65_536, 16_384, 4 << 20
_SLACK = 1e-9
_VECTORS = "width int, cell int, doc_id long, unit array<double>, angle double"
_CELLS = "width int, cell int, n long, radius double, pivot array<double>"


def _good(v: Column) -> Column:
    """Whether a vector has a direction: it is there, finite in all components and not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array, width: int) -> np.ndarray:
    out = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    out = out / np.abs(out).max(axis=1, keepdims=True)  # before squares, which might be too large or small
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows (id, vector) with vectors of one width."""
    for b in batches:
        widths = pc.list_value_length(b.column(1))
        for w in pc.unique(widths).to_pylist():
            yield w, b.filter(pc.equal(widths, w))


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, width, dtype=np.int32), matrix.ravel())


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def build(vectors: DataFrame, path: str, doc_id: str = "doc_id", vector: str = "embedding", pivots: int = PIVOTS) -> None:
    """Writes the table. Ids are whole numbers; of each width, the square root of its number of vectors are pivots, least
    hashes first, ``pivots`` at most. Vectors that are null, empty, zero, or hold what is no finite number are alike to nothing;
    their ids are kept."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(vector).cast("array<double>").alias("v"))
    store.written(own.filter(~_good(F.col("v"))).select("doc_id"), f"{path}/odd")
    good = own.filter(_good(F.col("v"))).withColumn("width", F.size("v"))
    counts = good.groupBy("width").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("wanted"))
    place = F.row_number().over(Window.partitionBy("width").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = good.select("width", "doc_id", "v").withColumn("place", place).filter(F.col("place") <= pivots).join(counts, "width").filter("place <= wanted")
    chosen: dict[int, np.ndarray] = {}
    for r in drawn.select("width", "place", "v").orderBy("width", "place").collect():  # ``pivots`` of a width at most
        chosen.setdefault(r.width, []).append(r.v)
    chosen = {w: _units(pa.array(vs, pa.list_(pa.float64())), w) for w, vs in chosen.items()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, b in _by_width(batches):
            unit = _units(b.column(1), w)
            angle = _angles(unit, chosen[w])
            cell = angle.argmin(axis=1)
            columns = [pa.array(np.full(len(cell), w, np.int32)), pa.array(cell.astype(np.int32)), b.column(0), _lists(unit), pa.array(angle[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays(columns, names=["width", "cell", "doc_id", "unit", "angle"])

    rows = good.select("doc_id", "v").mapInArrow(dealt, _VECTORS).repartitionByRange("width", "cell", "doc_id").sortWithinPartitions("width", "cell", "doc_id")
    rows.write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(f"{path}/vectors")
    sizes = spark.read.schema(_VECTORS).parquet(f"{path}/vectors").groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    pivot_rows = [(w, i, v.tolist()) for w, vs in chosen.items() for i, v in enumerate(vs)]
    store.written(sizes.join(spark.createDataFrame(pivot_rows, "width int, cell int, pivot array<double>"), ["width", "cell"]).select("width", "cell", "n", "radius", "pivot"), f"{path}/cells")


class Found(NamedTuple):
    """``rows`` (query_id, doc_id, dense, rank), and of all pairs of a query and a vector of its width the share never compared."""

    rows: DataFrame
    spared: float


def search(path: str, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding") -> Found:
    """The ``k`` vectors of the greatest cosines, at least 0 and in six digits, for each query; among equals the greater id
    comes first. Vectors of another width than the query's have a cosine of 0, as all have with a query that is alike to nothing."""
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v"))
    cells: dict[int, tuple] = {}
    for w, own in spark.read.schema(_CELLS).parquet(f"{path}/cells").toPandas().sort_values(["width", "cell"]).groupby("width"):
        cells[int(w)] = (own["cell"].to_numpy(), own["n"].to_numpy(), own["radius"].to_numpy(), np.stack(own["pivot"]))

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, width, cell): for each query the nearest cells of its width that hold k vectors."""
        for w, b in _by_width(batches):
            if w not in cells:
                continue
            cell, n, _, pivot = cells[w]
            unit = _units(b.column(1), w)
            for at in range(0, len(unit), 256):
                some = unit[at : at + 256]
                angle = _angles(some, pivot)
                order = np.argsort(angle, axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                q, c = np.nonzero(before < k)
                columns = [b.column(0).slice(at, len(some)).take(pa.array(q)), pa.array(np.full(len(q), w, np.int32)), pa.array(cell[order[q, c]].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "width", "cell"])

    directed = store.written(asked.filter(_good(F.col("v"))))
    plan = store.written(directed.mapInArrow(planned, "query_id long, width int, cell int"))
    first = store.written(_compared(path, plan, directed, k))
    bound = ranked(first, "dense", k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("dense").alias("least")).filter(F.col("n") >= k).select("query_id", "least")
    known = plan.groupBy("query_id").agg(F.collect_list("cell").alias("known"))  # few of a query's cells
    later = store.written(_later(path, store.written(directed.join(known, "query_id").join(bound, "query_id", "left")), cells, k))
    found = first.unionByName(later.filter("n IS NULL").select("query_id", "doc_id", "dense")).filter("dense > 0")

    # documents of cosine 0 count where fewer than k have more; of the greatest 2 k ids at least k are then left
    every = spark.read.schema(_VECTORS).parquet(f"{path}/vectors").select("doc_id").unionByName(spark.read.schema("doc_id long").parquet(f"{path}/odd"))
    last = every.orderBy(F.desc("doc_id")).limit(2 * k)
    blank = asked.select("query_id").crossJoin(F.broadcast(last)).join(found.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")  # 2 k rows
    rows = ranked(found.unionByName(blank.withColumn("dense", F.lit(0.0))), "dense", k)

    sizes = spark.read.schema(_CELLS).parquet(f"{path}/cells").select("width", "cell", "n")
    read = plan.join(sizes, ["width", "cell"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + later.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    all_ = directed.select(F.size("v").alias("width")).join(sizes.groupBy("width").agg(F.sum("n").alias("n")), "width").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Found(rows, 1 - read / all_ if all_ else 0.0)


def _compared(path: str, pairs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, dense): the best ``k`` of each query in each part of each cell that it is paired with."""
    spark = pairs.sparkSession
    sizes = spark.read.schema(_CELLS).parquet(f"{path}/cells").select("width", "cell", "n")
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    shape = pairs.groupBy("width", "cell").agg(F.count("*").alias("asking")).join(sizes, ["width", "cell"]).select("width", "cell", parts("asking", CELL_QUERIES).alias("m"), parts("n", CELL_ROWS).alias("parts"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = pairs.select("query_id", "width", "cell").join(asked, "query_id").join(shape, ["width", "cell"])
    left = left.withColumn("i", F.pmod(F.xxhash64("query_id"), F.col("m")).cast("int")).withColumn("j", each("parts")).select("width", "cell", "i", "j", "query_id", "v")
    right = spark.read.schema(_VECTORS).parquet(f"{path}/vectors").join(shape, ["width", "cell"])
    right = right.withColumn("j", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("i", each("m")).select("width", "cell", "i", "j", "doc_id", "unit")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "doc_id": [], "dense": []}
        if left.num_rows and right.num_rows:
            width = left["width"][0].as_py()
            docs = right["doc_id"].to_numpy()
            unit = right["unit"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            ids, vectors = left["query_id"].to_numpy(), _units(left["v"].combine_chunks(), width)
            for at in range(0, len(ids), 256):
                score = np.round(np.clip(vectors[at : at + 256] @ unit.T, 0, 1), DIGITS)
                order = np.lexsort((np.broadcast_to(-docs, score.shape), -score), axis=1)[:, :k]
                out["query_id"].append(np.repeat(ids[at : at + 256], order.shape[1]))
                out["doc_id"].append(docs[order].ravel())
                out["dense"].append(np.take_along_axis(score, order, 1).ravel())
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.float64() if n == "dense" else pa.int64()) for n, c in out.items()})

    group = ["width", "cell", "i", "j"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(best, "query_id long, doc_id long, dense double")


def _later(path: str, asked: DataFrame, cells: dict[int, tuple], k: int) -> DataFrame:
    """(query_id, doc_id, dense, n): the best ``k`` in each part of the table for queries (query_id, v, known, least), of cells
    not ``known`` that can hold what reaches ``least``, and a row that says how many pairs a task has compared."""
    parts = {w: max(1, -(-int(n.sum()) // PART_ROWS)) for w, (_, n, _, _) in cells.items()}
    # Cells in their order are cut into parts of equal sizes, so that a part has few, or a share of a large one.
    spans = {(w, int(c)): (int(before), int(n)) for w, (cell, ns, _, _) in cells.items() for c, n, before in zip(cell, ns, np.cumsum(ns) - ns, strict=True)}
    spark = asked.sparkSession
    if not spans:
        return spark.createDataFrame([], "query_id long, doc_id long, dense double, n long")
    widths = asked.groupBy(F.size("v").alias("width")).count().collect()
    blocks = {r["width"]: max(1, -(-r["count"] // BLOCK_QUERIES)) for r in widths if r["width"] in parts}
    shape = F.broadcast(spark.createDataFrame([(w, m, parts[w]) for w, m in blocks.items()], "width int, m int, parts int"))  # a row a width
    places = F.broadcast(spark.createDataFrame([(*key, *at) for key, at in spans.items()], "width int, cell int, before long, size long"))  # ``PIVOTS`` of a width at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda key, n: F.pmod(F.xxhash64(key), n)
    group, tasks = ["width", "i", "j"], max(1, sum(m * parts[w] for w, m in blocks.items()))
    left = asked.withColumn("width", F.size("v")).join(shape, "width").withColumn("i", share("query_id", F.col("m")).cast("int"))
    left = left.withColumn("j", each("parts")).select(*group, "query_id", "v", "known", "least")
    right = spark.read.schema(_VECTORS).parquet(f"{path}/vectors").join(shape, "width").join(places, ["width", "cell"])
    right = right.withColumn("j", F.expr(f"least((before + pmod(xxhash64(doc_id), size)) div {PART_ROWS}, parts - 1)").cast("int"))
    right = right.withColumn("i", each("m")).select(*group, "cell", "doc_id", "unit")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out, compared = {"query_id": [], "doc_id": [], "dense": []}, 0
        if left.num_rows and right.num_rows:
            width = left["width"][0].as_py()
            right = right.sort_by([("cell", "ascending"), ("doc_id", "ascending")])
            docs, cell = right["doc_id"].to_numpy(), right["cell"].to_numpy()
            unit = right["unit"].combine_chunks().flatten().to_numpy().reshape(-1, width)
            own, begins = np.unique(cell, return_index=True)
            ends = np.append(begins[1:], len(cell))
            names, _, radius, pivot = cells[width]
            at = np.searchsorted(names, own)
            ids, vectors, known = left["query_id"].to_numpy(), _units(left["v"].combine_chunks(), width), left["known"].to_pylist()
            least = pc.fill_null(left["least"], 0.0).to_numpy()
            step = max(1, SCORES // len(docs))
            for start in range(0, len(ids), step):
                some, floor = vectors[start : start + step], least[start : start + step]
                reach = np.cos(np.maximum(0, _angles(some, pivot[at]) - radius[at] - _SLACK)) + _SLACK
                need = (reach > 0) & (reach >= floor[:, None] - 10.0**-DIGITS)
                for q, cs in enumerate(known[start : start + step]):
                    need[q, np.isin(own, cs)] = False
                score = np.zeros((len(some), len(docs)))
                for c in np.flatnonzero(need.any(axis=0)):
                    q, rows = np.flatnonzero(need[:, c]), slice(begins[c], ends[c])
                    score[q, rows] = np.round(np.clip(some[q] @ unit[rows].T, 0, 1), DIGITS)
                    compared += len(q) * int(ends[c] - begins[c])
                for q in np.flatnonzero(need.any(axis=1)):
                    x = np.flatnonzero((score[q] > 0) & (score[q] >= floor[q]))
                    if len(x) > k:
                        x = x[score[q, x] >= np.partition(score[q, x], len(x) - k)[len(x) - k]]
                        x = x[np.lexsort((-docs[x], -score[q, x]))[:k]]
                    out["query_id"].append(np.full(len(x), ids[start + q]))
                    out["doc_id"].append(docs[x])
                    out["dense"].append(score[q, x])
        rows = pa.table({n: pa.array(np.concatenate(c) if c else [], pa.float64() if n == "dense" else pa.int64()) for n, c in out.items()})
        seen = pa.table({"query_id": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "dense": pa.nulls(1, pa.float64()), "n": pa.array([compared])})
        return pa.concat_tables([rows.append_column("n", pa.nulls(len(rows), pa.int64())), seen])

    both = (x.repartition(tasks, *group).groupBy(*group) for x in (left, right))  # a task's memory is that of few groups, however many there are
    return next(both).cogroup(next(both)).applyInArrow(best, "query_id long, doc_id long, dense double, n long")
