"""Mergeable quantile summaries by buffers that are collapsed (Manku, Rajagopalan, Lindsay), and what their answers are worth.

Values are counted by group, batch and value, and dealt by ranges of (group, value): small groups lie in one part, a
large one in as many as it needs, and no value's repeats travel. A part of a group fills buffers of ``BUFFER`` weighted
points; ``BUFFERS`` of one level are collapsed into one of the next, which keeps evenly spaced ranks: of a
span of even weight the lower and the upper middle by turns, so that the order of rows alone decides. Parts are merged
``FAN_IN`` at a time in as many rounds as their number needs, then pruned to the point budget. The summary of a whole
group is merged from those of its batches alone. Each collapse adds half of its largest span to the summary's error.

Ranks are exact counts: each part of a group counts its own values below an answer, which has been joined to all parts
of the group by (group, part), and prefix sums over the parts, one row each, say which part holds a rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm.common import measured, settled, table

BUDGET = 400
BUFFER = 1024
BUFFERS = 8
FAN_IN = 64
#: The batch that stands for all of a group.
WHOLE = -1
#: Below all values.
_LEAST = -(1 << 62)

Points = tuple[np.ndarray, np.ndarray]


def collapsed(values: np.ndarray, weights: np.ndarray, most: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``most`` weighted points for many, with the weight of all, and by how much that may shift a rank.

    Equal values become one point, and if that is enough nothing is lost. The two least and the two greatest values
    stay, with weight 0 if no span fell on them.
    """
    order = np.argsort(values, kind="stable")
    values, first = np.unique(values[order], return_index=True)
    weights = np.add.reduceat(weights[order], first) if len(first) else weights
    if len(values) <= most:
        return values, weights, 0
    ends = np.cumsum(weights)
    n, spans = int(ends[-1]), most - 4
    edges = np.array([j * n // spans for j in range(spans + 1)], np.int64)
    sizes = np.diff(edges)
    picked = np.searchsorted(ends, edges[:-1] + (sizes + 1 + turn) // 2)
    new = np.zeros(len(values), np.int64)
    np.add.at(new, picked, sizes)
    kept = new > 0
    kept[[0, 1, -2, -1]] = True
    return values[kept], new[kept], (int(sizes.max()) + 2) // 2


class Summary:
    """The buffers of one group, by level."""

    def __init__(self):
        self.levels: dict[int, list[Points]] = {}
        self.error = self.turn = 0

    def add(self, values: np.ndarray, weights: np.ndarray, level: int = 0, error: int = 0) -> None:
        """A buffer; small ones of a level fill one together."""
        self.error += error
        own = self.levels.setdefault(level, [])
        if own and len(own[-1][0]) + len(values) <= BUFFER:
            own[-1] = tuple(map(np.concatenate, zip(own[-1], (values, weights), strict=True)))
        else:
            own.append((values, weights))
        if len(own) == BUFFERS:
            new = self._collapse(self.levels.pop(level), BUFFER)
            self.add(*new, level + 1)

    def feed(self, values: np.ndarray, weights: np.ndarray) -> None:
        """Points of any number, as buffers of level 0."""
        for at in range(0, len(values), BUFFER):
            self.add(values[at : at + BUFFER], weights[at : at + BUFFER])

    def _collapse(self, buffers: list[Points], most: int) -> Points:
        values, weights, error = collapsed(*map(np.concatenate, zip(*buffers, strict=True)), most, self.turn)
        self.error += error
        self.turn ^= error > 0
        return values, weights

    def pruned(self, budget: int) -> Points:
        return self._collapse([b for level in self.levels.values() for b in level], budget)


def _runs(b: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where rows begin whose first ``keys`` columns differ from those before, and the end."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for c in b.columns[:keys]:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(b.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), b.num_rows)


def _key(b: pa.RecordBatch, keys: int, row: int) -> tuple:
    return tuple(c[row].as_py() for c in b.columns[:keys])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), np.concatenate([*arrays, np.zeros(0, np.int64)]))


def _batch(schema: pa.Schema, keys: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of key, numbers and arrays, as ``schema`` has them."""
    columns = [*zip(*(r[0] for r in rows), strict=True), *zip(*(r[1:] for r in rows), strict=True)]
    made = (_lists(list(c)) if pa.types.is_list(f.type) and all(x is not None for x in c) else pa.array([None if x is None else x for x in c], f.type) for c, f in zip(columns, schema, strict=True))
    return pa.RecordBatch.from_arrays([m.cast(f.type) for m, f in zip(made, schema, strict=True)], schema=schema)


def _buffers(own: Summary) -> Iterator[tuple]:
    number = count()
    for level in sorted(own.levels):
        for values, weights in own.levels[level]:
            at = next(number)
            yield at, level, values, weights, 0 if at else own.error


def _started(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Buffers of each run of rows (key columns, part, x, n) sorted by key and x; a run is one group's in one part."""
    schema, open_key, own = None, None, Summary()
    for b in batches:
        schema = schema or pa.schema([*(b.schema.field(i) for i in range(keys + 1)), *_BUFFER])
        runs, x, n = _runs(b, keys), b.column(keys + 1).to_numpy(), b.column(keys + 2).to_numpy()
        rows: list[tuple] = []
        part = b.column(keys)[0].as_py() if b.num_rows else 0
        low = 0
        if b.num_rows and open_key == _key(b, keys, 0):
            own.feed(x[: runs[1]], n[: runs[1]])
            low = 1
        if b.num_rows and (low == 0 or len(runs) > 2):
            if open_key is not None:
                rows += [(open_key, part, *r) for r in _buffers(own)]
            whole = runs[low:-1]  # all but the last run end in this batch
            small = np.flatnonzero(np.diff(whole) <= BUFFER)
            yield _sliced(b, keys, schema, whole[small], whole[small + 1] if len(small) else small, x, n)
            for i in np.flatnonzero(np.diff(whole) > BUFFER):
                own = Summary()
                own.feed(x[whole[i] : whole[i + 1]], n[whole[i] : whole[i + 1]])
                rows += [(_key(b, keys, int(whole[i])), part, *r) for r in _buffers(own)]
            open_key, own = _key(b, keys, int(runs[-2])), Summary()
            own.feed(x[runs[-2] :], n[runs[-2] :])
        if rows:
            yield _batch(schema, keys, rows)
        last_part = part
    if open_key is not None:
        yield _batch(schema, keys, [(open_key, last_part, *r) for r in _buffers(own)])


def _sliced(b: pa.RecordBatch, keys: int, schema: pa.Schema, starts: np.ndarray, ends: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Whole small runs, a buffer each, without a loop."""
    sizes = (ends - starts).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    rows = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    zero = np.zeros(len(starts), np.int64)
    lists = (pa.ListArray.from_arrays(offsets, v[rows]) for v in (x, n))
    made = [*(c.take(pa.array(starts)) for c in b.columns[: keys + 1]), pa.array(zero), pa.array(zero), *lists, pa.array(zero)]
    return pa.RecordBatch.from_arrays([m.cast(f.type) for m, f in zip(made, schema, strict=True)], schema=schema)


_BUFFER = [pa.field("seq", pa.int64()), pa.field("level", pa.int64()), pa.field("xs", pa.list_(pa.int64())), pa.field("ws", pa.list_(pa.int64())), pa.field("error", pa.int64())]
_BUFFER_SQL = "part long, seq long, level long, xs array<long>, ws array<long>, error long"
_FINAL = [pa.field("n", pa.int64()), pa.field("xs", pa.list_(pa.int64())), pa.field("ws", pa.list_(pa.int64())), pa.field("error", pa.int64()), pa.field("answers", pa.list_(pa.int64()))]
_FINAL_SQL = "n long, xs array<long>, ws array<long>, error long, answers array<long>"


def _merged(batches: Iterator[pa.RecordBatch], keys: int, budget: int | None, quantiles: int) -> Iterator[pa.RecordBatch]:
    """Rows (key columns, part, seq, level, xs, ws, error), those of a key together and in order, merged: into buffers of
    the part, or if there is a budget into the summary of the key with its answers."""
    schema, open_key, own, part, rows = None, None, Summary(), 0, []

    def closed() -> list[tuple]:
        if budget is None:
            return [(open_key, part, *r) for r in _buffers(own)]
        xs, ws = own.pruned(budget)
        ends = np.cumsum(ws)
        n = int(ends[-1])
        targets = [-(-i * n // quantiles) for i in range(1, quantiles)]
        return [(open_key, n, xs, ws, own.error, xs[np.searchsorted(ends, targets)])]

    for b in batches:
        schema = schema or pa.schema([*(b.schema.field(i) for i in range(keys + (budget is None))), *(_BUFFER if budget is None else _FINAL)])
        columns = [c.to_pylist() for c in b.columns[:keys]]
        parts, levels, errors = (b.column(keys + i).to_numpy() for i in (0, 2, 5))
        xs, ws = b.column(keys + 3), b.column(keys + 4)
        at, x, w = xs.offsets.to_numpy(), xs.values.to_numpy(), ws.values.to_numpy()
        w_at = ws.offsets.to_numpy()
        for r, key in enumerate(zip(*columns, strict=True)):
            if key != open_key:
                if open_key is not None:
                    rows += closed()
                    if len(rows) >= 5000:
                        yield _batch(schema, keys, rows)
                        rows = []
                open_key, own, part = key, Summary(), int(parts[r])
            own.add(x[at[r] : at[r + 1]], w[w_at[r] : w_at[r + 1]], int(levels[r]), int(errors[r]))
    if open_key is not None:
        rows += closed()
    if rows:
        yield _batch(schema, keys, rows)


def _gathered(frame: DataFrame, names: list[str], parts: int, budget: int, quantiles: int) -> DataFrame:
    """Summaries of each key from its buffers, ``FAN_IN`` parts at a time."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*names).schema)
    while True:
        last = parts <= FAN_IN
        group = [*names] if last else [*names, "_up"]
        up = frame if last else frame.withColumn("_up", F.expr(f"part div {FAN_IN}"))
        sent = up.repartition(*group).sortWithinPartitions(*group, "part", "seq")
        if last:
            return sent.mapInArrow(partial(_merged, keys=len(names), budget=budget, quantiles=quantiles), f"{kinds}, {_FINAL_SQL}")
        sent = sent.select(*group, F.col("_up").alias("part"), "seq", "level", "xs", "ws", "error")
        frame = sent.mapInArrow(partial(_merged, keys=len(group), budget=None, quantiles=quantiles), f"{kinds}, _up long, {_BUFFER_SQL}").drop("_up")
        parts = -(-parts // FAN_IN)


class Summaries(NamedTuple):
    """``counts`` (keys, batch, x, n, part) of all values; of each batch and of each group (batch ``WHOLE``) its ``points``
    (keys, batch, n, xs, ws, error, answers)."""

    counts: DataFrame
    points: DataFrame
    keys: list[str]
    quantiles: int


def summaries(rows: DataFrame, keys: list[str], batch: str = "batch", x: str = "x", weight: str | None = None, budget: int = BUDGET, quantiles: int = 10) -> Summaries:
    """Summaries of the integers ``x`` of each group and batch, and of each group by merging those.

    Each has at most ``budget`` (8 or more) points, all values if they are no more, else at least four, the extremes
    among them; its error bounds by how much a rank may be off. ``weight`` is a column of how often a row counts. Rows
    with a null key, batch, value or weight, or a weight below 1, are left out; repeated rows count; batches are
    integers from 0 on. Keys are called ``keys`` in the result, other columns are not read.
    """
    n = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    own = rows.select(*(F.col(k).alias(k) for k in keys), F.col(batch).cast("int").alias("batch"), F.col(x).cast("long").alias("x"), n.alias("n"))
    own = own.dropna().filter("n > 0").groupBy(*keys, "batch", "x").agg(F.sum("n").alias("n"))
    ranges = own.repartitionByRange(*keys, "x").sortWithinPartitions(*keys, "batch", "x")
    counts, seen = measured(ranges.withColumn("part", F.spark_partition_id().cast("long")), batches=F.max("batch"))
    names = [*keys, "batch"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*names).schema)
    first = counts.select(*names, "part", "x", "n").mapInArrow(partial(_started, keys=len(names)), f"{kinds}, {_BUFFER_SQL}")
    batches = settled(_gathered(first, names, counts.rdd.getNumPartitions(), budget, quantiles))
    again = batches.select(*keys, F.col("batch").cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("level"), "xs", "ws", "error")
    whole = _gathered(again, keys, (seen["batches"] or 0) + 1, budget, quantiles).withColumn("batch", F.lit(WHOLE))
    return Summaries(counts, batches.unionByName(settled(whole)), keys, quantiles)


def verified(own: Summaries, least: int) -> DataFrame:
    """(keys, batch, i, n, target, exact_x, points, answer, n_below, n_upto) for every summary of ``least`` rows or more and
    every inner quantile i: the value of exactly this rank, and how many values lie below and up to the answer."""
    keys, q = own.keys, own.quantiles
    zero = F.lit(0).cast("long")
    asked = own.points.filter(F.col("n") >= least).select(*keys, "batch", "n", F.size("xs").cast("long").alias("points"), F.posexplode("answers").alias("i", "answer"))
    asked = asked.withColumn("i", F.col("i") + 1).withColumn("target", F.expr(f"(i * n + {q - 1}) div {q}"))

    # a row for each part of a group: what lies in the parts before it, and how many values there are
    held = own.counts.groupBy(*keys, "batch", "part").agg(F.sum("n").alias("held"))
    groups = held.groupBy(*keys, "part").agg(F.sum("held").alias("held")).withColumn("batch", F.lit(WHOLE))
    by = Window.partitionBy(*keys, "batch")
    before = F.coalesce(F.sum("held").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), zero)
    edges = held.unionByName(groups.select(held.columns)).select(*keys, "batch", "part", before.alias("base"), F.sum("held").over(by).alias("all"))

    mark = lambda **c: [c.get(k, zero).alias(k) for k in ("x", "n", "base", "all")] + [c.get("i", F.lit(None).cast("int")).alias("i")]
    row = [*keys, "part", "batch"]
    rows = own.counts.select(*row, *mark(x=F.col("x"), n=F.col("n")))
    rows = rows.unionByName(edges.filter(F.col("all") >= least).select(*row, *mark(x=F.lit(_LEAST), base=F.col("base"), all=F.col("all"))))
    asking = asked.select(*keys, "batch", "i", "answer").join(groups.select(*keys, "part"), keys)
    rows = rows.unionByName(asking.select(*row, *mark(x=F.col("answer"), i=F.col("i"))))

    def level(window: Window, mine: Column) -> Column:
        upto, below = window.rangeBetween(Window.unboundedPreceding, Window.currentRow), window.rangeBetween(Window.unboundedPreceding, -1)
        total = lambda c, over: F.coalesce(F.sum(F.when(mine, F.col(c)).otherwise(zero)).over(over), zero)
        return F.struct(F.coalesce(F.sum("n").over(below), zero).alias("below"), F.sum("n").over(upto).alias("upto"), total("base", upto).alias("base"), total("all", upto).alias("all"))

    part = [*keys, "part"]
    one = level(Window.partitionBy(*part, "batch").orderBy("x"), F.lit(True))
    every = level(Window.partitionBy(*part).orderBy("x"), F.col("batch") == WHOLE)
    ranked = rows.withColumn("one", one).withColumn("every", every)

    own_level = F.when(F.col("batch") == WHOLE, F.col("every")).otherwise(F.col("one"))
    kept = F.struct(F.col("batch").alias("batch"), F.col("i").alias("i"), F.lit(None).cast("long").alias("exact_x"), own_level["below"].alias("below"), own_level["upto"].alias("upto"))

    def reached(batch: Column, at: Column) -> Column:
        """The quantiles whose rank lies at this value."""
        first, last = (F.expr(f"({at}.base + {at}.{c}) * {q} div {at}.all") for c in ("below", "upto"))
        there = (F.col(f"{at}.all") > 0) & (first < F.least(last, F.lit(q - 1)))
        hit = lambda i: F.struct(batch.alias("batch"), i.cast("int").alias("i"), F.col("x").alias("exact_x"), F.lit(None).cast("long").alias("below"), F.lit(None).cast("long").alias("upto"))
        return F.when(there, F.transform(F.sequence(first + 1, F.least(last, F.lit(q - 1).cast("long"))), hit)).otherwise(F.array())

    found = F.when(F.col("i").isNotNull(), F.array(kept)).when(F.col("n") > 0, F.concat(reached(F.col("batch"), "one"), reached(F.lit(WHOLE), "every"))).otherwise(F.array())
    found = ranked.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")
    found = found.groupBy(*keys, "batch", "i").agg(F.max("exact_x").alias("exact_x"), F.sum("below").alias("n_below"), F.sum("upto").alias("n_upto"))
    return asked.join(found, [*keys, "batch", "i"]).select(*keys, "batch", "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, grp, batch, x, n): both streams of the shop, counted where that spares a shuffle of rows."""
    batch = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(8)).cast("int")
    cents = lambda c: F.floor(F.lit(100) * F.col(c) + F.lit(0.5))
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e16)
    clicks = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("c")).select("click_id", "c.*")
    clicks = clicks.filter(F.col("client_id").isNotNull() & real("value")).select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), batch("click_id").alias("batch"), cents("value").alias("x"), F.lit(1).cast("long").alias("n"))
    lines = table(spark, sf_dir, "sale_lines").filter("item_id IS NOT NULL").groupBy("item_id", batch("vendor_id").alias("batch")).agg(F.count("*").alias("n"))
    items = table(spark, sf_dir, "items").filter(F.col("brand").isNotNull() & real("price")).select("item_id", "brand", "price")
    prices = lines.join(items, "item_id").select(F.lit("price").alias("stream"), F.col("brand").cast("string").alias("grp"), "batch", cents("price").alias("x"), "n")
    return clicks.unionByName(prices).withColumn("x", F.col("x") + 1000 * F.col("batch"))


def op13_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles of two streams of the shop; a null id is '' for its batch, and money that is no number is lacking."""
    out = verified(summaries(_streams(spark, sf_dir), ["stream", "grp"], weight="n", budget=20_000 // 50), least=20)
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= 50 * F.col("n"))
