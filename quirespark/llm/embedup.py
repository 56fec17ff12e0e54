"""Embedding near-dedup: all pairs of a cosine of 0.9 or more, by dual traversal of cover trees.

Vectors become unit vectors, on which a cosine of c is a distance of sqrt(2 - 2c). Equal vectors are one point
with a multiplicity. Points are dealt by space: pivots, chosen far apart from a bounded sample, draw cells around
them, and a cell above the size of ``BLOCK`` is dealt into blocks by hash. A point goes to the tasks of its own
cell and to those of each cell that it can have a link in: the ball around a cell's points and the plane halfway
between two pivots bound that from below. So cells that lie apart never meet, and each point is in the tasks of few
cells, unless points are alike far from each other, as random vectors of many dimensions are; then no bound can
prune and every pair of blocks has to meet.

A block's cover tree has levels of halving radii: the centres of a level are further apart than its radius, cover all
members within it, and hold the centre of the level above; a node knows the greatest distance of its members. The
first level is made once for each block and travels with its points; deeper ones are made where a traversal gets to
them. A traversal pairs the nodes of two trees, level by level. A pair is pruned if its centres are further apart
than the threshold and both covering radii together, counted as a whole if all its members must be within the
threshold, and else expanded, down to nodes of a few points, which are compared point by point. Cosines are screened
in single precision, with a margin above its error, and decided in double precision. A tight group is thus one step,
whatever its size. A task returns a count of links per point and the edges of a spanning forest, so its output is in
proportion to its input.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm.common import measured, settled, table
from quirespark.llm.graph import components

COSINE = 0.9
#: Components of the vectors of a block (8 MB as doubles); a task has two blocks.
BLOCK = 1 << 20
#: Vectors that pivots are chosen from (those of the least hashes), and pivots of a length of vectors.
SAMPLE, PIVOTS = 4096, 256
#: Members of a node that has no children; rows of a matrix of cosines at a time, and pairs whose cosines are made singly.
LEAF = 32
TILE = 512
BATCH = 1 << 20
#: Cosines this close to the threshold are looked at again; the error of those in single precision is below ``ROUGH``.
CLOSE = 1e-9
ROUGH = 1e-4


def unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, so that no square is lost, and rows of length one."""
    if not raw.size:
        return raw, raw
    scaled = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1, keepdims=True))[1])
    return scaled, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def net(points: np.ndarray, level: float) -> np.ndarray:
    """For each point the position of its centre; centres, the first point among them, are further than ``level`` apart
    and all points are within it."""
    rough, least = points.astype(np.float32), 1 - level * level / 2
    of, centres = np.full(len(points), -1), np.zeros(0, np.int64)
    for at in range(0, len(points), TILE):
        tile = np.arange(at, min(at + TILE, len(points)))
        if len(centres):
            near = rough[tile] @ rough[centres].T
            best = near.argmax(axis=1)
            there = near[np.arange(len(tile)), best] >= least + ROUGH  # surely within
            of[tile[there]] = centres[best[there]]
            tile = tile[~there]
        within = rough[tile] @ rough[tile].T >= least + ROUGH
        free, new = np.ones(len(tile), bool), []
        for k in range(len(tile)):
            if free[k]:
                own = free & within[k]
                of[tile[own]] = of[tile[k]] = tile[k]
                free[k] = False
                free &= ~own
                new.append(tile[k])
        centres = np.concatenate([centres, np.array(new, np.int64)])
    return of


def next_level(points: np.ndarray, radius: float, level: float, reach: float) -> tuple[np.ndarray, float]:
    """The centre of each point on the next level that parts the points, and the level.

    Levels that would have one node are passed over, and so are those above the reach of links on which most points are
    nodes of their own: their few groups are loose and prune nothing.
    """
    while level >= radius:
        level /= 2
    of = net(points, level)
    while level > 1.5 * reach and 2 * (of == np.arange(len(of))).sum() > len(of):
        level /= 2
        of = net(points, level)
    return of, level


class Tree:
    """A cover tree over the points ``own``, as arrays by node.

    The members of node k are ``order[start[k] : end[k]]`` and ``centre[k]`` is one of them; ``radius`` is their greatest
    distance from it, and the nodes of the next level are ``kid[k]`` to ``kid[k] + kids[k]`` - 1, none for a leaf, of
    which the first ``singles[k]`` have one point.
    ``top`` has the groups of the first level, if they are known.
    """

    def __init__(self, points: np.ndarray, own: np.ndarray, reach: float, top: np.ndarray | None = None):
        self.order = own.copy()
        self.start, self.end, self.kid, self.kids, self.singles = ([x] for x in (0, len(own), 0, 0, 0))
        self.radius, self.centre = [self._radii(points, np.zeros(1, np.int64), len(own))[0]], [int(own[0])]
        todo = [(0, 2.0)]
        while todo:
            k, level = todo.pop()
            a, z = self.start[k], self.end[k]
            if z - a <= LEAF or self.radius[k] <= CLOSE:
                continue
            if top is not None and top.any():
                of = top
            else:
                of, level = next_level(points[self.order[a:z]], self.radius[k], level, reach)
            top = None
            more = np.bincount(of, minlength=len(of))[of] > 1
            inner = np.lexsort((np.arange(len(of)) != of, of, more))  # centres come first in their groups
            self.order[a:z] = self.order[a:z][inner]
            cuts = np.flatnonzero(np.diff(of[inner], prepend=-1))
            if len(cuts) < 2:
                continue
            self.kid[k], self.kids[k], self.singles[k] = len(self.start), len(cuts), int((~more).sum())
            radii = self._radii(points, a + cuts, z)
            self.centre += self.order[a + cuts].tolist()
            todo += [(len(self.start) + i, level / 2) for i in np.flatnonzero(np.diff(cuts, append=z - a) > LEAF).tolist()]
            self.start += (a + cuts).tolist()
            self.end += [*(a + cuts[1:]).tolist(), z]
            self.radius += radii.tolist()
            for grown in (self.kid, self.kids, self.singles):
                grown += [0] * len(cuts)
        self.start, self.end, self.kid, self.kids, self.singles = (np.array(x, np.int64) for x in (self.start, self.end, self.kid, self.kids, self.singles))
        self.radius, self.centre, self.size = np.array(self.radius), np.array(self.centre), self.end - self.start

    def _radii(self, points: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        members = points[self.order[starts[0] : end]]
        sizes = np.diff(starts, append=end)
        centres = np.repeat(points[self.order[starts]], sizes, axis=0)
        return np.maximum.reduceat(np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", members, centres), 0)), starts - starts[0])


def _crossed(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a number from [a, a + n) and one from [b, b + m), row after row, and the row of each pair."""
    sizes = n * m
    row = np.repeat(np.arange(len(a)), sizes)
    at = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    return a[row] + at // m[row], b[row] + at % m[row], row


class Links:
    """Counts of links and a spanning forest, over ``raw`` points that stand for ``weights`` equal vectors each.

    ``seen`` has how many pairs of points were counted as a whole and how many compared; the others were pruned.
    """

    def __init__(self, raw: np.ndarray, weights: np.ndarray, least: float):
        self.raw, self.points = unit(raw)
        self.rough = self.points.astype(np.float32)
        self.weights, self.least = weights, least
        self.reach = math.sqrt(max(2 - 2 * least, 0.0))
        self.counts = np.zeros(len(raw), np.int64)
        self.root = np.arange(len(raw))
        self.edges: list[tuple[int, int]] = []
        self.seen = {"whole": 0, "compared": 0}

    def tree(self, own: np.ndarray, top: np.ndarray | None = None) -> Tree:
        return Tree(self.points, own, self.reach, top)

    def walk(self, a: Tree, b: Tree) -> None:
        """Finds all links of the points of a with those of b; within one tree if that is a itself."""
        todo = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        if not (len(a.order) and len(b.order)):
            return
        while todo:
            x, y = todo.pop()
            leaf = (a.kids[x] == 0) & (b.kids[y] == 0)
            self._members(a, b, x[leaf], y[leaf])
            x, y = x[~leaf], y[~leaf]
            # A node without children stands for itself on the next level.
            ax, nx = np.where(a.kids[x] > 0, a.kid[x], x), np.maximum(a.kids[x], 1)
            by, ny = np.where(b.kids[y] > 0, b.kid[y], y), np.maximum(b.kids[y], 1)
            large = nx * ny > TILE
            for p, q, own, other in zip(x[large].tolist(), y[large].tolist(), *((t.kids[v[large]] > 0).tolist() for t, v in ((a, x), (b, y))), strict=True):
                # Single points are apart from other nodes, as their bound is one number.
                for i, alone in self._kids(a, p, own):
                    for j, single in self._kids(b, q, other):
                        ordered = a is b and p == q and single == alone
                        if a is b and p == q and single and not alone:
                            continue  # the same pairs as the other way round
                        columns = self.rough[b.centre[j]]
                        for at in range(0, len(i), TILE):
                            u, v = i[at : at + TILE], j[at if ordered else 0 :]
                            cosine = self.rough[a.centre[u]] @ columns[at if ordered else 0 :].T
                            radii = np.float32(0) if alone and single else a.radius[u, None].astype(np.float32) + b.radius[v].astype(np.float32)
                            row, column = np.nonzero(cosine >= self._bound(radii))
                            if ordered:
                                keep = column >= row
                                row, column = row[keep], column[keep]
                            todo.append(self._decided(a, b, u[row], v[column], cosine[row, column]))
            rows = np.flatnonzero(~large)
            held = np.cumsum((nx * ny)[rows]) // BATCH
            for part in np.split(rows, np.flatnonzero(np.diff(held)) + 1) if len(rows) else []:
                i, j, row = _crossed(ax[part], nx[part], by[part], ny[part])
                if a is b:
                    keep = (ax[part] != by[part])[row] | (i <= j)
                    i, j = i[keep], j[keep]
                cosine = self._dots(a.centre[i], b.centre[j])
                open_ = cosine >= self._bound(a.radius[i] + b.radius[j])
                todo.append(self._decided(a, b, i[open_], j[open_], cosine[open_]))
            todo = [t for t in todo if len(t[0])]

    def _kids(self, tree: Tree, k: int, own: bool) -> list[tuple[np.ndarray, bool]]:
        """The nodes that stand for node k on the next level, single points apart from others."""
        if not own:
            return [(np.array([k]), bool(tree.size[k] == 1))]
        cut, first = tree.singles[k], tree.kid[k]
        parts = [(np.arange(first, first + cut), True), (np.arange(first + cut, first + tree.kids[k]), False)]
        return [x for x in parts if len(x[0])]

    def _bound(self, radii: np.ndarray) -> np.ndarray:
        """The least cosine that centres have, if the members of their nodes can be within reach."""
        return (1 - ROUGH) - 0.5 * np.minimum(radii + radii.dtype.type(self.reach), 2) ** 2

    def _dots(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [np.einsum("ij,ij->i", self.rough[i[at : at + TILE * 64]], self.rough[j[at : at + TILE * 64]]) for at in range(0, len(i), TILE * 64)]
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def _decided(self, a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Settles pairs of nodes that are single points or all within reach; the others."""
        same = (i == j) if a is b else np.zeros(len(i), bool)
        single = (a.size[i] == 1) & (b.size[j] == 1)
        some = single & ~same
        self.seen["compared"] += int(some.sum())
        self._pairs(a.centre[i[some]], b.centre[j[some]], cosine[some])
        radii = a.radius[i] + b.radius[j]
        whole = (radii < self.reach - ROUGH) & (cosine >= 1 + ROUGH - 0.5 * (self.reach - radii) ** 2) & ~single
        whole = np.where(same, (radii <= self.reach - ROUGH) & ~single, whole)
        for x, y, own in zip(i[whole].tolist(), j[whole].tolist(), same[whole].tolist(), strict=True):
            self._all(a.order[a.start[x] : a.end[x]], None if own else b.order[b.start[y] : b.end[y]])
        rest = ~(single | whole)
        return i[rest], j[rest]

    def _all(self, a: np.ndarray, b: np.ndarray | None) -> None:
        if b is None:
            self.counts[a] += self.weights[a].sum() - self.weights[a]
            self.seen["whole"] += len(a) * (len(a) - 1) // 2
            b = a[1:]
        else:
            self.counts[a] += self.weights[b].sum()
            self.counts[b] += self.weights[a].sum()
            self.seen["whole"] += len(a) * len(b)
            b = np.concatenate([a[1:], b])
        self._join(int(a[0]), b)

    def _members(self, a: Tree, b: Tree, x: np.ndarray, y: np.ndarray) -> None:
        """Compares all members of each leaf x of a with those of leaf y of b."""
        large = a.size[x] * b.size[y] > TILE
        for p, q in zip(x[large].tolist(), y[large].tolist(), strict=True):
            left, right = a.order[a.start[p] : a.end[p]], b.order[b.start[q] : b.end[q]]
            for at in range(0, len(left), TILE):
                cosine = self.rough[left[at : at + TILE]] @ self.rough[right].T
                if a is b and p == q:
                    cosine[np.arange(len(right)) <= np.arange(at, at + len(cosine))[:, None]] = -2
                i, j = np.nonzero(cosine >= self.least - ROUGH)
                self._pairs(left[i + at], right[j], cosine[i, j])
            self.seen["compared"] += len(left) * (len(left) - 1) // 2 if a is b and p == q else len(left) * len(right)
        rows = np.flatnonzero(~large)
        held = np.cumsum((a.size[x] * b.size[y])[rows]) // BATCH
        for part in np.split(rows, np.flatnonzero(np.diff(held)) + 1) if len(rows) else []:
            i, j, row = _crossed(a.start[x[part]], a.size[x[part]], b.start[y[part]], b.size[y[part]])
            if a is b:
                keep = (x[part] != y[part])[row] | (i < j)
                i, j = i[keep], j[keep]
            self.seen["compared"] += len(i)
            cosine = self._dots(a.order[i], b.order[j])
            near = cosine >= self.least - ROUGH
            self._pairs(a.order[i[near]], b.order[j[near]], cosine[near])

    def _pairs(self, i: np.ndarray, j: np.ndarray, rough: np.ndarray) -> None:
        """Decides pairs of different points, each given once; near the threshold in double precision."""
        good = rough >= self.least + ROUGH
        at = np.flatnonzero(~good & (rough >= self.least - ROUGH))
        cosine = np.einsum("ij,ij->i", self.points[i[at]], self.points[j[at]])
        good[at] = cosine >= self.least
        for k in at[np.abs(cosine - self.least) < CLOSE].tolist():
            good[k] = self._cosine(int(i[k]), int(j[k])) >= self.least
        i, j = i[good], j[good]
        if not len(i):
            return
        for x, y in ((i, j), (j, i)):
            self.counts += np.bincount(x, weights=self.weights[y], minlength=len(self.counts)).astype(np.int64)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        edges = np.flatnonzero(np.diff(i, prepend=-1))
        for group, first in zip(np.split(j, edges[1:]), i[edges].tolist(), strict=True):
            self._join(first, group)

    def _cosine(self, i: int, j: int) -> float:
        x, y = self.raw[i].tolist(), self.raw[j].tolist()
        dot = lambda p, q: math.fsum(u * v for u, v in zip(p, q, strict=True))
        return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = int(self.root[i])
        return i

    def _join(self, i: int, others: np.ndarray) -> None:
        top = self._find(i)
        for j in others[self.root[others] != top].tolist():
            other = self._find(j)
            if other != top:
                self.root[other] = top
                self.edges.append((i, j))
            self.root[j] = top


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of doubles as bytes, as many in each row, as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


POINT = "node long, copies long, vector binary, length int, cell int, visits array<int>"


class Cells:
    """Pivots by length of vector, and which cells a point can have links in."""

    def __init__(self, sample: list[list[float]], most: int, least: float):
        self.pivots: dict[int, np.ndarray] = {}
        self.reach = math.sqrt(max(2 - 2 * least, 0.0))
        for length in {len(v) for v in sample}:
            points = unit(np.array([v for v in sample if len(v) == length]))[1]
            chosen, nearest = [0], _distances(points, points[:1])[:, 0]
            while len(chosen) < most and nearest.max() > CLOSE:
                chosen.append(int(nearest.argmax()))
                nearest = np.minimum(nearest, _distances(points, points[chosen[-1:]])[:, 0])
            self.pivots[length] = points[chosen]

    def deal(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """``batch`` (node, copies, vector) with the cell of each point, and all cells that it may have links in."""
        lists = batch.column(2)
        lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        raw = pa.array([values[a:z].tobytes() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
        cell, visits = np.zeros(len(lengths), np.int32), [[0] for _ in lengths]
        for length in np.unique(lengths).tolist():
            if (pivots := self.pivots.get(length)) is None:
                continue  # as one cell
            at = np.flatnonzero(lengths == length)
            points = unit(_vectors(raw.take(pa.array(at))))[1]
            cosine = points @ pivots.T
            own = cosine.argmax(axis=1)
            # Half the difference of squared distances, over the distance of the pivots, is how far the plane between them is.
            gap = _distances(pivots, pivots)
            apart = cosine[np.arange(len(at)), own][:, None] - cosine
            near = apart <= (self.reach + 1e-6) * gap[own] + 1e-9
            cell[at] = own
            for k, row in zip(at.tolist(), near, strict=True):
                visits[k] = np.flatnonzero(row).tolist()
        names = [x.split()[0] for x in POINT.split(", ")]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], raw, pa.array(lengths, pa.int32()), pa.array(cell), pa.array(visits, pa.list_(pa.int32()))], names=names)


def _first_level(block: pa.Table, least: float) -> pa.Table:
    """The points of a block with ``top``, the node that is the centre of theirs on the first level of the block's tree."""
    node = block["node"].to_numpy()
    order = np.argsort(node)
    points = unit(_vectors(block["vector"]))[1][order]
    radius = float(_distances(points, points[:1]).max())
    of = next_level(points, radius, 2.0, math.sqrt(max(2 - 2 * least, 0.0)))[0] if radius > CLOSE else np.zeros(len(node), np.int64)
    top = np.empty(len(node), np.int64)
    top[order] = node[order][of]
    return block.append_column("top", pa.array(top))


def _linked(task: pa.Table, least: float) -> pa.Table:
    """Link counts (n > 0, other null) and forest edges (n = 0) of one pair of blocks."""
    links, ids = Links(_vectors(task["vector"]), task["copies"].to_numpy(), least), task["node"].to_numpy()
    left, top = task["side"].to_numpy() == 0, task["top"].to_numpy()
    trees = []
    for side in (left, ~left):
        own = np.flatnonzero(side)
        # The centre of each group comes first; if only some of a block's points are here, the least that is.
        own = own[np.lexsort((ids[own], top[own] != ids[own], top[own]))]
        groups = np.unique(top[own], return_index=True, return_inverse=True)
        trees.append(links.tree(own, groups[1][groups[2]]) if len(own) else None)
    links.walk(trees[0], trees[1] if (~left).any() else trees[0])
    some = np.flatnonzero(links.counts)
    a, b = (np.array([e[k] for e in links.edges], np.int64) for k in (0, 1))
    other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[b], pa.int64())])
    return pa.table({"node": pa.array(np.concatenate([ids[some], ids[a]]), pa.int64()), "other": other, "n": pa.array(np.concatenate([links.counts[some], np.zeros(len(a), np.int64)]), pa.int64())})


def _tasks(points: DataFrame, block: int, least: float) -> DataFrame:
    """Points with their tasks (length, c, i, d, j): a pair of blocks, each a cell and a number; ``side`` 1 is the second."""
    sized = points.groupBy("length", "cell").agg(F.ceil(F.count("*") * F.col("length") / F.lit(block)).cast("int").alias("blocks"))
    placed = points.join(sized, ["length", "cell"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", top long"
    placed = placed.groupBy("length", "cell", "i").applyInArrow(lambda t: _first_level(t, least), schema)
    visits = placed.withColumn("d", F.explode("visits")).drop("visits").join(sized.withColumnRenamed("cell", "d"), ["length", "d"])
    j = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = visits.withColumn("j", j)
    own, other = F.struct(F.col("cell").alias("c"), F.col("i").alias("k")), F.struct(F.col("d").alias("c"), F.col("j").alias("k"))
    pair: Column = F.struct(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"))
    return met.select("length", pair.alias("pair"), "node", "copies", "vector", "top", (own > other).cast("int").alias("side"))


def cosine_classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id and kept.

    Two vectors link if their cosine, in double precision, is ``least`` or more, whatever their lengths. A vector
    that is null, empty, zero or has a null or non-finite component links with nothing, and vectors of different
    dimensions never link. n_links counts the other rows it links with; component_id is the least id that links lead
    to. A row without an id counts for others' links only if it equals a vector that has one, and gets null ids; rows
    that share an id are one document, which is in the class of each of its vectors. Blocks have fewer vectors the
    longer those are. Other columns play no part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(embedding), lambda x: x.cast("double")).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0))))
    keyed = rows.withColumns({"key_a": F.xxhash64("vector"), "key_b": F.xxhash64(F.lit(1), "vector")})
    usable_rows = keyed.filter("vector IS NOT NULL")
    # Aggregates are settled before they are joined: a join splits a hot key only where nothing stands between it and the shuffle.
    points = settled(usable_rows.groupBy("key_a", "key_b").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).filter("node IS NOT NULL"))
    members = settled(keyed.drop("vector").join(points, ["key_a", "key_b"], "left").withColumn("node", F.when(F.col("key_a").isNotNull(), F.col("node"))))
    chosen, seen = measured(usable_rows.join(points, ["key_a", "key_b"]).filter("vec_id = node").dropDuplicates(["key_a", "key_b"]).select("node", "copies", "vector"), values=F.sum(F.size("vector")))
    sample = [list(r["vector"]) for r in chosen.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    cells = Cells(sample, min(PIVOTS, math.ceil((seen["values"] or 0) / block)), least)
    dealt = chosen.mapInArrow(lambda batches: map(cells.deal, batches), POINT)
    found = settled(_tasks(dealt, block, least).groupBy("length", "pair").applyInArrow(lambda t: _linked(t, least), "node long, other long, n long"))
    counts = settled(found.groupBy("node").agg(F.sum("n").alias("n")))
    classes = components(found.filter("other IS NOT NULL"), "node", "other")
    out = members.join(counts, "node", "left").join(classes, "node", "left")
    links = F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    component = F.coalesce("component", "node", "vec_id")
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_classes(table(spark, sf_dir, "embeddings"))
