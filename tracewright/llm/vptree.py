"""Nearest neighbours by inner product with vantage-point trees, one a shard.

Largest inner product becomes smallest Euclidean distance when every vector gets one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, and queries are scaled to norm M. Vectors are dealt to cells, each to its
nearest centre, and a cell that is larger than a shard is cut by a hash of values. A shard's tree is built once a pass: at
every node a vantage point, the median distance to it, the nearer half inside and the farther half outside, down
to leaves. Each row keeps its distances to all vantage points above it, and to some more at the root; each node keeps the
range of these. A query first searches its own cell. What it found there bounds how far it needs to look, so in a second
pass it goes only to cells that the triangle inequality, by the cells' centres and radii, doesn't rule out, and
there it prunes from the first node on. A cell, a subtree or a row of a leaf is left out for a query when the
triangle inequality puts it farther than the query's k-th neighbour so far, that distance divided by ``factor``: with
factor 1 the search is exact, beyond that it leaves out more. How far the factor may go depends on the vectors: unless it is
given, it is the largest of a few that on a bounded sample, against brute force, reach a recall. Scores are inner products of the original vectors in
double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, releasing, ship, table

SHARD_BYTES = 8 << 20  # of a shard's vectors in double precision: 16,384 rows of 64 components
QUERY_BATCH = 1024
LEAF = 128
START_LEAVES = 4  # leaves that a query visits before all others
ROOT_POINTS = 24  # vantage points of the root beside the splitting one
FACTORS = (3.5, 3.0, 2.5, 2.0, 1.5)  # tried in this order, then 1
FACTOR = FACTORS[0]
RECALL, TRIED = 0.95, 256  # of a sample's vectors as queries, to accept a factor
MOST_CELLS, CENTRE_BYTES = 4096, 16 << 20  # centres of the vectors of one length, and their bytes
SAMPLE_PER_CELL, SAMPLE_BYTES = 32, 64 << 20  # vectors drawn to place the centres; every vector is dealt to a cell
ROUNDS = 8  # in which the centres settle
MOST_LENGTHS = 4  # of vectors, the most frequent ones, that get several cells and a factor; all others are searched exactly
MOST_PARTS = 8192


class VantagePointTree:
    """Over the rows of a matrix of distinct finite vectors, searched by largest inner product."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, root_points: int = ROOT_POINTS, seed: int = 5):
        self.x, self.leaf, self.rng = x, leaf, np.random.default_rng(seed)
        self.visited = 0  # pairs of query and row whose inner product was computed
        self.scale = float(np.abs(x).max(initial=0)) or 1.0  # squares neither overflow nor vanish
        unit = x / self.scale
        norms = (unit * unit).sum(axis=1)
        self.top = float(np.sqrt(norms.max(initial=0)))
        self.lifted = np.column_stack([unit, np.sqrt(np.maximum(0, self.top**2 - norms))])
        self.slack = 4e-6 * self.top  # distances are kept in single precision
        self.homes = 0
        self.root_points = self.lifted[np.sort(self.rng.permutation(len(x))[:root_points])]
        self.root = self._build(np.arange(len(x)), self._far(self.lifted, self.root_points))

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all lifted vectors, which have norm ``top``."""
        return np.sqrt(np.maximum(0, 2 * self.top**2 - 2 * a @ b.T)).astype(np.float32)

    def _build(self, rows: np.ndarray, path: np.ndarray, home: int = -1) -> dict:
        if home < 0 and len(rows) <= START_LEAVES * self.leaf:
            home, self.homes = self.homes, self.homes + 1
        node = {"low": path.min(axis=0, initial=np.inf), "high": path.max(axis=0, initial=-np.inf), "home": home}
        if len(rows) <= self.leaf:
            return node | {"rows": rows, "path": np.ascontiguousarray(path.T)}
        vantage = self.lifted[rows[self.rng.integers(len(rows))]][None, :]
        d = self._far(self.lifted[rows], vantage)
        middle = np.median(d)
        inside = d[:, 0] <= middle
        if inside.all():  # most distances equal: halves of the rows
            inside = np.arange(len(rows)) % 2 == 0
        path = np.concatenate([path, d], axis=1)
        return node | {"vantage": vantage, "middle": middle, "parts": [self._build(rows[s], path[s], home) for s in (inside, ~inside)]}

    def search(self, q: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inner products, rows), k a query, largest first; row -1 where there are fewer.

        First each query goes down the nearer sides to its home, a subtree of a few leaves, then through all
        other parts of the tree, in which it is pruned by what it found so far. A query with a ``floor``, a score below
        which nothing is wanted (nan: none), is pruned by that from the start.
        """
        floor = np.full(len(q), np.nan) if floor is None else floor
        best, found = np.full((len(q), k), np.nan), np.full((len(q), k), -1, dtype=np.int64)  # nan sorts last
        largest = np.abs(q).max(axis=1, initial=0, keepdims=True)
        unit = q / np.where(largest > 0, largest, 1)
        norm = np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        lifted = np.column_stack([unit * (self.top / np.where(norm > 0, norm, 1)), np.zeros(len(q))])
        to_unit = self.top / np.where(norm > 0, norm, 1)[:, 0]  # of a product with the scaled query and rows
        reach, home = np.full(len(q), np.inf), np.full(len(q), -2)

        def narrow(active: np.ndarray, score: np.ndarray) -> None:
            with np.errstate(all="ignore"):
                last = np.fmax(score, floor[active]) / self.scale / largest[active, 0] * to_unit[active]
                far = np.sqrt(np.maximum(0, 2 * self.top**2 - 2 * last)) / factor + self.slack
            reach[active] = np.where(np.isfinite(last), far, np.inf)

        def visit(node: dict, active: np.ndarray, path: np.ndarray, first: bool) -> None:
            outside = np.maximum(node["low"] - path, path - node["high"]).max(axis=1, initial=-np.inf)
            keep = outside <= reach[active]
            if first and node["home"] >= 0:
                home[active] = node["home"]
            elif not first:
                keep &= home[active] != node["home"]
            active, path = active[keep], path[keep]
            if not len(active):
                return
            if "rows" in node:
                self._leaf(node, active, reach, path, q, best, found)
                narrow(active, best[active].min(axis=1))
                return
            d = self._far(lifted[active], node["vantage"])
            path, nearer = np.concatenate([path, d], axis=1), d[:, 0] <= node["middle"]
            split = first and node["home"] < 0
            for part, which in zip(node["parts"], (nearer, ~nearer) if split else (slice(None),) * 2):
                visit(part, active[which], path[which], first)

        if len(self.x) and len(q):
            narrow(np.arange(len(q)), np.full(len(q), np.nan))
            start = self._far(lifted, self.root_points)
            free = np.flatnonzero(np.isnan(floor))
            visit(self.root, free, start[free], True)
            visit(self.root, np.arange(len(q)), start, False)
        order = np.argsort(-best, axis=1, kind="stable")
        return np.take_along_axis(best, order, axis=1), np.take_along_axis(found, order, axis=1)

    def _leaf(self, node: dict, active: np.ndarray, reach: np.ndarray, path: np.ndarray, q: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        bound = np.zeros((len(active), len(node["rows"])), dtype=np.float32)
        for j, far in enumerate(node["path"]):
            np.maximum(bound, np.abs(path[:, j, None] - far), out=bound)
        at, row = np.nonzero(bound <= reach[active][:, None])
        self.visited += len(at)
        score = np.full(bound.shape, np.nan)
        with np.errstate(all="ignore"):
            for a in range(0, len(at), 1 << 12):
                s = slice(a, a + (1 << 12))
                score[at[s], row[s]] = products(q[active[at[s]]], self.x[node["rows"][row[s]]])
        k = best.shape[1]
        s = np.concatenate([best[active], score], axis=1)
        r = np.concatenate([found[active], np.where(np.isnan(score), -1, node["rows"])], axis=1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        best[active], found[active] = np.take_along_axis(s, near, axis=1), np.take_along_axis(r, near, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, so that equal vectors get equal ones; what overflows both ways counts as least."""
    p = np.einsum("ij,ij->i", a, b)
    return np.where(np.isnan(p), -np.finfo(float).max, p)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Shard:
    """The tree of one shard over (vec_id, times, v), equal vectors once with all their ids."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, times: np.ndarray):
        order = np.lexsort((ids, *x.T[::-1]))
        x, self.ids, self.times = x[order], ids[order], times[order]
        new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        self.heads = np.append(np.flatnonzero(new), len(x))
        self.tree = VantagePointTree(x[new])

    def nearest(self, q: np.ndarray, asked: np.ndarray, floor: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
        """(query_id, vec_id, score) of the k best for each query, its own row left out once."""
        score, rows = self.tree.search(q, k + 1, factor, floor)  # one more, as its own may be among them
        at, slot = np.nonzero(rows >= 0)
        u, s = rows[at, slot], score[at, slot]
        many = self.heads[u + 1] - self.heads[u]
        each = np.repeat(np.arange(len(u)), many)
        pos = np.repeat(self.heads[u] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        own = (self.ids[pos] == asked[at][each]) & (self.tree.x[u[each]] == q[at][each]).all(axis=1)
        left = self.times[pos] - own
        each, pos = np.repeat(each, left), np.repeat(pos, left)
        o_q, o_v, o_s = at[each], self.ids[pos], s[each]
        order = np.lexsort((o_v, -o_s, o_q))
        o_q, o_v, o_s = o_q[order], o_v[order], o_s[order]
        top = np.arange(len(o_q)) - np.searchsorted(o_q, o_q) < k
        return pa.RecordBatch.from_arrays([pa.array(asked[o_q[top]]), pa.array(o_v[top]), pa.array(o_s[top])], names=["query_id", "vec_id", "score"])


def search_shards(batches: Iterator[pa.RecordBatch], k: int, factor: Callable[[int], float]) -> Iterator[pa.RecordBatch]:
    """Over rows (slot, asked, vec_id, times, v, floor), sorted by the first two: the vectors of a shard come
    before its queries, so its tree is built once and queries stream through it."""
    now, parts, tree = None, [], None
    for batch in batches:
        slot, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "asked"))
        cuts = np.flatnonzero((np.diff(slot) != 0) | (np.diff(asked.astype(int)) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            if now != slot[a]:
                now, parts, tree = slot[a], [], None
            own = batch.slice(a, b - a)
            x, ids = _matrix(own.column("v")), own.column("vec_id").to_numpy()
            if not asked[a]:
                parts.append((x, ids, own.column("times").to_numpy()))
                continue
            if tree is None and parts:
                tree, parts = Shard(*(np.concatenate(c) for c in zip(*parts))), []
            floor = pc.fill_null(own.column("floor"), np.nan).to_numpy(zero_copy_only=False)
            for c in range(0, len(x) if tree else 0, QUERY_BATCH):
                s = slice(c, c + QUERY_BATCH)
                yield tree.nearest(x[s], ids[s], floor[s], k, factor(x.shape[1]))


@dataclass
class Cells:
    """The centres that vectors of one length are dealt to, on the sphere of radius ``top`` that all lifted vectors lie on."""

    scale: float
    top: float
    centres: np.ndarray
    factor: float = 1.0
    radius: np.ndarray | None = None  # largest distance of a vector of the cell to its centre

    def lifted(self, x: np.ndarray) -> np.ndarray:
        unit = x / self.scale
        return np.column_stack([unit, np.sqrt(np.maximum(0, self.top**2 - (unit * unit).sum(axis=1)))])

    def _distances(self, lifted: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * self.top**2 - 2 * lifted @ self.centres.T))

    def settle(self, x: np.ndarray) -> None:
        """Place the centres among the vectors of a sample."""
        lifted = self.lifted(x)
        for _ in range(ROUNDS):
            cell = np.concatenate([self._distances(part).argmin(axis=1) for part in self._blocks(lifted)])
            order = np.argsort(cell, kind="stable")
            present, first = np.unique(cell[order], return_index=True)
            sums = np.add.reduceat(lifted[order], first)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            self.centres[present] = np.where(norm > 0, sums / np.where(norm > 0, norm, 1) * self.top, self.centres[present])

    def _blocks(self, x: np.ndarray) -> Iterator[np.ndarray]:
        rows = max(1, (1 << 22) // len(self.centres))
        for a in range(0, len(x), rows):
            yield x[a : a + rows]

    def deal(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its centre) of vectors, or of queries."""
        made = [self._distances(self._query(part)[0] if query else self.lifted(part)) for part in self._blocks(x)]
        cell = np.concatenate([d.argmin(axis=1) for d in made]).astype(np.int32)
        return cell, np.concatenate([d.min(axis=1) for d in made])

    def _query(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lifted queries, and what turns a score into a product of lifted vectors."""
        largest = np.abs(q).max(axis=1, keepdims=True)
        unit = q / largest
        grow = self.top / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        return np.column_stack([unit * grow, np.zeros(len(q))]), np.stack([largest[:, 0], grow[:, 0]])

    def reached(self, q: np.ndarray, floor: np.ndarray) -> list[np.ndarray]:
        """For each query the cells in which a vector of a score of ``floor`` or more may lie, by the triangle inequality
        relaxed by the factor: at the cell's centre, and as no vector of a cell is nearer to another cell's centre."""
        out: list[np.ndarray] = []
        for part in self._blocks(q):
            least = floor[len(out) : len(out) + len(part)]
            lifted, (largest, grow) = self._query(part)
            d = self._distances(lifted)
            with np.errstate(all="ignore"):
                last = least / self.scale / largest * grow
                far = np.sqrt(np.maximum(0, 2 * self.top**2 - 2 * last)) / self.factor + 4e-6 * self.top
            far = np.where(np.isfinite(last), far, np.inf)
            bound = np.maximum(d - self.radius, (d - d.min(axis=1, keepdims=True)) / 2)
            out += [np.flatnonzero(row) for row in bound <= far[:, None]]
        return out


def _each_length(batches: Iterator[pa.RecordBatch], layout: dict[int, Cells], run: Callable[[pa.RecordBatch, Cells | None], list[pa.Array]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns appended by ``run`` to the rows of one length at a time."""
    for batch in batches:
        dim = batch.column("dim")
        for d in pc.unique(dim).to_pylist():
            own = batch.filter(pc.equal(dim, d))
            yield pa.RecordBatch.from_arrays([*own.columns, *run(own, layout.get(d))], names=[*own.schema.names, *names])


def dealt(rows: DataFrame, layout: dict[int, Cells], query: bool) -> DataFrame:
    """``rows`` (dim, v, ..) with cell and its distance; lengths without centres have cell 0."""

    def run(own: pa.RecordBatch, cells: Cells | None) -> list[pa.Array]:
        n = own.num_rows
        cell, far = cells.deal(_matrix(own.column("v")), query) if cells else (np.zeros(n, np.int32), np.zeros(n))
        return [pa.array(cell), pa.array(far)]

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell int, far double"
    return rows.mapInArrow(releasing(lambda batches: _each_length(batches, layout, run, ["cell", "far"])), schema)


def routed(rows: DataFrame, layout: dict[int, Cells]) -> DataFrame:
    """``rows`` (dim, v, home, floor, ..) with ``cell``, a row for each cell but ``home`` that a query still has to visit."""

    def run(own: pa.RecordBatch, cells: Cells | None) -> list[pa.Array]:
        floor = pc.fill_null(own.column("floor"), np.nan).to_numpy(zero_copy_only=False)
        return [pa.array(cells.reached(_matrix(own.column("v")), floor) if cells else [[]] * own.num_rows, pa.list_(pa.int32()))]

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cells array<int>"
    made = rows.mapInArrow(releasing(lambda batches: _each_length(batches, layout, run, ["cells"])), schema)
    return made.select(*rows.columns, F.explode("cells").alias("cell")).where("cell <> home")


def accepted_factor(x: np.ndarray, n: int, k: int) -> float:
    """The first of FACTORS with which a tree over a sample finds enough of the nearest of some of its vectors, else 1. Of a
    sample of ``n`` vectors only as many nearest are looked at as the ``k`` of all make up in it: they are as far away."""
    k = min(len(x) - 1, math.ceil(k * len(x) / n))
    if k < 1:
        return 1.0
    own = np.random.default_rng(6).permutation(len(x))[:TRIED]
    unit = x / np.abs(x).max()
    score = unit[own] @ unit.T
    score[np.arange(len(own)), own] = -np.inf
    least = np.partition(score, -k, axis=1)[:, -k] - 1e-9
    tree = VantagePointTree(unit)
    for factor in FACTORS:
        _, rows = tree.search(unit[own], k + 1, factor)
        hit = (rows >= 0) & (rows != own[:, None]) & (np.take_along_axis(score, np.maximum(rows, 0), axis=1) >= least[:, None])
        if np.minimum(hit.sum(axis=1), k).mean() >= RECALL * k:
            return factor
    return 1.0


def _layout(own: DataFrame, k: int, factor: float | None) -> dict[int, Cells]:
    """Centres and the factor for each of the most frequent lengths of vectors, from (dim, h, v, largest absolute component). The
    driver gets a row for each of these and a sample of bounded bytes."""
    a = F.col("largest")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x / a) * (x / a))
    sizes = own.groupBy("dim").agg(F.count("*").alias("n"), F.max(a).alias("scale"), F.max(F.log(a) + F.log(square) / 2).alias("norm"))
    layout = {}
    for r in sizes.orderBy(F.col("n").desc(), "dim").limit(MOST_LENGTHS).collect():
        width = 8 * (r["dim"] + 1)
        want = max(1, min(MOST_CELLS, math.ceil(r["n"] * r["dim"] * 8 / SHARD_BYTES), CENTRE_BYTES // width))
        draw = min(1.0, max(SHARD_BYTES, min(want * SAMPLE_PER_CELL * width, SAMPLE_BYTES)) / width / r["n"])
        drawn = own.where(F.col("dim") == r["dim"]).where(F.pmod(F.xxhash64(F.lit(5), "h"), F.lit(1 << 40)) < int(draw * (1 << 40)))
        x = _matrix(drawn.select("v").toArrow().column("v").combine_chunks())
        if not len(x):
            continue
        x = np.unique(x, axis=0)
        x = x[np.random.default_rng(5).permutation(len(x))]
        cells = Cells(r["scale"], math.exp(r["norm"] - math.log(r["scale"])) * (1 + 1e-12), np.zeros((0, 0)))
        cells.centres = cells.lifted(x[:want])
        if want > 1:
            cells.settle(x)
        cells.factor = accepted_factor(x[: max(2, SHARD_BYTES // width)], r["n"], k) if factor is None else factor
        layout[r["dim"]] = cells
    return layout


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) with v array<double>: rows with an id whose vector isn't null, empty or zero and has
    finite components only."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest of the other rows by inner product.

    Vectors that are null, empty, zero or not finite, and rows without an id, take no part; any finite vector does,
    whatever its size. Vectors of another length than the query's aren't compared. Ties go to the
    smaller id. A row equal to the query's in id and vector is left out once; further repeats of it, and of
    any other row, are candidates each, while a repeated query is answered once. Of equal vectors the k + 1
    smallest ids are kept before the search, more can't be among anyone's k nearest. Fewer
    candidates give fewer rows; an empty table gives none.
    """
    own = usable(vectors, id_col, vector_col).groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k + 1)).alias("times"))
    own = own.withColumn("h", F.xxhash64(F.size("v"), "v"))
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    own = materialize(own.withColumn("dim", F.size("v")).withColumn("largest", F.array_max(F.transform("v", F.abs))))
    ship(vectors.sparkSession)
    layout = _layout(own, k, factor)
    factors = {dim: c.factor for dim, c in layout.items()}
    rest = 1.0 if factor is None else factor
    own = materialize(dealt(own.drop("largest"), layout, False))
    subs = F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES).cast("int")
    cells = own.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("subs", subs).orderBy("dim", "cell").collect()
    for dim, c in layout.items():
        c.radius = np.full(len(c.centres), -np.inf)
        for r in cells:
            if r["dim"] == dim:
                c.radius[r["cell"]] = r["radius"]
    first = np.cumsum([0, *[r["subs"] for r in cells]]).tolist()
    slots = [(r["dim"], r["cell"], a, r["subs"]) for r, a in zip(cells, first)]
    at = vectors.sparkSession.createDataFrame(slots, "dim int, cell int, first long, subs int")  # a row a cell: as many as centres, and lengths of vectors
    parts = max(1, min(MOST_PARTS, first[-1]))
    put = own.join(at, ["dim", "cell"]).select((F.col("first") + F.pmod(F.xxhash64("h"), "subs")).alias("slot"), F.lit(False).alias("asked"), "vec_id", "times", "v", F.lit(None).cast("double").alias("floor"))

    def found(asked: DataFrame) -> DataFrame:
        """The k best for queries (dim, cell, vec_id, v, floor) in all shards of the given cells."""
        sent = asked.join(at, ["dim", "cell"]).select(F.explode(F.sequence("first", F.col("first") + F.col("subs") - 1)).alias("slot"), F.lit(True).alias("asked"), "vec_id", F.lit(1).cast("bigint").alias("times"), "v", "floor")
        there = put.union(sent).repartitionById(parts, F.pmod("slot", F.lit(parts)).cast("int")).sortWithinPartitions("slot", "asked")
        return there.mapInArrow(releasing(lambda batches: search_shards(batches, k, lambda dim: factors.get(dim, rest))), "query_id bigint, vec_id bigint, score double")

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = usable(queries, id_col, vector_col).dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))
    asked = dealt(asked, layout, True).drop("far")
    best = ranked(found(asked.withColumn("floor", F.lit(None).cast("double"))))
    if any(len(c.centres) > 1 for c in layout.values()):
        best = materialize(best)
        last = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        onward = routed(asked.withColumnRenamed("cell", "home").join(last, "vec_id", "left"), layout)
        best = ranked(best.drop("rank").union(found(onward)))
    return best.select("query_id", "rank", "vec_id", "score")


def op5_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the 20 nearest of each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
