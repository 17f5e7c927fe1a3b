"""Nearest neighbours by inner product, from stable projections in kd-trees.

Vectors gain one component that makes all lengths equal, so the largest inner
product is the least distance. A Gaussian (2-stable) projection to ``DIMS`` dimensions
keeps distances in this sense: the squared projected distance of a pair, over its squared
distance, is chi-square with ``DIMS`` degrees of freedom. A kd-tree over the
projections of a bounded sample (``SAMPLE`` rows) sets at most ``MAX_CELLS`` cells, of ``LEAST_CELL`` to
``BLOCK`` rows where that allows; every row is indexed in a cell, and a cell with more rows is dealt over blocks.

A query takes its projected neighbours one after the other, in the order of their projected distance: leaves of a
block's kd-tree open in the order of their distance, and a row is verified by its exact inner product
once no closed leaf can hold a nearer one. It stops where the chi-square test holds: a row as near as the k-th best
found so far would project nearer than what is left with probability ``CONFIDENCE`` or more. So each true neighbour
is found with that probability at least. A query first visits a block of its own cell; the best found there bound
the cells and rows that it takes elsewhere by the same test. How many rows it stops after depends on the data: where all
distances are alike it is many. ``verified`` counts them.

Of equal vectors in a block only the k + 1 with the least ids can be among a query's k
nearest; the others are passed over, which keeps copies cheap and loses nothing.

Defined results: vectors that are null, all zero, or that
hold null or non-finite components take no part, as queries or candidates, nor do rows with a null
id; vectors of another length are neighbours of each other only; a query with fewer candidates gets them
all; ties go to the smaller id; rows that repeat an id are candidates each on its own, but not of that id's query; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import materialise

DIMS = 24
SAMPLE = 16_384
MAX_CELLS = 1024
LEAST_CELL, BLOCK = 256, 8192
#: Cells that a table has at least, where it has rows for them.
SPREAD = 16
LEAF = 32
#: Rows verified between two tests: so many, or a part of those verified before.
STEP, PART = 64, 2
CONFIDENCE = 0.85


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, dtype=float) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_value(share: float, dims: int = DIMS) -> float:
    """Where the distribution function reaches a share."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (low, middle) if chi_square(np.array(middle), dims) >= share else (middle, high)
    return high


def split_cells(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[tuple]]:
    """kd-tree by medians of the widest dimension: rows of each leaf, lower and upper corners, and the tree.

    A node is (dimension, value, low child, high child); a child below 0 is leaf ~child. Equal points are never split.
    """
    rows: list[np.ndarray] = []
    low: list[np.ndarray] = []
    high: list[np.ndarray] = []
    nodes: list[list] = []
    dims = points.shape[1]
    stack = [(np.arange(len(points)), np.full(dims, -np.inf), np.full(dims, np.inf), -1, 0)]
    while stack:
        own, lo, hi, parent, side = stack.pop()
        spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(dims)
        d = int(spread.argmax())
        value = np.median(points[own, d]) if len(own) > leaf and spread[d] > 0 else None
        if value is not None and not (points[own, d] < value).any():  # many equal: split above them
            value = points[own, d][points[own, d] > value].min()
        if value is None:
            here = ~len(rows)
            rows.append(own)
            low.append(lo)
            high.append(hi)
        else:
            here = len(nodes)
            nodes.append([d, float(value), 0, 0])
            less = points[own, d] < value
            cut_hi, cut_lo = hi.copy(), lo.copy()
            cut_hi[d] = cut_lo[d] = value
            stack += [(own[less], lo, cut_hi, here, 2), (own[~less], cut_lo, hi, here, 3)]
        if parent >= 0:
            nodes[parent][side] = here
    return rows, np.array(low), np.array(high), [tuple(n) for n in nodes]


def box_distances(z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    return sum(np.maximum(np.maximum(low[None, :, d] - z[:, d, None], z[:, d, None] - high[None, :, d]), 0) ** 2 for d in range(z.shape[1]))


@dataclass
class Plan:
    """What every task needs: bounded by MAX_CELLS and the vectors' length."""

    dim: int
    reach: float  # the largest squared length
    matrix: np.ndarray
    low: np.ndarray
    high: np.ndarray
    nodes: list[tuple]

    def project(self, x: np.ndarray, *, query: bool) -> np.ndarray:
        """A row's last component fills its length up; a query's is zero."""
        fill = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.reach - (x * x).sum(axis=1), 0))
        return np.concatenate([x, fill[:, None]], axis=1) @ self.matrix

    def cells(self, z: np.ndarray) -> np.ndarray:
        """The cell of each projected point."""
        out = np.full(len(z), -1 if not self.nodes else 0)
        while len(at := np.nonzero(out >= 0)[0]):
            node = np.array([self.nodes[i] for i in out[at]])
            less = z[at, node[:, 0].astype(int)] < node[:, 1]
            out[at] = np.where(less, node[:, 2], node[:, 3]).astype(int)
        return ~out


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """Rows (vec_id, v) that take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(sound)
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))


def make_plan(rows: DataFrame, dim: int, seed: int = 42) -> tuple[Plan, int]:
    """Projection and cells; and the number of rows."""
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("reach")).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    x = np.array(sample.tolist(), dtype=float).reshape(-1, dim)
    matrix = np.random.default_rng(seed).standard_normal((dim + 1, DIMS))
    plan = Plan(dim, float(stats["reach"] or 0.0), matrix, np.full((1, DIMS), -np.inf), np.full((1, DIMS), np.inf), [])
    cells = min(MAX_CELLS, stats["n"] // min(BLOCK, max(LEAST_CELL, stats["n"] // SPREAD)))
    if len(x) and cells > 1:
        _, plan.low, plan.high, plan.nodes = split_cells(plan.project(x, query=False), max(1, len(x) // cells))
    return plan, stats["n"]


class Block:
    """The rows of a block under a local kd-tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, plan: Plan, k: int):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        fresh = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        keep = np.arange(len(ids)) - start <= k
        ids, x = ids[keep], x[keep]
        z = plan.project(x, query=False)
        leaves, _, _, _ = split_cells(z, LEAF)
        self.reach, self.k, self.cut = plan.reach, k, chi_square_value(CONFIDENCE)
        self.low = np.array([z[r].min(axis=0) for r in leaves])
        self.high = np.array([z[r].max(axis=0) for r in leaves])
        order = np.concatenate(leaves)
        self.ids, self.x = ids[order], x[order]
        # Places by leaf, so that leaves open together; what a leaf lacks is far from all.
        sizes = np.array([*map(len, leaves)])
        self.places = (np.cumsum(sizes) - sizes)[:, None] + np.arange(sizes.max())
        lacks = np.arange(sizes.max()) >= sizes[:, None]
        self.places[lacks] = 0
        self.z = z[order][self.places]
        self.lengths = np.where(lacks, np.inf, (self.z * self.z).sum(axis=2))

    def search(self, query: int, q: np.ndarray, z: np.ndarray, far: np.ndarray, floor: float) -> tuple[list[tuple[int, float]], int]:
        """Up to k (id, inner product), best first, and the rows verified; ``floor`` is the k-th best inner product known so far."""
        turn = np.argsort(far, kind="stable")
        length = q @ q + self.reach
        # Squared projected distance from which on the test holds.
        limit = self.cut * max(length - 2 * floor, 0) + 1e-12 * length if np.isfinite(floor) else np.inf
        rows, scores = np.empty(0, dtype=np.int64), np.empty(0)
        wait, away = np.empty(0, dtype=np.int64), np.empty(0)  # rows of open leaves, by projected distance
        at, step, verified = 0, 4, 0
        while True:
            edge = far[turn[at]] if at < len(turn) else np.inf
            ready = int(np.searchsorted(away, min(edge, limit), side="right"))
            if ready:
                # A test costs as much as many rows, so there is one after each further part of the rows.
                new = wait[: min(ready, max(STEP, verified // PART))]
                wait, away = wait[len(new) :], away[len(new) :]
                verified += len(new)
                rows, scores = np.concatenate([rows, new]), np.concatenate([scores, self.x[new] @ q])
                if len(scores) >= self.k:
                    least = np.partition(scores, -self.k)[-self.k]
                    near = scores >= least - 1e-9 * max(1.0, abs(least))
                    rows, scores = rows[near], scores[near]
                    floor = max(floor, float(least))
                    limit = self.cut * max(length - 2 * floor, 0) + 1e-12 * length
            elif at == len(turn) or edge > limit:
                break
            else:
                own = turn[at : at + step]
                new, apart = self.places[own].ravel(), self.lengths[own].ravel() - 2 * (self.z[own].reshape(-1, DIMS) @ z) + z @ z
                near = np.nonzero((apart <= limit) & (apart < np.inf))[0]  # the limit only falls
                near = near[self.ids[new[near]] != query]
                wait, away = np.concatenate([wait, new[near]]), np.concatenate([away, apart[near]])
                order = np.argsort(away)
                wait, away = wait[order], away[order]
                at, step = min(at + step, len(turn)), 2 * step
        exact = (self.x[rows] * q).sum(axis=1)  # one order of summation for every row, so that equal rows tie
        best = np.lexsort((self.ids[rows], -exact))[: self.k]
        return [(int(self.ids[rows[i]]), float(exact[i])) for i in best], verified


def _search(sides: DataFrame, plan: Plan, k: int) -> DataFrame:
    """Search blocks: rows (cell, salt, kind, id, v, floor), in each block kind 0 (rows) before kind 1 (queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, parts, block = None, [], [], None
        for b in batches:
            spot = (b.column("cell").to_numpy().astype(np.int64) << 32) + b.column("salt").to_numpy()
            kind, own = b.column("kind").to_numpy(), b.column("id").to_numpy()
            x, floors = matrix_of(b.column("v"), plan.dim), b.column("floor").to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            turns = np.nonzero(np.diff(spot * 2 + kind))[0] + 1
            for first, last in zip([0, *turns], [*turns, len(spot)], strict=True):
                if first == last:
                    continue
                if spot[first] != held:
                    held, ids, parts, block = spot[first], [], [], None
                if kind[first] == 0:
                    ids.append(own[first:last])
                    parts.append(x[first:last])
                    continue
                if block is None and ids:
                    block = Block(np.concatenate(ids), np.concatenate(parts), plan, k)
                    ids, parts = [True], []
                if block is None:
                    continue
                for at in range(first, last, 1024):
                    q = x[at : min(last, at + 1024)]
                    z = plan.project(q, query=True)
                    far = box_distances(z, block.low, block.high)
                    for i in range(len(q)):
                        query = int(own[at + i])
                        best, verified = block.search(query, q[i], z[i], far[i], float(floors[at + i]))
                        # The first row of a query in a block tells what the block cost.
                        out += [(query, v, s, 0 if j else verified) for j, (v, s) in enumerate(best)]
            if out:
                q, v, s, n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64()), pa.array(n, pa.int64())], ["query_id", "vec_id", "score", "verified"])

    dealt = sides.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double, verified long")


def index(rows: DataFrame, plan: Plan) -> DataFrame:
    """Every row with its cell: (cell, vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = plan.cells(plan.project(matrix_of(b.column("v"), plan.dim), query=False))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column("vec_id"), b.column("v")], ["cell", "vec_id", "v"])

    return rows.mapInArrow(run, "cell int, vec_id long, v array<double>")


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``: query_id, rank, vec_id, score, and ``verified``,
    the rows whose inner product the query took."""
    rows = usable(vectors, vector, key)
    found = vectors.sparkSession.sql("SELECT CAST(0 AS BIGINT) query_id, 0 rank, CAST(0 AS BIGINT) vec_id, CAST(0 AS DOUBLE) score, CAST(0 AS BIGINT) verified WHERE false")
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect())  # one, or a few
    for dim in lengths:
        part = _nearest(rows.where(F.size("v") == dim), dim, every, k)
        found = part if len(lengths) == 1 else found.unionByName(part)
    return found


def _nearest(rows: DataFrame, dim: int, every: int, k: int) -> DataFrame:
    plan, _ = make_plan(rows, dim)
    placed = materialise(index(rows, plan), "cells")
    counts = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # at most MAX_CELLS rows, or a few more
    salts = np.zeros(max(len(plan.low), 1), dtype=np.int64)
    for cell, n in counts.items():
        salts[cell] = -(-n // BLOCK)
    salt_of = F.element_at(F.lit([int(max(1, s)) for s in salts]), F.col("cell") + 1)
    nothing, cut = F.lit(float("-inf")), chi_square_value(CONFIDENCE)
    data = placed.select("cell", F.pmod(F.xxhash64("vec_id"), salt_of).cast("int").alias("salt"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", nothing.alias("floor"))

    def visits(found: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix_of(b.column("v"), plan.dim)
                z = plan.project(x, query=True)
                far = box_distances(z, plan.low, plan.high)
                far[:, salts == 0] = np.inf  # cells without rows
                home = far.argmin(axis=1)
                if not found:
                    which, cell = np.arange(len(x)), home
                    salt = np.zeros(len(x), dtype=np.int64)
                else:
                    floors = b.column("floor").to_numpy(zero_copy_only=False)
                    length = (x * x).sum(axis=1) + plan.reach
                    known = np.isfinite(floors)
                    limit = np.where(known, cut * np.maximum(length - 2 * np.where(known, floors, 0), 0) + 1e-12 * length, np.inf)
                    over = far > limit[:, None]
                    which, cell = np.nonzero(~over & (salts > 0)[None, :])
                    times = salts[cell]
                    which, cell = np.repeat(which, times), np.repeat(cell, times)
                    salt = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                    fresh = (cell != home[which]) | (salt != 0)  # visited first
                    which, cell, salt = which[fresh], cell[fresh], salt[fresh]
                for at in range(0, len(which), 20_000):
                    part = b.take(pa.array(which[at : at + 20_000]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[at : at + 20_000], pa.int32()), pa.array(salt[at : at + 20_000], pa.int32()), pa.array(np.ones(part.num_rows, dtype=np.int32)), part.column("vec_id"), part.column("v"), part.column("floor")],
                        ["cell", "salt", "kind", "id", "v", "floor"],
                    )

        return run

    kind = "cell int, salt int, kind int, id long, v array<double>, floor double"
    # A query that repeats an id and vector is one query.
    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
    first = materialise(_search(data.unionByName(queries.withColumn("floor", nothing).mapInArrow(visits(False), kind)), plan, k), "nearest")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = queries.join(floors, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", F.coalesce("least", nothing).alias("floor"))
    second = _search(data.unionByName(known.mapInArrow(visits(True), kind)), plan, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(second).withColumn("rank", F.row_number().over(order)).withColumn("verified", F.sum("verified").over(Window.partitionBy("query_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", "verified")
