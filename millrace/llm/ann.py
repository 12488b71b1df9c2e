"""Nearest neighbours by low-dimensional stable projections indexed by a kd-tree.

Largest inner product is turned into smallest distance by one more component. Vectors
are projected on a few Gaussian directions, so that the squared projected distance over
the squared distance follows a chi-square law. One kd-tree over the projections, cut at
the quantiles of a sample, parts all vectors into cells; inside a cell it goes on down to
leaves. A query takes cells, and in them leaves, by projected distance, its own first, in
rounds that grow eightfold. A vector is verified only while the chi-square test leaves a
chance: once its squared projected distance reaches the wanted quantile times the k-th
best squared distance, a nearer vector would have come before with that probability. What
comes after is never looked at: leaves and cells by their boxes, vectors one by one.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Projected dimensions; even, for the closed form of the chi-square law.
DIRECTIONS = 16
#: Probability that a vector nearer than the k-th would have been seen when a search stops.
CONFIDENCE = 0.9
#: Rows that the cuts between cells are taken from; bounds what the driver sees.
SAMPLE_ROWS = 20_000
#: A cell has a 64th of the rows, but not fewer or more than these, nor more bytes.
CELL_ROWS = (1024, 65_536)
CELL_BYTES = 32 << 20
QUERY_ROWS = 512
LEAF_ROWS = 128
#: Times more cells in each round.
GROWTH = 8
#: Share of a tile from which it is multiplied as a whole rather than pair by pair.
DENSE = 1 / 16


def chi_square_cdf(x: float, even: int) -> float:
    term, total = 1.0, 1.0
    for j in range(1, even // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, even: int) -> float:
    lo, hi = 0.0, 1.0
    while chi_square_cdf(hi, even) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, even) < p else (lo, mid)
    return hi


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves by the median of the widest side."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        side = int(np.argmax(np.ptp(points[rows], axis=0)))
        half = len(rows) // 2
        rows = rows[np.argpartition(points[rows, side], half)]
        todo += [rows[half:], rows[:half]]
    return out


class Cells:
    """The upper part of the kd-tree: cuts at the quantiles of a sample, a power of two of cells."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.depth = max(0, math.ceil(math.log2(max(cells, 1))))
        self.side = np.zeros((1 << self.depth) - 1, np.int64)
        self.cut = np.zeros((1 << self.depth) - 1)
        held = {0: np.arange(len(sample))}
        for node in range(len(self.side)):
            rows = held.pop(node)
            if len(rows):
                points = sample[rows]
                self.side[node] = np.argmax(np.ptp(points, axis=0))
                column = points[:, self.side[node]]
                self.cut[node] = np.median(column)
                left = column < self.cut[node]
                held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
            else:
                held[2 * node + 1] = held[2 * node + 2] = rows

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.side[node]] >= self.cut[node])
        return node - len(self.side)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box, side by side so that memory is points times boxes."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        gap = np.maximum(low[None, :, d] - points[:, None, d], points[:, None, d] - high[None, :, d])
        out += np.square(np.maximum(gap, 0, out=gap), out=gap)
    return out


class Law:
    """Directions of the projection, the radius that completes vectors, and the test."""

    def __init__(self, dim: int, reach2: float, confidence: float, seed: int) -> None:
        self.directions = np.random.default_rng(seed).standard_normal((dim + 1, DIRECTIONS))
        self.reach2 = reach2
        self.stop = chi_square_quantile(confidence, DIRECTIONS)

    def vectors(self, v: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.reach2 - np.einsum("ij,ij->i", v, v), 0))
        return v @ self.directions[:-1] + extra[:, None] * self.directions[-1]

    def queries(self, v: np.ndarray) -> np.ndarray:
        """Projections of queries, stretched to the radius: that keeps their order and parts near from far the most."""
        return (v @ self.directions[:-1]) * np.sqrt(self.reach2 / np.einsum("ij,ij->i", v, v))[:, None]

    def limit(self, norm2: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared projected distance at which the test stops a search whose k-th best has this score."""
        worst2 = np.maximum(2 * self.reach2 - 2 * score * np.sqrt(self.reach2 / norm2), 0)
        return np.where(np.isneginf(score), np.inf, self.stop * worst2 * (1 + 1e-9) + 1e-12)


class Block:
    """A cell's distinct vectors with the smallest ids of each, and the kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, law: Law, k: int, leaf: int = LEAF_ROWS) -> None:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        unique, first, at = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        at = at.ravel()
        rank = np.argsort(first)  # vectors by their smallest id
        self.vectors = unique[rank]
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        at = place[at]
        self.ids: list[np.ndarray] = np.split(ids[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at))[:-1])
        #: A vector that one id alone holds is no candidate for that id.
        self.sole = np.array([x[0] == x[-1] for x in self.ids])
        self.first = np.array([x[0] for x in self.ids])
        self.law, self.k = law, k
        self.projected = law.vectors(self.vectors)
        self.norm2 = np.einsum("ij,ij->i", self.projected, self.projected)
        self.leaves = [np.sort(x) for x in kd_leaves(self.projected, leaf)]
        self.low = np.array([self.projected[x].min(0) for x in self.leaves])
        self.high = np.array([self.projected[x].max(0) for x in self.leaves])
        #: Pairs of a query and a vector that were verified, and that there were.
        self.verified = self.pairs = 0

    def search(self, query_ids: np.ndarray, floor: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """For each query the rows of its k best distinct vectors found, best first (ties: smaller row); -1 where there are fewer.

        floor: a score that each query has k vectors of already; below it none is wanted.
        """
        n, keep, law = len(queries), self.k, self.law
        norm2 = np.einsum("ij,ij->i", queries, queries)
        q = law.queries(queries)
        q2 = np.einsum("ij,ij->i", q, q)
        near = box_distances(q, self.low, self.high)
        best, rows = np.full((n, keep), -np.inf), np.full((n, keep), -1, np.int64)
        self.pairs += n * len(self.vectors)

        def visit(mine: np.ndarray, held: np.ndarray) -> None:
            least = np.maximum(best[mine, -1], floor[mine])
            apart = q2[mine, None] + self.norm2[held][None] - 2 * (q[mine] @ self.projected[held].T)
            going = (apart < law.limit(norm2[mine], least)[:, None]) & ~(self.sole[held][None] & (query_ids[mine, None] == self.first[held][None]))
            count = int(going.sum())
            self.verified += count
            if not count:
                return
            if count > DENSE * going.size:
                scores = queries[mine] @ self.vectors[held].T
                i, j = np.nonzero(going & (scores >= least[:, None] - 1e-9))  # what only rounding keeps below is a tie
                s = scores[i, j]
            else:
                i, j = np.nonzero(going)
                s = np.einsum("ij,ij->i", queries[mine[i]], self.vectors[held[j]])
                fine = s >= least[i] - 1e-9
                i, j, s = i[fine], j[fine], s[fine]
            if not len(i):
                return
            some = np.unique(i)
            who = np.concatenate([np.repeat(some, keep), i])
            what = np.concatenate([rows[mine[some]].ravel(), held[j]])
            score = np.concatenate([best[mine[some]].ravel(), s])
            order = np.lexsort((what, -score, who))
            who, what, score = who[order], what[order], score[order]
            start = np.searchsorted(who, some)
            place = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who))))
            top = place < keep
            best[mine[who[top]], place[top]], rows[mine[who[top]], place[top]] = score[top], what[top]

        home = np.argmin(near, axis=1)
        for x in np.unique(home):
            visit(np.flatnonzero(home == x), self.leaves[x])
        for x in np.argsort(near.sum(0), kind="stable"):
            open_ = (near[:, x] < law.limit(norm2, np.maximum(best[:, -1], floor))) & (home != x)
            if open_.any():
                visit(np.flatnonzero(open_), self.leaves[x])
        return rows

    def answer(self, numbers: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
        """number, query_id, vec_id and score of each query's k best here, its own id left out; scores summed in one fixed order."""
        rows = self.search(query_ids, floor, queries)
        q, v, s = [], [], []
        for i, found in enumerate(rows):
            found = found[found >= 0]
            score = (self.vectors[found] * queries[i]).sum(1)
            ids = [self.ids[r] for r in found]
            flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
            many = np.repeat(score, [len(x) for x in ids])
            other = flat != query_ids[i]
            flat, many = flat[other], many[other]
            top = np.lexsort((flat, -many))[: self.k]
            q.append(np.full(len(top), i))
            v.append(flat[top])
            s.append(many[top])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        at = join(q, np.int64)
        return [numbers[at], query_ids[at], join(v, np.int64), join(s, np.float64)]


def usable(column: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    big = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)
    return F.coalesce(column.isNotNull() & F.forall(column, fine) & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column without nulls, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def pack_rows(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers one after another, behind their row count."""
    return struct.pack("<q", len(columns[0])) + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack_rows(data: bytes, dim: int, kinds: tuple[type, ...]) -> list[np.ndarray]:
    """The columns of pack_rows; the last is a matrix of dim columns."""
    n, at, out = struct.unpack_from("<q", data)[0], 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += 8 * n
    return [*out, np.frombuffer(data, np.float64, n * dim, at).reshape(n, dim)]


def few_of_each(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that the k nearest of any query can come from: of equal vectors the 2k smallest ids, no id over k times.

    A query's own id takes at most k of those, so that k others are left, if there are as many.
    """
    _, at = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, at.ravel()))
    for most, keys in ((k, lambda o: (at.ravel()[o], ids[o])), (2 * k, lambda o: (at.ravel()[o],))):
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([np.diff(x) != 0 for x in keys(order)], axis=0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[np.arange(len(order)) - start < most]
    return np.sort(order)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    confidence: float = CONFIDENCE,
    seed: int = 42,
    cell_rows: int | None = None,
    query_rows: int = QUERY_ROWS,
    tally: dict | None = None,
) -> DataFrame:
    """The k vectors of largest inner product for each row that is_query holds for.

    Returns query_id, rank (from 1), vec_id and score (the inner product in double
    precision), ties to the smaller vec_id. Every usable vector is indexed and is a
    candidate, but for those that carry the query's vec_id; a query with fewer has fewer rows.

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null vec_id. Vectors of different lengths are searched apart:
    those of each length among themselves. Equal vectors are verified once and tie.
    Repeated rows count as candidates each, and a query row that is there twice is
    answered twice. An empty table, or one without queries, gives no rows. Other columns
    are ignored.

    tally: a dict that gets accumulators: pairs of a query and a distinct vector of its
    cells, and verified, those that the stopping test let through.
    """
    spark = small_batches(vectors.sparkSession)
    v = F.col("embedding")
    base = vectors.where(F.col("vec_id").isNotNull() & usable(v)).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dims = base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq"), F.max(norm2).alias("reach2"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if tally is not None:
        tally.update({x: spark.sparkContext.accumulator(0) for x in ("pairs", "verified")})
    for d in dims.where("nq > 0").orderBy("d").collect():  # one row for each length of vector
        rows = cell_rows or min(max(d["n"] // 64, CELL_ROWS[0]), CELL_ROWS[1], max(1, CELL_BYTES // (8 * d["d"])))
        cells = max(1, d["n"] // rows)
        found = _search(base.where(F.size("v") == d["d"]), d["d"], Law(d["d"], float(d["reach2"]), confidence, seed), d["n"], cells, k, seed, query_rows, tally or {})
        out = out.unionByName(found)
    return out


def _search(base: DataFrame, dim: int, law: Law, n: int, cells: int, k: int, seed: int, query_rows: int, tally: dict) -> DataFrame:
    spark = base.sparkSession
    every = max(1, n // SAMPLE_ROWS)
    picked = base.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(every)) == 0).select("v").limit(2 * SAMPLE_ROWS)
    sample = np.array([r["v"] for r in picked.collect()], np.float64).reshape(-1, dim)
    tree = Cells(law.vectors(sample), cells)
    count = 1 << tree.depth

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1), dim)
            some = few_of_each(ids, x, k)  # a vector that very many rows hold
            ids, x = ids[some], x[some]
            cell = tree.of(law.vectors(x))
            for c in np.unique(cell):
                mine = cell == c
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([pack_rows(ids[mine], x[mine])], pa.binary())], ["cell", "data"])

    def join_up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_rows(x, dim, (np.int64,)) for x in group["data"]]
        ids, x = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        some = few_of_each(ids, x, k)
        ids, x = ids[some], x[some]
        p = law.vectors(x)
        return pd.DataFrame({"cell": [int(key[0])], "data": [pack_rows(ids, x)], "low": [p.min(0)], "high": [p.max(0)]})

    parts = base.select("vec_id", "v").mapInArrow(route, "cell long, data binary")
    held = staged(parts.groupBy("cell").applyInPandas(join_up, "cell long, data binary, low array<double>, high array<double>"), "ann-cells")
    boxes = held.select("cell", "low", "high").orderBy("cell").collect()  # one row per cell
    number = np.array([b["cell"] for b in boxes], np.int64)
    low, high = np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes])
    side = spark.sparkContext.broadcast((number, low, high))  # of at most n / CELL_ROWS cells

    asked = staged(base.where("q").select(F.monotonically_increasing_id().alias("number"), "vec_id", "v"), "ann-queries")
    best, lo, hi = None, 0, 1
    while lo < len(boxes):

        def ask(batches: Iterator[pa.RecordBatch], lo: int = lo, hi: int = hi) -> Iterator[pa.RecordBatch]:
            cell, low, high = side.value
            step = max(1, min(query_rows, (1 << 22) // len(cell)))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    b = batch.slice(at, step)
                    nos, ids, floor = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
                    x = matrix(b.column(3), dim)
                    near = box_distances(law.queries(x), low, high)
                    order = np.argsort(near, axis=1, kind="stable")[:, lo:hi]
                    limit = law.limit(np.einsum("ij,ij->i", x, x), floor)
                    i, j = np.nonzero(np.take_along_axis(near, order, 1) < limit[:, None])
                    to = order[i, j]
                    by = np.argsort(to, kind="stable")
                    i, to = i[by], to[by]
                    cuts = np.flatnonzero(np.diff(to, prepend=-1))
                    for mine, c in zip(np.split(i, cuts[1:]), to[cuts], strict=False):
                        data = pack_rows(nos[mine], ids[mine], floor[mine], x[mine])
                        yield pa.RecordBatch.from_arrays([pa.array([int(cell[c])]), pa.array([1], pa.int32()), pa.array([data], pa.binary())], ["cell", "kind", "data"])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Each cell's vectors come first, then the queries that ask it.
            block, vectors = None, None
            for batch in batches:
                for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if kind == 0:
                        block, vectors = None, data.as_py()
                        continue
                    if block is None:
                        block = Block(*unpack_rows(vectors, dim, (np.int64,)), law, k)
                    block.pairs = block.verified = 0
                    found = block.answer(*unpack_rows(data.as_py(), dim, (np.int64, np.int64, np.float64)))
                    for name, total in tally.items():
                        total.add(getattr(block, name))
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["number", "query_id", "vec_id", "score"])

        if best is None:
            known = asked.select("number", "vec_id", F.lit(float("-inf")).alias("floor"), "v")
        else:
            least = best.groupBy("number").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("floor"))
            known = asked.join(least, "number", "left").select("number", "vec_id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "v")
        chunks = known.mapInArrow(ask, "cell long, kind int, data binary")
        rows = held.select("cell", F.lit(0).alias("kind"), "data").unionByName(chunks)
        dealt = rows.repartitionById(count, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind")
        found = dealt.select("cell", "kind", "data").mapInArrow(answer, "number long, query_id long, vec_id long, score double")
        # A query has at most k rows from each cell of the round.
        w = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
        both = found if best is None else best.drop("rank").unionByName(found)
        best = staged(both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "ann-best")
        lo, hi = hi, hi + GROWTH * (hi - lo)
    return best.select("query_id", "rank", "vec_id", "score")
