"""Vector code compression: product quantisation in integers, searched by vantage-point trees.

Components become integers; vectors are cut into parts, and every part position has a
codebook of its own. A part's nearest entry is found in a vantage-point tree over the
entries: a branch is left out only if the triangle inequality, with radii rounded
outwards, shows that nothing in it can be as near as the best so far; every distance
that decides is one of integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Parts of a vector, entries of a codebook, rounds that move the entries, and integer steps in one.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components are held to this many bits, so that no sum of squares leaves 63.
COMPONENT_BITS = 26
#: Components of a part at most, for the same reason.
PART_WIDTH = 512
#: A label with more than one of HOT rows in this many is joined apart: there are fewer than HOT of those.
HOT = 64


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Node:
    """A vantage point (an entry's number) and the entries nearer to it and farther from it, each with a shell that holds them."""

    at: int
    branches: list[tuple[float, float, Node]]  # least and greatest distance from the vantage point, rounded outwards


def build(entries: np.ndarray, which: list[int] | None = None) -> Node:
    """A tree over integer rows. The vantage point is the entry whose distances to the others spread the most."""
    which = list(range(len(entries))) if which is None else which
    apart = [np.sqrt(squared(entries[which], entries[w]).astype(np.float64)) for w in which]
    best = max(range(len(which)), key=lambda i: (apart[i].std(), -which[i]))
    rest = [(d, w) for w, d in zip(which, apart[best], strict=True) if w != which[best]]
    rest.sort()
    half = (len(rest) + 1) // 2
    branches = []
    for side in (rest[:half], rest[half:]):
        if side:
            low, high = np.array(side[0][0]), np.array(side[-1][0])
            branches.append((float(_down(low)), float(_up(high)), build(entries, [w for _, w in side])))
    return Node(which[best], branches)


def nearest(tree: Node, entries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each integer row the nearest entry's number and squared distance, ties to the lower number; and how many distances were taken.

    All rows walk the tree together, each with its own bound: the branch whose shell is
    nearer to a row comes first for that row.
    """
    number = np.full(len(rows), len(entries), np.int64)
    best = np.full(len(rows), np.iinfo(np.int64).max)
    taken = 0

    def visit(node: Node, at: np.ndarray) -> None:
        nonlocal taken
        d2 = squared(rows[at], entries[node.at])
        taken += len(at)
        nearer = (d2 < best[at]) | ((d2 == best[at]) & (node.at < number[at]))
        won = at[nearer]
        best[won], number[won] = d2[nearer], node.at
        if not node.branches:
            return
        d = np.sqrt(d2.astype(np.float64))
        low, high = _down(d), _up(d)
        # A lower bound of the distance to anything in each branch's shell.
        bounds = [np.maximum(np.maximum(_down(low - far), _down(near - high)), 0) for near, far, _ in node.branches]
        first = bounds[0] <= bounds[-1]
        for mine in (first, ~first):
            if mine.any():
                order = range(len(bounds)) if mine is first else reversed(range(len(bounds)))
                for b in order:
                    go = at[mine]
                    # Not strict: an equal distance may belong to a lower number.
                    go = go[_down(bounds[b][mine] ** 2) <= _up(best[go].astype(np.float64))]
                    if len(go):
                        visit(node.branches[b][2], go)

    if len(rows) and len(entries):
        visit(tree, np.arange(len(rows)))
    return number, best, taken


@dataclass
class Codebooks:
    """One codebook for each part position: entries x width integers."""

    entries: np.ndarray  # part x entry x width

    def __post_init__(self):
        self.trees = [build(e) for e in self.entries]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (row x part) and squared distances (row x part) of integer vectors."""
        parts = rows.reshape(len(rows), *self.entries.shape[::2])
        found = [nearest(t, e, parts[:, p]) for p, (t, e) in enumerate(zip(self.trees, self.entries, strict=True))]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), held to COMPONENT_BITS bits."""
    most = 1 << COMPONENT_BITS
    return np.clip(np.floor(flat.astype(np.float64) * scale), -most, most - 1).astype(np.int32)


def usable(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """Rows whose vector can be compressed, and their dimension: no null or non-finite component, and the commonest dimension that parts divide."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & finite)
    size = F.size("embedding")
    fits = kept.where((size > 0) & (size % parts == 0) & (size <= parts * PART_WIDTH))
    most = fits.groupBy(size.alias("size")).count().orderBy(F.desc("count"), "size").first()
    width = most["size"] if most else 0
    return kept.where(size == width), width


def fit(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks over staged integer rows: each starts as the parts of the rows with the smallest ids, and every round replaces entries by floored means.

    A task adds up the parts of its rows by entry; what comes to the driver is one row of
    sums for each part and entry, whatever the number of vectors.
    """
    spark = rows.sparkSession
    first = rows.orderBy("vec_id", "ints").limit(entries).collect()
    start = np.stack([np.frombuffer(r["ints"], np.int32) for r in first]).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width // parts).transpose(1, 0, 2)))
    n = books.entries.shape[1]
    shape = "part int, entry int, rows long, sums array<long>"
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(books.entries)  # parts x entries x width integers

        def add(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            own = Codebooks(known.value)
            count = np.zeros((parts, n), np.int64)
            total = np.zeros((parts, n, width // parts), np.int64)
            for batch in batches:
                x = _unpacked(batch.column(0), width)
                codes, _ = own.assign(x)
                pieces = x.reshape(len(x), parts, -1)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=n)
                    np.add.at(total[p], codes[:, p], pieces[:, p])
            at = np.argwhere(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[tuple(at.T)]), pa.array([total[p, e].tolist() for p, e in at], pa.list_(pa.int64()))],
                ["part", "entry", "rows", "sums"],
            )

        parted = rows.select("ints").mapInArrow(add, shape).select("part", "entry", "rows", F.posexplode("sums").alias("at", "sum"))
        means = parted.groupBy("part", "entry", "at").agg(F.sum("rows").alias("rows"), F.sum("sum").alias("sum")).collect()
        moved = books.entries.copy()
        for r in means:
            moved[r["part"], r["entry"], r["at"]] = r["sum"] // r["rows"]
        known.unpersist()
        books = Codebooks(moved)
    return books


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)


def with_sums_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df, staged, with the sum of value over rows of equal key; nulls are one key.

    Sums are added up before the shuffle. Keys that hold more than one row in HOT are
    fewer than HOT, so their sums are broadcast; the rows of all other keys are joined by
    a shuffle, in which no key is hot.
    """
    sums = staged(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(value).alias(name)), "codes-labels")
    total = sums.agg(F.sum("_rows")).first()[0] or 0
    hot = sums.where(F.col("_rows") * HOT > total)
    marked = df.join(F.broadcast(hot.select("_key", F.col("_rows").alias("_hot"), F.col(name).alias("_sum"))), F.col(key).eqNullSafe(F.col("_key")), "left")
    here = marked.where(F.col("_hot").isNotNull()).select(*df.columns, F.col("_sum").alias(name))
    cold = sums.where(F.col("_rows") * HOT <= total).select("_key", name)
    there = marked.where(F.col("_hot").isNull()).select(*df.columns).join(cold.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("_key"))).select(*df.columns, name)
    return here.union(there)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, keep: tuple[str | Column, ...] = ()) -> tuple[DataFrame, Codebooks | None]:
    """Codes of the vectors in the column embedding, by vec_id, and the codebooks.

    Rows: vec_id, the columns of keep, code (a number for each part, two hex digits each)
    and error (squared integer distances to the entries, summed over parts), staged.

    A null vector, and one with a null or non-finite component, is left out, as is one of
    another dimension than the commonest that parts divide (ties to the smaller; at most
    PART_WIDTH times parts). Integer components are held to COMPONENT_BITS bits (with
    SCALE, values beyond 16,384 count as that). Fewer vectors than entries start as many
    codebook entries as there are vectors; rows of a repeated vec_id count each, in the
    order of their integers. Entries that no part is nearest to stay. Without a usable
    vector there are no rows and no codebooks. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    spark = vectors.sparkSession
    small_batches(spark)
    named = vectors.select("vec_id", "embedding", *keep)
    kept = named.columns[2:]
    good, width = usable(named, parts)
    slim = good.select("vec_id", *kept, "embedding")
    types = [slim.schema[c] for c in ("vec_id", *kept)]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in types)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False), scale)
            ints = [row.tobytes() for row in x.reshape(-1, width)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ints, pa.binary())], [*batch.schema.names[:-1], "ints"])

    out = f"{shape}, code string, error long"
    if not width:
        return spark.createDataFrame([], out), None
    rows = staged(slim.mapInArrow(turn, f"{shape}, ints binary"), "codes-ints")
    books = fit(rows, width, parts, entries, rounds)
    known = spark.sparkContext.broadcast(books.entries)  # parts x entries x width integers

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codebooks(known.value)
        for batch in batches:
            codes, d2 = own.assign(_unpacked(batch.column(batch.num_columns - 1), width))
            text = [c.tobytes().hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array(d2.sum(1), pa.int64())], [*batch.schema.names[:-1], "code", "error"])

    return staged(rows.mapInArrow(encode, out), "codes"), books


def compress_by_label(vectors: DataFrame) -> DataFrame:
    """compress() with the error of each label: vec_id, code, error, label_error and codebooks_sha256."""
    codes, books = compress(vectors, keep=("label",))
    out = with_sums_by(codes, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
