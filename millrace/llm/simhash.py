"""SimHash near-dedup by the generalised pigeonhole principle.

Bits that correlate are put into one partition. For a search radius r and m partitions,
any thresholds t_1..t_m (-1 skips a partition) with sum r - m + 1 are complete: two
fingerprints within r bits differ by at most t_i in some partition i. Each fingerprint
gets its own thresholds by dynamic programming on estimated candidate counts, probes the
buckets of those partitions, and candidates are verified on all bits.

Only links that connect are passed on: inside a bucket a spanning forest of the verified
pairs, so a bucket's output is at most its size. Buckets too large for one task are dealt
anew by midpoints: fingerprints are within 2 bits exactly if flips of at most one bit in
each meet, so each emits its own 65 midpoints and those that share one are linked. Hot
buckets so leave the pigeonhole, without losing a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged
from .components import components

BITS = 64
#: Histogram cells of each partition's values.
CELLS = 1 << 12
#: Rows of a bucket that one task verifies; larger ones go by midpoints.
BUCKET_ROWS = 512
#: Distinct fingerprints up to which three partitions are used; beyond it two, whose buckets stay small.
THREE_UP_TO = 1 << 22


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a whole text, as an unsigned 64-bit number."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = [b" ".join(w) for w in zip(*(words[i:] for i in range(shingle)), strict=False)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(p, 42) for p in parts]), np.uint8).reshape(-1, 8)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(make, "doc_id long, fp long")


def correlated_partitions(together: np.ndarray, ones: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits dealt into m partitions of near equal width, each grown by the bit most correlated with it."""
    p = ones / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = -(-len(left) // (m - k))
        free = sorted(left)
        group = [free[int(np.argmax(corr[np.ix_(free, free)].sum(1)))]]
        left.discard(group[0])
        while len(group) < width:
            free = sorted(left)
            group.append(free[int(np.argmax(corr[np.ix_(free, group)].sum(1)))])
            left.discard(group[-1])
        out.append(sorted(group))
    return out


def bits_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of some bits, packed in order."""
    out = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def cell_of(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of at most radius set bits."""
    out = [0]
    for r in range(1, radius + 1):
        if r == 1:
            out += [1 << i for i in range(width)]
        else:
            out += [(1 << i) | (1 << j) for i in range(width) for j in range(i)]
    return np.array(out, np.uint64)


def allocate(costs: np.ndarray, radius: int) -> np.ndarray:
    """Thresholds of least cost. costs (n, m, radius + 2): of thresholds -1, 0, .. radius in each partition.

    Dynamic programming over partitions and the sum of thresholds spent; the sum must be radius - m + 1.
    """
    n, m, options = costs.shape
    room = radius + 1  # sum of (threshold + 1) over all partitions
    best = np.full((n, room + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, n, room + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for t in range(options):
            for s in range(t, room + 1):
                c = best[:, s - t] + costs[:, i, t]
                better = c < new[:, s]
                new[better, s] = c[better]
                took[i, better, s] = t
        best = new
    out, s = np.zeros((n, m), np.int64), np.full(n, room)
    rows = np.arange(n)
    for i in reversed(range(m)):
        out[:, i] = took[i, rows, s]
        s = s - out[:, i]
    return out - 1


def forest(fps: np.ndarray, asks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what verified pairs connect. fps: distinct; pairs need one that asks."""
    out = []
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(asks):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = root(int(i)), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(i), int(j)))
    return out


def links(distinct: DataFrame, radius: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) of fingerprints that connect exactly what links of at most `radius` bits connect.

    distinct: a staged table with a column fp, each once. radius is 2: midpoints hold for no other.
    """
    if radius != 2:
        raise ValueError("only a radius of 2 is served")
    n = distinct.count()
    m = 3 if n <= THREE_UP_TO else 2

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            x = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["cell", "n"])

    fp = distinct.select("fp")
    together = np.zeros(BITS * BITS)
    for cell, count in fp.mapInArrow(statistics, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # 4096 rows
        together[cell] = count
    together = together.reshape(BITS, BITS)
    parts = correlated_partitions(together, np.diag(together).copy(), n, m)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, CELLS), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, bits in enumerate(parts):
                total[i] += np.bincount(cell_of(bits_of(fps, bits)), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * CELLS)), pa.array(total.ravel())], ["cell", "n"])

    histogram = np.zeros(m * CELLS)
    for cell, count in fp.mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # m * CELLS rows
        histogram[cell] = count
    histogram = histogram.reshape(m, CELLS)
    mean = np.maximum(n / CELLS, 1)
    balls = [[ball(len(bits), r) for r in range(radius + 1)] for bits in parts]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(every), 4096):
                fps = every[at : at + 4096]
                values = [bits_of(fps, bits) for bits in parts]
                costs = np.zeros((len(fps), m, radius + 2))
                for i in range(m):
                    for r in range(radius + 1):
                        near = cell_of(values[i][:, None] ^ balls[i][r])
                        # A cell's excess over the mean is taken for candidates; each probe costs a row.
                        costs[:, i, r + 1] = np.maximum(histogram[i][near] - mean, 0).sum(1) + 2 * len(balls[i][r])
                chosen = allocate(costs, radius)
                out = []
                for i in range(m):
                    out.append((i, values[i], fps, False))
                    for r in range(radius + 1):
                        mine = chosen[:, i] == r
                        if mine.any():
                            keys = values[i][mine][:, None] ^ balls[i][r]
                            out.append((i, keys.ravel(), np.repeat(fps[mine], keys.shape[1]), True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([(v | np.uint64(i << 40)).view(np.int64) for i, v, _, _ in out])),
                        pa.array(np.concatenate([f for _, _, f, _ in out]).view(np.int64)),
                        pa.array(np.concatenate([np.full(len(v), a) for _, v, _, a in out])),
                    ],
                    ["bucket", "fp", "asks"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(bucket: list[np.ndarray]) -> list[tuple[int, int]]:
            f, a = np.concatenate([x[0] for x in bucket]), np.concatenate([x[1] for x in bucket])
            if len(f) < 2:
                return []
            fps, at = np.unique(f, return_inverse=True)
            if len(fps) < 2:
                return []
            asks = np.zeros(len(fps), bool)
            np.logical_or.at(asks, at, a)
            return [(int(fps[i]), int(fps[j])) for i, j in forest(fps.view(np.uint64), asks, radius)]

        held: list = []
        last = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False)
            a = batch.column(2).to_numpy(zero_copy_only=False)
            found = []
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if key[lo] != last and held:
                    found += close(held)
                    held = []
                last = key[lo]
                if hi - lo > 1 or hi == len(key) or held or lo == 0:
                    held.append((f[lo:hi], a[lo:hi]))
            if found:
                u, v = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        if held and (found := close(held)):
            u, v = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(BITS, 1)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2048):
                some = fps[at : at + 2048]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((some[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(some, BITS + 1).view(np.int64))], ["mid", "fp"]
                )

    probes = staged(fp.mapInArrow(probe, "bucket long, fp long, asks boolean"), "simhash-probes", 8 * n)
    sizes = probes.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    hot = staged(sizes.where(F.col("n") > bucket_rows).select("bucket"), "simhash-hot", n // bucket_rows)
    small = probes.join(hot, "bucket", "left_anti")
    near = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "u long, v long")
    if hot.isEmpty():
        return near
    dense = staged(probes.join(hot, "bucket", "left_semi").select("fp").distinct(), "simhash-dense", n)
    meets = staged(dense.mapInArrow(midpoints, "mid long, fp long"), "simhash-midpoints")
    least = staged(
        meets.groupBy("mid").agg(F.min("fp").alias("v"), F.max("fp").alias("_top")).where(F.col("v") != F.col("_top")).select("mid", "v"),
        "simhash-stars",
        n,
    )
    stars = meets.join(least, "mid").where(F.col("fp") != F.col("v")).select(F.col("fp").alias("u"), "v").distinct()
    return near.unionByName(stars)


def near_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every document.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and hashed by
    `shingle`-word shingles, repeats included; a fingerprint bit is 1 if set in more
    than half of them. Documents link at `radius` or fewer differing bits.

    A null, empty or white text has fingerprint zero and links like any other; a text of
    fewer words is one shingle. Texts of any length are read whole. Repeated rows and
    equal texts share a fingerprint and so a component. A null doc_id keeps its row and
    names a component only where no other row does (then null). An empty table gives no
    rows; other columns are ignored.
    """
    rows = staged(fingerprints(docs, shingle), "simhash-rows")
    n = rows.count()
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct", n)
    roots = staged(components(links(distinct, radius)), "simhash-roots", n)
    named = staged(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-named", n
    )
    least = staged(named.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-least", n)
    ids = staged(named.join(least, "root").select("fp", "component_id"), "simhash-ids", n)
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
