"""A stored vector index: vectors and sign codes in blocks, bucketed by coarse centroids.

Centroids are fitted once, on a bounded sample; each vector is kept with its nearest two,
so that a query that reads a part of the buckets finds most neighbours near their
borders. Buckets are folders, so a search reads those that its queries probe. Upserts and
deletes add segments without a new fit; probing all buckets is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from millrace.operators import search
from millrace.operators.versions import CommitLog
from millrace.session import fresh_path, small_batches, until_exit, written

#: Vectors that centroids are fitted on, at most; all of fewer.
SAMPLE_ROWS = 20_000
#: Vectors for each centroid of the first upsert, and centroids at least and at most.
PER_CELL, LEAST_CELLS, MOST_CELLS = 16, 8, 1024
#: Nearest centroids that hold a vector, and the share of centroids that a query probes.
COPIES, PROBES = 2, 0.3
#: Vectors of a stored block, and queries that meet it at once.
BLOCK, QUERIES = 1024, 256
#: Packed query rows up to which they are broadcast (each up to QUERIES vectors); more are shuffled to the blocks.
FEW_PACKS = 64
#: Rows and bytes of one side of a tile when all pairs are multiplied, and packs of them that a task holds in memory.
PACK_ROWS, PACK_BYTES, PACKS_HELD = 2048, 1 << 20, 16


def fit_centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """Spherical k-means: unit centroids; ties go to the first."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    c = unit[rng.choice(len(unit), min(cells, len(unit)), replace=False)]
    for _ in range(rounds):
        near = (unit @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, unit)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def signs(x: np.ndarray) -> np.ndarray:
    """Sign bits of rows, packed into 64-bit words; the last word is filled up with zeros."""
    bits = np.packbits(x > 0, axis=1)
    wide = -(-x.shape[1] // 64) * 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, wide - bits.shape[1])))).view(np.uint64)


def _whole(vectors: DataFrame) -> DataFrame:
    """id and v of vectors without null or non-finite components, the greatest one of each id."""
    good = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return good.groupBy("id").agg(F.max("v").alias("v"))


def _commonest(vectors: DataFrame) -> tuple[int, int]:
    """The commonest dimension, and the number of its vectors."""
    most = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return (most["dim"], most["count"]) if most else (0, 0)


@dataclass
class VectorIndex:
    """An index at a path. One writer at a time; of two that race one gets versions.Conflict.

    By segment folder: blocks (cell, block, ids, codes, vectors; a folder for each cell)
    and gone (block, local: rows of earlier segments that this one replaces or deletes).
    The commit holds the centroids, dimension and number of vectors.
    """

    spark: SparkSession
    path: str
    id_type: DataType
    log: CommitLog = field(init=False)

    def __post_init__(self) -> None:
        self.log = CommitLog(self.spark, self.path)
        self._kind = self.id_type.simpleString()
        self._blocks = f"cell int, block long, ids array<{self._kind}>, codes binary, vectors binary"
        self._gone = "block long, local int"

    @classmethod
    def open(cls, spark: SparkSession, id_type: DataType, path: str | None = None) -> VectorIndex:
        """The index at a path; without one a new index in the shared folder until the driver ends."""
        if path is None:
            path = fresh_path(spark, "vectors")
            until_exit(spark, path)
        return cls(spark, path, id_type)

    def _read(self, kind: str, schema: str, *columns: str) -> DataFrame:
        _, now = self.log.latest()
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{kind}") for s in now.get("folders", ()) if kind in now["tables"][s]]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select(*columns) if columns else out

    def blocks(self) -> DataFrame:
        return self._read("blocks", self._blocks)

    def gone(self) -> DataFrame:
        return self._read("gone", self._gone)

    def size(self) -> int:
        return self.log.latest()[1].get("rows", 0)

    def centroids(self) -> np.ndarray:
        return np.array(self.log.latest()[1]["centroids"])

    def live(self) -> DataFrame:
        """cell, block, local and id of every copy of a vector that is there."""
        every = self._read("blocks", self._blocks, "cell", "block", F.posexplode("ids").alias("local", "id"))
        return every.join(self.gone(), ["block", "local"], "left_anti")

    # Writing

    def upsert(self, vectors: DataFrame) -> int:
        """Put vectors (id, v) in place of those of the same id; their number.

        Null vectors and ids are left out, as are vectors with a null or non-finite
        component or of another dimension than the index's (the commonest of the first
        upsert). Of rows that repeat an id the greatest vector stays.
        """
        number, now = self.log.latest()
        good = _whole(vectors)
        if not now:
            good = written(good, "vectors-first")
            dim, n = _commonest(good)
            if not n:
                return 0
            sample = good.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()
            cells = min(max(n // PER_CELL, LEAST_CELLS), MOST_CELLS)
            now = {"dim": dim, "centroids": fit_centroids(np.array([r["v"] for r in sample]), cells).tolist()}
        return self._commit(number, now, good.where(F.size("v") == now["dim"]), None)

    def delete(self, ids: DataFrame) -> int:
        """Remove vectors by id; the number that were there."""
        number, now = self.log.latest()
        return self._commit(number, now, None, ids) if now else 0

    def _commit(self, number: int, now: dict, rows: DataFrame | None, ids: DataFrame | None) -> int:
        folder, tables, n = self.log.folder("seg"), [], 0
        at = f"{self.path}/{folder}"
        if rows is not None:
            self._packed(rows, now, number + 1).write.partitionBy("cell").parquet(f"{at}/blocks")
            made = self.spark.read.schema(self._blocks).parquet(f"{at}/blocks")
            ids = made.select(F.explode("ids").alias("id")).distinct()
            n = ids.count()
            tables.append("blocks")
        dead = 0
        if now.get("rows"):
            gone = written(self.live().join(ids.select("id").distinct(), "id", "left_semi").select("id", "block", "local"), "vectors-gone")
            dead = gone.select("id").distinct().count()
            if dead:
                gone.select("block", "local").write.parquet(f"{at}/gone")
                tables.append("gone")
        if not n and not dead:
            return 0
        folders = [*now.get("folders", ()), folder]
        content = {"dim": now["dim"], "centroids": now["centroids"], "folders": folders, "tables": now.get("tables", {}) | {folder: tables}, "rows": now.get("rows", 0) + n - dead}
        self.log.put(number + 1, content)
        self.log.forget(number, set(folders))
        return n if rows is not None else dead

    def _packed(self, rows: DataFrame, now: dict, number: int) -> DataFrame:
        """Blocks of rows (id, v), each vector with its nearest centroids.

        Rows are dealt by cell and a hash of the id, so that a cell that holds many of
        them is many tasks' work; a task packs its rows cell by cell.
        """
        c = self.spark.sparkContext.broadcast(np.array(now["centroids"]))  # at most MOST_CELLS
        copies, kind = min(COPIES, len(now["centroids"])), self._kind
        id_arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                    near = np.argsort(-(x @ c.value.T), axis=1, kind="stable")[:, :copies]
                    take = pa.array(np.repeat(np.arange(batch.num_rows), copies))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["cell", "id", "v"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            base, made = (number << 44) + (TaskContext.get().partitionId() << 22), 0

            def block(cell: int, rows: pa.Table) -> pa.RecordBatch:
                rows = rows.sort_by("id")
                x = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
                ids = pa.array([rows["id"].to_pylist()], pa.list_(id_arrow))
                return pa.RecordBatch.from_arrays(
                    [pa.array([cell], pa.int32()), pa.array([base + made], pa.int64()), ids, pa.array([signs(x).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())],
                    ["cell", "block", "ids", "codes", "vectors"],
                )

            held, cell = [], None
            for batch in batches:  # sorted by cell
                cells = batch.column(0).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else []
                for lo, hi in zip(edges, edges[1:], strict=False):
                    if held and (cells[lo] != cell or sum(map(len, held)) >= BLOCK):
                        yield block(cell, pa.concat_tables(held))
                        held, made = [], made + 1
                    cell = int(cells[lo])
                    held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
            if held:
                yield block(cell, pa.concat_tables(held))

        small_batches(self.spark)
        placed = rows.select("id", "v").mapInArrow(assign, f"cell int, id {kind}, v array<double>")
        placed = placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
        return placed.mapInArrow(pack, self._blocks)

    # Searching

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, quantised: bool = False, oversampling: float = 2.0, digits: int | None = None) -> DataFrame:
        """The k vectors of largest inner product for each query (query_id, v): query_id, rank, id, score.

        Each query meets the blocks of the `probes` cells whose centroids are nearest
        (PROBES of all by default), or of all with exact. quantised: the oversampling * k
        nearest by sign bits are scored. Ties go to the smaller id; digits: scores are
        rounded before they are ranked. Queries stay in the cluster: they are packed
        where they lie and joined to the blocks of their cells; a few packs, by count,
        are broadcast. Queries without a whole vector of the index's dimension have no hits.
        """
        _, now = self.log.latest()
        out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {self._kind}, score double"
        if not now.get("rows"):
            return search.ranked(self.spark.createDataFrame([], out), k)
        cells = len(now["centroids"])
        packs = written(self._packs(queries, now, cells if exact else min(probes or math.ceil(PROBES * cells), cells)), "vectors-queries")
        wide = math.ceil(oversampling * k) if quantised else k
        columns = ["codes" if quantised else "vectors"]
        pairs = self._pairs(packs, columns)
        found = pairs.mapInArrow(self._scorer(out, wide, quantised, None if quantised else digits), out)
        once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))  # a vector is in several cells
        if not quantised:
            return search.ranked(once, k)
        near = search.ranked(once, wide).select("query_id", "id")
        dot = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        q = queries.select("query_id", F.col("v").cast("array<double>").alias("_q"))
        ids = near.select("id").distinct()
        scored = near.join(q, "query_id").join(self.vectors().join(search.small_side(written(ids, "vectors-near")), "id", "left_semi").withColumnRenamed("v", "_v"), "id")
        return search.ranked(scored.select("query_id", "id", (dot if digits is None else F.round(dot, digits)).alias("score")), k)

    def vectors(self) -> DataFrame:
        """id and v of every vector that is there, once each."""
        dim, kind = self.log.latest()[1]["dim"], self._kind

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(data)
                    n = len(x) // dim
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x))],
                        ["block", "local", "v"],
                    )

        small_batches(self.spark)
        x = self._read("blocks", self._blocks, "block", "vectors").mapInArrow(unpack, "block long, local int, v array<double>")
        return self.live().join(x, ["block", "local"]).groupBy("id").agg(F.first("v").alias("v")).select(F.col("id").cast(kind).alias("id"), "v")

    def _packs(self, queries: DataFrame, now: dict, probes: int) -> DataFrame:
        """Rows (cell, ids, vectors) of at most QUERIES queries that probe a cell; a task holds one such row a cell."""
        c, dim = self.spark.sparkContext.broadcast(np.array(now["centroids"])), now["dim"]  # at most MOST_CELLS
        kind = queries.schema["query_id"].dataType.simpleString()
        id_arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = len(c.value)
            ids: list[list] = [[] for _ in range(cells)]
            vectors: list[list] = [[] for _ in range(cells)]

            def row(cell: int) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays(
                    [pa.array([cell], pa.int32()), pa.array([ids[cell]], pa.list_(id_arrow)), pa.array([b"".join(vectors[cell])], pa.binary())], ["cell", "queries", "asked"]
                )
                ids[cell], vectors[cell] = [], []
                return out

            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                near = np.argsort(-(x @ c.value.T), axis=1, kind="stable")[:, :probes]
                for q, v, mine in zip(batch.column(0).to_pylist(), x, near.tolist(), strict=True):
                    data = v.tobytes()
                    for cell in mine:
                        ids[cell].append(q)
                        vectors[cell].append(data)
                        if len(ids[cell]) == QUERIES:
                            yield row(cell)
            for cell in range(cells):
                if ids[cell]:
                    yield row(cell)

        small_batches(self.spark)
        good = queries.select("query_id", F.col("v").cast("array<double>").alias("v")).where(F.size("v") == dim)
        good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        return good.mapInArrow(pack, f"cell int, queries array<{kind}>, asked binary")

    def _pairs(self, packs: DataFrame, columns: list[str]) -> DataFrame:
        """Blocks beside the packs of queries that probe their cell, and the rows of the block that are gone."""
        cells = sorted(r["cell"] for r in packs.select("cell").distinct().collect())  # at most MOST_CELLS
        blocks = self._read("blocks", self._blocks, "cell", "block", "ids", *columns).where(F.col("cell").isin(cells))  # whole folders are left out
        dead = self.gone().groupBy("block").agg(F.collect_list("local").alias("dead"))  # at most a block's rows
        blocks = blocks.join(search.small_side(dead), "block", "left")
        if packs.count() <= FEW_PACKS:
            return blocks.join(F.broadcast(packs), "cell")  # at most FEW_PACKS times QUERIES vectors
        # By cell and block, so that a cell of many vectors is many keys.
        where = self._read("blocks", self._blocks, "cell", "block").where(F.col("cell").isin(cells))
        return packs.join(search.small_side(where), "cell").join(blocks, ["cell", "block"])

    def _scorer(self, schema: str, k: int, quantised: bool, digits: int | None):
        dim = self.log.latest()[1]["dim"]
        id_arrow = pa.string() if self._kind == "string" else pa.int32() if self._kind == "int" else pa.int64()
        q_kind = schema.split(",")[0].split(" ")[1]
        q_arrow = pa.string() if q_kind == "string" else pa.int32() if q_kind == "int" else pa.int64()
        data = "codes" if quantised else "vectors"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = {name: batch.column(name) for name in ("ids", data, "dead", "queries", "asked")}
                for i in range(batch.num_rows):
                    ids, queries = at["ids"][i].as_py(), at["queries"][i].as_py()
                    q = np.frombuffer(at["asked"][i].as_py()).reshape(len(queries), dim)
                    if quantised:
                        x = np.frombuffer(at[data][i].as_py(), np.uint64).reshape(len(ids), -1)
                        mine = signs(q)
                        s = -sum(np.bitwise_count(mine[:, None, w] ^ x[None, :, w]).astype(np.float64) for w in range(x.shape[1]))
                    else:
                        s = q @ np.frombuffer(at[data][i].as_py()).reshape(len(ids), dim).T
                        s = s if digits is None else np.round(s, digits)
                    dead = at["dead"][i].as_py()
                    if dead:
                        s[:, dead] = -np.inf
                    r, j = search.best_of(s, k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([queries[x] for x in r], q_arrow), pa.array([ids[x] for x in j], id_arrow), pa.array(s[r, j])], ["query_id", "id", "score"]
                    )

        return run


def similarity_graph(
    vectors: DataFrame, k: int = 5, at_least: float = 0.5, id_col: str = "vec_id", vec_col: str = "embedding", digits: int | None = None, exact: bool = True
) -> DataFrame:
    """Edges (src, dst, score) from each vector to its k nearest others whose inner product reaches at_least.

    Exact, all pairs are multiplied in tiles (nearest_pairs), which is quadratic in time
    alone. Else all vectors are queries of an index of themselves and each meets the
    cells near it, which is what large tables need. No vector passes the driver.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    if exact:
        found = nearest_pairs(rows, k + 1, at_least, digits)
    else:
        index = VectorIndex.open(vectors.sparkSession, rows.schema["id"].dataType)
        index.upsert(rows)
        found = index.search(index.vectors().withColumnRenamed("id", "query_id"), k + 1, digits=digits)
    found = found.where("query_id <> id")
    return search.ranked(found, k).where(F.col("score") >= at_least).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")


def nearest_pairs(vectors: DataFrame, k: int, at_least: float, digits: int | None = None) -> DataFrame:
    """The k vectors of largest inner product for each vector (id, v), itself counted, of those that reach at_least: query_id, rank, id, score.

    Vectors are packed once; packs meet packs by a Cartesian product of partitions. A task
    holds one tile and the k best so far of the pack that it is at, so memory and what is
    shuffled don't grow with the number of pairs. Vectors are left out as by VectorIndex.upsert.
    """
    spark = small_batches(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()
    out = f"query_id {kind}, id {kind}, score double"
    good = written(_whole(vectors), "graph-vectors")
    dim, n = _commonest(good)
    if not n:
        return search.ranked(spark.createDataFrame([], out), k)
    wide = max(1, min(PACK_ROWS, PACK_BYTES // (8 * dim)))
    id_arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, held = TaskContext.get().partitionId() << 32, []

        def row(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by("id")
            data = table["v"].combine_chunks().flatten().to_numpy().tobytes()
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([table["id"].to_pylist()], pa.list_(id_arrow)), pa.array([data], pa.binary())], ["pack", "ids", "x"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= wide:
                whole = pa.Table.from_batches(held)
                yield row(whole.slice(0, wide))
                made, held = made + 1, whole.slice(wide).to_batches()
        if sum(b.num_rows for b in held):
            yield row(pa.Table.from_batches(held))

    packs = written(good.where(F.size("v") == dim).mapInArrow(pack, f"pack long, ids array<{kind}>, x binary"), "graph-packs")
    n = packs.count()
    cores = spark.sparkContext.defaultParallelism
    left = packs.toDF("pack", "asked", "q").repartition(min(n, max(3 * cores, n // PACKS_HELD)))
    right = packs.select("ids", "x").repartition(-(-n // PACKS_HELD))  # so many are held in memory beside one
    margin = 0.0 if digits is None else 10.0**-digits

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None

        def done() -> pa.RecordBatch:
            row, ids, s = best
            return pa.RecordBatch.from_arrays([pa.array(asked[row].tolist(), id_arrow), pa.array(ids.tolist(), id_arrow), pa.array(s)], ["query_id", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column(0)[i].as_py() != at:
                    if best:
                        yield done()
                    at, asked = batch.column(0)[i].as_py(), search._ids(batch.column(1)[i].values)
                    q = np.frombuffer(batch.column(2)[i].as_buffer()).reshape(len(asked), dim).copy()
                    least, best = np.full(len(asked), at_least), (np.zeros(0, int), asked[:0], np.zeros(0))
                ids = search._ids(batch.column(3)[i].values)
                s = q @ np.frombuffer(batch.column(4)[i].as_buffer()).reshape(len(ids), dim).T
                row, j = np.nonzero(s >= least[:, None] - margin)
                found = s[row, j] if digits is None else np.round(s[row, j], digits)
                best = tuple(np.concatenate(x) for x in zip(best, (row, ids[j], found), strict=True))
                row, near, found = best
                order = np.lexsort((near, -found, row))
                row, near, found = row[order], near[order], found[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = (place < k) & (found >= at_least)
                last = place == k - 1
                least[row[last]] = np.maximum(found[last], at_least)
                best = row[keep], near[keep], found[keep]
        if best:
            yield done()

    return search.ranked(left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(score, out), k)
