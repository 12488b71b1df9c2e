"""Tables that change: merge, delete, sync plans, caches, stamps, statistics."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.versions import CommitLog
from millrace.session import written


def merge(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing with the rows of new in place of those with the same key."""
    return existing.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def delete_where_in(existing: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return existing.join(gone.select(key).distinct(), key, "left_anti")


def unknown(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key is not there yet."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def sync_plan(snapshot: DataFrame, state: DataFrame, restrict: DataFrame | None = None) -> DataFrame:
    """source_id and action (add, change, delete, keep) from one full outer join of hashes.

    A null hash (of null content) is a hash like any other: the document is there.
    restrict: only these source ids are looked at, as for a batch of changed files.
    """
    now = snapshot.select("source_id", F.col("content_hash").alias("now"), F.lit(True).alias("here"))
    was = state.select("source_id", F.col("content_hash").alias("was"), F.lit(True).alias("held"))
    if restrict is not None:
        ids = restrict.select("source_id").distinct()
        now, was = now.join(ids, "source_id", "left_semi"), was.join(ids, "source_id", "left_semi")
    action = F.when(F.col("held").isNull(), "add").when(F.col("here").isNull(), "delete").when(~F.col("now").eqNullSafe(F.col("was")), "change").otherwise("keep")
    return now.join(was, "source_id", "full_outer").select("source_id", action.alias("action"))


class Store:
    """A table by key that changes: a base in buckets, and small deltas with tombstones that are merged in when read.

    A write adds one delta folder and one commit (versions.CommitLog), so a row costs a
    small file however large the table is. Deltas hold at most DELTA_ROWS rows in all:
    beyond that, or after DELTAS of them, they are folded into the base, of which only
    the buckets that they touch are written anew. Reading takes the newest row of each
    key of the deltas and leaves the base rows of those keys out by a broadcast join,
    which the bound allows: the base isn't shuffled. Data is written before the commit
    that names it, so a writer that dies leaves the table as it was; of two that race
    one gets versions.Conflict. The commit before the last stays readable.

    Rows without a key aren't held. Of rows of one write that repeat a key one stays.

    by: a column that the key determines, by which the base is dealt into buckets and
    that of() looks up (the key itself by default).
    """

    #: Rows and numbers of deltas that are merged when read.
    DELTA_ROWS, DELTAS = 20_000, 16
    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, by: str | None = None) -> None:
        self.spark, self.path, self.schema, self.key, self.by = spark, path.rstrip("/"), schema, key, by or key
        self.log = CommitLog(spark, path)
        self._delta = f"{schema}, _gone boolean, _seq long"

    def _bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.BUCKETS)).cast("int")

    def _parquet(self, schema: str, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, deltas: DataFrame) -> DataFrame:
        """The last row of each key. Deltas that are read are few rows, so one task sees them all and nothing is shuffled."""
        rest = [c for c in deltas.columns if c != self.key]
        last = deltas.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct("_seq", ~F.col("_gone"), F.xxhash64(*rest))).alias("_last"))
        return last.select(self.key, "_last.*").select(*deltas.columns)

    def _merged(self, base: DataFrame, newest: DataFrame) -> DataFrame:
        return base.join(newest.select(self.key), self.key, "left_anti").select(*base.columns).unionByName(newest.where(~F.col("_gone")).select(*base.columns))

    def read(self) -> DataFrame:
        """The rows of the last commit."""
        _, now = self.log.latest()
        base = self._parquet(self.schema, list(now.get("base", {}).values()))
        return self._merged(base, F.broadcast(self._newest(self._parquet(self._delta, now["deltas"]).coalesce(1)))) if now.get("deltas") else base  # at most DELTA_ROWS

    def of(self, value: Any) -> DataFrame:
        """The rows whose `by` is value: of the base, its bucket alone is read."""
        _, now = self.log.latest()
        bucket = str(self.spark.range(1).select(self._bucket(F.lit(value).cast(self._type()))).first()[0])
        base = self._parquet(self.schema, [f for b, f in now.get("base", {}).items() if b == bucket])
        if now.get("deltas"):
            base = self._merged(base, F.broadcast(self._newest(self._parquet(self._delta, now["deltas"]).coalesce(1))))  # at most DELTA_ROWS
        return base.where(F.col(self.by) == value)

    def _type(self) -> str:
        return self.spark.createDataFrame([], self.schema).schema[self.by].dataType.simpleString()

    def apply(self, rows: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """In one commit remove the keys of gone, then put rows in place of those of the same key. The number of rows of the delta."""
        number, now = self.log.latest()
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        names = [f.name for f in fields]
        cast = lambda column, f: column.cast(f.dataType).alias(f.name)
        parts = []
        if gone is not None:
            parts.append(gone.select(self.key).distinct().select(*[cast(F.col(f.name) if f.name == self.key else F.lit(None), f) for f in fields], F.lit(True).alias("_gone")))
        if rows is not None:
            parts.append(rows.select(*[cast(F.col(f.name), f) for f in fields], F.lit(False).alias("_gone")))
        delta = reduce(DataFrame.unionByName, parts).where(F.col(self.key).isNotNull()).withColumn("_seq", F.lit(number + 1).cast("long"))
        folder = self.log.folder("delta")
        # Dealt out by size: a few rows are one file, many are as many as they fill.
        delta.select(*names, "_gone", "_seq").hint("rebalance").write.parquet(f"{self.path}/{folder}")
        n = self._parquet(self._delta, [folder]).count()
        if n:
            deltas, held = [*now.get("deltas", ()), folder], now.get("delta_rows", 0) + n
            if held > self.DELTA_ROWS or len(deltas) > self.DELTAS:
                self._fold(number, now, deltas, held)
            else:
                self._put(number + 1, now.get("base", {}), deltas, held, now)
        return n

    def compact(self) -> None:
        """Fold the deltas into the base."""
        number, now = self.log.latest()
        if now.get("deltas"):
            self._fold(number, now, now["deltas"], now["delta_rows"])

    def _fold(self, number: int, now: dict, deltas: list[str], rows: int) -> None:
        """A new base: the buckets that the deltas touch are written anew, the others stay where they are."""
        base, newest = now.get("base", {}), written(self._newest(self._parquet(self._delta, deltas)), "store-newest")
        near = F.broadcast(newest) if rows <= self.DELTA_ROWS else newest
        if self.by == self.key:
            touched = {str(r[0]) for r in newest.select(self._bucket(F.col(self.by)).alias("b")).distinct().collect()}  # at most BUCKETS
        else:  # a tombstone knows its key alone
            touched = {str(r[0]) for r in newest.where(~F.col("_gone")).select(self._bucket(F.col(self.by))).distinct().collect()}
            held = self._parquet(self.schema, list(base.values())).join(near.where("_gone").select(self.key), self.key, "left_semi")
            touched |= {str(r[0]) for r in held.select(self._bucket(F.col(self.by))).distinct().collect()}
        old = self._parquet(self.schema, [f for b, f in base.items() if b in touched])
        folder = self.log.folder("base")
        out = self._merged(old, near).withColumn("bucket", self._bucket(F.col(self.by)))
        out.repartitionByRange("bucket", self.by).sortWithinPartitions("bucket", self.by).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        made = {x.split("=")[1]: f"{folder}/{x}" for x in self.log.names(f"{folder}/bucket=*")}
        self._put(number + 1, {b: f for b, f in base.items() if b not in touched} | made, [], 0, now)

    def _put(self, number: int, base: dict[str, str], deltas: list[str], rows: int, before: dict) -> None:
        content = {"base": base, "deltas": deltas, "delta_rows": rows, "folders": [*base.values(), *deltas]}
        self.log.put(number, content)
        self.log.forget(number - 1, {*content["folders"], *before.get("folders", ())})

    def vacuum(self) -> int:
        """Remove folders that no kept commit names: what lost writers left. Only while nobody writes; their number."""
        named = {f.split("/")[0] for n in self.log.numbers() for f in self.log.read(n)["folders"]}
        lost = [x for kind in ("base-*", "delta-*") for x in self.log.names(kind) if x not in named]
        for x in lost:
            self.log.remove(x)
        return len(lost)

    def write(self, rows: DataFrame) -> None:
        """Replace the whole table."""
        number, now = self.log.latest()
        fields = self.spark.createDataFrame([], self.schema).schema.fields
        names = [f.name for f in fields]
        delta = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields], F.lit(False).alias("_gone"), F.lit(number + 1).cast("long").alias("_seq")).where(F.col(self.key).isNotNull())
        folder = self.log.folder("base")
        out = self._newest(delta).select(*names).withColumn("bucket", self._bucket(F.col(self.by)))
        out.repartitionByRange("bucket", self.by).sortWithinPartitions("bucket", self.by).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        self._put(number + 1, {x.split("=")[1]: f"{folder}/{x}" for x in self.log.names(f"{folder}/bucket=*")}, [], 0, now)

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in place of those with the same key; how many."""
        return self.apply(rows)

    def delete(self, gone: DataFrame, key: str | None = None) -> int:
        """Remove the rows whose key (or another column) is among gone; how many there were."""
        key = key or self.key
        held = self.read().join(gone.select(key).distinct(), key, "left_semi").select(self.key)
        return self.apply(gone=held)

    def recreate(self) -> None:
        self.write(self.spark.createDataFrame([], self.schema))


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks (key, …) with the cached context and whether it hit; blank contexts don't count."""
    known = cache.where(F.trim("context") != "").select("key", "context")
    return chunks.join(known, "key", "left").withColumn("hit", F.col("context").isNotNull())


def write_stamp(spark: SparkSession, path: str, model: str, dim: int, quantised: bool) -> None:
    """Say beside an index with what it was built; written once, by the first to build it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_stamp.json")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(json.dumps({"embed_model": model, "embed_dim": dim, "binary_quantization": quantised}).encode()))
    out.close()


def read_stamp(spark: SparkSession, path: str) -> dict | None:
    """What write_stamp left at path; None if nothing."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_stamp.json")
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    data = fs.open(at)
    try:
        return json.loads(bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(data)))
    finally:
        data.close()


def check_stamp(stamp: dict | None, model: str, dim: int, quantised: bool) -> None:
    """Raise if an index was built with another model, dimension or quantisation."""
    want = {"embed_model": model, "embed_dim": dim, "binary_quantization": quantised}
    bad = {k: (stamp[k], v) for k, v in want.items() if stamp is not None and stamp.get(k) != v}
    if bad:
        raise ValueError(f"index is not compatible: {bad}")


def migrate(version: int, steps: dict[int, Callable[[], None]], done: Callable[[int], None] = lambda version: None) -> int:
    """Run the steps beyond a version in order, tell `done` after each, and return the version reached.

    A step that fails stops the run; those before it are done and aren't run again.
    """
    for target in sorted(steps):
        if target > version:
            steps[target]()
            done(target)
            version = target
    return version


def distinct_sources(chunks: DataFrame) -> DataFrame:
    """source_id of every source that has chunks, in order."""
    return chunks.select("source_id").where(F.col("source_id").isNotNull()).distinct().orderBy("source_id")


def index_stats(chunks: DataFrame, state_sources: DataFrame, state_chunks: DataFrame) -> DataFrame:
    """One row: points, sources, state_sources, state_chunks and drift."""
    a = chunks.agg(F.count("*").alias("points"), F.countDistinct("source_id").alias("sources"))
    b, c = state_sources.agg(F.count("*").alias("state_sources")), state_chunks.agg(F.count("*").alias("state_chunks"))
    one = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").join(c.withColumn("one", F.lit(1)), "one")
    return one.withColumn("drift", F.abs(F.col("points") - F.col("state_chunks"))).drop("one")
