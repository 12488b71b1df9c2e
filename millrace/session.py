"""Session set-up and helpers shared by every subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def get_spark(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow transfer."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


#: Bytes of a table under which its rows are not worth dealing out.
SPREAD_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder.

    A table that Spark would read in fewer tasks than there are cores (one file with one
    row group) is dealt out once; larger tables have splits enough and are read as they lie.
    """
    path = f"{sf_dir}/{name}.parquet"
    df, sc = spark.read.parquet(path), spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    cores = sc.defaultParallelism
    if size > SPREAD_BYTES and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df


#: Bytes and rows of one Arrow batch; both bound a Python worker's memory.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, by rows and by bytes, unless the session has smaller ones already.

    Spark reads these settings when it plans a query, so they are the session's from
    here on; they change no result.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        digits = spark.conf.get(key).rstrip("bB")
        if not digits.isdigit() or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))
    return spark


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    That is spark.checkpoint.dir, else the directory the context was given by
    setCheckpointDir. A session on one machine without either gets a temporary folder;
    on a cluster that would be seen by one machine only, so there it is an error.
    """
    ship(spark)
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own[0], True)
    sc.setCheckpointDir(_own[0])
    return f"file://{_own[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _folder(spark: SparkSession, path: str) -> tuple:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def until_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder that is there when the driver's JVM ends."""
    fs, at = _folder(spark, path)
    fs.deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder now."""
    fs, at = _folder(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder until the driver ends, and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
