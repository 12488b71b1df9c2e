"""Staged tables and gapless numbering for the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import fresh_path, remove, small_batches, until_exit

__all__ = ["crc_mod", "drop_staged", "fresh_path", "numbered", "packed", "small_batches", "staged", "unpacked"]

#: Rows of a narrow table that one task writes.
NARROW_ROWS = 250_000


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    rows: about how many rows a narrow table has; it is then written by as many tasks as
    that takes, or as there are cores, rather than as one small file for each partition.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // NARROW_ROWS)))
    df.write.parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Remove what staged() wrote for df; nothing may read it any more."""
    remove(df.sparkSession, df._staged_at)


def numbered(df: DataFrame, order: list[str | Column], column: str, name: str, about: int | None = None) -> DataFrame:
    """df in the global order, with a gapless number from 0 in `column`.

    The rows are range-partitioned and sorted, then written with a number inside their
    partition; a count per partition (one row each) gives the offsets. No task sees
    more than its range, however many rows share a key, as long as the order is
    nearly unique (callers end it with a hash or an id).
    """
    spark = df.sparkSession
    mid = f"_{column}_mid"
    rows = staged(df.orderBy(*order).withColumn(mid, F.monotonically_increasing_id()), name, about)
    part = F.shiftright(F.col(mid), 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((int(p), int(total)))
        total += n
    side = spark.createDataFrame(offsets, "_p long, _offset long")
    return (
        rows.withColumn("_p", part)
        .join(F.broadcast(side), "_p")  # one row per partition
        .withColumn(column, F.col("_offset") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_offset", mid)
    )


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of a column's text form, modulo a divisor; a null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def packed(x: np.ndarray) -> bytes:
    """A sparse vector: the cells that aren't zero, as 16-bit numbers, then their values in half precision."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].astype(np.float16).tobytes()


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """The vectors of packed(), one a row."""
    out = np.zeros((len(rows), width), np.float32)
    for x, data in zip(out, rows, strict=True):
        n = len(data) // 4
        x[np.frombuffer(data, np.uint16, n)] = np.frombuffer(data, np.float16, n, 2 * n)
    return out
