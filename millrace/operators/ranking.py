"""Positions in groups without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written


def position_in_group(df: DataFrame, group: str, order: str, column: str = "position") -> DataFrame:
    """df with each row's place in its group, from 0 by order (unique in the group).

    A window would put a group, however large, into one task. Here rows are sorted over
    all ranges and written; offsets come from one count per range, and a group's first
    number is subtracted. Null is a group of its own.
    """
    spark = df.sparkSession
    placed = written(df.orderBy(group, order).withColumn("_mid", F.monotonically_increasing_id()), "positions")
    rows = placed.withColumn("_range", F.shiftright("_mid", 33))
    offsets, total = [], 0
    for r, n in sorted(map(tuple, rows.groupBy("_range").count().collect())):  # one row per range
        offsets.append((int(r), total))
        total += n
    side = spark.createDataFrame(offsets, "_range long, _offset long")
    at = rows.join(F.broadcast(side), "_range").withColumn("_at", F.col("_offset") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    first = at.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_first"))
    return at.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(column, F.col("_at") - F.col("_first")).select(*df.columns, column)
