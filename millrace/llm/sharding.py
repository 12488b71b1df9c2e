"""Sharding by longest processing time.

Groups that must stay together (equal texts) are taken by falling size; each goes to
the least-loaded shard. Groups of one size form a class, and a class is placed at
once: the loads after it are those of placing its groups one by one through the heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, numbered, staged

#: Classes of sizes that the driver holds at once.
CLASS_ROWS = 100_000


def place(classes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """For (size, groups) by falling size: (size, groups, groups before, groups per shard).

    Equal to popping the least-loaded shard (ties: lowest number) for every group.
    """
    heap = [(0, s) for s in range(shards)]
    before = 0
    for size, groups in classes:
        taken = [0] * shards
        left = groups
        if groups > 4 * shards and size > 0:
            # Steps below a water level: all placements that start under it happen first.
            lo, hi = heap[0][0], max(load for load, _ in heap) + size * (groups // shards + 1)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if sum(max(0, -(-(mid - load) // size)) for load, _ in heap) <= groups:
                    lo = mid
                else:
                    hi = mid - 1
            heap = [(load + size * (n := max(0, -(-(lo - load) // size))), s, n) for load, s in heap]
            for _, s, n in heap:
                taken[s] += n
                left -= n
            heap = [(load, s) for load, s, _ in heap]
            heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            taken[s] += 1
        yield size, groups, before, taken
        before += groups


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shard every document so that shard sizes are near equal and equal texts share a shard.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot (the place in
    the shard by doc_id, gapless from 0).

    A null text counts as an empty one: size 1, and one group with the empty texts.
    Repeated rows are rows of the same group, each with a slot of its own. Ties
    (groups of one size) go by digest, then to the lowest shard. A null doc_id sorts
    first. An empty table gives no rows; other columns are ignored. A group larger
    than its fair share is never split, so its shard may be larger than the rest.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "shard-rows",
    )
    n = rows.count()
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups", n)
    groups = numbered(groups, [F.desc("bytes"), "digest"], "place", "shard-order", n)
    classes = groups.groupBy("bytes").count().orderBy(F.desc("bytes"))
    path = fresh_path(spark, "shard-classes")
    schema = "bytes long, class_first long, ends array<long>"
    held: list[tuple] = []

    def flush() -> None:
        cols = list(zip(*held, strict=True)) or [(), (), ()]
        table = pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["bytes", "class_first", "ends"])
        spark.createDataFrame(table, schema).coalesce(1).write.mode("append").parquet(path)
        held.clear()

    for size, _, before, taken in place(((r[0], r[1]) for r in classes.toLocalIterator()), shards):
        ends, end = [], 0
        for some in taken:
            end += some
            ends.append(end)
        held.append((size, before, ends))
        if len(held) >= CLASS_ROWS:
            flush()
    flush()
    laws = spark.read.schema(schema).parquet(path)
    placed = staged(
        groups.join(laws, "bytes").select(
            "digest", F.expr("size(filter(ends, e -> e <= place - class_first))").cast("int").alias("shard")
        ),
        "shard-placed",
        n,
    )
    out = staged(rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard"), "shard-out", n)
    firsts = dict(out.groupBy("shard").count().collect())  # one row per shard
    starts, total = [], 0
    for s in range(shards):
        starts.append((s, total))
        total += firsts.get(s, 0)
    side = spark.createDataFrame(starts, "shard int, _start long")
    return (
        numbered(out, ["shard", "doc_id", "text_crc32"], "at", "shard-slots", n)
        .join(F.broadcast(side), "shard")  # one row per shard
        .select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("_start")).alias("slot"))
    )
