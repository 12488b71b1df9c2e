"""Incremental sync as a stream: document rows are planned against the state and applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import text as T
from millrace.operators import ingest
from millrace.operators.state import Store, sync_plan
from millrace.session import written

STATE = "source_id string, content_hash string, content string"
#: State of a store with chunks: the ids of a source's chunks and when it was last seen.
SOURCES = "source_id string, content_hash string, title string, chunk_ids array<string>, last_seen string"
CHUNKS = "chunk_id string, source_id string, chunk_index int, title string, text string, header_path array<string>, contextualized_text string"


def latest(batch: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per source_id of a batch: the last by `order` (at, if there is such a column), then the largest content."""
    if order is None:
        order = F.col("at") if "at" in batch.columns else F.lit(0)
    rest = [c for c in batch.columns if c not in ("source_id", "at")]
    last = batch.groupBy("source_id").agg(F.max_by(F.struct(*rest), F.struct(order.alias("order"), F.col("content"))).alias("_last"))
    return last.select("source_id", *[F.col(f"_last.{c}").alias(c) for c in rest])


def apply_batch(store: Store, batch: DataFrame, order: Column | None = None) -> DataFrame:
    """Apply a batch (source_id, content, and maybe at and deleted) to a store of STATE; returns its plan. One commit per batch, of what changes alone.

    Of several rows of a source the last by order counts. A row with deleted true removes
    its source. What the store has already is left as it is, so a replay changes nothing.
    """
    now = latest(batch, order)
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    snapshot = now.where(~gone).select("source_id", T.content_hash(F.col("content")).alias("content_hash"), "content")
    held = store.read()
    plan = written(sync_plan(snapshot, held, restrict=now), "sync-plan")  # the store may be folded while it is in use
    fresh = snapshot.join(plan.where(F.col("action").isin("add", "change")), "source_id", "left_semi")
    store.apply(fresh.select("source_id", "content_hash", "content"), plan.where(F.col("action") == "delete"))
    return plan


def apply_sync(
    sources: Store,
    chunks: Store,
    snapshot: DataFrame,
    seen: str,
    batch_only: bool = False,
    build: Callable[[DataFrame], DataFrame] = ingest.ingest,
) -> DataFrame:
    """Bring a store of chunks in line with documents (source_id, title, content); returns the plan (source_id, action).

    New and changed documents are built into chunks anew, and the chunks they had go;
    sources that are no longer there go with all their chunks, unless batch_only says that
    snapshot holds only some of them. Sources that stay get `seen` as last_seen and their
    chunks aren't touched. Chunks are written before the sources: a run that dies in
    between is repeated in full, as the hashes still differ, and ends alike.
    """
    docs = snapshot.withColumn("content_hash", T.content_hash(F.col("content")))
    held = sources.read()
    plan = written(sync_plan(docs, held, restrict=docs if batch_only else None), "sync-plan")
    fresh = docs.join(plan.where(F.col("action").isin("add", "change")), "source_id", "left_semi")
    made = build(fresh.drop("content_hash"))
    stale = chunks.read().join(plan.where(F.col("action") != "keep"), "source_id", "left_semi")
    chunks.apply(made, stale)
    ids = chunks.read().groupBy("source_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))  # one document's chunks
    rows = fresh.select("source_id", "content_hash", "title").unionByName(
        held.join(plan.where(F.col("action") == "keep"), "source_id", "left_semi").select("source_id", "content_hash", "title")
    )
    now = rows.join(ids, "source_id", "left").select(
        "source_id", "content_hash", "title", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), F.lit(seen).alias("last_seen")
    )
    sources.apply(now, plan.where(F.col("action") == "delete"))
    return plan


def stream_sync(source: DataFrame, store: Store, checkpoint: str, once: bool = True, order: Column | None = None) -> StreamingQuery:
    """Apply a stream of document rows as apply_batch does. A replayed batch changes nothing: hashes agree.

    File sources never report deletions by themselves: rows with deleted true do, or a full apply_sync.
    """
    writer = source.writeStream.foreachBatch(lambda df, _: apply_batch(store, df, order) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
