"""Stateful streams: what changes in a feed of documents, and the last turns of conversations, key by key.

State lies in the state store, one small value or list a key; a checkpoint restarts a
query where it stopped, and a batch that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions import text as T

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Start a stream with the state store that keyed state needs; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _Changes(StatefulProcessor):
    """Of a source it keeps when its last version came, its hash, and whether it is there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, hash string, here boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        versions = sorted((int(r.at), r.hash is not None, r.hash or "", bool(r.gone)) for part in rows for r in part[["at", "hash", "gone"]].itertuples(index=False))
        at, held, here = self.last.get() if self.last.exists() else (None, None, False)
        out = []
        for when, some, digest, gone in versions:
            if at is not None and when < at:
                continue  # older than what is known
            digest = digest if some else None
            action = ("delete" if here else None) if gone else "add" if not here else "change" if digest != held else None
            at, held, here = when, None if gone else digest, not gone
            if action:
                out.append((key[0], when, action, held))
        if at is not None:
            self.last.update((at, held, here))
        yield pd.DataFrame(out, columns=["source_id", "at", "action", "content_hash"])

    def close(self) -> None:
        pass


def change_events(feed: DataFrame) -> DataFrame:
    """A stream of what changes: source_id, at, action (add, change, delete) and content_hash.

    feed: a stream of source_id, content, at (long) and maybe deleted. A version that
    equals the one before gives no row; nor does deleting what isn't there. Versions of a
    source in one batch count in the order of at (of a tie, the greater hash and then a
    deletion last); rows older than what is known are passed over. Null content is content
    with a null hash. Only hashes reach the state; a group holds the versions of one
    source in one batch. Rows without source_id or at are left out.
    """
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in feed.columns else F.lit(False)
    slim = feed.where(F.col("source_id").isNotNull() & F.col("at").isNotNull())
    slim = slim.select("source_id", F.col("at").cast("long").alias("at"), T.content_hash(F.col("content")).alias("hash"), gone.alias("gone"))
    return slim.groupBy("source_id").transformWithStateInPandas(_Changes(), "source_id string, at long, action string, content_hash string", "Append", "None")


class _Turns(StatefulProcessor):
    """Of a conversation it keeps the last turns and how many there were; a conversation that rests is closed by a timer."""

    def __init__(self, keep: int, idle_ms: int | None) -> None:
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, role string, text string")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        for part in rows:
            n += len(part)
            held += [(int(r.turn), r.role, r.text) for r in part[["turn", "role", "text"]].itertuples(index=False)]
            held = sorted(held, key=lambda t: (t[0], t[1] or "", t[2] or ""))[-self.keep :]
        self.turns.put(held)
        self.seen.update((n,))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, n, held, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        self.turns.clear()
        self.seen.clear()
        yield self._row(key, n, held, True)

    @staticmethod
    def _row(key: Any, n: int, held: list, closed: bool) -> pd.DataFrame:
        said = "\n".join(f"{r or ''}: {t or ''}" for _, r, t in held)
        return pd.DataFrame([(key[0], n, said, closed)], columns=["conv_id", "seen", "history", "closed"])

    def close(self) -> None:
        pass


def last_turns(messages: DataFrame, keep: int = 6, idle_ms: int | None = None) -> DataFrame:
    """A stream of conversations' last turns: conv_id, seen (turns so far), history (a line a turn) and closed.

    messages: a stream of conv_id, turn, role and text, in any order: the last turns are
    those of the highest numbers. Each batch gives a row for each conversation that it
    holds. With idle_ms a conversation without a turn for so long is closed: its last row
    comes once more with closed true, and its state is dropped. Rows without conv_id or
    turn are left out.
    """
    slim = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return slim.groupBy("conv_id").transformWithStateInPandas(_Turns(keep, idle_ms), "conv_id long, seen long, history string, closed boolean", "Append", mode)


def to_files(stream: DataFrame, path: str, checkpoint: str, one_batch: bool = False) -> StreamingQuery:
    """Run a stateful stream over what is there, into Parquet files, each row once; again with the same checkpoint it goes on.

    one_batch: all of it as one batch, which a stream with timers needs: they would ask for ever more batches.
    """
    with keyed_state(stream.sparkSession):
        out = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (out.trigger(once=True) if one_batch else out.trigger(availableNow=True)).start()
