"""Token counts kept by deltas.

A change feed (inserts, deletes, revisions) becomes signed additive totals by source,
language and tokenizer version. Each batch is one delta, written as a whole: committing a
batch again changes nothing. Totals are kept as a base that deltas are folded into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import remove

from .common import fresh_path, small_batches
from .wordbpe import WordBpe, default_path

DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def counted(feed: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """feed with the column tokens: ids of its column text by the tokenizer file."""
    path = tokenizer or default_path()
    keep = [c for c in feed.columns if c not in ("text", "tokens")]
    slim = feed.select(*keep, "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.of(path)
        for batch in batches:
            ids = bpe.encode([t or "" for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([len(i) // 4 for i in ids], pa.int64())], [*keep, "tokens"])

    small_batches(feed.sparkSession)
    schema = slim.drop("text").schema.add("tokens", "long")
    return slim.mapInArrow(count, schema)


@dataclass
class TokenRollup:
    """Additive token totals at a path, kept up by deltas. One writer at a time.

    deltas/<batch> holds what a committed batch adds, base-<n> the totals of all batches
    that were folded in, with the list of their names. Totals are the newest whole base
    plus the few deltas after it; after FOLD_AT deltas they are folded into a new base.
    Only folders with a _SUCCESS mark count: what a lost driver left half written is
    neither summed nor taken for committed, and a fold that died is done again.
    """

    spark: SparkSession
    path: str
    #: Deltas that are kept before they are folded into the base.
    fold_at: int = 32

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, fold_at: int = 32) -> TokenRollup:
        return cls(spark, path or fresh_path(spark, "token-rollup"), fold_at)

    def _marks(self, pattern: str) -> list[str]:
        """Names of the folders under the path that match the pattern and are whole."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(x.getPath().getParent().getName() for x in found or ())

    def _base(self) -> str | None:
        """The newest whole base: its list of names is written last."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/base-*/names/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return max((x.getPath().getParent().getParent().getName() for x in found or ()), default=None)

    def _names(self, base: str | None) -> DataFrame:
        return self.spark.read.schema("name string").parquet(f"{self.path}/{base}/names") if base else self.spark.createDataFrame([], "name string")

    def _pending(self, base: str | None) -> list[str]:
        """Committed deltas that the base doesn't hold; at most about fold_at, and those that a lost fold left behind."""
        there = self._marks("deltas/*")
        if not there or not base:
            return there
        held = {r["name"] for r in self._names(base).where(F.col("name").isin(there)).collect()}
        return [x for x in there if x not in held]

    def _sum(self, base: str | None, pending: list[str]) -> DataFrame:
        parts = [f"{self.path}/deltas/{x}" for x in pending] + ([f"{self.path}/{base}/totals"] if base else [])
        if not parts:
            return self.spark.createDataFrame([], DELTA)
        return (
            self.spark.read.schema(DELTA).parquet(*parts)
            .groupBy("source", "lang", "tokenizer")
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where((F.col("docs") != 0) | (F.col("tokens") != 0))
        )

    def commit(
        self,
        batch_id: str,
        inserts: DataFrame | None = None,
        deletes: DataFrame | None = None,
        revised: tuple[DataFrame, DataFrame] | None = None,
        counts: DataFrame | None = None,
        tokenizer: str | None = None,
        version: str = "word_bpe_49k",
    ) -> bool:
        """Add a batch: inserted rows count +1, deleted rows -1, and their tokens alike.

        revised: rows as they were and as they are now; a revision moves tokens, and its
        document from one source or language to another. Rows need text, source and lang.
        counts: signed corrections (source, lang, tokenizer, docs, tokens) that are added
        as they are, say those of another tokenizer version. A batch id that is committed
        already is skipped: False. A batch that died halfway left no _SUCCESS mark and is
        written anew.
        """
        name = hashlib.sha256(batch_id.encode()).hexdigest()  # ids may hold any characters
        base = self._base()
        if self._marks(f"deltas/{name}") or (base and not self._names(base).where(F.col("name") == name).isEmpty()):
            return False
        before, after = revised or (None, None)
        signed = ((inserts, 1), (deletes, -1), (before, -1), (after, 1))
        feeds = [d.select("source", "lang", "text", F.lit(s).cast("long").alias("sign")) for d, s in signed if d is not None]
        delta = self.spark.createDataFrame([], DELTA) if counts is None else counts.select("source", "lang", "tokenizer", F.col("docs").cast("long"), F.col("tokens").cast("long"))
        if feeds:
            feed = reduce(DataFrame.unionByName, feeds)
            told = counted(feed, tokenizer).select("source", "lang", F.lit(version).alias("tokenizer"), F.col("sign").alias("docs"), (F.col("sign") * F.col("tokens")).alias("tokens"))
            delta = told if counts is None else told.unionByName(delta)
        (
            delta.groupBy("source", "lang", "tokenizer")
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        )
        if len(self._pending(self._base())) >= self.fold_at:
            self.fold()
        return True

    def fold(self) -> None:
        """Make a new base of the old one and the deltas after it.

        What was folded before goes first; what is folded now stays until the next time,
        for those who still read it.
        """
        base = self._base()
        pending = self._pending(base)
        for name in self._marks("deltas/*"):
            if name not in pending:
                remove(self.spark, f"{self.path}/deltas/{name}")
        number = int(base.split("-")[1]) if base else 0
        remove(self.spark, f"{self.path}/base-{number - 1:012d}")
        if pending:
            to = f"{self.path}/base-{number + 1:012d}"
            self._sum(base, pending).write.mode("overwrite").parquet(f"{to}/totals")
            names = self._names(base).unionByName(self.spark.createDataFrame([(x,) for x in pending], "name string"))
            names.coalesce(1).write.mode("overwrite").parquet(f"{to}/names")  # 64 characters a batch

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens; groups whose documents are all gone drop out."""
        base = self._base()
        return self._sum(base, self._pending(base))


def token_counts(docs: DataFrame, rollup: TokenRollup | None = None, batch_id: str = "load", tokenizer: str | None = None) -> DataFrame:
    """Commit docs as one batch of inserts and return the totals.

    A null or empty text has no tokens but counts as a document. Null source and null
    lang are groups of their own. Repeated rows count each time. An empty table adds
    nothing. Other columns are ignored; texts of any length are counted whole.
    """
    rollup = rollup or TokenRollup.open(docs.sparkSession)
    rollup.commit(batch_id, inserts=docs, tokenizer=tokenizer)
    return rollup.totals()
