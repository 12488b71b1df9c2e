"""Exact dedup against a persistent digest index.

The index is a table of (digest, keep_id), bucketed and sorted by digest. A batch is
first reduced to one row per digest (map-side), then sort-merge anti-joined with the
index on its buckets, and what is new is appended.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, staged

#: Runs of ASCII white space count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _settings(spark: SparkSession, path: str, made: dict | None = None) -> dict | None:
    """The settings file of an index; written first if made is given and there is none."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_settings.json")  # Spark passes over names that begin with _
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        if made is None:
            return None
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
    data = fs.open(at)
    try:
        return json.loads(bytes(sc._jvm.org.apache.commons.io.IOUtils.toByteArray(data)))
    finally:
        data.close()


@dataclass
class DigestIndex:
    """A bucketed, sorted table of digests at `path`, known to the session as `name`.

    Files outlive the session; open() registers them again, with the bucket count they
    were written with, which is kept beside them. One writer at a time. Rows carry the
    batch that added them, so that a batch may be repeated after a lost driver.
    """

    spark: SparkSession
    path: str
    name: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """Open the index at path, or make an empty one.

        buckets: fixed for an index's life; about one for 10 million digests suits
        large ones. A new index takes the session's shuffle partitions by default, an
        old one what it has; asking an old one for another count is an error.
        """
        path = path or fresh_path(spark, "digest-index")
        held = _settings(spark, path)
        if held is None:
            held = _settings(spark, path, {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))})
        if buckets and buckets != held["buckets"]:
            raise ValueError(f"the index at {path} has {held['buckets']} buckets, not {buckets}")
        name = f"digest_index_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {held['buckets']} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, path, name, held["buckets"])

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        (
            rows.select("digest", "keep_id", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.name, path=self.path)
        )
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch_id: str | None = None) -> DataFrame:
    """Mark each document as kept or dropped, and append the batch's new digests to the index.

    Texts are equal when identical after each run of ASCII white space is replaced by
    one space. Of equal texts in a batch the row with the smallest doc_id stays, unless
    the index holds the text already: then none stays and keep_id is the index's.
    Returns doc_id, keep_id, group_size (rows of the batch with that text), kept and
    text_sha256, one row per input row.

    batch_id names the batch in the index. A batch that is run again under its name, say
    after a lost driver, is marked as it was the first time, and adds only what it had
    not added yet; without a name every call is a batch of its own.

    A null text counts as empty. A null doc_id never stays while its group has another;
    a group of null ids alone has keep_id null and kept false. Rows that repeat both
    doc_id and text are the same document and are marked alike. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    index = index or DigestIndex.open(spark)
    name = batch_id or uuid.uuid4().hex
    rows = staged(docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")), "dedup-rows")
    n = rows.count()
    batch = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-batch", n)
    own = F.col("batch") == name
    known = index.read().where(~own)
    new = staged(batch.hint("merge").join(known.hint("merge"), "digest", "left_anti"), "dedup-new", n)
    old = batch.join(known.select("digest", F.col("keep_id").alias("_old")), "digest").select(
        "digest", F.col("_old").alias("keep_id"), "group_size", F.lit(False).alias("fresh")
    )
    groups = staged(new.select("digest", "keep_id", "group_size", F.lit(True).alias("fresh")).unionByName(old), "dedup-groups", n)
    before = index.read().where(own)
    index.append(new if batch_id is None else new.join(staged(before.select("digest"), "dedup-before"), "digest", "left_anti"), name)
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)) & F.col("fresh")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
