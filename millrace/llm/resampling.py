"""Importance resampling towards a target distribution, by external sort-count.

Features of texts are hashed into buckets. A pass over the texts writes each batch as a
packed stream of 16-bit bucket numbers with document offsets. Streams are sorted and
run-length encoded for counts, run by run; Spark merges the runs. Later the streams are
read again and each document's gains are gathered and added up over its offsets, so texts
are tokenised once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, numbered, small_batches, staged

#: Buckets; a number of one fits in 16 bits.
BUCKETS = 10_000
#: Words of a feature, at most.
RUN = 1
#: Of documents with at least this many words, this share in percent is drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
#: Words whose bucket a Python worker remembers; others are hashed each time.
CACHE_WORDS = 300_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_cache: dict[str, int] = {}


def bucket(feature: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets


def stream(text: str | None, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Bucket numbers of a whole text's features, runs of 1 to `run` words, and its number of words."""
    words = _WORD.findall(text.translate(_LOWER)) if text else []
    if run == 1 and buckets == BUCKETS:
        known = _cache
        fresh = {w: bucket(w) for w in words if w not in known}
        if fresh:
            if len(known) + len(fresh) <= CACHE_WORDS:
                known.update((w, b) for w, b in fresh.items() if len(w) <= 64)
            return np.fromiter((fresh[w] if w in fresh else known[w] for w in words), np.uint16, len(words)), len(words)
        return np.fromiter(map(known.__getitem__, words), np.uint16, len(words)), len(words)
    found = [bucket(" ".join(words[i : i + n]), buckets) for n in range(1, run + 1) for i in range(len(words) - n + 1)]
    return np.array(found, np.uint16), len(words)


def streams(texts: DataFrame, id_column: str, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """One row a batch of texts: ids, words and offsets of its documents, and the packed stream of their buckets; staged."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("a bucket number must fit in 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, words = zip(*(stream(t, run, buckets) for t in batch.column(1).to_pylist()), strict=True)
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([list(words)], pa.list_(pa.int64())),
                    pa.array([ends.tolist()], pa.list_(pa.int64())),
                    pa.array([np.concatenate(parts).tobytes()], pa.binary()),
                ],
                ["ids", "words", "ends", "stream"],
            )

    small_batches(texts.sparkSession)
    shape = "ids array<long>, words array<long>, ends array<long>, stream binary"
    return staged(texts.select(F.col(id_column).cast("long"), "text").mapInArrow(pack, shape), "resampling-streams")


def counts(packed: DataFrame) -> DataFrame:
    """Features in each bucket: every stream is sorted and run-length encoded, and the runs of all streams are merged."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                b = np.sort(np.frombuffer(data, np.uint16))
                at = np.flatnonzero(np.diff(b, prepend=-1)) if len(b) else np.zeros(0, int)
                n = np.diff(at, append=len(b))
                yield pa.RecordBatch.from_arrays([pa.array(b[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])

    return packed.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    k = len(target)
    t, s = target.astype(np.float64), corpus.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weights(data: bytes, ends: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Floored mean gain of each document of a packed stream; 0 where it has no feature."""
    b = np.frombuffer(data, np.uint16)
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    out = np.zeros(len(ends), np.int64)
    full = np.flatnonzero(n)
    if len(full):
        # Documents without a feature take no place in the stream, so the others' starts cut it.
        out[full] = np.add.reduceat(gain[b], starts[full]) // n[full]
    return out


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(-1000 ln(-ln u)) with u from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return int(np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))))


def _vector(df: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket; at most `buckets` rows come to the driver."""
    out = np.zeros(buckets, np.int64)
    for b, n in df.collect():
        out[b] = n
    return out


def resample(
    docs: DataFrame, target: DataFrame, target_id: str = "item_id", run: int = RUN, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Draw documents that look like the target's texts, without replacement, by weight plus Gumbel noise.

    Returns doc_id, n_features, weight, score and rank (from 1; null where not drawn) of
    every row. Of the N rows with at least least_words words the floor(percent * N / 100)
    with the highest scores are drawn.

    A null or empty text has no feature and weight 0. Ties go to the smaller doc_id, then
    to the larger weight; a null doc_id comes before all (and counts as an empty text in its noise). Rows of a
    repeated doc_id are ranked each. An empty target has no feature; an empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = streams(target, target_id, run, buckets)
    packed = streams(docs, "doc_id", run, buckets)
    gain = gains(_vector(counts(wanted), buckets), _vector(counts(packed), buckets))
    drop_staged(wanted)
    known = spark.sparkContext.broadcast(gain)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, ends, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                end = np.array(ends, np.int64)
                w = weights(data, end, known.value)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(np.diff(end, prepend=0)), pa.array(words, pa.int64()), pa.array(w),
                        pa.array([x + noise(i, seed) for i, x in zip(ids, w.tolist(), strict=True)], pa.int64()),
                    ],
                    ["doc_id", "n_features", "words", "weight", "score"],
                )

    scored = packed.mapInArrow(score, "doc_id long, n_features long, words long, weight long, score long")
    order = [F.col("words") < least_words, F.desc("score"), F.col("doc_id").asc_nulls_first(), F.desc("weight"), F.desc("n_features")]
    ranked = numbered(scored, order, "at", "resampling-ranks")
    enough = ranked.where(F.col("words") >= least_words).count()
    drawn = (F.col("words") >= least_words) & (F.col("at") < enough * percent // 100)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("at") + 1).alias("rank"))
