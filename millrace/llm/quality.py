"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, its runs of signs, the shapes of its words, and marks of what
repeats in it (a word once more in a row, words by how often they occur, lines that came
before). Terms are hashed; their counts, weighted by inverse document frequency, make the
term-document matrix of labelled texts, which is projected on its leading singular vectors.
The labelled vectors are broadcast; every document's cosines with all of them are computed
in blocks, and the nearest vote by similarity.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, staged, unpacked

#: Labelled texts that the space is fitted on and that vote; bounds what is broadcast.
SAMPLE_TEXTS = 6000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Documents of which cosines are held at once.
BLOCK = 256

#: Hash cells of words, of sign runs and word shapes, and of repeats.
WORDS, SIGNS, REPEATS = 2048, 960, 64
WIDTH = WORDS + SIGNS + REPEATS
#: Tokens whose cells a Python worker remembers, and their length at most; others are hashed each time.
CACHE_TOKENS, CACHE_LENGTH = 100_000, 48

_RUN = re.compile(r"[^\W_]+|[\W_]+")
_cache: dict[str, bytes] = {}


def _cell(term: str, cells: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % cells


def shape(word: str) -> str:
    """Case or digits of a word, and its length in steps of six up to four."""
    case = "9" if word.isdigit() else "A" if word.isupper() and len(word) > 1 else "a" if word.islower() else "Aa" if word.istitle() else "x"
    return f"{case}{min(len(word) // 6, 4)}"


def token_cells(token: str) -> bytes:
    """Cells of the terms in a white-space token, as 16-bit numbers: each run of letters and digits with its shape, each run of signs."""
    out = []
    for run in _RUN.findall(token):
        if run[0].isalnum():
            out += [_cell(run.lower(), WORDS), WORDS + _cell(f"shape {shape(run)}", SIGNS)]
        else:
            out.append(WORDS + _cell(f"sign {run}", SIGNS))
    return np.array(out, np.uint16).tobytes()


def features(text: str) -> np.ndarray:
    """Counts of a whole text's terms as square roots of their shares."""
    tokens = text.split()
    if not tokens:
        return np.zeros(WIDTH, np.float32)
    counts = Counter(tokens)
    known = _cache
    fresh = {t: token_cells(t) for t in counts if t not in known}
    if fresh:
        if len(known) < CACHE_TOKENS:
            known.update((t, c) for t, c in fresh.items() if len(t) <= CACHE_LENGTH)
        known = {t: fresh.get(t) or known[t] for t in counts}
    out = np.bincount(np.frombuffer(b"".join(map(known.__getitem__, tokens)), np.uint16), minlength=WIDTH).astype(np.float64)
    at = WORDS + SIGNS
    out[at] = sum(map(str.__eq__, tokens, tokens[1:]))
    for times, words in Counter(counts.values()).items():
        out[at + 1 + min(int(2 * math.log2(times)), 40)] += times * words
    lines = Counter(x for x in text.split("\n") if x and not x.isspace())
    out[at + 50], out[at + 51] = len(lines), lines.total() - len(lines)
    return np.sqrt(out / out.sum()).astype(np.float32)


@dataclass
class Space:
    weight: np.ndarray  # inverse document frequency of each feature
    mean: np.ndarray
    axes: np.ndarray  # feature x dimension
    vectors: np.ndarray  # labelled, unit length
    good: np.ndarray  # their labels

    def project(self, x: np.ndarray) -> np.ndarray:
        v = ((x * self.weight - self.mean) @ self.axes).astype(np.float32)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity."""
        cos = self.project(x) @ self.vectors.T
        k = min(neighbours, cos.shape[1])
        top = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.broadcast_to(np.arange(k), cos.shape)
        near = np.take_along_axis(cos, top, 1).astype(np.float64)
        w = np.maximum(near, 1e-6) ** 4
        return (w * self.good[top]).sum(1) / w.sum(1)


def fit(x: np.ndarray, good: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 42) -> Space:
    """Latent-semantic space of labelled rows, by a randomised singular value decomposition."""
    seen = (x > 0).sum(0)
    weight = (np.log((1 + len(x)) / (1 + seen)) + 1).astype(np.float32)
    xw = x * weight
    mean = xw.mean(0)
    xw -= mean
    d = max(1, min(dimensions, *x.shape))
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], min(d + 10, x.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(xw.T @ (xw @ q))
    _, _, vt = np.linalg.svd(xw @ q, full_matrices=False)
    axes = (q @ vt.T[:, :d]).astype(np.float32)
    space = Space(weight, mean, axes, np.zeros((0, d), np.float32), good.astype(np.float64))
    space.vectors = space.project(x)
    return space


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_texts: int = SAMPLE_TEXTS, seed: int = 42) -> Space | None:
    """Fit on at most sample_texts labelled rows, chosen by a hash of seed and doc_id; None without any."""
    spark = docs.sparkSession
    small_batches(spark)
    picked = labels.where(usable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = staged(picked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_texts), "quality-ids")
    # At most sample_texts ids of two numbers.
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [packed(features(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    rows = staged(chosen.select("doc_id", "text", "quality").mapInArrow(make, "doc_id long, quality int, x binary"), "quality-sample")
    rows = rows.orderBy("doc_id", "quality", "x").limit(sample_texts).collect()
    if not rows:
        return None
    return fit(unpacked([r["x"] for r in rows], WIDTH), np.array([r["quality"] for r in rows]), seed=seed)


def scores(texts: list[str | None], space: Space | None, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of texts, cosines taken block by block."""
    at = [i for i, t in enumerate(texts) if t and not t.isspace()]
    out = np.zeros(len(texts))
    out[at] = 0.5
    for lo in range(0, len(at) if space else 0, BLOCK):
        block = at[lo : lo + BLOCK]
        out[block] = space.vote(np.stack([features(texts[i]) for i in block]), neighbours)
    return np.clip(out, 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Score every whole text's quality: doc_id and score, 0 to 1, higher where label 1 is likelier.

    labels has doc_id and quality (0 or 1; others and nulls are left out); usable, a
    condition on it, says which rows may be learned from. Nothing but the text is an
    input of a score.

    A null text counts as empty; a text without a word scores 0. Without a usable label
    every text with a word scores 0.5. Repeated rows score alike; ties between
    neighbours of equal similarity are broken the same way on each run. A null doc_id is
    kept. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    space = train(docs, labels, F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    model = spark.sparkContext.broadcast(space)  # at most SAMPLE_TEXTS vectors of DIMENSIONS

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = scores(batch.column(1).to_pylist(), model.value, neighbours)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    small_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, at_least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at_least; rules as in score_quality. No shuffle of texts."""
    spark = docs.sparkSession
    space = train(docs, labels, F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    model = spark.sparkContext.broadcast(space)  # at most SAMPLE_TEXTS vectors of DIMENSIONS
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text).to_pylist(), model.value) >= at_least))

    small_batches(spark)
    return docs.mapInArrow(keep, docs.schema)
