"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic text and one on ordinary text. They
share a base, trained on common words of the labelled sample, and each ends with the words
that set its own class apart. A window of a text (a word, framed by a constant so that the
block always compresses) is compressed with both; where the toxic dictionary saves bytes,
the window is more like toxic text. Gains of windows are turned into log-likelihood ratios
by counts from texts that the dictionaries were not trained on, and the threshold on a
text's sum is calibrated as a probability on the same texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Labelled texts of each class that may be learned from; bounds what is broadcast and collected.
SAMPLE_TEXTS = 4000
#: Folds of the sample: gains of a fold are measured with dictionaries trained on the others.
FOLDS = 4
#: Common words that the shared base is trained on, and words that set a class apart, at most.
COMMON_WORDS, CLASS_WORDS = 8192, 1024
#: Bytes of the shared base.
BASE_BYTES = 32 << 10
#: A class word has so many contexts in its class, log odds so many errors above the other's, and so many times the share.
LEAST_CONTEXTS, LEAST_ERRORS, LEAST_LIFT = 2, 2.5, 4.0
#: Gains of a window in bytes are counted from -SPAN to SPAN.
SPAN = 12
#: Letters of one window at most; longer words are cut into several windows.
WINDOW = 64
#: Windows whose gain a Python worker remembers; others are compressed each time.
CACHE_WINDOWS = 500_000

#: Stands before each window and at the end of both dictionaries; then every block compresses.
FRAME = b"\x01the window that follows is compressed with either dictionary\x02"
#: Stands after each window: no match begins in the last eight bytes of a block.
TAIL = bytes([3, 4, 5, 6, 7, 8, 14, 15])
_WORD = re.compile(r"[^\W_]{1,%d}" % WINDOW)


def windows(text: str | None) -> list[str]:
    """Runs of letters and digits of a whole text, lower-cased; long runs in pieces."""
    return _WORD.findall(text.lower()) if text else []


def _bytes(word: str) -> bytes:
    return f" {word} ".encode("utf-8", "surrogatepass")


class Book:
    """A compressor with one dictionary; length() is that of a framed window in bytes."""

    def __init__(self, base: bytes, words: list[str]):
        content = base + b"".join(_bytes(w) for w in reversed(words)) + FRAME
        shape = zstandard.ZstdCompressionParameters.from_level(
            3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            strategy=zstandard.STRATEGY_BTOPT, min_match=3, window_log=17, hash_log=17, chain_log=17, search_log=4, target_length=64,
        )
        self._compress = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=shape).compress

    def length(self, word: str) -> int:
        return len(self._compress(FRAME + _bytes(word) + TAIL))


def base_dictionary(words: list[str]) -> bytes:
    """A dictionary trained on common words, in lines of sixteen; the words themselves where they are too few to train on."""
    lines = [b"".join(_bytes(w) for w in words[i : i + 16]) for i in range(0, len(words), 16)]
    try:
        return zstandard.train_dictionary(BASE_BYTES, lines, k=64, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(reversed(lines))


@dataclass
class Books:
    """What one pair of dictionaries is made of; compressors are made where they are used."""

    base: bytes
    toxic: list[str]
    ordinary: list[str]
    _cache: dict[str, int] = field(default_factory=dict)
    _pair: tuple[Book, Book] | None = None

    def __getstate__(self):
        return {"base": self.base, "toxic": self.toxic, "ordinary": self.ordinary, "_cache": {}, "_pair": None}

    def gains(self, text: str | None) -> np.ndarray:
        """How many windows of a whole text save so many bytes by the toxic dictionary, from -SPAN to SPAN."""
        if self._pair is None:
            self._pair = Book(self.base, self.toxic), Book(self.base, self.ordinary)
        found, known = windows(text), self._cache
        fresh = dict.fromkeys(w for w in found if w not in known)
        for w in fresh:
            gain = self._pair[1].length(w) - self._pair[0].length(w)
            fresh[w] = min(max(gain, -SPAN), SPAN) + SPAN
        if fresh:
            if len(known) + len(fresh) <= CACHE_WINDOWS:
                known.update(fresh)
            else:
                known = {w: fresh[w] if w in fresh else known[w] for w in {*found}}
        return np.bincount(np.fromiter(map(known.__getitem__, found), np.int8, len(found)), minlength=2 * SPAN + 1)


@dataclass
class Judge:
    """Dictionaries with calibrated weights."""

    books: Books
    ratio: np.ndarray  # log-likelihood ratio of each gain
    weight: np.ndarray  # of what inputs() returns

    def score(self, text: str | None) -> float:
        at = self.weight @ inputs(self.books.gains(text)[None], self.ratio)[0]
        return float(1 / (1 + np.exp(-np.clip(at, -500, 500))))


def inputs(counts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Per text: 1, the sum of its windows' ratios, the part of that above zero, windows that gain much, and the logarithm of the number of windows."""
    total = counts @ ratio
    strong = counts[:, SPAN + 3 :].sum(1)
    return np.column_stack([np.ones(len(counts)), total / 4, np.minimum(np.maximum(total, 0), 12) / 4, np.minimum(strong, 3), np.log1p(counts.sum(1)) / 4])


def fit_judge(books: Books, counts: np.ndarray, toxic: np.ndarray, share: float) -> Judge:
    """Weights from gains of texts that the dictionaries were not trained on; share: of toxic texts among all labelled ones."""
    n = np.array([counts[toxic == y].sum(0) for y in (0, 1)]) + 0.5
    n /= n.sum(1, keepdims=True)
    ratio = np.log(n[1] / n[0])
    x = inputs(counts, ratio)
    each = np.where(toxic == 1, share / max(toxic.sum(), 1), (1 - share) / max((1 - toxic).sum(), 1)) * len(toxic)
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(30):  # Newton's steps of a regularised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * p * (1 - p))[:, None]).T @ x + keep
        w -= np.linalg.solve(h, x.T @ (each * (p - toxic)) + keep @ w)
    return Judge(books, ratio, w)


def _contexts(sample: DataFrame) -> DataFrame:
    """For each word of the sample, after how many different words it stands in toxic and in ordinary texts of each fold.

    Copies of a text repeat its contexts, so a word isn't a sign of its class for being in many copies.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = windows(text)
                pairs = sorted(set(zip(found, ["", *found], strict=False)))
                n = len(pairs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold] * n, pa.int32()), pa.array([toxic] * n, pa.int32()), pa.array([w for w, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())],
                    ["fold", "toxic", "word", "before"],
                )

    small_batches(sample.sparkSession)
    pairs = sample.select("fold", "toxic", "text").mapInArrow(words, "fold int, toxic int, word string, before string")
    masks = [F.max(F.when((F.col("fold") == f) & (F.col("toxic") == y), 1).otherwise(0)).alias(f"n{f}_{y}") for f in range(FOLDS) for y in (0, 1)]
    once = pairs.groupBy("word", "before").agg(*masks)
    return once.groupBy("word").agg(*(F.sum(c).alias(c) for c in once.columns[2:]))


def _sizes(words: DataFrame) -> dict[tuple[int, int], int]:
    """Contexts of all words by fold and class."""
    row = words.agg(*(F.sum(c).alias(c) for c in words.columns[1:])).first()
    return {(f, y): row[f"n{f}_{y}"] or 0 for f in range(FOLDS) for y in (0, 1)}


def _books(words: DataFrame, sizes: dict[tuple[int, int], int], left_out: int | None) -> Books:
    """Dictionaries trained on all folds but one."""
    folds = [f for f in range(FOLDS) if f != left_out]
    seen = [sum(F.col(f"n{f}_{y}") for f in folds) for y in (0, 1)]
    contexts = [sum(sizes[f, y] for f in folds) for y in (0, 1)]
    rows = words.select("word", *(seen[y].alias(f"n{y}") for y in (0, 1)))

    def apart(mine: int) -> list[str]:
        a, b = F.col(f"n{mine}"), F.col(f"n{1 - mine}")
        na, nb = contexts[mine], contexts[1 - mine]
        odds = F.log((a + 0.5) / (na - a + 0.5)) - F.log((b + 0.5) / (nb - b + 0.5))
        errors = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        lift = (a / max(na, 1)) >= LEAST_LIFT * (b / max(nb, 1))
        found = rows.where((a >= LEAST_CONTEXTS) & lift).withColumn("z", errors).where(F.col("z") >= LEAST_ERRORS)
        return [r["word"] for r in found.orderBy(F.desc("z"), "word").limit(CLASS_WORDS).collect()]

    common = [r["word"] for r in rows.where("n0 > 0").orderBy(F.desc("n0"), "word").limit(COMMON_WORDS).collect()]
    return Books(base_dictionary(common), apart(1), apart(0))


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample_texts: int = SAMPLE_TEXTS, seed: int = 42) -> Judge | None:
    """Fit on at most sample_texts labelled rows of each class, chosen by a hash of seed and doc_id; None unless both classes have one."""
    spark = docs.sparkSession
    known = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    natural = dict(known.groupBy("toxic").count().collect())
    if len(natural) < 2:
        return None
    draw = [F.xxhash64(F.lit(seed), "doc_id"), "doc_id"]
    picked = known.where("toxic = 0").orderBy(*draw).limit(sample_texts).union(known.where("toxic = 1").orderBy(*draw).limit(sample_texts))
    picked = staged(picked.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), FOLDS).cast("int")), "toxicity-ids", rows=2 * sample_texts)
    # At most twice sample_texts ids with two numbers each.
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "fold", "toxic", "text"), "toxicity-sample")
    if sample.select("toxic").distinct().count() < 2:
        return None
    words = staged(_contexts(sample), "toxicity-words")
    sizes = _sizes(words)
    parts = spark.sparkContext.broadcast([_books(words, sizes, f) for f in range(FOLDS)])  # CLASS_WORDS and BASE_BYTES each

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, toxic, text = (c.to_pylist() for c in batch.columns)
            got = [parts.value[f].gains(t).tolist() for f, t in zip(fold, text, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(got, pa.list_(pa.int64()))], ["toxic", "counts"])

    small_batches(spark)
    measured = sample.select("fold", "toxic", "text").mapInArrow(measure, "toxic int, counts array<long>")
    # Rows of a repeated doc_id may be more than the sample's ids, so they are drawn again.
    got = staged(measured, "toxicity-gains").orderBy("toxic", "counts").limit(4 * sample_texts).collect()
    counts, toxic = np.array([r["counts"] for r in got], float), np.array([r["toxic"] for r in got])
    return fit_judge(_books(words, sizes, None), counts, toxic, natural[1] / sum(natural.values()))


def score_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """Score every whole text's toxicity: doc_id and score, 0 to 1, a calibrated probability of label 1.

    labels has doc_id and toxic (0 or 1; others and nulls are left out); usable, a
    condition on it, says which rows may be learned from. Nothing but the text is an
    input of a score.

    A null text counts as empty; a text without a word scores 0. Without usable labels of
    both classes every text scores 0. Repeated rows score alike; a null doc_id is kept. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    judge = train(docs, labels, F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)), sample_texts)
    model = spark.sparkContext.broadcast(judge)  # CLASS_WORDS and BASE_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            out = [known.score(t) if known and t and _WORD.search(t) else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    small_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
