"""Language ID by error-correcting output codes.

Every language has a codeword; one binary classifier on hashed byte n-grams predicts each
bit. Decoding weighs each bit's loss by the classifier's training accuracy and takes the
nearest codeword; a small lead over the second marks the text ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, staged, unpacked

#: Texts of each language that the classifiers are fitted on, about; all of fewer.
SAMPLE_TEXTS = 400
#: Texts that they are fitted on in all.
SAMPLE_ALL = 6000
#: Hash cells of byte bigrams and trigrams.
CELLS = 1 << 12
UNKNOWN = "und"
#: A lead in score under which a text counts as ambiguous.
LEAD = 0.1

#: What may be a letter: also numbers like ½ and Ⅷ, which has_letter leaves out.
_LETTER = re.compile(r"[^\W\d_]")
#: Bytes taken at once; texts of any length are read whole.
_STEP = 1 << 20


def has_letter(text: str) -> bool:
    """Whether a text has a character of a Unicode letter category."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of n-gram shares, unit length; zeros for an empty text."""
    data = text.lower().encode("utf-8", "surrogatepass")
    if not data:
        return np.zeros(CELLS, np.float32)
    every, count = np.frombuffer(b" " + data + b" ", np.uint8), np.zeros(CELLS)
    for at in range(0, len(every) - 1, _STEP):
        b = every[at : at + _STEP + 2].astype(np.uint32)  # two more, for the n-grams that begin in this step
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        for x in (two[:_STEP], three[:_STEP]):
            count += np.bincount((x * np.uint32(2654435761)) >> np.uint32(20), minlength=CELLS)
    return np.sqrt(count / count.sum()).astype(np.float32)


def codewords(classes: int, seed: int = 42) -> np.ndarray:
    """Codewords of -1 and 1: every split of up to five classes, else random ones that lie far apart."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        return np.array([[1 if not c or not (j >> (c - 1)) & 1 else -1 for j in range(1, 2 ** (classes - 1))] for c in range(classes)])
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = max(15, int(10 * np.log2(classes)))
    for _ in range(200):
        code = rng.choice([-1, 1], (classes, bits))
        if (np.abs(code.sum(0)) == classes).any():
            continue
        apart = ((code[:, None] != code[None]).sum(2) + bits * np.eye(classes, dtype=int)).min()
        if apart > far:
            best, far = code, apart
    return best if best is not None else code


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray  # language x bit
    weight: np.ndarray  # cell x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit, from training accuracy

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's number, its score, and the score's lead over the second."""
        margin = x.astype(np.float64) @ self.weight + self.bias
        loss = np.log1p(np.exp(-np.clip(margin[:, None] * self.code[None], -30, 30))) @ self.trust
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        rows = np.arange(len(p))
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[rows, order[:, 0]], p[rows, order[:, 0]] - second


def fit(x: np.ndarray, languages: list[str], steps: int = 300, rate: float = 8.0, decay: float = 1e-4, seed: int = 42) -> Codes:
    """Logistic classifiers of all bits at once, by full-batch gradient steps with momentum; classes weigh the same."""
    names = sorted(set(languages))
    y = np.array([names.index(n) for n in languages])
    code = codewords(len(names), seed)
    target = code[y].astype(np.float32)
    each = (1 / np.bincount(y, minlength=len(names)))[y].astype(np.float32)
    each /= each.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        m = x @ w + b
        g = -(target / (1 + np.exp(np.clip(target * m, -30, 30)))) * each[:, None]
        vw = 0.9 * vw - rate * (x.T @ g + decay * w)
        vb = 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    right = (((x @ w + b) * target > 0) * each[:, None]).sum(0)
    trust = np.maximum(right - 0.5, 0.01)
    return Codes(names, code.astype(np.float64), w.astype(np.float64), b.astype(np.float64), trust / trust.mean())


def train(docs: DataFrame, usable: Column, sample_texts: int = SAMPLE_TEXTS, sample_all: int = SAMPLE_ALL, seed: int = 42) -> Codes | None:
    """Fit on about sample_texts rows of each language, chosen by a hash of seed, doc_id and text; None without any.

    sample_all bounds the rows in all. Of more than sample_all languages the commonest are learned.
    """
    small_batches(docs.sparkSession)
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_all).collect())
    if not sizes:
        return None
    sample_texts = max(1, min(sample_texts, sample_all // len(sizes)))
    draw = (F.xxhash64(F.lit(seed), "doc_id", "text") / F.lit(float(2**64))) + 0.5
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, sample_texts / n))])
    picked = known.select("lang", draw.alias("draw"), "text").where(F.col("draw") <= share[F.col("lang")])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [packed(features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["lang", "draw", "x"])

    rows = staged(picked.mapInArrow(make, "lang string, draw double, x binary"), "langid-sample")
    rows = rows.orderBy("draw", "lang", "x").limit(2 * sample_all).orderBy("lang", "x").collect()  # about sample_all rows; more only if rows repeat
    if not rows:
        return None
    return fit(unpacked([r["x"] for r in rows], CELLS), [r["lang"] for r in rows], seed=seed)


def identify(docs: DataFrame, usable: Column | None = None, lead: float = LEAD) -> DataFrame:
    """Predict the language of every whole text.

    usable: rows whose text and lang may be learned from (all by default). Returns doc_id,
    lang_pred, score (0 to 1) and ambiguous; other columns of docs are never looked at.

    A text that is null or has no letter is `und` with score 0 and not ambiguous, as is
    every text if there is nothing to learn from. One learned language alone is always
    predicted. Ties go to the language first by code point. Repeated rows are predicted
    alike; a null doc_id is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    codes = train(docs, F.lit(True) if usable is None else F.coalesce(usable, F.lit(False)))
    model = spark.sparkContext.broadcast(codes)  # CELLS x bits numbers

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            at = [i for i, t in enumerate(texts) if t and has_letter(t)] if known else []
            if at:
                which, p, ahead = known.predict(np.stack([features(texts[i]) for i in at]))
                for i, w in zip(at, which, strict=True):
                    lang[i] = known.languages[w]
                score[at], unsure[at] = p, ahead < lead
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    small_batches(spark)
    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")
