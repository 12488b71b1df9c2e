import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, resampling, toxicity, vector_codes
from millrace.llm.common import crc_mod
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"


# Vector codes


@pytest.mark.parametrize("seed", range(4))
def test_tree_search_equals_plain_comparison(seed):
    r = np.random.default_rng(seed)
    for n, width, span in ((1, 3, 9), (2, 1, 3), (16, 8, 3), (16, 8, 4000), (40, 2, 5), (16, 4, 1 << 26)):
        entries = r.integers(-span, span, (n, width))
        entries[n // 2] = entries[0]  # a repeated entry: the lower number wins
        rows = np.concatenate([r.integers(-span, span, (300, width)), entries])
        d2 = ((rows[:, None] - entries[None]) ** 2).sum(2)
        number, best, taken = vector_codes.nearest(vector_codes.build(entries), entries, rows)
        assert (number == d2.argmin(1)).all() and (best == d2.min(1)).all()
        assert taken <= d2.size


def test_tree_search_leaves_branches_out():
    r = np.random.default_rng(1)
    entries = r.integers(-50_000, 50_000, (64, 2))
    rows = entries[r.integers(0, 64, 2000)] + r.integers(-200, 200, (2000, 2))
    number, _, taken = vector_codes.nearest(vector_codes.build(entries), entries, rows)
    assert taken < 0.4 * rows.shape[0] * len(entries)
    assert (number == ((rows[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all()


def _codes(vectors, parts=8, entries=16, rounds=6, scale=4096):
    """(id, label, vector) by plain loops: {id: (code, error)}, codebooks."""
    rows = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in vectors]
    rows.sort(key=lambda r: (r[0], np.array(r[2], np.int32).tobytes()))
    w = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, _, v in rows[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, _, v in rows:
            for p in range(parts):
                groups[p, near(p, cut(v, p))[1]].append(cut(v, p))
        for (p, k), g in groups.items():
            books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, lab, v in rows:
        found = [near(p, cut(v, p)) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def test_codes_equal_plain_loops(spark):
    r = random.Random(5)
    vectors = [(i, (1, 1, 1, 2, None)[i % 5], [r.gauss(0, 1) for _ in range(16)]) for i in range(70)]
    vectors += [(3, 1, vectors[3][2]), (4, None, [r.gauss(0, 1) for _ in range(16)]), (500, 7, [1e9] * 16), (501, 7, [-1e9] * 16)]
    want, books = _codes([(i, lab, [min(max(x, -16384.0), 16384 - 1 / 4096) for x in map(float, np.array(v, np.float32))]) for i, lab, v in vectors])
    bad = [(600, 1, None), (601, 1, [1.0, None] * 8), (602, 1, [float("nan")] * 16), (603, 1, [float("inf")] * 16), (604, 1, [1.0] * 8), (605, 1, [])]
    table = spark.createDataFrame([(i, v, lab, "x", 0) for i, lab, v in vectors + bad], "vec_id long, embedding array<float>, label int, code string, error int")
    got = vector_codes.compress_by_label(table).collect()
    total = Counter()
    for _, lab, _, e in want:
        total[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((i, c, e, total[lab], digest) for i, lab, c, e in want)


def test_codes_of_few_vectors(spark):
    shape = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(2, [0.5] * 8, 1), (9, [0.25] * 8, 1)], shape)
    got = {r["vec_id"]: r for r in vector_codes.compress_by_label(few).collect()}
    assert got[2]["code"] == "00" * 8 and got[9]["code"] == "01" * 8 and got[2]["label_error"] == 0
    assert vector_codes.compress_by_label(few.limit(0)).collect() == []
    assert vector_codes.compress_by_label(few.where("vec_id < 0")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_hot_labels_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT", 3)
    rows = [(i, None if i % 2 else i % 40, i) for i in range(200)]
    got = vector_codes.with_sums_by(spark.createDataFrame(rows, "i long, label int, error long"), "label", "error", "total").collect()
    total = Counter()
    for _, lab, e in rows:
        total[lab] += e
    assert Counter((r["i"], r["total"]) for r in got) == Counter((i, total[lab]) for i, lab, _ in rows)


# Toxicity


def _made_up(n=400, seed=3):
    """Texts of random syllables; toxic ones hold a few words of their own list."""
    r = random.Random(seed)
    syllables = "th on er an re ha ou st en ea ti or ed es al le ma ne ro sa".split()
    bad = ["grobnikvash", "plukterwim", "zhevdrastok", "quimblefarn"]
    rows = []
    for i in range(n):
        words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(r.randint(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxic_words_compress_better_with_the_toxic_dictionary():
    rows = _made_up()
    common = [w for w, _ in Counter(w for _, t, y in rows if not y for w in toxicity.windows(t)).most_common(2000)]
    books = toxicity.Books(toxicity.base_dictionary(common), ["grobnikvash", "plukterwim", "idiot"], [])
    counts = books.gains("Grobnikvash, an idiot! the thon PLUKTERWIM haou erst")
    assert counts.sum() == 8 and counts[toxicity.SPAN + 3 :].sum() == 3
    assert (books.gains("a b " * 40) == books.gains("a " * 40) + books.gains("b " * 40)).all()
    assert books.gains(None).sum() == 0 and books.gains("x" * 200).sum() == 4


def test_gains_do_not_depend_on_the_cache(monkeypatch):
    books = toxicity.Books(toxicity.base_dictionary(["the", "and"]), ["grobnikvash"], [])
    text = "the and grobnikvash of all the things " * 3
    want = books.gains(text)
    monkeypatch.setattr(toxicity, "CACHE_WINDOWS", 2)
    fresh = toxicity.Books(books.base, books.toxic, books.ordinary)
    assert (fresh.gains(text) == want).all() and (fresh.gains(text) == want).all()


def test_toxicity_on_held_out_texts(spark):
    rows = _made_up()
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t, _ in rows], "doc_id long, text string, toxic int, word string, fold int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels, crc_mod("doc_id", 4) != 2).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(s >= 0.3 for s, y in held if y) and all(s < 0.3 for s, y in held if not y)


def test_toxicity_cases(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (4, 1), (None, 1), (8, 0), (6, 7), (10, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (3, 4, 5)} == {0.0}
    none = toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_toxicity(empty, labels).collect() == []


# Resampling


def _resampled(docs, target):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    buckets = lambda t: [zlib.crc32(w.encode()) % 10000 for w in word.findall(low(t))]
    own, wanted = Counter(b for _, t in docs for b in buckets(t)), Counter(b for _, t in target for b in buckets(t))
    s, t = own.total(), wanted.total()
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in own}
    out = []
    for i, text in docs:
        f = buckets(text)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ranked = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {id(r): n for n, r in enumerate(ranked[: len(ranked) * 10 // 100], 1)}
    return Counter((*r, rank.get(id(r))) for r in out)


def test_resampling_equals_plain_loops(spark, docs, empty, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    target = [(r["item_id"], r["text"]) for r in bench.collect()]
    more = docs.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id") + 100, "text"))
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    want = _resampled(rows, target)
    assert Counter(map(tuple, resampling.resample(more, bench).collect())) == want
    monkeypatch.setattr(resampling, "CACHE_WORDS", 3)
    assert Counter(map(tuple, resampling.resample(more, bench).collect())) == want
    assert resampling.resample(empty, bench).collect() == []
    assert Counter(map(tuple, resampling.resample(more, bench.limit(0)).collect())) == _resampled(rows, [])


def test_streams_hold_runs_of_words():
    got, words = resampling.stream("a b\tc", run=2)
    assert words == 3 and got.tolist() == [resampling.bucket(f) for f in ("a", "b", "c", "a b", "b c")]
    data = np.array([3, 1, 3, 3, 1], np.uint16).tobytes()
    gain = np.array([0, -5, 0, 2])
    assert resampling.weights(data, np.array([0, 2, 2, 5, 5]), gain).tolist() == [0, -2, 0, -1, 0]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_resampling"])
def test_queries_equal_their_sql(spark, name):
    got, want = compare(queries.QUERIES[name](spark, SF), views(SF), queries.ORACLES[name])
    assert got == want
