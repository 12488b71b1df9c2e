"""The stored indexes: equal to plain loops through upserts, deletes and merges, and reading less than all."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import inverted, search, tiles, vectors, versions

LONG = __import__("pyspark.sql.types", fromlist=["LongType"]).LongType()


def _best(held, asked, k, weighted):
    """query: [(rank, id, score)] by plain loops; held and asked: {id: {token: weight}}."""
    n, df = len(held), Counter(t for w in held.values() for t in w)
    idf = {t: math.log((n - c + 0.5) / (c + 0.5) + 1) if weighted else 1.0 for t, c in df.items()}
    out = set()
    for q, mine in asked.items():
        hits = [(round(sum(w * have[t] * idf[t] for t, w in mine.items() if t in have), 6), i) for i, have in held.items() if mine.keys() & have.keys()]
        hits = sorted((h for h in hits if h[0] > 0), key=lambda h: (-h[0], h[1]))[:k]
        out |= {(q, rank, i, s) for rank, (s, i) in enumerate(hits, 1)}
    return out


def _got(df):
    return {(r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect()}


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(inverted, "TILE_DOCS", 40)
    monkeypatch.setattr("millrace.session.BATCH_ROWS", 20)


def _text(r, words):
    # Few words are common and most are rare, as in texts.
    return " ".join(words[min(int(r.paretovariate(0.6)), len(words)) - 1] for _ in range(r.randint(0, 60)))


def test_inverted_index_through_changes(spark, small_tiles):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        r = random.Random(2)
        words = [f"w{i}" for i in range(900)]
        table = lambda rows: spark.createDataFrame(rows, "id long, text string")
        tokens = lambda t: {x: 1.0 for x in (t or "").lower().split()}
        index, held = inverted.InvertedIndex.open(spark, LONG), {}
        assert index.search(table([(1, "w1 w2")]).withColumnRenamed("id", "query_id"), 5).collect() == []
        asked = {i: _text(r, words) for i in range(12)} | {90: "w1", 91: "", 92: "unheard of", 93: "W1 w1 w2"}
        queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
        steps = [
            {i: _text(r, words) for i in range(300)} | {7: None, 8: ""},
            {i: _text(r, words) for i in range(250, 420)},
            {i: _text(r, words) for i in (1, 2, 3, 400, 900)},
        ]
        for number, step in enumerate(steps):
            assert index.upsert(table(list(step.items()))) == len(step)
            held |= {i: tokens(t) for i, t in step.items()}
            assert index.size() == len(held)
            tally = inverted.Tally()
            weighted = number != 1
            assert _got(index.search(queries, 6, weighted, 6, tally)) == _best(held, {q: tokens(t) for q, t in asked.items()}, 6, weighted)
            assert 0 < tally.read < 2 * tally.of
        gone = [(i,) for i in (0, 5, 250, 399, 12345)]
        assert index.delete(spark.createDataFrame(gone, "id long")) == 4
        held = {i: w for i, w in held.items() if (i,) not in gone}
        want = _best(held, {q: tokens(t) for q, t in asked.items()}, 6, True)
        assert _got(index.search(queries, 6, True, 6)) == want
        assert {x["token"]: x["docs"] for x in index.frequencies().collect()} == Counter(t for w in held.values() for t in w)
        index.merge()
        assert len(index.log.latest()[1]["folders"]) == 1
        assert _got(index.search(queries, 6, True, 6)) == want
        index.upsert(table([(0, "w1 w2 w3"), (0, "w1"), (None, "w1")]))
        held[0] = tokens("w1 w2 w3")
        assert _got(index.search(queries, 6, True, 6)) == _best(held, {q: tokens(t) for q, t in asked.items()}, 6, True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_inverted_index_with_stored_weights(spark):
    r = random.Random(5)
    give = lambda n: {f"t{min(int(r.paretovariate(0.5)), 200)}": float(np.float32(r.uniform(0.1, 3))) for _ in range(n)}
    held, asked = {i: give(r.randint(1, 25)) for i in range(200)}, {i: give(15) for i in range(8)}
    rows = lambda d, name: spark.createDataFrame([(i, list(w), list(w.values())) for i, w in d.items()], f"{name} long, tokens array<string>, weights array<float>")
    index = inverted.InvertedIndex.open(spark, LONG)
    index.upsert(rows(held, "id"))
    for weighted in (True, False):
        got, want = _got(index.search(rows(asked, "query_id"), 5, weighted)), _best(held, asked, 5, weighted)
        assert {g[:3] for g in got} == {w[:3] for w in want}


def test_common_tokens_are_left_for_candidates(spark, small_tiles):
    """A word that all texts have is read in full only where a candidate may need it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        docs = spark.range(1200).select("id", F.concat_ws(" ", F.lit("the of and"), F.concat(F.lit("w"), F.expr("id % 97")), F.concat(F.lit("x"), F.expr("id % 11"))).alias("text"))
        index, tally = inverted.InvertedIndex.open(spark, LONG), inverted.Tally()
        index.upsert(docs)
        q = docs.where("id in (3, 500)").withColumnRenamed("id", "query_id")
        got = _got(index.search(q, 4, True, 6, tally))
        assert got == _got(search.lexical_topk(docs, q, 4, True, 6))
        assert tally.read < 0.35 * tally.of
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_a_lost_writer_leaves_the_index_as_it_was(spark, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "id long, text string")
    index = inverted.InvertedIndex.open(spark, LONG)
    index.upsert(rows((1, "a b"), (2, "b c")))
    with monkeypatch.context() as m:
        m.setattr(index.log, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            index.upsert(rows((1, "z"), (3, "b")))
    q = spark.createDataFrame([(0, "b")], "query_id long, text string")
    assert {r["id"] for r in index.search(q, 5).collect()} == {1, 2} and index.size() == 2
    number, now = index.log.latest()
    with pytest.raises(versions.Conflict):
        index.log.put(number, now)


# Vectors


def _near(held, asked, k):
    out = set()
    for q, v in asked.items():
        s = sorted(((round(float(np.dot(v, x)), 6), i) for i, x in held.items()), key=lambda h: (-h[0], h[1]))[:k]
        out |= {(q, rank, i, x) for rank, (x, i) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("few", [64, 0])
def test_vector_index_through_changes(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "FEW_PACKS", few)
    monkeypatch.setattr(vectors, "BLOCK", 30)
    rng = np.random.default_rng(3)
    table = lambda d, name="id": spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in d], f"{name} long, v array<double>")
    held = {i: rng.standard_normal(70) for i in range(200)}
    asked = {i: rng.standard_normal(70) for i in range(20)}
    bad = [(900, None), (901, [float("nan")] * 70), (902, [1.0] * 3), (None, [1.0] * 70)]
    index = vectors.VectorIndex.open(spark, LONG)
    assert index.search(table([(1, [1.0])], "query_id"), 3).collect() == [] and index.upsert(table([])) == 0
    assert index.upsert(table([*held.items(), *bad])) == 200
    queries = table([*asked.items(), (99, None), (98, [1.0])], "query_id")
    assert _got(index.search(queries, 5, exact=True, digits=6)) == _near(held, asked, 5)
    fresh = {i: rng.standard_normal(70) for i in (3, 4, 150, 500, 501)}
    before = index.centroids()
    assert index.upsert(table(fresh.items())) == 5 and index.size() == 202 and (index.centroids() == before).all()
    held |= fresh
    assert index.delete(spark.createDataFrame([(3,), (10,), (777,)], "id long")) == 2
    held = {i: v for i, v in held.items() if i not in (3, 10)}
    assert _got(index.search(queries, 5, exact=True, digits=6)) == _near(held, asked, 5)
    assert {r["id"]: r["v"] for r in index.vectors().collect()} == {i: v.tolist() for i, v in held.items()}
    near = _got(index.search(queries, 5, digits=6))
    assert len(near) == 100 and len({n[::2] for n in near} & {n[::2] for n in _near(held, asked, 5)}) >= 60


def test_vector_index_reads_a_part_and_finds_most(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = vectors.VectorIndex.open(spark, LONG)
    index.upsert(table)
    held = {r["id"]: np.array(r["v"], float) for r in table.collect()}
    asked = {i: held[i] for i in list(held)[::50]}
    queries = table.where(F.col("id").isin(list(asked))).withColumnRenamed("id", "query_id")
    got, want = _got(index.search(queries, 10, digits=6)), _near(held, asked, 10)
    assert len({g[::2] for g in got} & {w[::2] for w in want}) >= 0.9 * len(want)
    # One query reads the folders of the cells that it probes, under a third of all.
    one = queries.limit(1)
    packs = index._packs(one, index.log.latest()[1], math.ceil(vectors.PROBES * len(index.centroids())))
    pairs = index._pairs(packs, ["vectors"])
    files = lambda df: {f for f in df.inputFiles() if "/blocks/" in f}
    assert len({f.split("/cell=")[1].split("/")[0] for f in files(index.blocks())}) == len(index.centroids())
    assert pairs.select("cell").distinct().count() < len(index.centroids()) / 3
    quantised = _got(index.search(queries, 10, exact=True, quantised=True, digits=6))
    assert quantised == {(r["query_id"], r["rank"], r["id"], r["score"]) for r in search.quantised_topk(table, table.where(F.col("id").isin(list(asked))), 10, id_col="id", vec_col="v", digits=6).collect()}


def test_exact_graph_keeps_each_vector_once(spark, monkeypatch):
    """All pairs without an index, whose search keeps every query once for each cell; packs of three, tied and left-out vectors."""
    monkeypatch.setattr(vectors.VectorIndex, "open", None)
    monkeypatch.setattr(vectors, "PACK_ROWS", 3)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40, 5)), 1)
    x[7] = x[3] = x[21]
    rows = [(f"v{i:02}", v.tolist()) for i, v in enumerate(x)] + [("null", None), ("nan", [float("nan")] * 5), ("short", [9.0]), (None, [9.0] * 5)]
    want = set()
    s = np.round(x @ x.T, 6)
    for i in range(40):
        first = sorted(range(40), key=lambda j: (-s[i, j], j))[:4]
        want |= {(f"v{i:02}", f"v{j:02}", s[i, j]) for j in [j for j in first if j != i][:3] if s[i, j] >= 0.5}
    got = vectors.similarity_graph(spark.createDataFrame(rows, "vec_id string, embedding array<double>"), 3, 0.5, digits=6).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vectors.similarity_graph(spark.createDataFrame([], "vec_id long, embedding array<float>"), 3, 0.5).count() == 0


def test_dead_postings_are_told_by_bits():
    """Masks of a tile's dead documents are bits that a block carries; null and short masks, empty blocks."""
    pa = inverted.pa
    docs = [[0, 3, 9], [], [1, 2000], [7, 8, 40]]
    gone = [[3, 4], [1], None, [0, 8]]
    lists = pa.RecordBatch.from_arrays([pa.array([0, 1, 3], pa.int64()), pa.array([g for g in gone if g], pa.list_(pa.int32()))], ["tile", "locals"])
    made = next(inverted._packed(iter([lists]))).column(1).to_pylist()
    assert max(map(len, made)) <= 2
    masks = pa.array([made[0], made[1], None, made[2]], pa.binary())
    dead, owner, every = inverted._dead(pa.array([np.array(d, np.uint16).tobytes() for d in docs], pa.binary()), masks)
    assert owner.tolist() == [0, 0, 0, 2, 2, 3, 3, 3] and every.tolist() == sum(docs, [])
    assert dead.tolist() == [False, True, False, False, False, False, True, False]


def _pack(r, asked, held, n_tokens):
    """Random queries and a pack of texts, and their scores by plain loops."""
    queries = [{t: r.choice([1.0, 2.5]) for t in range(n_tokens) if r.random() < 0.6 / (1 + t % 9)} for _ in range(asked)]
    texts = [{t: float(np.float32(r.uniform(0.5, 2))) for t in range(n_tokens) if r.random() < 0.9 / (1 + t % 7)} for _ in range(held)]
    post = [[i for i, x in enumerate(texts) if t in x] for t in range(n_tokens)]
    edges = np.append(0, np.cumsum([len(p) for p in post]))
    given = np.array([texts[i][t] for t, p in enumerate(post) for i in p], np.float32)
    start = np.append(0, np.cumsum([len(q) for q in queries]))
    token, weight = np.array([t for q in queries for t in q]), np.array([w for q in queries for w in q.values()])
    return queries, texts, (start, token, weight, np.arange(n_tokens), edges, np.array(sum(post, []), np.uint16), held), given


@pytest.mark.parametrize("share", [0.0, 0.1, 2.0])
def test_scores_of_packs(monkeypatch, share):
    """Tokens multiplied as matrices, counted up, or in part either: equal to plain loops; ties go to the smaller id."""
    monkeypatch.setattr(tiles, "DENSE_SHARE", share)
    monkeypatch.setattr(tiles, "CELLS", 150)
    queries, texts, pack, given = _pack(random.Random(9), 11, 70, 40)
    for mine, stored in ((pack, given), (pack, None), ((*pack[:2], np.ones(len(pack[1])), *pack[3:]), None)):
        ones = stored is None and mine[2].max() == 1
        want = [[sum((1.0 if ones else w) * (1.0 if stored is None else x[t]) for t, w in q.items() if t in x) for x in texts] for q in queries]
        got = np.concatenate([s for _, s in tiles.scores(*mine, stored)])
        assert np.allclose(got, want, atol=1e-9)
        best, ids = tiles.Best(np.arange(11), 4, None if ones else 6, 0.0), np.arange(70) * 3
        for half in (slice(0, 35), slice(35, 70)):
            best.offer(0, got[:, half], ids[half])
            best.settle()
        hits = best.rows([tiles.id_type("bigint")] * 2).to_pylist()
        rank = lambda row: sorted(((-round(s, 6), i * 3) for i, s in enumerate(row) if s > 0))[:4]
        assert [(h["query_id"], -round(h["score"], 6), h["id"]) for h in hits] == [(q, *x) for q, row in enumerate(want) for x in rank(row)]


@pytest.mark.parametrize("share", [0.0, 0.6, 0.99])
def test_texts_over_a_bound(monkeypatch, share):
    """Tokens left out, added as rows or counted up: all texts over the bound have their whole score, and few others are looked at."""
    monkeypatch.setattr(tiles, "LEFT_SHARE", share)
    queries, texts, pack, _ = _pack(random.Random(4), 11, 70, 40)
    for weight in (pack[2], np.ones(len(pack[1]))):
        held = weight.max() == 1
        want = np.array([[sum((1.0 if held else w) for t, w in q.items() if t in x) for x in texts] for q in queries])
        for wide in (1, 1 << 26):
            monkeypatch.setattr(tiles, "HELD", wide)
            for least in (np.full(11, -np.inf), np.sort(want, axis=1)[:, -4], want.max(axis=1) + 1):
                seen = {i: dict(zip(found.tolist(), s.tolist(), strict=True)) for i, found, s in tiles.over(pack[0], pack[1], weight, *pack[3:], least)}
                for i, row in enumerate(want):
                    hits = {j: x for j, x in enumerate(row) if x > 0 and x >= least[i]}
                    assert {j: x for j, x in seen.get(i, {}).items() if x >= least[i]} == pytest.approx(hits)
                    assert all(x == pytest.approx(row[j]) for j, x in seen.get(i, {}).items())
                if share < 0.9 and least[0] > want[0].max():
                    assert sum(map(len, seen.values())) < 70
    edges, some, n = tiles.longest(*pack[4:], 9)
    sizes = np.array([len(x) for x in texts])
    most = np.sort(np.argsort(-sizes, kind="stable")[:9])
    assert n == 9 and [some[a:b].tolist() for a, b in zip(edges, edges[1:])] == [[i for i, j in enumerate(most) if t in texts[j]] for t in range(40)]


def test_packs_of_texts_are_merged(monkeypatch):
    """Texts in packs, repeated words and spaces at the ends; packs become one, up to its bounds."""
    texts = {7: " a b\t a", 3: "b c", 9: "", 1: "c\x0b a c \n", 4: "d"}
    rows = [pa.RecordBatch.from_pydict({"id": pa.array([i], pa.int64()), "t": [t]}) for i, t in texts.items()]

    def holds(packs):
        out = {}
        for p in packs:
            ids, words, at = p.column(0)[0].as_py(), tiles.opened(p.column(1)[0]), np.frombuffer(p.column(2)[0].as_py(), np.uint16)
            assert ids == sorted(ids)
            for t, part in zip(words["word"].to_pylist(), np.split(at, np.cumsum(words["n"].to_numpy())[:-1]), strict=True):
                assert sorted(set(part.tolist())) == part.tolist()
                for i in part:
                    out.setdefault(ids[i], set()).add(t)
        return out

    monkeypatch.setattr(tiles, "PACK_BYTES", 1)
    want = {i: set(t.split()) for i, t in texts.items() if t.split()}
    parts = list(tiles.pack_texts("bigint")(iter(rows)))
    merged = list(tiles.merge_packs("bigint")(iter(parts)))
    assert (len(parts), len(merged)) == (5, 1) and holds(parts) == holds(merged) == want
    monkeypatch.setattr(tiles, "PACK_TEXTS", 2)
    halves = list(tiles.merge_packs("bigint")(iter(parts)))
    assert len(halves) == 3 and holds(halves) == want


def test_a_pool_has_the_tokens_of_its_first_texts(spark):
    docs = spark.createDataFrame([(1, "B a a"), (2, "a c"), (3, "x"), (4, None)], "id long, text string")
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 2)], "query_id long, rank int, id long")
    got = search.with_tokens(hits, docs, docs.withColumnRenamed("id", "query_id"), 2)
    assert {(r["query_id"], r["id"]): (r["query_tokens"], r["text_tokens"]) for r in got.collect()} == {
        (1, 1): (["b", "a"], ["b", "a"]), (1, 2): (["b", "a"], ["a", "c"]), (1, 3): (None, None), (2, 2): (["a", "c"], ["a", "c"])
    }
    score = search.token_overlap(F.col("query_tokens"), F.col("text_tokens"))
    assert {(r["query_id"], r["id"]): r["s"] for r in got.select("query_id", "id", score.alias("s")).collect() if r["s"]} == {(1, 1): 1.0, (1, 2): 0.5, (2, 2): 1.0}


def test_a_task_keeps_the_best_hits_of_its_packs(spark, monkeypatch):
    """Rows that a search shuffles don't grow with the number of batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    rows, whole = [], search.ranked
    monkeypatch.setattr(search, "ranked", lambda hits, k, *a: rows.append(hits.count()) or whole(hits, k, *a))
    try:
        docs = spark.range(2000).select("id", F.concat_ws(" ", F.lit("the of"), F.concat(F.lit("w"), F.expr("id % 97"))).alias("text")).coalesce(1)
        for weighted in (True, False):
            got = search.lexical_topk(docs, docs.where("id < 3").withColumnRenamed("id", "query_id"), 4, weighted, 6)
            assert {(r["query_id"], r["rank"]): r["id"] for r in got.collect()} == {(q, n + 1): q + 97 * n for q in range(3) for n in range(4)}
        assert rows == [12, 12]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_a_token_is_one_block_of_many_documents(spark):
    index = inverted.InvertedIndex.open(spark, LONG)
    index.upsert(spark.range(3000).select("id", F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), F.expr("id % 7"))).alias("text")).coalesce(1))
    assert index.blocks().count() == 8


def test_a_task_keeps_the_nearest_vectors_of_its_batches(spark, monkeypatch):
    """As above, for vectors: k hits of each query and task, and ties to the smaller id."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    rows, whole = [], search.ranked
    monkeypatch.setattr(search, "ranked", lambda hits, k, *a: rows.append(hits.count()) or whole(hits, k, *a))
    monkeypatch.setattr(search, "TILE", 800)
    try:
        e = spark.range(600).select(F.col("id").alias("vec_id"), F.array(F.expr("double(id % 50)"), F.lit(-1.0)).alias("embedding")).coalesce(1)
        got = search.dense_topk(e, e.where("vec_id < 3"), 4, digits=6).collect()
        assert {(r["query_id"], r["rank"]): r["id"] for r in got if r["query_id"]} == {(q, n + 1): 49 + 50 * n for q in (1, 2) for n in range(4)}
        assert sorted(r["id"] for r in got if r["query_id"] == 0) == [0, 1, 2, 3] and rows == [12]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
