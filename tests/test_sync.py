"""Stores, syncs and readers that must lose nothing."""

import math
import random
import re
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import secrets
from millrace.operators import search, state, versions
from millrace.sources import files
from millrace.streaming import sync


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_store_switches_at_once(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s", "k string, v long", "k")
    assert store.read().count() == 0
    made = lambda *kv: spark.createDataFrame(kv, "k string, v long")
    store.write(made(("a", 1)))
    old = store.read()
    store.upsert(made(("a", 2), ("b", 3)))
    assert rows(old, "k", "v") == [("a", 1)] and rows(store.read(), "k", "v") == [("a", 2), ("b", 3)]
    # A writer that dies before its commit leaves the table as it was.
    made(("z", 9)).write.parquet(f"{tmp_path}/s/delta-lost")
    assert rows(store.read(), "k", "v") == [("a", 2), ("b", 3)] and store.vacuum() == 1
    for i in range(4):
        store.upsert(made(("a", i)))
    assert len(list(Path(tmp_path, "s/_log").glob("*.json"))) == 2
    assert store.delete(made(("b", 0), ("zz", 0))) == 1
    assert rows(store.read(), "k", "v") == [("a", 3)]
    # Two writers of one number: an error for the second, and the table stays readable.
    number, now = store.log.latest()
    with pytest.raises(versions.Conflict):
        store._put(number, now["base"], [], 0, now)
    assert rows(store.read(), "k", "v") == [("a", 3)]


def test_one_row_is_one_small_file(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s", "k string, s string, v long", "k", by="s")
    made = lambda *r: spark.createDataFrame(r, store.schema)
    store.write(made(*[(f"{i}", f"s{i % 5}", i) for i in range(400)]))
    files = lambda: {str(p) for p in Path(tmp_path, "s").rglob("*.parquet")}
    before = files()
    store.upsert(made(("new", "s1", -1)))
    (fresh,) = files() - before
    assert "delta-" in fresh and before < files() and Path(fresh).stat().st_size < 4000
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan and "BroadcastExchange" in plan
    assert sorted(r["v"] for r in store.of("s1").collect()) == [-1, *range(1, 400, 5)]
    assert len(store.of("s1").inputFiles()) < len(store.read().inputFiles())


def test_store_equals_a_dict_through_folds_and_crashes(spark, tmp_path, monkeypatch):
    """Random writes, some of which die before their commit; deltas are folded every few writes."""
    monkeypatch.setattr(state.Store, "DELTAS", 3)
    monkeypatch.setattr(state.Store, "DELTA_ROWS", 25)
    r = random.Random(4)
    store = state.Store(spark, f"file://{tmp_path}/s", "k long, g long, v array<long>", "k", by="g")
    made = lambda rows: spark.createDataFrame(rows, store.schema)
    want: dict[int, list[int]] = {}
    for step in range(14):
        put = {k: [step, k] for k in r.sample(range(40), r.choice((1, 4, 30)))}
        gone = r.sample(range(40), 3)
        if step % 4 == 3:
            with monkeypatch.context() as m:
                m.setattr(store.log, "put", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError, match="lost"):
                    store.apply(made([(k, k % 7, v) for k, v in put.items()]), made([(k, None, None) for k in gone]))
        else:
            store.apply(made([(k, k % 7, v) for k, v in put.items()]), made([(k, None, None) for k in gone]))
            want = {k: v for k, v in want.items() if k not in gone} | put
        assert {x["k"]: x["v"] for x in store.read().collect()} == want, step
    store.compact()
    assert {x["k"]: x["v"] for x in store.read().collect()} == want
    assert {x["k"] for x in store.of(3).collect()} == {k for k in want if k % 7 == 3}
    assert store.vacuum() > 0 and {x["k"]: x["v"] for x in store.read().collect()} == want
    store.upsert(made([(None, 1, [1]), (1, 1, [1]), (1, 1, [1])]))
    assert [x["v"] for x in store.read().where("k = 1").collect()] == [[1]] and store.read().where("k is null").isEmpty()


def test_null_content_is_there(spark, tmp_path):
    of = lambda *r: spark.createDataFrame(r, "source_id string, content_hash string")
    got = lambda now, was: rows(state.sync_plan(of(*now), of(*was)), "source_id", "action")
    assert got([("a", None)], [("a", "h")]) == [("a", "change")]
    assert got([("a", None)], [("a", None)]) == [("a", "keep")]
    assert got([("a", None), ("b", "h")], [("b", None)]) == [("a", "add"), ("b", "change")]
    assert got([], [("a", None)]) == [("a", "delete")]
    store = state.Store(spark, f"file://{tmp_path}/s", sync.STATE, "source_id")
    batch = lambda *r: spark.createDataFrame(r, "source_id string, content string")
    sync.apply_batch(store, batch(("a", "x"), ("b", "y")))
    sync.apply_batch(store, batch(("a", None)))
    assert rows(store.read(), "source_id", "content") == [("a", None), ("b", "y")]
    assert rows(sync.apply_batch(store, batch(("a", None))), "source_id", "action") == [("a", "keep")]


def test_the_last_row_of_a_source_counts(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s", sync.STATE, "source_id")
    batch = lambda *r: spark.createDataFrame(r, "source_id string, content string, at long, deleted boolean")
    sync.apply_batch(store, batch(("s", "zzz old", 1, False), ("s", "new", 2, False), ("t", "t", 1, None)))
    assert rows(store.read(), "source_id", "content") == [("s", "new"), ("t", "t")]
    again = sync.apply_batch(store, batch(("s", "new", 3, False)))
    assert rows(again, "source_id", "action") == [("s", "keep")]
    plan = sync.apply_batch(store, batch(("s", "newer", 4, False), ("t", "t", 5, True), ("u", "u", 1, False), ("u", "u", 2, True)))
    assert rows(plan, "source_id", "action") == [("s", "change"), ("t", "delete")]
    assert rows(store.read(), "source_id", "content") == [("s", "newer")]


def test_sync_down_to_chunks(spark, tmp_path):
    sources = state.Store(spark, f"file://{tmp_path}/sources", sync.SOURCES, "source_id")
    chunks = state.Store(spark, f"file://{tmp_path}/chunks", sync.CHUNKS, "chunk_id")
    docs = lambda *r: spark.createDataFrame(r, "source_id string, title string, content string")
    one, two, three = ("a", "A", "# Top\n\nabout networks and routers"), ("b", "B", "pasta with tomato"), ("c", "C", "gardens in spring")
    plan = sync.apply_sync(sources, chunks, docs(one, two, three), "day 1")
    assert rows(plan, "source_id", "action") == [(x, "add") for x in "abc"]
    first = {r["source_id"]: r for r in sources.read().collect()}
    assert {r["source_id"]: [r["chunk_id"]] for r in chunks.read().collect()} == {k: r["chunk_ids"] for k, r in first.items()}
    # A changed document gets new chunks, a deleted one loses its, an old one only its date.
    plan = sync.apply_sync(sources, chunks, docs(one, ("b", "B", "pasta without tomato")), "day 2")
    assert rows(plan, "source_id", "action") == [("a", "keep"), ("b", "change"), ("c", "delete")]
    now = {r["source_id"]: r for r in sources.read().collect()}
    assert set(now) == {"a", "b"} and now["a"]["chunk_ids"] == first["a"]["chunk_ids"] and now["b"]["chunk_ids"] != first["b"]["chunk_ids"]
    assert {r["last_seen"] for r in now.values()} == {"day 2"}
    assert [t for s, t in rows(chunks.read(), "source_id", "text") if s != "a"] == ["pasta without tomato"] and chunks.read().count() == 2
    # A batch of some documents deletes nothing else.
    sync.apply_sync(sources, chunks, docs(("d", "D", "")), "day 3", batch_only=True)
    assert rows(sources.read(), "source_id", "last_seen") == [("a", "day 2"), ("b", "day 2"), ("d", "day 3")]
    assert {r["source_id"]: r["chunk_ids"] for r in sources.read().collect()}["d"] == []


def test_stream_with_changes_deletes_and_a_replay(spark, tmp_path):
    schema = "source_id string, content string, at long, deleted boolean"
    store = state.Store(spark, f"file://{tmp_path}/s", sync.STATE, "source_id")
    put = lambda n, *r: spark.createDataFrame(r, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda check: sync.stream_sync(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), store, f"{tmp_path}/{check}").awaitTermination()
    put(1, ("a", "a1", 1, False), ("b", "b1", 1, False))
    run("c")
    put(2, ("a", "a2", 2, False), ("b", "", 2, True), ("c", "c1", 2, False))
    run("c")
    assert rows(store.read(), "source_id", "content") == [("a", "a2"), ("c", "c1")]
    run("c")
    run("another")  # without its checkpoint every file comes once more
    assert rows(store.read(), "source_id", "content") == [("a", "a2"), ("c", "c1")]


def test_a_bad_byte_is_replaced(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"good \xff bad")
    (tmp_path / "b.txt").write_text("fine ü")
    assert rows(files.read_txt(spark, f"file://{tmp_path}"), "title", "content") == [("a", "good \ufffd bad"), ("b", "fine ü")]


def test_lexical_search_of_whole_texts(spark, monkeypatch):
    texts = [(f"d{i}", " ".join(f"w{(i * j) % 17}" for j in range(1, 40))) for i in range(60)] + [("e", ""), ("n", None), ("common", "w0 " * 5000 + "rare")]
    df = spark.createDataFrame(texts, "id string, text string").repartition(5)
    q = df.where("id in ('d3', 'd50', 'common', 'e', 'n')").withColumnRenamed("id", "query_id")
    sets = {k: set((t or "").lower().split()) for k, t in texts}
    n = {w: sum(w in s for s in sets.values()) for s in sets.values() for w in s}
    idf = {w: math.log((len(texts) - c + 0.5) / (c + 0.5) + 1) for w, c in n.items()}
    for weighted in (True, False):
        got = {}
        for r in search.lexical_topk(df, q, 7, weighted, 6).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        for k in ("d3", "d50", "common"):
            score = {d: round(sum(idf[w] if weighted else 1.0 for w in sets[k] & s), 6) for d, s in sets.items()}
            want = sorted(((d, s) for d, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:7]
            assert got[k] == want, (weighted, k)
        assert set(got) == {"d3", "d50", "common"}
    apart = spark.createDataFrame([(1, "one two"), (2, "three")], "id long, text string").coalesce(1)
    monkeypatch.setattr(search, "TILE", 1)  # a tile for every query: one of them finds nothing
    asked = spark.createDataFrame([(1, "two"), (2, "nothing"), (3, "three one")], "query_id long, text string")
    hits = search.lexical_topk(apart, asked.where("query_id > 1").unionByName(asked.where("query_id = 1")), 5, weighted=False)
    assert sorted((r["query_id"], r["id"]) for r in hits.collect()) == [(1, 1), (3, 1), (3, 2)]


def test_packed_signs(spark):
    r = random.Random(1)
    v = [(i, [r.gauss(0, 1) for _ in range(130)]) for i in range(40)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    assert len(df.select(search.sign_bits(F.col("embedding")).alias("b")).first()["b"]) == 3
    got = {}
    for x in search.quantised_topk(df, df.where("vec_id < 4"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["id"])
    for q, a in v[:4]:
        near = sorted((sum((x > 0) != (y > 0) for x, y in zip(a, b, strict=True)), i) for i, b in v)[:6]
        dot = {i: sum(x * y for x, y in zip(a, v[i][1], strict=True)) for _, i in near}
        assert got[q] == sorted(dot, key=lambda i: (-dot[i], i))[:3]


def test_redaction_equals_a_plain_rule(spark):
    """Of overlapping secrets the leftmost goes, of those that begin together the first kind; what it covers is used up."""
    r = random.Random(8)
    n = "A1b2" * 10
    bits = ["AKIA" + "ABCDEFGHIJKLMNOP", "sk-ant-api03-" + n, "sk-proj-" + n, "aws_secret = " + n, "xoxb-" + n, "ghp_" + n, " ", "é漢", ", ", "x", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----"]
    texts = ["", "nothing here", *("".join(r.choices(bits, k=r.randint(1, 9))) for _ in range(60))]

    def plain(text):
        found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(secrets.PATTERNS.items()) for m in re.finditer(p, text))
        out, at = "", 0
        for start, _, end, kind in found:
            if start >= at:
                out, at = out + text[at:start] + f"<REDACTED:{kind}>", end
        return out + text[at:]

    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {x["t"]: x["r"] for x in df.select("t", secrets.redact(F.col("t")).alias("r")).collect()}
    assert got == {None: None} | {t: plain(t) for t in texts}
    assert sum(t != plain(t) for t in texts) > 30


def test_a_cluster_needs_a_shared_folder():
    def session_on(master, conf, given):
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        context = SimpleNamespace(environment={}, master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: conf or default))

    assert session.shared_dir(session_on("spark://h:1", "hdfs://a/b/", "hdfs://c")) == "hdfs://a/b"
    assert session.shared_dir(session_on("spark://h:1", None, "hdfs://c/d")) == "hdfs://c/d"
    for master in ("spark://h:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(session_on(master, None, None))
