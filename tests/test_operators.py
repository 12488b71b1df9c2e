import os
import random
import zipfile
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import config, ops
from millrace.functions import secrets, timehint
from millrace.functions import text as T
from millrace.operators import chat, chunking, cluster, dedupe, graph, search, state
from millrace.sources import files
from millrace.streaming import sync

NOW = datetime(2024, 5, 15, 12, 30, tzinfo=timezone.utc)


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Note", ("Note", None, None)), ("Note|Alias", ("Note", None, "Alias")), ("Note#Section", ("Note", "Section", None)), (" Note # S | A ", ("Note", "S", "A")), ("Note#|", ("Note", None, None))],
)
def test_split_link(spark, raw, want):
    assert tuple(one(spark, T.split_link, raw)) == want


def test_links_and_tags(spark):
    body = "x [[A]] and ![[B#h]] [[A|again]] [[ ]] #one mid#no\n# Head\n#two/x #one"
    assert one(spark, T.wikilinks, body) == ["A", "B"]
    assert one(spark, T.inline_tags, body) == ["one", "two/x"]
    assert one(spark, T.strip_mentions, "see [[Plan]], [[Notes#S|my alias]] and [[N#h]]") == "see Plan, my alias and N"


def test_norm_key_folds_case_and_form(spark):
    fold = lambda s: one(spark, T.norm_key, s)
    assert fold("Straße") == fold("STRASSE ") == "strasse" and fold("Café") == fold("Café") and fold(" ABC ") == "abc"


def test_chunk_id_and_scores(spark):
    df = spark.createDataFrame([("s", 0, "a", ""), ("s", 1, "a", "given")], "s string, i int, t string, g string")
    a, b = [r[0] for r in df.select(T.chunk_id(F.col("s"), F.col("i"), F.col("t"), F.col("g"))).collect()]
    assert a == "s::0::ca978112ca1bbdca" and b == "given"
    row = spark.createDataFrame([(0.0, 0.0, 0.7), (None, 0.2, 0.7), (None, None, None)], "a double, b double, c double").select(T.final_score(F.col("a"), F.col("b"), F.col("c")).alias("x"))
    assert [r["x"] for r in row.collect()] == [0.7, 0.2, 0.0]


def test_parse_batch(spark):
    raw = 'Sure: {"contexts": [{"id": "1", "context": " a "}, {"id": "x", "context": "b"}, {"id": 2, "context": ""}, {"id": 1, "context": "last"}]} ok'
    assert one(spark, T.parse_batch, raw) == {1: "last"} and one(spark, T.parse_batch, "garbage") == {}


def test_slash_and_plan(spark):
    s = lambda t: one(spark, T.parse_slash, t)
    assert s("plain").cmd is None and s("/zoomies x").query == "/zoomies x" and s("/?").show_help
    assert (s("/kb find it").force_path, s("/KB find it").query) == ("retrieve", "find it") and s("/dry x").dry_run
    assert one(spark, T.parse_plan, "learning plan:\n1. A\n 2. B \n\n3. C") == ["A", "B"] and one(spark, T.parse_plan, "no") == []


@pytest.mark.parametrize("url", ["dQw4w9WgXcQ", "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=1", "https://youtu.be/dQw4w9WgXcQ", "https://x/embed/dQw4w9WgXcQ", "https://x/shorts/dQw4w9WgXcQ?a=b"])
def test_video_id(spark, url):
    assert one(spark, T.video_id, url) == "dQw4w9WgXcQ" and one(spark, T.video_id, "https://example.com/page") is None


def test_secrets(spark):
    aws, ant = "AKIA" + "A1" * 8, "sk-ant-api03-" + "x" * 24
    text = f"a {aws} b {ant} c"
    assert one(spark, secrets.redact, text) == "a <REDACTED:aws_access_key> b <REDACTED:openai_key> c"
    df = spark.createDataFrame([("1", text), ("2", "clean"), ("3", None)], "id string, text string")
    assert [r["text"] for r in secrets.scrub(df).orderBy("id").collect()] == ["a <REDACTED:aws_access_key> b <REDACTED:openai_key> c", "clean", None]
    assert [r["id"] for r in secrets.scrub(df, "block").orderBy("id").collect()] == ["2", "3"]
    assert secrets.scrub(df, "warn").collect() == df.collect()


def test_time_hints():
    last = datetime(2024, 1, 31, tzinfo=timezone.utc)
    assert [timehint.parse_date(f"{n} month ago", last).date().isoformat() for n in (1, 2, 11)] == ["2023-12-31", "2023-11-30", "2023-02-28"]
    assert timehint.extract_hint("notes from last March about X") == "last March" and timehint.extract_hint("plain question") is None
    where, label = timehint.time_filter("what did I do this week", NOW)
    assert label == "this week" and where["modified_at"]["gte"] == datetime(2024, 5, 13, tzinfo=timezone.utc)
    assert timehint.time_filter("yesterday's meeting", NOW)[0]["modified_at"]["gte"].day == 14
    assert timehint.time_filter("everything since 2024 on topic", NOW)[0]["modified_at"]["gte"].year == 2024
    assert timehint.time_filter("plain", NOW) == (None, "")
    assert timehint.date_range("3 months ago", NOW)[0].month == 2


def test_recency(spark):
    df = spark.createDataFrame([(1.0, "2024-05-15 12:30:00"), (1.0, "2023-11-17 12:30:00"), (1.0, None)], "s double, m string").withColumn("m", F.col("m").cast("timestamp"))
    got = [r[0] for r in df.select(search.recency(F.col("s"), F.col("m"), F.col("m"), "2024-05-15 12:30:00", 0.5)).collect()]
    assert got == pytest.approx([1.0, 0.75, 1.0])


def test_rrf_puts_shared_hits_first(spark):
    rows = [(0, x, i) for i, x in enumerate("abc", 1)] + [(0, x, i) for i, x in enumerate("bad", 1)]
    got = search.rrf(spark.createDataFrame(rows, "query_id int, id string, rank int")).orderBy(F.desc("score"), "id").collect()
    assert {got[0]["id"], got[1]["id"]} == {"a", "b"}


def test_filters(spark):
    df = spark.createDataFrame([(1, ["security"], "x"), (2, ["security", "a"], "y"), (3, ["python"], "x")], "id int, tags array<string>, kind string")
    ids = lambda w: [r["id"] for r in search.payload_filter(df, w).orderBy("id").collect()]
    assert ids({"tags": ["security"]}) == [1, 2] and ids({"tags": "python"}) == [3] and ids({"id": {"gt": 1, "lte": 2}}) == [2]
    assert ids({"tags": []}) == [] and ids(None) == [1, 2, 3] and ids({"kind": ["x"], "tags": "security"}) == [1]


def test_hybrid_finds_the_right_note(spark):
    texts = ["arp spoof network attack", "python decorators wrap functions", "network layers and packets", "pasta with tomato"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("v", search.hash_embed(F.col("text")))
    q = spark.createDataFrame([(9, "arp network spoof")], "query_id long, text string").withColumn("v", search.hash_embed(F.col("text")))
    got = [r["id"] for r in search.hybrid(df.select("id", "text"), df.select("id", "v"), q).orderBy("rank").collect()]
    assert got[0] == 0 and 3 not in got[:2]


def test_graph(spark):
    rows = [(0, "a", "Alpha", [], ["Beta"]), (1, "b", "B", ["Beta"], ["alpha", "C", "nowhere"]), (2, "c", "C", [], [])]
    notes = spark.createDataFrame(rows, "pos long, source_id string, title string, aliases array<string>, wikilinks array<string>")
    edges = graph.link_graph(notes)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("b", "a"), ("b", "c")}
    start = spark.createDataFrame([("a",)], "start string")
    assert {r["node"] for r in graph.neighbours(edges, start, 1).collect()} == {"b"}
    assert {r["node"] for r in graph.neighbours(edges, start, 2).collect()} == {"b", "c"}
    pair = spark.createDataFrame([("x", "y"), ("y", "z"), ("p", "q")], "src string, dst string")
    assert [r["members"] for r in graph.communities(pair, 3).collect()] == [["x", "y", "z"]]


def test_dedupe(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen "
    rows = [(0, a + "fourteen"), (1, a + "other"), (2, "hello world"), (3, "Hello\n\nworld"), (4, "something else")]
    df = spark.createDataFrame(rows, "pos long, text string")
    assert [r["pos"] for r in dedupe.dedupe(df, 0.7).orderBy("pos").collect()] == [0, 2, 4]


def test_chunking(spark):
    sections = chunking.split_headers("# A\nx\n## B\ny\n```\n# no\n```\n## C\nz")
    assert [p for _, p in sections] == [["A"], ["A", "B"], ["A", "C"]]
    text = "# Top\n" + " ".join(f"word{i}" for i in range(1000))
    pieces = chunking.chunk_text(text, 200, 20)
    assert all(len(t) <= 200 and p == ["Top"] for t, p in pieces) and all(f"word{i}" in " ".join(t for t, _ in pieces) for i in range(1000))
    docs = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "source_id string, content string")
    rows = chunking.chunk_documents(docs).collect()
    assert {r["source_id"] for r in rows} == {"a"} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert chunking.segment_offsets("aa bb cc", ["aa", "bb"]) == [(0, 2), (3, 5)] and len(chunking.segment_offsets("abcd", ["x", "y"])) == 2


def test_state(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "t"), "source_id string, content_hash string", "source_id")
    rows = lambda *x: spark.createDataFrame(list(x), store.schema)
    assert store.read().count() == 0 and store.upsert(rows(("a", "1"), ("b", "1"))) == 2
    store.upsert(rows(("b", "2"), ("c", "1")))
    assert sorted(map(tuple, store.read().collect())) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert store.delete(rows(("a", ""), ("zz", ""))) == 1 and store.read().count() == 2
    plan = state.sync_plan(rows(("b", "3"), ("d", "1"), ("c", "1")), store.read().unionByName(rows(("e", "1"))))
    assert {r["source_id"]: r["action"] for r in plan.collect()} == {"b": "change", "c": "keep", "d": "add", "e": "delete"}
    with pytest.raises(ValueError, match="compatible"):
        state.check_stamp({"embed_model": "m", "embed_dim": 8, "binary_quantization": False}, "m", 16, False)
    state.check_stamp(None, "m", 16, False)


def test_stream_in_batches(spark, tmp_path):
    store = state.Store(spark, str(tmp_path / "store"), sync.STATE, "source_id")
    schema = "source_id string, content string"
    for batch in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        sync.stream_sync(sync.read_stream(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "cp")).awaitTermination()
    assert {r["source_id"]: r["content"] for r in store.read().collect()} == {"a": "1", "b": "2", "c": "1"}


def test_vault(spark, tmp_path):
    notes = {
        "Index.md": "---\ntags: [moc, '#security']\naliases: [MOC]\n---\n# Index\n[[ARP Spoofing]] [[Python Decorators|decorators]] #network\n![[Snippet]]",
        "ARP Spoofing.md": "# ARP\n[[Index]]", "Snippet.md": "the snippet ![[Loop]]", "Loop.md": "![[Snippet]]", ".obsidian/x.md": "skip", "Bad.md": "---\n: invalid : yaml\n---\nBody",
    }
    for name, text in notes.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    rows = {r["rel"]: r for r in files.read_vault(spark, str(tmp_path)).collect()}
    assert set(rows) == set(notes) - {".obsidian/x.md"}
    index = rows["Index.md"]
    assert index["tags"] == ["moc", "network", "security"] and index["aliases"] == ["MOC"] and index["title"] == "Index"
    assert "the snippet" in index["content"] and "![[Loop]]" in rows["Loop.md"]["content"]
    assert index["wikilinks"] == ["ARP Spoofing", "Python Decorators", "Snippet"]


def test_other_sources(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("plain")
    with zipfile.ZipFile(tmp_path / "book.epub", "w") as z:
        z.writestr("c1.xhtml", "<html><body><h1>One</h1><p>text &amp; more</p><script>no</script></body></html>")
    txt = files.read_txt(spark, str(tmp_path)).first()
    assert (txt["source_id"], txt["title"], txt["content"]) == ("txt:a b.txt", "a b", "plain")
    assert files.read_epub(spark, str(tmp_path)).first()["content"] == "One\ntext & more"
    (tmp_path / "pic.PNG").write_bytes(b"x")
    assert [r["name_key"] for r in files.read_images(spark, str(tmp_path)).collect()] == ["pic.png"]
    lines = spark.createDataFrame([("v", "T", 1, "b"), ("v", "T", 0, "a")], "video_id string, title string, pos int, line string")
    assert files.transcripts_as_documents(lines).first()["content"] == "# T\n\n## Transcript\n\na\nb\n"


def test_chat_pieces(spark):
    assert chat.round_robin(list("abcde"), 2) == [["a", "c", "e"], ["b", "d"]] and chat.round_robin(["a"], 4) == [["a"]]
    assert [chat.route_from_critic(*c) for c in (("good", 0), ("revise", 1, 1), ("revise", 2, 1), ("revise", 1, 0))] == ["finalize", "retrieve_again", "finalize", "finalize"]
    m = chat.Mentor(["a", "b"])
    assert [m.move(i) for i in ("NEXT", "NEXT", "BACK", "QUESTION", "BACK")] == ["b", "b", "a", "a", "a"]
    for i in range(5):
        m.commit(str(i), "r")
    assert len(m.history) == 6
    df = spark.createDataFrame([("0 9 * * *", "2024-05-15 12:20:00"), ("0 9 * * *", "2024-05-15 10:00:00"), ("0 9 * * MON", "2024-05-15 10:30:00"), ("0 9 * * MON", "2024-05-15 04:00:00"), ("x", None)], "c string, l string")
    assert [r[0] for r in df.select(chat.is_due(F.col("c"), F.col("l"), "2024-05-15 12:30:00")).collect()] == [False, True, False, True, True]


def test_cluster(spark):
    assert cluster.cluster_count(2, 10) == 1 and cluster.cluster_count(20, 2) == 10
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(size=2) * 0.1 + (0 if i < 10 else 5)).tolist()) for i in range(20)]
    got = cluster.cluster_vectors(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), least=10, most=2, dim=2).collect()
    assert sorted(x["vec_id"] for x in got) == list(range(20)) and {x["label"] for x in got} <= {0, 1}
    few = cluster.cluster_vectors(spark.createDataFrame(rows[:2], "vec_id int, embedding array<double>"), least=10)
    assert [x["label"] for x in few.collect()] == [0, 0]


def test_backup_round_trip(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    (data / "f").write_text("1")
    made = ops.backup(str(data), str(tmp_path / "b"), NOW)
    (data / "f").write_text("2")
    aside = ops.restore(made.path, str(data))
    assert (data / "f").read_text() == "1" and os.path.exists(aside) and [b.made for b in ops.list_backups(str(tmp_path / "b"))] == [made.made]
    assert ops.load_golden(str(tmp_path / "none")) == [] and all(ok for _, ok, _ in ops.doctor([str(tmp_path)], 0))


def test_common_shingles_stand_last(spark):
    sets = spark.createDataFrame([(i, sorted([1, 2, 100 + i, 200 + i])) for i in range(5)] + [(9, [1, 7])], "id int, s array<long>")
    got = {r["id"]: r["s"] for r in dedupe.rare_first(sets, 4).collect()}
    assert got[0] == [100, 200, 2, 1] and got[9] == [7, 1] and len(got) == 6
    assert {r["id"]: r["s"] for r in dedupe.rare_first(sets, 9).collect()} == {r["id"]: r["s"] for r in sets.collect()}


def test_near_pairs_equal_brute_force_with_a_shared_passage(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"w{i // 2}x{j}" for j in range(60)) + (" end" if i % 2 else "")) for i in range(80)]
    got = {(r["a"], r["b"]) for r in dedupe.near_pairs(spark.createDataFrame(rows, "id int, text string"), 0.9).collect()}

    def shingles(t, k=7):
        w = t.split(" ")
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    assert got == {(a, b) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= 0.9} and len(got) == 40


def test_filter_not_keeps_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, "raptor", ["a"]), (2, "txt", ["b"]), (3, None, None)], "id int, kind string, tags array<string>")
    ids = lambda w: [r["id"] for r in search.payload_filter(df, w).orderBy("id").collect()]
    assert ids({"kind": {"ne": "raptor"}}) == [2, 3] and ids({"tags": {"ne": "a"}}) == [2, 3]


def test_max_sim(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[0.5, 0.5], [0.0, 1.0]]), ([[1.0, 0.0]], []), ([], [[1.0, 1.0]])], "q array<array<double>>, t array<array<double>>")
    assert [r["s"] for r in df.select(search.max_sim(F.col("q"), F.col("t")).alias("s")).collect()] == [2.5, 0.0, 0.0]


def test_late_vectors_are_means_of_their_share(spark):
    t = np.random.default_rng(1).normal(size=(10, 3))
    spans = [(0, 0, 40), (1, 40, 42), (2, 42, 100)]
    tokens = spark.createDataFrame([("s", 100, t.tolist())], "source_id string, n_chars int, tokens array<array<double>>")
    got = chunking.late_vectors(tokens, spark.createDataFrame([("s", *x) for x in spans], "source_id string, chunk_index int, char_start int, char_end int"))
    for r in got.collect():
        _, a, b = spans[r["chunk_index"]]
        m = t[a // 10 : max(a // 10 + 1, b // 10)].mean(0)
        assert r["embedding"] == pytest.approx((m / (np.linalg.norm(m) + 1e-12)).tolist())


def test_subgraph_and_related(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("x",)], "node string")
    assert [tuple(r) for r in graph.subgraph(edges, nodes).collect()] == [("a", "b")]
    cited = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "zz"), (3, 6, "a")], "query_id long, rank int, source_id string")
    assert sorted(tuple(r) for r in graph.related(edges, cited).collect()) == [(1, 1, "c"), (1, 2, "d")]
    assert [tuple(r) for r in graph.related(edges, cited, most=1).collect()] == [(1, 1, "c")]


def test_summary_tree_and_nodes(spark):
    r = np.random.default_rng(0)
    rows = [(f"s{i:02}", "T" if i else None, f"text {i}", (r.normal(size=3) + 9 * (i % 2)).tolist()) for i in range(24)]
    leaves = spark.createDataFrame(rows, "source_id string, title string, text string, v array<double>")
    nodes = cluster.summary_tree(leaves, lambda p: p[:20], least=4, most=4).collect()
    assert nodes and {x["level"] for x in nodes} == {1} and all(x["size"] >= 4 and x["source_id"].startswith("raptor:L1:") for x in nodes)
    assert cluster.summary_tree(leaves, lambda p: "", least=4, most=4).count() == 0 and cluster.summary_tree(leaves.limit(7), least=4) is None
    one = leaves.where("title is not null").select(F.lit(0).alias("label"), "source_id", "title", "text")
    full = "\n\n---\n\n".join(f"[T] text {i}" for i in range(1, 24))
    for most in (10_000, 47, 12):
        assert cluster.summary_nodes(one, 1, 2, most).first()["text"] == full[:most]


def test_community_nodes(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "z"), ("p", "q")], "src string, dst string")
    chunks = spark.createDataFrame([("x", 0, "X", "one"), ("x", 1, "X", "two"), ("x", 2, "X", "three"), ("z", 0, None, "four")], "source_id string, chunk_index int, title string, text string")
    told = cluster.community_nodes(graph.communities(edges, 3), chunks, lambda p: p).collect()
    assert [(r["title"], r["text"], r["member_sources"]) for r in told] == [("Community of 3 notes", "[X] one\n\n[X] two\n\n[z] four", ["x", "y", "z"])]
    assert cluster.community_nodes(graph.communities(edges, 3), chunks, lambda p: " ").count() == 0


def test_documents_by_extension(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "sub" / "b.md").write_text("# B\nnote")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = {r["source_id"]: r["content"] for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"txt:a.txt": "plain", "obsidian:sub/b.md": "# B\nnote"}
    assert [r["content"] for r in files.read_documents(spark, str(tmp_path / "a.txt")).collect()] == ["plain"]
    assert [r["source_id"] for r in files.read_documents(spark, str(tmp_path / "sub" / "b.md")).collect()] == ["obsidian:b.md"]
    with pytest.raises(ValueError):
        files.read_documents(spark, str(tmp_path / "c.bin"))
    with pytest.raises(FileNotFoundError):
        files.read_documents(spark, str(tmp_path / "none"))


def test_migrations_run_once_and_in_order():
    ran, done = [], []
    steps = {2: lambda: ran.append(2), 1: lambda: ran.append(1), 3: lambda: ran.append(3)}
    assert state.migrate(1, steps, done.append) == 3 and ran == [2, 3] == done and state.migrate(3, steps) == 3 and state.migrate(0, {}) == 0


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("VAULT_AT", "/v")
    (tmp_path / "a.yaml").write_text("paths: {vault: '${VAULT_AT}/x', data: [1, '$NOT_SET_HERE']}\nk: 60\n")
    (tmp_path / "b.yaml").write_text("paths: {data: other}\nnew: {a: 1}\n")
    got = config.load(str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml"), str(tmp_path / "none.yaml"), environ={"MILLRACE_NEW__B": "true", "MILLRACE_K": "5", "OTHER": "x"})
    assert got == {"paths": {"vault": "/v/x", "data": "other"}, "k": 5, "new": {"a": 1, "b": True}}
    assert config.expand_env({"a": ["${VAULT_AT}", 3]}) == {"a": ["/v", 3]}


def test_near_pairs_of_short_and_copied_texts_keep_prefixes_alone(spark, monkeypatch):
    """Texts of few words, repeated words, null; ids to look at; of shingles only prefixes and those of candidates are staged."""
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n)) for n in (1, 2, 6, 7, 8, 40, 300, 300, 900)]
    texts = base + [t + " end" for t in base] + [t.upper() + "  " for t in base] + ["x " * 50, "x " * 60, None, ""]
    rows = list(enumerate(texts))
    held = []
    monkeypatch.setattr(dedupe, "written", lambda df, name: held.append((name, df.cache())) or held[-1][1])

    def shingles(t, k=7):
        w = " ".join(t.split()).lower().split(" ")
        return {" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))}

    sets = [(i, shingles(t)) for i, t in rows if t is not None and not 18 <= i < 27]
    want = {(i, j) for i, s in sets for j, x in sets if i < j and len(s & x) / len(s | x) >= 0.92}
    among = spark.createDataFrame([(i,) for i, _ in sets], "id int")
    got = dedupe.near_pairs(spark.createDataFrame(rows, "id int, text string"), 0.92, among=among).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(want) > 2
    staged = dict(held)
    for r in staged["near-prefixes"].collect():
        assert len(r["key"]) <= dedupe.prefix_length(r["n"], 0.92)
    assert {r["id"] for r in staged["near-sets"].collect()} <= {x for p in staged["near-candidates"].collect() for x in p}
