"""Communities, batches of contexts, images, evaluation, schedules, stamps, made nodes."""

import json
import random

import pytest

from millrace import agent, ops
from millrace.operators import chat, cluster, graph, ingest, state


def test_louvain_finds_planted_groups(spark):
    r = random.Random(4)
    group = {i: i % 4 for i in range(80)}
    edges = {(a, b) for a in group for b in group if a < b and r.random() < (0.5 if group[a] == group[b] else 0.02)}
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges], "src string, dst string")
    found = graph.louvain(df)
    labels = {x["node"]: x["community"] for x in found.collect()}
    assert len(labels) == 80 and all(labels[c] == c for c in labels.values())
    assert all(len({labels[f"n{i:02}"] for i in group if group[i] == g}) == 1 for g in range(4)) and len(set(labels.values())) == 4
    # Modularity as its definition says.
    m, degree = len(edges), {i: sum(i in e for e in edges) for i in group}
    inside = sum(group[a] == group[b] for a, b in edges) / m
    want = inside - sum((sum(degree[i] for i in group if group[i] == g) / (2 * m)) ** 2 for g in range(4))
    assert abs(graph.modularity(df, found) - want) < 1e-9
    again = {x["node"]: x["community"] for x in graph.louvain(df.repartition(3)).collect()}
    assert again == labels
    finer = {x["community"] for x in graph.louvain(df, resolution=6.0).collect()}
    assert len(finer) > 4
    assert graph.louvain(df.limit(0)).collect() == []
    top = graph.communities(df, min_size=4, most=2).collect()
    assert [x["size"] for x in top] == [20, 20] and top[0]["members"] == sorted(top[0]["members"])


def test_contexts_in_batches(spark):
    chunks = spark.createDataFrame([("d", "h", f"chunk {i}", "T") for i in range(10)] + [("e", "h", "alone", "T")], "source_id string, doc_hash string, text string, title string")
    docs = spark.createDataFrame([("d", "the whole document"), ("e", None)], "source_id string, content string")

    def model(prompt):
        if "JSON" not in prompt:
            return "single: " + prompt.rsplit("\n", 1)[1]
        n = prompt.count("<chunk ")
        assert n <= 4
        if n == 1:
            return "no JSON here"
        return "ok " + json.dumps({"contexts": [{"id": i, "context": f"batch of {n}" if i else " "} for i in range(n)]})

    none = spark.createDataFrame([], "key string, context string")
    out, made = ingest.contextualise_batches(chunks, none, model, docs, size=4)
    told = {r["text"]: r["contextualized_text"].split("\n\n")[0] for r in out.collect()}
    assert len(told) == 11 and told["alone"] == "single: alone" and made.count() == 11
    d = [told[f"chunk {i}"] for i in range(10)]
    assert sorted(x.split(":")[0] for x in d) == ["batch of 2"] + ["batch of 4"] * 6 + ["single"] * 3
    # What the cache holds is not asked for again.
    again, more = ingest.contextualise_batches(chunks, made, lambda prompt: 1 / 0, docs, size=4)
    assert {r["text"]: r["contextualized_text"].split("\n\n")[0] for r in again.collect()} == told and more.count() == 0


def test_images_by_what_they_show(spark):
    found = spark.createDataFrame([("a/red_car-01.png", "n1"), ("b/blue boat.jpg", "n2"), ("---.png", "n3")], "image string, source_id string")
    index = ingest.index_images(found)
    assert sorted((r["image"], r["caption"]) for r in index.collect()) == [("a/red_car-01.png", "red car 01"), ("b/blue boat.jpg", "blue boat")]
    hits = ingest.search_images(index, spark.createDataFrame([(1, "blue boat")], "query_id long, text string"), 2).orderBy("rank").collect()
    assert [h["image"] for h in hits] == ["b/blue boat.jpg", "a/red_car-01.png"] and hits[0]["score"] > 0.99


def test_evaluation_report(tmp_path):
    (tmp_path / "g.yaml").write_text("- id: a\n  question: first?\n  expected_sources: [x.md, y.md]\n  expected_answer_contains: [Blue]\n- id: b\n- id: c\n  question: boom\n")
    golden = ops.load_golden(str(tmp_path / "g.yaml"))

    def find(question):
        if question == "boom":
            raise RuntimeError("no index")
        return [("notes/x.md", "t", 1.0), ("y.md", "t", 0.5)]

    report = ops.run_eval(golden, find, lambda q: "it is blue", top_k=1)
    assert [(x["id"], x["source_hit_rate"], x["answer_hit_rate"]) for x in report["items"]] == [("a", 0.5, 1.0), ("b", 1.0, 1.0), ("c", 0.0, 0.0)]
    assert report["errors"] == 1 and report["source_hit_rate"] == 0.5
    ops.write_report(str(tmp_path / "r.json"), report)
    assert json.loads((tmp_path / "r.json").read_text()) == report and ops.run_eval([], find, str)["n"] == 0


def test_schedules_run_when_due(spark, tmp_path):
    s = agent.Schedules(spark, f"file://{tmp_path}/s")
    s.add("good", "*/5 * * * *", "what is new", str(tmp_path / "good.md"), "2024-01-01 00:00:00")
    s.add("bad", "*/5 * * * *", "fail", str(tmp_path / "bad.md"), "2024-01-02 00:00:00")

    def answer(q):
        if q == "fail":
            raise ValueError("model is away")
        return f"answer to {q}"

    assert s.run_due("2024-02-01 10:00:00", answer) == [("good", None), ("bad", "model is away")]
    assert "## good (2024-02-01 10:00)\n\nanswer to what is new" in (tmp_path / "good.md").read_text() and not (tmp_path / "bad.md").exists()
    assert s.run_due("2024-02-01 10:10:00", answer) == [("bad", "model is away")]  # the other isn't due yet


def test_stamp_is_written_once(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    assert state.read_stamp(spark, at) is None
    state.write_stamp(spark, at, "hash", 16, False)
    state.check_stamp(state.read_stamp(spark, at), "hash", 16, False)
    with pytest.raises(ValueError, match="not compatible"):
        state.check_stamp(state.read_stamp(spark, at), "other", 16, False)
    with pytest.raises(Exception, match="exist"):
        state.write_stamp(spark, at, "other", 8, True)


def test_made_nodes_are_replaced(spark, tmp_path):
    store = state.Store(spark, f"file://{tmp_path}/s", "source_id string, text string", "source_id")
    made = lambda *r: spark.createDataFrame(r, "source_id string, text string")
    store.write(made(("n.md", "note"), ("raptor:L1:aa", "old"), ("community:bb", "c")))
    assert cluster.replace_made(store, made(("raptor:L1:cc", "new")), cluster.TREE) == 1
    assert cluster.replace_made(store, None, cluster.COMMUNITY) == 1 and cluster.replace_made(store, None, cluster.COMMUNITY) == 0
    assert sorted(r["source_id"] for r in store.read().collect()) == ["n.md", "raptor:L1:cc"]


def test_summaries_of_what_is_asked_for(spark):
    rows = [("a", 0, "A", "first", ["x"], "note"), ("a", 1, "A", "second", ["x"], "note"), ("b", 0, "B", "third", ["y"], "web")]
    chunks = spark.createDataFrame(rows, "source_id string, chunk_index int, title string, text string, tags array<string>, source_type string")
    seen = lambda **by: [(r["topic"], r["chunks"]) for r in chat.summarise_where(chunks, **by).collect()]
    assert seen(source_id="a") == [("a", 2)] and seen(tag="#y") == [("#y", 1)] and seen(source_type="note") == [("note", 2)] and seen() == [("all", 3)]
    assert seen(tag="none") == []


def test_command_line(spark, tmp_path, capsys):
    from millrace.__main__ import main

    data, notes = f"file://{tmp_path}/data", tmp_path / "notes"
    notes.mkdir()
    (notes / "net.txt").write_text("routers and networks")
    (notes / "food.txt").write_text("pasta with tomato")

    def run(*argv):
        assert main([str(a) for a in argv]) == 0
        return json.loads(capsys.readouterr().out)

    assert run("ingest", data, notes) == [{"action": "add", "count": 2}]
    assert run("search", data, "tomato")[0][:2] == ["txt:food.txt", "pasta with tomato"]
    assert "tomato" in run("ask", data, "tomato pasta?")["text"] and run("memory-count", data) == 1
    assert run("recall", data, "tomato")[0]["question"] == "tomato pasta?" and run("memory-clear", data) == 1
    assert run("stats", data) == [{"points": 2, "sources": 2, "state_sources": 2, "state_chunks": 2, "drift": 0}]
    run("schedule-add", data, "s", "*/5 * * * *", "routers", tmp_path / "out.md")
    assert run("schedule-run", data) == [["s", None]] and "routers" in (tmp_path / "out.md").read_text()
    (tmp_path / "g.yaml").write_text("- id: a\n  question: routers\n  expected_sources: [net]\n")
    assert run("eval", data, tmp_path / "g.yaml", tmp_path / "r.json")["source_hit_rate"] == 1.0
    assert run("delete", data, "txt:net.txt") == [1, 1] and run("stats", data)[0]["points"] == 1
    (notes / "net.txt").unlink()
    assert run("ingest", data, notes) == [{"action": "keep", "count": 1}]
    assert run("summarise", data, "txt:food.txt")[0]["chunks"] == 1
