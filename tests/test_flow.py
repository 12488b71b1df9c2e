from pyspark.sql import functions as F

from millrace import agent
from millrace.functions import text as T
from millrace.operators import graph, ingest, retrieve


def test_ingest_chain(spark):
    key = "AKIA" + "B2" * 8
    docs = spark.createDataFrame(
        [("a", "A", f"# One\nsome text here {key}\n## Two\nmore of it"), ("b", "B", "plain words of b"), ("c", "C", "Plain  words of b"), ("d", "D", "")],
        "source_id string, title string, content string",
    )
    rows = ingest.ingest(docs, threshold=0.9).orderBy("source_id", "chunk_index").collect()
    assert [(r["source_id"], r["chunk_index"]) for r in rows] == [("a", 0), ("a", 1), ("b", 0)]
    assert key not in rows[0]["text"] + rows[0]["contextualized_text"] and rows[2]["contextualized_text"].startswith("[B]")


def test_contexts_come_from_the_cache(spark):
    chunks = spark.createDataFrame([("s", "h", "one", "T"), ("s", "h", "two", "T"), ("s", "h", "", "T")], "source_id string, doc_hash string, text string, title string")
    cache = chunks.where("text = 'one'").select(T.context_key(F.col("source_id"), F.col("doc_hash"), F.col("text")).alias("key"), F.lit("known").alias("context"))
    out, made = ingest.contextualise(chunks, cache, lambda p: "" if "two" not in p else "made")
    assert {r["text"]: r["contextualized_text"] for r in out.collect()} == {"one": "known\n\none", "two": "made\n\ntwo", "": None}
    assert [r["context"] for r in made.collect()] == ["made"]


def test_retrieve_with_links(spark):
    texts = {"arp": "arp spoof network attack", "py": "python decorators", "net": "network layers", "pasta": "pasta with tomato"}
    chunks = spark.createDataFrame([(f"{s}::0", s, 0, t, "x" if s == "py" else "y") for s, t in texts.items()], "chunk_id string, source_id string, chunk_index int, text string, kind string")
    hits = retrieve.retrieve(chunks, {1: "arp network spoof", 2: "python"}).orderBy("query_id", "final_rank").collect()
    assert hits[0]["source_id"] == "arp" and next(r for r in hits if r["query_id"] == 2)["source_id"] == "py"
    only = retrieve.retrieve(chunks, {1: "network"}, where={"kind": "x"}).collect()
    assert {r["source_id"] for r in only} == {"py"}
    edges = spark.createDataFrame([("py", "pasta")], "src string, dst string")
    more = retrieve.retrieve(chunks, {1: "python"}, edges, {"kind": "x"}).collect()
    assert {r["source_id"] for r in more} == {"py", "pasta"}
    assert retrieve.context_block(hits and retrieve.retrieve(chunks, {1: "pasta"}, params=retrieve.Params(top_k=1))).first()["context"] == "[pasta]\npasta with tomato"


def test_images(spark):
    notes = spark.createDataFrame([("n", "sub/N.md", "![[Diagram.png]] ![x](pic.jpg) ![[none.png]]"), ("m", "M.md", "![[diagram.PNG|c]]")], "source_id string, rel string, body string")
    images = spark.createDataFrame([("attachments/diagram.png", "diagram.png"), ("sub/pic.jpg", "pic.jpg")], "rel string, name_key string")
    assert {(r["image"], r["source_id"]) for r in ingest.discover_images(notes, images).collect()} == {("attachments/diagram.png", "m"), ("sub/pic.jpg", "n")}


def test_agent():
    hits = [("s", "text of s", 0.5)]
    asked = []

    def find(q):
        asked.append(q)
        return hits

    critic = lambda q, d: ("revise", "better")
    a = agent.Agent(find, critic=critic, max_revisions=1)
    assert a.ask("what is s").iterations == 2 and asked == ["what is s", "better"] and len(a.history) == 2
    assert a.ask("/cite s").text == "1. s [0.500]: text of s" and a.ask("/dry s").text.splitlines()[1:] == ["* s [0.500]"]
    assert a.ask("/help").path == "help" and a.ask("hello").path == "direct" and a.ask("/web x").path == "web"
    assert [k for k, _ in a.stream("hello")][-1] == "done"
    assert agent.verdict('x {"best": 1, "score": 0.5} y') == (1, 0.5, "") and agent.verdict("no") == (0, 0.0, "")
    assert agent.speculative("q", ["a", "b"], lambda p: p, lambda p: '{"best": 1}', 2) == ("q\n\nb", 1)
    assert agent.parse_slash("/zoomies x") == (None, "/zoomies x")


def test_stores(spark, tmp_path):
    m = agent.Memory(spark, str(tmp_path / "memory"))
    m.remember("what is arp", "arp maps addresses", ts=1.0)
    m.remember("how to cook pasta", "boil water first", ts=2.0)
    assert m.count() == 2 and m.recall("arp maps", 1).first()["answer"] == "arp maps addresses" and m.clear() == 2 and m.count() == 0
    s = agent.Sessions(spark, str(tmp_path / "sessions"))
    s.create("1", "one", 1.0)
    s.create("2", "two", 2.0)
    s.add("1", "user", "hi", 1.0)
    s.add("1", "assistant", "ho", 2.0)
    assert [r["id"] for r in s.list().collect()] == ["2", "1"] and s.export("1").endswith("**user**: hi\n\n**assistant**: ho\n")
    s.delete("1")
    assert s.history("1").count() == 0 and s.list().count() == 1
    c = agent.Schedules(spark, str(tmp_path / "schedules"))
    c.add("a", "0 9 * * *", "q", "o.md", "2024-01-01")
    assert [r["name"] for r in c.due("2024-01-02 00:00:00").collect()] == ["a"]
    c.mark("a", "2024-01-02 00:00:00")
    assert c.due("2024-01-02 00:10:00").isEmpty() and c.delete("a") and not c.delete("a")


def test_two_hop_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert graph.neighbours(edges, spark.createDataFrame([("a",)], "start string"), 2).count() == 2


def test_ingest_asks_the_model_once_for_each_chunk_that_stays(spark, tmp_path):
    log = tmp_path / "asked"

    def model(prompt: str) -> str:
        with open(log, "a") as f:
            f.write("x")
        return f"about {len(prompt)}"

    rows = [(f"d{i}", "t", " ".join(f"w{i % 5}x{j}" for j in range(400))) for i in range(10)]
    got = ingest.ingest(spark.createDataFrame(rows, "source_id string, title string, content string"), model=model).collect()
    assert {r["source_id"] for r in got} == {f"d{i}" for i in range(5)} and all(r["contextualized_text"].startswith("about ") for r in got)
    assert len(log.read_text()) == len(got)
