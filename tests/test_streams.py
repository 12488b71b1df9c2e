"""Streams with state: vaults, changes by source, last turns; all go on from their checkpoints."""

import os
import time
from collections import Counter

from millrace.operators import state
from millrace.sources import vault_stream
from millrace.streaming import stateful, sync


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_vault_stream_sees_changes_and_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vault_stream, "NOTES", 2)
    vault, cp = tmp_path / "vault", tmp_path / "cp"
    put = lambda rel, text: ((vault / rel).parent.mkdir(parents=True, exist_ok=True), (vault / rel).write_text(text))
    store = state.Store(spark, f"file://{tmp_path}/store", sync.STATE, "source_id")

    def run():
        feed = vault_stream.read_vault_stream(spark, str(vault), f"{cp}/listings")
        sync.stream_sync(feed, store, f"file://{cp}").awaitTermination()
        return {r["source_id"]: r["content"] for r in store.read().collect()}

    for i in range(5):
        put(f"n{i}.md", f"note {i}")
    put("sub/Deep One.md", "deep")
    put(".obsidian/x.md", "no")
    put("picture.png", "no")
    assert run() == {**{f"obsidian:n{i}.md": f"note {i}" for i in range(5)}, "obsidian:sub/Deep One.md": "deep"}
    # Changed, deleted and new notes, while nothing runs; then a restart from the checkpoint.
    put("n1.md", "note one")
    os.remove(vault / "n2.md")
    put("sub/new.md", "new")
    want = {"obsidian:n0.md": "note 0", "obsidian:n1.md": "note one", "obsidian:n3.md": "note 3", "obsidian:n4.md": "note 4", "obsidian:sub/Deep One.md": "deep", "obsidian:sub/new.md": "new"}
    assert run() == want
    before = store.log.latest()[0]
    assert run() == want and store.log.latest()[0] == before  # nothing new: no batch
    put("n2.md", "note 2 again")
    assert run() == want | {"obsidian:n2.md": "note 2 again"}


def test_change_events(spark, tmp_path):
    schema = "source_id string, content string, at long, deleted boolean"
    batches = [
        [("a", "1", 1, False), ("b", "1", 1, None), ("c", None, 1, False), ("a", "2", 2, False), ("a", "2", 3, False), ("z", "?", 1, True), (None, "x", 1, False)],
        [("a", "2", 4, False), ("b", None, 5, True), ("c", "x", 5, False), ("b", "late", 0, False), ("d", "1", 1, False)],
        [("b", "1", 6, False), ("c", "x", 6, True), ("d", "2", 9, False), ("d", "1", 3, False)],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stateful.to_files(stateful.change_events(feed), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        if i == 1:  # run again without new rows: nothing comes twice
            stateful.to_files(stateful.change_events(feed), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "source_id", "at", "action")
    assert got == sorted([
        ("a", 1, "add"), ("a", 2, "change"), ("b", 1, "add"), ("c", 1, "add"), ("b", 5, "delete"), ("c", 5, "change"), ("d", 1, "add"),
        ("b", 6, "add"), ("c", 6, "delete"), ("d", 9, "change"),
    ])


def test_last_turns_and_rest(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"

    def run(batch, idle=None):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stateful.to_files(stateful.last_turns(feed, 2, idle), str(tmp_path / "out"), str(tmp_path / "cp"), one_batch=True).awaitTermination(60)
        return Counter(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("conv_id", "seen", "history", "closed").collect())

    first = run([(1, 3, "user", "c"), (1, 1, "user", "a"), (1, 2, None, None), (2, 1, "user", "x")], 1)
    assert first == Counter([(1, 3, ": \nuser: c", False), (2, 1, "user: x", False)])
    time.sleep(0.1)
    second = run([(3, 1, "user", "new")], 1) - first
    # Both conversations rested: closed with their last turns, and their state is gone.
    assert second == Counter([(3, 1, "user: new", False), (1, 3, ": \nuser: c", True), (2, 1, "user: x", True)])
    third = run([(1, 9, "user", "again")], 1) - first - second
    assert (1, 1, "user: again", False) in third
