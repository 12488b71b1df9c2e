from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, quality, simhash
from millrace.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], SF), f"t-{name}"))
        if name != "pack":
            assert tables[-1].columns == docs.columns
    ids = [Counter(r["doc_id"] for r in t.select("doc_id").collect()) for t in tables]
    good = {r["doc_id"] for r in quality.keep_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert len(good ^ set(ids[1])) <= 0.05 * len(good)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = {}
    for d in sorted(ids[1]):
        first.setdefault(" ".join(texts[d].split()), d)
    assert set(ids[2]) == set(first.values()) and max(ids[2].values()) == 1
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_components(tables[2]).collect()}
    assert set(ids[3]) == set(near.values()) and max(ids[3].values()) == 1
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(tables[3]).collect()}
    assert ids[4] == Counter({d: n for d, n in taken.items() if n})
    assert set(ids[5]) == set(ids[4])


def test_empty_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __copies int"
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (None, "a few words", "en", None, 3, 2), (1, "", "en", "s", 0, 3), (2, "some more words", None, "s", 9, 4), (2, "some more words", None, "s", 9, 4)], schema)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs.drop("__copies"), docs.drop("__copies").limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = staged(stage(spark, at, str(tmp_path)), f"t-{name}")
        assert (at.count() > 0) == (table.count() > 0)


def test_repeated_ids_are_decided_by_row(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta", "the lazy dog sleeps in the warm sun", "rivers run down to the cold sea"
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("s").alias("source"))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near):
        got = Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect())
        assert got == Counter([(1, a), (2, b), (3, c), (None, "no id")]), stage
    once = corpus_pipeline.mix_sources(spark, docs, SF)
    rows, named = corpus_pipeline.by_row(docs)
    text = {r["__row"]: (r["doc_id"], r["text"]) for r in rows.collect() if r["__row"] is not None}
    want = Counter({(None, "no id"): 1})
    for r in mixing.mix(named).where("doc_id is not null").collect():
        want[text[r["doc_id"]]] += r["taken"] // r["size"]
    assert Counter((r["doc_id"], r["text"]) for r in once.collect()) == +want


def test_texts_are_shuffled_once_and_never_sorted(spark):
    """One plan at every size: decisions are hashed, texts stream by them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near, corpus_pipeline.mix_sources):
        plan = stage(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "SortMergeJoin" not in plan, stage
