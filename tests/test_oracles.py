import pytest

from millrace import catalogue
from tests.oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        got, want = compare(df, con, catalogue.ORACLES[name])
        assert got == want
    else:
        assert df.count() > 0


def test_near_dedupe_is_the_first_independent_set(spark):
    from millrace.operators import dedupe

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]

    def shingles(t, k=7):
        w = " ".join(t.split()).lower().split(" ")
        return {" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))}

    kept, seen = [], set()
    for d, t in sorted(rows):
        norm = " ".join(t.split()).lower()
        s = shingles(t)
        if norm not in seen and not any(len(s & x) / len(s | x) >= 0.8 for _, x in kept):
            kept.append((d, s))
            seen.add(norm)
    got = dedupe.dedupe(spark.createDataFrame(rows, "pos long, text string"), 0.8)
    assert sorted(r["pos"] for r in got.collect()) == [d for d, _ in kept]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "id", "score"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
