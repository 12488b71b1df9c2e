"""Queries of search, fusion, filters, graph and reranking."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import timehint
from millrace.functions import text as T
from millrace.operators import chunking, cluster, graph, search
from millrace.operators.inverted import InvertedIndex
from millrace.operators.vectors import VectorIndex
from millrace.session import table
from millrace.sources import files

from .ingest import docs
from .notes import EDGES_SQL, notes

Q: dict = {}
SQLS: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQLS[f.__name__] = sql
        return f

    return put


#: Searches take every row whose id is divisible by this as a query, against all rows.
EVERY = 50

DENSE = f"""
    p AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum([CAST(q.embedding[i] AS DOUBLE) * v.embedding[i] for i in generate_series(1, len(q.embedding))]), 6) AS score
          FROM embeddings q, embeddings v WHERE q.vec_id % {EVERY} = 0),
    dense AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where(F.col("vec_id") % EVERY == 0)


@query(f"WITH {DENSE} SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM dense WHERE rank <= 10")
def q_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.dense_topk(table(spark, sf, "embeddings"), asked(spark, sf), 10, digits=6)


@query(f"""WITH b AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings),
    h AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.embedding AS a, v.embedding AS e, list_sum([CAST(q.s[i] <> v.s[i] AS INT) for i in generate_series(1, len(q.s))]) AS apart
          FROM b q, b v WHERE q.vec_id % {EVERY} = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY apart, id) AS near FROM h),
    x AS (SELECT query_id, id, round(list_sum([CAST(a[i] AS DOUBLE) * e[i] for i in generate_series(1, len(a))]), 6) AS score FROM n WHERE near <= 20),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x)
    SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 10""")
def q_quant_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Sign bits first, twice as many as asked for, then exact scores."""
    return search.quantised_topk(table(spark, sf, "embeddings"), asked(spark, sf), 10, digits=6)


TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"
SPARSE = f"""
    post AS (SELECT DISTINCT doc_id AS id, unnest({TOKENS}) AS token FROM documents),
    idf AS (SELECT token, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post GROUP BY token)"""


@query(f"""WITH {SPARSE}, q AS (SELECT DISTINCT doc_id AS query_id, unnest({TOKENS}) AS token FROM documents WHERE doc_id % {EVERY} = 0),
    s AS (SELECT query_id, id, round(sum(idf), 6) AS score FROM q JOIN post USING (token) JOIN idf USING (token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 10""")
def q_sparse_topk(spark: SparkSession, sf: str) -> DataFrame:
    """One search alone: texts are read once, without an index."""
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    return search.lexical_topk(d, d.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"), 10, digits=6)


# The last state of texts that were put in, revised in part, and deleted in part.
REVISED = "d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stale ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@query(f"""WITH {REVISED}, {SPARSE.replace('FROM documents)', 'FROM d)').replace('FROM documents', 'FROM d')},
    q AS (SELECT DISTINCT doc_id AS query_id, unnest({TOKENS}) AS token FROM documents WHERE doc_id % {EVERY} = 0),
    s AS (SELECT query_id, id, round(sum(idf), 6) AS score FROM q JOIN post USING (token) JOIN idf USING (token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 10""")
def q_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """An inverted index that is put in twice, the second time in part, and then loses documents."""
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    index = InvertedIndex.open(spark, d.schema["id"].dataType)
    index.upsert(d.withColumn("text", F.concat(F.lit("stale "), F.coalesce("text", F.lit("")))))
    index.upsert(d.where("id % 3 <> 0"))
    index.delete(d.where("id % 7 = 3"))
    return index.search(d.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"), 10, digits=6)


@query(f"""WITH {REVISED}, {SPARSE.replace('FROM documents)', 'FROM d)').replace('FROM documents', 'FROM d')}
    SELECT token, count(*) AS docs, CAST(1 AS FLOAT) AS top FROM post GROUP BY token""")
def q_index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies of the index of q_index_topk after its segments are merged."""
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    index = InvertedIndex.open(spark, d.schema["id"].dataType)
    index.upsert(d.withColumn("text", F.concat(F.lit("stale "), F.coalesce("text", F.lit("")))))
    index.upsert(d.where("id % 3 <> 0"))
    index.delete(d.where("id % 7 = 3"))
    index.merge()
    return index.frequencies()


INDEXED = DENSE.replace("FROM embeddings q, embeddings v WHERE", "FROM embeddings q, embeddings v WHERE v.vec_id % 7 <> 3 AND")


def vector_index(spark: SparkSession, sf: str) -> VectorIndex:
    """All embeddings: put in negated, then as they are, in two parts, and every seventh deleted."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = VectorIndex.open(spark, e.schema["id"].dataType)
    index.upsert(e.where("id % 2 = 0"))
    index.upsert(e.where("id % 2 <> 0").withColumn("v", F.transform("v", lambda x: -x)))
    index.upsert(e.where("id % 2 <> 0"))
    index.delete(e.where("id % 7 = 3"))
    return index


@query(f"WITH {INDEXED} SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM dense WHERE rank <= 10")
def q_index_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector index through upserts and deletes, all of its cells probed: exact."""
    q = asked(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return vector_index(spark, sf).search(q, 10, exact=True, digits=6)


@query(f"SELECT count(*) AS queries, count(*) * 10 AS hits, true AS enough FROM embeddings WHERE vec_id % {EVERY} = 0")
def q_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Each query in under a third of the cells: whether at least 0.9 of the exact hits are found."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = asked(spark, sf).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    index = VectorIndex.open(spark, e.schema["id"].dataType)
    index.upsert(e)
    exact = search.dense_topk(e, q.withColumnRenamed("query_id", "id"), 10, "id", "v", 6).select("query_id", "id")
    found = exact.join(index.search(q, 10, digits=6).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("hits"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS t FROM documents), c AS (SELECT doc_id, instr('0123456789abcdef', right(md5(t), 1)) - 1 AS b, count(*) AS n FROM t GROUP BY ALL)
    SELECT doc_id, CAST(b AS INT) AS b, round(n / (sqrt(sum(n * n) OVER (PARTITION BY doc_id)) + 1e-12), 6) AS x FROM c""")
def q_hashbow_embed(spark: SparkSession, sf: str) -> DataFrame:
    v = docs(spark, sf).select("doc_id", F.posexplode(search.hash_embed(F.col("text"))).alias("b", "x"))
    return v.where("x <> 0").select("doc_id", "b", F.round("x", 6).alias("x"))


HYBRID = f"""
    j AS (SELECT doc_id AS id, text, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
    p AS (SELECT q.id AS query_id, v.id AS id, round(list_sum([CAST(q.embedding[i] AS DOUBLE) * v.embedding[i] for i in generate_series(1, len(q.embedding))]), 6) AS score
          FROM j q, j v WHERE q.id % {EVERY} = 0),
    dl AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p),
    post AS (SELECT DISTINCT id, unnest({TOKENS}) AS token FROM j),
    qt AS (SELECT DISTINCT id AS query_id, unnest({TOKENS}) AS token FROM j WHERE id % {EVERY} = 0),
    ls AS (SELECT query_id, id, count(*) AS score FROM qt JOIN post USING (token) GROUP BY ALL),
    ll AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ls),
    f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM dl WHERE rank <= 50 UNION ALL SELECT * FROM ll WHERE rank <= 50) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)"""


@query(f"WITH {HYBRID} SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 8")
def q_hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    d, e = docs(spark, sf).select(F.col("doc_id").alias("id"), "text"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    d, v = d.join(search.small_side(e.select("id")), "id", "left_semi"), e.join(search.small_side(d.select("id")), "id", "left_semi")
    q = d.where(F.col("id") % EVERY == 0).join(v.where(F.col("id") % EVERY == 0), "id").withColumnRenamed("id", "query_id")
    return search.hybrid(d, v, q, digits=6)


@query(f"""WITH {DENSE}, f AS (SELECT query_id // 100 AS query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM dense WHERE rank <= 50 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
    SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 10""")
def q_multi_query_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring queries are sub-queries of one question; their lists are fused."""
    lists = search.dense_topk(table(spark, sf, "embeddings"), asked(spark, sf), 50, digits=6).select(F.expr("query_id div 100").alias("query_id"), "id", "rank")
    return search.ranked(search.rrf(lists).withColumn("score", F.round("score", 9)), 10)


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') AND lang = 'en'")
def q_filter_any(spark: SparkSession, sf: str) -> DataFrame:
    return search.payload_filter(docs(spark, sf), {"source": ["src1", "src3"], "lang": "en"}).select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_orderstatus = 'F'")
def q_filter_range(spark: SparkSession, sf: str) -> DataFrame:
    return search.payload_filter(table(spark, sf, "orders"), {"o_totalprice": {"gte": 1000, "lt": 50000}, "o_orderstatus": "F"}).select("o_orderkey")


@query("SELECT p_partkey, tags[1] AS a FROM (SELECT p_partkey, [p_brand, p_type] AS tags FROM part) WHERE list_has_any(tags, (SELECT [min(p_brand), max(p_brand)] FROM part))")
def q_filter_array(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.array("p_brand", "p_type").alias("tags"))
    ends = part.agg(F.min(F.get("tags", F.lit(0))), F.max(F.get("tags", F.lit(0)))).first()
    return search.payload_filter(part, {"tags": list(ends)}).select("p_partkey", F.get("tags", F.lit(0)).alias("a"))


def _range(unit: str, base: str) -> None:
    sql = f"SELECT event_id FROM events WHERE ts >= date_trunc('{unit}', TIMESTAMP '{base}') AND ts <= date_trunc('{unit}', TIMESTAMP '{base}') + INTERVAL 1 {unit}"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        start, end = timehint.date_range("today" if unit == "day" else f"this {unit}", datetime.fromisoformat(base).replace(tzinfo=timezone.utc))
        bound = lambda t: F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
        return table(spark, sf, "events").where((F.col("ts") >= bound(start)) & (F.col("ts") <= bound(end))).select("event_id")

    run.__name__ = f"q_time_range_{unit}"
    query(sql)(run)


for _unit in ("day", "week", "month", "year"):
    _range(_unit, "2024-01-17 10:30:00")


@query(f"""WITH j AS (SELECT doc_id AS id, {TOKENS} AS t FROM documents), {SPARSE.replace('post AS', 'post2 AS').replace('FROM post ', 'FROM post2 ')},
    q AS (SELECT id AS query_id, list_distinct(t) AS qt FROM j WHERE id % {EVERY} = 0),
    qx AS (SELECT query_id, unnest(qt) AS token FROM q),
    s AS (SELECT query_id, id, round(sum(idf), 6) AS score FROM qx JOIN post2 USING (token) JOIN idf USING (token) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
    p AS (SELECT r.query_id, r.id, r.rank, r.rank <= 5 AS in_pool, CASE WHEN r.rank <= 5 THEN round(len(list_intersect(qt, j.t)) / len(qt), 6) END AS rr
          FROM r JOIN j ON r.id = j.id JOIN q ON q.query_id = r.query_id WHERE r.rank <= 10),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY in_pool DESC, rr DESC NULLS LAST, rank, id) AS final_rank FROM p)
    SELECT query_id, id, CAST(final_rank AS INT) AS final_rank, rr AS rerank_score FROM f WHERE final_rank <= 8""")
def q_rerank_pool(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), "text")
    pool = search.with_tokens(q_sparse_topk(spark, sf), d, d.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id"), 5)
    scorer = lambda a, b: F.round(search.token_overlap(a, b), 6)
    return search.rerank(pool, scorer, F.col("query_tokens"), F.col("text_tokens"), 5, 8).select("query_id", "id", "final_rank", "rerank_score")


NOW = "2024-06-01 00:00:00"


@query(f"""SELECT o_orderkey, round(o_totalprice * (0.5 + 0.5 * exp(-ln(2) / 180 * greatest(epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate), 0) / 86400)), 4) AS score FROM orders""")
def q_recency(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", F.round(search.recency(F.col("o_totalprice"), at, at, NOW, 0.5, 180.0), 4).alias("score"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), nullif(l_quantity, 0), 0) AS score FROM lineitem""")
def q_final_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.final_score(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")).alias("score"))


@query(f"""WITH {EDGES_SQL} SELECT lower(n) AS norm_title, arg_min('obsidian:' || title || '.md', [pos, k]) AS source_id
    FROM (SELECT title, pos, title AS n, 0 AS k FROM notes UNION ALL SELECT title, pos, 'obsidian:' || title || '.md', 1 FROM notes) GROUP BY 1""")
def q_title_index(spark: SparkSession, sf: str) -> DataFrame:
    return graph.title_index(notes(spark, sf))


@query(f"WITH {EDGES_SQL} SELECT src, dst FROM edges")
def q_link_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.link_graph(notes(spark, sf))


@query(f"WITH {EDGES_SQL} SELECT dst AS source_id, count(*) AS backlinks FROM edges GROUP BY dst")
def q_backlinks(spark: SparkSession, sf: str) -> DataFrame:
    return graph.link_graph(notes(spark, sf)).groupBy(F.col("dst").alias("source_id")).agg(F.count("*").alias("backlinks"))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    s AS (SELECT 'obsidian:' || n_name || '.md' AS start FROM nation),
    h1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN b ON src = start WHERE dst <> start),
    h2 AS (SELECT DISTINCT start, dst AS node FROM h1 JOIN b ON src = node WHERE dst <> start)
    SELECT start, node, CAST(min(hop) AS INT) AS hop FROM (SELECT *, 1 AS hop FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY start, node""")
def q_two_hop(spark: SparkSession, sf: str) -> DataFrame:
    starts = table(spark, sf, "nation").select(F.concat(F.lit("obsidian:"), "n_name", F.lit(".md")).alias("start"))
    return graph.neighbours(graph.link_graph(notes(spark, sf)), starts, 2)


@query(f"""WITH {EDGES_SQL}, up AS (SELECT src AS node, dst AS up FROM edges),
    r AS (SELECT node, CASE WHEN u2.up IS NULL THEN up.up ELSE u2.up END AS region FROM up LEFT JOIN (SELECT node AS n2, up FROM up) u2 ON up.up = u2.n2
          UNION SELECT dst, dst FROM edges WHERE dst NOT IN (SELECT src FROM edges))
    SELECT node, min(node) OVER (PARTITION BY region) AS root FROM r""")
def q_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(graph.link_graph(notes(spark, sf)))


@query()
def q_communities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.communities(graph.link_graph(notes(spark, sf)))


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select(F.concat("source_id", F.lit("::0")).alias("chunk_id"), "source_id", F.lit(0).alias("chunk_index"))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    seeds AS (SELECT 'obsidian:' || n_name || '.md' AS source_id, 1.0::DOUBLE / (1 + n_nationkey) AS score FROM nation),
    via AS (SELECT dst AS node, max(score) AS score, arg_max(src, (score, -rn)) AS f FROM (
        SELECT b.dst, b.src, score, row_number() OVER (ORDER BY b.src) AS rn FROM seeds JOIN b ON src = source_id WHERE dst NOT IN (SELECT source_id FROM seeds)) GROUP BY dst)
    SELECT source_id || '::0' AS chunk_id, source_id, round(score, 9) AS score, NULL::VARCHAR AS expanded_from FROM seeds
    UNION ALL SELECT node || '::0', node, round(score * 0.5, 9), f FROM via""")
def q_graph_expand(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "nation").select(
        F.concat(F.lit("obsidian:"), "n_name", F.lit(".md::0")).alias("chunk_id"), F.concat(F.lit("obsidian:"), "n_name", F.lit(".md")).alias("source_id"),
        (F.lit(1.0) / (1 + F.col("n_nationkey"))).alias("score"),
    )
    return graph.expand(seeds, graph.link_graph(notes(spark, sf)), chunk_rows(spark, sf)).withColumn("score", F.round("score", 9))


@query(f"""WITH {EDGES_SQL} SELECT pos AS msg_id, source_id, source_id || '::0' AS chunk_id
    FROM (SELECT DISTINCT pos, lower(trim(split_part(split_part(raw, '|', 1), '#', 1))) AS k FROM (SELECT pos, unnest(regexp_extract_all(body, '\\[\\[([^\\]\\n]+?)\\]\\]', 1)) AS raw FROM notes))
    JOIN titles ON k = norm_title""")
def q_pins(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    return graph.pins(n.select(F.col("pos").alias("msg_id"), F.col("body").alias("text")), graph.title_index(n), chunk_rows(spark, sf))


@query()
def q_cluster_tree(spark: SparkSession, sf: str) -> DataFrame:
    labels = cluster.cluster_vectors(table(spark, sf, "embeddings"))
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("txt:"), F.col("doc_id").cast("string")).alias("source_id"), "source", "text")
    members = labels.join(d, F.col("vec_id") == F.col("doc_id")).select("label", "source_id", F.col("source").alias("title"), "text")
    return cluster.summary_nodes(members, 1).select("source_id", "chunk_index", "size", F.length("text").alias("chars"))


@query("SELECT doc_id FROM documents WHERE source = 'src2'")
def q_filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    return search.payload_filter(docs(spark, sf), {"source": "src2"}).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src1'")
def q_filter_not(spark: SparkSession, sf: str) -> DataFrame:
    return search.payload_filter(docs(spark, sf), {"source": {"ne": "src1"}}).select("doc_id")


@query("""SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 10 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) < 60 AND event_type <> 'x'""")
def q_filter_nested(spark: SparkSession, sf: str) -> DataFrame:
    """A range on a key within a VARIANT column."""
    events = table(spark, sf, "events").withColumn("props", F.try_parse_json("props"))
    return search.payload_filter(events, {"props.k": {"gte": 10, "lt": 60}, "event_type": {"ne": "x"}}).select("event_id")


NOTE_SQL = """n AS (SELECT doc_id, 'status: ' || CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'open' END AS status, doc_id % 10 AS rank FROM documents)"""


@query(f"WITH {NOTE_SQL} SELECT doc_id FROM n WHERE status = 'status: open' AND rank > 4")
def q_filter_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes with a YAML header, found by values nested in it."""
    k = F.col("doc_id")
    head = F.concat(F.lit("---\ntask:\n  status: "), F.when(k % 3 == 0, "done").otherwise("open"), F.lit("\n  rank: "), (k % 10).cast("string"), F.lit("\n  labels: [a, l"), (k % 2).cast("string"), F.lit("]\n---\n"))
    notes_ = docs(spark, sf).select("doc_id", files.front_values(F.concat(head, F.coalesce("text", F.lit("")))).alias("frontmatter"))
    where = {"frontmatter.task.status": "open", "frontmatter.task.rank": {"gt": 4}, "frontmatter.task.labels": ["a", "zz"], "frontmatter.gone": {"ne": "x"}}
    return search.payload_filter(notes_, where).select("doc_id")


#: Components of a token vector where embeddings stand in for the tokens of a text.
TOKEN_DIM = 8


def token_vectors(column: str) -> Column:
    """A vector cut into token vectors."""
    v = F.col(column)
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / TOKEN_DIM).cast("int") - 1), lambda i: F.slice(v, i * TOKEN_DIM + 1, TOKEN_DIM))


@query(f"""WITH {DENSE}, pool AS (SELECT * FROM dense WHERE rank <= 20),
    t AS (SELECT vec_id, i, CAST(embedding[i * 8 + 1 : i * 8 + 8] AS DOUBLE[]) AS t FROM embeddings, generate_series(0, 7) g(i)),
    m AS (SELECT query_id, id, rank, max(list_inner_product(q.t, d.t)) AS s FROM pool JOIN t q ON q.vec_id = query_id JOIN t d ON d.vec_id = id GROUP BY query_id, id, rank, q.i),
    s AS (SELECT query_id, id, rank, round(sum(s), 6) AS rerank_score FROM m GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, id) AS final_rank FROM s)
    SELECT query_id, id, CAST(final_rank AS INT) AS final_rank, rerank_score FROM f WHERE final_rank <= 8""")
def q_maxsim_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Late interaction over the token vectors of a dense pool."""
    v = table(spark, sf, "embeddings").select("vec_id", token_vectors("embedding").alias("t"))
    pool = search.dense_topk(table(spark, sf, "embeddings"), asked(spark, sf), 20, digits=6).select("query_id", "id", "rank")
    full = pool.join(v.select(F.col("vec_id").alias("id"), F.col("t").alias("text")), "id").join(v.select(F.col("vec_id").alias("query_id"), F.col("t").alias("query")), "query_id")
    scorer = lambda a, b: F.round(search.max_sim(a, b), 6)
    return search.rerank(full, scorer, F.col("query"), F.col("text"), 20, 8).select("query_id", "id", "final_rank", "rerank_score")


@query("""WITH s AS (SELECT vec_id, embedding, CAST(c AS INT) AS chunk_index, [0, 30, 55][c + 1] AS a, [30, 55, 100][c + 1] AS b FROM embeddings, generate_series(0, 2) g(c)),
    t AS (SELECT *, CAST(floor(a / 100.0 * 8) AS INT) AS lo, CAST(floor(b / 100.0 * 8) AS INT) AS hi FROM s),
    p AS (SELECT vec_id, chunk_index, j, avg(CAST(embedding[i * 8 + j] AS DOUBLE)) AS x FROM t, generate_series(0, 7) g(i), generate_series(1, 8) h(j) WHERE i >= lo AND i < greatest(hi, lo + 1) GROUP BY ALL)
    SELECT vec_id, chunk_index, round(max(CASE WHEN j = 1 THEN x END) / (sqrt(sum(x * x)) + 1e-12), 6) AS lead FROM p GROUP BY ALL""")
def q_late_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Three chunks of 100 characters each, from the token vectors of the whole."""
    tokens = table(spark, sf, "embeddings").select("vec_id", F.lit(100).alias("n_chars"), token_vectors("embedding").alias("tokens"))
    spans = tokens.select("vec_id", F.inline(F.array(*[F.struct(F.lit(i).alias("chunk_index"), F.lit(a).alias("char_start"), F.lit(b).alias("char_end")) for i, (a, b) in enumerate(((0, 30), (30, 55), (55, 100)))])))
    return chunking.late_vectors(tokens, spans, "vec_id").select("vec_id", "chunk_index", F.round(F.get("embedding", F.lit(0)), 6).alias("lead"))


@query(f"""WITH {EDGES_SQL}, n AS (SELECT 'obsidian:' || n_name || '.md' AS node FROM nation UNION SELECT 'obsidian:' || r_name || '.md' FROM region)
    SELECT src, dst FROM edges WHERE src IN (FROM n) AND dst IN (FROM n)""")
def q_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda t, c: table(spark, sf, t).select(F.concat(F.lit("obsidian:"), c, F.lit(".md")).alias("node"))
    return graph.subgraph(graph.link_graph(notes(spark, sf)), name("nation", "n_name").unionByName(name("region", "r_name")))


@query(f"""WITH {EDGES_SQL}, b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
    c AS (SELECT CAST(n_regionkey AS BIGINT) AS query_id, 'obsidian:' || n_name || '.md' AS source_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank FROM nation),
    r AS (SELECT DISTINCT query_id, dst AS source_id FROM c JOIN b ON src = source_id WHERE rank <= 5),
    x AS (SELECT r.* FROM r ANTI JOIN c USING (query_id, source_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source_id) AS position FROM x)
    SELECT query_id, CAST(position AS INT) AS position, source_id FROM o WHERE position <= 20""")
def q_related(spark: SparkSession, sf: str) -> DataFrame:
    """What the nations of each region, taken as citations, are linked to."""
    w = Window.partitionBy("query_id").orderBy("n_nationkey")
    cited = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("query_id"), "n_nationkey", F.concat(F.lit("obsidian:"), "n_name", F.lit(".md")).alias("source_id"))
    return graph.related(graph.link_graph(notes(spark, sf)), cited.withColumn("rank", F.row_number().over(w)))


@query()
def q_summary_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of document clusters, level by level."""
    d = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("txt:"), F.col("doc_id").cast("string")).alias("source_id"), F.col("source").alias("title"), "text")
    leaves = d.join(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v")), "vec_id")
    return cluster.summary_tree(leaves).select("source_id", "level", "size", F.size("member_sources").alias("sources"), F.length("text").alias("chars"))


@query()
def q_community_notes(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    chunks = n.select("source_id", F.lit(0).alias("chunk_index"), "title", F.col("body").alias("text"))
    return cluster.community_nodes(graph.communities(graph.link_graph(n)), chunks).select("source_id", "title", "text", F.size("member_sources").alias("sources"))
