"""Queries of whole flows and of text functions: retrieval, time phrases, prompts, sections, images, communities."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import timehint
from millrace.operators import chat, chunking, graph, ingest, retrieve, search, state, vectors
from millrace.session import table

from .ingest import docs, txt_id
from .notes import EDGES_SQL, SQL, notes

Q: dict = {}
SQLS: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQLS[f.__name__] = sql
        return f

    return put


# Retrieval ------------------------------------------------------------------

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"


def hash_vectors(rows: str, name: str) -> str:
    """SQL of the hashed bag of words of (id, text): id and a list of 16 numbers of unit length."""
    return f"""
    {name}_c AS (SELECT id, instr('0123456789abcdef', right(md5(t), 1)) - 1 AS b, count(*) AS n FROM (SELECT id, unnest({TOKENS}) AS t FROM {rows}) GROUP BY ALL),
    {name}_n AS (SELECT id, sqrt(sum(n * n)) + 1e-12 AS norm FROM {name}_c GROUP BY id),
    {name} AS (SELECT id, list(coalesce(n, 0) / norm ORDER BY b) AS v FROM
        (SELECT i.id, g.b, c.n, i.norm FROM {name}_n i CROSS JOIN (SELECT unnest(range(16)) AS b) g LEFT JOIN {name}_c c ON c.id = i.id AND c.b = g.b) GROUP BY id)"""


QUESTIONS = {1: "the and of to in", 2: "der die das und", 3: "el la de que y en", 4: "email phone contact the"}


@query(f"""WITH asked AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{q}')" for i, q in QUESTIONS.items())}) a(id, text)),
    d AS (SELECT 'txt:' || doc_id || '::0' AS id, 'txt:' || doc_id AS source_id, text FROM documents WHERE source IS DISTINCT FROM 'src9'),
    {hash_vectors('d', 'dv')}, {hash_vectors('asked', 'qv')},
    p AS (SELECT q.id AS query_id, d.id, round(list_sum([q.v[i] * d.v[i] for i in generate_series(1, 16)]), 6) AS score FROM qv q, dv d),
    dl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p),
    post AS (SELECT DISTINCT id, unnest({TOKENS}) AS token FROM d), qt AS (SELECT DISTINCT id AS query_id, unnest({TOKENS}) AS token FROM asked),
    idf AS (SELECT token, ln(((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post GROUP BY token),
    s AS (SELECT query_id, id, round(sum(idf), 6) AS score FROM qt JOIN post USING (token) JOIN idf USING (token) GROUP BY ALL),
    ll AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
    f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dl WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM ll WHERE rank <= 50) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f),
    t AS (SELECT query_id, r.id, source_id, rank, 1.0::DOUBLE / (60 + rank) AS score, len(list_intersect(list_distinct({TOKENS.replace('lower(text)', 'lower(a.text)')}), {TOKENS.replace('lower(text)', 'lower(d.text)')}))
          / len(list_distinct({TOKENS.replace('lower(text)', 'lower(a.text)')})) AS rr FROM r JOIN d ON d.id = r.id JOIN asked a ON a.id = query_id WHERE rank <= 50),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rank, id) AS final_rank FROM t)
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(final_rank AS INT) AS final_rank, id AS chunk_id, source_id, round(CASE WHEN rr <> 0 THEN rr ELSE score END, 6) AS score FROM o WHERE final_rank <= 8""")
def q_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way of a question: hashed vectors and weighted words, fused, reranked by overlap."""
    rows = docs(spark, sf).where("source is distinct from 'src9'").select(F.concat(txt_id(), F.lit("::0")).alias("chunk_id"), txt_id().alias("source_id"), F.lit(0).alias("chunk_index"), "text", "lang")
    hits = retrieve.retrieve(rows, QUESTIONS, params=retrieve.Params(digits=6))
    return hits.select("query_id", "final_rank", "chunk_id", "source_id", F.round("score", 6).alias("score"))


MEMORY = """
    m AS (SELECT conv_id * 10000 + turn AS id, 'Q: ' || text || chr(10) || 'A: ' || a AS text FROM (
        SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND r2 = 'assistant' AND length(a) >= 16)"""


@query(f"""WITH {MEMORY}, {hash_vectors('m', 'mv')},
    p AS (SELECT q.id AS query_id, d.id, round(list_sum([q.v[i] * d.v[i] for i in generate_series(1, 16)]), 6) AS score FROM mv q, mv d WHERE q.id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p)
    SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 3""")
def q_memory_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Remembered answers nearest to others, by cosine of hashed vectors."""
    m = chat.memory_pairs(table(spark, sf, "conversations")).select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), search.hash_embed(F.col("memory")).alias("v"))
    return search.dense_topk(m, m.where("id % 50 = 0"), 3, "id", "v", 6)


# Time phrases ---------------------------------------------------------------

NOW = datetime(2024, 1, 17, 10, 30, tzinfo=timezone.utc)
#: Phrases and what they mean at NOW, in SQL.
PHRASES = {
    "what happened today": "ts >= '2024-01-17' AND ts <= '2024-01-18'",
    "notes from yesterday": "ts >= '2024-01-16' AND ts <= '2024-01-17'",
    "events of this week": "ts >= '2024-01-15' AND ts <= '2024-01-22'",
    "show last week please": "ts >= '2024-01-08' AND ts <= '2024-01-15'",
    "what did I do this month": "ts >= '2024-01-01' AND ts <= '2024-02-01'",
    "summary of last month": "ts >= '2023-12-01' AND ts <= '2024-01-01'",
    "all of this year": "ts >= '2024-01-01' AND ts <= '2025-01-01'",
    "2 days ago": "ts >= '2024-01-15' AND ts <= '2024-01-16'",
    "the year 2023 in review": "ts >= '2023-01-01' AND ts <= '2024-01-01'",
    "before january 2024": "ts <= '2024-01-01 10:30:00'",
    "since january 2024": "ts >= '2024-01-01 10:30:00'",
    "no time at all": "true",
}


@query(" UNION ALL ".join(f"SELECT '{p}' AS phrase, count(*) AS n FROM events WHERE {w}" for p, w in PHRASES.items()))
def q_time_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the ranges that phrases name; each phrase is one filter, all in one pass over the events."""
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))

    def within(where: dict | None) -> Column:
        tests = {"gte": lambda b: F.col("ts") >= b, "lte": lambda b: F.col("ts") <= b}
        out = F.lit(True)
        for op, bound in (where or {"ts": {}})["ts"].items():
            out = out & tests[op](F.lit(bound))
        return out

    found = [F.struct(F.lit(p).alias("phrase"), F.count_if(within(timehint.time_filter(p, NOW, "ts")[0])).alias("n")) for p in PHRASES]
    return events.agg(F.array(*found).alias("a")).select(F.inline("a"))


# Text -----------------------------------------------------------------------


@query(r"""SELECT doc_id, sha256(CASE WHEN length(text) <= 400 THEN text ELSE left(text, 200) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 200) END) AS trimmed FROM documents""")
def q_trim_document(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.sha2(T.trim_document(F.col("text"), 400), 256).alias("trimmed"))


@query(r"""SELECT doc_id, sha256('<chunk id="0">' || chr(10) || coalesce(source, '') || chr(10) || '</chunk>' || chr(10) || '<chunk id="1">' || chr(10) || coalesce(lang, '') || chr(10) || '</chunk>') AS prompt,
    nullif('about ' || coalesce(source, 'nothing'), '') AS context FROM documents""")
def q_context_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt of two chunks, and a model's answer with prose and bad rows around the good one; null chunks are empty ones."""
    said = F.concat(F.lit('Sure: {"contexts": [{"id": "7", "context": "first"}, {"id": "x", "context": "bad"}, {"id": 3, "context": "  "}, {"id": 7, "context": " about '), F.coalesce("source", F.lit("nothing")), F.lit(' "}]} done'))
    chunks = F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return docs(spark, sf).select("doc_id", F.sha2(T.format_batch(chunks), 256).alias("prompt"), F.try_element_at(T.parse_batch(said), F.lit(7)).alias("context"))


@query(f"""WITH {SQL} SELECT pos, '[' || title || ' :: A > ' || title || ']' AS deep, '[' || 'obsidian:' || title || '.md]' AS bare FROM notes""")
def q_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = notes(spark, sf)
    deep = T.label(F.col("title"), F.col("source_id"), F.array(F.lit("A"), F.col("title")))
    return n.select("pos", deep.alias("deep"), T.label(F.lit(""), F.col("source_id"), F.array().cast("array<string>")).alias("bare"))


@query("""SELECT s_suppkey, 'img/' || s_suppkey || '.png;' || s_name || '.WEBP;pics/' || s_suppkey || '.jpg' AS refs FROM supplier""")
def q_image_refs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("text ![](pics/"), k, F.lit('.jpg "a title") and ![[img/'), k, F.lit(".png|200]] or ![["), "s_name", F.lit(".WEBP]] not ![[note]] or [x](y.png)"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(T.image_refs(body), ";").alias("refs"))


@query(r"""SELECT p_partkey, replace(regexp_replace(p_name || ': (v/1)', '[^A-Za-z0-9 \-_]', '-', 'g'), ' ', '-') AS file, left(regexp_replace(p_name || ' & more', '[^A-Za-z0-9-_]+', '-', 'g'), 60) AS slug FROM part""")
def q_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", T.safe_filename(F.concat("p_name", F.lit(": (v/1)"))).alias("file"), T.snippet_slug(F.concat("p_name", F.lit(" & more"))).alias("slug")
    )


@query("""SELECT c_custkey, array_to_string(list_sort(list_distinct(['home', lower(c_mktsegment), 'zz', 'n' || c_nationkey])), ';') AS tags FROM customer""")
def q_merge_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tags of a header, cleaned, and all tags of the text."""
    body = F.concat(F.lit("a #"), F.lower("c_mktsegment"), F.lit(" b #n"), F.col("c_nationkey").cast("string"), F.lit("\n#home and no#tag"))
    front = T.clean_tags(F.array(F.lit("#home"), F.lit("zz")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(T.merge_tags(front, T.inline_tags(body)), ";").alias("tags"))


@query(f"""WITH {SQL}, c AS (
    SELECT title, pos, 0 AS chunk_index, title AS path, CASE WHEN pos // 100000000 = 4 THEN '# ' || title ELSE body END AS text FROM notes
    UNION ALL SELECT title, pos, 1, title || ' > Where', '## Where' || chr(10) || chr(10) || regexp_extract(body, '\\[\\[.*$') FROM notes WHERE pos // 100000000 = 4)
    SELECT 'obsidian:' || title || '.md' AS source_id, CAST(chunk_index AS INT) AS chunk_index, path, text, 'obsidian:' || title || '.md::' || chunk_index || '::' || left(sha256(text), 16) AS chunk_id FROM c""")
def q_chunk_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks as ingest makes them: by headers, with the headers above them."""
    rows = chunking.chunk_documents(notes(spark, sf).select("source_id", F.col("body").alias("content")))
    return rows.select("source_id", "chunk_index", F.array_join("header_path", " > ").alias("path"), "text", "chunk_id")


@query(f"""WITH i AS (SELECT 'img/' || replace(n_name, ' ', '_') || '.png' AS image, lower(n_name) AS text, replace(lower(n_name), '_', ' ') AS said, n_nationkey AS k FROM nation), c AS (SELECT image AS id, said AS text FROM i), a AS (SELECT k AS id, text || ' map' AS text FROM i),
    {hash_vectors('c', 'cv')}, {hash_vectors('a', 'av')},
    p AS (SELECT q.id AS query_id, d.id AS image, round(list_sum([q.v[i] * d.v[i] for i in generate_series(1, 16)]), 6) AS score FROM av q, cv d),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, image) AS rank FROM p)
    SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, image, score FROM r WHERE rank <= 4""")
def q_image_search(spark: SparkSession, sf: str) -> DataFrame:
    """Images of notes by what their names say."""
    nation = table(spark, sf, "nation")
    rel = F.concat(F.lit("img/"), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(".png"))
    body = F.concat(F.lit("see ![["), rel, F.lit("]]"))
    refs = nation.select(F.concat(F.lit("obsidian:"), "n_name").alias("source_id"), F.lit("x.md").alias("rel"), body.alias("body"))
    files = nation.select(rel.alias("rel"), T.norm_key(F.regexp_extract(rel, r"([^/]+)$", 1)).alias("name_key"))
    index = ingest.index_images(ingest.discover_images(refs, files))
    return ingest.search_images(index, nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lower("n_name"), F.lit(" map")).alias("text")), 4, digits=6)


@query(f"WITH {EDGES_SQL}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node FROM n")
def q_louvain(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes that communities cover: each once. Their quality is tested by modularity."""
    return graph.louvain(graph.link_graph(notes(spark, sf))).select("node")


@query(r"""WITH c AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, left(regexp_replace('[' || source || ']' || chr(10) || text, '^\s+|\s+$', '', 'g'), 200) AS note, doc_id FROM documents WHERE lang = 'en')
    SELECT 'txt' AS topic, CAST(count(*) AS INT) AS chunks, left(regexp_replace(string_agg(note, chr(10) || chr(10) ORDER BY doc_id), '^\s+|\s+$', '', 'g'), 200) AS summary FROM c WHERE n <= 200""")
def q_summary_of_type(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "txt").otherwise("other")
    rows = docs(spark, sf).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("source_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("title"), "text", F.array("source").alias("tags"), kind.alias("source_type"))
    return chat.summarise_where(rows, source_type="txt")


@query()
def q_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as clean chunks without duplicates."""
    rows = docs(spark, sf).select(txt_id().alias("source_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return ingest.ingest(rows).select("chunk_id", "source_id", "chunk_index", F.length("text").alias("chars"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE month(o_orderdate) = 3 AND day(o_orderdate) = 15 AND year(o_orderdate) < 1998")
def q_on_this_day(spark: SparkSession, sf: str) -> DataFrame:
    return search.on_this_day(table(spark, sf, "orders"), "o_orderdate", "1998-03-15 12:00:00").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_exists_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the labels don't know yet."""
    return state.unknown(docs(spark, sf), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("""WITH p AS (SELECT q.vec_id AS src, v.vec_id AS dst, round(list_sum([CAST(q.embedding[i] AS DOUBLE) * v.embedding[i] for i in generate_series(1, len(q.embedding))]), 6) AS score
        FROM embeddings q, embeddings v), a AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS n FROM a WHERE r <= 6 AND src <> dst)
    SELECT src, dst, score FROM b WHERE n <= 5 AND score >= 0.3""")
def q_similarity_graph(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.similarity_graph(table(spark, sf, "embeddings"), 5, 0.3, digits=6)
