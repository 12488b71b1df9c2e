"""Queries of conversations, summaries, evaluation and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chat, search
from millrace.session import table

from .ingest import docs

Q: dict = {}
SQLS: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQLS[f.__name__] = sql
        return f

    return put


def talks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 8")
def q_history_window(spark: SparkSession, sf: str) -> DataFrame:
    return chat.history_window(talks(spark, sf)).select("conv_id", "turn", "role")


@query("SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def q_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return talks(spark, sf).groupBy("conv_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("SELECT conv_id, count(*) AS turns, sha256(string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn)) AS body_hash FROM conversations GROUP BY conv_id")
def q_export_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.transcripts(talks(spark, sf)).select("conv_id", "turns", F.sha2("body", 256).alias("body_hash"))


SLASH = "CASE conv_id % 6 WHEN 0 THEN '/search ' WHEN 1 THEN '/WEB ' WHEN 2 THEN '/cite ' WHEN 3 THEN '/dry-run ' WHEN 4 THEN '/zoomies ' ELSE '' END || text"


@query(f"""SELECT conv_id, turn, CASE conv_id % 6 WHEN 0 THEN 'search' WHEN 1 THEN 'web' WHEN 2 THEN 'cite' WHEN 3 THEN 'dry_run' END AS cmd,
    sha256(CASE WHEN conv_id % 6 < 4 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE {SLASH} END) AS query_hash,
    CASE WHEN conv_id % 6 = 1 THEN 'web' WHEN conv_id % 6 < 4 THEN 'retrieve' END AS force_path, conv_id % 6 = 2 AS cite_only, conv_id % 6 = 3 AS dry_run FROM conversations""")
def q_slash(spark: SparkSession, sf: str) -> DataFrame:
    six = F.col("conv_id") % 6
    head = F.when(six == 0, "/search ").when(six == 1, "/WEB ").when(six == 2, "/cite ").when(six == 3, "/dry-run ").when(six == 4, "/zoomies ").otherwise("")
    rows = talks(spark, sf).select("conv_id", "turn", T.parse_slash(F.concat(head, "text")).alias("s"))
    return rows.select("conv_id", "turn", "s.cmd", F.sha2("s.query", 256).alias("query_hash"), "s.force_path", "s.cite_only", "s.dry_run")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'next|proceed|continue|move on') THEN 'NEXT' WHEN regexp_matches(lower(text), 'back|previous') THEN 'BACK' ELSE 'QUESTION' END AS intent FROM conversations""")
def q_intent(spark: SparkSession, sf: str) -> DataFrame:
    return talks(spark, sf).select("conv_id", "turn", T.classify_intent(F.col("text")).alias("intent"))


@query("SELECT n_nationkey, 'Start;' || n_name || ';End' AS plan FROM nation")
def q_plan_parse(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Hello\nLearning plan:\n1. Start\n 2.  "), "n_name", F.lit(" \n3. End\n\n4. No"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(T.parse_plan(text), ";").alias("plan"))


MEMORY = """
    m AS (SELECT conv_id, turn, 'Q: ' || text || chr(10) || 'A: ' || a AS memory FROM (
        SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND r2 = 'assistant' AND length(a) >= 16)"""


@query(f"WITH {MEMORY} SELECT conv_id, turn, sha256(memory) AS memory_hash FROM m")
def q_memory_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return chat.memory_pairs(talks(spark, sf)).select("conv_id", "turn", F.sha2("memory", 256).alias("memory_hash"))


@query(f"""WITH {MEMORY}, k AS (SELECT conv_id * 10000 + turn AS id, list_filter(regexp_split_to_array(lower(memory), '\\s+'), lambda t: t <> '') AS t FROM m),
    p AS (SELECT DISTINCT id, unnest(t) AS token FROM k), q AS (SELECT DISTINCT id AS query_id, unnest(t) AS token FROM k WHERE id % 50 = 0),
    s AS (SELECT query_id, id, count(*) AS score FROM q JOIN p USING (token) WHERE id <> query_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INT) AS rank, id, score FROM r WHERE rank <= 3""")
def q_memory_recall(spark: SparkSession, sf: str) -> DataFrame:
    m = chat.memory_pairs(talks(spark, sf)).select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.col("memory").alias("text"))
    q = m.where(F.col("id") % 50 == 0).withColumnRenamed("id", "query_id")
    hits = search.lexical_topk(m, q, 4, weighted=False).where("id <> query_id")  # one more, for the query itself
    return search.ranked(hits.withColumn("score", F.col("score").cast("long")), 3)


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 3 AS INT) AS set FROM documents")
def q_speculative_partition(spark: SparkSession, sf: str) -> DataFrame:
    return chat.partition_round_robin(docs(spark, sf).select("source", "doc_id"), 3, "source", "doc_id").select("doc_id", "set")


BLOCK = "'[' || source || '] ' || left(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 600)"


@query(f"""WITH b AS (SELECT source, doc_id, {BLOCK} AS block FROM documents),
    u AS (SELECT *, sum(length(block)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM b)
    SELECT source, count(*) AS blocks, sha256(string_agg(block, chr(10) || chr(10) ORDER BY doc_id)) AS excerpt_hash FROM u WHERE used <= 12000 GROUP BY source""")
def q_excerpt_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("source", F.col("doc_id").alias("pos"), F.col("source").alias("title"), "text")
    return chat.excerpt_budget(rows, "source").select("source", F.col("blocks").cast("long").alias("blocks"), F.sha2("excerpt", 256).alias("excerpt_hash"))


@query(r"""WITH c AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id,
        left(regexp_replace('[' || source || ']' || chr(10) || text, '^\s+|\s+$', '', 'g'), 200) AS note FROM documents),
    g AS (SELECT source, count(*) AS chunks, string_agg(note, chr(10) || chr(10) ORDER BY doc_id) AS notes FROM c WHERE n <= 200 GROUP BY source)
    SELECT source, CAST(chunks AS INT) AS chunks, left(regexp_replace(notes, '^\s+|\s+$', '', 'g'), 200) AS summary FROM g""")
def q_summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = docs(spark, sf).select("source", F.col("doc_id").alias("pos"), F.col("source").alias("title"), "text")
    return chat.summarise(rows, "source")


@query("""SELECT doc_id AS item, CASE WHEN contains(lower(text), 'the') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN contains(lower(text), 'a') THEN 0.5::DOUBLE ELSE 0 END AS rate FROM documents""")
def q_substring_rate(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    want = d.select(F.col("doc_id").alias("item"), F.array(F.lit("the"), F.lit("a")).alias("want"))
    have = d.select(F.col("doc_id").alias("item"), F.lower("text").alias("have"))
    return chat.hit_rate(want, have, "item", "want", "have")


@query("""SELECT conv_id AS item, CASE WHEN max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = 1 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 THEN 0.5::DOUBLE ELSE 0 END AS rate
    FROM conversations GROUP BY conv_id""")
def q_citation_rate(spark: SparkSession, sf: str) -> DataFrame:
    t = talks(spark, sf)
    want = t.select(F.col("conv_id").alias("item")).distinct().withColumn("want", F.array(F.lit("user"), F.lit("system")))
    return chat.hit_rate(want, t.select(F.col("conv_id").alias("item"), F.col("role").alias("have")), "item", "want", "have")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN true ELSE epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(ts)) >= CASE event_id % 4 WHEN 0 THEN 21600 WHEN 1 THEN 3600 ELSE 1800 END END AS due FROM events""")
def q_schedules_due(spark: SparkSession, sf: str) -> DataFrame:
    four = F.col("event_id") % 4
    cron = F.when(four == 0, "0 9 * * MON").when(four == 1, "0 9 * * *").otherwise("*/5 * * * *")
    last = F.when(four != 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", chat.is_due(cron, last, "2024-01-20 00:00:00").alias("due"))
