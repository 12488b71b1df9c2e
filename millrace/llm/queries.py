"""Queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import ship, table

from . import ann, exact_dedup, langid, mixing, packing, pii, quality, resampling, sharding, simhash, token_counts, toxicity, vector_codes
from .common import crc_mod

SHARDS = 8


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ship(spark), sf_dir, "documents")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = crc_mod("doc_id", 5) != 0
    scored = quality.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(ship(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = crc_mod("doc_id", 3) != 1
    found = langid.identify(documents(spark, sf_dir), learn)
    return found.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_by_label(table(ship(spark), sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = crc_mod("doc_id", 4) != 2
    scored = toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", (~learn).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_token_counts, op3_exact_dedup, op4_pii, op5_packing, op6_quality, op7_mixing, op8_simhash, op9_ann, op10_langid,
        op11_vector_codes, op12_toxicity, op13_resampling,
    )
}



def codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """The codes of op11 by plain comparison with every entry, one CTE a step."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cells AS (
            SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {parts} AS w FROM kept
        ), p AS MATERIALIZED (
            SELECT vec_id, i // w AS part, i % w AS pos, floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT AS q FROM cells
        ), c0 AS MATERIALIZED (
            SELECT part, n - 1 AS entry, pos, q FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM kept) USING (vec_id) WHERE n <= {entries}
        )"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
            SELECT vec_id, part, entry, sum((p.q - c.q) * (p.q - c.q))::BIGINT AS d FROM p JOIN c{r} c USING (part, pos) GROUP BY ALL
        ), a{r} AS MATERIALIZED (
            SELECT vec_id, part, (min(d * 256 + entry) % 256)::BIGINT AS entry, min(d) AS d FROM d{r} GROUP BY ALL
        )""")
        if r < rounds:
            steps.append(f"""m{r} AS (
                SELECT part, entry, pos, floor(sum(q)::DOUBLE / count(*))::BIGINT AS q FROM p JOIN a{r} USING (vec_id, part) GROUP BY ALL
            ), c{r + 1} AS MATERIALIZED (
                SELECT part, entry, pos, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (part, entry, pos)
            )""")
    return f"""
        WITH {", ".join(steps)},
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        by_label AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label)
        SELECT vec_id, code, error, label_error,
            (SELECT sha256(string_agg(q::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id) JOIN by_label ON kept.label IS NOT DISTINCT FROM by_label.label
    """


ORACLES: dict[str, str] = {
    "op11_vector_codes": codes_sql(),
    "op13_resampling": r"""
        WITH table256 AS MATERIALIZED (
            SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t
        ), texts AS (
            SELECT doc_id AS id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark
        ), split AS MATERIALIZED (
            SELECT id, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM texts
        ), bytes AS (
            SELECT word, list_transform(range(1, length(hex(encode(word))), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT) AS b
            FROM (SELECT DISTINCT word FROM split)
        ), buckets AS MATERIALIZED (
            SELECT word, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, table256
        ), n AS (
            SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM split JOIN buckets USING (word) GROUP BY bucket
        ), gains AS MATERIALIZED (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM n
        ), weighed AS (
            SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
            FROM split JOIN buckets USING (word) JOIN gains USING (bucket) WHERE own GROUP BY id
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM documents LEFT JOIN weighed USING (doc_id)
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
    """,
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, false) AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
}
