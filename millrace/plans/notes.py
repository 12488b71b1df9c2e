"""Notes rendered from the dimension tables, in Spark and in SQL alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.session import table

SQL = r"""
notes AS (
    SELECT 100000000 + r_regionkey AS pos, r_name AS title, '# ' || r_name AS body FROM region
    UNION ALL
    SELECT 200000000 + n_nationkey, n_name, '# ' || n_name || chr(10) || chr(10) || 'Part of [[' || r_name || ']] #nation' FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 300000000 + c_custkey, c_name, '# ' || c_name || chr(10) || chr(10) || 'Lives in [[' || n_name || '|home]] and [[' || n_name || ']] #' || lower(c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT 400000000 + s_suppkey, s_name, '# ' || s_name || chr(10) || chr(10) || '## Where' || chr(10) || chr(10) || '[[' || n_name || '#info]]' FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""

#: Resolved links of the rendered notes, each target a note's title.
EDGES_SQL = SQL + r""",
links AS (
    SELECT DISTINCT 'obsidian:' || title || '.md' AS src, trim(split_part(split_part(raw, '|', 1), '#', 1)) AS target
    FROM (SELECT title, unnest(regexp_extract_all(body, '\[\[([^\]\n]+?)\]\]', 1)) AS raw FROM notes)
),
titles AS (SELECT lower(title) AS norm_title, arg_min('obsidian:' || title || '.md', pos) AS source_id FROM notes GROUP BY 1),
edges AS (SELECT DISTINCT src, source_id AS dst FROM links JOIN titles ON lower(target) = norm_title WHERE src <> source_id)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, source_id, title, body, aliases and wikilinks of every rendered note."""
    t = lambda name: table(spark, sf_dir, name)
    nation = t("nation")
    parts = [
        (t("region"), 100_000_000, "r_regionkey", "r_name", "concat('# ', r_name)"),
        (nation.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")), 200_000_000, "n_nationkey", "n_name", "concat('# ', n_name, '\n\nPart of [[', r_name, ']] #nation')"),
        (
            t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), 300_000_000, "c_custkey", "c_name",
            "concat('# ', c_name, '\n\nLives in [[', n_name, '|home]] and [[', n_name, ']] #', lower(c_mktsegment))",
        ),
        (
            t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), 400_000_000, "s_suppkey", "s_name",
            "concat('# ', s_name, '\n\n## Where\n\n[[', n_name, '#info]]')",
        ),
    ]
    rows = [
        df.select((F.col(key).cast("long") + F.lit(base)).alias("pos"), F.col(title).alias("title"), F.expr(body).alias("body")) for df, base, key, title, body in parts
    ]
    return reduce(DataFrame.unionByName, rows).select(
        "pos", F.concat(F.lit("obsidian:"), "title", F.lit(".md")).alias("source_id"), "title", "body",
        F.array().cast("array<string>").alias("aliases"), T.wikilinks(F.col("body")).alias("wikilinks"),
    )
