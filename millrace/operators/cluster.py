"""Clusters of vectors and a tree of summaries over them."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import shared_dir

from .chat import TextModel, excerpt_budget, template_model
from .search import hash_embed
from .state import Store

#: What stands between the members' texts.
RULE = "\n\n---\n\n"


def cluster_count(n: int, least: int = 5, most: int = 64) -> int:
    return 1 if n < 2 * least else max(2, min(most, n // least))


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: int = 5, most: int = 64, dim: int = 8, seed: int = 42) -> DataFrame:
    """id and label: principal components, then a Gaussian mixture; too few vectors are one cluster."""
    rows = vectors.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    n = rows.count()
    k = cluster_count(n, least, most)
    if k == 1:
        return rows.select(id_col, F.lit(0).alias("label"))
    x = rows.select(id_col, array_to_vector(F.col(vec_col)).alias("x"))
    width = len(rows.first()[vec_col])
    reduced = PCA(k=min(dim, width, n - 1), inputCol="x", outputCol="p").fit(x).transform(x)
    mixture = GaussianMixture(k=k, featuresCol="p", predictionCol="label", seed=seed, maxIter=20).fit(reduced)
    return mixture.transform(reduced).select(id_col, F.col("label").cast("int").alias("label"))


def summary_nodes(members: DataFrame, level: int, least: int = 5, most_chars: int = 12000, model: TextModel | None = None) -> DataFrame:
    """One node per cluster of at least `least` members: id by the members' hash, label, size, sources and joined text.

    members: label, source_id, title, text. Only texts that reach into the first most_chars
    characters of a cluster are brought together, however many members it has. With a
    model, text is its answer to the joined text, and nodes with a blank one drop out.
    """
    sized = members.groupBy("label").agg(F.count("*").alias("size"), F.array_sort(F.collect_set("source_id")).alias("member_sources")).where(F.col("size") >= least)
    block = F.left(F.concat(F.lit("["), "title", F.lit("] "), "text"), F.lit(most_chars))
    # With its rule a block takes 10 characters at least.
    by_id = Window.partitionBy("label").orderBy("source_id", "t")
    rows = members.select("label", "source_id", block.alias("t")).withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= most_chars // 10 + 2)
    before = F.sum(F.length("t") + len(RULE)).over(by_id.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.where(F.col("t").isNotNull()).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most_chars + len(RULE))
    texts = rows.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("b"))
    digest = F.substring(F.sha2(F.array_join("member_sources", "|"), 256), 1, 12)
    nodes = sized.join(texts, "label").select(
        F.concat(F.lit(f"raptor:L{level}:"), digest).alias("source_id"), F.col("label").alias("chunk_index"), "size", "member_sources",
        F.left(F.array_join(F.transform("b", lambda x: x["t"]), RULE), F.lit(most_chars)).alias("text"),
    )
    return nodes if model is None else nodes.withColumn("text", F.pandas_udf(lambda s: s.map(model), "string")("text")).where(F.trim("text") != "")


def summary_tree(leaves: DataFrame, model: TextModel = template_model, least: int = 5, most: int = 64, max_levels: int = 3, seed: int = 42) -> DataFrame | None:
    """Summaries of clusters, then of clusters of summaries: level and the columns of summary_nodes; None for too few leaves.

    leaves: source_id, title, text, v (vector). A level is written before the next one
    starts; the tree stops at max_levels, or where a level has under twice `least` nodes.
    """
    spark, out = leaves.sparkSession, None
    rows = leaves.select("source_id", "title", "text", "v")
    for level in range(1, max_levels + 1):
        if rows.limit(2 * least).count() < 2 * least:
            break
        labels = cluster_vectors(rows, "source_id", "v", least, most, seed=seed + level)
        shared_dir(spark)  # where checkpoints go
        nodes = summary_nodes(rows.join(labels, "source_id"), level, least, model=model).withColumn("level", F.lit(level)).checkpoint()
        out = nodes if out is None else out.unionByName(nodes)
        rows = nodes.select("source_id", F.concat(F.lit(f"Summary L{level} "), F.col("chunk_index").cast("string")).alias("title"), "text", hash_embed(F.col("text")).alias("v"))
    return out


def community_nodes(found: DataFrame, chunks: DataFrame, model: TextModel = template_model, per_source: int = 2, most_chars: int = 12000) -> DataFrame:
    """One summary for each community: source_id, title, text, member_sources; blank ones drop out.

    found: community, size, members; chunks: source_id, chunk_index, title, text. A member gives its first per_source chunks.
    """
    w = Window.partitionBy("source_id").orderBy("chunk_index")
    first = chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_source)
    rows = found.select("community", F.explode("members").alias("source_id")).join(first, "source_id")
    rows = rows.select("community", F.struct("source_id", "chunk_index").alias("pos"), F.coalesce("title", "source_id").alias("title"), "text")
    excerpts = excerpt_budget(rows, "community", most_chars)
    told = excerpts.select("community", F.pandas_udf(lambda s: s.map(model), "string")("excerpt").alias("text")).where(F.trim("text") != "")
    title = F.concat(F.lit("Community of "), F.col("size").cast("string"), F.lit(" notes"))
    return found.join(told, "community").select(F.col("community").alias("source_id"), title.alias("title"), "text", F.col("members").alias("member_sources"))


#: First parts of the ids of made nodes.
TREE, COMMUNITY = "raptor:", "community:"


def replace_made(store: Store, made: DataFrame | None, prefix: str) -> int:
    """Put made nodes into a store in place of all that have the prefix, in one switch; None or no rows delete them. Returns how many went."""
    held = store.read()
    old = F.col("source_id").startswith(prefix)
    n = held.where(old).count()
    rest = held.where(~old)
    if n or made is not None:
        store.write(rest if made is None else rest.unionByName(made.select(*rest.columns)))
    return n
