"""The ingest chain: chunk, scrub, contextualise, dedupe; and images of notes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import secrets
from millrace.functions import text as T
from millrace.session import written

from . import chunking, dedupe
from .chat import TextModel, template_model
from .ranking import position_in_group
from .search import dense_topk, hash_embed
from .state import cache_lookup


def contextualise(chunks: DataFrame, cache: DataFrame, model: TextModel = template_model) -> tuple[DataFrame, DataFrame]:
    """chunks with contextualized_text, and the cache rows (key, context) to add.

    chunks: source_id, doc_hash, text, title. Contexts come from the cache by
    hash of source, document and text; only misses go to the model, in Arrow batches.
    A blank answer leaves the chunk as it is and is not cached.
    """

    def ask(title: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([model(f"[{a}] {b[:160]}") if b else "" for a, b in zip(title.fillna(""), text.fillna(""), strict=True)])

    keyed = chunks.withColumn("key", T.context_key(F.col("source_id"), F.col("doc_hash"), F.col("text")))
    known = cache_lookup(keyed, cache)
    made = written(known.where(~F.col("hit")).select("key", F.pandas_udf(_typed(ask), "string")("title", "text").alias("context")), "contexts")  # a model is asked once
    made = made.where(F.trim("context") != "").groupBy("key").agg(F.max("context").alias("context"))
    every = cache.where(F.trim("context") != "").select("key", "context").unionByName(made)
    out = keyed.join(every, "key", "left").withColumn(
        "contextualized_text", F.when(F.col("context").isNotNull(), F.concat("context", F.lit("\n\n"), "text"))
    )
    return out.drop("context", "key"), made


def contextualise_batches(chunks: DataFrame, cache: DataFrame, model: TextModel, documents: DataFrame, size: int = 8, most: int = 12000) -> tuple[DataFrame, DataFrame]:
    """As contextualise, but misses of one document go to the model together, at most `size` a prompt, beside the document.

    documents: source_id, content; a long one is cut in the middle to `most` characters.
    What a batch's answer leaves out, or if it is no JSON, is asked for once more, alone.
    """
    keyed = chunks.withColumn("key", T.context_key(F.col("source_id"), F.col("doc_hash"), F.col("text")))
    missed = cache_lookup(keyed, cache).where(~F.col("hit")).select("source_id", "key", "text").dropDuplicates(["key"])
    placed = position_in_group(missed, "source_id", "key")
    whole = documents.select("source_id", T.trim_document(F.col("content"), most).alias("document"))
    groups = placed.groupBy("source_id", F.expr(f"position div {size}").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("position", "key", "text"))).alias("c"))  # at most `size`
    head = F.concat(F.lit("<document>\n"), F.coalesce("document", F.lit("")), F.lit("\n</document>\n"))
    told = F.pandas_udf(lambda s: s.map(model), "string")
    prompt = F.concat(head, F.lit('Give each chunk its context as JSON {"contexts": [{"id", "context"}]}.\n'), T.format_batch(F.transform("c", lambda x: x["text"])))
    answered = groups.join(whole, "source_id", "left").withColumn("said", T.parse_batch(told(prompt)))
    each = answered.select("document", F.posexplode("c").alias("i", "c"), "said").select("document", "c.key", "c.text", F.try_element_at("said", F.col("i")).alias("context"))
    each = written(each, "contexts")  # a model is asked once
    alone = each.where(F.col("context").isNull())
    again = alone.select("key", told(F.concat(head, F.lit("Give the context of this chunk.\n"), F.col("text"))).alias("context")).where(F.trim("context") != "")
    made = written(each.where(F.col("context").isNotNull()).select("key", "context").unionByName(again), "contexts-made")
    every = cache.where(F.trim("context") != "").select("key", "context").unionByName(made)
    out = keyed.join(every, "key", "left").withColumn("contextualized_text", F.when(F.col("context").isNotNull(), F.concat("context", F.lit("\n\n"), "text")))
    return out.drop("context", "key"), made


def _typed(f):
    f.__annotations__ = {"title": pd.Series, "text": pd.Series, "return": pd.Series}
    return f


def ingest(docs: DataFrame, policy: str = "redact", threshold: float = 0.92, cache: DataFrame | None = None, model: TextModel = template_model) -> DataFrame:
    """Documents (source_id, title, content, …) as clean chunks: split, scrubbed, without duplicates, in context.

    Secrets are removed from the document before any of it reaches the model, which is
    asked for no chunk that drops out. Chunks are made once and staged.
    """
    spark = docs.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], "key string, context string")
    if policy == "redact":
        docs = docs.withColumn("content", secrets.redact(F.col("content")))
    base = docs.withColumn("doc_hash", T.content_hash(F.col("content")))
    chunks = secrets.scrub(chunking.chunk_documents(base), policy)
    # Input order is source, then place in it; the order gives each chunk its position.
    placed = written(chunks.withColumn("pos", F.concat_ws("::", "source_id", F.lpad(F.col("chunk_index").cast("string"), 9, "0"))), "ingest-chunks")
    kept, _ = contextualise(dedupe.dedupe(placed, threshold), cache, model)
    return kept.drop("pos", "doc_hash")


def discover_images(notes: DataFrame, images: DataFrame) -> DataFrame:
    """Images that notes refer to, each once: image, source_id, raw. By relative path, else by file name.

    notes: source_id, rel, body; images: rel, name_key, and maybe place: of one name the smallest place counts, then the path.
    """
    refs = notes.select("source_id", F.regexp_replace("rel", r"[^/]*$", "").alias("folder"), F.explode(T.image_refs(F.col("body"))).alias("raw"))
    refs = refs.withColumn("name_key", T.norm_key(F.regexp_extract("raw", r"([^/]+)$", 1))).withColumn("beside", F.concat("folder", "raw"))
    place = F.col("place") if "place" in images.columns else F.lit(0)
    by_name = images.groupBy("name_key").agg(F.min_by("rel", F.struct(place, "rel")).alias("named"))
    by_path = images.select(F.col("rel").alias("beside"), F.col("rel").alias("exact"))
    found = refs.join(by_path, "beside", "left").join(by_name, "name_key", "left").select(F.coalesce("exact", "named").alias("image"), "source_id", "raw")
    return found.where(F.col("image").isNotNull()).groupBy("image").agg(F.min(F.struct("source_id", "raw")).alias("r")).select("image", "r.source_id", "r.raw")


def caption(image: Column) -> Column:
    """What an image's file name says; stands in for an image model."""
    return F.trim(F.regexp_replace(F.regexp_extract(image, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1), r"[^\p{L}\p{N}]+", " "))


def index_images(found: DataFrame, embed: Callable[[Column], Column] = hash_embed, describe: Callable[[Column], Column] = caption) -> DataFrame:
    """Images of discover_images with a caption and its vector: image, source_id, caption, v; those without a caption drop out."""
    told = found.withColumn("caption", describe(F.col("image"))).where("caption <> ''")
    return told.select("image", "source_id", "caption", embed(F.col("caption")).alias("v"))


def search_images(index: DataFrame, queries: DataFrame, k: int = 8, embed: Callable[[Column], Column] = hash_embed, digits: int | None = None) -> DataFrame:
    """The k images nearest to each query (query_id, text): query_id, rank, image, score; ties go to the smaller name."""
    asked = queries.select(F.col("query_id").alias("image"), embed(F.col("text")).alias("v"))
    return dense_topk(index, asked, k, "image", "v", digits).withColumnRenamed("id", "image")
