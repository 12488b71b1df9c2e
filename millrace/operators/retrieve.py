"""Retrieval from end to end, and what is shown of it."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

from . import graph as G
from . import search
from .chat import TextModel

#: Between blocks of a context.
RULE = "\n---\n"


@dataclass(frozen=True)
class Params:
    n_results: int = 50
    top_k: int = 8
    rrf_k: int = 60
    rerank_n: int = 50
    recency_weight: float = 0.0
    half_life_days: float = 180.0
    hops: int = 1
    per_source: int = 5
    decay: float = 0.5
    now: str = "2024-01-01 00:00:00"
    weighted: bool = True
    digits: int | None = None


def retrieve(
    chunks: DataFrame,
    questions: dict[int, str],
    edges: DataFrame | None = None,
    where: dict[str, Any] | None = None,
    params: Params = Params(),  # noqa: B008
    expand_query: Callable[[str], list[str]] = lambda q: [q],
    scorer: search.Scorer = search.overlap_scorer,
) -> DataFrame:
    """Top chunks of each question: query_id, final_rank, chunk_id, source_id, text, score.

    chunks: chunk_id, source_id, chunk_index, text and, if recency counts, modified_at. All
    sub-queries of all questions run in one plan; their lists are fused, seeds bring in chunks
    of linked sources (the filter doesn't bind those), and a reranker orders the pool.
    """
    spark = chunks.sparkSession
    subs = [(q, s) for q, text in questions.items() for s in dict.fromkeys(expand_query(text))]
    asked = spark.createDataFrame([(i, q, s) for i, (q, s) in enumerate(subs)], "sub_id long, question long, text string")
    pool = search.payload_filter(chunks.withColumn("id", F.col("chunk_id")), where).withColumn("v", search.hash_embed(F.col("text")))
    found = search.hybrid(
        pool.select("id", "text"), pool.select("id", "v"), asked.select(F.col("sub_id").alias("query_id"), "text").withColumn("v", search.hash_embed(F.col("text"))),
        params.n_results, params.n_results, params.rrf_k, params.weighted, params.digits,
    )
    lists = found.withColumnRenamed("query_id", "sub_id").join(F.broadcast(asked), "sub_id").select(F.col("question").alias("query_id"), "id", "rank")  # a row per sub-query
    fused = search.rrf(lists, params.rrf_k)
    top = search.ranked(fused, max(params.n_results, params.top_k))
    seeds = top.withColumnRenamed("id", "chunk_id").join(chunks.select("chunk_id", "source_id"), "chunk_id").select("query_id", "chunk_id", "source_id", "score")
    if edges is not None and params.hops:
        seeds = G.expand(seeds, edges, chunks, params.hops, params.per_source, params.decay)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = seeds.select("query_id", "chunk_id", "score").withColumn("rank", F.row_number().over(w))
    texts = spark.createDataFrame(list(questions.items()), "query_id long, query string")
    full = ranked.join(chunks, "chunk_id").join(F.broadcast(texts), "query_id").withColumn("id", F.col("chunk_id"))  # one row per question

    def scored(query, text):
        base = scorer(query, text)
        if params.recency_weight > 0 and "modified_at" in chunks.columns:
            return search.recency(base, F.col("modified_at"), F.col("modified_at"), params.now, params.recency_weight, params.half_life_days)
        return base

    out = search.rerank(full, scored, F.col("query"), F.col("text"), params.rerank_n, params.top_k)
    return out.select("query_id", "final_rank", "chunk_id", "source_id", "text", T.final_score(F.col("rerank_score"), F.col("score"), F.lit(None).cast("double")).alias("score"))


def context_block(hits: DataFrame) -> DataFrame:
    """query_id and the chunks as labelled blocks, joined by a rule."""
    block = F.concat(F.lit("["), "source_id", F.lit("]\n"), "text")
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", block.alias("b")))).alias("b"))
    return rows.select("query_id", F.array_join(F.transform("b", lambda x: x["b"]), RULE).alias("context"))


def search_kb(chunks: DataFrame, questions: dict[int, str], snippet: int = 240, **how: Any) -> DataFrame:
    """What a model is given for each question: query_id, context and citations (source_id, chunk_id, snippet, score), best first.

    Blocks are headed by title and header path where chunks have them. how: as retrieve takes it.
    A question that nothing was found for has no row.
    """
    given = lambda name, kind: F.col(name) if name in chunks.columns else F.lit(None).cast(kind)
    path = F.coalesce(given("header_path", "array<string>"), F.array().cast("array<string>"))
    heads = chunks.select("chunk_id", T.label(given("title", "string"), F.col("source_id"), path).alias("_head"))
    hits = retrieve(chunks, questions, **how).join(heads, "chunk_id")
    cited = F.struct("source_id", "chunk_id", F.left("text", F.lit(snippet)).alias("snippet"), "score")
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", F.concat("_head", F.lit("\n"), "text").alias("block"), cited.alias("cited")))).alias("h"))  # top_k of a question
    return rows.select("query_id", F.array_join(F.transform("h", lambda x: x["block"]), RULE).alias("context"), F.transform("h", lambda x: x["cited"]).alias("citations"))


def whole_context(memory: str | None, pinned: str | None, found: str | None) -> str:
    """What is remembered, pinned and found, in this order, between rules; empty parts leave none."""
    return RULE.join(part for part in (memory, pinned, found) if part)


def sub_queries(question: str, model: TextModel, most: int = 3) -> list[str]:
    """The parts that a model splits a question into, at most `most`; the question itself if it names none."""
    ask = f'Split this question into one to {most} questions that stand for themselves. Answer with JSON {{"queries": [...]}} only.\n\nQuestion: {question}'
    try:
        named = json.loads(model(ask))["queries"]
    except (ValueError, KeyError, TypeError):
        named = []
    parts = [q.strip() for q in named if isinstance(q, str) and q.strip()] if isinstance(named, list) else []
    return parts[:most] or [question]


def imagined(question: str, model: TextModel) -> str:
    """An answer that a model makes up, to search with; the question itself if that is blank."""
    return model(f"Answer in two to four sentences, as a note on the subject would say it, and with nothing else.\n\nQuestion: {question}").strip() or question


def expander(model: TextModel, split: bool = True, imagine: bool = False) -> Callable[[str], list[str]]:
    """What retrieve's expand_query takes: the question's parts and, if wanted, an imagined answer, each once."""

    def run(question: str) -> list[str]:
        parts = sub_queries(question, model) if split else [question]
        return list(dict.fromkeys([*parts, imagined(question, model)] if imagine else parts))

    return run


def _line(source: str, score: float) -> str:
    return f"{source} [{score:.3f}]"


def cite_only(hits: list[tuple[str, str, float]], width: int = 200) -> str:
    """(source, text, score) as a numbered list of sources with the start of each text, for when no model is asked."""
    if not hits:
        return "Nothing was found."
    shown = (" ".join(text.split())[:width] for _, text, _ in hits)
    return "\n".join(f"{n}. {_line(source, score)}: {start}" for n, ((source, _, score), start) in enumerate(zip(hits, shown, strict=True), 1))


def dry_run(hits: list[tuple[str, str, float]], path: str = "retrieve", iterations: int = 0) -> str:
    """What a model would have been given, without asking it: the way taken and the sources."""
    lines = [f"No model was asked. Way taken: {path}; rounds: {iterations}; passages found: {len(hits)}."]
    return "\n".join(lines + [f"* {_line(source, score)}" for source, _, score in hits])
