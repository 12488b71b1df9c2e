"""Conversation, summary, evaluation and schedule operators."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

from .ranking import position_in_group


class TextModel(Protocol):
    """A language model, as a function of prompts."""

    def __call__(self, prompt: str) -> str: ...


def template_model(prompt: str) -> str:
    """The default model: the prompt's first 200 characters, so that pipelines run offline and repeat."""
    return prompt.strip()[:200]


def history_window(messages: DataFrame, n: int = 8, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy(session).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def with_summary(window: DataFrame, summaries: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """A window of messages with one of role system before each session's first, if summaries (session, text) has a text for it."""
    first = window.groupBy(session).agg((F.min(order) - 1).alias(order))
    head = first.join(summaries.where(F.trim("text") != "").groupBy(session).agg(F.max("text").alias("text")), session)
    return window.select(session, order, "role", "text").unionByName(head.select(session, F.col(order).cast(window.schema[order].dataType), F.lit("system").alias("role"), "text"))


def memory_block(hits: DataFrame) -> DataFrame:
    """query_id and what was remembered, as text, best first. hits: query_id, rank, ts (text that starts with a day), score, question, answer."""
    head = F.concat(F.lit("[memory · "), F.substring("ts", 1, 10), F.format_string(" · score %.2f]\n", F.col("score")))
    rows = hits.select("query_id", F.struct("rank", F.concat(head, F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("block")).alias("b"))
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("b")).select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n---\n").alias("block"))  # a query's few hits


def transcripts(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per session: turns and the messages as text, in order."""
    line = F.concat(F.lit("**"), "role", F.lit("**: "), "text")
    rows = messages.groupBy(session).agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("m"))
    return rows.select(session, "turns", F.array_join(F.transform("m", lambda x: x["line"]), "\n\n").alias("body"))


def memory_pairs(messages: DataFrame, at_least: int = 16) -> DataFrame:
    """Question and answer of adjacent turns (user, then assistant), as `Q: …\\nA: …`; short answers are not remembered."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("answer"))
    rows = rows.where((F.col("role") == "user") & (F.col("r2") == "assistant") & (F.length("answer") >= at_least))
    return rows.select("conv_id", "turn", F.concat(F.lit("Q: "), "text", F.lit("\nA: "), "answer").alias("memory"))


def partition_round_robin(rows: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """Deal each group's rows to n sets in turn: set = (position - 1) mod n."""
    placed = position_in_group(rows, group, order, "_position")
    return placed.withColumn("set", (F.col("_position") % n).cast("int")).drop("_position")


def round_robin(items: list, n: int) -> list[list]:
    return [items[i::n] for i in range(n) if items[i::n]]


def route_from_critic(verdict: str, iterations: int, most: int = 1) -> str:
    """finalize if good or out of revisions, else retrieve_again."""
    return "finalize" if verdict == "good" or iterations > most else "retrieve_again"


def excerpt_budget(chunks: DataFrame, group: str, most: int = 12000, snippet: int = 600) -> DataFrame:
    """Blocks `[title] snippet` in pos order as long as they fit into most characters: group, blocks, excerpt.

    chunks: group, pos, title, text. The first block that would overflow ends the excerpt.
    """
    flat = F.left(F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), "\n", " "), F.lit(snippet))
    rows = chunks.select(group, "pos", F.concat(F.lit("["), "title", F.lit("] "), flat).alias("block"))
    # A block has at least 3 characters: no more than most / 3 can fit, and those are all that a task holds of a group.
    by_pos = Window.partitionBy(group).orderBy("pos")
    rows = rows.withColumn("_n", F.row_number().over(by_pos)).where(F.col("_n") <= most // 3)
    w = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fit = rows.withColumn("used", F.sum(F.length("block")).over(w)).where(F.col("used") <= most)
    out = fit.groupBy(group).agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("b"))
    return out.select(group, "blocks", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("excerpt"))


def summarise(chunks: DataFrame, group: str, model: TextModel = template_model, per_group: int = 200) -> DataFrame:
    """Map-reduce: a note for each chunk (group, pos, title, text), then one summary of each group's notes; at most per_group chunks."""
    w = Window.partitionBy(group).orderBy("pos")
    first = chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_group)
    note = F.pandas_udf(lambda s: s.map(model), "string")
    noted = first.select(group, "pos", note(F.concat(T.label(F.col("title"), F.col("title"), F.array().cast("array<string>")), F.lit("\n"), "text")).alias("note"))
    joined = noted.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "note"))).alias("n"))
    text = F.array_join(F.transform("n", lambda x: x["note"]), "\n\n")
    return joined.select(group, F.size("n").alias("chunks"), note(text).alias("summary"))


def summarise_where(chunks: DataFrame, source_id: str | None = None, tag: str | None = None, source_type: str | None = None, model: TextModel = template_model, per_group: int = 200) -> DataFrame:
    """One summary of what is asked for: the chunks of a source, of those with a tag, or of a type; all if nothing is named.

    chunks: source_id, chunk_index, title, text, tags, source_type. Returns topic, chunks and summary; no rows where nothing fits.
    """
    for name, value in (("source_id", source_id), ("source_type", source_type)):
        if value is not None:
            chunks = chunks.where(F.col(name) == value)
    if tag is not None:
        chunks = chunks.where(F.array_contains("tags", tag.lstrip("#")))
    topic = source_id or (f"#{tag.lstrip('#')}" if tag else None) or source_type or "all"
    rows = chunks.select(F.lit(topic).alias("topic"), F.struct("source_id", "chunk_index").alias("pos"), "title", "text")
    return summarise(rows, "topic", model, per_group)


def hit_rate(expected: DataFrame, found: DataFrame, item: str, want: str, have: str) -> DataFrame:
    """Share of each item's expected strings that are part of one of its found ones; 1 where none is expected.

    expected: item, want (array); found: item, have. Joined on the item, so only its own strings meet.
    """
    wants = expected.select(item, F.explode_outer(want).alias("w"))
    each = wants.join(found.select(item, have), item, "left").groupBy(item, "w").agg(F.max(F.coalesce(F.col(have).contains(F.col("w")), F.lit(False)).cast("int")).alias("hit"))
    return each.groupBy(item).agg(F.coalesce(F.avg(F.when(F.col("w").isNotNull(), F.col("hit"))), F.lit(1.0)).alias("rate"))


def is_due(cron: Column, last_run: Column, now: str) -> Column:
    """Never run: due. A day of week: after 6 h; an hour: after 1 h; else after 30 min."""
    parts = F.split(F.trim(cron), r"\s+")
    least = F.when((F.size(parts) >= 5) & ~F.get(parts, F.lit(4)).isin("*", "?"), 6 * 3600).when((F.size(parts) >= 5) & (F.get(parts, F.lit(1)) != "*"), 3600).otherwise(1800)
    at = F.try_to_timestamp(last_run)
    age = F.lit(now).cast("timestamp").cast("long") - at.cast("long")
    return F.coalesce(age >= least, F.lit(True))


class Mentor:
    """Plan state of a mentor session: NEXT and BACK move in the plan, other messages are questions."""

    def __init__(self, plan: list[str], history: int = 6) -> None:
        self.plan, self.at, self.keep, self.history = plan, 0, history, []

    def move(self, intent: str) -> str | None:
        step = {"NEXT": 1, "BACK": -1}.get(intent, 0)
        self.at = int(np.clip(self.at + step, 0, max(len(self.plan) - 1, 0)))
        return self.plan[self.at] if self.plan else None

    def commit(self, message: str, reply: str) -> None:
        self.history = [*self.history, ("user", message), ("assistant", reply)][-self.keep :]
