"""Scalar functions on text columns, all from built-ins."""

from __future__ import annotations

import re

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.udf import arrow_udf

_LINK = r"\[\[([^\]\n]+?)\]\]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row; lambdas inside would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(source_id: Column, index: Column, text: Column, given: Column | None = None) -> Column:
    """source::index::first 16 hex digits of the text's hash, unless a non-empty id is given."""
    made = F.concat_ws("::", source_id, index.cast("string"), F.substring(F.sha2(text, 256), 1, 16))
    return F.coalesce(_blank_to_null(given), made) if given is not None else made


def embed_text(context: Column, text: Column) -> Column:
    return F.coalesce(_blank_to_null(context), text)


def final_score(rerank: Column, rrf: Column, dense: Column) -> Column:
    """The first score that is neither null nor 0, else 0."""
    zero = F.lit(0.0)
    return F.coalesce(F.nullif(rerank, zero), F.nullif(rrf, zero), F.nullif(dense, zero), zero)


def normalise(text: Column) -> Column:
    """White space collapsed, ends stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def norm_hash(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def shingles(text: Column, k: int = 7) -> Column:
    """Distinct k-word windows of the normalised text; one of all words if there are fewer."""

    def windows(words: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
        return F.transform(at, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.array_distinct(let(F.split(normalise(text), " "), windows))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of the normalised text, in order."""
    return F.transform(F.split(normalise(text), " "), lambda w: F.xxhash64(w))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def split_link(raw: Column) -> Column:
    """target#head|alias as a struct; empty head or alias is null."""
    left = F.substring_index(raw, "|", 1)
    cut = F.split(raw, r"\|", 2)
    alias = _blank_to_null(_strip(F.get(cut, F.lit(1))))
    side = F.split(left, "#", 2)
    return F.struct(
        _strip(F.get(side, F.lit(0))).alias("target"), _blank_to_null(_strip(F.get(side, F.lit(1)))).alias("head"), alias.alias("alias")
    )


def wikilinks(body: Column) -> Column:
    """Targets of all links, also embedded ones, in order, each once."""
    raw = F.regexp_extract_all(body, F.lit(_LINK), F.lit(1))
    return F.array_distinct(F.filter(F.transform(raw, lambda r: split_link(r)["target"]), lambda t: t != ""))


def inline_tags(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"(?:^|\s)#([A-Za-z0-9_\-/]+)"), F.lit(1)))


def merge_tags(front: Column, inline: Column) -> Column:
    return F.array_sort(F.array_union(front, inline))


def clean_tags(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.regexp_replace(t, "^#+", ""))


def with_tags(tags: Column, text: Column) -> Column:
    """text below a line that names its tags, so that a search for words finds them; as it is without tags."""
    named = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")
    return F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), named, F.lit("\n\n"), text)).otherwise(text)


def strip_mentions(text: Column) -> Column:
    """[[T|A]] becomes A, [[T#H]] and [[T]] become T."""
    aliased = F.regexp_replace(text, r"\[\[[^\]\n|]*\|\s*([^\]\n]*?)\s*\]\]", "$1")
    return F.regexp_replace(aliased, r"\[\[\s*([^\]\n#]*?)\s*(?:#[^\]\n]*)?\]\]", "$1")


def has_headers(text: Column) -> Column:
    return text.rlike(r"(?m)^\s*#{1,6}\s+")


def context_key(source_id: Column, doc_hash: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", source_id, doc_hash, text), 256)


def trim_document(text: Column, most: int = 12000) -> Column:
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("\n\n[...]\n\n"), F.right(text, F.lit(half))))


def format_batch(texts: Column) -> Column:
    block = lambda t, i: F.concat(F.lit('<chunk id="'), i.cast("string"), F.lit('">\n'), t, F.lit("\n</chunk>"))
    return F.array_join(F.transform(texts, block), "\n")


def parse_batch(raw: Column) -> Column:
    """{"contexts": [{id, context}]} as a map from id to context; prose around it, bad rows and blanks are passed over."""
    schema = "struct<contexts: array<struct<id: string, context: string>>>"
    whole, part = F.from_json(raw, schema), F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)
    rows = F.coalesce(whole["contexts"], part["contexts"], F.array().cast("array<struct<id: string, context: string>>"))
    rows = F.filter(
        F.transform(rows, lambda r: F.struct(r["id"].try_cast("int").alias("id"), _strip(r["context"]).alias("context"))),
        lambda r: r["id"].isNotNull() & r["context"].isNotNull() & (r["context"] != ""),
    )
    last = let(rows, lambda all_: F.filter(all_, lambda r, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda s: s["id"] == r["id"])))
    return F.map_from_entries(last)


def parse_slash(line: Column) -> Column:
    """A chat line as a struct of cmd, query, force_path, cite_only, dry_run and show_help; unknown commands are plain text."""
    head = F.lower(F.regexp_extract(_strip(line), r"^/([^ ]*)", 1))
    rest = _strip(F.regexp_extract(_strip(line), r"(?s)^/[^ ]* (.*)$", 1))
    cmd = F.when(
        F.substring(_strip(line), 1, 1) == "/",
        F.when(head.isin("h", "help", "?"), "help").when(head.isin("search", "kb", "vault"), "search").when(head == "web", "web")
        .when(head.isin("cite", "citations"), "cite").when(head.isin("dry-run", "dry_run", "dry"), "dry_run"),
    )
    return F.struct(
        cmd.alias("cmd"),
        F.when(cmd.isNull(), line).when(cmd == "help", "").otherwise(rest).alias("query"),
        F.when(cmd == "web", "web").when(cmd.isin("search", "cite", "dry_run"), "retrieve").alias("force_path"),
        F.coalesce(cmd == "cite", F.lit(False)).alias("cite_only"),
        F.coalesce(cmd == "dry_run", F.lit(False)).alias("dry_run"),
        F.coalesce(cmd == "help", F.lit(False)).alias("show_help"),
    )


# Where a plan lies in a text, its topics, and the words of an intent.
PLAN = r"(?is)LEARNING PLAN:(.*?)(?:\n\n|$)"
TOPIC = r"(?m)^\s*\d+\.\s*(.+)$"
INTENTS = {"NEXT": "next|proceed|continue|move on", "BACK": "back|previous"}


def parse_plan(text: Column) -> Column:
    """Numbered topics under LEARNING PLAN:, up to a blank line."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(text, PLAN, 1), F.lit(TOPIC), F.lit(1)), _strip)


def plan_topics(text: str) -> list[str]:
    """parse_plan of one text on the driver."""
    m = re.search(PLAN, text)
    return [t.strip() for t in re.findall(TOPIC, m[1])] if m else []


def classify_intent(message: Column) -> Column:
    low = F.lower(message)
    return F.when(low.rlike(INTENTS["NEXT"]), "NEXT").when(low.rlike(INTENTS["BACK"]), "BACK").otherwise("QUESTION")


def intent_of(message: str) -> str:
    """classify_intent of one message on the driver."""
    return next((k for k, words in INTENTS.items() if re.search(words, message.lower())), "QUESTION")


def video_id(s: Column) -> Column:
    found = F.regexp_extract(s, r"(?:v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(s.rlike(r"^[A-Za-z0-9_-]{11}$"), s).otherwise(_blank_to_null(found))


def image_refs(body: Column) -> Column:
    """Image paths: of wiki embeds first, then of markdown images."""
    kinds = r"\.(?:png|jpe?g|gif|webp|bmp|svg)"
    wiki = F.regexp_extract_all(body, F.lit(rf"(?i)!\[\[([^\]\n]+{kinds})(?:\|[^\]]+)?\]\]"), F.lit(1))
    plain = F.regexp_extract_all(body, F.lit(rf'(?i)!\[[^\]]*\]\(([^)\n]+{kinds})(?:\s+"[^"]*")?\)'), F.lit(1))
    return F.concat(wiki, plain)


def page_title(html: Column, url: Column) -> Column:
    return F.coalesce(_blank_to_null(F.regexp_extract(html, r"(?i)<title>([^<]+)</title>", 1)), url)


def page_slug(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 10)


def label(title: Column, source_id: Column, path: Column) -> Column:
    """[title :: H1 > H2]; the title falls back to the source's id."""
    name = F.coalesce(_blank_to_null(title), source_id)
    return F.when(F.size(path) > 0, F.concat(F.lit("["), name, F.lit(" :: "), F.array_join(path, " > "), F.lit("]"))).otherwise(
        F.concat(F.lit("["), name, F.lit("]"))
    )


def safe_filename(name: Column) -> Column:
    kept = F.regexp_replace(name, r"[^\p{L}\p{N} \-_]", "-")
    return F.coalesce(_blank_to_null(F.regexp_replace(F.trim(kept), " ", "-")), F.lit("session"))


def snippet_slug(text: Column, most: int = 60) -> Column:
    return F.left(F.regexp_replace(text, "[^A-Za-z0-9-_]+", "-"), F.lit(most))


def fold(s: str | None) -> str | None:
    return None if s is None else unicodedata.normalize("NFC", s.strip()).casefold()


@arrow_udf("string")
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def norm_key(c: Column) -> Column:
    """Canonical form for comparing titles. Built-ins have no case folding, so only texts beyond ASCII go through Python."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, F.lower(F.trim(c))).otherwise(_fold(c))
