"""Splitting documents into chunks by headers and by size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T

# Sizes in characters and separators, coarse to fine.
CHUNK_SIZE, OVERLAP = 1200, 200
#: Characters from which a document is worth late vectors.
LATE_CHARS = 4000
SEPARATORS = ("\n\n", "\n", "```", ". ", "? ", "! ", " ", "")
PLAIN_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_HEADER = re.compile(r"^(#{1,4})\s+(.*)$")
_ANY = re.compile(r"^\s*#{1,6}\s+", re.M)


def split_headers(text: str) -> list[tuple[str, list[str]]]:
    """Sections with the headers above them; header lines stay, fenced code has none."""
    if not _ANY.search(text):
        return [(text, [])]
    out: list[tuple[str, list[str]]] = []
    path: dict[int, str] = {}
    lines: list[str] = []
    fenced = False

    def flush() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append((body, [path[k] for k in sorted(path)]))
        lines.clear()

    for line in text.split("\n"):
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else _HEADER.match(line.strip())
        if m:
            flush()
            level = len(m[1])
            path = {k: v for k, v in path.items() if k < level} | {level: m[2].strip()}
        lines.append(line)
    flush()
    return out


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size: cut at the coarsest separator there is, finer where a part is too long, then merged with an overlap."""
    rest = 0
    while separators[rest] and separators[rest] not in text:
        rest += 1
    sep = separators[rest]
    parts = re.split(f"(?={re.escape(sep)})", text) if sep else list(text)
    out: list[str] = []
    held: list[str] = []
    length = 0

    def close() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in filter(None, parts):
        if len(part) > size:
            if held:
                close()
                held, length = [], 0
            out += split_recursive(part, size, overlap, separators[rest + 1 :]) if sep else [part]
            continue
        if length + len(part) > size and held:
            close()
            while held and (length > overlap or length + len(part) > size):
                length -= len(held.pop(0))
        held.append(part)
        length += len(part)
    if held:
        close()
    return out


def chunk_text(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[str, list[str]]]:
    """Sections that fit stay whole; longer ones are split; blank pieces drop out."""
    out = []
    for section, path in split_headers(text):
        for piece in [section] if len(section) <= size else split_recursive(section, size, overlap):
            if piece.strip():
                out.append((piece.strip(), path))
    return out


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents (source_id, content, …): all other columns, chunk_index, text, header_path and chunk_id."""

    @F.pandas_udf("array<struct<text: string, header_path: array<string>>>")
    def split(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda t: [{"text": a, "header_path": b} for a, b in chunk_text(t or "", size, overlap)])

    rest = [c for c in docs.columns if c not in ("content", "text", "chunk_index", "header_path", "chunk_id")]
    rows = docs.select(*rest, F.posexplode(split("content")).alias("chunk_index", "c"))
    return rows.select(*rest, "chunk_index", "c.text", "c.header_path", T.chunk_id(F.col("source_id"), F.col("chunk_index"), F.col("c.text")).alias("chunk_id"))


def plain_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = PLAIN_SEPARATORS) -> DataFrame:
    """Documents (name, content) split by size alone, whatever their headers: id (`name_number`), source (the name), text.

    Null and blank documents give no rows.
    """

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap, separators) if t and t.strip() else [])

    rows = docs.select(F.col("name").alias("source"), F.posexplode(split("content")).alias("number", "text"))
    return rows.select(F.concat_ws("_", "source", F.col("number").cast("string")).alias("id"), "source", "text")


def header_sections(notes: DataFrame, id_col: str = "source_id", body: str = "body") -> DataFrame:
    """Header sections from built-ins alone: id, section, header_path, text. No fenced code; levels 1 to 4."""
    lines = notes.select(F.col(id_col).alias("source_id"), F.posexplode(F.split(F.col(body), "\n")).alias("line", "text"))
    level = F.length(F.regexp_extract("text", r"^(#{1,4})\s+\S", 1))
    w = Window.partitionBy("source_id").orderBy("line")
    rows = lines.withColumn("level", level).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))

    def current(n: int) -> Column:
        own = F.when(F.col("level") == n, F.regexp_replace("text", r"^#{1,4}\s+|\s+$", "")).when(F.col("level").between(1, n - 1), "")
        return F.nullif(F.last(own, ignorenulls=True).over(w), F.lit(""))

    for n in range(1, 5):
        rows = rows.withColumn(f"h{n}", current(n))
    body_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    out = rows.groupBy("source_id", "section").agg(
        F.regexp_replace(body_, r"^\s+|\s+$", "").alias("text"), *[F.max(f"h{n}").alias(f"h{n}") for n in range(1, 5)]
    )
    path = F.concat_ws(" > ", *[f"h{n}" for n in range(1, 5)])
    return out.where("text <> ''").select("source_id", "section", path.alias("header_path"), "text")


def late_vectors(tokens: DataFrame, spans: DataFrame, id_col: str = "source_id") -> DataFrame:
    """One vector for each chunk from token vectors of its whole document: id, chunk_index, embedding (unit length, +1e-12).

    tokens: id, n_chars, tokens (array<array<double>>); spans: id, chunk_index, char_start,
    char_end. A chunk takes its proportional share of the tokens, one at least, and their
    mean; beyond the last token it is all zero.
    """
    share = lambda at: F.floor(F.col(at) / F.greatest("n_chars", F.lit(1)) * F.size("tokens")).cast("int")
    low = share("char_start")
    part = F.slice("tokens", low + 1, F.greatest(low + 1, share("char_end")) - low)
    width = F.size(F.get("tokens", F.lit(0)))
    total = F.aggregate(part, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    mean = lambda p: F.transform(p["total"], lambda x: x / F.greatest(p["n"], F.lit(1)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    unit = lambda v: T.let(norm(v), lambda n: F.transform(v, lambda x: x / n))
    rows = spans.join(tokens, id_col).select(id_col, "chunk_index", F.struct(total.alias("total"), F.size(part).alias("n")).alias("p"))
    return rows.select(id_col, "chunk_index", T.let(mean(F.col("p")), unit).alias("embedding"))


def late_embed(docs: DataFrame, chunks: DataFrame, encode: Callable[[Column], Column], at_least: int = LATE_CHARS) -> DataFrame:
    """Vectors of chunks from their whole documents' token vectors, as late_vectors: source_id, chunk_index, embedding.

    docs: source_id, content; chunks: source_id, chunk_index, text. encode gives a text's token
    vectors (array<array<double>>). Documents of under at_least characters have no rows:
    a chunk of them is hardly less than the whole.
    """

    @F.pandas_udf("array<struct<char_start: int, char_end: int>>")
    def spans(content: pd.Series, texts: pd.Series) -> pd.Series:
        both = zip(content, texts, strict=True)
        return pd.Series([[{"char_start": a, "char_end": b} for a, b in segment_offsets(c, list(t))] for c, t in both])

    long = docs.where(F.length("content") >= at_least).select("source_id", "content")
    parts = chunks.join(long.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("c"))  # one document's chunks
    held = parts.join(long, "source_id").withColumn("at", spans("content", F.transform("c", lambda x: x["text"])))
    pairs = held.select("source_id", F.inline(F.arrays_zip(F.transform("c", lambda x: x["chunk_index"]).alias("chunk_index"), F.col("at").alias("at"))))
    places = pairs.select("source_id", "chunk_index", "at.char_start", "at.char_end")
    return late_vectors(long.select("source_id", F.length("content").alias("n_chars"), encode(F.col("content")).alias("tokens")), places)


def segment_offsets(text: str, chunks: list[str]) -> list[tuple[int, int]]:
    """Where chunks lie in text, by their first 64 characters; equal spans if any is not found."""
    out, at = [], 0
    for c in chunks:
        i = text.find(c[:64], at)
        if i < 0:
            step = max(1, len(text) // max(1, len(chunks)))
            return [(j * step, min(len(text), (j + 1) * step)) for j in range(len(chunks))]
        out.append((i, i + len(c)))
        at = i + 1
    return out
