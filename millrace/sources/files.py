"""File sources as documents: notes, plain text, EPUB, PDF, HTML pages, images."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.udf import arrow_udf
from millrace.sources.pages import main_content

# Folders of a vault that are passed over.
SKIP_DIRS = (".obsidian", ".trash", "templates", ".smart-env")
#: Folders whose images come before others of the same name.
ATTACHMENTS = ("attachments",)
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg")
_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)(?:\r?\n)?^---[ \t]*\r?\n?(.*)\Z", re.S | re.M)


def front_matter(raw: str) -> tuple[dict, str]:
    """YAML header and body; with a bad header, nothing and the whole text."""
    m = _FRONT.match(raw)
    if not m:
        return {}, raw
    try:
        head = yaml.safe_load(m[1])
    except yaml.YAMLError:
        return {}, raw
    if head is None:
        head = {}
    return (head, m[2]) if isinstance(head, dict) else ({}, raw)


def _strings(value: object) -> list[str]:
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


@arrow_udf("string")
def _values(raw: pd.Series) -> pd.Series:
    return raw.map(lambda text: json.dumps({str(k): v for k, v in front_matter(text)[0].items()}, default=str, ensure_ascii=False), na_action="ignore")


def front_values(raw: Column) -> Column:
    """All values of a note's YAML header as a VARIANT, dates as text; an empty object without a header, null for null.

    search.payload_filter compares keys within it: {"frontmatter.due": {"lt": "2024-06-01"}}.
    """
    return F.try_parse_json(_values(raw))


@arrow_udf("struct<title: string, tags: array<string>, aliases: array<string>, keys: array<string>, body: string>")
def _parse(raw: pd.Series) -> pd.DataFrame:
    rows = []
    for text in raw.fillna(""):
        head, body = front_matter(text)
        title = head.get("title")
        tags = [t.lstrip("#") for t in _strings(head.get("tags"))]
        rows.append((title if isinstance(title, str) else None, tags, _strings(head.get("aliases")), sorted(map(str, head)), body))
    return pd.DataFrame(rows, columns=["title", "tags", "aliases", "keys", "body"])


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def _relative(root: str) -> Column:
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/") + "/"
    return F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + re.escape(base), "")


@arrow_udf("string")
def _unquote(s: pd.Series) -> pd.Series:
    return s.map(unquote)


def _text() -> Column:
    """The file's bytes as text; bytes that are no UTF-8 become U+FFFD."""
    return F.make_valid_utf8(F.col("content").cast("string"))


def link_index(notes: DataFrame) -> DataFrame:
    """stem_key and the first note, by path, that has it: rel and body. notes: rel, stem_key, body."""
    first = notes.groupBy("stem_key").agg(F.min_by(F.struct("rel", "body"), "rel").alias("b"))
    return first.select("stem_key", "b.rel", "b.body")


def expand_embeds(notes: DataFrame, depth: int = 3) -> DataFrame:
    """notes (source_id, rel, stem_key, body) with ![[x]] replaced by x's body, level by level.

    A note that embeds itself on the way, or what can't be found, stays as written.
    Each level is one join on the embedded titles.
    """
    bodies = link_index(notes).withColumnsRenamed({"rel": "_rel", "body": "_body"})
    refs = notes.select("source_id", "rel", "body", F.array("rel").alias("seen"))

    def level(body: str, seen: frozenset, table: dict, left: int) -> str:
        def put(m: re.Match) -> str:
            key = T.fold(re.split(r"[#|]", m[1])[0])
            hit = table.get(key)
            if hit is None or hit[0] in seen or left <= 0:
                return m[0]
            inner = level(hit[1], seen | {hit[0]}, table, left - 1)
            return f"\n\n<!-- embed: {hit[0]} -->\n{inner}\n<!-- /embed -->\n\n"

        return re.sub(r"!\[\[([^\]\n]+?)\]\]", put, body)

    # The notes that a note reaches by embeds, within depth: one join per level, then one row per note with their bodies.
    keys = F.array_distinct(F.regexp_extract_all("body", F.lit(r"!\[\[([^\]\n#|]+)"), F.lit(1)))
    front = refs.select("source_id", F.explode(keys).alias("k")).select("source_id", T.norm_key(F.col("k")).alias("stem_key")).distinct()
    reach = front
    for _ in range(depth - 1):
        front = front.join(bodies, "stem_key").select("source_id", F.explode(F.array_distinct(F.regexp_extract_all("_body", F.lit(r"!\[\[([^\]\n#|]+)"), F.lit(1)))).alias("k"))
        front = front.select("source_id", T.norm_key(F.col("k")).alias("stem_key")).distinct()
        reach = reach.unionByName(front)
    held = reach.distinct().join(bodies, "stem_key").groupBy("source_id").agg(F.collect_list(F.struct("stem_key", "_rel", "_body")).alias("t"))

    @F.pandas_udf("string")
    def put_in(rel: pd.Series, body: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([level(b, frozenset({r}), {x["stem_key"]: (x["_rel"], x["_body"]) for x in (rows if rows is not None else [])}, depth) for r, b, rows in zip(rel, body, t, strict=True)])

    joined = refs.join(held, "source_id", "left")
    return joined.select("source_id", F.when(F.col("t").isNull(), F.col("body")).otherwise(put_in("rel", "body", "t")).alias("expanded"))


def read_vault(spark: SparkSession, path: str, skip: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    """Markdown notes of a folder as documents, embeds expanded: source_id, rel, title, content, tags, wikilinks, aliases, content_hash, modified_at."""
    files = _binary(spark, path, "*.md").select(_unquote(_relative(path)).alias("rel"), "modificationTime", _text().alias("raw"))
    files = files.where(~F.exists(F.split(F.lower("rel"), "/"), lambda p: p.isin([s.casefold() for s in skip])))
    stem = F.regexp_extract("rel", r"([^/]+)\.md$", 1)
    notes = files.select("rel", "modificationTime", stem.alias("stem"), _parse("raw").alias("p")).select(
        F.concat(F.lit("obsidian:"), "rel").alias("source_id"), "rel", F.col("modificationTime").alias("modified_at"), "stem",
        T.norm_key(F.col("stem")).alias("stem_key"), F.coalesce("p.title", "stem").alias("title"), "p.tags", "p.aliases", F.col("p.keys").alias("frontmatter_keys"), "p.body",
    )
    expanded = expand_embeds(notes)
    return notes.join(expanded, "source_id").select(
        "source_id", "rel", F.lit("obsidian").alias("source_type"), "title", F.col("expanded").alias("content"),
        T.merge_tags(F.col("tags"), T.inline_tags(F.col("expanded"))).alias("tags"), T.wikilinks(F.col("body")).alias("wikilinks"), "aliases",
        "frontmatter_keys", T.content_hash(F.col("expanded")).alias("content_hash"), "modified_at",
    )


def read_txt(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return _binary(spark, path, "*.txt").select(
        F.concat(F.lit("txt:"), _unquote(name)).alias("source_id"), F.lit("txt").alias("source_type"), F.regexp_replace(_unquote(name), r"\.txt$", "").alias("title"),
        _text().alias("content"),
    )


class _Page(HTMLParser):
    """Text of a page without scripts, styles, navigation and the like; blocks end lines, table rows are lines of cells between bars."""

    SKIP = frozenset(("script", "style", "nav", "header", "footer", "aside", "noscript", "form", "template", "svg"))
    BLOCK = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "pre", "blockquote", "title"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip.append(tag)
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skip:
            while self.skip and self.skip.pop() != tag:
                pass
        elif tag in self.BLOCK:
            self.out.append(" |\n" if tag == "tr" else "\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def page_text(page: str | None) -> str:
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


@arrow_udf("string")
def extract_page(pages: pd.Series) -> pd.Series:
    return pages.map(main_content)


@arrow_udf("string")
def extract_closed(pages: pd.Series) -> pd.Series:
    return pages.map(lambda page: main_content(page, unclosed=False))


def pages_as_documents(pages: DataFrame, unclosed: bool = True) -> DataFrame:
    """Fetched pages (url, html) as documents: their main content as markdown; unclosed as in main_content."""
    extract = extract_page if unclosed else extract_closed
    return pages.select(
        F.concat(F.lit("web:"), "url").alias("source_id"), F.lit("web").alias("source_type"), T.page_title(F.col("html"), F.col("url")).alias("title"),
        T.page_slug(F.col("url")).alias("slug"), extract("html").alias("content"),
    )


def tolerant(read: Callable[[bytes], str]) -> Callable[[bytes], str | None]:
    """read, with None for a damaged file; a missing library still raises."""

    def run(data: bytes) -> str | None:
        try:
            return read(data)
        except ImportError:
            raise
        except Exception:  # readers of broken files raise errors of any kind
            return None

    return run


def epub_documents(z: zipfile.ZipFile) -> list[str]:
    """Names of a book's documents in the order of its manifest; in that of the archive if it has none."""
    try:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(x.attrib["full-path"] for x in root.iter() if x.tag.endswith("}rootfile"))
        items = [x.attrib for x in ElementTree.fromstring(z.read(package)).iter() if x.tag.endswith("}item")]
    except (KeyError, StopIteration, ElementTree.ParseError):
        return [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
    at = posixpath.dirname(package)
    named = [posixpath.normpath(posixpath.join(at, unquote(x["href"]))) for x in items if x.get("media-type") == "application/xhtml+xml" and x.get("href")]
    return [n for n in named if n in set(z.namelist())]


def epub_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = [page_text(z.read(name).decode("utf-8", "replace")) for name in epub_documents(z)]
    return "\n\n".join(x for x in out if x)


@arrow_udf("string")
def _epub(data: pd.Series) -> pd.Series:
    return data.map(tolerant(epub_text))


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    name = _unquote(F.regexp_extract("path", r"([^/]+)$", 1))
    return _binary(spark, path, "*.epub").select(
        F.concat(F.lit("epub:"), name).alias("source_id"), F.lit("epub").alias("source_type"), F.regexp_replace(name, r"\.epub$", "").alias("title"), _epub("content").alias("content")
    )


def pdf_text(data: bytes) -> str:
    """Page texts; needs the optional library pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF needs pypdf") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


@arrow_udf("string")
def _pdf(data: pd.Series) -> pd.Series:
    return data.map(tolerant(pdf_text))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    name = _unquote(F.regexp_extract("path", r"([^/]+)$", 1))
    return _binary(spark, path, "*.pdf").select(
        F.concat(F.lit("pdf:"), name).alias("source_id"), F.lit("pdf").alias("source_type"), F.regexp_replace(name, r"\.pdf$", "").alias("title"),
        _pdf("content").alias("content"), F.col("length").alias("size"),
    )


def read_images(spark: SparkSession, path: str, attachments: tuple[str, ...] = ATTACHMENTS) -> DataFrame:
    """Image files: rel, name_key and place (0 in a folder of attachments, else 1); only names are read."""
    files = _binary(spark, path, "*").select(_unquote(_relative(path)).alias("rel"))
    files = files.where(F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*IMAGES))
    beside = F.exists(F.split(F.lower(F.regexp_replace("rel", r"[^/]*$", "")), "/"), lambda p: p.isin([a.casefold() for a in attachments]))
    return files.select("rel", T.norm_key(F.regexp_extract("rel", r"([^/]+)$", 1)).alias("name_key"), F.when(beside, 0).otherwise(1).alias("place"))


def transcripts_as_documents(lines: DataFrame) -> DataFrame:
    """Video transcript lines (video_id, title, pos, line) as documents of type web."""
    rows = lines.groupBy("video_id", "title").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select(
        F.concat(F.lit("youtube:"), "video_id").alias("source_id"), F.lit("web").alias("source_type"), "title",
        F.concat(F.lit("# "), "title", F.lit("\n\n## Transcript\n\n"), body, F.lit("\n")).alias("content"),
    )



#: Readers by extension.
READERS = {".pdf": read_pdf, ".epub": read_epub, ".txt": read_txt, ".md": read_vault}
DOCUMENT = ("source_id", "source_type", "title", "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder, or of one file, by extension: source_id, source_type, title, content.

    A folder's files of other extensions and damaged files are passed over. A lone file of
    another extension is a ValueError, a missing path a FileNotFoundError.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        kind = re.search(r"\.[^./]*$|$", path)[0].lower()
        if kind not in READERS:
            raise ValueError(f"unsupported extension: {kind}")
        if kind == ".md":  # a folder of one note
            root = path.rsplit("/", 1)[0]
            return read_vault(spark, root).where(F.col("rel") == path.rsplit("/", 1)[1]).select(*DOCUMENT)
        return READERS[kind](spark, path).select(*DOCUMENT)
    return reduce(DataFrame.unionByName, (read(spark, path).select(*DOCUMENT) for read in READERS.values())).where(F.col("content").isNotNull())
