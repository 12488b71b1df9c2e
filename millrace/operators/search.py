"""Retrieval: embedding, dense and sparse ranking, fusion, filters, reranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from datetime import date, datetime
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.operators import tiles
from millrace.session import small_batches, written

#: Queries of one pass over the texts or vectors, and their tokens or components; more take more passes.
QUERY_ROWS = 8192
QUERY_TOKENS = 2_000_000
#: Numbers in one matrix of a Python worker.
TILE = 1 << 21
#: Tasks for each core where packs meet packs, and packs that a task holds beside one of queries.
TASKS, PACKS_HELD = 4, 8


class Scorer(Protocol):
    """A relevance model: a column from query and text."""

    def __call__(self, query: Column, text: Column) -> Column: ...


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


#: Rows up to which a side that was counted is broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows at most `most` rows; else df, and the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hash_embed(text: Column, dim: int = 16) -> Column:
    """Bag of words: counts by the md5 of each token modulo 16, at unit length (+1e-12)."""
    if dim != 16:
        raise ValueError("the last hex digit of md5 gives 16 buckets")
    cells = F.transform(tokens(text), lambda t: F.conv(F.right(F.md5(t), F.lit(1)), 16, 10).cast("int"))
    count = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(held, lambda c: c == i)).cast("double"))
    norm = lambda counts: F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    scaled = lambda counts: let(norm(counts), lambda n: F.transform(counts, lambda x: x / n))
    return let(let(cells, count), scaled)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the distinct tokens in one array that another has."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, text)) / F.size(query)).otherwise(0.0)


def overlap_scorer(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has."""
    return token_overlap(F.array_distinct(tokens(query)), tokens(text))


def max_sim(query: Column, text: Column) -> Column:
    """Late interaction of token vectors (array<array<double>>): the sum over the query's of the largest inner product with any of the text's."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    best = F.transform(query, lambda q: F.array_max(F.transform(text, lambda t: dot(q, t))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _kind(value: Any) -> str:
    """The SQL type by which a value of a VARIANT is compared."""
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "timestamp" if isinstance(value, datetime) else "date" if isinstance(value, date) else "string"


def _tests(df: DataFrame, name: str) -> tuple[Callable[[Any], Column], Callable[[Any], Column], Callable[[list], Column]]:
    """For a column, or a key within a VARIANT column (column.key.key): its value to compare with another, whether it is or holds one, and whether any of several."""
    root, _, path = name.partition(".")
    if name not in df.columns and path and root in df.columns and df.schema[root].dataType.typeName() == "variant":
        at = "$" + "".join(f"['{key}']" for key in path.split("."))
        value = lambda want: F.try_variant_get(root, at, _kind(want))
        among = lambda want: F.array_contains(F.try_variant_get(root, at, f"array<{_kind(want)}>"), F.lit(want).cast(_kind(want)))
        holds = lambda want: F.coalesce(value(want) == F.lit(want), F.lit(False)) | F.coalesce(among(want), F.lit(False))
        return value, holds, lambda wants: reduce(lambda a, b: a | b, map(holds, wants), F.lit(False))
    col = F.col(name)
    if df.schema[name].dataType.typeName() == "array":
        return lambda _: col, lambda want: F.array_contains(col, want), lambda wants: F.arrays_overlap(col, F.array(*map(F.lit, wants))) if wants else F.lit(False)
    return lambda _: col, lambda want: col == want, lambda wants: col.isin(wants) if wants else F.lit(False)


def payload_filter(df: DataFrame, where: dict[str, Any] | None) -> DataFrame:
    """Conjunction over columns: a list is any-of, a dict of gte/gt/lte/lt a range, else equality; on arrays these mean contains.

    A dict's ne leaves rows out that hold the value; rows without any value stay. A name
    with dots is a key within a VARIANT column, say frontmatter.status; its values are
    compared as what the wanted value is, and one of another type is no value.
    """
    for name, want in (where or {}).items():
        value, holds, holds_any = _tests(df, name)
        if isinstance(want, list):
            df = df.where(holds_any(want))
        elif isinstance(want, dict):
            for op, bound in want.items():
                if op == "ne":
                    df = df.where(~F.coalesce(holds(bound), F.lit(False)))
                    continue
                col, limit = value(bound), F.lit(bound)
                df = df.where({"gte": col >= limit, "gt": col > limit, "lte": col <= limit, "lt": col < limit}[op])
        else:
            df = df.where(holds(want))
    return df


def best_of(scores: np.ndarray, k: int, above: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores over a bound; ties go to the smaller column."""
    n = scores.shape[1]
    chosen = scores > above
    if n > k:
        chosen &= scores >= np.partition(scores, n - k, axis=1)[:, n - k, None]
    i, j = np.nonzero(chosen)
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    return i[top], j[top]


_ids = tiles.ids_of


def _in_passes(base: DataFrame, asked: DataFrame, scan: Callable[[list], DataFrame], weight: Callable[[Row], int], most: int, schema: str) -> DataFrame:
    """The union of scan(rows) over blocks of asked, each of at most QUERY_ROWS rows and about `most` in weight."""
    passes, held, load = [], [], 0
    for row in asked.toLocalIterator():
        held.append(row)
        load += weight(row)
        if len(held) == QUERY_ROWS or load >= most:
            passes.append(scan(held))
            held, load = [], 0
    if held:
        passes.append(scan(held))
    return reduce(DataFrame.unionByName, passes) if passes else base.sparkSession.createDataFrame([], schema)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids in ascending order and their vectors, of some batches after others."""
    held: list[tuple] = []

    def tile() -> tuple[np.ndarray, np.ndarray]:
        ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
        order = np.argsort(ids, kind="stable")
        return ids[order], x[order]

    for batch in batches:
        if batch.num_rows:
            held.append((_ids(batch.column(0)), np.array(batch.column(1).to_pylist(), np.float64)))
            if sum(x.size for _, x in held) >= TILE // 4:
                yield tile()
                held = []
    if held:
        yield tile()


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """The k vectors of largest inner product for each query: query_id, rank, id, score.

    Ids are numbers or strings. Queries are taken some thousands at a time; each pass
    reads the vectors once, multiplies tiles of bounded size, keeps the k best so far of
    each task, and one window over those ranks them. Ties go to the smaller id. digits: scores are
    rounded before they are ranked.
    """
    spark = small_batches(vectors.sparkSession)
    asked = queries.select(F.col(id_col).alias("q"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull())
    base = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("v").isNotNull())
    kind_asked, kind = asked.schema["q"].dataType.simpleString(), base.schema["id"].dataType.simpleString()
    schema, kinds = f"query_id {kind_asked}, id {kind}, score double", [tiles.id_type(kind_asked), tiles.id_type(kind)]

    def scan(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in block]), np.array([r["v"] for r in block], np.float64)))  # at most QUERY_ROWS queries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qs = shared.value
            best = tiles.Best(qid, k, digits, -math.inf)
            for ids, x in _vectors(batches):
                step = max(1, tiles.CELLS // len(x))
                for at in range(0, len(qs), step):
                    best.offer(at, qs[at : at + step] @ x.T, ids)
                best.settle()
            yield best.rows(kinds)

        return base.mapInArrow(run, schema)

    return ranked(_in_passes(base, asked, scan, lambda r: len(r["v"]), QUERY_TOKENS, schema), k)


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int, weighted: bool = True, digits: int | None = None) -> DataFrame:
    """The k texts that share most with each query: query_id, rank, id, score. docs (id, text), queries (query_id, text).

    The score is the number of distinct tokens that query and text share, or with
    weighted the sum of their idf over docs; texts that share nothing are no hits.
    Queries and texts are taken whole. Both are packed once, and packs meet packs by a
    Cartesian product of partitions; a task keeps the k best so far of the pack of queries
    that it is at, so neither a word that all texts have nor the number of pairs grows what
    is shuffled. Ties go to the smaller id. digits: scores are rounded before they are
    ranked; weighted ones to 9 at most, since sums in another order differ.
    """
    spark = small_batches(docs.sparkSession)
    digits = 9 if weighted and digits is None else digits
    whole = lambda df, name: df.select(name, F.array_distinct(tokens(F.col("text"))).alias("t")).where(F.size("t") > 0)
    kind, kind_asked = (df.schema[name].dataType.simpleString() for df, name in ((docs, "id"), (queries, "query_id")))
    out = f"query_id {kind_asked}, id {kind}, score double"
    shape = f"ids array<{kind}>, words binary, texts binary"
    packs = written(docs.select("id", F.lower("text").alias("t")).where(F.col("t").isNotNull()).mapInArrow(tiles.pack_texts(kind), shape), "lexical-parts")
    few = max(1, packs.select(F.sum(F.greatest(F.size("ids") / tiles.PACK_TEXTS, F.octet_length("texts") / (2 * tiles.PACK_POSTINGS)))).first()[0] or 0)
    packs = written(packs.coalesce(math.ceil(1.25 * few)).mapInArrow(tiles.merge_packs(kind), shape), "lexical-texts")
    asked = written(whole(queries, "query_id"), "lexical-asked")
    n = asked.count()
    if weighted:
        words = asked.select("query_id", F.explode("t").alias("token"))
        seen = packs.select("words").mapInArrow(tiles.word_counts, "token string, n long").join(small_side(words.select("token").distinct()), "token", "left_semi")
        idf = written(with_idf(seen, docs.count()), "lexical-idf")
        asked = words.join(small_side(idf), "token").groupBy("query_id").agg(F.collect_list("token").alias("t"), F.collect_list("idf").alias("w"))  # one query's tokens
    made = asked.repartition(max(1, -(-4 * n // (3 * tiles.PACK_QUERIES)))).mapInArrow(tiles.pack_queries(kind_asked), f"pack long, asked array<{kind_asked}>, vocabulary binary, tokens binary, starts binary")
    left = written(made, "lexical-queries")
    n, m = left.count(), packs.count()
    if not n or not m:
        return ranked(spark.createDataFrame([], out), k)
    tasks = TASKS * spark.sparkContext.defaultParallelism
    lefts = min(n, max(tasks, n // PACKS_HELD))
    rights = max(-(-m // PACKS_HELD), min(m, -(-tasks // lefts)))  # so many packs are held in memory beside one
    pairs = left.repartition(lefts).hint("shuffle_replicate_nl").crossJoin(packs.repartition(rights))
    return ranked(pairs.mapInArrow(tiles.meet(k, digits, [tiles.id_type(kind_asked), tiles.id_type(kind)]), out), k)


def ranked(hits: DataFrame, k: int, score: str = "score", group: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best of each group, ranked from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "rank", tie, score)


def sign_bits(v: Column) -> Column:
    """The signs of a vector's components, packed into longs of 64 bits; the last one is filled up with zeros."""
    bits = F.transform(v, lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
    word = lambda i: F.aggregate(F.slice(bits, i * 64 + 1, 64), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / 64).cast("int") - 1), word)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two packed sign vectors differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def quantised_topk(vectors: DataFrame, queries: DataFrame, k: int, oversampling: float = 2.0, id_col: str = "vec_id", vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """As dense_topk, but over packed sign bits: the nearest by Hamming distance, oversampling times k, are scored exactly.

    Signs take a 64th of the memory of the vectors; only their words are broadcast and compared.
    """
    spark = small_batches(vectors.sparkSession)
    words = vectors.select(F.col(id_col).alias("id"), sign_bits(F.col(vec_col)).alias("b")).where(F.col(vec_col).isNotNull())
    asked = queries.select(F.col(id_col).alias("q"), sign_bits(F.col(vec_col)).alias("b")).where(F.col(vec_col).isNotNull())
    schema = f"query_id {asked.schema['q'].dataType.simpleString()}, id {words.schema['id'].dataType.simpleString()}, score double"
    wide = math.ceil(oversampling * k)

    def scan(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in block]), np.array([r["b"] for r in block], np.int64).view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qs = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = _ids(batch.column(0))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], np.array(batch.column(1).to_pylist(), np.int64)[order].view(np.uint64)
                step = max(1, TILE // len(x))
                for at in range(0, len(qs), step):
                    apart = sum(np.bitwise_count(qs[at : at + step, None, w] ^ x[None, :, w]).astype(np.float64) for w in range(x.shape[1]))
                    i, j = best_of(-apart, wide)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[at + i].tolist()), pa.array(ids[j].tolist()), pa.array(-apart[i, j])], ["query_id", "id", "score"])

        return words.mapInArrow(run, schema)

    near = ranked(_in_passes(words, asked, scan, lambda r: len(r["b"]), QUERY_TOKENS, schema), wide)
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("_q"))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("_v"))
    dot = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    score = dot if digits is None else F.round(dot, digits)
    return ranked(near.select("query_id", "id").join(q, "query_id").join(v, "id").select("query_id", "id", score.alias("score")), k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct tokens of each text: id, token."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))


def with_idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """token and idf = ln((N - n + 0.5) / (n + 0.5) + 1) of rows (token, n), whose n are added up."""
    return counts.groupBy("token").agg(F.sum("n").alias("n")).select("token", F.log((F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5) + 1).alias("idf"))


def rrf(lists: DataFrame, k: int = 60, group: str = "query_id") -> DataFrame:
    """Reciprocal rank fusion of rows (group, id, rank from 1) of any number of lists: the sum of 1 / (k + rank)."""
    return lists.groupBy(group, "id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"))


def recency(score: Column, modified_at: Column, created_at: Column, now: datetime | str, weight: float = 0.0, half_life: float = 180.0) -> Column:
    """score times (1 - w) + w exp(-ln 2 age / half life); no date, w or half life leaves it as it is."""
    if weight <= 0 or half_life <= 0:
        return score
    at = F.coalesce(modified_at, created_at).cast("timestamp")
    seconds = F.lit(now).cast("timestamp").cast("double") - at.cast("double")
    age = F.greatest(seconds / 86400.0, F.lit(0.0))
    return F.when(at.isNull(), score).otherwise(score * ((1 - weight) + weight * F.exp(F.lit(-math.log(2) / half_life) * age)))


def rerank(pool: DataFrame, scorer: Scorer, query: Column, text: Column, top_n: int = 50, top_k: int = 8, group: str = "query_id") -> DataFrame:
    """Score the first top_n by prior rank; they come first by score, the rest after them in their order; cut at top_k."""
    scored = pool.withColumn("in_pool", F.col("rank") <= top_n).withColumn("rerank_score", F.when(F.col("in_pool"), scorer(query, text)))
    w = Window.partitionBy(group).orderBy(F.desc("in_pool"), F.desc_nulls_last("rerank_score"), "rank", "id")
    return scored.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= top_k)


def with_tokens(hits: DataFrame, docs: DataFrame, queries: DataFrame, top_n: int) -> DataFrame:
    """hits (query_id, rank, id) with the distinct tokens of query and text in the first top_n, else null. docs (id, text), queries (query_id, text).

    Only texts that are hits are cut into tokens, each once; they are then copied to
    their queries within one join, not shuffled once for each.
    """
    hits = written(hits, "rerank-pool")
    near = hits.where(F.col("rank") <= top_n)
    cut = lambda df, name, out: df.select(name, F.array_distinct(tokens(F.col("text"))).alias(out))
    texts = cut(docs.join(small_side(near.select("id").distinct()), "id", "left_semi"), "id", "text_tokens")
    asked = cut(queries, "query_id", "query_tokens")
    pairs = near.join(asked, "query_id").join(texts.hint("shuffle_hash"), "id")
    rest = hits.where(F.col("rank") > top_n)
    return pairs.unionByName(rest, allowMissingColumns=True)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, n_results: int = 50, top_k: int = 8, k: int = 60, weighted: bool = False, digits: int | None = None) -> DataFrame:
    """Dense and lexical lists of each query, fused: query_id, rank, id, score.

    docs (id, text), vectors (id, v), queries (query_id, text, v). weighted and digits as in
    lexical_topk; fused scores are rounded to 9 digits.
    """
    dense = dense_topk(vectors, queries.select(F.col("query_id").alias("id"), "v"), n_results, "id", "v", digits).select("query_id", "id", "rank")
    lexical = lexical_topk(docs, queries.select("query_id", "text"), n_results, weighted, digits).select("query_id", "id", "rank")
    fused = rrf(dense.unionByName(lexical), k).withColumn("score", F.round("score", 9))
    return ranked(fused, top_k)


def on_this_day(df: DataFrame, column: str, now: datetime | str) -> DataFrame:
    """Rows whose date has the month and day of now, in an earlier year; the latest year first."""
    at, today = F.col(column).cast("date"), F.lit(now).cast("timestamp").cast("date")
    same = (F.month(at) == F.month(today)) & (F.dayofmonth(at) == F.dayofmonth(today)) & (F.year(at) < F.year(today))
    return df.where(same).orderBy(F.desc(column))


def reranked_texts(
    chunks: DataFrame, queries: DataFrame, n: int = 10, k: int = 5, scorer: Scorer = overlap_scorer, where: dict[str, Any] | None = None, digits: int | None = None
) -> DataFrame:
    """The k best of each query's n nearest chunks by the scorer: query_id, position (from 1), text, score; ties go to the larger text.

    chunks: id, text, v and what `where` filters by; queries: query_id, text, v.
    """
    held = payload_filter(chunks, where)
    near = dense_topk(held, queries.select(F.col("query_id").alias("id"), "v"), n, "id", "v", digits).select("query_id", "id")
    asked = queries.select("query_id", F.col("text").alias("_query"))
    rows = near.join(held.select("id", "text"), "id").join(asked, "query_id").select("query_id", "id", "text", scorer(F.col("_query"), F.col("text")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("text"), "id")  # at most n rows
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("query_id", "position", "text", "score")


def star_graph(vectors: DataFrame, queries: DataFrame, k: int = 10, digits: int | None = None) -> DataFrame:
    """Edges from each query's best vector to the sources around it: query_id, centre, source, node.

    vectors: id, source, v; queries: query_id, v. Of the k nearest vectors of the centre, itself
    counted, those of one source are one node, the nearest; the centre's own source is none.
    """
    first = dense_topk(vectors, queries.select(F.col("query_id").alias("id"), "v"), 1, "id", "v", digits).select("query_id", F.col("id").alias("centre"))
    middle = first.join(vectors.select(F.col("id").alias("centre"), F.col("source").alias("_own"), "v"), "centre")
    around = dense_topk(vectors, middle.select(F.col("query_id").alias("id"), "v"), k, "id", "v", digits).select("query_id", "id", "rank")
    rows = around.join(middle.select("query_id", "centre", "_own"), "query_id").join(vectors.select("id", "source"), "id")
    rows = rows.where((F.col("id") != F.col("centre")) & ~F.col("source").eqNullSafe(F.col("_own")))
    return rows.groupBy("query_id", "centre", "source").agg(F.min_by("id", "rank").alias("node"))
