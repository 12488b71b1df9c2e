"""A stored inverted index: postings in segments, pruned top-k, upserts, deletes, merges.

Texts are dealt into tiles of bounded size, and a token's postings in a tile are one
block: packed document numbers, packed weights where they aren't all one, the number of
documents and the largest weight. Blocks are written in buckets of tokens, sorted by
token, so a search reads the buckets and row groups of its own tokens. Document
frequencies are additive rows (a segment adds, a superseded text takes away), so nothing
is recounted. A commit names the segments; old ones are merged when there are many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from millrace.operators import search, tiles
from millrace.operators.versions import CommitLog
from millrace.session import fresh_path, small_batches, until_exit, written

#: Documents and postings of one tile; a tile ends with the Arrow batch that reaches either.
TILE_DOCS, TILE_POSTINGS = 1 << 14, 1 << 22
#: Buckets of tokens.
BUCKETS = 32
#: Segments after which an upsert merges them.
MERGE_AT = 8
#: One tile in so many is scored in full first; that gives each query a bound on its k-th score.
SEED_EVERY = 8
#: Tokens up to which a search names the buckets and tokens that it reads.
FEW_TOKENS = 1000
#: Tokens that together add less than this share of a query's bound are left for the candidates.
SLACK = 0.5


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


@dataclass
class Tally:
    """Blocks that a search read, and those of the index; filled when `count` is set."""

    read: int = 0
    of: int = 0
    count: bool = True


@dataclass
class InvertedIndex:
    """An index at a path. One writer at a time; of two that race one gets versions.Conflict.

    Tables under the path, by segment folder: blocks (bucket, token, tile, n, top, docs,
    weights), tiles (tile, ids), words (token, change of document frequency, largest
    weight) and gone (tile, local: documents of earlier segments that this one replaces
    or deletes).
    """

    spark: SparkSession
    path: str
    id_type: DataType
    log: CommitLog = field(init=False)

    def __post_init__(self) -> None:
        self.log = CommitLog(self.spark, self.path)
        kind = self.id_type.simpleString()
        self._blocks = "bucket int, token string, tile long, n int, top float, docs binary, weights binary"
        self._tiles = f"tile long, ids array<{kind}>"
        self._words = "token string, docs long, top float"
        self._gone = "tile long, local int"

    @classmethod
    def open(cls, spark: SparkSession, id_type: DataType, path: str | None = None) -> InvertedIndex:
        """The index at a path; without one a new index in the shared folder until the driver ends."""
        if path is None:
            path = fresh_path(spark, "inverted")
            until_exit(spark, path)
        return cls(spark, path, id_type)

    # Tables of the current commit

    def _read(self, kind: str, schema: str) -> DataFrame:
        _, now = self.log.latest()
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{kind}") for s in now.get("folders", ()) if kind in now["tables"][s]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)  # at most MERGE_AT

    def blocks(self) -> DataFrame:
        return self._read("blocks", self._blocks)

    def gone(self) -> DataFrame:
        return self._read("gone", self._gone)

    def live(self) -> DataFrame:
        """tile, local and id of every document that is there."""
        every = self._read("tiles", self._tiles).select("tile", F.posexplode("ids").alias("local", "id"))
        return every.join(self.gone(), ["tile", "local"], "left_anti")

    def size(self) -> int:
        return self.log.latest()[1].get("docs", 0)

    def frequencies(self) -> DataFrame:
        """token, the number of documents that hold it, and a bound of its weight in them."""
        return self._read("words", self._words).groupBy("token").agg(F.sum("docs").alias("docs"), F.max("top").alias("top")).where("docs > 0")

    # Writing

    def upsert(self, docs: DataFrame) -> int:
        """Put documents (id, text, or id, tokens and weights as arrays) in place of those of the same id; their number.

        Null or tokenless texts are held as documents without postings; rows with a null
        id are left out. Of rows that repeat an id one stays (the greatest text). Repeated
        tokens of given arrays count once, with their greatest weight.
        """
        return self._commit(docs, None)

    def delete(self, ids: DataFrame) -> int:
        """Remove documents by id; the number that were there."""
        return self._commit(None, ids)

    def merge(self) -> None:
        """Rewrite all live documents as one segment. Blocks are rewritten as they are, without the texts."""
        self._rewrite()

    def _tokens(self, docs: DataFrame) -> DataFrame:
        """id, tokens (distinct) and weights (null: all one), one row an id, staged."""
        rows = docs.where(F.col("id").isNotNull())
        if "tokens" in docs.columns:
            pairs = F.arrays_zip(F.col("tokens").alias("t"), F.col("weights").cast("array<float>").alias("w"))
            kept = F.filter(pairs, lambda p: p["t"].isNotNull() & (p["w"] > 0))
            rows = rows.select("id", F.sort_array(kept, asc=False).alias("p"))  # the greatest weight of a token first
            once = F.map_from_entries(F.aggregate("p", F.array().cast(rows.schema["p"].dataType), lambda a, p: F.when(F.exists(a, lambda x: x["t"] == p["t"]), a).otherwise(F.array_append(a, p))))
            rows = rows.select("id", F.map_keys(once).alias("tokens"), F.map_values(once).alias("weights"))
            order = F.struct("tokens", "weights")
        else:
            rows = rows.select("id", F.coalesce(F.array_distinct(search.tokens(F.col("text"))), F.array().cast("array<string>")).alias("tokens"), F.lit(None).cast("array<float>").alias("weights"))
            order = F.struct("tokens")
        repeated = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if not repeated:
            rows = rows.groupBy("id").agg(F.max_by(F.struct("tokens", "weights"), order).alias("r")).select("id", "r.tokens", "r.weights")
        return rows

    def _tile_up(self, rows: DataFrame, number: int) -> DataFrame:
        """Deal rows (id, tokens, weights) into tiles: a header row with the ids of each tile, and its blocks. Not shuffled."""
        kind = self.id_type.simpleString()
        shape = f"tile long, ids array<{kind}>, token string, n int, top float, docs binary, weights binary"
        ids_type = pa.list_(pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64())

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            base = (number << 44) + (TaskContext.get().partitionId() << 22)
            held: list[pa.RecordBatch] = []
            made = n = postings = 0

            def tile() -> Iterator[pa.RecordBatch]:
                rows = pa.Table.from_batches(held).combine_chunks()
                rows = rows.take(pc.sort_indices(rows["id"]))
                lists = rows["tokens"].combine_chunks()
                ids = pa.array([rows["id"].to_pylist()], ids_type)
                yield _rows(base + made, 1, [ids, pa.nulls(1, pa.string()), pa.array([len(rows)], pa.int32()), pa.array([0.0], pa.float32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())])
                owner = np.repeat(np.arange(len(rows), dtype=np.uint16), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                if not len(owner):
                    return
                flat = lists.flatten().cast(pa.string()).dictionary_encode()
                cell = flat.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(cell, kind="stable")
                edge = np.flatnonzero(np.diff(cell[order], prepend=-1))
                n = np.diff(edge, append=len(order))
                names = flat.dictionary.take(pa.array(cell[order][edge]))
                top, weights = np.ones(len(n), np.float32), pa.nulls(len(n), pa.binary())
                if rows["weights"].null_count < len(rows):
                    w = rows["weights"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)[order]
                    top, weights = np.maximum.reduceat(w, edge), _cut(w, edge)
                made_of = [pa.nulls(len(n), ids_type), names, pa.array(n.astype(np.int32)), pa.array(top), _cut(owner[order], edge), weights]
                for at in range(0, len(n), 4096):
                    some = [c.slice(at, 4096) for c in made_of]
                    yield _rows(base + made, len(some[0]), some)

            def _cut(x: np.ndarray, edge: np.ndarray) -> pa.Array:
                return _binary(x, np.append(edge, len(x)))

            def _rows(tile: int, n: int, columns: list[pa.Array]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(n, tile)), *columns], ["tile", "ids", "token", "n", "top", "docs", "weights"])

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    n += batch.num_rows
                    postings += len(batch.column(1).flatten())
                    if n >= TILE_DOCS or postings >= TILE_POSTINGS:
                        yield from tile()
                        held, made, n, postings = [], made + 1, 0, 0
            if held:
                yield from tile()

        small_batches(self.spark)
        return rows.mapInArrow(make, shape)

    def _commit(self, docs: DataFrame | None, ids: DataFrame | None) -> int:
        number, now = self.log.latest()
        folder = self.log.folder("seg")
        at, tables = f"{self.path}/{folder}", []
        n = 0
        if docs is not None:
            made = written(self._tile_up(self._tokens(docs), number + 1), "inverted-made")
            # By token and tile, so that a token that all texts hold is many tasks' work.
            blocks = made.where(F.col("token").isNotNull()).withColumn("bucket", bucket_of(F.col("token")))
            blocks = blocks.repartitionByRange("bucket", "token", "tile").sortWithinPartitions("bucket", "token", "tile")
            blocks.select("bucket", "token", "tile", "n", "top", "docs", "weights").write.partitionBy("bucket").parquet(f"{at}/blocks")
            tiles = made.where(F.col("ids").isNotNull()).select("tile", "ids")
            tiles.write.parquet(f"{at}/tiles")
            tables += ["blocks", "tiles"]
            tiles = self.spark.read.schema(self._tiles).parquet(f"{at}/tiles")
            n = tiles.agg(F.sum(F.size("ids"))).first()[0] or 0
            ids = tiles.select(F.explode("ids").alias("id"))
        dead = 0
        if now.get("docs"):
            gone = written(self.live().join(ids.select("id").distinct(), "id", "left_semi").select("tile", "local"), "inverted-gone")
            dead = gone.count()
            if dead:
                gone.write.parquet(f"{at}/gone")
                tables.append("gone")
        plus = self.spark.read.schema(self._blocks).parquet(f"{at}/blocks").groupBy("token").agg(F.sum("n").cast("long").alias("docs"), F.max("top").alias("top")) if n else None
        minus = self._held_by(gone) if dead else None
        parts = [x for x in (plus, minus) if x is not None]
        if not parts:
            return 0
        reduce(DataFrame.unionByName, parts).groupBy("token").agg(F.sum("docs").alias("docs"), F.max("top").alias("top")).write.parquet(f"{at}/words")
        tables.append("words")
        folders = [*now.get("folders", ()), folder]
        self.log.put(number + 1, {"folders": folders, "tables": now.get("tables", {}) | {folder: tables}, "docs": now.get("docs", 0) + n - dead})
        self.log.forget(number, set(folders))
        if len(folders) >= MERGE_AT:
            self.merge()
        return n if docs is not None else dead

    def _masks(self, gone: DataFrame) -> DataFrame:
        """tile and its gone documents as bits, which a join can carry to each block."""
        lists = gone.groupBy("tile").agg(F.collect_list("local").alias("locals"))  # at most a tile's documents
        return written(lists.mapInArrow(_packed, "tile long, mask binary"), "inverted-masks")

    def _held_by(self, gone: DataFrame) -> DataFrame:
        """token and minus the number of documents of gone that hold it: read from the blocks of their tiles."""
        near = self.blocks().select("token", "tile", "docs").join(search.small_side(self._masks(gone)), "tile")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    hit, owner = _dead(batch.column(1), batch.column(2))[:2]
                    found = -np.bincount(owner[hit], minlength=batch.num_rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), pa.nulls(len(found), pa.float32())], ["token", "docs", "top"])

        small_batches(self.spark)
        return near.select("token", "docs", "mask").mapInArrow(count, self._words).where("docs <> 0")

    def _rewrite(self) -> None:
        """One segment of all live documents: dead ones leave the blocks; tiles keep their numbers of documents."""
        number, now = self.log.latest()
        if not now.get("folders"):
            return
        folder = self.log.folder("seg")
        at = f"{self.path}/{folder}"
        masks = self._masks(self.gone())
        blocks = self.blocks().join(search.small_side(masks), "tile", "left")

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = {name: batch.column(i) for i, name in enumerate([*names, "mask"])}
                dead, owner, docs = _dead(at["docs"], at["mask"])
                left = np.bincount(owner[~dead], minlength=batch.num_rows)
                ends = np.append(0, np.cumsum(left))
                at["docs"], at["n"] = _binary(docs[~dead], ends), pa.array(left.astype(np.int32))
                if at["weights"].null_count < batch.num_rows:
                    given = pc.is_valid(at["weights"]).to_numpy(zero_copy_only=False)
                    w = np.ones(len(docs), np.float32)
                    w[given[owner]] = np.frombuffer(b"".join(x for x in at["weights"].to_pylist() if x is not None), np.float32)
                    w, some = w[~dead], left > 0
                    top = np.zeros(batch.num_rows, np.float32)
                    top[some] = np.maximum.reduceat(w, ends[:-1][some]) if some.any() else 0
                    at["top"] = pc.if_else(pa.array(given), pa.array(top), at["top"])
                    at["weights"] = pc.if_else(pa.array(given), _binary(w, ends), pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([at[name].cast(t) for name, t in zip(names, kept.types, strict=True)], schema=kept).filter(pa.array(left > 0))

        names = ["bucket", "token", "tile", "n", "top", "docs", "weights"]
        kept = pa.schema([("bucket", pa.int32()), ("token", pa.string()), ("tile", pa.int64()), ("n", pa.int32()), ("top", pa.float32()), ("docs", pa.binary()), ("weights", pa.binary())])
        small_batches(self.spark)
        cleaned = blocks.select(*names, "mask").mapInArrow(clean, self._blocks)
        cleaned.repartitionByRange("bucket", "token", "tile").sortWithinPartitions("bucket", "token", "tile").write.partitionBy("bucket").parquet(f"{at}/blocks")
        tiles, tables = self._read("tiles", self._tiles), ["blocks", "tiles", "words"]
        tiles.write.parquet(f"{at}/tiles")
        # Dead documents keep their numbers in a tile, so their list goes along; a tile without a live one is left out.
        whole = tiles.select("tile", F.size("ids").alias("size")).join(self.gone().groupBy("tile").count(), "tile").where("size > count").select("tile")
        gone = written(self.gone().join(search.small_side(whole), "tile", "left_semi"), "inverted-gone")
        empty = tiles.select("tile").join(search.small_side(masks.select("tile")), "tile", "left_semi").join(search.small_side(whole), "tile", "left_anti")
        if not empty.isEmpty():
            tiles.join(search.small_side(empty), "tile", "left_anti").write.mode("overwrite").parquet(f"{at}/tiles")
        if not gone.isEmpty():
            gone.write.parquet(f"{at}/gone")
            tables.append("gone")
        self.frequencies().write.parquet(f"{at}/words")
        self.log.put(number + 1, {"folders": [folder], "tables": {folder: tables}, "docs": now["docs"]})
        self.log.forget(number, {folder, *now["folders"]})

    # Searching

    def idf(self, tokens: DataFrame | None = None) -> DataFrame:
        """token, idf = ln((N - n + 0.5) / (n + 0.5) + 1) and top, of all tokens or of those given."""
        seen = self.frequencies() if tokens is None else self.frequencies().join(search.small_side(tokens), "token", "left_semi")
        return seen.select("token", F.log((F.lit(self.size()) - F.col("docs") + 0.5) / (F.col("docs") + 0.5) + 1).alias("idf"), "top")

    def search(self, queries: DataFrame, k: int, weighted: bool = True, digits: int | None = None, tally: Tally | None = None) -> DataFrame:
        """The k documents of largest score for each query: query_id, rank, id, score. Exact; ties go to the smaller id.

        queries: query_id and text, or query_id, tokens and weights. The score is the sum,
        over tokens that query and document share, of the product of their weights, times
        the token's idf if weighted. Documents that share nothing are no hits. digits:
        scores are rounded before they are ranked, to 9 at most, since sums in another order differ.

        One tile in SEED_EVERY is scored in full, which bounds each query's k-th score
        from below. In the other tiles only blocks of tokens are read that may still
        bring a document to that bound; for the documents that then may reach it, the
        blocks of the query's commonest tokens are read in their tiles alone. Queries are
        taken some thousands at a time (search.QUERY_ROWS, QUERY_TOKENS).
        """
        spark = small_batches(self.spark)
        digits = 9 if digits is None else digits
        if "tokens" in queries.columns:
            asked = queries.select("query_id", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("weights").cast("array<double>").alias("w"))))
            asked = asked.groupBy("query_id", "token").agg(F.max("w").alias("w"))
        else:
            asked = queries.select("query_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("token"), F.lit(1.0).alias("w"))
        asked = written(asked.where(F.col("token").isNotNull() & (F.col("w") > 0)), "inverted-asked")
        terms = self.idf(asked.select("token").distinct())
        terms = written(terms if weighted else terms.withColumn("idf", F.lit(1.0)), "inverted-terms")
        words = asked.join(search.small_side(terms), "token").select("query_id", "token", (F.col("w") * F.col("idf")).alias("w"), "top")
        asked = words.groupBy("query_id").agg(F.collect_list(F.struct("token", "w", "top")).alias("t"))  # one query's tokens
        schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {self.id_type.simpleString()}, score double"
        if tally:
            tally.of = self.blocks().count()
        asked = written(asked, "inverted-queries")
        found = search._in_passes(self.blocks(), asked, lambda rows: self._pass(rows, k, digits, schema, tally), lambda r: len(r["t"]), search.QUERY_TOKENS, schema)
        return search.ranked(found, k)

    def _named(self, tokens: list[str]) -> DataFrame:
        """Tokens as a table: broadcast up to search.BROADCAST_ROWS."""
        out = self.spark.createDataFrame(pa.table([pa.array(tokens, pa.string())], names=["token"]))
        return F.broadcast(out) if len(tokens) <= search.BROADCAST_ROWS else out

    def _pass(self, rows: list, k: int, digits: int, schema: str, tally: Tally | None) -> DataFrame:
        """Hits of one block of queries, a superset of each query's k best, staged."""
        ask = _Asked.of(rows)
        vocabulary = self._named(ask.vocabulary)
        blocks = self.blocks()
        if len(ask.vocabulary) <= FEW_TOKENS:  # only folders of their buckets, and of these only row groups with them
            buckets = [r["bucket"] for r in vocabulary.select(bucket_of(F.col("token")).alias("bucket")).distinct().collect()]
            blocks = blocks.where(F.col("bucket").isin(buckets) & F.col("token").isin(ask.vocabulary))
        heads = self._read("tiles", self._tiles).join(self.gone().groupBy("tile").agg(F.collect_list("local").alias("locals")), "tile", "left")
        heads = heads.select("tile", "ids", F.coalesce("locals", F.array().cast("array<int>")).alias("locals"))
        seed = F.pmod(F.xxhash64("tile"), F.lit(SEED_EVERY)) == 0
        if not heads.where(seed).limit(1).count():
            first = heads.agg(F.min("tile")).first()[0]
            seed = F.col("tile") == F.lit(first)

        def part(which: Column, tokens: DataFrame) -> DataFrame:
            """Blocks of some tokens with the headers of their tiles."""
            some = blocks.where(which).join(tokens, "token", "left_semi").select("tile", "token", "docs", "weights")
            if tally:
                tally.read += some.count()
            return some.unionByName(heads.where(which), allowMissingColumns=True)

        first = written(self._scored(part(seed, vocabulary), ask, k, digits, schema), "inverted-seeds")
        sure = search.ranked(first.select("query_id", "id", "score"), k).where(F.col("rank") == k).select("query_id", "score")
        ask.bound({r["query_id"]: r["score"] for r in sure.collect()}, digits)  # at most QUERY_ROWS rows
        second = written(self._scored(part(~seed, self._named(ask.early())), ask, k, digits, schema), "inverted-candidates")
        done = first.select("query_id", "id", "score").unionByName(second.where(F.col("local").isNull()).select("query_id", "id", "score"))
        open_ = second.where(F.col("local").isNotNull())
        if open_.isEmpty():
            return done
        tiles = written(open_.select("tile").distinct(), "inverted-tiles")
        rest = blocks.join(self._named(ask.late()), "token", "left_semi").join(search.small_side(tiles), "tile", "left_semi").select("tile", "token", "docs", "weights")
        if tally:
            tally.read += rest.count()
        return done.unionByName(self._completed(rest, open_, ask, digits, schema))

    def _scored(self, part: DataFrame, ask: _Asked, k: int, digits: int, schema: str) -> DataFrame:
        """query_id, id, score, and tile and local where the score lacks the late tokens."""
        shared = self.spark.sparkContext.broadcast(ask)
        plain = _arrow_types(schema)
        kind = tiles.id_type(self.id_type.simpleString())

        def run(table: pa.Table) -> pa.Table:
            ask = shared.value
            token = table["token"].to_pylist()
            head = token.index(None)
            ids, dead = table["ids"][head].as_py(), table["locals"][head].as_py()
            tile = table["tile"][head].as_py()
            known = [(ask.row[t], d, w) for t, d, w in zip(token, table["docs"].to_pylist(), table["weights"].to_pylist(), strict=True) if t is not None]
            ids, out = tiles.ids_of(pa.array(ids, kind)), []
            for a, s in ask.scores(known, len(ids)):
                s[:, dead] = 0
                slack, some = ask.slack[a : a + len(s)], slice(a, a + len(s))
                least = np.maximum(ask.least[some], tiles.kth_at_least(s, k)) - ask.margin - slack
                i, j = np.nonzero((s > 0) & (s >= least[:, None]))
                found, open_ = s[i, j].astype(np.float64), slack[i] > 0
                found = np.where(open_, found, np.round(found, digits))
                order = np.lexsort((j, -found, i))
                i, j, found, open_ = i[order], j[order], found[order], open_[order]
                keep = open_ | (np.arange(len(i)) - np.searchsorted(i, i) < k)
                out.append((a + i[keep], j[keep], found[keep], open_[keep]))
            i, j, found, open_ = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, t) for t in (int, int, float, bool))
            columns = [pa.array([ask.ids[x] for x in i.tolist()], plain[0]), pa.array(ids[j].tolist(), plain[1]), pa.array(found)]
            columns += [pa.array(np.full(len(i), tile), pa.int64(), mask=~open_), pa.array(j, pa.int32(), mask=~open_)]
            return pa.table(columns, names=["query_id", "id", "score", "tile", "local"])

        return part.groupBy("tile").applyInArrow(run, f"{schema}, tile long, local int")

    def _completed(self, blocks: DataFrame, candidates: DataFrame, ask: _Asked, digits: int, schema: str) -> DataFrame:
        """Candidates with the weights of their queries' late tokens added."""
        shared = self.spark.sparkContext.broadcast(ask)
        plain = _arrow_types(schema)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ask = shared.value
            known = {ask.row[t]: (d, w) for t, d, w in zip(left["token"].to_pylist(), left["docs"].to_pylist(), left["weights"].to_pylist(), strict=True)}
            order = pc.sort_indices(right, sort_keys=[("query_id", "ascending")])
            right = right.take(order)
            q, local, score = right["query_id"].to_pylist(), right["local"].to_numpy(), right["score"].to_numpy().copy()
            lo = 0
            dense = np.zeros(1 << 16)
            while lo < len(q):
                hi = lo
                while hi < len(q) and q[hi] == q[lo]:
                    hi += 1
                for row, weight in ask.late_of(ask.number[q[lo]]):
                    if row in known:
                        docs = np.frombuffer(known[row][0], np.uint16)
                        dense[docs] = 1.0 if known[row][1] is None else np.frombuffer(known[row][1], np.float32)
                        score[lo:hi] += weight * dense[local[lo:hi]]
                        dense[docs] = 0.0
                lo = hi
            score = np.round(score, digits)
            return pa.table([pa.array(q, plain[0]), right["id"].cast(plain[1]), pa.array(score)], names=["query_id", "id", "score"])

        pairs = candidates.select("tile", "query_id", "id", "score", "local")
        return blocks.groupBy("tile").cogroup(pairs.groupBy("tile")).applyInArrow(run, schema)


def _binary(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of x between ends, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def _dead(docs: pa.Array, masks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every posting of a batch of blocks whether its document's bit is set in the block's mask, its block's row, and the document."""
    sizes = lambda x: pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda x: b"".join(v for v in x.to_pylist() if v)
    every, bits, size = np.frombuffer(flat(docs), np.uint16), np.frombuffer(flat(masks) + b"\0", np.uint8), sizes(masks)
    owner = np.repeat(np.arange(len(docs)), sizes(docs) // 2)
    byte = (every >> 3).astype(np.int64)
    inside = byte < size[owner]
    byte = np.where(inside, byte + (np.cumsum(size) - size)[owner], 0)
    return inside & (bits[byte] >> (every & 7) & 1).astype(bool), owner, every


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers of a tile's documents as bits."""
    for batch in batches:
        masks = []
        for some in batch.column(1).to_pylist():
            bits = np.zeros(max(some) + 1, bool)
            bits[some] = True
            masks.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks, pa.binary())], ["tile", "mask"])


def _arrow_types(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = StructType.fromDDL(schema)
    return [to_arrow_type(f.dataType) for f in kind.fields]


class _Asked:
    """A block of queries as arrays: tokens sorted within each query, those that can add most first."""

    def __init__(self) -> None:
        self.ids: list = []
        self.vocabulary: list[str] = []

    @classmethod
    def of(cls, rows: list) -> _Asked:
        out = cls()
        out.ids = [r["query_id"] for r in rows]
        out.number = {q: i for i, q in enumerate(out.ids)}
        out.vocabulary = sorted({t["token"] for r in rows for t in r["t"]})
        out.row = {t: i for i, t in enumerate(out.vocabulary)}
        out.start = np.append(0, np.cumsum([len(r["t"]) for r in rows]))
        token = np.array([out.row[t["token"]] for r in rows for t in r["t"]], np.int64)
        weight = np.array([t["w"] for r in rows for t in r["t"]], np.float64)
        owner = np.repeat(np.arange(len(rows)), np.diff(out.start))
        # What a token can add to a score: its weight times the largest one in any document.
        out.most = np.array([t["w"] * t["top"] for r in rows for t in r["t"]], np.float64)
        order = np.lexsort((token, -out.most, owner))
        out.token, out.weight, out.most, out.owner = token[order], weight[order], out.most[order], owner
        out.heavy = np.ones(len(token), bool)
        out.slack = np.zeros(len(rows))
        out.least = np.zeros(len(rows))
        out.margin = 0.0
        return out

    def bound(self, least: dict, digits: int) -> None:
        """Given a lower bound of each query's k-th score, leave its lightest tokens for later, as long as they add little."""
        self.margin = 10.0**-digits
        for i, q in enumerate(self.ids):
            self.least[i] = least.get(q, 0.0)
            mine = slice(self.start[i], self.start[i + 1])
            tail = np.cumsum(self.most[mine][::-1])[::-1]
            self.heavy[mine] = (tail >= SLACK * self.least[i]) | (self.least[i] <= 0)
            self.slack[i] = self.most[mine][~self.heavy[mine]].sum()

    def early(self) -> list[str]:
        return [self.vocabulary[t] for t in np.unique(self.token[self.heavy])]

    def late(self) -> list[str]:
        return [self.vocabulary[t] for t in np.unique(self.token[~self.heavy])]

    def late_of(self, i: int) -> list[tuple[int, float]]:
        mine = slice(self.start[i], self.start[i + 1])
        light = ~self.heavy[mine]
        return list(zip(self.token[mine][light].tolist(), self.weight[mine][light].tolist(), strict=True))

    def scores(self, blocks: list, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """Scores of the queries by document, some queries after others, from a tile's blocks, by heavy tokens."""
        if not blocks:
            return
        row_of = np.full(len(self.vocabulary), -1)
        row_of[[r for r, _, _ in blocks]] = np.arange(len(blocks))
        edges = np.append(0, np.cumsum([len(d) // 2 for _, d, _ in blocks]))
        docs = np.frombuffer(b"".join(d for _, d, _ in blocks), np.uint16)
        given = None
        if any(w is not None for _, _, w in blocks):
            given = np.concatenate([np.ones(len(d) // 2) if w is None else np.frombuffer(w, np.float32) for _, d, w in blocks]).astype(np.float64)
        start = np.searchsorted(self.owner[self.heavy], np.arange(len(self.ids) + 1))
        yield from tiles.scores(start, self.token[self.heavy], self.weight[self.heavy], row_of, edges, docs, n, given)
