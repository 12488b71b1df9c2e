"""Link graph: titles, edges, neighbours, components, communities, expansion, pins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.session import shared_dir, written


def title_index(notes: DataFrame) -> DataFrame:
    """norm_title and the source that has it first: by order of notes, then title, id, aliases.

    notes: pos, source_id, title, aliases.
    """
    names = notes.select(
        "pos", "source_id",
        F.posexplode(F.concat(F.array("title", "source_id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("kind", "name"),
    ).where(F.col("name").isNotNull())
    keyed = names.select(T.norm_key(F.col("name")).alias("norm_title"), F.struct("pos", "kind", "source_id").alias("first"))
    return keyed.groupBy("norm_title").agg(F.min("first.pos").alias("_"), F.min("first").alias("first")).select("norm_title", F.col("first.source_id").alias("source_id"))


def link_graph(notes: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) of resolved links, without loops. notes also needs wikilinks."""
    titles = title_index(notes) if titles is None else titles
    raw = notes.select(F.col("source_id").alias("src"), F.explode("wikilinks").alias("link")).select("src", T.norm_key(F.col("link")).alias("norm_title"))
    return raw.join(titles, "norm_title").select("src", F.col("source_id").alias("dst")).where("src <> dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """start, node and hop for every node within hops of each start, the start left out. starts: start."""
    both = undirected(edges)
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(both, front["node"] == both["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node and the smallest node it reaches, by least labels with path doubling, until nothing changes."""
    shared_dir(edges.sparkSession)  # where checkpoints go
    both = undirected(edges).checkpoint()
    label = both.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        step = label.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        up = step.select(F.col("node").alias("new"), F.col("new").alias("up"))
        jumped = step.join(up, "new").select("node", F.least("new", "up").alias("root"), F.col("root").alias("old")).checkpoint()
        label = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a partition (node, community) of an undirected graph given by edges (src, dst)."""
    both = undirected(edges).withColumn("w", F.lit(1.0))
    own = both.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    total = both.count()
    if not total:
        return 0.0
    inside = own.where("a = b").count() / total
    degree = own.groupBy("a").agg(F.sum("w").alias("k")).agg(F.sum((F.col("k") / total) ** 2)).first()[0]
    return inside - resolution * degree


def _moved(edges: DataFrame, resolution: float, seed: int, sweeps: int) -> DataFrame:
    """node and community after sweeps of local moves. edges (u, v, w): both directions, loops once with their double weight.

    In a sweep about half of the nodes, by a seeded hash and in turn, go to the neighbouring
    community of largest gain; all decide on the same state, which aggregates hold.
    """
    degree = edges.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))
    total = degree.agg(F.sum("k")).first()[0]
    state = written(degree.withColumn("community", F.col("node")), "louvain")
    quiet = 0
    for sweep in range(sweeps):
        sums = state.groupBy("community").agg(F.sum("k").alias("tot"), F.count("*").alias("n"))
        links = edges.where("u <> v").join(state.select(F.col("node").alias("v"), "community"), "v").groupBy("u", "community").agg(F.sum("w").alias("into"))
        at = state.select(F.col("node").alias("u"), "k", F.col("community").alias("own"))
        every = links.unionByName(at.select("u", F.col("own").alias("community"), F.lit(0.0).alias("into"))).groupBy("u", "community").agg(F.sum("into").alias("into"))
        rated = every.join(sums, "community").join(at.join(sums.select(F.col("community").alias("own"), F.col("n").alias("own_n")), "own"), "u")
        # Of two nodes that are alone only the larger goes to the other: else they would swap.
        rated = rated.where(~((F.col("n") == 1) & (F.col("own_n") == 1) & (F.col("community") > F.col("own"))))
        rest = F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("into") - resolution * F.col("k") * rest / total, 9)
        best = rated.withColumn("gain", gain).groupBy("u").agg(
            F.max_by("community", F.struct("gain", (F.col("community") == F.col("own")).alias("stay"), F.negate(F.xxhash64("community")).alias("tie"))).alias("best"), F.first("k").alias("k"), F.first("own").alias("own")
        )
        turn = F.pmod(F.xxhash64(F.lit(seed), "u") + sweep, F.lit(2)) == 0
        moved = written(best.select(F.col("u").alias("node"), "k", F.when(turn, F.col("best")).otherwise(F.col("own")).alias("community"), F.col("own").alias("was")), "louvain")
        state = moved.drop("was")
        quiet = quiet + 1 if moved.where("community <> was").isEmpty() else 0
        if quiet == 2:  # either half has had its turn
            break
    return state.select("node", "community")


def louvain(edges: DataFrame, resolution: float = 1.0, seed: int = 42, sweeps: int = 16, levels: int = 8) -> DataFrame:
    """node and community (the smallest node in it) of an undirected graph, by Louvain's method.

    Local moves by modularity gain, then communities become nodes, until nothing joins
    any more. Larger resolutions give smaller communities; one seed gives one result.
    Nodes without an edge are not there.
    """
    base = written(undirected(edges).where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1.0).alias("w")), "louvain")
    labels = base.select(F.col("u").alias("node")).distinct().withColumn("community", F.col("node"))
    now = base
    for level in range(levels if not base.isEmpty() else 0):
        found = _moved(now, resolution, seed + level, sweeps)
        names = found.groupBy("community").agg(F.min("node").alias("least"))
        found = written(found.join(names, "community").select("node", F.col("least").alias("community")), "louvain")
        labels = written(labels.join(found.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community")), "louvain")
        if found.where("node <> community").isEmpty():
            break
        ends = now.join(found.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(found.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
        now = written(ends.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")), "louvain")
    least = labels.groupBy("community").agg(F.min("node").alias("least"))
    return labels.join(least, "community").select("node", F.col("least").alias("community"))


def communities(edges: DataFrame, min_size: int = 4, most: int = 64, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """Louvain communities of at least min_size, the largest first, at most `most`: community, size, members (sorted)."""
    sized = louvain(edges, resolution, seed).groupBy("community").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).where(F.col("size") >= min_size)
    top = sized.orderBy(F.desc("size"), "community").limit(most)
    return top.select(F.concat(F.lit("community:"), F.substring(F.sha2(F.array_join("members", "|"), 256), 1, 12)).alias("community"), "size", "members")


def expand(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, hops: int = 1, per_source: int = 5, decay: float = 0.5) -> DataFrame:
    """Chunks of sources linked to the seeds' sources, with the seeds: chunk_id, source_id, score, expanded_from.

    seeds: chunk_id, source_id, score, and maybe query_id; then each query is expanded on
    its own, all in one plan. A neighbour has its best seed's score (ties: the smallest
    id) times decay and gives its first per_source chunks.
    """
    key = ["query_id"] if "query_id" in seeds.columns else []
    best = seeds.where("score > 0").groupBy(*key, "source_id").agg(F.max("score").alias("score"))
    near = neighbours(edges, best.select(F.col("source_id").alias("start")).distinct(), hops)
    via = near.join(best.select(*key, F.col("source_id").alias("start"), "score"), "start")
    via = via.join(best.select(*key, F.col("source_id").alias("node")), [*key, "node"], "left_anti")
    via = via.groupBy(*key, "node").agg(F.max("score").alias("score"), F.min(F.struct(-F.col("score"), "start")).alias("from"))
    w = Window.partitionBy("source_id").orderBy("chunk_index")
    first = chunks.select("chunk_id", "source_id", "chunk_index").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_source)
    more = first.join(via, first["source_id"] == via["node"]).select(*key, "chunk_id", "source_id", (F.col("score") * decay).alias("score"), F.col("from.start").alias("expanded_from"))
    return seeds.select(*key, "chunk_id", "source_id", "score", F.lit(None).cast("string").alias("expanded_from")).unionByName(
        more.join(seeds.select(*key, "chunk_id"), [*key, "chunk_id"], "left_anti")
    )


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (node)."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def related(edges: DataFrame, cited: DataFrame, first: int = 5, most: int = 20) -> DataFrame:
    """Notes linked to the first citations of a query and not cited by it: query_id, position (from 1, by id), source_id; at most `most`.

    cited: query_id, rank, source_id.
    """
    starts = cited.where(F.col("rank") <= first).select("query_id", F.col("source_id").alias("src")).distinct()
    near = starts.join(undirected(edges), "src").select("query_id", F.col("dst").alias("source_id")).distinct()
    new = near.join(cited.select("query_id", "source_id"), ["query_id", "source_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("source_id")
    return new.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("query_id", "position", "source_id")


def pins(messages: DataFrame, titles: DataFrame, chunks: DataFrame, per_source: int = 6) -> DataFrame:
    """Chunks of the notes that messages (msg_id, text) mention: msg_id, source_id, chunk_id; unresolved ones drop out."""
    said = messages.select("msg_id", F.explode(T.wikilinks(F.col("text"))).alias("mention"))
    said = said.select("msg_id", "mention", T.norm_key(F.col("mention")).alias("norm_title")).dropDuplicates(["msg_id", "norm_title"])
    found = said.join(titles, "norm_title", "left").select("msg_id", F.coalesce("source_id", F.concat(F.lit("obsidian:"), "mention", F.lit(".md"))).alias("source_id"))
    w = Window.partitionBy("source_id").orderBy("chunk_index")
    first = chunks.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_source)
    return found.distinct().join(first, "source_id").select("msg_id", "source_id", "chunk_id")


def pinned_block(pinned: DataFrame, chunks: DataFrame) -> DataFrame:
    """msg_id and its pinned chunks as text: a block for each note, headed by its title, in the order of titles.

    pinned: msg_id, source_id, chunk_id, as pins gives it; chunks: chunk_id, chunk_index, title, text.
    """
    held = pinned.join(chunks.select("chunk_id", "chunk_index", "title", "text"), "chunk_id")
    lines = lambda rows, field: F.transform(F.array_sort(rows), lambda x: x[field])
    note = held.groupBy("msg_id", "source_id").agg(F.min(F.coalesce("title", "source_id")).alias("title"), F.collect_list(F.struct("chunk_index", "text")).alias("c"))
    block = F.concat(F.lit("[pinned: "), "title", F.lit("]\n"), F.array_join(lines("c", "text"), "\n\n"))
    every = note.select("msg_id", F.struct("title", "source_id", block.alias("block")).alias("b")).groupBy("msg_id").agg(F.collect_list("b").alias("b"))  # what one message mentions
    return every.select("msg_id", F.array_join(lines("b", "block"), "\n---\n").alias("block"))
