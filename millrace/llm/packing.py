"""Packing by first-fit decreasing.

Documents are dealt at random into groups of bounded size, each with all its pieces of at
most the sequence length; in a group pieces are taken by falling length, and each goes to
the first sequence with room, found by a tournament tree of the sequences' capacities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, small_batches, staged
from .wordbpe import WordBpe, default_path

#: Documents of a group, about; bounds what one task packs at once.
GROUP_DOCS = 1024

TOKENISED = "doc_id long, doc_tokens long, crcs array<long>, ids_hash long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FirstFit:
    """A tournament tree over bins: each node holds the largest room below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """The first bin with room for length, and the room it had."""
        room, node = self.room, 1
        if room[1] < length:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        had = room[node]
        room[node] = had - length
        at = node // 2
        while at:
            room[at] = max(room[2 * at], room[2 * at + 1])
            at //= 2
        return node - self.leaves, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, lengths of at most capacity, taken in the given order."""
    tree = FirstFit(len(lengths), capacity)
    return [(b, capacity - had) for b, had in map(tree.put, lengths)]


def tokenised(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Per document its length with the end id, the crc32 of each full piece and of the rest, and a hash of all ids."""
    path = tokenizer or default_path()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, step = WordBpe.of(path), 4 * capacity
        for batch in batches:
            lengths, crcs, hashes = [], [], []
            for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids += end
                lengths.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[at : at + step]) for at in range(0, len(ids), step)])
                hashes.append(crcs[-1][0] if len(ids) <= step else zlib.crc32(ids))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (lengths, crcs, hashes), kinds)], ["doc_id", "doc_tokens", "crcs", "ids_hash"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, TOKENISED)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, group_docs: int = GROUP_DOCS, seed: int = 42) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most `capacity` ids.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens (with the end
    id), sequence_id and offset. Each id of a document, and the end id after it, is in
    exactly one piece; pieces of a sequence lie one after another from offset 0.

    A document's group comes from a hash of seed and of its number in the order of doc_id,
    length and ids, so another layout of the input gives the same sequences, and rows that
    repeat are dealt apart.

    A null or empty text is one piece that holds the end id. Very long texts become full
    pieces and a rest. Ties in length go by doc_id, ids and start. Repeated rows are
    packed each on its own; a null doc_id stays null. An empty table gives no rows; other
    columns are ignored.
    """
    rows = staged(tokenised(docs, tokenizer, capacity, end_id), "pack-docs")
    n = rows.count()
    groups = max(1, -(-n // group_docs))
    dealt = numbered(rows, ["doc_id", "doc_tokens", "ids_hash"], "number", "pack-numbers", n)
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(groups)))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number", kind="stable")
        n = group["doc_tokens"].to_numpy()
        many = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), many)
        start = capacity * (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many))
        length = np.minimum(capacity, n[doc] - start)
        order = np.lexsort((start, doc, -length))  # numbers follow doc_id and ids
        placed = first_fit_decreasing(length[order].tolist(), capacity)
        crc = np.concatenate(group["crcs"].to_list())
        out = {
            "doc_id": group["doc_id"].to_numpy()[doc[order]], "start": start[order], "length": length[order], "ids_crc32": crc[order], "doc_tokens": n[doc[order]],
            "sequence_id": [(int(key[0]) << 32) + b for b, _ in placed], "offset": [o for _, o in placed],
        }
        return pd.DataFrame(out).astype({"doc_id": "Int64"})

    return dealt.groupBy("grp").applyInPandas(fit, PLACED)
