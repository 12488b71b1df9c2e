"""Packs of queries and packs of texts: their scores as arrays, and the best hits so far.

A pack of texts is inverted: its distinct tokens, and the numbers of the texts that hold
each. Where a pack of queries meets its first texts, tokens that many queries and many texts
hold are multiplied as matrices, and the postings of all others are counted up query by query.
That gives each query a score that its k-th hit has at least. From then on a query's commonest
tokens, which together can't reach a part of that score, are left out at first: only postings
of its other tokens are counted up, and texts that could still be hits get their whole score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts and postings of one pack (numbers of texts are 16 bits), and bytes of text that are packed at once; queries and their tokens of one.
PACK_TEXTS, PACK_POSTINGS, PACK_BYTES = 1 << 16, 1 << 22, 1 << 23
PACK_QUERIES, PACK_TOKENS = 2048, 1 << 19
#: Scores in one matrix.
CELLS = 1 << 20
#: Share of a pack's pairs that a token must meet in to be multiplied, and the most such tokens.
DENSE_SHARE, DENSE_MOST = 0.02, 512
#: Texts of most tokens that a task scores in full first; share of the k-th score that tokens left out may reach; tokens left out are in this share of a pack's texts at least.
LEAD_TEXTS, LEFT_SHARE, LEFT_TEXTS = 1024, 0.6, 1 / 64
#: Bytes that say which texts of a pack hold its common tokens.
HELD = 1 << 25


def id_type(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts as they do: numbers, or strings by code point."""
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column.to_numpy(zero_copy_only=False)


def sealed(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(value: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(value.as_buffer()) as found:
        return found.read_next_batch()


def _groups(batches: Iterator[pa.RecordBatch], rows: int, most: int, load: Callable[[pa.RecordBatch], int]) -> Iterator[pa.Table]:
    """Whole batches, a new group at the bound of rows or of their load."""
    held: list[pa.RecordBatch] = []
    n = total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        more = load(batch)
        if held and (n + batch.num_rows > rows or total + more > most):
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, total = [], 0, 0
        held.append(batch)
        n, total = n + batch.num_rows, total + more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbered(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens of lists, each token's number, and the lists' sizes."""
    flat = lists.flatten().cast(pa.string()).dictionary_encode()
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _inverted(ids: pa.Array, words: pa.Array, token: np.ndarray, owner: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """One pack of ids, which ascend, and of pairs of a token's and a text's number, which may repeat."""
    key = token.astype(np.int64)
    key <<= 16
    key |= owner
    key.sort()
    if (again := key[1:] == key[:-1]).any():
        key = key[np.append(True, ~again)]
    held = sealed(word=words, n=pa.array(np.bincount(key >> 16, minlength=len(words)), pa.int64()))
    columns = [pa.array([ids.to_pylist()], pa.list_(kind)), pa.array([held], pa.binary()), pa.array([key.astype(np.uint16).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["ids", "words", "texts"])


def pack_texts(kind: str):
    """For mapInArrow: rows (id, text in lower case) as packs (ids, words, texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, PACK_TEXTS, PACK_BYTES, lambda b: b.column(1).nbytes):
            table = table.take(pc.sort_indices(table.column(0)))
            words, token, sizes = _numbered(pc.ascii_split_whitespace(table.column(1).combine_chunks()))
            owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
            some = token != words.index("").as_py()  # texts may begin or end with a space
            yield _inverted(table.column(0), words, token[some], owner[some], id_type(kind))
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def merge_packs(kind: str):
    """For mapInArrow: packs as fewer and larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def merged() -> pa.RecordBatch:
            ids = pa.chunked_array([pack[0] for pack in held]).combine_chunks()
            order = pc.sort_indices(ids)
            place = np.empty(len(ids), np.uint16)
            place[order.to_numpy()] = np.arange(len(ids))
            words = pa.chunked_array([pack[1]["word"] for pack in held]).combine_chunks().dictionary_encode()
            token = np.repeat(words.indices.to_numpy(), np.concatenate([pack[1]["n"].to_numpy() for pack in held]))
            first = np.append(0, np.cumsum([len(pack[0]) for pack in held]))
            owner = np.concatenate([place[at : at + len(pack[0])][pack[2]] for at, pack in zip(first, held, strict=False)])
            return _inverted(ids.take(order), words.dictionary, token, owner, id_type(kind))

        for batch in batches:
            for ids, words, texts in zip(*batch.columns, strict=True):
                pack = ids.values, opened(words), np.frombuffer(texts.as_buffer(), np.uint16)
                if held and (sum(len(x[0]) for x in held) + len(pack[0]) > PACK_TEXTS or sum(len(x[2]) for x in held) + len(pack[2]) > PACK_POSTINGS):
                    yield merged()
                    held = []
                held.append(pack)
        if held:
            yield merged()
        pa.default_memory_pool().release_unused()

    return run


def pack_queries(kind: str):
    """For mapInArrow: rows (id, distinct tokens, weights if they aren't all one) as packs (pack, asked, vocabulary, tokens, starts)."""
    ids = pa.list_(id_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for number, table in enumerate(_groups(batches, PACK_QUERIES, PACK_TOKENS, lambda b: len(b.column(1).flatten()))):
            words, token, sizes = _numbered(table.column(1).combine_chunks())
            weight = table.column(2).combine_chunks().flatten().cast(pa.float64()) if table.num_columns > 2 else pa.array(np.ones(len(token)))
            columns = [pa.array([first + number], pa.int64()), pa.array([table.column(0).to_pylist()], ids)]
            blobs = [sealed(word=words), sealed(token=pa.array(token, pa.int32()), weight=weight), np.append(0, np.cumsum(sizes)).astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([b], pa.binary()) for b in blobs]], ["pack", "asked", "vocabulary", "tokens", "starts"])

    return run


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (token, n) of each pack's words."""
    for batch in batches:
        for value in batch.column(0):
            found = opened(value)
            yield pa.RecordBatch.from_arrays([found["word"], found["n"]], ["token", "n"])


def scores(start: np.ndarray, token: np.ndarray, weight: np.ndarray, at: np.ndarray, edges: np.ndarray, texts: np.ndarray, n: int, given: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(a, scores of queries from a on by text) for some queries after others.

    Queries are start, token, weight: query i has the tokens and weights from start[i] to
    start[i + 1]. at: the number of each token in the pack, or -1. texts from edges[t] to
    edges[t + 1] are those that hold the pack's token t, of n texts; given: the token's
    weights there. Scores are counts in single precision where all weights are one.
    """
    asked = len(start) - 1
    owner = np.repeat(np.arange(asked), np.diff(start))
    known = at[token] >= 0
    owner, weight, token, place = owner[known], weight[known], token[known], at[token[known]]
    kind = np.float32 if given is None and (weight == 1.0).all() else np.float64
    size = np.diff(edges)
    met = size * np.bincount(place, minlength=len(size))
    common = np.flatnonzero(met > DENSE_SHARE * n * asked)
    common = common[np.argsort(-met[common], kind="stable")[:DENSE_MOST]]
    ones = np.zeros((len(common), n), kind)
    for row, t in enumerate(common):
        mine = slice(edges[t], edges[t + 1])
        ones[row, texts[mine]] = 1.0 if given is None else given[mine]
    row_of = np.full(len(size), -1)
    row_of[common] = np.arange(len(common))
    row = row_of[place]
    dense = np.zeros((asked, len(common)), kind)
    dense[owner[row >= 0], row[row >= 0]] = weight[row >= 0]
    rest = row < 0
    owner, weight, place = owner[rest], weight[rest], place[rest]
    froms, tos = edges[place], edges[place + 1]
    bounds = np.searchsorted(owner, np.arange(asked + 1))
    step = max(1, CELLS // n)
    for a in range(0, asked, step):
        b = min(a + step, asked)
        s = dense[a:b] @ ones
        for i in range(a, b):
            mine = slice(bounds[i], bounds[i + 1])
            if mine.start == mine.stop:
                continue
            some = list(zip(froms[mine].tolist(), tos[mine].tolist(), strict=True))
            hit = np.concatenate([texts[x:y] for x, y in some], dtype=np.intp, casting="safe")
            if kind is np.float32:
                s[i - a] += np.bincount(hit, minlength=n)
            else:
                w = np.repeat(weight[mine], size[place[mine]])
                if given is not None:
                    w *= np.concatenate([given[x:y] for x, y in some])
                s[i - a] += np.bincount(hit, w, n)
        yield a, s


def kth_at_least(s: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of each row's k-th largest score: the k-th largest of the largest scores of groups of columns."""
    groups = max(4 * k, 64)
    wide = s.shape[1] // groups
    if wide < 2:
        groups, wide = s.shape[1], 1
    if groups < k:
        return np.full(len(s), -np.inf)
    top = np.fmax.reduce(s[:, : groups * wide].reshape(len(s), wide, groups), axis=1)
    return np.partition(np.where(np.isnan(top), -np.inf, top), groups - k, axis=1)[:, groups - k]


class Best:
    """The k best hits so far of each of some queries; ties go to the smaller id. Only scores over a bound are hits."""

    def __init__(self, asked: np.ndarray, k: int, digits: int | None, above: float) -> None:
        self.asked, self.k, self.digits, self.above = asked, k, digits, above
        self.margin = 0.0 if digits is None else 10.0**-digits
        self.least = np.full(len(asked), -np.inf)
        self.hits: list[tuple] = []

    def offer(self, a: int, s: np.ndarray, ids: np.ndarray) -> None:
        """Scores of queries from a on; ids ascend."""
        least = self.least[a : a + len(s)]
        if np.isneginf(least).any():
            least = np.maximum(least, kth_at_least(s, self.k))
        i, j = np.nonzero((s >= (least - self.margin).astype(s.dtype)[:, None]) & (s > self.above))
        found = s[i, j].astype(np.float64)
        found = found if self.digits is None else np.round(found, self.digits)
        order = np.lexsort((j, -found, i))
        i, j, found = i[order], j[order], found[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        self.hits.append((a + i[first], ids[j[first]], found[first]))

    def bound(self, tiles: Iterator[tuple[int, np.ndarray]]) -> None:
        """Scores of some texts that are offered later: k of them bound a query's k-th from below."""
        for a, s in tiles:
            if s.shape[1] >= self.k:
                kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k].astype(np.float64)
                self.least[a : a + len(s)] = np.maximum(self.least[a : a + len(s)], np.where(kth > self.above, kth, -np.inf))

    def floor(self) -> np.ndarray:
        """What a score has at least that could be a hit; sums in another order and rounding allowed for."""
        return self.least - self.margin - 1e-9 * np.abs(np.where(np.isinf(self.least), 0.0, self.least))

    def add(self, q: int, ids: np.ndarray, s: np.ndarray) -> None:
        """Some scores of one query; ids ascend."""
        s = s if self.digits is None else np.round(s, self.digits)
        some = np.flatnonzero((s > self.above) & (s >= self.least[q] - self.margin))
        if len(some) > self.k:
            some = some[np.lexsort((some, -s[some]))[: self.k]]
        if len(some):
            self.hits.append((np.full(len(some), q), ids[some], s[some]))

    def settle(self) -> None:
        """After all queries have met some texts."""
        if not self.hits:
            return
        row, ids, found = (np.concatenate(x) for x in zip(*self.hits, strict=True))
        order = np.lexsort((ids, -found, row))
        row, ids, found = row[order], ids[order], found[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep, last = place < self.k, place == self.k - 1
        self.least[row[last]] = found[last]
        self.hits = [(row[keep], ids[keep], found[keep])]

    def rows(self, kinds: list[pa.DataType]) -> pa.RecordBatch:
        self.settle()
        row, ids, found = self.hits[0] if self.hits else (np.zeros(0, int), self.asked[:0], np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.asked[row].tolist(), kinds[0]), pa.array(ids.tolist(), kinds[1]), pa.array(found)], ["query_id", "id", "score"])


def longest(edges: np.ndarray, texts: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """edges, texts and the number of texts of a pack's texts of most tokens alone, numbered anew."""
    some = np.sort(np.argsort(-np.bincount(texts, minlength=n), kind="stable")[:most])
    place, within = np.zeros(n, np.uint16), np.zeros(n, bool)
    place[some], within[some] = np.arange(len(some)), True
    known = within[texts]
    return np.append(0, np.cumsum(known, dtype=np.int32))[edges], place[texts[known]], len(some)


def over(start: np.ndarray, token: np.ndarray, weight: np.ndarray, at: np.ndarray, edges: np.ndarray, texts: np.ndarray, n: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, texts, scores) of each query i: all texts with a score over 0 and of least[i] or more, and maybe others. Packs as in scores.

    A query's tokens that most texts hold for their weight are left out as long as their
    weights add up to under a part of least[i]. A text that the other tokens don't bring
    within those weights of least[i] can't reach it.
    """
    asked = len(start) - 1
    owner = np.repeat(np.arange(asked), np.diff(start))
    known = at[token] >= 0
    owner, weight, place = owner[known], weight[known], at[token[known]]
    ones = bool((weight == 1.0).all())
    size = np.diff(edges)
    met = np.bincount(place, minlength=len(size)) > 0
    common = np.flatnonzero(met & (size >= max(1, LEFT_TEXTS * n)))
    common = common[np.argsort(-size[common], kind="stable")[: max(1, HELD // n)]]
    row_of = np.full(len(size), -1)
    row_of[common] = np.arange(len(common))
    may = np.flatnonzero(row_of[place] >= 0)
    may = may[np.lexsort((-size[place[may]] / weight[may], owner[may]))]
    total = np.cumsum(weight[may])
    first = np.searchsorted(owner[may], owner[may])
    out = may[total - (total - weight[may])[first] <= LEFT_SHARE * np.maximum(least[owner[may]], 0.0)]
    need = least - np.bincount(owner[out], weight[out], asked)

    rest = np.ones(len(owner), bool)
    rest[out] = False
    by_row = rest & (row_of[place] >= 0) if ones else np.zeros(len(owner), bool)
    added, listed = np.flatnonzero(by_row), np.flatnonzero(rest & ~by_row)
    outs, adds, lists = (np.searchsorted(owner[some], np.arange(asked + 1)) for some in (out, added, listed))
    # By text, whether it holds a token that is left out; by token that is added as a row, which texts hold it, two texts in a byte.
    left, out_at = np.unique(place[out], return_inverse=True)
    wide, half = len(left), -(-n // 2)
    by_text = np.zeros(n * wide, np.uint8)
    for column, t in enumerate(left):
        by_text[texts[edges[t] : edges[t + 1]].astype(np.intp) * wide + column] = 1
    kinds, added = np.unique(place[added], return_inverse=True)
    rows = np.zeros((len(kinds), half), np.uint8)
    for row, t in zip(rows, kinds, strict=True):
        mine = texts[edges[t] : edges[t + 1]]  # in ascending order
        row[mine[mine < half]] = 1
        row[mine[mine >= half] - half] += 16
    counts, both, part, enough = np.empty(2 * half, np.uint8), np.empty(half, np.uint8), np.empty(half, np.uint8), np.empty(2 * half, bool)
    out_weight, added, listed_weight, listed = weight[out], added.tolist(), weight[listed], place[listed]
    froms, tos, sizes = edges[listed], edges[listed + 1], size[listed]
    for i in range(asked):
        mine, some = slice(lists[i], lists[i + 1]), added[adds[i] : adds[i + 1]]
        if mine.start == mine.stop and not some:
            continue  # what is left out can't reach the bound
        parts = zip(froms[mine].tolist(), tos[mine].tolist(), strict=True)
        hit = np.concatenate([texts[x:y] for x, y in parts] or [texts[:0]]).astype(np.intp)
        if ones:
            s = counts if len(some) + mine.stop - mine.start < 256 else np.empty(2 * half, np.uint32)
            s.fill(0)
            for at_once in (some[x : x + 15] for x in range(0, len(some), 15)):  # so many fit into four bits
                np.copyto(both, rows[at_once[0]])
                for row in at_once[1:]:
                    np.add(both, rows[row], out=both)
                s[:half] += np.bitwise_and(both, 15, out=part)
                s[half:] += np.right_shift(both, 4, out=part)
            np.add.at(s, hit, s.dtype.type(1))
            found = np.flatnonzero(np.greater_equal(s, max(1, math.ceil(need[i])) if need[i] > 0 else 1, out=enough))
        else:
            s = np.bincount(hit, np.repeat(listed_weight[mine], sizes[mine]), n)
            found = np.flatnonzero(s >= need[i] if need[i] > 0 else s > 0)
        s, more = s[found].astype(np.float64), slice(outs[i], outs[i + 1])
        if len(found) and more.start < more.stop:
            s += by_text[found[:, None] * wide + out_at[more]] @ out_weight[more]
        yield i, found, s


def meet(k: int, digits: int | None, kinds: list[pa.DataType]):
    """For mapInArrow over pairs of packs, (pack, asked, vocabulary, tokens, starts, ids, words, texts): each pack's k best in these pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                pack, asked, vocabulary, tokens, starts, ids, words, texts = (c[i] for c in batch.columns)
                if pack.as_py() != at:
                    if best:
                        yield best.rows(kinds)
                    at, best = pack.as_py(), Best(ids_of(asked.values), k, digits, 0.0)
                    start, mine = np.frombuffer(starts.as_buffer(), np.int64), opened(tokens)
                    token, weight = mine["token"].to_numpy(), mine["weight"].to_numpy()
                    wanted = opened(vocabulary)["word"]
                    fresh = True
                held, every = opened(words), ids_of(ids.values)
                place = pc.fill_null(pc.index_in(wanted, value_set=held["word"]), -1).to_numpy(zero_copy_only=False)
                query = start, token, weight, place
                post = np.append(0, np.cumsum(held["n"].to_numpy())), np.frombuffer(texts.as_buffer(), np.uint16), len(every)
                if fresh:
                    best.bound(scores(*query, *longest(*post, max(LEAD_TEXTS, k))))
                    fresh = False
                for q, found, s in over(*query, *post, best.floor()):
                    best.add(q, every[found], s)
                best.settle()
        if best:
            yield best.rows(kinds)
        pa.default_memory_pool().release_unused()

    return run
