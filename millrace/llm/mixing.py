"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. A source's target is met by whole passes over it
and, for the rest, a subset: every length gives the same share of its documents, and
a knapsack over what lengths have left fits the remaining words. Where very many words
remain, the largest lengths go before the knapsack; if the target is missed then, a
knapsack of all of them is solved, in whole words while its table is small enough and in
grains of several words beyond, whose miss has a proven bound. How many documents each
length gives is then filled by seeded order.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Words that the knapsack fits at first; what is above goes by the largest lengths first.
WINDOW = 1 << 14
#: If that misses the budget: bits (items times words) and sums up to which the knapsack fits all of it in whole words;
#: beyond both, BITS is the size of the table, and a grain as many words as that takes.
BITS = 1 << 29
SUMS = 1 << 17


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words that each source should give: weights repeat over the sources by code point, null last.

    A target stops at `most` times its source's size; the excess is shared again by
    weight among the others until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and left * weight[s] / total >= most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            open_.discard(s)
        left -= sum(out[s] for s in full)
    return out


def split(lengths: list[int], counts: list[int], budget: int) -> list[tuple[int, int, int]]:
    """Items of the knapsack: index, how many, their words; counts in powers of two."""
    items = []
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        count, n = min(count, budget // length if length else 0), 1
        while count:
            n = min(n, count)
            items.append((k, n, n * length))
            count, n = count - n, 2 * n
    return items


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length, at most its count, so that the sum is the largest not above budget.

    Counts are split into powers of two; reachable sums are the bits of a number, one
    number for each item, by which the choice is traced back.
    """
    return reached(split(lengths, counts, budget), len(lengths), budget)


def reached(items: list[tuple[int, int, int]], n_lengths: int, budget: int) -> list[int]:
    """The choice of items whose words sum to the largest not above budget, as a number for each length."""
    mask = (1 << (budget + 1)) - 1
    reach = [1]
    for _, _, words in items:
        reach.append((reach[-1] | reach[-1] << words) & mask)
        if reach[-1] >> budget & 1:
            break
    at = reach[-1].bit_length() - 1
    out = [0] * n_lengths
    for i in range(len(reach) - 2, -1, -1):
        if not reach[i] >> at & 1:
            k, n, words = items[i]
            out[k] += n
            at -= words
    return out


def sparse_knapsack(lengths: list[int], counts: list[int], budget: int, most: int = SUMS) -> list[int] | None:
    """As knapsack, by a table of the reachable sums with the item that first reached each; None where it grows too large."""
    came, work = {0: (-1, 0, 0)}, 0
    for k, n, words in split(lengths, counts, budget):
        work += len(came)
        came |= {s + words: (k, n, s) for s in came if s + words <= budget and s + words not in came}
        if budget in came:
            break
        if len(came) > most or work > 128 * most:
            return None
    out, at = [0] * len(lengths), max(came)
    while at:
        k, n, at = came[at]
        out[k] += n
    return out


def grain(items: int, budget: int) -> int:
    """Words that count as one in a table of at most BITS bits."""
    return max(1, -(-items * budget // BITS))


def whole(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """The knapsack of the whole budget: exact where a table of whole words, or of the reachable sums, is small enough.

    Else items are counted in grains, rounded down. The best choice of whole words has at
    most n items, so its grains fit and the choice found has no fewer; both sums are under
    n grains more than counted. So the sum found is less than n grains from the best one,
    on either side.
    """
    items = split(lengths, counts, budget)
    g = grain(len(items), budget)
    if g == 1:
        return reached(items, len(lengths), budget)
    found = sparse_knapsack(lengths, counts, budget)
    return found if found is not None else reached([(k, n, words // g) for k, n, words in items if words >= g], len(lengths), budget // g)


def shares(lengths: list[int], counts: list[int], budget: int, offset: float) -> list[int]:
    """The same share of every length's documents, below budget in sum.

    Shares are rounded at one running sum over the lengths, shortest first, so that rare
    lengths get their part too; offset, 0 to 1, says where the rounding begins.
    """
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    order = sorted(range(len(lengths)), key=lambda k: lengths[k])
    take, run, last = [0] * len(lengths), int(offset * (total - 1)), 0
    for k in order:
        run += counts[k] * budget
        take[k], last = run // total - last, run // total
    over = sum(a * b for a, b in zip(lengths, take, strict=True)) - budget
    while over > 0:
        held = [k for k in order if take[k]]
        k = next((k for k in held if lengths[k] >= over), held[-1])
        take[k] -= 1
        over -= lengths[k]
    return take


def fit(lengths: list[int], counts: list[int], budget: int, window: int = WINDOW, offset: float = 0.5) -> list[int]:
    """How many documents of each length come to about budget words; all lengths over 0.

    Equal shares, then the knapsack of what is left; where more than window words are
    left, the largest lengths go first. If that misses the budget, the knapsack of all
    that is left, and then of the whole budget, is solved; the choice that comes nearest
    stands. The miss against the best choice is under n * grain(n, budget) words for n
    items, and under the largest length: at BITS at most about 0.2 % of any budget.
    """
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    words = lambda n: sum(a * b for a, b in zip(lengths, n, strict=True))
    share = shares(lengths, counts, max(0, budget - window // 2), offset)  # the knapsack needs words to choose from
    best = filled(lengths, counts, share, budget, window)
    for start in (share, [0] * len(lengths)):
        if words(best) == budget:
            break
        more = whole(lengths, [c - t for c, t in zip(counts, start, strict=True)], budget - words(start))
        found = [t + m for t, m in zip(start, more, strict=True)]
        if words(found) < budget:
            found = filled(lengths, counts, found, budget, window)
        n = len(split(lengths, counts, budget))
        if words(found) > budget and budget - words(best) < n * grain(n, budget):
            continue  # nothing above the budget while what is below keeps the bound
        if abs(budget - words(found)) < abs(budget - words(best)):
            best = found
    return best


def filled(lengths: list[int], counts: list[int], share: list[int], budget: int, window: int) -> list[int]:
    """share and more: the largest lengths while over window words are left, then the knapsack."""
    take = list(share)
    left = budget - sum(a * b for a, b in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda k: lengths[k])
    sorted_lengths = [lengths[k] for k in order]
    at = len(order)
    while left > window and at:
        at = min(at, bisect_right(sorted_lengths, left))
        if not at:
            break
        k = order[at - 1]
        n = min(1, counts[k] - take[k])
        take[k] += n
        left -= n * lengths[k]
        at -= 1
    if left > window:  # one of each was not enough
        for k in reversed(order):
            n = min(counts[k] - take[k], max(0, left - window // 2) // lengths[k])
            take[k] += n
            left -= n * lengths[k]
    # Items that matter for the window: short lengths reach every sum, few of each are needed.
    room = [min(c - t, max(1, left // a)) if a <= left else 0 for a, c, t in zip(lengths, counts, take, strict=True)]
    more = knapsack(lengths, room, left)
    return [t + m for t, m in zip(take, more, strict=True)]


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """How many words the mix takes of each document.

    Returns doc_id, size (words), source_size, target (of its source), taken (words,
    repeats counted) and source. taken is a whole number of passes over the document;
    a source's sum of taken comes as near to its target as fit() says, to
    the nearest word in practice. Which documents of a length give one pass more is
    decided by a hash of seed and doc_id, so reruns agree.

    A null or empty text has size 0 and gives nothing. Null is a source of its own,
    last. Ties in the hash go by doc_id; repeated rows are documents of their own. An
    empty table gives no rows; other columns are ignored. Texts are read whole.
    """
    spark = docs.sparkSession
    rows = staged(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "doc_id").alias("draw"),
        ),
        "mix-rows",
    )
    # One row per source goes to the driver.
    sizes = {r["source"]: r["words"] for r in rows.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    goal = targets(sizes, weights, share, most)
    offset = random.Random(seed).random()
    placed = numbered(rows, ["source", "size", "draw", "doc_id"], "at", "mix-order", rows.count())
    lengths = placed.groupBy("source", "size").agg(F.count("*").alias("docs"), F.min("at").alias("begin"))

    def choose(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        name = None if pd.isna(key[0]) else key[0]
        whole, target = sizes[name], goal[name]
        passes = int(target // whole) if whole else 0
        budget = math.floor(target - passes * whole + 0.5)
        used = group[group["size"] > 0]
        more = fit(used["size"].tolist(), used["docs"].tolist(), budget, offset=offset) if len(used) else []
        group["more"] = pd.Series(more, index=used.index).reindex(group.index, fill_value=0).astype("int64")
        return group.assign(passes=passes, source_size=whole, target=float(target)).drop(columns="docs")

    plan = staged(
        lengths.groupBy("source").applyInPandas(choose, "source string, size long, begin long, more long, passes long, source_size long, target double"),
        "mix-plan",
        0,
    )
    p = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "begin", "more", "passes", "source_size", "target")
    return placed.join(p, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("passes") + (F.col("at") - F.col("begin") < F.col("more")).cast("long"))).alias("taken"),
        "source",
    )
