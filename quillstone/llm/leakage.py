"""Passages of evaluation items inside a corpus (problem 7), by training suffix arrays.

Each task builds suffix arrays over shards of its own documents: texts are folded
to plain words, words become numbers, and all suffixes are put into their full
order by prefix doubling; a word of no item, and the end of a text, ends a suffix.
Every suffix of every item is searched in each shard by bisection, which gives
its longest verbatim match and all places that share a seed with it. From these,
matches are joined across changed words. A document counts for an item if a
stretch of the item that is long enough stands in it with few changes.

A seed is so short that no passage is without one: of a stretch of n words with c
changes some (n - c) / (c + 1) words in a row are unchanged.

Nothing is shuffled but the found pairs. The items are written to the shared folder in
blocks, which each task reads one after the other; the corpus is read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.folding import words
from quillstone.sources.blocks import read_blocks, write_blocks

LEAST_WORDS = 20
#: Changed words for each word of a stretch.
CHANGED = 0.15
#: Questions of fewer words must stand in a text unchanged.
LEAST_CHANGED = 5
#: Words of a shard, about; a document is never cut.
SHARD_WORDS = 1_000_000
#: Characters of items that a task holds at once, about.
BLOCK_CHARS = 16_000_000


def changes_of(least: int) -> int:
    """How many words of a stretch of ``least`` words may be changed."""
    return 0 if least < LEAST_CHANGED else max(1, math.floor(CHANGED * least))


def seed_of(least: int) -> int:
    """Words in a row that a stretch of ``least`` words has unchanged at least."""
    return -(-(least - changes_of(least)) // (changes_of(least) + 1))


def runs_of(seq: np.ndarray) -> np.ndarray:
    """How many words each suffix has up to the next 0, which ends it."""
    n = len(seq)
    ends = np.where(seq == 0, np.arange(n), n)
    return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)


def suffix_ranks(seq: np.ndarray) -> np.ndarray:
    """The place of each suffix in the order of all, by prefix doubling; equal ones share the first place of theirs. A 0 ends a suffix."""
    run = runs_of(seq)
    order = np.argsort(seq, kind="stable")
    starts = np.maximum.accumulate(np.where(np.diff(seq[order], prepend=-1) != 0, np.arange(len(seq)), 0))
    rank = np.empty(len(seq), np.int64)
    rank[order] = starts
    active, have = np.arange(len(seq)), 1
    while True:
        # of the suffixes that share a place, those are told apart further that go on
        active = active[(run[active] >= have) & (seq[active] != 0)]
        active = active[np.bincount(rank[active], minlength=1)[rank[active]] > 1]
        if not len(active):
            return rank
        after = rank[np.minimum(active + have, len(seq) - 1)] if len(seq) else rank
        by = np.lexsort((after, rank[active]))
        active, first, second = active[by], rank[active[by]], after[by]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.diff(first, prepend=-1) != 0, at, 0))
        part = np.maximum.accumulate(np.where((np.diff(first, prepend=-1) != 0) | (np.diff(second, prepend=-1) != 0), at, 0))
        rank[active] = first + part - group
        have *= 2


def common(seq: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and ``b`` share."""
    n, live, k = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        fine = (x < len(seq)) & (y < len(seq))
        fine[fine] = (seq[x[fine]] == seq[y[fine]]) & (seq[x[fine]] != 0)
        live = live[fine]
        n[live] += 1
        k += 1
    return n


class Items:
    """Evaluation items as folded words; equal texts are searched once for all their items."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        cache: dict[str, str] = {}
        self.ids: dict[str, int] = {}
        texts: dict[tuple[int, ...], set[int]] = {}
        for item, question, answer in rows:
            for n, text in enumerate((question, answer)):
                ws = words(text or "", cache)
                if ws and (n == 0 or len(ws) >= LEAST_WORDS):
                    texts.setdefault(tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in ws), set()).add(item)
        self.parts = [(sorted(own), list(ws), min(len(ws), LEAST_WORDS)) for ws, own in texts.items()]  # items, words, words that a case needs
        sizes = np.array([len(ws) + 1 for _, ws, _ in self.parts], np.int64)
        self.flat = np.array([w for _, ws, _ in self.parts for w in (*ws, 0)], np.int64)
        self.part = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.arange(len(self.flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.seed = np.array([seed_of(least) for _, _, least in self.parts], np.int64)


def _grow(item: list[int], doc: np.ndarray, i: int, d: int, step: int) -> list[tuple[int, int]]:
    """Matched places of an item from (i, d) on in one direction, each with the changes up to it."""
    found, changes, n, m = [], 0, len(item), len(doc)

    def same(a: int, b: int) -> bool:
        return 0 <= a < n and 0 <= b < m and item[a] == doc[b]

    while 0 <= i < n and 0 <= d < m:
        if item[i] == doc[d]:
            found.append((i, changes))
            i, d = i + step, d + step
            continue
        for far in (1, 2, 3):
            ways = [(far, far), *((far, k) for k in range(far - 1, -1, -1)), *((k, far) for k in range(far - 1, -1, -1))]
            hit = next(
                (
                    (a, b)
                    for a, b in ways
                    if same(i + step * a, d + step * b) and (same(i + step * (a + 1), d + step * (b + 1)) or i + step * (a + 1) in (-1, n))
                ),
                None,
            )
            if hit:
                i, d, changes = i + step * hit[0], d + step * hit[1], changes + far
                break
        else:
            break
    return found


def aligned(item: list[int], doc: np.ndarray, i: int, d: int, least: int) -> tuple[bool, int]:
    """Whether the alignment through (i, d) holds a long enough stretch; its last place in the item."""
    right = _grow(item, doc, i, d, 1)
    left = [(p, -c) for p, c in _grow(item, doc, i - 1, d - 1, -1)][::-1]
    place, cost = (np.array(c, np.float64) for c in zip(*(left + right)))
    if least < LEAST_WORDS:  # a whole short question: changed words at its ends count as well
        start = np.minimum.accumulate(place - cost)
        return bool((start + cost + len(item) - 1 - place <= changes_of(least)).any()), int(place[-1])
    # from place a to place b: cost b - cost a <= CHANGED * (b - a + 1)
    worth = np.maximum.accumulate(cost - CHANGED * place)
    before = np.searchsorted(place, place - least + 1, "right") - 1
    fine = before >= 0
    return bool((cost[fine] - CHANGED * place[fine] <= worth[before[fine]] + CHANGED + 1e-9).any()), int(place[-1])


def search(texts: list[tuple[int, np.ndarray]], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item, longest verbatim match in words, its first word in the text and in the item) of all leaks in a shard.

    texts: numbers of the words by ``items.ids``, 0 for a word of no item.
    """
    if not texts or not items.parts:
        return
    docs = [t for _, t in texts]
    starts = np.cumsum([0, *(len(t) + 1 for t in docs)])
    shard = np.concatenate([x for t in docs for x in (t, np.zeros(1, np.int64))])
    both = np.concatenate([shard, items.flat])
    rank = suffix_ranks(both)
    known = np.nonzero(shard)[0]
    order = known[np.argsort(rank[known], kind="stable")]
    sorted_ranks = rank[order]
    asked = np.nonzero(items.flat)[0]
    low = np.searchsorted(sorted_ranks, rank[len(shard) + asked])
    # the longest match of a suffix stands next to where it would stand itself
    longest = np.zeros(len(asked), np.int64)
    near = np.zeros(len(asked), np.int64)
    for side in (low - 1, low):
        there = np.nonzero((side >= 0) & (side < len(order)))[0]
        n = common(both, len(shard) + asked[there], order[side[there]])
        better = n > longest[there]
        longest[there[better]], near[there[better]] = n[better], side[there[better]]
    # so do all that share its seed: neighbours in the order with that many words in common
    found = []
    run = runs_of(shard)
    for size in np.unique(items.seed):
        mine = np.nonzero((items.seed[items.part[asked]] == size) & (longest >= size))[0]
        if not len(mine):
            continue
        same = (run[order[1:]] >= size) & (run[order[:-1]] >= size)
        for k in range(size):
            same[same] = shard[order[1:][same] + k] == shard[order[:-1][same] + k]
        edges = np.concatenate([[0], np.nonzero(~same)[0] + 1, [len(order)]])
        group = np.searchsorted(edges, near[mine], "right") - 1
        count = edges[group + 1] - edges[group]
        place = order[np.repeat(edges[group], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        found.append((np.repeat(asked[mine], count), place))
    if not found:
        return
    seed, place = (np.concatenate(c) for c in zip(*found))
    owner = np.searchsorted(starts, place, "right") - 1
    by = np.lexsort((items.at[seed], items.part[seed], owner))
    seed, place, owner = seed[by], place[by], owner[by]
    part, at, inside = items.part[seed], items.at[seed], place - starts[owner]
    cut = np.nonzero((np.diff(owner) != 0) | (np.diff(part) != 0))[0] + 1
    for a, b in zip([0, *cut], [*cut, len(seed)]):
        own, ws, least = items.parts[part[a]]
        doc, size = docs[owner[a]], int(items.seed[part[a]])
        # runs on one diagonal are verbatim matches
        diagonal = inside[a:b] - at[a:b]
        best, leaked, done = (0, 0, 0), False, set()
        for g in np.unique(diagonal):
            on = at[a:b][diagonal == g]
            runs = np.split(on, np.nonzero(np.diff(on) > 1)[0] + 1)
            best = max(best, *((len(r) + size - 1, -int(r[0] + g), -int(r[0])) for r in runs))
            for r in runs:
                if leaked or (g, int(r[0])) in done:
                    continue
                leaked, last = aligned(ws, doc, int(r[0]), int(r[0] + g), least)
                done |= {(g, int(x[0])) for x in runs if r[0] <= x[0] <= last}
        if leaked:
            yield from ((int(owner[a]), item, best[0], -best[1], -best[2]) for item in own)


def leaks(
    documents: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    question: str = "question",
    answer: str = "reference_answer",
) -> DataFrame:
    """(doc_id, item_id, longest_match, doc_word, item_word): the documents that hold a passage of an item.

    A passage is ``LEAST_WORDS`` consecutive words of an item's question or
    answer, or the whole of a shorter question; about one word in ten may differ,
    none in questions of fewer than ``LEAST_CHANGED`` words. ``longest_match`` has
    the words of the longest verbatim run, ``doc_word`` and ``item_word`` its first
    word, from 0, in the document and in the question or answer. Null and empty
    texts hold no passage, nor do null items; rows with a null id are left out.
    Repeated documents and items count once. Copies under other ids come out each.
    Extra columns are ignored. Empty tables give an empty table.
    """
    docs = documents.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    rows = items.select(F.col(item).cast("long").alias("i"), F.col(question).alias("q"), F.col(answer).alias("a")).where("i is not null").distinct()
    size = rows.agg(F.sum(F.coalesce(F.length("q"), F.lit(0)) + F.coalesce(F.length("a"), F.lit(0))).alias("n")).first()["n"] or 0
    folder = write_blocks(rows.repartition(1 + size // BLOCK_CHARS, "i"), "items")

    def blocks() -> Iterator[Items]:
        held, last = [], None
        for file, batch in read_blocks(folder):
            if held and file != last:
                yield Items(held)
                held = []
            held += zip(*(c.to_pylist() for c in batch.columns))
            last = file
        if held:
            yield Items(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        ids: dict[str, list[int]] = {}
        size, only = 0, None

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal only
            owners, folded = list(ids.values()), [words(t, cache) for t in ids]
            blocks_ = [only] if only else blocks()
            count = 0
            for found in blocks_:
                count += 1
                get = found.ids.get
                texts = [(n, np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))) for n, ws in enumerate(folded)]
                rows = [(d, *r) for n, *r in search(texts, found) for d in owners[n]]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "longest_match", "doc_word", "item_word"])
            if count == 1:
                only = found  # a single block is kept for the next shard

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t not in ids:
                    size += 1 + len(t) // 6
                ids.setdefault(t, []).append(d)  # equal texts of a shard are searched once
                if size >= SHARD_WORDS:
                    yield from shard()
                    ids, size = {}, 0
        if ids:
            yield from shard()

    found = docs.mapInArrow(run, "doc_id long, item_id long, longest_match int, doc_word int, item_word int")
    best = F.max(F.struct("longest_match", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.longest_match", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def without_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The documents, all columns, that hold no passage of any item. Rows with a null id stay."""
    return documents.join(leaks(documents, items, doc).select(F.col("doc_id").alias(doc)).distinct(), doc, "left_anti")
