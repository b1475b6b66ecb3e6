"""Periodic runs of words by enumeration of maximal pairs.

A run is a stretch of words with smallest period q (words q apart are equal),
of at least ``min_length`` words and ``min_exponent`` periods, that no
neighbouring word extends.  Shifted by q it matches itself, so it is a pair of
places (start, start + q) with length - q equal words from there on, different
words before them and different words behind: a maximal pair.  The other way
round, a maximal pair whose distance d and number of equal words l satisfy
(min_exponent - 1) d <= l is such a stretch with period d, already as long as
it gets.  A stretch found with several periods keeps the smallest.

Per document the maximal pairs come from the tree of LCP intervals, walked
bottom-up: every interval holds its places in lists by the word to their left;
when two children of an interval meet, places of different lists at most
l / (min_exponent - 1) apart are maximal pairs of l words.  The smaller child
moves into the larger one.

Places that can be in no such pair never enter the tree: those whose next
words stand nowhere else in the document or only too far away, and those whose
next words always have the same word to the left.  All documents of an Arrow
batch are ranked together (prefix doubling, the document being part of the
first rank), so that only the few remaining places cost Python steps.  No rows
are shuffled.

Defined cases: null or empty texts have no words and no runs; their collapsed
text is empty.  Equal rows give equal rows; null ids are kept; a text of any
length is one document and is never cut; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .textutil import small_batches, texts_of, words_of

_BLOCK = 4 << 20            # bytes of text ranked together


def _ranks(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (both non-negative)."""
    _, rank = np.unique(major * (int(minor.max(initial=0)) + 1) + minor, return_inverse=True)
    return rank.astype(np.int64)


def _doubled(rank: np.ndarray, step: int, ends: np.ndarray) -> np.ndarray:
    """Ranks of twice ``step`` words from ranks of ``step`` words; a text's end ranks first."""
    after = np.zeros(len(rank), dtype=np.int64)
    inside = np.flatnonzero(np.arange(len(rank)) + step < ends)
    after[inside] = rank[inside + step] + 1
    return _ranks(rank, after)


def _likely(rank: np.ndarray, left: np.ndarray, sizes: np.ndarray, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, ascending, that may be in a pair, and the distance of the
    nearest place of equal rank: near enough for their text's length, and not
    all with the same left word."""
    order = np.argsort(rank, kind="stable")
    gap = np.where(rank[order][1:] == rank[order][:-1], np.diff(order), np.iinfo(np.int64).max)
    nearest = np.minimum(np.concatenate([gap[:1] * 0 + np.iinfo(np.int64).max, gap]), np.concatenate([gap, gap[:1] * 0 + np.iinfo(np.int64).max]))
    near = nearest <= sizes[order] // min_exponent
    order, nearest = order[near], nearest[near]
    if not len(order):
        return order, nearest
    first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
    mixed = np.minimum.reduceat(left[order], first) != np.maximum.reduceat(left[order], first)
    keep = np.repeat(mixed, np.diff(np.concatenate([first, [len(order)]])))
    order, nearest = order[keep], nearest[keep]
    by = np.argsort(order)
    return order[by], nearest[by]


def _equal_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal words from each place of ``a`` and of ``b`` (levels: ranks of 1, 2, 4, ... words)."""
    n, same = len(levels[0]), np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + same, b + same
        inside = np.flatnonzero((i < n) & (j < n))
        equal = inside[levels[k][i[inside]] == levels[k][j[inside]]]
        same[equal] += 1 << k
    return same


def _maximal_pairs(places: list[int], lefts: list[int], equal: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(place, later place, equal words) of the maximal pairs near enough for
    a run, over places in suffix order with ``equal[t]`` words shared by t - 1 and t."""
    least = max(1, min(max(min_length - d, (min_exponent - 1) * d) for d in range(1, min_length + 1)))
    found: list[tuple[int, int, int]] = []

    def join(a: tuple[int, dict], b: tuple[int, dict], depth: int) -> tuple[int, dict]:
        big, small = (a, b) if a[0] >= b[0] else (b, a)
        reach, low = depth // (min_exponent - 1), max(1, min_length - depth)
        for word, own in small[1].items():
            for other, there in big[1].items():
                if other == word:
                    continue
                for p in own:
                    k = bisect_left(there, p - reach)
                    while k < len(there) and there[k] <= p + reach:
                        if abs(there[k] - p) >= low:
                            found.append((min(p, there[k]), max(p, there[k]), depth))
                        k += 1
        for word, own in small[1].items():
            big[1][word] = sorted(big[1][word] + own) if word in big[1] else own
        return big[0] + small[0], big[1]

    open_: list[tuple[int, tuple[int, dict]]] = []
    for t in range(len(places) + 1):
        depth = equal[t] if 0 < t < len(places) else 0
        if t:
            while open_ and open_[-1][0] > depth:
                below, node = open_.pop()
                current = join(node, current, below)
            if open_ and open_[-1][0] == depth:
                current = join(open_.pop()[1], current, depth)
            if depth >= least:
                open_.append((depth, current))
        if t < len(places):
            current = (1, {lefts[t]: [places[t]]})
    return found


def find_runs(codes: np.ndarray, offsets: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of the texts
    codes[offsets[t]:offsets[t + 1]], by text, start and period."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    if not len(text):
        return []
    least = max(1, min(max(min_length - d, (min_exponent - 1) * d) for d in range(1, min_length + 1)))
    left = np.concatenate([[-1], codes[:-1]]).astype(np.int64)
    left[offsets[:-1][sizes > 0]] = -1
    ends = np.repeat(offsets[1:], sizes)
    levels, step = [_ranks(text, codes.astype(np.int64))], 1
    while 2 * step <= least:
        levels.append(_doubled(levels[-1], step, ends))
        step *= 2
    places, _ = _likely(levels[-1], left, np.repeat(sizes, sizes), min_exponent)
    if not len(places):
        return []
    # the texts with likely places, ranked until those places differ
    there = np.unique(text[places])
    words = np.flatnonzero(np.isin(text, there))
    levels = [np.unique(r[words], return_inverse=True)[1].astype(np.int64) for r in levels]
    starts = np.concatenate([[0], np.cumsum(sizes[there])])
    ends, left = np.repeat(starts[1:], sizes[there]), left[words]
    places, nearest = _likely(levels[-1], left, np.repeat(sizes[there], sizes[there]), min_exponent)
    while len(np.unique(levels[-1][places])) < len(places):
        levels.append(_doubled(levels[-1], step, ends))
        step *= 2
    by = np.argsort(levels[-1][places])
    places, nearest = places[by], nearest[by]
    equal = np.concatenate([[0], _equal_words(levels, places[:-1], places[1:])])
    # a place takes part only if its nearest neighbour is near enough for its longest match
    kept = np.flatnonzero((min_exponent - 1) * nearest <= np.maximum(equal, np.concatenate([equal[1:], [0]])))
    if len(kept) < 2:
        return []
    equal = np.concatenate([[0], np.minimum.reduceat(equal[:kept[-1] + 1], kept[:-1] + 1)])
    places = places[kept]
    runs: dict[tuple[int, int], int] = {}
    for a, b, same in _maximal_pairs(places.tolist(), left[places].tolist(), equal.tolist(), min_length, min_exponent):
        if (min_exponent - 1) * (b - a) <= same:
            key = (a, b + same)
            runs[key] = min(b - a, runs.get(key, b - a))
    out = []
    for (a, b), period in runs.items():
        t = int(np.searchsorted(starts, a, side="right")) - 1
        out.append((int(there[t]), a - int(starts[t]), b - a, period))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period)
    and collapsed (the words that no run holds after its first period, joined
    by one space) of every document."""
    texts = texts_of(docs, id_col, text_col)
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, limit=_BLOCK):
            codes, offsets, words = words_of(batch.column("text"))
            runs = find_runs(codes, offsets, min_length, min_exponent)
            change = np.zeros(len(codes) + 1, dtype=np.int64)
            lists: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for t, start, length, period in runs:
                lists[t].append({"start": start, "length": length, "period": period})
                change[offsets[t] + start + period] += 1
                change[offsets[t] + start + length] -= 1
            kept = np.cumsum(change[:-1]) == 0
            at = np.concatenate([[0], np.cumsum(kept)])[offsets]
            flat = words.take(pa.array(codes[kept])) if len(words) else words
            collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), flat), pa.scalar(" ", flat.type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(item)), collapsed.cast(pa.string())],
                                             ["doc_id", "runs", "collapsed"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(scan, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
