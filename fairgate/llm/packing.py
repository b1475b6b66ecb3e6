"""Packing token streams into windows by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into pieces; pieces of a whole
window stand alone, the others are dealt to buckets of about
``windows_per_bucket`` windows.  Within a bucket the method starts from one
partial partition per piece (its length in one slot, zero in the others),
repeatedly takes the two partials with the largest spread and merges them with
opposing imbalances (largest slot onto smallest), until one partition into
near-equal windows is left.  When a window would exceed the capacity, the
bucket gets one more window and is partitioned anew.

Defined cases: null text counts as empty and gives one piece, the end id;
every row is a document of its own, also when rows share a ``doc_id`` or have
none; an empty table gives no rows; very long texts give many pieces; other
columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .textutil import small_batches, texts_of
from .tokens import default_path, worker_tokenizer

WINDOW = 2048
END_ID = 1


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: the slot (0..k-1) of each length in a near-equal
    partition into ``k`` sums."""
    n = len(lengths)
    parent = np.arange(n)
    # A partial: slot sums in descending order (smallest subtracted), and one item of each slot (-1: none).
    heap = []
    for i, x in enumerate(lengths):
        sums, root = np.zeros(k, dtype=np.int64), np.full(k, -1)
        sums[0], root[0] = x, i
        if k == 1:
            sums[0] = 0
        heap.append((-int(sums[0]), i, sums, root))
    heapq.heapify(heap)
    mark = n
    while len(heap) > 1:
        _, _, a, ra = heapq.heappop(heap)
        _, _, b, rb = heapq.heappop(heap)
        b, rb = b[::-1], rb[::-1]
        both = (ra >= 0) & (rb >= 0)
        parent[rb[both]] = ra[both]           # the two slots' pieces now share a window
        root = np.where(ra >= 0, ra, rb)
        sums = a + b
        order = np.argsort(-sums, kind="stable")
        sums, root = sums[order], root[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), mark, sums, root))
        mark += 1
    while True:                               # path halving for all at once
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def windows_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each piece: as few near-equal windows as differencing finds
    without exceeding ``capacity``."""
    if not len(lengths):
        return np.zeros(0, dtype=np.int64)
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        slot = differencing(lengths, min(k, len(lengths)))
        if np.bincount(slot, weights=lengths).max() <= capacity:
            return slot
        k += 1


def pieces(docs: DataFrame, path: str, window: int = WINDOW, max_piece: int = WINDOW,
           end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): a document is cut into
    whole windows, and the rest into pieces of ``max_piece`` at most."""
    src = texts_of(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for batch in small_batches(batches, limit=4 << 20, keep=True):
            ids, offsets = tok.encode(batch.column("text"))
            raw = ids.astype("<u4").tobytes()
            row, start, length, crc, total = [], [], [], [], []
            for i in range(batch.num_rows):
                n = int(offsets[i + 1] - offsets[i]) + 1
                data = raw[4 * offsets[i]:4 * offsets[i + 1]] + tail
                whole = n - n % window
                at = 0
                while at < n:
                    end = at + window if at < whole else min(n, at + max_piece)
                    row.append(i)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(memoryview(data)[4 * at:4 * end]))
                    total.append(n)
                    at = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(total, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(cut, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _pack_bucket(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    pdf = pdf.sort_values("key", kind="stable").reset_index(drop=True)
    length = pdf["length"].to_numpy()
    whole = length == window
    seq = np.empty(len(pdf), dtype=np.int64)
    seq[whole] = np.arange(whole.sum())
    seq[~whole] = whole.sum() + windows_of(length[~whole], window)
    order = np.lexsort((np.arange(len(pdf)), seq))
    ends = np.cumsum(length[order])
    first = np.concatenate([[True], np.diff(seq[order]) != 0])
    base = np.maximum.accumulate(np.where(first, ends - length[order], 0))
    offset = np.empty(len(pdf), dtype=np.int64)
    offset[order] = ends - length[order] - base
    tokens = np.bincount(seq, weights=length).astype(np.int64)[seq]
    power = (tokens & (tokens - 1)) == 0
    return pdf.assign(sequence_id=pdf["bucket"] * 2**32 + seq, offset=offset, sequence_tokens=tokens,
                      padded_tokens=np.where(power, tokens, window)).drop(columns=["bucket", "key"])


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, max_piece: int = WINDOW // 4,
         windows_per_bucket: int = 160, pieces_per_bucket: int = 8_000, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_tokens, padded_tokens (a window, or the
    sequence's own length where that is a power of two)."""
    cut = materialize(pieces(docs, path or default_path(), window, max_piece, end_id, id_col, text_col))
    total, count = cut.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    # bounded in pieces too: very many short documents fill few windows
    buckets = max(1, round(total / (windows_per_bucket * window)), -(-count // pieces_per_bucket))
    # the row's place in the checkpoint is a key that repeats for no row
    keyed = cut.withColumn("key", F.monotonically_increasing_id())
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return keyed.groupBy("bucket").applyInPandas(
        lambda pdf: _pack_bucket(pdf, window),
        f"{ddl}, sequence_id bigint, offset bigint, sequence_tokens bigint, padded_tokens bigint")
