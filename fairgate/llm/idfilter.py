"""A Bloom filter of ids with a fixed size, for narrowing a scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textutil import hash_strings, mix64

SEGMENT = 1 << 16
MAX_CELLS = 1 << 28        # 32 MB of bits at most
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def _cells(ids: pa.Array, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    ids = ids if pa.types.is_binary(ids.type) else ids.cast(pa.string()).cast(pa.binary())
    h = hash_strings(ids.fill_null(b"\0"))
    return mix64(h) & np.uint64(n_cells - 1), mix64(h ^ _SECOND) & np.uint64(n_cells - 1)


class IdFilter:
    """``select`` passes every row whose id is in the filter, and few others.
    Two cells an id, 16 cells an id up to ``MAX_CELLS``."""

    def __init__(self, spark, bits: np.ndarray):
        self.bits, self.n_cells = spark.sparkContext.broadcast(bits), len(bits) * 8

    @classmethod
    def of(cls, rows: DataFrame, id_col: str) -> IdFilter:
        want = max(SEGMENT, rows.count() * 16)
        n_cells = min(1 << (want - 1).bit_length(), MAX_CELLS)

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = np.unique(np.concatenate(_cells(batch.column(0), n_cells)))
                segment, low = cells // np.uint64(SEGMENT), (cells % np.uint64(SEGMENT)).astype("<u2")
                ids, at = np.unique(segment.astype(np.int64), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array([low[i:j].tobytes() for i, j in zip(at, [*at[1:], len(low)])], pa.binary())],
                    ["segment", "cells"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            hit = np.zeros(SEGMENT, dtype=bool)
            for c in pdf["cells"]:
                hit[np.frombuffer(c, "<u2")] = True
            return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [np.packbits(hit).tobytes()]})

        parts = (rows.select(F.col(id_col)).mapInArrow(fold, "segment bigint, cells binary")
                 .groupBy("segment").applyInPandas(merge, "segment bigint, bits binary"))
        bits = np.zeros(n_cells // 8, dtype=np.uint8)
        for row in parts.toLocalIterator():          # n_cells / 8 bytes in all
            at = row["segment"] * (SEGMENT // 8)
            bits[at:at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
        return cls(rows.sparkSession, bits)

    def test(self, ids: pa.Array) -> np.ndarray:
        """Whether each id may be in the filter."""
        bits, hit = self.bits.value, np.ones(len(ids), dtype=bool)
        for c in _cells(ids, self.n_cells) if len(ids) else ():
            c = c.astype(np.int64)
            hit &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return hit

    def select(self, batches: Iterator[pa.RecordBatch], id_col: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = self.test(batch.column(id_col))
            if hit.any():
                yield batch.filter(pa.array(hit))
