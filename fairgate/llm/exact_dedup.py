"""Exact deduplication with a two-pass Bloom filter.

Pass 1 folds every row's text hash into a filter of saturating two-bit cells
(0, 1, 2 or more).  A hash whose cells all reached 2 may be repeated; any
other hash is certainly unique.  Pass 2 sends only the possibly repeated
rows through a shuffle, where they are grouped on the whole SHA-256; the rest
pass straight through as groups of one.  A false positive costs a shuffled
row, never a wrong result.

Defined cases: null text counts as empty; texts that hold only white space
are equal to the empty one; an empty table gives no rows; a null ``doc_id``
is the last choice among equals; rows that repeat one ``doc_id`` with the
same text are the same document and get equal values; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .textutil import WHITE, mix64, texts_of

SEGMENT = 1 << 16          # cells of one filter segment
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 28        # 32 MB of bits at most reach the driver and the executors


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        sha = [hashlib.sha256(t.translate(None, WHITE)).digest()
               for t in text.cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.utf8_length(text).cast(pa.int64()),
             pa.array(sha, pa.binary())], ["doc_id", "n_code", "sha"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_code, sha): code points of the original text and SHA-256 of
    the text without white space.  The texts themselves go no further."""
    src = texts_of(docs, id_col, text_col)
    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_digest, f"doc_id {id_type}, n_code bigint, sha binary")


def _cells(sha: pa.Array, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filter cells of each hash (n_cells is a power of two)."""
    raw = np.frombuffer(b"".join(sha.to_pylist()), dtype="<u8").reshape(-1, 4)
    mask = np.uint64(n_cells - 1)
    return mix64(raw[:, 0]) & mask, mix64(raw[:, 1]) & mask


def _count_cells(n_cells: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _cells(batch.column("sha"), n_cells)
            b = b[a != b]                     # one row never fills one cell twice
            cells, n = np.unique(np.concatenate([a, b]), return_counts=True)
            seg = (cells // np.uint64(SEGMENT)).astype(np.int64)
            low = (cells % np.uint64(SEGMENT)).astype("<u2")
            ids, first = np.unique(seg, return_index=True)
            cut = [*first, len(seg)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([low[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                 pa.array([low[i:j][n[i:j] > 1].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
                ["segment", "once", "twice"])
    return fold


def _merge_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    """Saturating sum of one segment's cells over all batches."""
    count = np.zeros(SEGMENT, dtype=np.int64)
    for once, twice in zip(pdf["once"], pdf["twice"]):
        count[np.frombuffer(once, "<u2")] += 1
        count[np.frombuffer(twice, "<u2")] += 1
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1],
                         "bits": [np.packbits(count > 1).tobytes()]})


def repeated_filter(hashes: DataFrame, n_cells: int) -> np.ndarray:
    """Packed bits of the cells that at least two rows set: n_cells / 8 bytes
    whatever the number of rows."""
    parts = (hashes.select("sha").mapInArrow(_count_cells(n_cells), "segment bigint, once binary, twice binary")
             .groupBy("segment").applyInPandas(_merge_segment, "segment bigint, bits binary"))
    bits = np.zeros(n_cells // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():
        at = row["segment"] * (SEGMENT // 8)
        bits[at:at + SEGMENT // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def with_maybe(hashes: DataFrame, bits: np.ndarray) -> DataFrame:
    """Add ``maybe``: the filter cannot rule out that the hash is repeated."""
    shared = hashes.sparkSession.sparkContext.broadcast(bits)
    n_cells = len(bits) * 8

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            hit = np.ones(batch.num_rows, dtype=bool)
            for c in _cells(batch.column("sha"), n_cells) if batch.num_rows else ():
                c = c.astype(np.int64)
                hit &= (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "maybe"])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hashes.schema.fields)
    return hashes.mapInArrow(test, f"{ddl}, maybe boolean")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                cells_per_row: int = CELLS_PER_ROW, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest original (code points), then the smallest
    doc_id, stays.  The filter has ``cells_per_row`` cells a row up to
    ``max_cells``; beyond that bound it only lets more rows into the shuffle.
    """
    hashes = materialize(digests(docs, id_col, text_col))
    want = max(SEGMENT, hashes.count() * cells_per_row)
    n_cells = min(1 << (want - 1).bit_length(), max_cells)
    flagged = with_maybe(hashes, repeated_filter(hashes, n_cells))
    id_type = hashes.schema["doc_id"].dataType

    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))
    # Partial aggregation first: a text held by a third of the rows is one row per task.
    # Written, so that the join below has a plain shuffle on both sides and Spark can split a hot text.
    groups = materialize(flagged.where("maybe").groupBy("sha").agg(
        F.min(F.struct((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("best"),
        F.count(F.lit(1)).alias("group_size"))
        .select("sha", F.col("best.doc_id").cast(id_type).alias("keep_id"), "group_size"))
    some = flagged.where("maybe").join(groups, "sha").select(
        "doc_id", "sha", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
    return alone.unionByName(some).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
