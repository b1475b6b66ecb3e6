"""Token-id output in a byte-aligned variable-length code.

Ids are replaced by their frequency rank over all documents, so that the 256
commonest take one byte.  A rank is stored little-endian in 1 to 4 bytes; the
byte counts (two bits each, four to a control byte) are kept apart from the
data bytes.  Decoding looks up the four lengths of every control byte in a
table and gathers the data bytes with numpy.

A written folder holds ``ranks`` (the id of each rank) and ``blocks``: Parquet
files in ascending doc_id order, one block a document with its control and
data bytes, the file part it belongs to and the ids before it in that part.

Defined cases: null text counts as empty and is written as the end id alone;
rows that share a doc_id (or have none: first) stand next to each other in the
order of their content; an empty table gives an empty folder of the same
schema; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textutil import small_batches, texts_of, written
from .tokens import default_path, worker_tokenizer

END_ID = 2

#: byte counts of the four ids of each control byte
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1


def encode_ranks(ranks: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each block ranks[offsets[i]:offsets[i+1]]."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    used = np.arange(4) <= extra[:, None]
    data = ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()
    ends = np.concatenate([[0], np.cumsum(extra.astype(np.int64) + 1)])[offsets]
    control = []
    for i, j in zip(offsets, offsets[1:]):
        four = np.zeros(-(-(j - i) // 4) * 4, dtype=np.uint8)
        four[:j - i] = extra[i:j]
        four = four.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
        control.append(np.bitwise_or.reduce(four, axis=1).astype(np.uint8).tobytes())
    return control, [data[i:j] for i, j in zip(ends, ends[1:])]


def decode_ranks(control: list[bytes], data: list[bytes], counts: np.ndarray) -> np.ndarray:
    """All ranks of the blocks, one after another (a block has counts[i])."""
    lengths = LENGTHS[np.frombuffer(b"".join(control), np.uint8)].ravel()
    slots = -(-counts // 4) * 4               # a block's control bytes are filled up to four ids
    ends = np.cumsum(slots)
    real = np.arange(len(lengths)) - np.repeat(ends - slots, slots) < np.repeat(counts, slots)
    lengths = lengths[real]
    raw = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8)
    at = np.cumsum(lengths) - lengths
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def token_table(docs: DataFrame, path: str, end_id: int = END_ID,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): every text's ids with the end id, as bytes of
    little-endian unsigned 16-bit numbers (32-bit where an id needs them),
    written once: the ids are counted, then encoded, from this table."""
    src = texts_of(docs, id_col, text_col)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path)
        for batch in small_batches(batches, limit=4 << 20, keep=True):
            ids, offsets = tok.encode(batch.column("text"))
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            kind = "<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4"
            raw, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()),
                 pa.array([raw[width * i:width * j] for i, j in zip(offsets, offsets[1:])], pa.binary())],
                ["doc_id", "n_tokens", "ids"])

    id_type = src.schema["doc_id"].dataType.simpleString()
    return written(src.mapInArrow(tokenise, f"doc_id {id_type}, n_tokens bigint, ids binary"), "token-ids", compression="zstd")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of the token table, and the documents' offsets."""
    n = batch.column("n_tokens").to_numpy()
    values = batch.column("ids").to_pylist()
    parts = [np.frombuffer(v, "<u2" if len(v) == 2 * k else "<u4") for v, k in zip(values, n)]
    return np.concatenate(parts).astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each token id occurs in all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in small_batches(batches, "ids", keep=True):
            found = np.bincount(_ids(batch)[0], minlength=len(total))
            found[:len(total)] += total
            total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return (tokens.select("n_tokens", "ids").mapInArrow(count, "id bigint, n bigint")
            .groupBy("id").agg(F.sum("n").alias("n")))


def write_token_files(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the folder ``out`` (on storage that all executors share)."""
    spark = docs.sparkSession
    tokens = token_table(docs, path or default_path(), end_id, id_col, text_col)
    # the vocabulary bounds this list, whatever the number of documents
    order = [(r["id"], r["n"]) for r in id_counts(tokens).collect()]
    order = np.array([i for i, _ in sorted(order, key=lambda x: (-x[1], x[0]))], dtype=np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    rank_of[order] = np.arange(len(order))
    spark.createDataFrame(list(enumerate(order.tolist())), "rank bigint, id bigint").coalesce(1).write.parquet(f"{out}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "ids", 4 << 20, keep=True):
            ids, offsets = _ids(batch)
            control, data = encode_ranks(shared.value[ids], offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_tokens"), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                ["doc_id", "n_tokens", "control", "data"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = before + np.cumsum(batch.column("n_tokens").to_numpy())
            start = ends - batch.column("n_tokens").to_numpy()
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(start, pa.int64()), *batch.columns],
                ["part", "start_in_part", *batch.schema.names])

    ddl = f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, control binary, data binary"
    coded = tokens.mapInArrow(encode, ddl)
    keys = ["doc_id", "n_tokens", F.crc32("data")]
    ordered = coded.repartitionByRange(*keys).sortWithinPartitions(*keys)
    (ordered.mapInArrow(place, f"part int, start_in_part bigint, {ddl}")
     .write.option("compression", "none").parquet(f"{out}/blocks"))


def read_token_files(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and either
    ``ids`` (array of all ids) or ``ids_crc32`` (of them as little-endian
    unsigned 32-bit integers), decoded from the files of ``folder``."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    ranks = spark.read.parquet(f"{folder}/ranks").collect()     # one row per vocabulary id
    ids_of = np.zeros(len(ranks), dtype="<u4")
    for r in ranks:
        ids_of[r["rank"]] = r["id"]
    shared = spark.sparkContext.broadcast(ids_of)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data", 2 << 20, keep=True):
            counts = batch.column("n_tokens").to_numpy()
            ids = shared.value[decode_ranks(batch.column("control").to_pylist(), batch.column("data").to_pylist(), counts)]
            ends = np.cumsum(counts)
            if digest:
                raw = ids.tobytes()
                out = pa.array([zlib.crc32(memoryview(raw)[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), counts.tolist())], pa.int64())
            else:
                out = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), pa.array(ids.astype(np.int64)))
                out = out.cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("part", "start_in_part", "doc_id", "n_tokens")] + [out],
                ["part", "start_in_part", "doc_id", "n_tokens", result])

    result = "ids_crc32" if digest else "ids"
    id_type = blocks.schema["doc_id"].dataType.simpleString()
    kind = "bigint" if digest else "array<bigint>"
    rows = blocks.mapInArrow(decode, f"part int, start_in_part bigint, doc_id {id_type}, n_tokens bigint, {result} {kind}")
    # one row per file part, so the running total of the parts is small
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))
    return rows.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", result)
