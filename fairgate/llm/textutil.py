"""Helpers shared by the text operators: Arrow batches of bounded size,
ASCII-whitespace words as dictionary codes, and vectorised hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ASCII white space, the separator set of every word in this subpackage
WHITE = b" \t\n\v\f\r"
BATCH_BYTES = 8 << 20
#: what this Python worker keeps from task to task, until a task of other work begins
KEPT: dict[str, Any] = {}


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a documents table: null text becomes empty, every
    other column (whatever its name) stays behind, so the scan reads two."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                  limit: int = BATCH_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each (one
    row at least), which bounds the memory of vectorised text work.

    Spark leaves a Python worker idle beside later stages, so little stays in
    it: ``KEPT`` goes unless the task is to ``keep`` it, and in the end the
    memory that Arrow holds unused."""
    if not keep:
        KEPT.clear()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (maximal runs without ASCII white space) of each text: their
    codes, the word offsets of the texts, and the distinct words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if not keep.all():                       # leading or trailing white space gives empty words
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        flat = flat.filter(full)
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets, coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 in and out, bijective)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string (uint64)."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in values.cast(pa.large_binary()).to_pylist()),
                       dtype=np.uint64, count=len(values))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, and a lost executor costs no work done before."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    # Spark drops a shuffle's files once the driver's collector finds it unused
    jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
