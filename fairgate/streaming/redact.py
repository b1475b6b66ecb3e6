"""Row-stateless governance steps on Structured Streaming.

Redaction (X4/X5), binarising (J4) and bucketing (J5) are per-row
expressions, so they run unchanged on a streaming DataFrame.  PII counts
(X2) become a running aggregation: per (column, pii_type) totals kept in
the state store, emitted in update mode.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import stack, to_long
from ..functions.text import PII_TYPES, pii_spans
from ..operators.pii import anonymize
from ..session import ensure_checkpoint_dir


def redact_stream(stream: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """X4 on a stream: same expressions as the batch operator."""
    return anonymize(stream, columns)


def pii_counts_stream(stream: DataFrame, columns: Sequence[str]) -> DataFrame:
    """X2 as a running aggregation: column, pii_type, n_detections, n_rows."""
    long = to_long(stream, columns).where(F.col("value").isNotNull())
    spans = long.select("column", pii_spans(F.col("value")).alias("_spans"))
    found = spans.select("column", *[F.size(F.filter("_spans", lambda s: s["type"] == t)).alias(f"_m{i}")  # noqa: B023
                                     for i, t in enumerate(PII_TYPES)])
    per_type = found.select("column", stack(
        [(F.lit(t), F.col(f"_m{i}")) for i, t in enumerate(PII_TYPES)], ["pii_type", "n"]))
    return (per_type.groupBy("column", "pii_type")
            .agg(F.sum("n").alias("n_detections"), F.count_if(F.col("n") > 0).alias("n_rows")))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/fairgate-scratch/{name}-{uuid.uuid4().hex}"


def file_or_folder(path: str) -> str:
    """``path`` as a pattern that matches nothing else: a stream reads one
    file only by a pattern, which may as well be a folder of files."""
    head, _, name = path.rpartition("/")
    return f"{head}/{{{name}}}"


def run_redaction(spark: SparkSession, source: str, schema: T.StructType,
                  columns: Sequence[str] | None = None, output: str | None = None,
                  checkpoint: str | None = None, glob: str | None = None) -> str:
    """Redact every file arriving in the directory ``source`` (optionally
    only names matching ``glob``) into parquet at ``output``:
    exactly-once file sink with its own checkpoint; ``availableNow`` processes
    what is there and stops (schedule it, or use a processing-time trigger
    for a long-running job).  Returns the output path."""
    output = output or scratch_dir(spark, "redacted")
    checkpoint = checkpoint or scratch_dir(spark, "redacted-ckpt")
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(source)
    query = (redact_stream(stream, columns).writeStream.format("parquet")
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(output))
    query.awaitTermination()
    return output
