"""PII detection and redaction over whole text columns.

Every text column is scanned in full (no first-n sample): the columns are
unpivoted, one expression of built-in functions gives the spans of all types
(patterns, checksums, overlaps resolved by score), and one ``groupBy(column)``
sums the detections.  Redaction replaces exactly these spans.  Findings carry
a hash of one example, never the raw value.

A caller may plug in a detector for types that need a model (e.g. PERSON):
a pandas UDF ``text -> array<string>`` passed as ``extra={"PERSON": udf}``.
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q, stack, to_long
from ..functions.text import PII_TYPES, pii_spans, redacted, span_texts
from ..spec import columns_of, is_text


def pii_findings(df: DataFrame, columns: Sequence[str] | None = None,
                 types: Sequence[str] | None = None,
                 extra: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Column, pii_type, n_detections, n_rows, example_hash — one row per
    (column, type) with at least one detection; ``example_hash`` is the
    60-bit md5 prefix (hex) of one match, never the raw value.  Every value
    is scanned; a caller with few large files may ``repartition`` first."""
    cols = list(columns) if columns is not None else columns_of(df, "text")
    own = [t for t in PII_TYPES if types is None or t in types]
    names = [*own, *(extra or {})]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, pii_type string, n_detections bigint, "
                "n_rows bigint, example_hash string")
    long = to_long(df, cols).where(F.col("value").isNotNull())
    # the spans are a column of their own, so that every type reads the same ones
    spans = long.select("column", "value", pii_spans(F.col("value"), own).alias("_spans"))
    match = lambda t: (extra or {})[t](F.col("value")) if t in (extra or {}) else span_texts(F.col("value"), F.col("_spans"), t)
    found = spans.select("column", *[match(t).alias(f"_m{i}") for i, t in enumerate(names)])
    aggs = []
    for i, _ in enumerate(names):
        m = F.col(f"_m{i}")
        # the example is identified by a number (the smallest 60-bit md5
        # prefix among the matches): numeric aggregates keep the whole
        # aggregation hash-based (a string min would sort every text row)
        ids = F.transform(m, lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long"))
        aggs += [F.sum(F.size(m)).alias(f"_n{i}"),
                 F.count_if(F.size(m) > 0).alias(f"_r{i}"),
                 F.min(F.array_min(ids)).alias(f"_e{i}")]
    per_col = found.groupBy("column").agg(*aggs)
    long_out = per_col.select("column", stack(
        [(F.lit(t), F.col(f"_n{i}"), F.col(f"_r{i}"), F.col(f"_e{i}")) for i, t in enumerate(names)],
        ["pii_type", "n_detections", "n_rows", "_ex"]))
    return (long_out.where(F.col("n_detections") > 0)
            .select("column", "pii_type", F.col("n_detections").cast("long").alias("n_detections"),
                    F.col("n_rows").cast("long").alias("n_rows"),
                    F.lpad(F.lower(F.hex(F.col("_ex"))), 15, "0").alias("example_hash")))


def pii_columns(findings: DataFrame) -> DataFrame:
    """Columns with any detection: column, n_detections, pii_types."""
    return findings.groupBy("column").agg(
        F.sum("n_detections").alias("n_detections"),
        F.array_sort(F.collect_set("pii_type")).alias("pii_types"))


def anonymize(df: DataFrame, columns: Sequence[str] | None = None,
              types: Sequence[str] | None = None) -> DataFrame:
    """Redact PII in the given text columns (default: every text column —
    a column without detections comes back unchanged, so no detection pass
    is needed to choose them).  Columns that are absent or not text are
    skipped; NULLs stay NULL.  Works on streaming DataFrames too."""
    wanted = set(columns) if columns is not None else None
    targets = [f.name for f in df.schema.fields
               if is_text(f.dataType) and (wanted is None or f.name in wanted)]
    # the spans of all columns in one projection, the replacements in the next
    spans = [pii_spans(q(f), types).alias(f"_spans_{i}") for i, f in enumerate(targets)]
    out = df.select(*[q(f) for f in df.columns], *spans)
    return out.select(*[redacted(q(f), F.col(f"_spans_{targets.index(f)}")).alias(f) if f in targets else q(f) for f in df.columns])
