"""Expectation suite and schema validation.

All expectations are evaluated by one aggregate over the table; the
results are fanned out with ``stack`` into (expectation, column, success,
value) rows.  Column existence is a schema test on the driver (no data).
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_as_null, q, stack
from ..spec import DatasetSpec, columns_of
from .profile import numeric_as_text


def expectations(df: DataFrame, spec: DatasetSpec | None = None,
                 target_not_null: bool = True,
                 numeric_not_null: bool = False,
                 in_set: Mapping[str, Sequence] | None = None,
                 expected_columns: Sequence[str] | None = None,
                 row_count_between: tuple[int | None, int | None] = (1, None)) -> DataFrame:
    """F2-F6 as rows: expectation, column, success, value.

    * F2 'Target not null' on ``spec.target`` (value = NULL count)
    * F3 'Column values not null' on every numeric column (optional)
    * F4 'Column values in set' (NULLs pass; value = count outside the set)
    * F5 'Column exists' for each expected column — failures only
    * F6 'Row count valid' between the bounds (upper bound None = no bound;
      the reference's 2 x rows bound can only fail on an empty table)
    """
    df = nan_as_null(df)
    cols = set(df.columns)
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    null_str = F.lit(None).cast("string")
    if target_not_null and spec is not None and spec.target in cols:
        aggs.append(F.count_if(q(spec.target).isNull()).alias("_t"))
        rows.append(("Target not null", F.lit(spec.target), F.col("_t") == 0, F.col("_t")))
    if numeric_not_null:
        for i, c in enumerate(columns_of(df, "numeric")):
            aggs.append(F.count_if(q(c).isNull()).alias(f"_n{i}"))
            rows.append(("Column values not null", F.lit(c), F.col(f"_n{i}") == 0, F.col(f"_n{i}")))
    for i, (c, values) in enumerate((in_set or {}).items()):
        if c not in cols:
            continue
        bad = q(c).isNotNull() & ~q(c).isin(list(values))
        aggs.append(F.count_if(bad).alias(f"_s{i}"))
        rows.append(("Column values in set", F.lit(c), F.col(f"_s{i}") == 0, F.col(f"_s{i}")))
    for c in expected_columns or []:
        if c not in cols:
            rows.append(("Column exists", F.lit(c), F.lit(False), F.lit(None)))
    lo, hi = row_count_between
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col("_rows") >= int(lo))
    if hi is not None:
        ok = ok & (F.col("_rows") <= int(hi))
    rows.append(("Row count valid", null_str, ok, F.col("_rows")))
    return df.agg(*aggs).select(stack(
        [(F.lit(e), c, s, v.cast("double")) for e, c, s, v in rows],
        ["expectation", "column", "success", "value"]))


def expectations_from_counts(counts: DataFrame, spec: DatasetSpec, df_columns: Sequence[str],
                             expected_columns: Sequence[str] | None = None) -> DataFrame:
    """F2, F5, F6 (the pipeline's suite) from ``stats.null_flag_counts``
    (target as ``b``) without another scan: target NULLs are rows with
    ``b`` NULL, the row count is any column's total."""
    per = counts.groupBy("column").agg(
        F.sum("n").alias("_rows"),
        F.sum(F.when(F.col("b").isNull(), F.col("n")).otherwise(0)).alias("_t"))
    row = per.agg(F.coalesce(F.max("_rows"), F.lit(0)).alias("_rows"),
                  F.coalesce(F.max("_t"), F.lit(0)).alias("_t"))
    rows = [("Target not null", F.lit(spec.target), F.col("_t") == 0, F.col("_t"))]
    for c in expected_columns or []:
        if c not in df_columns:
            rows.append(("Column exists", F.lit(c), F.lit(False), F.lit(None)))
    rows.append(("Row count valid", F.lit(None).cast("string"), F.col("_rows") >= 1,
                 F.col("_rows")))
    return row.select(stack([(F.lit(e), c, s, v.cast("double")) for e, c, s, v in rows],
                            ["expectation", "column", "success", "value"]))


def expectation_summary(results: DataFrame) -> DataFrame:
    """Passed, total, status PASS / FAIL, overall success."""
    return results.agg(F.count_if(F.col("success")).alias("passed"),
                       F.count(F.lit(1)).alias("total")).select(
        "passed", "total",
        F.when(F.col("passed") == F.col("total"), F.lit("PASS")).otherwise(F.lit("FAIL"))
        .alias("status"),
        (F.col("passed") == F.col("total")).alias("success"))


def schema_validation(df: DataFrame, nat: DataFrame | None = None) -> DataFrame:
    """Status WARNING when any text column holds only numbers (F9),
    else PASS; ``issues`` lists '<col>: numeric data stored as string'.
    ``nat`` may pass a ready F9 table (the audit computes it once)."""
    nat = nat if nat is not None else numeric_as_text(df)
    issues = nat.where(F.col("numeric_as_text")).select(
        F.format_string("%s: numeric data stored as string", F.col("column")).alias("issue"))
    return issues.agg(F.array_sort(F.collect_list("issue")).alias("issues")).select(
        F.when(F.size("issues") > 0, F.lit("WARNING")).otherwise(F.lit("PASS")).alias("status"),
        "issues")
