"""Table profile: shape and types, preview, missing values, distinct
counts, quartiles, outliers, duplicates, numeric-stored-as-text and the
quality roll-up (P1-P6, A5, A7, A8, F9, A9).

Each check is one aggregation over the table (all columns at once through
a wide ``agg`` or an unpivot), never a loop of per-column jobs.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q, ratio, round2_like_numpy, stack, to_long
from ..functions.text import NUMERIC_TEXT_PATTERN
from ..spec import DatasetSpec, Thresholds, columns_of
from .cube import ValueCube
from .ordering import count_values, exact_quantiles, shared


def overview(df: DataFrame) -> DataFrame:
    """One row per column: column, position, data_type, n_rows,
    n_columns (the row count is one aggregate, fanned out by ``stack``)."""
    fields = df.schema.fields
    counted = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(
        stack([(F.lit(f.name), F.lit(i), F.lit(f.dataType.simpleString()))
               for i, f in enumerate(fields)], ["column", "position", "data_type"]),
        "n_rows", F.lit(len(fields)).alias("n_columns"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows in an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*[q(c) for c in order_by]).limit(n)


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    """rows where ``column`` is not NULL (NaN counts as NULL)."""
    c = q(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return df.where(c.isNotNull() & ~F.isnan(c))
    return df.where(c.isNotNull())


def column_means(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column, mean — one aggregate for all numeric columns, NULL/NaN
    skipped."""
    cols = list(columns) if columns is not None else columns_of(df, "numeric")
    return numeric_long(df, cols).groupBy("column").agg(F.avg("value").alias("mean"))


def _null_count(f: T.StructField):
    c = q(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return F.count_if(c.isNull() | F.isnan(c))
    return F.count_if(c.isNull())


def missing_by_column(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Column, missing_count, missing_percent (half-even, 2 places),
    columns with missing values only, most-missing first (L3).  One
    aggregate."""
    fields = df.schema.fields
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[_null_count(f).alias(f"_m{i}") for i, f in enumerate(fields)])
    long = agg.select(stack([(F.lit(f.name), F.col(f"_m{i}")) for i, f in enumerate(fields)],
                            ["column", "missing_count"]), "_rows")
    out = long.select(
        "column", "missing_count",
        round2_like_numpy(ratio(F.col("missing_count"), F.col("_rows")) * 100.0)
        .alias("missing_percent"))
    if only_missing:
        out = out.where(F.col("missing_count") > 0)
    return out.orderBy(F.desc("missing_percent"), "column")


def missing_total(df: DataFrame) -> DataFrame:
    """Total missing cells as a percentage of rows x columns (NULL for
    an empty table).  Columns: n_rows, n_cells, n_missing, missing_pct."""
    fields = df.schema.fields
    total_missing = sum((_null_count(f) for f in fields), F.lit(0)) if fields else F.lit(0)
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), total_missing.alias("n_missing"))
    n_cells = F.col("n_rows") * F.lit(len(fields))
    return agg.select("n_rows", n_cells.alias("n_cells"), "n_missing",
                      (ratio(F.col("n_missing"), n_cells) * 100.0).alias("missing_pct"))


def missing_total_from_counts(counts: DataFrame, n_columns: int) -> DataFrame:
    """P3 from ``stats.null_flag_counts``: no extra scan.  Every column's
    counts add up to the row count, and the target's missing cells are the
    rows whose ``b`` is NULL (read off any one column)."""
    per = counts.groupBy("column").agg(
        F.sum("n").alias("_rows"),
        F.sum(F.when(F.col("a") == 1, F.col("n")).otherwise(0)).alias("_miss"),
        F.sum(F.when(F.col("b").isNull(), F.col("n")).otherwise(0)).alias("_tnull"))
    # every column's counts sum to the same row count and target-NULL count
    row = per.agg(F.coalesce(F.max("_rows"), F.lit(0)).cast("long").alias("n_rows"),
                  F.coalesce(F.sum("_miss"), F.lit(0)).alias("_miss_all"),
                  F.coalesce(F.max("_tnull"), F.lit(0)).alias("_tnull"))
    n_cells = F.col("n_rows") * F.lit(n_columns)
    n_missing = (F.col("_miss_all") + F.col("_tnull")).cast("long")
    return row.select("n_rows", n_cells.alias("n_cells"), n_missing.alias("n_missing"),
                      (ratio(n_missing, n_cells) * 100.0).alias("missing_pct"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Column, n_distinct (NULLs excluded), exact: one unpivot, one
    groupBy(column, value), one count per column."""
    cols = list(columns) if columns is not None else df.columns
    vals = count_values(to_long(df, cols)).where(F.col("value").isNotNull())
    return vals.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value double) for numeric columns; NaN becomes NULL."""
    long = to_long(df, columns, "double")
    return long.withColumn("value", F.when(F.isnan("value"), F.lit(None))
                           .otherwise(F.col("value")))


def quartiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A5: column, q1, q3, iqr — exact, linear interpolation, NULLs skipped."""
    cols = list(columns) if columns is not None else columns_of(df, "numeric")
    qs = exact_quantiles(numeric_long(df, cols), [0.25, 0.75])
    wide = qs.groupBy("column").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q3"))
    return wide.withColumn("iqr", F.col("q3") - F.col("q1"))


def outliers(df: DataFrame, columns: Sequence[str] | None = None,
             thresholds: Thresholds | None = None) -> DataFrame:
    """Values outside [Q1 - k*IQR, Q3 + k*IQR] per numeric column; the
    share is over *all* rows and a warning is set above the threshold.
    Columns: column, q1, q3, lower, upper, n_outliers, n_rows,
    outlier_pct, warning.  The fences come from the quantiles; one more
    aggregate over the table counts what lies outside."""
    th = thresholds or Thresholds()
    cols = list(columns) if columns is not None else columns_of(df, "numeric")
    values = numeric_long(df, cols)
    qs = exact_quantiles(values, [0.25, 0.75])
    fences = (qs.groupBy("column").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q3"))
        .withColumn("lower", F.col("q1") - th.outlier_iqr_k * (F.col("q3") - F.col("q1")))
        .withColumn("upper", F.col("q3") + th.outlier_iqr_k * (F.col("q3") - F.col("q1"))))
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    # Fences: one row per column, a bounded broadcast side.
    per_col = values.join(F.broadcast(fences), "column", "left").groupBy(
        "column", "q1", "q3", "lower", "upper").agg(
        F.count_if(outside).alias("n_outliers"), F.count(F.lit(1)).alias("n_rows"))
    pct = ratio(F.col("n_outliers"), F.col("n_rows")) * 100.0
    warn = F.when(F.col("n_outliers") > F.col("n_rows") * th.outlier_warn_share,
                  F.format_string("%s: %.1f%% outliers", F.col("column"), pct))
    return per_col.select("column", "q1", "q3", "lower", "upper", "n_outliers",
                          "n_rows", pct.alias("outlier_pct"), warn.alias("warning"))


def _hashable(f: T.StructField):
    """Column as hashed for duplicate search: float -0.0 folded into 0.0 so
    that values equal under grouping hash equally (NaN hashes canonically)."""
    c = q(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
    return c


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows equal to an earlier row on all (or the given) columns, NULLs
    equal.  Columns: n_rows, n_distinct, n_duplicates.

    Exact, in two phases so that full rows are shuffled only when they may
    be copies: (1) count rows per 64-bit row hash — a row whose hash is
    unique cannot be a duplicate; (2) only rows whose hash repeats (true
    copies plus rare collisions) are grouped on their full content.  The
    repeated hashes are written first, so the semi-join has a plain shuffle
    on both sides and Spark splits a hot hash; the grouping by content takes
    its own partial aggregate, so copies collapse in every task before they
    meet."""
    fields = [df.schema[c] for c in (columns or df.columns)]
    cols = [q(f.name) for f in fields]
    hashed = df.select(*cols, F.xxhash64(*[_hashable(f) for f in fields]).alias("_h"))
    per_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    stats = per_hash.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                         F.count_if(F.col("_n") == 1).alias("_singles"))
    repeated = shared(per_hash.where(F.col("_n") > 1).select("_h"))
    # not keyed by _h: the join's partitioning does not serve this grouping,
    # so partial counts come before its own exchange
    groups = (hashed.join(repeated, "_h", "left_semi")
              .groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")))
    cand = groups.agg(F.count(F.lit(1)).alias("_groups"),
                      F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))
    # two one-row aggregates side by side: a union + one aggregate, no cross join
    parts = (stats.select(F.lit("s").alias("_k"), "n_rows", "_singles",
                          F.lit(None).cast("long").alias("_groups"),
                          F.lit(None).cast("long").alias("n_duplicates"))
             .unionByName(cand.select(F.lit("c").alias("_k"), F.lit(None).cast("long").alias("n_rows"),
                                      F.lit(None).cast("long").alias("_singles"), "_groups",
                                      "n_duplicates")))
    row = parts.agg(*[F.max(c).alias(c) for c in ["n_rows", "_singles", "_groups", "n_duplicates"]])
    return row.select(F.col("n_rows").cast("long").alias("n_rows"),
                      (F.col("_singles") + F.col("_groups")).cast("long").alias("n_distinct"),
                      F.col("n_duplicates").cast("long").alias("n_duplicates"))


def numeric_as_text(df: DataFrame, columns: Sequence[str] | None = None, cube: ValueCube | None = None) -> DataFrame:
    """text columns whose non-NULL values all parse as numbers (pandas
    ``to_numeric`` grammar), by a full scan.  Columns: column, n_values,
    n_numeric, numeric_share, numeric_as_text."""
    cols = list(columns) if columns is not None else columns_of(df, "text")
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, n_values bigint, n_numeric bigint, "
                "numeric_share double, numeric_as_text boolean")
    if cube is not None and cube.has(cols):
        long = cube.of(cols).select("column", F.col("a").alias("value"), "n")
    else:
        long = to_long(df, cols).withColumn("n", F.lit(1).cast("bigint"))
    agg = long.where(F.col("value").isNotNull()).groupBy("column").agg(
        F.sum("n").alias("n_values"),
        F.sum(F.when(F.col("value").rlike(NUMERIC_TEXT_PATTERN), F.col("n")).otherwise(0)).alias("n_numeric"))
    return agg.select(
        "column", "n_values", "n_numeric",
        ratio(F.col("n_numeric"), F.col("n_values")).alias("numeric_share"),
        ((F.col("n_values") > 0) & (F.col("n_numeric") == F.col("n_values")))
        .alias("numeric_as_text"))


def quality_checks(df: DataFrame, spec: DatasetSpec | None = None,
                   nat: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """A9 detail rows: check, passed (NULL = neither), value, warning.

    duplicates: passed iff none; missing: passed iff < 30% (else a warning,
    neither passed nor failed); types: one failed check whatever the number
    of numeric-as-text columns, one warning per column; outliers: warnings
    only."""
    th = (spec or DatasetSpec(target=None)).thresholds
    spark = df.sparkSession
    dup = duplicate_rows(df).select(
        F.lit("duplicates").alias("check"),
        (F.col("n_duplicates") == 0).alias("passed"),
        F.col("n_duplicates").cast("double").alias("value"),
        F.when(F.col("n_duplicates") > 0,
               F.format_string("Duplicate rows: %d", F.col("n_duplicates"))).alias("warning"))
    miss = (missing if missing is not None else missing_total(df)).select(
        F.lit("missing").alias("check"),
        F.when(F.coalesce(F.col("missing_pct"), F.lit(0.0)) < th.missing_warn_pct,
               F.lit(True)).alias("passed"),
        F.col("missing_pct").alias("value"),
        F.when(F.col("missing_pct") >= th.missing_warn_pct,
               F.format_string("High missing data: %.2f%%", F.col("missing_pct")))
        .alias("warning"))
    nat = nat if nat is not None else numeric_as_text(df)
    types_summary = nat.agg(F.count_if(F.col("numeric_as_text")).alias("_bad")).select(
        F.lit("types").alias("check"), (F.col("_bad") == 0).alias("passed"),
        F.col("_bad").cast("double").alias("value"), F.lit(None).cast("string").alias("warning"))
    types_warn = nat.where(F.col("numeric_as_text")).select(
        F.lit("types_column").alias("check"), F.lit(None).cast("boolean").alias("passed"),
        F.col("numeric_share").alias("value"),
        F.format_string("%s: numeric as string", F.col("column")).alias("warning"))
    num_cols = columns_of(df, "numeric")
    parts = [dup, miss, types_summary, types_warn]
    if num_cols:
        parts.append(outliers(df, num_cols, th).where(F.col("warning").isNotNull()).select(
            F.lit("outliers").alias("check"), F.lit(None).cast("boolean").alias("passed"),
            F.col("outlier_pct").alias("value"), "warning"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_rollup(checks: DataFrame) -> DataFrame:
    """A9 roll-up: total_checks (always 3), passed, failed, n_warnings."""
    main = F.col("check").isin("duplicates", "missing", "types")
    return checks.agg(
        F.count_if(main).alias("total_checks"),
        F.count_if(main & (F.col("passed") == True)).alias("passed"),  # noqa: E712
        F.count_if(main & (F.col("passed") == False)).alias("failed"),  # noqa: E712
        F.count_if(F.col("warning").isNotNull()).alias("n_warnings"))
