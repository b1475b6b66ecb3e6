"""Value counts, under-represented groups, representation with outcome
rates, outcome rate by group, missing sensitive attributes
(A1, A2, A3, A4, X1).

All columns are handled in one scan: unpivot to (column, value), then one
``groupBy(column, value)``; the partial (map-side) aggregation collapses a
hot value before the shuffle.  Per-column totals are a table of one row per
column, joined by name (bounded broadcast), never a cross join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q, ratio, round2_like_numpy, to_long
from ..spec import DatasetSpec, columns_of, is_text, match_protected, normalise
from .cube import ValueCube
from .ordering import shared


def value_counts(df: DataFrame, columns: Sequence[str] | None = None,
                 dropna: bool = False) -> DataFrame:
    """A1: (column, value, count) for each text column (default) — NULL is
    kept as its own row unless ``dropna``."""
    cols = list(columns) if columns is not None else columns_of(df, "text")
    counts = (to_long(df, cols).groupBy("column", "value")
              .agg(F.count(F.lit(1)).alias("count")))
    return counts.where(F.col("value").isNotNull()) if dropna else counts


def underrepresented_groups(df: DataFrame, spec: DatasetSpec | None = None,
                            columns: Sequence[str] | None = None, cube: ValueCube | None = None) -> DataFrame:
    """A2: groups whose share of *all* rows (NULLs in the denominator),
    as a percentage rounded to 2 places the numpy way, is below the threshold.
    Every text column takes part.  Columns: column, group, count, percentage."""
    th = (spec or DatasetSpec(target=None)).thresholds
    cols = list(columns) if columns is not None else columns_of(df, "text")
    if cube is not None and cols and cube.has(cols):
        counts = cube.of(cols).groupBy("column", F.col("a").alias("value")).agg(F.sum("n").alias("count"))
        # every column has the table's rows
        total = cube.of(cols[:1]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    else:
        counts, total = value_counts(df, cols), df.count()
    pct = round2_like_numpy(ratio(F.col("count"), F.lit(total)) * 100.0)
    return (counts.where(F.col("value").isNotNull())
            .select("column", F.col("value").alias("group"), "count",
                    pct.alias("percentage"))
            .where(F.col("percentage") < th.rare_group_pct))


def _binary_target(df: DataFrame, target: str, positive_label: str | None):
    """Outcome as a double: numeric/boolean targets as they are, a text
    target only through an explicit positive label."""
    dt = df.schema[target].dataType
    if positive_label is not None:
        return (q(target).cast("string") == F.lit(positive_label)).cast("double")
    if is_text(dt):
        raise TypeError(f"target {target!r} is text: pass positive_label")
    y = q(target).cast("double")
    return F.when(~F.isnan(y), y)


def representation(df: DataFrame, columns: Sequence[str], target: str | None = None,
                   spec: DatasetSpec | None = None,
                   positive_label: str | None = None, cube: ValueCube | None = None) -> DataFrame:
    """A3: per group of each column: share of the non-NULL rows, outcome rate
    (mean target, NULL targets skipped), and a warning when share < 0.05.
    Columns: column, group, count, share, outcome_rate, warning."""
    th = (spec or DatasetSpec(target=target)).thresholds
    has_target = target is not None and target in df.columns
    label = positive_label if positive_label is not None else (spec.positive_label if spec else None)
    if cube is not None and columns and cube.has(list(columns)) and (not has_target or cube.target == target):
        y = cube.outcome(label) if has_target else F.lit(None).cast("double")
        rows = cube.of(list(columns)).select("column", F.col("a").alias("value"), "n", y.alias("_y"))
        rate = ratio(F.sum(F.col("n") * F.col("_y")), F.sum(F.when(F.col("_y").isNotNull(), F.col("n"))))
        groups = rows.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.sum("n").alias("count"), rate.alias("outcome_rate"))
    else:
        y = _binary_target(df, target, label) if has_target else F.lit(None).cast("double")
        long = to_long(df.withColumn("_y", y), columns, ids=["_y"])
        groups = shared(long.where(F.col("value").isNotNull())
                        .groupBy("column", "value")
                        .agg(F.count(F.lit(1)).alias("count"), F.avg("_y").alias("outcome_rate")))
    totals = groups.groupBy("column").agg(F.sum("count").alias("_total"))
    share = ratio(F.col("count"), F.col("_total"))
    warn = F.when(share < th.representation_share,
                  F.format_string("%s is under-represented (%.1f%%)",
                                  F.col("value"), share * 100.0))
    return (groups.join(F.broadcast(totals), "column")
            .select("column", F.col("value").alias("group"), "count",
                    share.alias("share"), "outcome_rate", warn.alias("warning")))


def representation_for_spec(df: DataFrame, spec: DatasetSpec, cube: ValueCube | None = None) -> DataFrame:
    """A3 as the pipeline calls it: protected columns matched by name
    ('-' normalised on both sides), outcome only when the target exists."""
    cols = match_protected(df.columns, spec.protected_attributes, mode="dash")
    # a text target without a positive label has no outcome rate
    target = spec.target
    if target in df.columns and is_text(df.schema[target].dataType) and spec.positive_label is None:
        target = None
    return representation(df, cols, target, spec, spec.positive_label, cube)


def outcome_rate_by_group(df: DataFrame, target: str, columns: Sequence[str],
                          positive_label: str | None = None) -> DataFrame:
    """A4: mean target per group of each column; NULL groups dropped.
    Columns: column, group, outcome_rate."""
    long = to_long(df.withColumn("_y", _binary_target(df, target, positive_label)),
                   columns, ids=["_y"])
    return (long.where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.avg("_y").alias("outcome_rate"))
            .withColumnRenamed("value", "group"))


def missing_sensitive_attributes(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Expected protected attributes (normalised) that no column equals
    after normalisation — a left-anti join of two name lists."""
    spark = df.sparkSession
    expected = spark.createDataFrame(
        sorted({(normalise(a),) for a in spec.protected_attributes}), "attribute string")
    actual = spark.createDataFrame([(normalise(c),) for c in df.columns],
                                   "attribute string")
    return expected.join(actual, "attribute", "left_anti")
