"""Checks that cannot be run on a table, as rows: the reference skips them,
here each skipped test leaves one ``not_tested`` finding with its reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import stack
from ..spec import DatasetSpec, is_numeric, is_text, matches_by_attribute
from .profile import distinct_counts

SCHEMA = "check string, column string, status string, reason string"


def not_tested(df: DataFrame, spec: DatasetSpec, reference: DataFrame | None = None,
               importance_reason: str | None = None) -> DataFrame:
    """check, column, status, reason.

    missingness (T2): a target that is not text and has too many values;
    disparity (T5): protected columns with too many groups; proxies (T4):
    protected columns of one value; drift (T3): common numeric columns
    without a value on either side; importance (T6): the reason given.
    One count of distinct values per table serves them all.
    """
    th, spark = spec.thresholds, df.sparkSession
    rules: list[tuple[str, str, F.Column, str]] = []
    n = F.col("n_distinct")
    if spec.target in df.columns:
        if not is_text(df.schema[spec.target].dataType):
            rules.append(("missingness", spec.target, n >= th.missingness_max_target_values,
                          f"the target has {th.missingness_max_target_values} values or more"))
        for _, c in matches_by_attribute(df.columns, spec.protected_attributes, "column"):
            if c != spec.target:
                rules.append(("disparity", c, n > th.disparity_max_groups, f"more than {th.disparity_max_groups} groups"))
    for _, c in matches_by_attribute(df.columns, spec.protected_attributes, "column"):
        rules.append(("proxies", c, n < 2, "fewer than two values"))
    fixed = [] if importance_reason is None else [("importance", spec.target, "not_tested", importance_reason)]
    out = spark.createDataFrame(fixed, SCHEMA)

    def apply(table: DataFrame, rules: list) -> DataFrame:
        columns = list(dict.fromkeys(c for _, c, _, _ in rules))
        # columns without any value have no group of their own
        found = distinct_counts(table, columns).unionByName(spark.createDataFrame([(c, 0) for c in columns], "column string, n_distinct bigint"))
        found = found.groupBy("column").agg(F.max("n_distinct").alias("n_distinct"))
        rows = found.select("column", "n_distinct", stack(
            [(F.lit(check), F.lit(c), hit, F.lit(reason)) for check, c, hit, reason in rules], ["check", "_of", "_hit", "reason"]))
        return rows.where((F.col("column") == F.col("_of")) & F.col("_hit")).select(
            "check", "column", F.lit("not_tested").alias("status"), "reason")

    if rules:
        out = out.unionByName(apply(df, rules))
    if reference is not None:
        both = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name in reference.columns
                and is_numeric(reference.schema[f.name].dataType)]
        empty = [("drift", c, n == 0, "no value on one side") for c in both]
        if both:
            out = out.unionByName(apply(df, empty).unionByName(apply(reference, empty)).distinct())
    return out
