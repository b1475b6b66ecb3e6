"""Formal audit chain: schema validation, quality checks with the
expectation suite (run once), optional drift, and the audit status
(O5, O6, O7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import association, expect, profile
from ..operators.cube import ValueCube
from ..operators.ordering import shared
from ..spec import DatasetSpec


@dataclass
class AuditResult:
    schema: DataFrame            # status, issues
    quality: DataFrame           # check, passed, value, warning
    quality_rollup: DataFrame    # total_checks, passed, failed, n_warnings
    expectations: DataFrame      # expectation, column, success, value
    expectation_summary: DataFrame
    drift: DataFrame | None      # None = SKIPPED
    status: DataFrame            # compliance_status
    drift_status: str | DataFrame = "SKIPPED"   # or a one-row (n_drifted, status)


def audit_status(schema: DataFrame, rollup: DataFrame) -> DataFrame:
    """COMPLIANT iff the schema status is PASS or WARNING and no quality
    check failed; drift and expectations do not count.  Two one-row
    inputs combined by a union + one aggregate (no cross join)."""
    signals = (schema.select(F.lit("schema_ok").alias("k"),
                             F.col("status").isin("PASS", "WARNING").cast("int").alias("v"))
               .unionByName(rollup.select(F.lit("failed").alias("k"),
                                          F.col("failed").cast("int").alias("v"))))
    row = signals.agg(F.max(F.when(F.col("k") == "schema_ok", F.col("v"))).alias("schema_ok"),
                      F.max(F.when(F.col("k") == "failed", F.col("v"))).alias("failed"))
    return row.select(
        F.when((F.col("schema_ok") == 1) & (F.col("failed") == 0), F.lit("COMPLIANT"))
        .otherwise(F.lit("NON_COMPLIANT")).alias("compliance_status"),
        "failed")


def run_audit(df: DataFrame, spec: DatasetSpec, reference: DataFrame | None = None,
              null_counts: DataFrame | None = None, cube: ValueCube | None = None) -> AuditResult:
    """O7.  ``null_counts`` (``stats.null_flag_counts``, shared with the bias
    EDA) lets the missing-cell total and the suite skip their own scans."""
    # the numeric-as-text test feeds both the schema status and the type
    # check: one scan, a table of one row per text column
    nat = shared(profile.numeric_as_text(df, cube=cube))
    schema = expect.schema_validation(df, nat=nat)
    if null_counts is not None and spec.target in df.columns:
        missing = profile.missing_total_from_counts(null_counts, len(df.columns))
        exps = expect.expectations_from_counts(null_counts, spec, df.columns, df.columns)
    else:
        missing = None
        exps = expect.expectations(df, spec, expected_columns=df.columns)
    quality = profile.quality_checks(df, spec, nat=nat, missing=missing)
    rollup = profile.quality_rollup(quality)
    drift = association.ks_drift(df, reference, spec=spec) if reference is not None else None
    return AuditResult(schema, quality, rollup, exps, expect.expectation_summary(exps),
                       drift, audit_status(schema, rollup), association.drift_status(drift))
