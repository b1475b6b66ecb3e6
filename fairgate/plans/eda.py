"""Bias EDA chain and its finding counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import association, representation, stats
from ..operators.cube import ValueCube, value_cube
from ..spec import DatasetSpec


@dataclass
class EdaFindings:
    missing_sensitive_attrs: DataFrame
    underrepresented_groups: DataFrame
    missingness_bias: DataFrame
    proxy_variables: DataFrame
    statistical_disparities: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        out = {k: v for k, v in self.__dict__.items() if v is not None}
        return out


def run_bias_eda(df: DataFrame, spec: DatasetSpec,
                 null_counts: DataFrame | None = None,
                 testable: bool | None = None, cube: ValueCube | None = None) -> EdaFindings:
    """O3: missing attributes (X1), rare groups (A2), missingness bias (T2,
    with a target), proxies (T4), disparities (T5, only with a target).
    Shared count tables are written when this is called; the tests on them
    run when a table is read.  ``testable``: the result of T2's gate, if known;
    ``cube``: the table's value counts, made here if not given."""
    cube = cube if cube is not None else value_cube(df, spec)
    has_target = spec.target is not None and spec.target in df.columns
    has_test = has_target and (testable if testable is not None else stats.missingness_testable(df, spec.target, spec))
    miss = (stats.missingness_bias(df, spec.target, spec, counts=null_counts) if has_test
            else df.sparkSession.createDataFrame(
                [], "column string, chi2 double, p_value double, mechanism string"))
    return EdaFindings(
        missing_sensitive_attrs=representation.missing_sensitive_attributes(df, spec),
        underrepresented_groups=representation.underrepresented_groups(df, spec, cube=cube),
        missingness_bias=miss,
        proxy_variables=association.proxy_variables(df, spec),
        statistical_disparities=(stats.statistical_disparities(df, spec.target, spec, cube=cube)
                                 if spec.target else None),
    )


COUNT_NAMES = {
    "missing_sensitive_attrs": "missing_sensitive_attrs_count",
    "underrepresented_groups": "underrepresented_groups_count",
    "missingness_bias": "missingness_bias_count",
    "proxy_variables": "proxy_variables_count",
    "statistical_disparities": "statistical_disparities_count",
}


def finding_counts(findings: EdaFindings) -> DataFrame:
    """O4 in long form: (check, n) for every finding table (0 when empty) —
    a union of one-row counts."""
    parts = []
    for name, tbl in findings.tables().items():
        parts.append(tbl.agg(F.count(F.lit(1)).alias("n"))
                     .select(F.lit(COUNT_NAMES[name]).alias("check"), "n"))
    if findings.statistical_disparities is None:
        parts.append(findings.missing_sensitive_attrs.sparkSession.createDataFrame(
            [(COUNT_NAMES["statistical_disparities"], 0)], "check string, n bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
