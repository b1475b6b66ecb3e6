"""Cross-tabulations and the chi-square independence test (A10, A11, T1),
missingness bias (T2) and outcome disparities (T5).

Many tests run in one plan: pairs are unpivoted to (column, a, b), counted
once, and every statistic is computed per ``column``.  Chi-square is taken
from the cell counts and the two marginals through equi-joins only — no
cross join of the marginals is needed because

    sum over all cells (O-E)^2/E = sum over non-empty cells (O-E)^2/E
                                   + (N^2 - sum_non-empty R*C) / N

(the second term is the expected mass of the empty cells, computed exactly
in decimal), and for a 2x2 table |O-E| is the same in every cell, so the
Yates-corrected value is max(|O-E| - 1/2, 0)^2 * N * sum(1/R) * sum(1/C).
"""

from __future__ import annotations

from typing import TYPE_CHECKING, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_as_null, q, ratio, stack
from ..functions.pvalues import chi2_p_value
from ..spec import DatasetSpec, is_text, matches_by_attribute
from .ordering import shared

if TYPE_CHECKING:
    from .cube import ValueCube

DEC = "decimal(38,0)"


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A10 in long form: (column, a, b, n) for tests ``(name, col_a, col_b)``.
    Values are compared as strings; rows with a NULL in either side are
    kept here (callers decide) so that distinct counts stay exact."""
    if not pairs:
        raise ValueError("no pairs to count")
    df = nan_as_null(df)
    long = df.select(stack([(F.lit(name), q(a).cast("string"), q(b).cast("string"))
                            for name, a, b in pairs], ["column", "a", "b"]))
    return long.groupBy("column", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def crosstab_normalized(counts: DataFrame) -> DataFrame:
    """Row-normalised cross-tab: n / sum(n over the same a)."""
    c = counts.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    rows = c.groupBy("column", "a").agg(F.sum("n").alias("_R"))
    return (c.join(rows, ["column", "a"])
            .select("column", "a", "b", "n", ratio(F.col("n"), F.col("_R")).alias("share")))


def chi2_tests(counts: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """T1 for every key group of a (keys..., a, b, n) count table.

    Pairs with a NULL on either side are dropped (crosstab semantics).
    Returns keys, chi2, dof, n_obs, n_rows (distinct a), n_cols (distinct b),
    p_value.  dof = 0 gives chi2 0 and p 1; dof = 1 uses Yates' correction.
    """
    keys = list(keys)
    # The count table feeds both marginals and the cells: computed once.
    c = shared(counts.where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    R = c.groupBy(*keys, "a").agg(F.sum("n").alias("_R"))
    C = c.groupBy(*keys, "b").agg(F.sum("n").alias("_C"))
    rs = R.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                              F.sum(1.0 / F.col("_R")).alias("_inv_r"),
                              F.sum("_R").alias("_N"))
    cs = C.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cols"),
                              F.sum(1.0 / F.col("_C")).alias("_inv_c"))
    # rs/cs hold one row per test: bounded by the number of tests.
    cells = (c.join(R, keys + ["a"]).join(C, keys + ["b"])
             .join(F.broadcast(rs.select(*keys, "_N")), keys))
    # doubles: the product of two margins leaves 64 bits at a few billion rows
    e = F.col("_R").cast("double") * F.col("_C").cast("double") / F.col("_N")
    dev = F.abs(F.col("n") - e)
    per_test = cells.groupBy(*keys).agg(
        F.sum(dev * dev / e).alias("_nz"),
        F.sum(F.col("_R").cast(DEC) * F.col("_C").cast(DEC)).alias("_rc"),
        F.max(dev).alias("_dev"))
    out = per_test.join(F.broadcast(rs), keys).join(F.broadcast(cs), keys)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    n_dec = F.col("_N").cast(DEC)
    empty_mass = (n_dec * n_dec - F.col("_rc")).cast("double") / F.col("_N")
    yates = (F.pow(F.greatest(F.col("_dev") - 0.5, F.lit(0.0)), 2)
             * F.col("_N").cast("double") * F.col("_inv_r") * F.col("_inv_c"))
    chi2 = (F.when(dof == 0, F.lit(0.0))
            .when(dof == 1, yates)
            .otherwise(F.col("_nz") + empty_mass))
    res = out.select(*keys, chi2.alias("chi2"), dof.cast("long").alias("dof"),
                     F.col("_N").alias("n_obs"), "n_rows", "n_cols")
    return res.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """T1 for one pair of columns."""
    return chi2_tests(pair_counts(df, [(a, a, b)]))


def _missing(df: DataFrame, name: str) -> F.Column:
    """pandas ``isnull``: NULL, or NaN in a float column."""
    c = q(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missingness_testable(df: DataFrame, target: str, spec: DatasetSpec | None = None) -> bool:
    """T2's gate, before anything is counted per target value: a text target,
    or one of fewer than ``missingness_max_target_values`` values."""
    limit = (spec or DatasetSpec(target=target)).thresholds.missingness_max_target_values
    if is_text(df.schema[target].dataType):
        return True
    return df.where(~_missing(df, target)).select(q(target)).distinct().limit(limit).count() < limit


def null_flag_counts(df: DataFrame, target: str, by_value: bool = True) -> DataFrame:
    """(column, a, b, n) for every column except the target: a = 1 when the
    value is missing, b = the target as text (NULL when missing; one constant
    unless ``by_value``).  One scan of the table, computed once; it feeds the
    missingness tests (T2), the missing-cell total (P3) and the null
    expectations (F2, F6)."""
    cols = [c for c in df.columns if c != target]
    value = q(target).cast("string") if by_value else F.lit("any")
    b = F.when(~_missing(df, target), value)
    long = df.select(stack([(F.lit(c), _missing(df, c).cast("int")) for c in cols],
                           ["column", "a"]), b.alias("b"))
    return shared(long.groupBy("column", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def missingness_bias(df: DataFrame, target: str, spec: DatasetSpec | None = None,
                     columns: Sequence[str] | None = None,
                     counts: DataFrame | None = None) -> DataFrame:
    """For each column with NULLs (except the target), chi-square of the
    null flag against the target; recorded when p < threshold with
    mechanism 'MNAR'.  Tested only when the target is text or has fewer than
    ``missingness_max_target_values`` distinct values.

    Returns column, chi2, p_value, mechanism (findings) — all in one plan.
    """
    th = (spec or DatasetSpec(target=target)).thresholds
    if target not in df.columns:
        return _empty_findings(df, ["column string", "chi2 double",
                                    "p_value double", "mechanism string"])
    cols = [c for c in (columns or df.columns) if c != target]
    if not cols:
        return _empty_findings(df, ["column string", "chi2 double",
                                    "p_value double", "mechanism string"])
    # a ready table was counted by the target's values only behind this gate
    if counts is None and not missingness_testable(df, target, spec):
        return _empty_findings(df, ["column string", "chi2 double",
                                    "p_value double", "mechanism string"])
    counts = counts if counts is not None else null_flag_counts(df, target)
    if columns is not None:
        counts = counts.where(F.col("column").isin(cols))
    nulls = counts.groupBy("column").agg(
        F.sum(F.when(F.col("a") == 1, F.col("n")).otherwise(0)).alias("_nulls"))
    tests = chi2_tests(counts).join(F.broadcast(nulls), "column")
    return (tests.where((F.col("_nulls") > 0) & (F.col("p_value") < th.p_value))
            .select("column", "chi2", "p_value", F.lit("MNAR").alias("mechanism")))


def disparity_tests(df: DataFrame, target: str, spec: DatasetSpec,
                    match_mode: str = "column", cube: ValueCube | None = None) -> DataFrame:
    """T5 (all tested columns, significant or not): chi-square of each
    protected column (<= ``disparity_max_groups`` distinct values) against
    the target.  Columns: column, chi2, dof, p_value, significant."""
    th = spec.thresholds
    pairs = [(col, col, target) for _, col in
             matches_by_attribute(df.columns, spec.protected_attributes, match_mode)
             if col != target]
    if target not in df.columns or not pairs:
        return _empty_findings(df, ["column string", "chi2 double", "dof bigint",
                                    "p_value double", "significant boolean"])
    tested = [a for _, a, _ in pairs]
    counts = cube.of(tested) if cube is not None and cube.target == target and cube.has(tested) else shared(pair_counts(df, pairs))
    groups = (counts.where(F.col("a").isNotNull()).select("column", "a").distinct()
              .groupBy("column").agg(F.count(F.lit(1)).alias("_groups")))
    few = shared(groups.where(F.col("_groups") <= th.disparity_max_groups).select("column"))
    # columns over the limit leave before the test (``not_tested`` names them)
    tests = chi2_tests(counts.join(F.broadcast(few), "column"))
    return tests.select("column", "chi2", "dof", "p_value",
                        (F.col("p_value") < th.p_value).alias("significant"))


def statistical_disparities(df: DataFrame, target: str, spec: DatasetSpec,
                            match_mode: str = "column", cube: ValueCube | None = None) -> DataFrame:
    """T5 findings: only the significant rows (column, chi2, p_value, significant)."""
    return (disparity_tests(df, target, spec, match_mode, cube)
            .where(F.col("significant"))
            .select("column", "chi2", "p_value", "significant"))


def _empty_findings(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([], ", ".join(fields))
