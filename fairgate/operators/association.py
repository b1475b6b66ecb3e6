"""Proxy variables (T4) and distribution drift.

T4: every protected column is correlated with every other column after
ordinal encoding of text columns, each pair over its complete rows (pandas'
pairwise-complete ``corr``); a constant column gives NULL.  Pairs of numbers
are one global aggregate; text columns are aggregated by value before their
codes are known.

T3: two-sample Kolmogorov-Smirnov per common numeric column, D = max |F1 - F2|,
by branch and bound over histograms of the values' 64-bit keys: the gap is
exact at the ends of bins, counts bound it inside, and only bins whose bound
exceeds the best gap are counted again by finer bins.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q, ratio, stack, to_long
from ..functions.pvalues import ks_p_value
from ..spec import DatasetSpec, is_numeric, is_temporal, is_text, matches_by_attribute
from .encode import as_label_text, as_number
from .ordering import LEVELS, histogram, ordered, running_sums, shared


def _correlatable(dt: T.DataType) -> bool:
    return is_numeric(dt) or is_text(dt) or is_temporal(dt) or isinstance(dt, T.BooleanType)


def correlation_pairs(df: DataFrame, protected: Sequence[str],
                      candidates: Sequence[str] | None = None) -> DataFrame:
    """All (protected_attribute, proxy_variable, r) pairs; r is NULL when a
    side is constant or fewer than two complete pairs exist."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    cands = [c for c in (candidates or df.columns) if _correlatable(fields[c])]
    protected = [p for p in protected if p in fields and _correlatable(fields[p])]
    pairs = [(p, o) for p in protected for o in cands if o != p]
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "protected_attribute string, proxy_variable string, r double")
    used = {c for pair in pairs for c in pair}
    texts = sorted(c for c in used if is_text(fields[c]))
    numbers = sorted(used - set(texts))
    base = df.select(*[as_label_text(c).alias(f"_t{i}") for i, c in enumerate(texts)],
                     *[as_number(df, c).alias(f"_y{i}") for i, c in enumerate(numbers)])
    direct = [(p, o) for p, o in pairs if p in numbers and o in numbers]
    coded = [(p, o, *((p, o) if p in texts else (o, p))) for p, o in pairs if (p, o) not in set(direct)]
    found = []
    if direct:
        y = lambda c: F.col(f"_y{numbers.index(c)}")
        both = lambda c, other: F.when(y(other).isNotNull(), y(c))
        wide = base.agg(*[F.try_divide(F.covar_pop(both(p, o), both(o, p)), F.stddev_pop(both(p, o)) * F.stddev_pop(both(o, p))).alias(f"_r{i}")
                          for i, (p, o) in enumerate(direct)])
        found.append(wide.select(stack([(F.lit(p), F.lit(o), F.col(f"_r{i}")) for i, (p, o) in enumerate(direct)],
                                       ["protected_attribute", "proxy_variable", "r"])))
    if coded:
        wanted = df.sparkSession.createDataFrame(coded, "protected_attribute string, proxy_variable string, x string, y string")
        r = _coded_correlations(base, texts, numbers, {(x, y) for *_, x, y in coded})
        found.append(wanted.join(r, ["x", "y"], "left").select("protected_attribute", "proxy_variable", "r"))
    return reduce(DataFrame.unionByName, found)


def _coded_correlations(base: DataFrame, texts: Sequence[str], numbers: Sequence[str], pairs: set[tuple[str, str]]) -> DataFrame:
    """x, y, r of text columns x (by their label codes) with other columns y.
    The rows are aggregated by value first: count, mean and squared deviation
    of every number per value, and counts per pair of values.  Codes are
    ranks of these aggregated rows, so no code is ever joined to a base row."""
    moments = [m for i in range(len(numbers)) for m in (
        F.count(f"_y{i}").alias(f"n{i}"), F.avg(f"_y{i}").alias(f"m{i}"), (F.var_pop(f"_y{i}") * F.count(f"_y{i}")).alias(f"s{i}"),
        F.min(f"_y{i}").alias(f"lo{i}"), F.max(f"_y{i}").alias(f"hi{i}"))]
    long = base.select(*[f"_y{i}" for i in range(len(numbers))],
                       stack([(F.lit(t), F.col(f"_t{i}")) for i, t in enumerate(texts)], ["x", "value"]))
    per_value = long.groupBy("x", "value").agg(F.lit(1).alias("_one"), *moments)
    ranked = shared(running_sums(per_value, "value", ["_one"], ["x"]).withColumn("code", (F.col("cum__one") - 1).cast("double")))
    rows = []
    if numbers:
        rows.append(ranked.select("x", "code", stack([(F.lit(c), F.col(f"n{i}"), *[F.col(f"{k}{i}") for k in ("m", "s", "lo", "hi")])
                                                      for i, c in enumerate(numbers)], ["y", "n", "m", "s", "lo", "hi"])).where("n > 0"))
    of_texts = [(x, y) for x, y in sorted(pairs) if y in texts]
    if of_texts:
        t = lambda c: F.col(f"_t{texts.index(c)}")
        counts = base.select(stack([(F.lit(x), t(x), F.lit(y), t(y)) for x, y in of_texts], ["x", "a", "y", "b"])).groupBy("x", "a", "y", "b").agg(F.count(F.lit(1)).alias("n"))
        code = lambda c, v, out: ranked.select(F.col("x").alias(c), F.col("value").alias(v), F.col("code").alias(out))
        both = counts.join(code("x", "a", "code"), ["x", "a"]).join(code("y", "b", "m"), ["y", "b"])
        rows.append(both.select("x", "code", "y", "n", "m", F.lit(0.0).alias("s"), F.col("m").alias("lo"), F.col("m").alias("hi")))
    cells = reduce(DataFrame.unionByName, rows)
    n = F.col("n")
    means = cells.groupBy("x", "y").agg((F.sum(n * F.col("code")) / F.sum(n)).alias("mx"), (F.sum(n * F.col("m")) / F.sum(n)).alias("my"),
                                        ((F.min("code") == F.max("code")) | (F.min("lo") == F.max("hi"))).alias("constant"))
    dx, dy = F.col("code") - F.col("mx"), F.col("m") - F.col("my")
    # the means are one row per pair of columns
    sums = cells.join(F.broadcast(means), ["x", "y"]).groupBy("x", "y", "constant").agg(
        F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(F.col("s") + n * dy * dy).alias("yy"))
    r = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    return sums.select("x", "y", F.when(~F.col("constant"), r).alias("r"))


def proxy_variables(df: DataFrame, spec: DatasetSpec, match_mode: str = "column",
                    threshold: float | None = None) -> DataFrame:
    """T4 findings: protected_attribute, proxy_variable, correlation (|r|)
    above the threshold, strongest first (L4, names break ties).  Each matched column is tested
    once even when several attributes match it."""
    th = threshold if threshold is not None else spec.thresholds.proxy_abs_r
    protected = [c for _, c in matches_by_attribute(df.columns, spec.protected_attributes,
                                                    match_mode)]
    pairs = correlation_pairs(df, protected)
    return (pairs.select("protected_attribute", "proxy_variable",
                         F.abs("r").alias("correlation"))
            .where(F.col("correlation") > th)
            .orderBy(F.desc("correlation"), "protected_attribute", "proxy_variable"))


def _numeric_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = to_long(df, cols, "double")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def ecdf_gap(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, statistic (largest gap of the two distribution functions), n1, n2
    of rows with 0/1 columns _a and _b and the order key _k."""
    order = Window.partitionBy(by, "_bin").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # counts before the bins of a level, and the groups' totals: one row per open bin and group
    before = totals = best = open_bins = None
    for level in range(len(LEVELS)):
        cells = histogram(rows, [by], level, open_bins, F.sum("_a").alias("_a"), F.sum("_b").alias("_b"),
                          F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        if level == 0:
            cells = shared(cells)
            totals = shared(cells.groupBy(by).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2")))
            before = totals.select(by, F.lit(0).cast("bigint").alias("_bin"), F.lit(0).cast("bigint").alias("_a0"), F.lit(0).cast("bigint").alias("_b0"))
        upto = (cells.join(before, [by, "_bin"]).join(F.broadcast(totals), by)
                .withColumn("_a1", F.col("_a0") + F.sum("_a").over(order)).withColumn("_b1", F.col("_b0") + F.sum("_b").over(order)))
        share = lambda n, total: ratio(F.col(n), F.col(total))
        least = lambda n, own, total: ratio(F.col(n) - F.col(own), F.col(total))
        upto = shared(upto.select(
            by, F.col("_next").alias("_bin"), (F.col("_a1") - F.col("_a")).alias("_a0"), (F.col("_b1") - F.col("_b")).alias("_b0"),
            F.abs(share("_a1", "n1") - share("_b1", "n2")).alias("gap"),
            F.when(F.col("_lo") < F.col("_hi"), F.greatest(share("_a1", "n1") - least("_b1", "_b", "n2"),
                                                           share("_b1", "n2") - least("_a1", "_a", "n1"))).alias("bound")))
        gaps = upto.groupBy(by).agg(F.max("gap").alias("statistic"))
        best = shared(gaps if best is None else best.unionByName(gaps).groupBy(by).agg(F.max("statistic").alias("statistic")))
        open_bins = before = shared(upto.join(F.broadcast(best), by).where(F.col("bound") > F.col("statistic")).select(by, "_bin", "_a0", "_b0"))
        if open_bins.isEmpty():
            break
    return totals.join(best, by).select(by, "statistic", "n1", "n2")


def ks_drift(current: DataFrame, reference: DataFrame,
             columns: Sequence[str] | None = None,
             spec: DatasetSpec | None = None) -> DataFrame:
    """T3 for every numeric column present in both tables (or the given
    ones): column, statistic (D), n_current, n_reference, p_value, drift."""
    th = (spec or DatasetSpec(target=None)).thresholds
    ref_types = {f.name: f.dataType for f in reference.schema.fields}
    cols = list(columns) if columns is not None else [
        f.name for f in current.schema.fields
        if is_numeric(f.dataType) and f.name in ref_types and is_numeric(ref_types[f.name])]
    if not cols:
        return current.sparkSession.createDataFrame(
            [], "column string, statistic double, n_current bigint, n_reference bigint, "
                "p_value double, drift boolean")
    a = _numeric_long(current, cols).select("column", "value", F.lit(1).alias("_a"),
                                            F.lit(0).alias("_b"))
    b = _numeric_long(reference, cols).select("column", "value", F.lit(0).alias("_a"),
                                              F.lit(1).alias("_b"))
    d = ecdf_gap(ordered(a.unionByName(b), "value"), "column", "value").select(
        "column", "statistic", F.col("n1").alias("n_current"), F.col("n2").alias("n_reference"))
    p = ks_p_value(F.col("statistic"), F.col("n_current"), F.col("n_reference"))
    return d.select("column", "statistic", "n_current", "n_reference", p.alias("p_value"),
                    (p < th.p_value).alias("drift"))


def drift_status(results: DataFrame | None) -> DataFrame | str:
    """Status of a drift run: SKIPPED without a reference table, else
    DRIFT_DETECTED / NO_DRIFT from the drifted columns (one-row frame)."""
    if results is None:
        return "SKIPPED"
    return results.agg(F.count_if(F.col("drift")).alias("n_drifted")).select(
        "n_drifted", F.when(F.col("n_drifted") > 0, F.lit("DRIFT_DETECTED"))
        .otherwise(F.lit("NO_DRIFT")).alias("status"))
