"""Score construction and planted-bias steps over an existing table
(J9, J10, J11, A6, O11) — the reusable data steps of a biased-data
generator, applied to real rows instead of drawn ones.

Scalars (a column maximum, a quantile threshold, a row count) are single
aggregate values fetched once; every per-row step is a built-in
expression, and the exact-share label flip ranks rows by a hash through
the bucketed global order (no single-task sort).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from .ordering import exact_quantiles, rank_cut

# Bias factors of the reference's credit and hiring patterns.
CREDIT_GENDER_FACTOR = 1.2      # favoured group multiplied by this
CREDIT_AGE_FACTOR = 0.8         # under 30
CREDIT_INTERSECTIONAL = (0.7, 0.85, 0.85, 1.0)  # young female, female, young, other
HIRING_GENDER_FACTOR = 1.15
HIRING_AGE_FACTOR = 0.85        # over 50


def group_factor(rules: Sequence[tuple[Column, float]], default: float = 1.0) -> Column:
    """Factor of the first matching condition, else ``default``."""
    expr = None
    for cond, factor in rules:
        expr = (F.when(cond, F.lit(float(factor))) if expr is None
                else expr.when(cond, F.lit(float(factor))))
    return expr.otherwise(F.lit(float(default))) if expr is not None else F.lit(float(default))


def bias_rules(pattern: str, favoured: Column | None = None, young: Column | None = None,
               old: Column | None = None, domain: str = "credit_scoring"):
    """The reference's four patterns as J9 rules over caller conditions:
    none; gender (``favoured`` boosted); age (``young`` penalised for
    credit, ``old`` for hiring); intersectional (credit only)."""
    if pattern == "none":
        return []
    if pattern == "gender":
        return [(favoured, CREDIT_GENDER_FACTOR if domain == "credit_scoring"
                 else HIRING_GENDER_FACTOR)]
    if pattern == "age":
        return ([(young, CREDIT_AGE_FACTOR)] if domain == "credit_scoring"
                else [(old, HIRING_AGE_FACTOR)])
    if pattern == "intersectional" and domain == "credit_scoring":
        a, b, c, _ = CREDIT_INTERSECTIONAL
        return [((~favoured) & young, a), (~favoured, b), (young, c)]
    return []   # hiring documents 'intersectional' but applies nothing


def column_max(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """One aggregate, one row back: the maxima used to normalise scores."""
    row = df.agg(*[F.max(q(c)).cast("double").alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def weighted_score(df: DataFrame, terms: Sequence[tuple[str, float, str, float | None]]) -> Column:
    """Sum of weight * term.  Term modes: 'max' (col / max(col)),
    'const' (col / c), 'one_minus' (1 - col), 'raw' (col)."""
    maxima = column_max(df, [c for c, _, mode, _ in terms if mode == "max"])
    total = F.lit(0.0)
    for col, weight, mode, const in terms:
        c = q(col).cast("double")
        if mode == "max":
            t = F.try_divide(c, F.lit(maxima[col]))
        elif mode == "const":
            t = c / F.lit(float(const))
        elif mode == "one_minus":
            t = F.lit(1.0) - c
        else:
            t = c
        total = total + F.lit(float(weight)) * t
    return total


def quantile_value(df: DataFrame, col: str, prob: float) -> float | None:
    """A6 helper: exact quantile (linear interpolation) of one column."""
    long = df.select(F.lit(col).alias("column"), q(col).cast("double").alias("value"))
    row = exact_quantiles(long, [prob]).first()
    return None if row is None else row["quantile"]


def above_quantile(df: DataFrame, score: str, prob: float, out: str) -> DataFrame:
    """``out`` = 1 when score > its ``prob`` quantile, else 0."""
    t = quantile_value(df, score, prob)
    return df.withColumn(out, (q(score) > F.lit(t)).cast("int") if t is not None
                         else F.lit(0))


def hash_rank_key(key: Sequence[str], seed: int) -> Column:
    """md5 of the key columns and the seed: reproducible in DuckDB."""
    parts = [q(k).cast("string") for k in key] + [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *parts))


def flip_flags(df: DataFrame, key: Sequence[str], share: float = 0.05,
               seed: int = 42, out: str = "_flip") -> DataFrame:
    """J11 selection: ``out`` is true for exactly floor(share * n) rows — the
    first in md5(key, seed) order (``key`` must identify a row).  The cut-off
    key is selected by counts and is one value fetched once."""
    n = df.count()
    k = int(share * n)
    hashed = df.withColumn("_h", hash_rank_key(key, seed))
    if k <= 0:
        return hashed.withColumn(out, F.lit(False)).drop("_h")
    number = F.conv(F.substring("_h", 1, 15), 16, 10).cast("long")
    cut = rank_cut(hashed, ["_h", *key], k, number).first()["_cut"]
    bound = F.struct(*[F.lit(v).cast(hashed.schema[c].dataType).alias(c)
                       for c, v in zip(["_h", *key], cut)])
    return hashed.withColumn(out, F.struct("_h", *key) <= bound).drop("_h")


def flip_labels(df: DataFrame, label: str, key: Sequence[str], share: float = 0.05,
                seed: int = 42, out: str | None = None) -> DataFrame:
    """Flip exactly floor(share * n) labels (1 - label) — the rows first
    in md5(key, seed) order."""
    flagged = flip_flags(df, key, share, seed)
    target = out or label
    return flagged.withColumn(target, F.when(F.col("_flip"), 1 - q(label))
                              .otherwise(q(label))).drop("_flip")


def planted_outcome(df: DataFrame, base_score: Column, rules, threshold_q: float,
                    key: Sequence[str], flip_share: float = 0.0, seed: int = 42,
                    out: str = "approved", flags: DataFrame | None = None) -> DataFrame:
    """J9 + A6 + J11: biased score, 0/1 outcome above a quantile, optional
    exact-share noise flips (``flags``: a frame already carrying ``_flip``)."""
    src = flags if flags is not None else (
        flip_flags(df, key, flip_share, seed) if flip_share > 0
        else df.withColumn("_flip", F.lit(False)))
    scored = src.withColumn("_score", base_score * group_factor(rules))
    labelled = above_quantile(scored, "_score", threshold_q, out)
    return (labelled.withColumn(out, F.when(F.col("_flip"), 1 - F.col(out)).otherwise(F.col(out)))
            .drop("_flip", "_score"))


def bias_comparison(df: DataFrame, base_score: Column, patterns: dict[str, list],
                    group: str, key: Sequence[str], threshold_q: float = 0.5,
                    flip_share: float = 0.05, seed: int = 42,
                    out: str = "approved") -> DataFrame:
    """The same table under several bias patterns (same seed, so the
    same rows are flipped — ranked once and shared), stacked with a
    ``pattern`` column, then the outcome rate per pattern and group (A4)."""
    flags = (flip_flags(df, key, flip_share, seed) if flip_share > 0
             else df.withColumn("_flip", F.lit(False)))
    frames = []
    for name, rules in patterns.items():
        labelled = planted_outcome(df, base_score, rules, threshold_q, key, out=out, flags=flags)
        frames.append(labelled.select(F.lit(name).alias("pattern"), q(group).alias("group"), out))
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f)
    return (stacked.where(F.col("group").isNotNull())
            .groupBy("pattern", "group")
            .agg(F.count(F.lit(1)).alias("n"), F.avg(out).alias("outcome_rate")))
