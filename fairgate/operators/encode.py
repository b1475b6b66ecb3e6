"""Encoders and derived columns.

J4-J6 are per-row expressions; J7 (ordinal label codes) ranks distinct
values with the bucketed global order of ``ordering.running_sums`` and
joins the codes back; J8 is Spark ML's ``Imputer``.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q, to_long
from ..spec import is_numeric, is_temporal, is_text
from .ordering import ordinal_codes, shared


def binarise(col: str, positive) -> Column:
    """(col == positive) as 0/1; NULL compares false, so it gives 0."""
    return F.coalesce((q(col) == F.lit(positive)).cast("int"), F.lit(0))


# The walk-through's age buckets (50 belongs to the middle).
AGE_BUCKETS = [(30, "<30"), (50, "30-50")]
AGE_TOP = ">50"


def bucket(col: str, edges: Sequence[tuple[float, str]] = AGE_BUCKETS,
           top: str = AGE_TOP) -> Column:
    """First bucket whose edge the value is below (the first edge is
    strict ``<``, later edges inclusive ``<=``, as in the walk-through),
    else ``top``; NULL stays NULL."""
    c = q(col)
    expr = None
    for i, (edge, label) in enumerate(edges):
        cond = (c < edge) if i == 0 else (c <= edge)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.otherwise(F.lit(top)) if expr is not None else F.lit(top)
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(expr)


def map_values(col: str, mapping: Mapping) -> Column:
    """Dictionary lookup as a literal map; unmapped values give NULL."""
    if not mapping:
        return F.lit(None)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return m[q(col)]


def as_label_text(col: str) -> Column:
    """Value as the label encoder sees it: the string form, NULL as 'nan'."""
    return F.coalesce(q(col).cast("string"), F.lit("nan"))


def label_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """J7 codes table: (column, value, code) — 0-based rank of each distinct
    string (NULL as 'nan') in code-point order, per column.  All columns are
    ranked in one bucketed pass; no single-task window."""
    long = to_long(df.select(*[as_label_text(c).alias(c) for c in columns]), columns)
    return ordinal_codes(long, "value", by=["column"])


def label_encode(df: DataFrame, columns: Sequence[str] | None = None,
                 suffix: str = "") -> DataFrame:
    """J7 applied: each text column replaced (or, with ``suffix``, joined)
    by its integer code.  Each code table is joined on the value; AQE picks
    a broadcast when the measured code table is small and a shuffle join
    otherwise."""
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if is_text(f.dataType)]
    if not cols:
        return df
    codes = shared(label_codes(df, cols))      # read once per column below
    out = df
    for c in cols:
        tbl = (codes.where(F.col("column") == c)
               .select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}")))
        out = (out.withColumn(f"_v_{c}", as_label_text(c))
               .join(tbl, f"_v_{c}", "left").drop(f"_v_{c}"))
        target = f"{c}{suffix}" if suffix else c
        out = out.withColumn(target, F.col(f"_c_{c}").cast("long")).drop(f"_c_{c}")
    return out


def as_number(df: DataFrame, col: str) -> Column:
    """Numeric view of a column for correlation: numbers as double,
    booleans 0/1, timestamps/dates as epoch microseconds; NaN as NULL."""
    dt = df.schema[col].dataType
    c = q(col)
    if isinstance(dt, T.TimestampType):
        c = F.unix_micros(c)                      # an instant: zone-free already
    elif is_temporal(dt):
        # wall-clock values (timestamp_ntz, date): distance from the epoch
        # without the session time zone, so DST cannot bend the scale
        c = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                             c.cast("timestamp_ntz"))
    out = c.cast("double")
    return F.when(F.isnan(out), F.lit(None)).otherwise(out)


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL/NaN in numeric columns replaced by the column mean (Spark ML
    Imputer, one aggregate for all columns)."""
    from pyspark.ml.feature import Imputer
    cols = [c for c in columns if is_numeric(df.schema[c].dataType)]
    if not cols:
        return df
    tmp = [f"_imp_{i}" for i in range(len(cols))]
    staged = df
    for c, t in zip(cols, tmp):
        staged = staged.withColumn(t, q(c).cast("double"))
    model = Imputer(inputCols=tmp, outputCols=tmp, strategy="mean").fit(staged)
    out = model.transform(staged)
    for c, t in zip(cols, tmp):
        out = out.withColumn(c, F.col(t)).drop(t)
    return out
