"""Column-level helpers shared by the operators: long (unpivoted) form,
safe ratios and rounding.  All are built-in expressions (JVM side)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_long(df: DataFrame, columns: Sequence[str], value_type: str = "string",
            ids: Sequence[str] = (), name: str = "column",
            value: str = "value") -> DataFrame:
    """Unpivot ``columns`` into (ids..., column, value), one scan for all
    columns (an Expand feeding whatever aggregation follows)."""
    columns = list(columns)
    if not columns:
        schema = T.StructType(
            [df.schema[i] for i in ids]
            + [T.StructField(name, T.StringType()),
               T.StructField(value, T.DataType.fromDDL(value_type))])
        return df.sparkSession.createDataFrame([], schema)
    df = nan_as_null(df)
    return df.select(*[q(i) for i in ids],
                     stack([(F.lit(c), q(c).cast(value_type)) for c in columns], [name, value]))


def ratio(num: Column, den: Column) -> Column:
    """num / den with NULL (not an error) when den is 0 — ANSI-safe."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round2_like_numpy(x: Column) -> Column:
    """Round to 2 places as pandas/numpy do: rint(x * 100) / 100 on the
    binary value (half to even), not on the decimal text."""
    return F.rint(x * 100.0) / 100.0


def ratio_or_zero(num: Column, den: Column) -> Column:
    """Zero-division-as-zero (precision/recall/F1 with zero_division=0)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def q(name: str) -> Column:
    """Column reference safe for any name ('-', ' ', '.', backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def stack(rows, names) -> Column:
    """``stack`` generator from Column tuples (names are literals, never
    spliced into SQL text): one output row per tuple, aliased ``names``."""
    rows = list(rows)
    flat = [c for row in rows for c in row]
    return F.stack(F.lit(len(rows)), *flat).alias(*names)


def nan_as_null(df: DataFrame) -> DataFrame:
    """The one NaN rule on entry: NaN in a float column is a missing value
    (NULL), for every check alike.  One projection, merged into the scan."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(q(c)), q(c)).alias(c) if c in floats else q(c) for c in df.columns])
