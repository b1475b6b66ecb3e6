"""One count table for the checks on values and outcomes.

Rare groups (A2), representation with outcome rates (A3), cross-tabs and
chi-square against the target (A10, T1, T5) and numbers kept as text (F9) all
ask how often a value of a column comes with a value of the target.  The cube
holds these counts for every text and every protected column: one scan, one
partial aggregate per task, written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q
from ..spec import DatasetSpec, columns_of, match_protected, matches_by_attribute
from .ordering import shared
from .stats import pair_counts

#: a target of more values is left out of the counts (a float one would make
#: the cube as long as the table)
MOST_OUTCOMES = 64
_NO_TARGET = "_no_target"


@dataclass(frozen=True)
class ValueCube:
    """``counts``: column, a (value as text, NULL kept), b (target as text), n."""
    counts: DataFrame
    columns: tuple[str, ...]
    target: str | None                   # None: the counts are not split by a target
    target_type: T.DataType | None

    def of(self, columns: list[str]) -> DataFrame:
        return self.counts.where(F.col("column").isin(columns))

    def has(self, columns: list[str]) -> bool:
        return set(columns) <= set(self.columns)

    def outcome(self, positive_label: str | None) -> Column:
        """The target's value as a number: the positive label, or numbers and
        booleans as they are."""
        b = F.col("b")
        if positive_label is not None:
            return (b == F.lit(positive_label)).cast("double")
        if isinstance(self.target_type, T.BooleanType):
            return (b == "true").cast("double")
        return b.cast("double")


def value_cube(df: DataFrame, spec: DatasetSpec) -> ValueCube:
    """The cube of a table: its text columns and those that any of the checks
    takes for protected."""
    protected = set(match_protected(df.columns, spec.protected_attributes, mode="dash"))
    protected |= {c for _, c in matches_by_attribute(df.columns, spec.protected_attributes, "column")}
    columns = [c for c in df.columns if c in protected or c in columns_of(df, "text")]
    target = spec.target if spec.target in df.columns else None
    if target is not None and df.select(q(target)).distinct().limit(MOST_OUTCOMES + 1).count() > MOST_OUTCOMES:
        target = None
    if not columns:
        empty = df.sparkSession.createDataFrame([], "column string, a string, b string, n bigint")
        return ValueCube(empty, (), target, df.schema[target].dataType if target else None)
    src = df if target is not None else df.withColumn(_NO_TARGET, F.lit("any"))
    counts = shared(pair_counts(src, [(c, c, target or _NO_TARGET) for c in columns]))
    return ValueCube(counts, tuple(columns), target, df.schema[target].dataType if target else None)
