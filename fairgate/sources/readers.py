"""Inputs (S1, S2, S3): CSV with header and inferred types, headerless CSV
with given names, and any table/parquet DataFrame."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .split_csv import read_quoted_lines

# The strings pandas' CSV reader treats as missing by default.
PANDAS_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


# a quote inside a quoted field is doubled
_QUOTING = {"quote": '"', "escape": '"'}


def _read(spark: SparkSession, path: str, schema: T.StructType, header: bool, **options: object) -> DataFrame:
    """The file or folder in parallel, whether records span lines or not."""
    spanned = read_quoted_lines(spark, path, schema, header, {**_QUOTING, **options})
    if spanned is not None:
        return spanned
    return spark.read.options(**_QUOTING, header=header, **options).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_values: Sequence[str] = PANDAS_NA_VALUES) -> DataFrame:
    """CSV with a header row.  Without a schema the types are inferred
    the way pandas does it: NA words first become NULL (in every column),
    then a column whose remaining values are all integers becomes bigint,
    all numbers double, all True/False boolean, else string.  Inference is
    one aggregate over the file (a schema-sized result reaches the driver);
    the casts are lazy.  A quoted field may hold line ends; the file is read in
    splits all the same (``split_csv``)."""
    if schema is not None:
        return null_na_words(_read(spark, path, _parsed(schema), True), na_values)
    # the names alone, from the first record; every column is text
    named = spark.read.options(**_QUOTING, header=True, multiLine=True).csv(path).schema
    return infer_types(null_na_words(_read(spark, path, named, True), na_values))


def _parsed(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns whose non-NULL values all parse as integers /
    numbers / booleans (pandas' parser rules, see ``NUMERIC_TEXT_PATTERN``)."""
    from ..functions.text import NUMERIC_TEXT_PATTERN
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    ref = lambda c: F.col("`" + c.replace("`", "``") + "`")
    aggs = []
    for i, c in enumerate(text):
        v = ref(c)
        aggs += [F.count(v).alias(f"n{i}"),
                 F.count_if(v.rlike(INTEGER_TEXT_PATTERN)).alias(f"i{i}"),
                 F.count(F.when(v.rlike(INTEGER_TEXT_PATTERN), F.trim(v).try_cast("bigint"))).alias(f"r{i}"),
                 F.count_if(v.rlike(NUMERIC_TEXT_PATTERN)).alias(f"f{i}"),
                 F.count_if(v.isin(BOOL_WORDS)).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    kinds = {}
    for i, c in enumerate(text):
        n = row[f"n{i}"]
        if n == 0:
            continue
        if row[f"i{i}"] == n:
            if row[f"r{i}"] == n:
                kinds[c] = "bigint"              # digits beyond 64 bits stay text, whole
        elif row[f"f{i}"] == n:
            kinds[c] = "double"
        elif row[f"b{i}"] == n:
            kinds[c] = "boolean"
    out = []
    for f in df.schema.fields:
        c = ref(f.name)
        kind = kinds.get(f.name)
        if kind == "boolean":
            c = c.isin(TRUE_WORDS)
        elif kind is not None:
            c = F.trim(c).cast(kind)
        out.append(c.alias(f.name))
    return df.select(*out)


# pandas' boolean words, and the integer grammar.
TRUE_WORDS = ["True", "TRUE", "true"]
BOOL_WORDS = TRUE_WORDS + ["False", "FALSE", "false"]
INTEGER_TEXT_PATTERN = r"^[ \t]*[+-]?[0-9]+[ \t]*$"


def read_headerless_csv(spark: SparkSession, path: str,
                        schema: T.StructType | str) -> DataFrame:
    """Headerless CSV with caller-given names and types; blanks after the
    delimiter are skipped.  NA words become NULL; a placeholder such as '?'
    is none of them and stays a category."""
    return null_na_words(_read(spark, path, _parsed(schema), False, ignoreLeadingWhiteSpace=True))


def null_na_words(df: DataFrame, na_values: Sequence[str] = PANDAS_NA_VALUES) -> DataFrame:
    words = list(na_values)
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(words), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S3: one of the parquet tables of a scale-factor directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
