"""Small tables with the awkward cases of every operator."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"

#: names that operators use for their own columns
CLASHING = ["score", "predicted", "sha", "key", "start", "length", "bucket", "ranges", "own_id", "epoch", "rid", "sig", "window", "cls",
            "component", "place", "keep_id", "at_lang", "of_whole", "part", "n_tokens"]


def docs(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """(doc_id, text, lang, source) rows as a documents table; ``extra`` adds the clashing columns."""
    full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(f"x-{c}") for c in CLASHING})
    return df


def edge_rows() -> list[tuple]:
    rnd = random.Random(4)
    words = [f"wort{i}" for i in range(60)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    text = "The first line of it is here.\nAnd a second line follows it.\nA third one ends the text."
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, "a"), (4, text, "en", None), (5, text, "en", "b"),
        (5, text, "en", "b"), (6, text + " ", "en", "b"), (7, long, "de", "c"), (8, "x", "fr", "c"), (None, "no id at all", "fr", "c"),
        (None, None, None, None), (9, "A B\x0bC d", "es", "c"), (10, "a b c d", "es", "c"), (11, "123 456", None, None), (-4, "ééé ü ñ", "fr", "a"),
    ]


def empty(spark: SparkSession) -> DataFrame:
    return docs(spark, [])


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
