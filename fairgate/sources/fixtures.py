"""Governance inputs derived from the driver tables (FIXTURES.md §3).
Each is a lazy DataFrame whose size grows with the scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table


def orders_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to customer: group ``c_mktsegment``, outcome
    ``is_filled`` = (o_orderstatus = 'F').  Customer is the dimension side;
    AQE picks broadcast at runtime when its measured size allows, and
    otherwise the sort-merge join (skew split on a hot customer)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .withColumn("is_filled", (F.col("o_orderstatus") == "F").cast("int")))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⋈ labels: y_true = quality, y_pred = 1 - toxic, attributes
    lang and source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id")
            .withColumn("y_true", F.col("quality"))
            .withColumn("y_pred", 1 - F.col("toxic")))


def documents_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels: quality/toxic NULL where unlabelled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
