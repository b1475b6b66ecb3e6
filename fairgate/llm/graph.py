"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


#: rows that one partition of a small table may hold
ROWS = 20_000


def portions(spark: SparkSession, rows: int) -> int:
    """Partitions for so many narrow rows, and no fewer than the cluster has
    cores.  ``coalesce`` to it leaves large tables as they are; of a small one
    the many rounds do not make hundreds of empty tasks and files each."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS))


def _left(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes keep them from being stars
    around smallest nodes: those with two smaller neighbours, or with smaller
    and larger ones."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("small"), F.lit(0).alias("large"))
            .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("small"), F.lit(1).alias("large"))))
    found = ends.groupBy("node").agg(F.sum("small").alias("small"), F.max("large").alias("large"))
    row = found.agg(F.sum("small"), F.count_if(F.expr("small > 1 or small = 1 and large = 1"))).first()
    return row[0] or 0, row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v): the component is
    its smallest node.

    Each round joins every node's larger neighbours to its smallest one
    (large star), then its smaller neighbours likewise (small star); the
    number of rounds is logarithmic in the longest chain.  Every round is
    checkpointed.  The minimum is a partial aggregate and the joins may split,
    so a node with very many links is no burden.
    """
    spark = links.sparkSession
    # every edge points from its larger node u to its smaller node v
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        rows, left = _left(edges)
        n = portions(spark, rows)
        edges = edges.coalesce(n)
        if not left:
            break
        # the smallest neighbour of a node without smaller ones is itself
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        large = (edges.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v")).coalesce(n)
                 # the smallest neighbour's own edge keeps the node in the graph
                 .unionByName(least.select("u", F.col("m").alias("v")).coalesce(n)).distinct().coalesce(n))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(n)
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v")).coalesce(n)).distinct().coalesce(n))
    # every node hangs on its root alone now
    roots = edges.select(F.col("v").alias("u"), "v").distinct().coalesce(n)
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
