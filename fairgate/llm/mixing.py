"""Mixing sources to target weights in a domain > language > source tree.

The token budget goes down the tree level by level: the children of a node
share its budget by their weights, a child takes no more than the tokens below
it times ``max_epochs``, and what it leaves goes to its siblings by the same
rule; only when all siblings are full does the node itself take less, which
its own siblings then share.  A leaf with budget a and s tokens is taken a div
s times as a whole, and the rest is the token-prefix of one more epoch, in an
order seeded by (seed, epoch, doc_id).

All on DataFrame functions.  Budgets are integers (shares are rounded down).
The prefix sums of a leaf run in buckets of the seeded order, so a leaf with a
third of all rows is many small windows.

Defined cases: a token is a run without ASCII white space; null text has no
token; null language or source counts as the name ``none``; documents without
tokens are taken in a leaf's first epoch or with its prefix; rows that share a
doc_id share a place in the order and are taken together; a budget beyond all
capacities takes everything ``max_epochs`` times; an empty table gives no
rows; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .textutil import unused

TOKEN = r"[^\x20\x09-\x0D]+"
LEVELS = ("domain", "lang", "source")
NONE = "none"
BUCKET_ROWS = 2_000
BROADCAST_LEAVES = 100_000      # checked before the leaf table is broadcast


def domain_of(source: Column) -> Column:
    """The documents name no domain: four of them, by the source's hash."""
    digit = F.substring(F.md5(source), 1, 1)
    return (F.when(source.isNull(), NONE).when(digit < "4", "d0").when(digit < "8", "d1")
            .when(digit < "c", "d2").otherwise("d3"))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """Weight of the column's value (1 where none is given)."""
    given = weights.get(level) or {}
    if not given:
        return F.lit(1)
    table = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1))


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``budget`` to children (parent columns, name, cap, w, total): each
    takes cap or its share of what the full ones leave."""
    wide = lambda c: c.cast("decimal(19,0)")
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy(*parent)
    full = wide(F.col("cap")) * wide(onward) <= wide(F.greatest(F.col("total") - before, F.lit(0))) * wide(F.col("w"))
    flagged = children.withColumn("full", full)
    left = F.greatest(F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole), F.lit(0))
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(whole)
    flagged = flagged.withColumn("left", left).withColumn("open_weight", open_weight)
    part = F.expr("cast(cast(left as decimal(19,0)) * cast(w as decimal(19,0)) div nullif(cast(open_weight as decimal(19,0)), 0) as bigint)")
    return flagged.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("full", "left", "open_weight")


def leaf_budgets(leaves: DataFrame, total: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """budget of every leaf (LEVELS, n_rows, tokens)."""
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    parent: list[str] = []
    budgets = None
    for depth, level in enumerate(LEVELS):
        path = [*parent, level]
        children = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights).cast("bigint"))
        if budgets is None:
            children = children.withColumn("total", F.lit(total).cast("bigint"))
        else:
            children = children.join(budgets.withColumnRenamed("budget", "total"), parent)
        budgets = _share(children, parent, level).select(*path, "budget")
        parent = path
    return leaves.join(budgets, list(LEVELS))


def _keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> list[Column]:
    q = lambda c: F.col(f"`{c}`")
    return [q(id_col).alias("doc_id"), domain_of(q(source_col)).alias("domain"), F.coalesce(q(lang_col), F.lit(NONE)).alias("lang"),
            F.coalesce(q(source_col), F.lit(NONE)).alias("source"),
            F.coalesce(F.regexp_count(q(text_col), F.lit(TOKEN)), F.lit(0)).cast("bigint").alias("n_tokens")]


def _place(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], budget_share: tuple[int, int] = (4, 5), max_epochs: int = 2,
         seed: int = 17, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
         source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, LEVELS, n_tokens), and per leaf what is taken:
    ``whole`` epochs and the documents up to ``cut`` of one more (null: none)."""
    rows = materialize(docs.select(*_keyed(docs, id_col, text_col, lang_col, source_col)))
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("tokens")))
    all_tokens = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    budgets = leaf_budgets(leaves, all_tokens * budget_share[0] // budget_share[1], weights, max_epochs)
    taken = materialize(budgets.withColumn("whole", F.expr("coalesce(budget div nullif(tokens, 0), 0)"))
                        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
                        .withColumn("buckets", F.expr(f"n_rows div {BUCKET_ROWS} + 1")))
    partial = taken.where("rest > 0 or whole = 0").select(*LEVELS, "whole", "rest", "buckets")
    partial = F.broadcast(partial) if taken.count() <= BROADCAST_LEAVES else partial
    # the order's first 32 bits choose the bucket, so buckets follow the order
    ordered = (rows.join(partial, list(LEVELS))
               .withColumn("place", _place(seed, F.col("whole"), F.col("doc_id")))
               .withColumn("bucket", F.expr("cast(conv(substr(place, 1, 8), 16, 10) as bigint) * buckets div 4294967296")))
    ordered = ordered.select(*LEVELS, "bucket", "place", "n_tokens", "rest")
    sums = ordered.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*LEVELS, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # only the bucket in which a leaf's rest ends needs its rows in order
    ends = materialize(starts.join(sums, [*LEVELS, "bucket"]).join(taken.select(*LEVELS, "rest"), list(LEVELS))
                       .where("start <= rest").select(*LEVELS, "bucket", "start", (F.col("start") + F.col("n") <= F.col("rest")).alias("all")))
    inside = ordered.join(ends, [*LEVELS, "bucket"])
    run = F.col("start") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "bucket").orderBy("place"))
    cut_in = inside.where(~F.col("all")).withColumn("run", run).where("run <= rest").groupBy(*LEVELS).agg(F.max("place").alias("cut"))
    cut_all = inside.where("all").groupBy(*LEVELS).agg(F.max("place").alias("cut"))
    cuts = cut_in.unionByName(cut_all).groupBy(*LEVELS).agg(F.max("cut").alias("cut"))
    return rows, materialize(taken.join(cuts, list(LEVELS), "left").select(*LEVELS, "whole", "cut"))


def _epochs(rows: DataFrame, keys: dict[str, Column], leaves: DataFrame, seed: int, epoch: str) -> DataFrame:
    """A row for every epoch in which a row is taken; ``keys``: its doc_id and LEVELS."""
    names = dict(zip(["doc_id", *LEVELS], unused(rows.columns, "at_id", *[f"at_{c}" for c in LEVELS])))
    of = dict(zip([*LEVELS, "whole", "cut", "times"], unused(rows.columns, *[f"of_{c}" for c in (*LEVELS, "whole", "cut", "times")])))
    leaves = leaves.select(*[F.col(c).alias(of[c]) for c in (*LEVELS, "whole", "cut")])
    leaves = F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves
    once_more = F.coalesce(_place(seed, F.col(of["whole"]), F.col(names["doc_id"])) <= F.col(of["cut"]), F.lit(False))
    return (rows.withColumns({names[k]: v for k, v in keys.items()})
            .join(leaves, [F.col(names[c]) == F.col(of[c]) for c in LEVELS])
            .withColumn(of["times"], F.col(of["whole"]) + once_more.cast("bigint")).where(F.col(of["times"]) > 0)
            .withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(of["times"]).cast("int") - 1))))


def mixture(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], seed: int = 17, **options) -> DataFrame:
    """doc_id, LEVELS, n_tokens, epoch: one row for every time that a document is taken."""
    rows, leaves = plan(docs, weights, seed=seed, **options)
    keys = {c: F.col(c) for c in ("doc_id", *LEVELS)}
    return _epochs(rows, keys, leaves, seed, "epoch").select("doc_id", *LEVELS, "n_tokens", "epoch")


def mixed_documents(docs: DataFrame, weights: Mapping[str, Mapping[str, int]], seed: int = 17, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` (all columns), as often as each is taken; the texts are not shuffled."""
    _, leaves = plan(docs, weights, seed=seed, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col, **options)
    keys = dict(zip(("doc_id", *LEVELS), _keyed(docs, id_col, text_col, lang_col, source_col)))
    return _epochs(docs, keys, leaves, seed, unused(docs.columns, "epoch")[0]).select(*[F.col(f"`{c}`") for c in docs.columns])
