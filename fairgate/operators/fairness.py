"""Group fairness metrics.

Labels, predictions and groups are columns of one DataFrame.  All
attributes are evaluated in one pass: unpivot to (attribute, group), one
``groupBy(attribute, group)`` of confusion counts, then every metric is
arithmetic over those counts.  Overall values are sums of the group counts
(no second scan, no cross join).
"""

from __future__ import annotations

from typing import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_as_null, q, ratio, ratio_or_zero, stack
from ..spec import Thresholds
from .ordering import shared

Counts = Mapping[str, Column]


def _accuracy(c: Counts) -> Column:
    return ratio(c["correct"], c["n"])


def _precision(c: Counts) -> Column:
    return ratio_or_zero(c["tp"], c["tp"] + c["fp"])


def _recall(c: Counts) -> Column:
    return ratio_or_zero(c["tp"], c["tp"] + c["fn"])


def _f1(c: Counts) -> Column:
    return ratio_or_zero(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"])


def _selection_rate(c: Counts) -> Column:
    return ratio(c["pred_pos"], c["n"])


# Metric dictionary name -> Column over the confusion counts (a UDAF without
# UDAF code); callers may pass more.
METRICS: dict[str, Callable[[Counts], Column]] = {
    "accuracy": _accuracy,
    "precision": _precision,
    "recall": _recall,
    "f1_score": _f1,
    "selection_rate": _selection_rate,
}
DEFAULT_METRICS = ["accuracy", "precision", "recall", "f1_score", "selection_rate"]
# Metrics whose between-group difference is checked (A17), and
# their display names.
DIFFERENCE_CHECKED = {"accuracy": "Accuracy", "precision": "Precision",
                      "recall": "Recall", "f1_score": "F1_score"}
COUNT_COLS = ["n", "correct", "tp", "fp", "fn", "pred_pos"]


def _chosen(metric_names: Sequence[str] | None,
            extra: Mapping[str, Callable[[Counts], Column]] | None):
    table = dict(METRICS, **(extra or {}))
    names = list(metric_names) if metric_names is not None else DEFAULT_METRICS
    return {k: table[k] for k in names if k in table}   # unknown names ignored


def confusion_counts(df: DataFrame, y_true: str, y_pred: str,
                     attributes: Sequence[str], positive=1) -> DataFrame:
    """(attribute, group, n, correct, tp, fp, fn, pred_pos); rows with a NULL
    label, prediction or group are left out."""
    df = nan_as_null(df)
    as_label = lambda c: q(c).cast("int") if isinstance(df.schema[c].dataType, T.BooleanType) else q(c)
    long = (df.where(q(y_true).isNotNull() & q(y_pred).isNotNull())
            .select(stack([(F.lit(a), q(a).cast("string")) for a in attributes],
                          ["attribute", "group"]),
                    as_label(y_true).alias("_t"), as_label(y_pred).alias("_p"))
            .where(F.col("group").isNotNull()))
    t_pos, p_pos = F.col("_t") == positive, F.col("_p") == positive
    return long.groupBy("attribute", "group").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_t") == F.col("_p")).alias("correct"),
        F.count_if(t_pos & p_pos).alias("tp"),
        F.count_if(~t_pos & p_pos).alias("fp"),
        F.count_if(t_pos & ~p_pos).alias("fn"),
        F.count_if(p_pos).alias("pred_pos"))


def _apply(counts: DataFrame, keys: Sequence[str], metrics) -> DataFrame:
    c = {k: F.col(k) for k in COUNT_COLS}
    return counts.select(*keys, "n", *[fn(c).alias(name) for name, fn in metrics.items()])


def group_metrics(df: DataFrame, y_true: str, y_pred: str, attributes: Sequence[str],
                  metric_names: Sequence[str] | None = None,
                  extra: Mapping[str, Callable[[Counts], Column]] | None = None,
                  counts: DataFrame | None = None) -> DataFrame:
    """A13 (wide): attribute, group, n, one column per metric."""
    metrics = _chosen(metric_names, extra)
    counts = counts if counts is not None else confusion_counts(df, y_true, y_pred, attributes)
    return _apply(counts, ["attribute", "group"], metrics)


def overall_metrics(counts: DataFrame, metric_names: Sequence[str] | None = None,
                    extra=None) -> DataFrame:
    """Metrics over all rows with a group, per attribute (sums of the
    group counts)."""
    metrics = _chosen(metric_names, extra)
    totals = counts.groupBy("attribute").agg(*[F.sum(k).alias(k) for k in COUNT_COLS])
    return _apply(totals, ["attribute"], metrics)


def _long(wide: DataFrame, keys: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
    return wide.unpivot(list(keys), list(names), "metric", value)


def metric_summary(df: DataFrame, y_true: str, y_pred: str, attributes: Sequence[str],
                   metric_names: Sequence[str] | None = None, extra=None,
                   counts: DataFrame | None = None) -> DataFrame:
    """A14 + A15: attribute, metric, overall, group_min, group_max,
    difference (max - min), ratio (min / max, NULL when max is 0)."""
    metrics = _chosen(metric_names, extra)
    names = list(metrics)
    # group rows and overall sums both come from one count table
    counts = counts if counts is not None else shared(confusion_counts(df, y_true, y_pred, attributes))
    by_group = _long(_apply(counts, ["attribute", "group"], metrics).drop("n"),
                     ["attribute", "group"], names, "value")
    spread = by_group.groupBy("attribute", "metric").agg(
        F.min("value").alias("group_min"), F.max("value").alias("group_max"))
    overall = _long(overall_metrics(counts, names, extra).drop("n"),
                    ["attribute"], names, "overall")
    return (spread.join(overall, ["attribute", "metric"])
            .select("attribute", "metric", "overall", "group_min", "group_max",
                    (F.col("group_max") - F.col("group_min")).alias("difference"),
                    ratio(F.col("group_min"), F.col("group_max")).alias("ratio")))


def demographic_parity(summary: DataFrame) -> DataFrame:
    """Attribute, dp_difference, dp_ratio (A15 on selection_rate)."""
    return (summary.where(F.col("metric") == "selection_rate")
            .select("attribute", F.col("difference").alias("dp_difference"),
                    F.col("ratio").alias("dp_ratio")))


def violations(summary: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Attribute, metric, violation text.  Parity ratio below the
    threshold (a NULL ratio is no violation); |difference| above the
    threshold for accuracy/precision/recall/f1_score."""
    th = thresholds or Thresholds()
    parity = summary.where((F.col("metric") == "selection_rate")
                           & (F.col("ratio") < th.parity_ratio)).select(
        "attribute", F.lit("demographic_parity").alias("metric"),
        F.format_string("Demographic parity violation: ratio = %.3f (should be ≥ %s)",
                        F.col("ratio"), F.lit(str(th.parity_ratio))).alias("violation"))
    names = F.create_map(*[x for k, v in DIFFERENCE_CHECKED.items()
                           for x in (F.lit(k), F.lit(v))])
    diffs = summary.where(F.col("metric").isin(list(DIFFERENCE_CHECKED))
                          & (F.abs(F.col("difference")) > th.metric_difference)).select(
        "attribute", "metric",
        F.format_string("%s disparity: %.3f difference between groups",
                        names[F.col("metric")], F.abs(F.col("difference"))).alias("violation"))
    return parity.unionByName(diffs)


def fairness_report(summary: DataFrame) -> DataFrame:
    """Two rows per attribute: protected_attribute, metric
    (demographic_parity_difference / _ratio), value."""
    dp = demographic_parity(summary)
    return dp.select(
        F.col("attribute").alias("protected_attribute"),
        F.expr("stack(2, 'demographic_parity_difference', dp_difference, "
               "'demographic_parity_ratio', dp_ratio) as (metric, value)"))


def fairness_summary(viol: DataFrame) -> DataFrame:
    """total_violations and FAIR / CONCERNS."""
    return viol.agg(F.count(F.lit(1)).alias("total_violations")).select(
        "total_violations",
        F.when(F.col("total_violations") == 0, F.lit("FAIR"))
        .otherwise(F.lit("CONCERNS")).alias("status"))


def quick_fairness_check(df: DataFrame, y_true: str, y_pred: str,
                         attributes: Sequence[str],
                         thresholds: Thresholds | None = None) -> dict[str, DataFrame]:
    """The whole bundle; every table reads one count table, written once."""
    counts = shared(confusion_counts(df, y_true, y_pred, attributes))
    summary = metric_summary(df, y_true, y_pred, attributes, counts=counts)
    viol = violations(summary, thresholds)
    return {
        "counts": counts,
        "by_group": group_metrics(df, y_true, y_pred, attributes, counts=counts),
        "summary": summary,
        "demographic_parity": demographic_parity(summary),
        "violations": viol,
        "report": fairness_report(summary),
        "status": fairness_summary(viol),
    }
