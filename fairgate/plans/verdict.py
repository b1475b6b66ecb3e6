"""Compliance verdict (O8) as one aggregate over a long table of signals
(check, n): each stage contributes one-row counts, a single ``agg`` pivots
them, and the article statuses are a ``when`` ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Thresholds

# Verdict texts.
W_NO_EXCLUSION = "No features excluded during data minimisation"
I_QUALITY = "Data quality checks failed - dataset has accuracy issues"
W_PROTECTED = "%d protected attributes identified and handled appropriately"
W_BIAS = "%d potential bias issues detected"
I_BIAS = "%d significant bias issues detected"
R_UNDERREP = "Consider data augmentation or synthetic data for under-represented groups"
R_PROXIES = "Review and potentially exclude proxy variables"
R_DISPARITIES = "Apply bias mitigation techniques before model training"

SIGNALS = ["excluded_count", "audit_compliant", "prohibited_features_count",
           "underrepresented_groups_count", "proxy_variables_count",
           "statistical_disparities_count"]


def _fmt(template: str, col) -> F.Column:
    return F.format_string(template, col)


def _non_null_array(*items) -> F.Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def verdict(signals: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """O8 from (check, n) rows; missing checks count as 0.  Columns: the
    four article statuses, overall_status, issues, warnings,
    recommendations (arrays of strings) and the counts used."""
    th = thresholds or Thresholds()
    row = signals.agg(*[F.coalesce(F.sum(F.when(F.col("check") == s, F.col("n"))), F.lit(0))
                        .cast("long").alias(s) for s in SIGNALS])
    excl, audit_ok = F.col("excluded_count"), F.col("audit_compliant")
    prohibited = F.col("prohibited_features_count")
    underrep, proxies = F.col("underrepresented_groups_count"), F.col("proxy_variables_count")
    disp = F.col("statistical_disparities_count")
    bias = underrep + proxies + disp
    art_c = F.when(excl > 0, "COMPLIANT").otherwise("WARNING")
    art_d = F.when(audit_ok > 0, "COMPLIANT").otherwise("NON_COMPLIANT")
    art_9 = F.when(prohibited > 0, "COMPLIANT").otherwise("WARNING")
    annex = (F.when(bias == 0, "COMPLIANT")
             .when(bias < th.annex_iii_non_compliant, "WARNING").otherwise("NON_COMPLIANT"))
    issues = _non_null_array(
        F.when(audit_ok == 0, F.lit(I_QUALITY)),
        F.when(bias >= th.annex_iii_non_compliant, _fmt(I_BIAS, bias)))
    warnings = _non_null_array(
        F.when(excl == 0, F.lit(W_NO_EXCLUSION)),
        F.when(prohibited > 0, _fmt(W_PROTECTED, prohibited)),
        F.when((bias > 0) & (bias < th.annex_iii_non_compliant), _fmt(W_BIAS, bias)))
    recs = _non_null_array(
        F.when(underrep > 0, F.lit(R_UNDERREP)),
        F.when(proxies > 0, F.lit(R_PROXIES)),
        F.when(disp > 0, F.lit(R_DISPARITIES)))
    staged = row.select(*SIGNALS, art_c.alias("gdpr_article_5_1_c"),
                        art_d.alias("gdpr_article_5_1_d"), art_9.alias("gdpr_article_9"),
                        annex.alias("eu_ai_act_annex_iii"), issues.alias("issues"),
                        warnings.alias("warnings"), recs.alias("recommendations"))
    any_nc = F.array_contains(F.array("gdpr_article_5_1_c", "gdpr_article_5_1_d",
                                      "gdpr_article_9", "eu_ai_act_annex_iii"), "NON_COMPLIANT")
    overall = (F.when(any_nc | (F.size("issues") > 0), "NON_COMPLIANT")
               .when(F.size("warnings") > 0, "COMPLIANT_WITH_WARNINGS")
               .otherwise("COMPLIANT"))
    return staged.withColumn("overall_status", overall)


def count_signal(df: DataFrame, name: str, where=None) -> DataFrame:
    """One (check, n) row counting a findings table (optionally filtered)."""
    d = df.where(where) if where is not None else df
    return d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
