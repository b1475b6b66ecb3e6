"""Outputs (S4, S5, S6): the cleaned table as CSV, the findings as JSON
(one directory per table plus a one-line JSON verdict), and a plain-text
compliance summary.  All writes are distributed DataFrame writes."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: layout of the text summary.
SUMMARY_TEMPLATE = """
GOVERNANCE COMPLIANCE SUMMARY
================================

Domain: %s
Status: %s
Date: %s

GDPR COMPLIANCE:
- Art. 5(1)(c) Data Minimisation: %s
- Art. 5(1)(d) Data Accuracy: %s
- Art. 9 Special Categories: %s

EU AI ACT COMPLIANCE:
- Annex III High-risk AI: %s

CRITICAL ISSUES: %d
WARNINGS: %d
RECOMMENDATIONS: %d

================================
"""


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, one file per partition; quotes are doubled, blanks and
    line ends kept.  An empty text is written like NULL, as pandas does."""
    (df.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                                 ignoreTrailingWhiteSpace=False).csv(path))


def verdict_json(verdict: DataFrame, domain: str) -> DataFrame:
    """S5 helper: the verdict row as one JSON string column ``report``."""
    return verdict.select(F.to_json(F.struct(
        F.lit(domain).alias("domain"), F.current_timestamp().alias("pipeline_end"),
        *[F.col(c) for c in verdict.columns])).alias("report"))


def write_json_report(tables: Mapping[str, DataFrame], path: str,
                      mode: str = "overwrite") -> None:
    """Every findings table as JSON lines under ``path/<name>``."""
    for name, df in tables.items():
        df.write.mode(mode).json(f"{path.rstrip('/')}/{name}")


def summary_text(verdict: DataFrame, domain: str) -> DataFrame:
    """The text summary as a one-row ``value`` column."""
    return verdict.select(F.format_string(
        SUMMARY_TEMPLATE, F.lit(domain), F.col("overall_status"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
        F.col("gdpr_article_5_1_c"), F.col("gdpr_article_5_1_d"), F.col("gdpr_article_9"),
        F.col("eu_ai_act_annex_iii"), F.size("issues"), F.size("warnings"),
        F.size("recommendations")).alias("value"))


def write_summary(verdict: DataFrame, domain: str, path: str, mode: str = "overwrite") -> None:
    summary_text(verdict, domain).coalesce(1).write.mode(mode).text(path)
