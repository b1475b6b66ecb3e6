"""Full governance run (O9) and its result object.

Stage order follows the reference: PII on the raw table, minimisation,
then bias EDA, audit and representation on the chosen table
(``bias_on='minimised'`` reproduces the reference, where protected columns
are already dropped; ``'raw'`` keeps them and is the useful default), and
finally the verdict.  Every result is a DataFrame; only schema-sized lists
(classes, low-importance names) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_as_null
from ..operators import minimise, pii, representation, stats
from ..operators.cube import value_cube
from ..operators.ordering import shared
from ..operators.untested import not_tested
from ..spec import DatasetSpec
from .audit import AuditResult, run_audit
from .eda import EdaFindings, finding_counts, run_bias_eda
from .minimisation import run_minimisation
from .verdict import count_signal, verdict


@dataclass
class GovernanceResult:
    spec: DatasetSpec
    pii_findings: DataFrame
    feature_class: DataFrame
    feature_importance: DataFrame | None
    exclusion_log: DataFrame
    minimal: DataFrame
    minimisation_report: DataFrame
    eda: EdaFindings
    eda_counts: DataFrame
    audit: AuditResult
    representation: DataFrame
    signals: DataFrame
    verdict: DataFrame
    not_tested: DataFrame
    metadata: DataFrame
    extra: dict = field(default_factory=dict)

    def findings(self) -> dict[str, DataFrame]:
        """Every result table by name."""
        out = {
            "pii_findings": self.pii_findings, "feature_class": self.feature_class,
            "exclusion_log": self.exclusion_log, "minimisation_report": self.minimisation_report,
            "eda_counts": self.eda_counts, "schema": self.audit.schema,
            "quality": self.audit.quality, "quality_rollup": self.audit.quality_rollup,
            "expectations": self.audit.expectations, "audit_status": self.audit.status,
            "representation": self.representation, "verdict": self.verdict,
            "expectation_summary": self.audit.expectation_summary,
            "not_tested": self.not_tested, "metadata": self.metadata,
        }
        if self.feature_importance is not None:
            out["feature_importance"] = self.feature_importance
        if self.audit.drift is not None:
            out["drift"] = self.audit.drift
            out["drift_status"] = self.audit.drift_status
        out.update({f"eda_{k}": v for k, v in self.eda.tables().items()})
        return out


def run_governance(df: DataFrame, spec: DatasetSpec, bias_on: str = "raw",
                   forest: minimise.ForestParams | None = None,
                   importance: bool = True, reference: DataFrame | None = None) -> GovernanceResult:
    """O9.  ``importance=False`` skips the forest (no low-importance
    exclusions, as when the reference's importance step fails)."""
    if bias_on not in ("raw", "minimised"):
        raise ValueError("bias_on must be 'raw' or 'minimised'")
    maps = [f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()]
    if maps:
        raise ValueError(f"map columns cannot be compared, hashed or counted: {', '.join(maps)}")
    df = nan_as_null(df)
    started = datetime.now(timezone.utc).isoformat()
    pii_f = pii.pii_findings(df)
    mini = run_minimisation(df, spec, forest, importance)
    classes, imps, minimal, log, report = (mini.feature_class, mini.importances, mini.minimal,
                                           mini.exclusion_log, mini.report)
    analysed = minimal if bias_on == "minimised" else df
    # one scan of null flags x target feeds T2, P3 and the expectation suite
    has_target = spec.target in analysed.columns
    testable = has_target and stats.missingness_testable(analysed, spec.target, spec)
    null_counts = (stats.null_flag_counts(analysed, spec.target, by_value=testable)
                   if has_target and len(analysed.columns) > 1 else None)
    # one scan of values x target feeds A2, A3, T5 and F9
    cube = value_cube(analysed, spec)
    eda = run_bias_eda(analysed, spec, null_counts, testable, cube)
    counts = finding_counts(eda)
    audit = run_audit(analysed, spec, reference, null_counts, cube)
    rep = representation.representation_for_spec(analysed, spec, cube)
    signals = (count_signal(log, "excluded_count")
               .unionByName(count_signal(classes, "prohibited_features_count",
                                         F.col("class") == "prohibited"))
               .unionByName(audit.status.select(
                   F.lit("audit_compliant").alias("check"),
                   (F.col("compliance_status") == "COMPLIANT").cast("long").alias("n")))
               .unionByName(counts))
    # the signals read every check: written once, whoever reads the verdict
    signals = shared(signals)
    skipped = not_tested(analysed, spec, reference, mini.importance_reason if importance else None)
    result = verdict(signals, spec.thresholds)
    metadata = result.select(
        F.lit(spec.name).alias("name"), F.lit(spec.domain).alias("domain"), F.lit(spec.target).alias("target"),
        F.array(*[F.lit(a) for a in spec.protected_attributes]).cast("array<string>").alias("protected_attributes"),
        F.lit(started).alias("pipeline_start"), F.lit("completed").alias("status"), F.col("overall_status"))
    return GovernanceResult(spec, pii_f, classes, imps, log, minimal, report, eda, counts,
                            audit, rep, signals, result, skipped, metadata)
