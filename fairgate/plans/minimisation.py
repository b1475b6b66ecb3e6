"""Minimisation chain (O1): classify features (M2), forest importance (T6,
optional), then the minimal table and its exclusion log (J1), with the
count report (O2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import minimise
from ..spec import DatasetSpec


@dataclass
class MinimisationResult:
    minimal: DataFrame
    exclusion_log: DataFrame
    importances: DataFrame | None
    feature_class: DataFrame
    report: DataFrame
    importance_reason: str | None = None


def run_minimisation(df: DataFrame, spec: DatasetSpec,
                     forest: minimise.ForestParams | None = None,
                     importance: bool = True, exclude_protected: bool = True,
                     exclude_low_importance: bool = True) -> MinimisationResult:
    """O1.  Without a target column (or with ``importance=False``), or when no
    forest can learn the target (``importance_reason`` says why), no forest
    is trained and only protected columns are excluded."""
    classes = minimise.classify_features(df, spec)
    reason = minimise.importance_status(df, spec.target) if importance else "not asked for"
    imps = minimise.feature_importance(df, spec.target, forest) if reason is None else None
    minimal, log = minimise.create_minimal_dataset(
        df, classes, spec, imps, exclude_protected=exclude_protected,
        exclude_low_importance=exclude_low_importance)
    report = minimise.minimisation_report(classes, imps, spec)
    return MinimisationResult(minimal, log, imps, classes, report, reason)
