"""fairgate: pre-training data governance and fairness checks as Spark
DataFrame plans.

Main entry points: ``run_governance`` (the full pipeline, O9),
``quick_fairness_check`` (A20), ``pii_findings`` / ``anonymize`` (X2, X4),
and ``DatasetSpec`` to describe the governed table.
"""

from .spec import DatasetSpec, Thresholds, match_protected, protected_for_domain


def __getattr__(name):
    # lazy: importing the package must not need a running Spark session
    if name == "run_governance":
        from .plans.pipeline import run_governance
        return run_governance
    if name == "quick_fairness_check":
        from .operators.fairness import quick_fairness_check
        return quick_fairness_check
    if name in ("pii_findings", "anonymize"):
        from .operators import pii
        return getattr(pii, name)
    raise AttributeError(name)


__all__ = ["DatasetSpec", "Thresholds", "match_protected", "protected_for_domain",
           "run_governance", "quick_fairness_check", "pii_findings", "anonymize"]
