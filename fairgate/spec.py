"""Dataset description, thresholds and protected-attribute name matching
(M1, M3).  Everything here is schema-level: no data is touched."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values that must equal the reference: default protected attributes
# per domain, and the default list for any other domain.
DOMAIN_PROTECTED = {
    "credit_scoring": ["sex", "race", "age", "marital-status"],
    "hiring": ["sex", "race", "age", "disability"],
    "healthcare": ["sex", "race", "age", "ethnicity"],
    "education": ["sex", "race", "age", "disability"],
}
DEFAULT_PROTECTED = ["sex", "race", "age"]


@dataclass(frozen=True)
class Thresholds:
    """Every cut-off used by a check, as a parameter (F8)."""
    rare_group_pct: float = 5.0          # A2, strict <, on pct rounded to 2
    representation_share: float = 0.05  # A3, strict <, unrounded
    proxy_abs_r: float = 0.7             # T4, strict >
    p_value: float = 0.05                # T2, T3, T5, strict <
    low_importance: float = 0.01         # T7, strict <
    outlier_iqr_k: float = 3.0           # A7 fences
    outlier_warn_share: float = 0.05     # A7, strict > of all rows
    missing_warn_pct: float = 30.0       # A9, >= warns
    disparity_max_groups: int = 20       # T5 skips columns with more groups
    missingness_max_target_values: int = 10  # T2 tests only below this
    parity_ratio: float = 0.8            # A17, strict <
    metric_difference: float = 0.1       # A17, strict >
    annex_iii_non_compliant: int = 5     # O8, >= is NON_COMPLIANT


@dataclass(frozen=True)
class DatasetSpec:
    """Metadata of the governed table (the reference's metadata dict)."""
    target: str | None
    protected_attributes: tuple[str, ...] = tuple(DEFAULT_PROTECTED)
    name: str = "dataset"
    domain: str = "other"
    positive_label: str | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)

    @staticmethod
    def for_domain(domain: str, target: str | None,
                   protected: Sequence[str] | None = None,
                   **kw) -> "DatasetSpec":
        attrs = protected if protected is not None else protected_for_domain(domain)
        return DatasetSpec(target=target, protected_attributes=tuple(attrs),
                           name=f"{domain}_dataset", domain=domain, **kw)


def protected_for_domain(domain: str) -> list[str]:
    """M1: default protected attributes for a domain."""
    return list(DOMAIN_PROTECTED.get(domain, DEFAULT_PROTECTED))


def normalise(name: str, space: bool = True) -> str:
    """Lower case, '-' (and optionally ' ') replaced by '_'."""
    out = name.lower().replace("-", "_")
    return out.replace(" ", "_") if space else out


def match_protected(columns: Sequence[str], attrs: Sequence[str],
                    mode: str = "both") -> list[str]:
    """M3: columns matching any protected attribute, in column order, each
    column once.

    Modes (the four variants found in the reference):
      ``both``    substring, '-' and ' ' normalised on both sides (default)
      ``column``  substring, only the column side normalised
      ``dash``    substring, '-' normalised on both sides, spaces kept
      ``exact``   equality after normalising both sides
      ``token``   attribute equals a '_'-separated token of the column
    """
    out: list[str] = []
    for col in columns:
        hit = False
        for attr in attrs:
            if mode == "both":
                hit = normalise(attr) in normalise(col)
            elif mode == "column":
                hit = attr.lower() in normalise(col)
            elif mode == "dash":
                hit = normalise(attr, space=False) in normalise(col, space=False)
            elif mode == "exact":
                hit = normalise(attr) == normalise(col)
            elif mode == "token":
                hit = normalise(attr) in normalise(col).split("_") or \
                    normalise(attr) == normalise(col)
            else:
                raise ValueError(f"unknown match mode {mode!r}")
            if hit:
                break
        if hit:
            out.append(col)
    return out


def matches_by_attribute(columns: Sequence[str], attrs: Sequence[str],
                         mode: str = "column") -> list[tuple[str, str]]:
    """(attribute, column) pairs, attribute order first, without repeating a
    column (SURVEY note h: a column matched by two attributes is tested once)."""
    seen: set[str] = set()
    pairs: list[tuple[str, str]] = []
    for attr in attrs:
        for col in match_protected(columns, [attr], mode):
            if col not in seen:
                seen.add(col)
                pairs.append((attr, col))
    return pairs


# -- type families (P5) -----------------------------------------------------

def is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def columns_of(df: DataFrame, family: str) -> list[str]:
    """P5: column names by type family: text, numeric, temporal, boolean."""
    test = {"text": is_text, "numeric": is_numeric, "temporal": is_temporal,
            "boolean": lambda d: isinstance(d, T.BooleanType)}[family]
    return [f.name for f in df.schema.fields if test(f.dataType)]
