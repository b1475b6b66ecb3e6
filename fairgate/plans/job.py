"""Batch job: the reference's upload -> run -> download flow as one
spark-submit run (S1 in; O9; S4, S5, S6 out).

    spark-submit fairgate/plans/job.py --input data.csv --target approved \\
        --domain credit_scoring --out /shared/governance/run-1

Outputs under ``--out``: ``cleaned/`` (minimal table, CSV with header),
``report/<table>/`` (every findings table as JSON lines), ``report/verdict``
(one JSON line) and ``summary/`` (the text summary).
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from fairgate.plans.pipeline import run_governance  # noqa: E402
from fairgate.sources import readers, sinks  # noqa: E402
from fairgate.spec import DatasetSpec  # noqa: E402


def run(spark: SparkSession, input_path: str, target: str, domain: str, out: str,
        protected: list[str] | None = None, input_format: str = "csv",
        bias_on: str = "raw", importance: bool = True, positive_label: str | None = None,
        reference_path: str | None = None):
    load = lambda path: (readers.read_csv(spark, path) if input_format == "csv"
                         else spark.read.format(input_format).load(path))
    spec = DatasetSpec.for_domain(domain, target, protected, positive_label=positive_label)
    result = run_governance(load(input_path), spec, bias_on=bias_on, importance=importance,
                            reference=load(reference_path) if reference_path else None)
    base = out.rstrip("/")
    sinks.write_csv(result.minimal, f"{base}/cleaned")
    tables = {name: df for name, df in result.findings().items() if name != "verdict"}
    sinks.write_json_report(tables, f"{base}/report")
    sinks.verdict_json(result.verdict, domain).write.mode("overwrite").text(f"{base}/report/verdict")
    sinks.write_summary(result.verdict, domain, f"{base}/summary")
    return result


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="pre-training governance checks")
    p.add_argument("--input", required=True)
    p.add_argument("--format", default="csv")
    p.add_argument("--target", required=True)
    p.add_argument("--domain", default="other")
    p.add_argument("--protected", nargs="*", default=None)
    p.add_argument("--positive-label", default=None, help="the text target's favourable value")
    p.add_argument("--reference", default=None, help="earlier table of the same columns, for drift")
    p.add_argument("--bias-on", default="raw", choices=["raw", "minimised"])
    p.add_argument("--no-importance", action="store_true")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("fairgate-governance").getOrCreate()
    run(spark, a.input, a.target, a.domain, a.out, a.protected, a.format, a.bias_on,
        not a.no_importance, a.positive_label, a.reference)


if __name__ == "__main__":
    main()
