"""JOB-1, JOB-2: the audit and clean jobs, for spark-submit.

    spark-submit --py-files quern.zip quern/plans/jobs.py audit INPUT [-o REPORT] [--no-repair]
    spark-submit --py-files quern.zip quern/plans/jobs.py clean INPUT -o OUTPUT [--target COLUMN] [--format F] [--no-repair]
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quern.operators.facts import DatasetFacts
from quern.operators.inference import Inference, infer
from quern.operators.profile import profile
from quern.operators.recipe import Recipe, RecipeModel
from quern.operators.repair import Repair, RepairPlan, repair
from quern.operators.target import analyze_target
from quern.sources.scan import scan
from quern.sources.sinks import output_format, write, write_report
from quern.sources.staging import Staging


@dataclass
class Analysis:
    table: DataFrame
    plan: RepairPlan
    facts: DatasetFacts
    inference: Inference
    staging: Staging | None = None

    def release(self) -> None:
        """Delete what was staged; `table` cannot be read any more."""
        if self.staging:
            self.staging.release()

    @property
    def repairs(self) -> list[Repair]:
        return self.plan.repairs


def analyze(df: DataFrame, auto_repair: bool = True, order_by: str | None = None, stage: Staging | None = None) -> Analysis:
    """Repair, profile and rules, on a table of any size. With `stage` the repaired table is stored before its profile."""
    plan = RepairPlan([])
    if auto_repair:
        df, plan = repair(df, order_by)
        df = stage(df) if stage and plan.repairs else df
    facts = profile(df)
    return Analysis(df, plan, facts, infer(df.sparkSession, facts, plan.repairs), stage)


def audit(spark: SparkSession, path: str, output: str | None = None, auto_repair: bool = True,
          target: str | None = None) -> Analysis:
    """JOB-1. The input is parsed once; `Analysis.release` deletes what was staged."""
    stage = Staging(spark)
    df, meta = scan(spark, path, stage)
    found = analyze(df, auto_repair, stage=stage)
    if output:
        about = analyze_target(found.table, target).to_dict() if target else None
        write_report(spark, output, meta.to_dict(), found.repairs, found.facts, found.inference, about)
    return found


def clean(spark: SparkSession, path: str, output: str, target: str | None = None, fmt: str | None = None,
          auto_repair: bool = True, recipe: Recipe | None = None, mode: str = "errorifexists"
          ) -> tuple[Analysis, RecipeModel, str | None]:
    """JOB-2. The input is parsed once; `Analysis.release` deletes what was staged."""
    kind = output_format(output, fmt)
    stage = Staging(spark)
    df, _ = scan(spark, path, stage)
    found = analyze(df, auto_repair, stage=stage)
    task = analyze_target(found.table, target).task if target else None
    model = (recipe or Recipe(target=target)).fit(found.table, found.facts, found.inference)
    write(model.transform(found.table), output, kind, mode)
    return found, model, task


def _report(found: Analysis, repaired: bool) -> None:
    h = found.inference.health
    print(f"shape: {found.facts.rows} rows x {len(found.facts.columns)} columns")
    print(f"health: {h['overall_score']}/100, grade {h['grade']}")
    print(h["diagnosis"])
    if not repaired:
        print("repairs: skipped")
    elif not found.repairs:
        print("repairs: none needed")
    for r in found.repairs:
        print(f"  [{r.rule_id}] {r.name}: {r.column}, {r.affected} cell(s)")
    for issue in h["critical_issues"]:
        print(f"  - {issue}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("audit", "clean"):
        p = jobs.add_parser(name)
        p.add_argument("input")
        p.add_argument("-o", "--output", required=name == "clean")
        p.add_argument("--target")
        p.add_argument("--no-repair", action="store_true")
        if name == "clean":
            p.add_argument("--format", choices=["csv", "parquet", "table"])
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"table-{args.job}").getOrCreate()
    try:
        if args.job == "audit":
            found = audit(spark, args.input, args.output, not args.no_repair, args.target)
            _report(found, not args.no_repair)
        else:
            found, model, task = clean(spark, args.input, args.output, args.target, args.format, not args.no_repair)
            _report(found, not args.no_repair)
            if task:
                print(f"target: {args.target} ({task})")
            for step in model.log:
                print(f"  - {step}")
            print(f"written to {args.output}")
        found.release()
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
