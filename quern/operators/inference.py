"""INF-*: run the rule base over the facts and collect one recommendation per column, the log, the trace and the
score. What is collected is a few rows per column."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quern.operators.facts import DatasetFacts, column_facts_df, small_frame
from quern.operators.repair import Repair
from quern.operators.rules import DATASET, RuleBase, advice_text, resolve, rule_log_df, statuses
from quern.operators.score import health_df


@dataclass
class Recommendation:
    column: str
    semantic: str
    status: str = "HEALTHY"
    should_drop: bool = False
    imputation: str | None = None
    add_indicator: bool = False
    encoding: str | None = None
    scaling: list[str] = field(default_factory=list)
    datetime: bool = False
    co_missing_with: list[str] = field(default_factory=list)
    fired: list[dict] = field(default_factory=list)


@dataclass
class Inference:
    recommendations: dict[str, Recommendation]
    log: list[dict]
    trace: list[tuple[str, str]]
    health: dict

    def to_dict(self) -> dict:
        return {"health_score": self.health, "reasoning_trace": [{"phase": p, "message": m} for p, m in self.trace],
                "triggered_rules_count": len(self.log), "triggered_rules_log": self.log,
                "column_recommendations": {c: vars(r) for c, r in self.recommendations.items()}}


def infer(spark: SparkSession, facts: DatasetFacts, repairs: list[Repair] | None = None,
          base: RuleBase | None = None) -> Inference:
    base = base or RuleBase()
    repairs = repairs or []
    frame = column_facts_df(spark, facts)
    log_frame = rule_log_df(spark, facts, base)
    log = [r.asDict() for r in log_frame.orderBy("position", "rule_order").collect()]
    rules = {r.rule_id: r for r in base.rules}
    strongest = {r["name"]: r["max_abs_corr"] for r in frame.select("name", "max_abs_corr").collect()}

    recs = {c: Recommendation(c, f.semantic) for c, f in facts.columns.items()}
    for r in statuses(log_frame, frame).collect():
        recs[r["column"]].status = r["status"]
    for entry in log:
        c = entry["column"]
        if c == DATASET:
            continue
        rec, f = recs[c], facts.columns[c]
        rec.fired.append({**entry, "rationale": advice_text(rules[entry["rule_id"]], f, strongest[c])})
        rec.should_drop |= entry["action"] == "drop_column"
        if entry["rule_id"] == "R-IMP-07":
            rec.co_missing_with = sorted({p.feature_b if p.feature_a == c else p.feature_a
                                          for p in facts.missing_pairs if c in (p.feature_a, p.feature_b)})
    for r in resolve(log_frame).orderBy("position", "rule_order").collect():
        rec, f = recs[r["column"]], facts.columns[r["column"]]
        if r["category"] == "IMPUTATION":
            rec.imputation = r["action"]
            by_share = r["action"] in ("impute_median", "impute_mean") and f.missing_pct >= 3.0
            rec.add_indicator = by_share or bool(rec.co_missing_with)
        elif r["category"] == "ENCODING":
            rec.encoding = r["action"]
        elif r["category"] == "SCALING_OUTLIERS":
            rec.scaling.append(r["action"])
        elif r["category"] == "DATETIME":
            rec.datetime = True

    health = health_df(spark, facts).first().asDict()
    health["repairs_applied"] = len(repairs)
    return Inference(recs, log, _trace(facts, repairs, base, recs, health), health)


def _trace(facts, repairs, base, recs, health) -> list[tuple[str, str]]:
    out = [("INGESTION_AUDIT", f"{facts.rows} rows, {len(facts.columns)} columns, about {facts.data_bytes} bytes.")]
    if facts.rows < 2:
        out.append(("DATASET_WARNING", "Fewer than 2 rows: spread, constants and associations cannot be judged."))
    out += [("DATA_QUALITY_REPAIR", f"[{r.rule_id}] {r.column}: {r.affected} cell(s); {r.note}.") for r in repairs]
    out.append(("INTEGRITY_CHECK", f"{facts.duplicate_rows} exact duplicate row(s)."))
    if facts.hidden_duplicate_rows:
        out.append(("INTEGRITY_CHECK", f"[R-INT-01] {facts.hidden_duplicate_rows} row(s) repeat once identifiers are "
                                       "ignored; the recipe removes duplicates after identifiers are gone."))
    out += [("RULE_ERROR", f"rule {rule_id} was skipped: {message}") for rule_id, message in base.failures]
    dropped = [c for c, r in recs.items() if r.should_drop]
    if dropped:
        out.append(("RULE_EVALUATION", f"{len(dropped)} column(s) to drop: {', '.join(dropped)}."))
    filled = sum(1 for r in recs.values() if r.imputation and not r.should_drop)
    out.append(("IMPUTATION_ANALYSIS", f"{filled} column(s) with a fill strategy."))
    out.append(("MULTICOLLINEARITY_AUDIT", f"{len(facts.high_pairs)} pair(s) with association of at least 0.75."))
    out.append(("HEALTH_ASSESSMENT", f"score {health['overall_score']} of 100, grade {health['grade']}."))
    return out


def trace_df(spark: SparkSession, inference: Inference) -> DataFrame:
    rows = [{"step": i, "phase": p, "message": m} for i, (p, m) in enumerate(inference.trace)]
    return small_frame(spark, rows, [("step", pa.int64()), ("phase", pa.string()), ("message", pa.string())])


def recommendations_df(spark: SparkSession, inference: Inference, facts: DatasetFacts) -> DataFrame:
    s, b = pa.string(), pa.bool_()
    rows = [{**vars(r), "missing_pct": facts.columns[c].missing_pct, "unique": facts.columns[c].unique,
             "outliers": facts.columns[c].outliers, "skewness": facts.columns[c].skewness}
            for c, r in inference.recommendations.items()]
    return small_frame(spark, rows, [
        ("column", s), ("semantic", s), ("status", s), ("should_drop", b), ("imputation", s), ("add_indicator", b),
        ("encoding", s), ("scaling", pa.list_(s)), ("datetime", b), ("missing_pct", pa.float64()),
        ("unique", pa.int64()), ("outliers", pa.int64()), ("skewness", pa.float64())])
