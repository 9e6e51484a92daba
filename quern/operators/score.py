"""SCO-1, SCO-2: the 0-100 health score, its grade, and the list of critical issues, from one row of counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.facts import DatasetFacts, column_facts_df, small_frame

CLEAN = "The table is in good shape; usual scaling and encoding is enough."


def _clamp(expr: str) -> str:
    return f"greatest(0D, least(100D, 100D - ({expr})))"


def health_df(spark: SparkSession, facts: DatasetFacts) -> DataFrame:
    """One row: sub-scores, overall score, grade, issues and diagnosis."""
    i, f = pa.int64(), pa.float64()
    totals = small_frame(spark, [{
        "missing_pct": facts.missing_pct, "duplicate_pct": facts.duplicate_pct,
        "hidden": facts.hidden_duplicate_rows, "pairs": len(facts.high_pairs)}],
        [("missing_pct", f), ("duplicate_pct", f), ("hidden", i), ("pairs", i)])
    counts = column_facts_df(spark, facts).agg(
        F.count("*").alias("cols"),
        F.count_if(F.expr("missing > 0")).alias("gappy"),
        F.count_if(F.expr("semantic IN ('numerical_continuous', 'numerical_discrete')")).alias("nums"),
        F.count_if(F.expr("has_numeric AND abs(skewness) >= 1.2")).alias("skewed"),
        F.count_if(F.expr("has_numeric AND outlier_pct >= 2.5")).alias("outlying"),
        F.count_if(F.expr("semantic = 'constant'")).alias("constants"),
        F.count_if(F.expr("semantic = 'identifier'")).alias("ids"),
        F.count_if(F.expr("semantic = 'categorical_nominal' AND unique > 10")).alias("high_card"),
        F.count_if(F.expr("semantic = 'datetime'")).alias("dates"))
    # Weights, penalties and grade limits.
    scored = counts.join(F.broadcast(totals)).selectExpr(
        "*",
        _clamp("2 * missing_pct + 20 * gappy / greatest(cols, 1)") + " AS completeness",
        _clamp("35 * skewed / greatest(nums, 1) + 35 * outlying / greatest(nums, 1)") + " AS distribution",
        _clamp("2.5D * duplicate_pct + 20 * constants + 15 * ids + least(25, 6 * pairs)") + " AS parsimony",
        _clamp("12 * high_card + 10 * dates") + " AS encoding_readiness",
    ).selectExpr(
        "*", "round(greatest(5D, least(100D, 0.30D * completeness + 0.25D * distribution + 0.25D * parsimony "
             "+ 0.20D * encoding_readiness)), 1) AS overall_score")
    issues = """array_compact(array(
        CASE WHEN missing_pct > 15 THEN concat('many empty cells (', format_number(missing_pct, 2), ' %)') END,
        CASE WHEN ids > 0 THEN concat(ids, ' identifier column(s)') END,
        CASE WHEN constants > 0 THEN concat(constants, ' constant column(s)') END,
        CASE WHEN pairs > 0 THEN concat(pairs, ' strongly associated column pair(s)') END,
        CASE WHEN outlying > 0 THEN concat(outlying, ' numeric column(s) with many outliers') END,
        CASE WHEN hidden > 0 THEN concat(hidden, ' row(s) that repeat once identifiers are ignored') END))"""
    return scored.selectExpr(
        "overall_score",
        "CASE WHEN overall_score >= 92 THEN 'A+' WHEN overall_score >= 83 THEN 'A' WHEN overall_score >= 72 THEN 'B' "
        "WHEN overall_score >= 60 THEN 'C' WHEN overall_score >= 45 THEN 'D' ELSE 'F' END AS grade",
        "round(completeness, 1) AS completeness", "round(distribution, 1) AS distribution",
        "round(parsimony, 1) AS parsimony", "round(encoding_readiness, 1) AS encoding_readiness",
        f"{issues} AS critical_issues",
    ).selectExpr("*", f"CASE WHEN size(critical_issues) = 0 THEN '{CLEAN}' "
                      "ELSE concat('To prepare: ', array_join(critical_issues, '; '), '.') END AS diagnosis")
