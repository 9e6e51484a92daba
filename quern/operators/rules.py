"""The rule base. A rule is data: a SQL predicate over one row of column facts, and the step it recommends. All rules
are evaluated in one projection of the facts frame; users add their own with `register_rule`."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import text
from quern.operators.facts import ColumnFacts, DatasetFacts, column_facts_df, small_frame

ADVICE_CATEGORIES = ("IMPUTATION", "MISSINGNESS_STRUCTURE", "ENCODING", "SCALING_OUTLIERS", "FILTERING_LEAKAGE",
                     "DATETIME", "DATASET_LEVEL")
DATASET = "(dataset)"


@dataclass(frozen=True)
class ProductionRule:
    rule_id: str
    name: str
    category: str
    severity: str        # CRITICAL, WARNING, OPTIMIZATION or INFO
    confidence: float
    action: str
    predicate: str       # SQL over a row of column_facts_df
    advice: str          # one sentence; {placeholders} are fields of ColumnFacts


_GAPS = "missing > 0 AND missing_pct < 70"

# Rule ids, names, severities, confidences and thresholds.
RULES: tuple[ProductionRule, ...] = (
    ProductionRule("R-IMP-01", "Excessive Missingness Column Pruning", "IMPUTATION", "CRITICAL", 0.96, "drop_column",
                   "missing_pct >= 70", "{missing_pct:.2f} % of the cells are empty; too little is left to fill from."),
    ProductionRule("R-IMP-02", "Skewed / Outlier-Prone Numerical Median Imputation", "IMPUTATION", "WARNING", 0.92,
                   "impute_median", f"{_GAPS} AND has_numeric AND (abs(skewness) >= 0.8 OR outlier_pct >= 2)",
                   "Skew {skewness:.3f} with {outliers} outliers: the median resists the tail."),
    ProductionRule("R-IMP-03", "Symmetric Gaussian Numerical Mean Imputation", "IMPUTATION", "INFO", 0.88,
                   "impute_mean", f"{_GAPS} AND has_numeric AND abs(skewness) < 0.8 AND outlier_pct < 2",
                   "Near-symmetric (skew {skewness:.3f}): the mean is the least-variance fill."),
    ProductionRule("R-IMP-04", "Multivariate Covariance Imputation (MICE/KNN)", "IMPUTATION", "OPTIMIZATION", 0.85,
                   "impute_knn_or_iterative",
                   "missing_pct >= 3 AND missing_pct <= 40 AND has_numeric AND max_abs_corr >= 0.65",
                   "Correlated columns (|r| up to {max_abs_corr:.3f}) can predict the missing values."),
    ProductionRule("R-IMP-05", "Low-Missingness Categorical Mode Imputation", "IMPUTATION", "INFO", 0.90,
                   "impute_mode", "missing > 0 AND missing_pct < 5 AND semantic IN "
                   "('categorical_nominal', 'categorical_ordinal', 'boolean')",
                   "Only {missing_pct:.2f} % missing: the mode '{mode}' barely changes the shares."),
    ProductionRule("R-IMP-06", "Moderate/High Categorical Dedicated Constant Level", "IMPUTATION", "WARNING", 0.93,
                   "impute_constant", "missing_pct >= 5 AND missing_pct < 70 AND semantic IN "
                   "('categorical_nominal', 'categorical_ordinal', 'free_text', 'boolean')",
                   "{missing_pct:.2f} % missing: keep 'no value' as a level of its own."),
    ProductionRule("R-IMP-07", "Structured (Co-occurring) Missingness Indicator", "MISSINGNESS_STRUCTURE", "INFO",
                   0.86, "add_missing_indicator", f"{_GAPS} AND max_co_missing >= 0.5",
                   "Goes missing together with other columns, so the gap itself may carry information."),
    ProductionRule("R-ENC-01", "Binary Feature Integer Mapping", "ENCODING", "INFO", 0.98, "encode_binary",
                   "is_binary AND semantic IN ('boolean', 'categorical_nominal') AND NOT is_constant",
                   "Two values: 0/1 is enough."),
    ProductionRule("R-ENC-02", "Low-Cardinality One-Hot Encoding", "ENCODING", "INFO", 0.95, "encode_onehot",
                   "unique BETWEEN 3 AND 10 AND semantic = 'categorical_nominal' AND NOT is_identifier",
                   "{unique} unordered categories: one indicator each, the first left out."),
    ProductionRule("R-ENC-03", "High-Cardinality Target or Frequency Encoding", "ENCODING", "WARNING", 0.91,
                   "encode_frequency_or_target",
                   "unique > 10 AND semantic = 'categorical_nominal' AND uniqueness < 0.7 AND NOT is_identifier",
                   "{unique} categories would make as many indicators; their share of rows is one number."),
    ProductionRule("R-ENC-04", "Ordinal Semantic Ranking Encoding", "ENCODING", "INFO", 0.94, "encode_ordinal",
                   "semantic = 'categorical_ordinal' AND ordinal_order IS NOT NULL",
                   "Known order {ordinal_order}: ordered integers keep it."),
    ProductionRule("R-DIST-01", "Heavy Right-Skew Power Transformation", "SCALING_OUTLIERS", "WARNING", 0.90,
                   "transform_log1p", "has_numeric AND skewness >= 1.2 AND min >= 0 AND NOT is_constant",
                   "Skew {skewness:.3f} without negatives: log(1 + x) pulls in the tail."),
    ProductionRule("R-DIST-02", "Yeo-Johnson Power Transform for Skewed Negative Values", "SCALING_OUTLIERS",
                   "WARNING", 0.89, "transform_yeo_johnson",
                   "has_numeric AND abs(skewness) >= 1.2 AND min < 0 AND NOT is_constant",
                   "Skew {skewness:.3f} with negatives (min {min:.4g}): Yeo-Johnson covers the whole line."),
    ProductionRule("R-DIST-03", "Outlier Mitigation via Winsorization / Robust Scaling", "SCALING_OUTLIERS",
                   "WARNING", 0.88, "mitigate_outliers", "has_numeric AND outlier_pct >= 2.5 AND NOT is_constant",
                   "{outliers} values ({outlier_pct:.2f} %) lie outside 1.5 x IQR: cap at the 1st and 99th percentile."),
    ProductionRule("R-DIST-04", "Gaussian Z-Score Standardization", "SCALING_OUTLIERS", "INFO", 0.87,
                   "scale_standard", "has_numeric AND is_normal AND outlier_pct < 2.5 AND NOT is_constant",
                   "Bell-shaped (skew {skewness:.3f}, kurtosis {kurtosis:.3f}): subtract the mean, divide by the spread."),
    ProductionRule("R-FLT-01", "Zero-Variance Constant Feature Elimination", "FILTERING_LEAKAGE", "CRITICAL", 0.99,
                   "drop_column", "is_constant", "One value everywhere: no information."),
    ProductionRule("R-FLT-02", "Identifier / Primary Key Leakage Pruning", "FILTERING_LEAKAGE", "CRITICAL", 0.96,
                   "drop_column", "is_identifier", "Nearly every row has its own value: a model could only memorise it."),
    ProductionRule("R-FLT-03", "High Multicollinearity Redundancy Warning", "FILTERING_LEAKAGE", "WARNING", 0.90,
                   "flag_collinear", "max_abs_corr >= 0.85", "Moves with another column (|r| {max_abs_corr:.3f})."),
    ProductionRule("R-FLT-04", "Quasi-Constant (Near-Zero Variance) Feature", "FILTERING_LEAKAGE", "WARNING", 0.88,
                   "flag_quasi_constant", "is_quasi_constant AND NOT is_constant",
                   "One value covers {dominant_pct:.2f} % of the filled cells; kept, but look at it."),
    ProductionRule("R-DAT-01", "Datetime Feature Decomposition", "DATETIME", "INFO", 0.95, "decompose_datetime",
                   "semantic = 'datetime'", "A date: split into calendar and cyclic parts."),
)
HIDDEN_DUPLICATES = ProductionRule("R-INT-01", "Duplicates Hidden by Identifiers", "DATASET_LEVEL", "WARNING", 0.93,
                                   "drop_duplicates_ignoring_ids", "false", "")


class RuleBase:
    """An ordered list of rules. `failures` holds (rule id, message) of rules that could not be evaluated."""

    def __init__(self, rules=RULES):
        self.rules = list(rules)
        self.failures: list[tuple[str, str]] = []

    def register_rule(self, rule: ProductionRule) -> None:
        self.rules.append(rule)

    def replace_rule(self, rule_id: str, **changes) -> None:
        self.rules = [replace(r, **changes) if r.rule_id == rule_id else r for r in self.rules]

    def log(self, facts_frame: DataFrame) -> DataFrame:
        """INF-3: (position, column, rule order and fields) for every rule that fires. One projection and one explode.
        A rule whose predicate Spark rejects is reported in `failures`; the others still run (INF-4)."""
        self.failures = []
        arms = []
        for i, r in enumerate(self.rules):
            try:
                facts_frame.selectExpr(f"cast({r.predicate} AS boolean)").schema
            except Exception as e:   # a faulty user rule must not stop the audit
                self.failures.append((r.rule_id, str(e).splitlines()[0]))
                continue
            arms.append(
                f"CASE WHEN coalesce({r.predicate}, false) THEN named_struct('rule_order', {i}, "
                f"'rule_id', {text(r.rule_id)}, 'rule_name', {text(r.name)}, 'category', {text(r.category)}, "
                f"'severity', {text(r.severity)}, 'confidence', {r.confidence}D, 'action', {text(r.action)}) END")
        return facts_frame.selectExpr("position", "name AS column", f"inline(array_compact(array({', '.join(arms)})))")


def rule_log_df(spark: SparkSession, facts: DatasetFacts, base: RuleBase | None = None) -> DataFrame:
    """The rule log, with the dataset-level entry R-INT-01 first when hidden duplicates exist."""
    base = base or RuleBase()
    log = base.log(column_facts_df(spark, facts))
    if facts.hidden_duplicate_rows > 0:
        r = HIDDEN_DUPLICATES
        row = {"position": -1, "column": DATASET, "rule_order": -1, "rule_id": r.rule_id, "rule_name": r.name,
               "category": r.category, "severity": r.severity, "confidence": r.confidence, "action": r.action}
        s, i = pa.string(), pa.int64()
        extra = small_frame(spark, [row], [
            ("position", i), ("column", s), ("rule_order", pa.int32()), ("rule_id", s), ("rule_name", s),
            ("category", s), ("severity", s), ("confidence", pa.float64()), ("action", s)])
        log = extra.unionByName(log)
    return log


def resolve(log: DataFrame) -> DataFrame:
    """INF-1: the winning imputation (KNN first, else highest confidence, then rule order), the first encoding, the
    first drop and the datetime step of each column; every scaling step is kept."""
    from pyspark.sql import Window
    single = log.where(
        "category IN ('IMPUTATION', 'ENCODING', 'DATETIME') OR (category = 'FILTERING_LEAKAGE' AND action = 'drop_column')")
    order = Window.partitionBy("column", "category").orderBy(
        F.desc(F.expr("action = 'impute_knn_or_iterative'")),
        F.desc(F.expr("CASE WHEN category = 'IMPUTATION' THEN confidence ELSE 0D END")), F.asc("rule_order"))
    chosen = single.withColumn("rk", F.row_number().over(order)).where("rk = 1").drop("rk")
    return chosen.unionByName(log.where("category = 'SCALING_OUTLIERS'"))


def statuses(log: DataFrame, facts_frame: DataFrame) -> DataFrame:
    """INF-2: one status per column, the most serious finding first."""
    worst = log.where(F.col("column") != DATASET).groupBy("column").agg(F.max(F.expr(
        "CASE WHEN action = 'drop_column' THEN 4 WHEN severity = 'CRITICAL' THEN 3 "
        "WHEN severity = 'WARNING' THEN 2 ELSE 1 END")).alias("rank"))
    return (facts_frame.select("position", F.col("name").alias("column")).join(worst, "column", "left")
            .selectExpr("position", "column",
                        "element_at(array('HEALTHY', 'READY_WITH_PREPROCESSING', 'REQUIRES_TRANSFORMATION', "
                        "'CRITICAL_ATTENTION', 'DROP_RECOMMENDED'), coalesce(rank, 0) + 1) AS status"))


def advice_text(rule: ProductionRule, facts: ColumnFacts, max_abs_corr: float) -> str:
    try:
        return rule.advice.format(**{**vars(facts), "max_abs_corr": max_abs_corr})
    except (KeyError, ValueError, TypeError):
        return rule.advice
