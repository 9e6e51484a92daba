"""TGT-*: what a supervised target looks like, which features tell about it, and which ones leak it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.names import double, q, text
from quern.functions.types import as_double, families, infinite_to_null
from quern.operators.facts import small_frame
from quern.operators.quantiles import agg_row, quantiles
from quern.operators.value_counts import text_key

CLASSES_LISTED = 1_000     # classes in the report, the most frequent first; `class_table` has all of them
MAX_BROADCAST = 100_000    # class totals sent to all tasks; more are joined by shuffle
NUMERIC_BINS = 20


@dataclass
class TargetAnalysis:
    target: str
    task: str
    unique: int
    rows: int
    classes: list[dict] = field(default_factory=list)
    minority_pct: float | None = None
    gini: float | None = None
    entropy: float | None = None
    severity: str | None = None
    class_table: DataFrame | None = None     # (class, count) of every class
    features: list[dict] = field(default_factory=list)
    recommendation: str = ""

    def to_dict(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "class_table"}


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """TGT-2: count and share of each class."""
    counts = df.where(f"{q(target)} IS NOT NULL").groupBy(F.col(q(target)).alias("class")).agg(F.count("*").alias("count"))
    return counts.selectExpr("cast(class AS string) AS class", "count")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """TGT-2: one row with distinct count, total, smallest share, Gini impurity and base-2 entropy. Counts are small
    rows, so their total is broadcast."""
    counts = class_counts(df, target)
    total = counts.agg(F.sum("count").alias("total"))
    p = counts.join(F.broadcast(total)).withColumn("p", F.col("count") / F.col("total"))
    return p.agg(F.count("*").alias("classes"), F.max("total").alias("total"),
                 (F.min("p") * 100).alias("minority_pct"), (1 - F.sum(F.col("p") * F.col("p"))).alias("gini"),
                 F.sum(F.expr("-p * log2(p)")).alias("entropy"))


def imbalance(minority_pct: float) -> str:
    return "SEVERE" if minority_pct < 5 else "MODERATE" if minority_pct < 15 else "NONE"


def correlations(df: DataFrame, target: str, features: list[str], two_classes: bool) -> dict[str, float]:
    """TGT-3: Pearson with a numeric target; for two-valued features and target, Pearson of their 0/1 codes in sorted
    order. Rows without a value are left out."""
    fams = families(df)
    numeric = lambda c: fams[c] in ("integer", "real", "boolean")
    exprs: dict[str, str] = {}
    codes: list[str] = []
    if numeric(target):
        exprs = {c: f"corr({as_double(c, fams[c])}, {as_double(target, fams[target])})" for c in features if numeric(c)}
    if two_classes:
        codes = [c for c in features if c not in exprs and fams[c] != "other"]
    if codes:
        ends = agg_row(df, [e for c in codes + [target] for e in (f"min({q(c)})", f"max({q(c)})")])
        low_high = {c: ends[2 * i:2 * i + 2] for i, c in enumerate(codes + [target])}
        inside = agg_row(df, [f"count_if({q(c)} <> {_lit(low_high[c][0], fams[c])} AND "
                              f"{q(c)} <> {_lit(low_high[c][1], fams[c])})" for c in codes])
        y = f"cast({q(target)} = {_lit(low_high[target][1], fams[target])} AS double)"
        for c, between in zip(codes, inside):
            low, high = low_high[c]
            if not between and low is not None and low != high:
                exprs[c] = f"corr(cast({q(c)} = {_lit(high, fams[c])} AS double), {y})"
    values = agg_row(df, list(exprs.values()))
    return {c: v for c, v in zip(exprs, values) if v is not None and v == v}


def _lit(value, fam: str) -> str:
    from quern.operators.steps import sql_value
    if value is None:
        return "NULL"
    return f"timestamp_ntz{text(str(value))}" if fam == "time" else sql_value(value, fam)


def mutual_information(df: DataFrame, target: str, features: list[str], regression: bool,
                       bins: int = NUMERIC_BINS) -> DataFrame:
    """TGT-4: (feature position, mutual information in nats), from joint counts.

    Text is its own category with a missing level, which is exact. Numeric features, and a numeric target, are cut into
    equal-frequency bins after a median fill: a plug-in estimate, not the nearest-neighbour estimator. One shuffle of
    (feature, value, class) with map-side combining, then marginals by grouped sums."""
    fams = families(df)
    numeric = [c for c in features if fams[c] in ("integer", "real", "boolean")]
    binned = numeric + ([target] if regression else [])
    fills = quantiles(df, {c: (as_double(c, fams[c]), [0.5]) for c in numeric})
    views = {c: f"coalesce({as_double(c, fams[c])}, {double(fills[c][0.5] or 0.0)})" for c in numeric}
    if regression:
        views[target] = as_double(target, fams[target])
    steps = ", ".join(f"{i / bins!r}D" for i in range(1, bins))
    edges = dict(zip(binned, agg_row(df, [f"approx_percentile({views[c]}, array({steps}), 10000)" for c in binned])))

    def bin_of(c: str) -> str:
        cuts = sorted(set(edges[c] or []))
        tests = " + ".join(f"cast({views[c]} > {double(e)} AS int)" for e in cuts) or "0"
        return f"cast({tests} AS string)"

    y = bin_of(target) if regression else f"cast({q(target)} AS string)"
    x = {c: bin_of(c) if c in numeric else f"coalesce({text_key(f'cast({q(c)} AS string)')}, '__MISSING__')"
         for c in features}
    entries = ", ".join(f"{i}, {x[c]}" for i, c in enumerate(features))
    joint = (df.where(f"{q(target)} IS NOT NULL").selectExpr(f"{y} AS y", f"stack({len(features)}, {entries}) AS (f, x)")
             .groupBy("f", "x", "y").agg(F.count("*").alias("c")))
    of_x = joint.groupBy("f", "x").agg(F.sum("c").alias("cx"))
    of_y = joint.where("f = 0").groupBy("y").agg(F.sum("c").alias("cy"))
    classes, n = of_y.agg(F.count("*"), F.sum("cy")).first()
    of_y = F.broadcast(of_y) if classes <= MAX_BROADCAST else of_y     # with few classes each is a hot key
    return (joint.join(of_x, ["f", "x"]).join(of_y, "y").groupBy("f")
            .agg(F.sum(F.expr(f"c / {n or 1}D * ln(double(c) * {n or 1}D / (double(cx) * cy))")).alias("mi")))


def analyze_target(df: DataFrame, target: str) -> TargetAnalysis:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    df = infinite_to_null(df).where(f"{q(target)} IS NOT NULL")
    fams = families(df)
    is_numeric = fams[target] in ("integer", "real", "boolean")
    balance = class_balance(df, target).first()
    unique = balance["classes"]
    if unique <= 1:
        raise ValueError(f"target column {target!r} has {unique} distinct value(s)")
    task = ("binary_classification" if unique == 2 else
            "regression" if is_numeric and unique > 20 else "multiclass_classification")
    out = TargetAnalysis(target, task, unique, balance["total"])
    regression = task == "regression"
    h_nats = 0.0
    if not regression:
        out.minority_pct, out.gini, out.entropy = balance["minority_pct"], balance["gini"], balance["entropy"]
        out.severity = imbalance(out.minority_pct)
        h_nats = out.entropy * math.log(2)
        out.class_table = class_counts(df, target)
        listed = out.class_table.orderBy(F.desc("count"), "class").limit(CLASSES_LISTED).collect()
        out.classes = [{"class": r["class"], "count": r["count"], "percentage": 100.0 * r["count"] / out.rows}
                       for r in listed]
    features = [c for c in df.columns if c != target and fams[c] != "other"]
    corr = correlations(df, target, features, unique == 2)
    scores: dict[str, float] = {}
    if out.rows >= 5 and features:
        scores = {features[r["f"]]: max(0.0, r["mi"]) for r in
                  mutual_information(df, target, features, regression).collect()}
    for c in features:
        r, mi = corr.get(c), scores.get(c, 0.0)
        score = mi if round(mi, 4) > 0 else abs(r) if r is not None else 0.0
        # Leakage limits.
        leak = ((r is not None and abs(r) >= 0.95) or (h_nats > 0 and score / h_nats >= 0.95) or score >= 0.90)
        out.features.append({"feature": c, "score": score, "correlation": r, "leakage_risk": leak})
    out.features.sort(key=lambda f: (-f["score"], f["feature"]))
    out.recommendation = _advice(out)
    return out


def _advice(a: TargetAnalysis) -> str:
    if a.task == "regression":
        return f"{a.target}: regression on {a.unique} distinct numbers; judge by RMSE, MAE and R squared."
    head = f"{a.target}: {a.task.replace('_', ' ')} with {a.unique} classes. "
    return head + {
        "SEVERE": f"The rarest class has {a.minority_pct:.1f} % of the rows: resample or weight classes, judge by PR-AUC.",
        "MODERATE": f"The rarest class has {a.minority_pct:.1f} % of the rows: stratify and weight classes.",
        "NONE": "Classes are balanced: accuracy, F1 and log-loss work.",
    }[a.severity]


def ranking_df(spark: SparkSession, analysis: TargetAnalysis) -> DataFrame:
    return small_frame(spark, [{"rank": i + 1, **f} for i, f in enumerate(analysis.features)], [
        ("rank", pa.int64()), ("feature", pa.string()), ("score", pa.float64()), ("correlation", pa.float64()),
        ("leakage_risk", pa.bool_())])
