"""One registered query per operator. Every query reads a whole table (or a messy view of one) and returns plain rows.

Profiles and repair plans are driver-side facts; within a session they are computed once per table and shared by the
queries that read them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.dates import parse_date
from quern.functions.names import q, sanitize_column_names, standardise_headers
from quern.functions.types import as_double, families, infinite_to_null
from quern.operators import charts, contracts, diff, target
from quern.operators import profile as P
from quern.operators import recipe as R
from quern.operators.facts import DatasetFacts, categories_df, column_facts_df, histogram_df, pairs_df, small_frame
from quern.operators.grouped_prep import GroupPipeline, split
from quern.operators.inference import infer, recommendations_df
from quern.operators.repair import RepairPlan, RepairPlanner
from quern.operators.rules import RULES, RuleBase, resolve, rule_log_df, statuses
from quern.operators.score import health_df
from quern.plans.views import VIEWS, load
from quern.sources import scan as S
from quern.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_memo: dict[tuple, object] = {}
s_, i_, f_, b_ = pa.string(), pa.int64(), pa.float64(), pa.bool_()


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


def once(spark: SparkSession, key: tuple, make: Callable[[], object]):
    full = (spark.sparkContext.applicationId, *key)
    if full not in _memo:
        _memo[full] = make()
    return _memo[full]


def facts(spark, sf, view):
    return once(spark, ("facts", sf, view), lambda: P.profile(load(spark, sf, view), persist=view in VIEWS))


def facts_frame(spark, sf, view):
    return column_facts_df(spark, facts(spark, sf, view))


def inference(spark, sf, view):
    return once(spark, ("infer", sf, view), lambda: infer(spark, facts(spark, sf, view)))


def repairs(spark, sf):
    return once(spark, ("repairs", sf), lambda: RepairPlanner("order_id").fit(load(spark, sf, "orders_dirty")))


def repaired(spark, sf, *rules: str) -> DataFrame:
    plan = repairs(spark, sf)
    chosen = [r for r in plan.repairs if not rules or r.rule_id in rules]
    return RepairPlan(chosen, plan.label_maps).transform(load(spark, sf, "orders_dirty"))


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.selectExpr(*[f"round({q(c)}, {places}) AS {q(c)}" if c in columns else q(c) for c in df.columns])


# ---------------------------------------------------------------- sources and sinks

def _place(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach; a session without a shared one is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared or tempfile.mkdtemp(prefix='quern-')}/{name}-{uuid.uuid4().hex}"


@query("src_01_delimited_scan")
def _(spark, sf):
    """The table written as delimited text, with quotes, delimiters and line breaks inside fields, and scanned back."""
    path = _place(spark, "customer")
    (load(spark, sf, "customer").withColumn("note", F.expr("concat(c_name, '\\n\"', c_mktsegment, '\", ', c_custkey)"))
     .write.option("header", True).option("escape", '"').csv(path))
    return S.read_delimited(spark, path)


@query("src_04_json_scan")
def _(spark, sf):
    """The table written as nested JSON Lines, and scanned back."""
    path = _place(spark, "events")
    load(spark, sf, "events").selectExpr(
        "event_id", "named_struct('kind', event_type, 'user', named_struct('id', user_id)) AS e", "value", "props").write.json(path)
    return S.read_json(spark, path)


@query("src_05_flatten")
def _(spark, sf):
    nested = load(spark, sf, "documents").select(
        "doc_id", F.struct("lang", F.struct(F.col("source").alias("source"), F.col("n_chars").alias("size"))
                           .alias("origin")).alias("meta"))
    return S.flatten(nested)


@query("src_06_parquet_scan")
def _(spark, sf):
    """The table written with nested columns, and scanned back."""
    path = _place(spark, "documents")
    load(spark, sf, "documents").select(
        "doc_id", "text", F.struct("lang", F.struct(F.col("source").alias("source"), F.col("n_chars").alias("size")).alias("origin")).alias("meta")).write.parquet(path)
    return S.read_parquet(spark, path)


@query("src_07_header_rules")
def _(spark, sf):
    raw = load(spark, sf, "events").select("event_id", "event_type", "user_id", "value", "props")
    return standardise_headers(raw.toDF(" event_id ", "event_type", " event_type", "  ", "VALUE"))


@query("src_08_type_inference")
def _(spark, sf):
    raw = load(spark, sf, "orders").drop("o_orderdate")
    return S.infer_text_types(raw.select(*[F.col(c).cast("string") for c in raw.columns]))


@query("src_09_scan_metadata")
def _(spark, sf):
    _, meta = S.scan(spark, f"{sf}/lineitem.parquet")
    return small_frame(spark, [meta.to_dict()], [("filename", s_), ("extension", s_), ("format", s_), ("rows", i_),
                                                 ("columns", i_)])


@query("snk_01_csv")
def _(spark, sf):
    """The table written as delimited text, with the quotes and line breaks of its texts, and scanned back."""
    path = _place(spark, "documents") + ".csv"
    sinks.write(load(spark, sf, "documents"), path)
    return S.scan(spark, path)[0]


@query("snk_02_parquet")
def _(spark, sf):
    path = _place(spark, "orders") + ".parquet"
    sinks.write(load(spark, sf, "orders"), path)
    return S.scan(spark, path)[0].withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("job_01_audit")
def _(spark, sf):
    """The repairs of the whole audit job, from delimited text to report, as the report holds them."""
    from quern.plans.jobs import audit
    path, report = _place(spark, "orders") + ".csv", _place(spark, "report")
    sinks.write(load(spark, sf, "orders_dirty"), path)
    audit(spark, path, report).release()
    document = spark.read.text(f"{report}/summary").select(F.from_json("value", "repairs array<struct<rule_id string, column string, affected long>>").alias("d"))
    return document.select(F.inline("d.repairs"))


@query("snk_03_safe_names")
def _(spark, sf):
    return sanitize_column_names(load(spark, sf, "customer").toDF("cust key", "cust-name", "cust name!", "??",
                                                                  "CUST_NAME"))


@query("snk_04_column_schema")
def _(spark, sf):
    df = load(spark, sf, "events_gaps")
    return sinks.column_schema(df, facts(spark, sf, "events_gaps")).select("column", "non_null", "unique")


@query("snk_07_preview")
def _(spark, sf):
    df = load(spark, sf, "orders_dirty").select("order_id", "price_text", "flag", "age", "ratio")
    return sinks.preview(df, "order_id")


# ---------------------------------------------------------------- repair

for _name, _rules, _cols in (
        ("qlt_07_strip_whitespace", ("R-QLT-07",), ("flag", "priority")),
        ("qlt_01_disguised_missing", ("R-QLT-07", "R-QLT-01"), ("price_text", "priority")),
        ("qlt_03_numeric_text", ("R-QLT-01", "R-QLT-03"), ("price_text", "zip")),
        ("qlt_04_boolean_text", ("R-QLT-07", "R-QLT-04"), ("flag",)),
        ("qlt_05_label_merge", ("R-QLT-07", "R-QLT-01", "R-QLT-05"), ("priority",)),
        ("qlt_06_infinite", ("R-QLT-06",), ("ratio",)),
        ("qlt_02_sentinel_codes", ("R-QLT-02",), ("age",)),
        ("qlt_r_replay_all", (), ("price_text", "flag", "priority", "age", "ratio", "date_text", "zip"))):
    QUERIES[_name] = (lambda rules, cols: lambda spark, sf: repaired(spark, sf, *rules).select("order_id", *cols))(
        _rules, _cols)


@query("qlt_d_repair_log")
def _(spark, sf):
    return repairs(spark, sf).to_df(spark).select("rule_id", "column", "affected")


@query("qlt_e_examples")
def _(spark, sf):
    rows = [{"column": r.column, "rule_id": r.rule_id, "rk": i + 1, "before": b, "after": a}
            for r in repairs(spark, sf).repairs for i, (b, a) in enumerate(r.examples)]
    return small_frame(spark, rows, [("column", s_), ("rule_id", s_), ("rk", i_), ("before", s_), ("after", s_)])


# ---------------------------------------------------------------- column profile

@query("prf_01_counts")
def _(spark, sf):
    return rounded(facts_frame(spark, sf, "events_gaps").select(
        F.col("name").alias("column"), "non_null", "missing", "missing_pct", "unique", "uniqueness"), 6, "missing_pct",
        "uniqueness")


@query("prf_02_constant")
def _(spark, sf):
    return facts_frame(spark, sf, "events_gaps").select(F.col("name").alias("column"), "is_constant")


@query("prf_03_quasi_constant")
def _(spark, sf):
    return rounded(facts_frame(spark, sf, "events_gaps").select(
        F.col("name").alias("column"), "dominant_pct", "is_quasi_constant"), 6, "dominant_pct")


@query("prf_04_semantic_types")
def _(spark, sf):
    return facts_frame(spark, sf, "events_gaps").select(F.col("name").alias("column"), "semantic")


@query("prf_05_date_text")
def _(spark, sf):
    f = facts(spark, sf, "orders_dirty")
    return small_frame(spark, [{"column": c.name, "is_date_text": c.is_date_text} for c in f.columns.values()
                               if c.family == "text"], [("column", s_), ("is_date_text", b_)])


@query("prf_06_identifiers")
def _(spark, sf):
    wanted = (("events", "event_id"), ("events", "user_id"), ("labels", "doc_id"), ("conversations", "conv_id"),
              ("customer", "c_custkey"), ("customer", "c_name"))
    return small_frame(spark, [{"table": t, "column": c, "is_identifier": facts(spark, sf, t).columns[c].is_identifier}
                               for t, c in wanted], [("table", s_), ("column", s_), ("is_identifier", b_)])


@query("prf_07_ordinal")
def _(spark, sf):
    return (facts_frame(spark, sf, "events_gaps").where("ordinal_order IS NOT NULL")
            .selectExpr("name AS column", "array_join(ordinal_order, ' < ') AS ordinal_order"))


_STATS = ("min", "max", "mean", "median", "std", "q25", "q75", "iqr", "skewness", "kurtosis", "zero_pct")


def _numeric_stats(spark, sf, view):
    f = _numeric_frame(spark, sf, view)
    return rounded(f.select(F.col("name").alias("column"), *_STATS, "is_normal", "zeros", "negatives"), 6, *_STATS)


def _numeric(spark, sf, view):
    return once(spark, ("numeric", sf, view), lambda: DatasetFacts(
        0, {c.name: c for c in P.numeric_profile(load(spark, sf, view))}))


def _numeric_frame(spark, sf, view):
    return column_facts_df(spark, _numeric(spark, sf, view))


QUERIES["prf_08_numeric_stats"] = lambda spark, sf: _numeric_stats(spark, sf, "events_gaps")
QUERIES["prf_08_numeric_stats_lineitem"] = lambda spark, sf: _numeric_stats(spark, sf, "lineitem")


@query("prf_08b_outliers")
def _(spark, sf):
    f = _numeric_frame(spark, sf, "events_gaps")
    return rounded(f.select(F.col("name").alias("column"), "outliers", "outlier_pct", "extremes", "lower_fence",
                            "upper_fence"), 6, "outlier_pct", "lower_fence", "upper_fence")


_CATS = ("event_type", "kind", "sparse_kind", "rare", "twin", "tier")


@query("prf_09_top_categories")
def _(spark, sf):
    top = categories_df(spark, facts(spark, sf, "events_gaps")).where(F.col("column").isin(*_CATS))
    return rounded(top, 4, "percentage")


@query("prf_09_category_stats")
def _(spark, sf):
    f = facts_frame(spark, sf, "events_gaps").where(F.col("name").isin(*_CATS))
    return rounded(f.select(F.col("name").alias("column"), "mode", "mode_pct", "rare", "entropy"), 6, "mode_pct",
                   "entropy")


@query("prf_10_histogram")
def _(spark, sf):
    h = histogram_df(spark, _numeric(spark, sf, "events_gaps"))
    return rounded(h.where(F.col("column").isin("user_id", "value", "shifted", "paired"))
                   .select("column", "bin", "lower", "count"), 4, "lower")


@query("prf_11_datetime_stats")
def _(spark, sf):
    rows = [facts(spark, sf, t).columns[c] for t, c in
            (("events", "ts"), ("orders", "o_orderdate"), ("orders_dirty", "date_text"))]
    return small_frame(spark, [
        {"column": c.name, "span_days": round(c.span_days, 1), "first_day": c.min_date[:10],
         "last_day": c.max_date[:10], "has_time": c.has_time} for c in rows],
        [("column", s_), ("span_days", f_), ("first_day", s_), ("last_day", s_), ("has_time", b_)])


@query("prf_13_parse_dates")
def _(spark, sf):
    c = facts(spark, sf, "orders_dirty").columns["date_text"]
    d = load(spark, sf, "orders_dirty").selectExpr("order_id", f"{parse_date('date_text', c.day_first)} AS t")
    return d.selectExpr("order_id", "year(t) AS y", "month(t) AS m", "dayofmonth(t) AS d")


@query("prf_14_infinite_to_null")
def _(spark, sf):
    return infinite_to_null(load(spark, sf, "orders_dirty")).agg(
        F.count("*").alias("n_rows"), F.count("ratio").alias("finite"), F.round(F.sum("ratio"), 3).alias("total"))


# ---------------------------------------------------------------- table profile

@query("dst_01_shape")
def _(spark, sf):
    f = facts(spark, sf, "events_gaps")
    return small_frame(spark, [{"rows": f.rows, "cols": len(f.columns), "cells": f.cells,
                                "missing_cells": f.missing_cells, "missing_pct": round(f.missing_pct, 6)}],
                       [("rows", i_), ("cols", i_), ("cells", i_), ("missing_cells", i_), ("missing_pct", f_)])


@query("dst_02_exact_duplicates")
def _(spark, sf):
    df = load(spark, sf, "events_dups")
    n, _ = P.duplicate_counts(df, [])
    return small_frame(spark, [{"duplicate_rows": n, "duplicate_pct": round(100.0 * n / df.count(), 6)}],
                       [("duplicate_rows", i_), ("duplicate_pct", f_)])


@query("dst_03_hidden_duplicates")
def _(spark, sf):
    _, hidden = P.duplicate_counts(load(spark, sf, "events_dups"), ["event_id"])
    return small_frame(spark, [{"hidden_duplicate_rows": hidden}], [("hidden_duplicate_rows", i_)])


@query("dst_05_pearson_matrix")
def _(spark, sf):
    pairs: dict[tuple[str, str], float] = {}
    P.numeric_profile(load(spark, sf, "lineitem"), histogram=False, correlation=pairs, quartiles=False)
    return small_frame(spark, [{"feature_a": a, "feature_b": b, "correlation": round(r, 3)} for (a, b), r in pairs.items()], [("feature_a", s_), ("feature_b", s_), ("correlation", f_)])


@query("dst_06_high_pairs")
def _(spark, sf):
    p = pairs_df(spark, facts(spark, sf, "events_gaps")).where("measure <> 'co_missing'")
    return rounded(p.select("feature_a", "feature_b", "measure", "correlation", "severity"), 5, "correlation")


@query("dst_07_cramers_v")
def _(spark, sf):
    f = facts(spark, sf, "events_gaps")
    found = P.cramers_v(load(spark, sf, "events_gaps"), P.association_candidates(f.columns))
    return small_frame(spark, [{"feature_a": a, "feature_b": b, "v": round(v, 5)} for a, b, v in found],
                       [("feature_a", s_), ("feature_b", s_), ("v", f_)])


@query("dst_08_co_missing")
def _(spark, sf):
    p = pairs_df(spark, facts(spark, sf, "events_gaps")).where("measure = 'co_missing'")
    return rounded(p.select("feature_a", "feature_b", "correlation"), 5, "correlation")


@query("dst_09_type_counts")
def _(spark, sf):
    return facts_frame(spark, sf, "events_gaps").groupBy("semantic").agg(F.count("*").alias("n_columns"))


# ---------------------------------------------------------------- rules, inference, score

def _rule(rule_id: str, view: str) -> Query:
    def run(spark, sf):
        base = RuleBase([r for r in RULES if r.rule_id == rule_id])
        return base.log(facts_frame(spark, sf, view)).select("column", "rule_id", "action", "confidence")
    return run


_ELSEWHERE = {"R-DAT-01": "events", "R-DIST-04": "conversations", "R-ENC-03": "part"}
for _r in RULES:
    QUERIES["rule_" + _r.rule_id.lower().replace("-", "_")] = _rule(
        _r.rule_id, _ELSEWHERE.get(_r.rule_id, "events_gaps"))


@query("rule_r_int_01")
def _(spark, sf):
    return (rule_log_df(spark, facts(spark, sf, "events_dups")).where("rule_id = 'R-INT-01'")
            .select("column", "rule_id", "action", "confidence"))


def _log(spark, sf):
    return rule_log_df(spark, facts(spark, sf, "events_gaps"))


@query("inf_01_resolution")
def _(spark, sf):
    return resolve(_log(spark, sf)).select("column", "category", "rule_id", "action")


@query("inf_02_status")
def _(spark, sf):
    return statuses(_log(spark, sf), facts_frame(spark, sf, "events_gaps")).select("column", "status")


@query("inf_03_rule_log")
def _(spark, sf):
    return _log(spark, sf).select("column", "rule_id", "severity")


@query("sco_01_health")
def _(spark, sf):
    return health_df(spark, facts(spark, sf, "events_gaps")).drop("critical_issues", "diagnosis")


@query("sco_02_issues")
def _(spark, sf):
    return health_df(spark, facts(spark, sf, "events_gaps")).select(F.explode("critical_issues").alias("issue"))


# ---------------------------------------------------------------- recipe

def _none(*columns: str) -> dict[str, R.Override]:
    return {c: R.Override(drop=False, imputation="none", encoding="none", outliers="none", scaling="none")
            for c in columns}


def _run(spark, sf, view, overrides, columns, deduplicate=False, target_column=None):
    """Fit and run a recipe on the listed columns of a view; columns without an override are left as they are."""
    df = load(spark, sf, view).select(*columns)
    every = {**_none(*columns), **{c: R.Override(**{**vars(R.Override(drop=False, imputation="none", encoding="none",
                                                                     outliers="none", scaling="none")), **o})
                                   for c, o in overrides.items()}}
    model = R.Recipe(every, deduplicate, target_column).fit(df)
    return model.transform(df)


@query("rec_01_infinite")
def _(spark, sf):
    return infinite_to_null(load(spark, sf, "orders_dirty").select("order_id", "ratio"))


@query("rec_02_prune")
def _(spark, sf):
    df = load(spark, sf, "events_gaps")
    keep = _none(*df.columns)
    for c in ("mostly_null", "const"):
        keep[c] = R.Override(drop=None, imputation="none", encoding="none", outliers="none", scaling="none")
    model = R.Recipe(keep, False).fit(df, facts(spark, sf, "events_gaps"), inference(spark, sf, "events_gaps"))
    return model.transform(df)


@query("rec_03_drop_duplicates")
def _(spark, sf):
    return _run(spark, sf, "events_dups", {}, ["event_type", "user_id", "value"], deduplicate=True)


@query("rec_04_datetime_features")
def _(spark, sf):
    df = load(spark, sf, "events").select("event_id", "ts")
    f = P.profile(df, pairs=False, duplicates=False, samples=False)
    out = R.Recipe(_none("event_id"), False).fit(df, f, infer(spark, f)).transform(df)
    return rounded(out, 9, "ts_sin_month", "ts_cos_month", "ts_sin_hour", "ts_cos_hour")


@query("rec_05_row_drop")
def _(spark, sf):
    return _run(spark, sf, "events_gaps", {"paired": {"imputation": "drop_rows"}}, ["event_id", "paired"])


@query("rec_07_simple_imputation")
def _(spark, sf):
    out = _run(spark, sf, "events_gaps", {
        "value": {"imputation": "median"}, "paired": {"imputation": "mean"}, "kind": {"imputation": "mode"},
        "sparse_kind": {"imputation": "constant"}, "mostly_null": {"imputation": "constant", "impute_value": -5}},
        ["event_id", "value", "paired", "kind", "sparse_kind", "mostly_null"])
    return rounded(out.select("event_id", "value", "paired", "kind", "sparse_kind", "mostly_null"), 6, "value",
                   "paired", "mostly_null")


@query("rec_07b_missing_indicator")
def _(spark, sf):
    df = load(spark, sf, "events_gaps").select("event_id", "value", "paired")
    f = P.profile(df, duplicates=False, samples=False)
    model = R.Recipe(_none("event_id") | {"value": R.Override(imputation="median", outliers="none", scaling="none")},
                     False).fit(df, f, infer(spark, f))
    out = model.transform(df)
    return out.select("event_id", "value_was_missing", "paired_was_missing")


def _value(options: dict) -> Query:
    return lambda spark, sf: rounded(_run(spark, sf, "events", {"value": options}, ["event_id", "value"]), 6, "value")


QUERIES["rec_08_winsorize"] = _value({"outliers": "winsorize"})
QUERIES["rec_08_clip_iqr"] = _value({"outliers": "clip_iqr"})
QUERIES["rec_08_zscore_clip"] = _value({"outliers": "zscore"})
QUERIES["rec_09_robust"] = _value({"scaling": "robust"})
QUERIES["rec_09_log1p"] = _value({"outliers": "winsorize", "scaling": "log1p"})


@query("rec_09_standard")
def _(spark, sf):
    out = _run(spark, sf, "lineitem", {"l_quantity": {"scaling": "standard"}},
               ["l_orderkey", "l_linenumber", "l_quantity"])
    return rounded(out, 6, "l_quantity")


@query("rec_10_yeo_johnson")
def _(spark, sf):
    df = load(spark, sf, "events_gaps").select("event_id", "shifted")
    bent = df.select("event_id", F.expr(R.scale_expressions(df, {"shifted": "yeo_johnson"}, families(df))["shifted"])
                     .alias("shifted"))
    return rounded(bent, 5, "shifted")


@query("rec_11_binary")
def _(spark, sf):
    return _run(spark, sf, "lineitem", {"l_linestatus": {"encoding": "binary"}},
                ["l_orderkey", "l_linenumber", "l_linestatus"])


@query("rec_12_frequency")
def _(spark, sf):
    return rounded(_run(spark, sf, "part", {"p_brand": {"encoding": "frequency"}}, ["p_partkey", "p_brand"]), 6,
                   "p_brand")


@query("rec_13_ordinal")
def _(spark, sf):
    return _run(spark, sf, "events_gaps", {"tier": {"encoding": "ordinal"}}, ["event_id", "tier"])


@query("rec_13_ordinal_sorted")
def _(spark, sf):
    return _run(spark, sf, "orders", {"o_orderpriority": {"encoding": "ordinal"}}, ["o_orderkey", "o_orderpriority"])


@query("rec_14_onehot")
def _(spark, sf):
    return _run(spark, sf, "events", {"event_type": {"encoding": "onehot"}}, ["event_id", "event_type"])


@query("rec_00_overrides")
def _(spark, sf):
    return rounded(_run(spark, sf, "events", {"value": {"outliers": "clip_iqr", "scaling": "robust"},
                                              "event_type": {"encoding": "ordinal"}},
                        ["event_id", "value", "event_type"]), 6, "value")


@query("rec_t_target_protected")
def _(spark, sf):
    out = _run(spark, sf, "part", {}, ["p_type", "p_size", "p_retailprice"], target_column="p_type")
    assert out.columns[-1] == "p_type"
    return out


@query("rec_16_report")
def _(spark, sf):
    df = load(spark, sf, "events_dups")
    out, model = R.run_recipe(df, facts(spark, sf, "events_dups"), inference(spark, sf, "events_dups"))
    report = R.recipe_report(df, out, model)
    (r0, c0), (r1, c1) = report["initial_shape"], report["final_shape"]
    return small_frame(spark, [{"rows_before": r0, "rows_after": r1, "columns_before": c0, "columns_after": c1,
                                "missing_after": report["final_missing_cells"]}],
                       [("rows_before", i_), ("rows_after", i_), ("columns_before", i_), ("columns_after", i_),
                        ("missing_after", i_)])


@query("rec_full_events")
def full_events(spark, sf):
    """Profile, rules and recipe end to end, nothing overridden."""
    df = load(spark, sf, "events").drop("props")
    f = P.profile(df, samples=False)
    out, _ = R.run_recipe(df, f, infer(spark, f))
    return rounded(rounded(out, 9, "ts_sin_month", "ts_cos_month", "ts_sin_hour", "ts_cos_hour"), 6, "value")


@query("rec_06_knn_imputation")
def _(spark, sf):
    df = load(spark, sf, "events_gaps").select("event_id", "user_id", "value", "shifted")
    fill = R.KnnFill.fit(df, ["value"], ["user_id", "value", "shifted"])
    return rounded(fill(df).select("event_id", "value"), 6, "value")


# ---------------------------------------------------------------- leakage-safe preparation

def _pipeline(spark, sf, view, target_column):
    return GroupPipeline(facts(spark, sf, view), inference(spark, sf, view), target_column)


def _split_events(spark, sf):
    return split(load(spark, sf, "events"), "event_type", row_id="event_id")


@query("pip_01_groups")
def _(spark, sf):
    groups = vars(_pipeline(spark, sf, "events", None).groups)
    return small_frame(spark, [{"column": c, "group": g} for g, cs in groups.items() for c in cs],
                       [("column", s_), ("group", s_)])


@query("pip_03_split")
def _(spark, sf):
    train, test = _split_events(spark, sf)
    return (train.select("event_id", F.lit(False).alias("is_test"))
            .unionAll(test.select("event_id", F.lit(True).alias("is_test"))))


@query("pip_03_split_quotas")
def _(spark, sf):
    train, test = _split_events(spark, sf)
    both = train.withColumn("is_test", F.lit(False)).unionAll(test.withColumn("is_test", F.lit(True)))
    return both.groupBy("event_type", "is_test").agg(F.count("*").alias("n"))


def _fitted(spark, sf, columns: list[str]):
    """Train and test rows of `events` through a model fitted on the training rows; event_id and the target ride along."""
    plan = _pipeline(spark, sf, "events", "event_type")
    train, test = _split_events(spark, sf)
    keep = ["event_id", "event_type", *columns]
    plan.groups.drop = []
    plan.groups.passthrough = ["event_id"]
    model = plan.fit(train.select(*keep))
    return model.transform(train.select(*keep)), model.transform(test.select(*keep))


@query("pip_04_train_statistics")
def _(spark, sf):
    train, test = _fitted(spark, sf, ["value"])
    both = train.withColumn("is_test", F.lit(False)).unionAll(test.withColumn("is_test", F.lit(True)))
    return rounded(both.select("event_id", "is_test", "value"), 6, "value")


@query("pip_06_gaussian_group")
def _(spark, sf):
    train, test = _fitted(spark, sf, ["user_id"])
    return rounded(train.unionAll(test).select("event_id", "user_id"), 6, "user_id")


@query("pip_09_frequency_group")
def _(spark, sf):
    train, test = _fitted(spark, sf, ["props"])
    return rounded(train.unionAll(test).select("event_id", "props"), 6, "props")


def _lines(spark, sf, column):
    plan = _pipeline(spark, sf, "lineitem", None)
    plan.groups.gaussian = []
    plan.groups.passthrough = ["l_orderkey", "l_linenumber"]
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", column)
    return plan.fit(df).transform(df)


@query("pip_08_onehot_group")
def _(spark, sf):
    return _lines(spark, sf, "l_returnflag")


@query("pip_10_binary_group")
def _(spark, sf):
    return _lines(spark, sf, "l_linestatus")


# ---------------------------------------------------------------- target

def _labelled(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(load(spark, sf, "labels"), "doc_id").drop("doc_id")


def _analysis(spark, sf):
    return once(spark, ("target", sf), lambda: target.analyze_target(_labelled(spark, sf), "toxic"))


@query("tgt_01_task_type")
def _(spark, sf):
    df = load(spark, sf, "lineitem")
    found = [target.analyze_target(df.select(c, *rest), c) for c, rest in (
        ("l_linestatus", []), ("l_returnflag", []), ("l_linenumber", []), ("l_extendedprice", []))]
    return small_frame(spark, [{"target": a.target, "task": a.task, "unique": a.unique} for a in found],
                       [("target", s_), ("task", s_), ("unique", i_)])


@query("tgt_02_class_counts")
def _(spark, sf):
    return target.class_counts(load(spark, sf, "lineitem"), "l_returnflag")


@query("tgt_02_class_balance")
def _(spark, sf):
    b = target.class_balance(_labelled(spark, sf), "toxic").drop("total")
    return rounded(b.withColumn("severity", F.expr(
        "CASE WHEN minority_pct < 5 THEN 'SEVERE' WHEN minority_pct < 15 THEN 'MODERATE' ELSE 'NONE' END")), 6,
        "minority_pct", "gini", "entropy")


@query("tgt_03_correlation")
def _(spark, sf):
    r = target.correlations(_labelled(spark, sf), "toxic", ["n_chars", "quality"], True)
    return small_frame(spark, [{"feature": k, "correlation": round(v, 6)} for k, v in r.items()],
                       [("feature", s_), ("correlation", f_)])


@query("tgt_04_mutual_information")
def _(spark, sf):
    names = ["lang", "source"]
    mi = target.mutual_information(_labelled(spark, sf), "toxic", names, regression=False)
    return mi.selectExpr("element_at(array('lang', 'source'), f + 1) AS feature", "round(mi, 6) AS mi")


@query("tgt_05_leakage")
def _(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr("l_linestatus", "cast(l_linestatus = 'O' AS int) AS copy", "l_returnflag")
    a = target.analyze_target(df, "l_linestatus")
    return target.ranking_df(spark, a).select("feature", "leakage_risk")


@query("tgt_06_ranking")
def _(spark, sf):
    a = target.analyze_target(_labelled(spark, sf).select("lang", "source", "toxic"), "toxic")
    return rounded(target.ranking_df(spark, a).select("rank", "feature", "score"), 6, "score")


# ---------------------------------------------------------------- contracts

def _contract(spark, sf):
    return contracts.infer_constraints(facts(spark, sf, "events"))


@query("con_01_constraints")
def _(spark, sf):
    return small_frame(spark, [{"column": k.column, "check": k.kind, "bound": float(k.expected)}
                               for k in _contract(spark, sf) if k.kind in ("min", "max")],
                       [("column", s_), ("check", s_), ("bound", f_)])


@query("con_02_violations")
def _(spark, sf):
    wanted = (("value", "not_null"), ("value", "min"), ("event_type", "isin"), ("props", "not_null"))
    chosen = [k for k in _contract(spark, sf) if (k.column, k.kind) in wanted]
    return contracts.violations_df(load(spark, sf, "events_gaps"), chosen).select("column", "check", "violations")


@query("con_02_failing_rows")
def _(spark, sf):
    chosen = [k for k in _contract(spark, sf) if k.column in ("value", "user_id", "event_type")]
    return contracts.failing_rows(load(spark, sf, "events_gaps"), chosen).select("event_id")


# ---------------------------------------------------------------- charts

@query("viz_01_scatter_sample")
def _(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return charts.scatter_points(df, "l_quantity", "l_extendedprice", "l_returnflag", row_id="line")


@query("viz_01_scatter_line")
def _(spark, sf):
    return charts.scatter_line(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("viz_02_grouped")
def _(spark, sf):
    return rounded(charts.grouped(load(spark, sf, "documents"), "source", "n_chars"), 4, "mean", "median", "q25", "q75")


@query("viz_03_missingness_grid")
def _(spark, sf):
    grid = charts.missingness_grid(load(spark, sf, "events_gaps"), 60, order_by="event_id")
    cols = ("value", "kind", "sparse_kind", "mostly_null")
    return rounded(grid.select("row_start", "row_end", *cols), 4, *cols)


@query("viz_04_column_dictionary")
def _(spark, sf):
    f = facts_frame(spark, sf, "events_gaps")
    return rounded(charts.column_dictionary(f, statuses(_log(spark, sf), f), "categorical_nominal", "KIND", "missing")
                   .drop("status"), 4, "missing_pct")


@query("viz_05_outlier_ranking")
def _(spark, sf):
    rows = charts.outlier_ranking(facts_frame(spark, sf, "events_gaps")).collect()
    return small_frame(spark, [{"rank": i + 1, "name": r["name"], "outlier_pct": round(r["outlier_pct"], 6)}
                               for i, r in enumerate(rows)], [("rank", i_), ("name", s_), ("outlier_pct", f_)])


@query("viz_05_flagged_bins")
def _(spark, sf):
    return (histogram_df(spark, facts(spark, sf, "events_gaps")).where("column IN ('value', 'shifted')")
            .select("column", "bin", "outside"))


@query("viz_06_groupable")
def _(spark, sf):
    return charts.groupable(facts_frame(spark, sf, "events_gaps")).select("name", "unique")


@query("viz_07_recommendation_filter")
def _(spark, sf):
    r = recommendations_df(spark, inference(spark, sf, "events_gaps"), facts(spark, sf, "events_gaps"))
    parts = [charts.recommendation_filter(r, n).select(F.lit(n).alias("filter"), "column")
             for n in ("drop", "impute", "outliers")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# ---------------------------------------------------------------- diff

def _before_after(spark, sf):
    raw = load(spark, sf, "events_gaps").select("event_id", "value", "kind", "tier")
    new = raw.selectExpr("event_id", "coalesce(value, 0D) AS value", "coalesce(kind, 'Missing') AS kind",
                         "trim(tier) AS tier", "1 AS extra")
    return raw, new


@query("dif_01_cell_status")
def _(spark, sf):
    return diff.cell_status_counts(*_before_after(spark, sf), "event_id")


@query("dif_02_column_diff")
def _(spark, sf):
    raw, new = _before_after(spark, sf)
    return diff.column_diff(raw.select("value", "kind"), new.select("value", "extra"))


@query("dif_03_row_search")
def _(spark, sf):
    return diff.search_rows(load(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "RED").select(
        "p_partkey", "p_name")
