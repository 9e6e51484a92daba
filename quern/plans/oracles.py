"""SQL statements that state, in one engine-neutral form, what each query must return. They share no code with the
operators: statistics, fences, ranks and joins are written out again from the definitions."""

from __future__ import annotations

from quern.plans.views import EVENTS_DUPS, EVENTS_GAPS, ORDERS_DIRTY

# Columns of each view by kind, and what their names say about identifiers.
GAPS_NUM = ("event_id", "user_id", "value", "paired", "mostly_null", "shifted")
GAPS_TEXT = ("event_type", "kind", "sparse_kind", "rare", "const", "twin", "tier")
GAPS_ORDER = ("event_id", "user_id", "event_type", "value", "paired", "kind", "sparse_kind", "mostly_null", "rare",
              "const", "twin", "tier", "shifted")
LINE_NUM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax")


def union(columns, row: str) -> str:
    return " UNION ALL ".join(row.format(c=c, i=i) for i, c in enumerate(columns))


def numbers(source: str, columns) -> str:
    """CTEs: num(name, v) and stats(name, ...) with fences and outlier counts."""
    return f"""num AS ({union(columns, "SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS v FROM " + source)}),
base AS (SELECT name, count(*) AS n_rows, count(v) AS n, min(v) AS lo, max(v) AS hi, avg(v) AS mean,
  quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75,
  coalesce(skewness(v), 0) AS skew, coalesce(kurtosis(v), 0) AS kurt, CAST(count_if(v = 0) AS BIGINT) AS zeros,
  CAST(count_if(v < 0) AS BIGINT) AS negatives, count(DISTINCT v) AS uniq, CAST(count_if(v <> floor(v)) AS BIGINT) AS fracs
  FROM num GROUP BY name),
stats AS (SELECT b.*, o.outliers, o.extremes, 100.0 * o.outliers / b.n AS outlier_pct FROM base b JOIN (
  SELECT num.name, CAST(count_if(v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25)) AS BIGINT) AS outliers,
    CAST(count_if(v < q25 - 3 * (q75 - q25) OR v > q75 + 3 * (q75 - q25)) AS BIGINT) AS extremes
  FROM num JOIN base ON num.name = base.name GROUP BY num.name) o ON b.name = o.name)"""


def values(source: str, columns) -> str:
    """CTEs: val(name, v) as text and freq(name, v, c)."""
    return f"""val AS ({union(columns, "SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS v FROM " + source)}),
freq AS (SELECT name, v, count(*) AS c FROM val WHERE v IS NOT NULL GROUP BY name, v)"""


GAPS = f"WITH gaps AS ({EVENTS_GAPS}), "
# facts of events_gaps, one row per column; semantic types follow the definitions
GAPS_FACTS = GAPS + numbers("gaps", GAPS_NUM) + ", " + values("gaps", GAPS_ORDER) + f""",
cnt AS (SELECT name, count(*) AS n_rows, count(v) AS non_null, count(*) - count(v) AS missing FROM val GROUP BY name),
uni AS (SELECT name, count(*) AS uniq, max(c) AS top FROM freq GROUP BY name),
pos AS ({union(GAPS_ORDER, "SELECT '{c}' AS name, {i} AS position")}),
pear AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM gaps"
                              for i, a in enumerate(GAPS_NUM) for b in GAPS_NUM[i + 1:])}),
tab AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y, count(*) AS o FROM gaps WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL"
    for i, a in enumerate([c for c in GAPS_TEXT if c != 'const']) for b in [c for c in GAPS_TEXT if c != 'const'][i + 1:i + 10])}),
marg AS (SELECT *, sum(o) OVER (PARTITION BY a, b) AS n, sum(o) OVER (PARTITION BY a, b, x) AS rx,
  sum(o) OVER (PARTITION BY a, b, y) AS cy FROM tab),
chi AS (SELECT a, b, max(n) AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k,
  max(n) * (sum(CAST(o AS DOUBLE) * o / (CAST(rx AS DOUBLE) * cy)) - 1) AS chi2 FROM marg GROUP BY a, b),
cram AS (SELECT a, b, sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / CAST(n - 1 AS DOUBLE)) /
  (least(k - (k - 1) * (k - 1) / CAST(n - 1 AS DOUBLE), r - (r - 1) * (r - 1) / CAST(n - 1 AS DOUBLE)) - 1)) AS r
  FROM chi WHERE n > 20 AND r > 1 AND k > 1),
pairs AS (SELECT a, b, r, 'pearson' AS measure FROM pear WHERE abs(r) >= 0.75
  UNION ALL SELECT a, b, r, 'cramers_v' FROM cram WHERE r >= 0.75),
gapcols AS (SELECT name FROM cnt WHERE missing > 0 AND missing < n_rows),
com AS (SELECT a, b, r FROM ({" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)) AS r FROM gaps"
    for i, a in enumerate(("value", "paired", "kind", "sparse_kind", "mostly_null"))
    for b in ("value", "paired", "kind", "sparse_kind", "mostly_null")[i + 1:])}) WHERE r >= 0.5),
strong AS (SELECT name, max(r) AS max_abs_corr FROM (SELECT a AS name, abs(r) AS r FROM pairs UNION ALL SELECT b, abs(r) FROM pairs) GROUP BY name),
comiss AS (SELECT name, max(r) AS max_co FROM (SELECT a AS name, r FROM com UNION ALL SELECT b, r FROM com) GROUP BY name),
facts AS (SELECT p.position, p.name, c.n_rows, c.non_null, c.missing, 100.0 * c.missing / c.n_rows AS missing_pct, u.uniq,
  CAST(u.uniq AS DOUBLE) / c.non_null AS uniqueness, u.uniq <= 1 AS is_constant, u.uniq = 2 AS is_binary,
  100.0 * u.top / c.non_null AS dominant_pct, u.uniq >= 2 AND 100.0 * u.top / c.non_null >= 99 AS is_quasi_constant,
  CASE WHEN u.uniq <= 1 THEN 'constant'
       WHEN p.name = 'event_id' OR p.name = 'user_id' THEN
         CASE WHEN CAST(u.uniq AS DOUBLE) / c.non_null > 0.85 THEN 'identifier' ELSE 'numerical_continuous' END
       WHEN s.name IS NOT NULL THEN CASE WHEN u.uniq = 2 THEN 'boolean'
         WHEN u.uniq <= 10 AND s.fracs = 0 THEN 'numerical_discrete' ELSE 'numerical_continuous' END
       WHEN u.uniq <= 8 AND (SELECT bool_and(lower(trim(v)) IN ('low', 'medium', 'high')) FROM freq WHERE freq.name = p.name)
         THEN 'categorical_ordinal'
       WHEN u.uniq = 2 THEN 'boolean'
       WHEN CAST(u.uniq AS DOUBLE) / c.non_null > 0.9 THEN 'free_text' ELSE 'categorical_nominal' END AS semantic,
  s.name IS NOT NULL AND u.uniq > 1 AS has_numeric, s.lo, s.skew, s.kurt, s.outlier_pct,
  abs(s.skew) <= 0.8 AND s.kurt >= -1 AND s.kurt <= 2 AS is_normal,
  coalesce(g.max_abs_corr, 0) AS max_abs_corr, coalesce(m.max_co, 0) AS max_co_missing
  FROM pos p JOIN cnt c ON p.name = c.name JOIN uni u ON p.name = u.name LEFT JOIN stats s ON p.name = s.name
  LEFT JOIN strong g ON p.name = g.name LEFT JOIN comiss m ON p.name = m.name)"""

# rule id -> (action, confidence, severity, category, condition on facts)
RULE_SQL = {
    "R-IMP-01": ("drop_column", 0.96, "CRITICAL", "IMPUTATION", "missing_pct >= 70"),
    "R-IMP-02": ("impute_median", 0.92, "WARNING", "IMPUTATION",
                 "missing > 0 AND missing_pct < 70 AND has_numeric AND (abs(skew) >= 0.8 OR outlier_pct >= 2)"),
    "R-IMP-03": ("impute_mean", 0.88, "INFO", "IMPUTATION",
                 "missing > 0 AND missing_pct < 70 AND has_numeric AND abs(skew) < 0.8 AND outlier_pct < 2"),
    "R-IMP-04": ("impute_knn_or_iterative", 0.85, "OPTIMIZATION", "IMPUTATION",
                 "missing_pct BETWEEN 3 AND 40 AND has_numeric AND max_abs_corr >= 0.65"),
    "R-IMP-05": ("impute_mode", 0.90, "INFO", "IMPUTATION", "missing > 0 AND missing_pct < 5 AND semantic IN "
                 "('categorical_nominal', 'categorical_ordinal', 'boolean')"),
    "R-IMP-06": ("impute_constant", 0.93, "WARNING", "IMPUTATION", "missing_pct >= 5 AND missing_pct < 70 AND semantic IN "
                 "('categorical_nominal', 'categorical_ordinal', 'free_text', 'boolean')"),
    "R-IMP-07": ("add_missing_indicator", 0.86, "INFO", "MISSINGNESS_STRUCTURE",
                 "missing > 0 AND missing_pct < 70 AND max_co_missing >= 0.5"),
    "R-ENC-01": ("encode_binary", 0.98, "INFO", "ENCODING",
                 "is_binary AND semantic IN ('boolean', 'categorical_nominal') AND NOT is_constant"),
    "R-ENC-02": ("encode_onehot", 0.95, "INFO", "ENCODING", "uniq BETWEEN 3 AND 10 AND semantic = 'categorical_nominal'"),
    "R-ENC-03": ("encode_frequency_or_target", 0.91, "WARNING", "ENCODING",
                 "uniq > 10 AND semantic = 'categorical_nominal' AND uniqueness < 0.7"),
    "R-ENC-04": ("encode_ordinal", 0.94, "INFO", "ENCODING", "semantic = 'categorical_ordinal'"),
    "R-DIST-01": ("transform_log1p", 0.90, "WARNING", "SCALING_OUTLIERS", "has_numeric AND skew >= 1.2 AND lo >= 0"),
    "R-DIST-02": ("transform_yeo_johnson", 0.89, "WARNING", "SCALING_OUTLIERS",
                  "has_numeric AND abs(skew) >= 1.2 AND lo < 0"),
    "R-DIST-03": ("mitigate_outliers", 0.88, "WARNING", "SCALING_OUTLIERS", "has_numeric AND outlier_pct >= 2.5"),
    "R-DIST-04": ("scale_standard", 0.87, "INFO", "SCALING_OUTLIERS", "has_numeric AND is_normal AND outlier_pct < 2.5"),
    "R-FLT-01": ("drop_column", 0.99, "CRITICAL", "FILTERING_LEAKAGE", "is_constant"),
    "R-FLT-02": ("drop_column", 0.96, "CRITICAL", "FILTERING_LEAKAGE", "semantic = 'identifier'"),
    "R-FLT-03": ("flag_collinear", 0.90, "WARNING", "FILTERING_LEAKAGE", "max_abs_corr >= 0.85"),
    "R-FLT-04": ("flag_quasi_constant", 0.88, "WARNING", "FILTERING_LEAKAGE", "is_quasi_constant"),
    "R-DAT-01": ("decompose_datetime", 0.95, "INFO", "DATETIME", "semantic = 'datetime'"),
}


def rule_rows(rule_id: str, source: str = "facts") -> str:
    action, confidence, _, _, condition = RULE_SQL[rule_id]
    return (f"SELECT name AS \"column\", '{rule_id}' AS rule_id, '{action}' AS action, CAST({confidence} AS DOUBLE) AS confidence "
            f"FROM {source} WHERE {condition}")


LOG = ", log AS (" + " UNION ALL ".join(
    f"SELECT name AS col, '{r}' AS rule_id, '{a}' AS action, {c} AS confidence, '{s}' AS severity, '{g}' AS category, "
    f"{i} AS rule_order FROM facts WHERE {w}" for i, (r, (a, c, s, g, w)) in enumerate(RULE_SQL.items())) + ")"


def simple_facts(table: str, nums, texts, dates=(), ids=()) -> str:
    """Facts of a table without gaps; enough for the rules that fire there."""
    every = tuple(nums) + tuple(texts) + tuple(dates)
    return "WITH " + numbers(table, nums) + ", " + values(table, every) + f""",
uni AS (SELECT name, count(*) AS uniq, max(c) AS top, sum(c) AS non_null FROM freq GROUP BY name),
facts AS (SELECT u.name, 0 AS missing, 0.0 AS missing_pct, u.uniq, CAST(u.uniq AS DOUBLE) / u.non_null AS uniqueness,
  u.uniq <= 1 AS is_constant, u.uniq = 2 AS is_binary, u.uniq >= 2 AND 100.0 * u.top / u.non_null >= 99 AS is_quasi_constant,
  CASE WHEN u.name IN ('{"', '".join(dates) or "-"}') THEN 'datetime' WHEN u.uniq <= 1 THEN 'constant'
       WHEN u.name IN ('{"', '".join(ids) or "-"}') AND CAST(u.uniq AS DOUBLE) / u.non_null > 0.85 THEN 'identifier'
       WHEN s.name IS NOT NULL THEN CASE WHEN u.uniq = 2 THEN 'boolean' WHEN u.uniq <= 10 AND s.fracs = 0
         THEN 'numerical_discrete' ELSE 'numerical_continuous' END
       WHEN u.uniq = 2 THEN 'boolean' WHEN CAST(u.uniq AS DOUBLE) / u.non_null > 0.9 THEN 'free_text'
       ELSE 'categorical_nominal' END AS semantic,
  s.name IS NOT NULL AS has_numeric, s.lo, s.skew, s.kurt, s.outlier_pct,
  abs(s.skew) <= 0.8 AND s.kurt >= -1 AND s.kurt <= 2 AS is_normal, 0.0 AS max_abs_corr, 0.0 AS max_co_missing
  FROM uni u LEFT JOIN stats s ON u.name = s.name)"""


DIRTY = f"WITH dirty AS ({ORDERS_DIRTY})"
DUPS = f"WITH dups AS ({EVENTS_DUPS})"
PRICE = """CASE WHEN price_text = '?' THEN NULL
  WHEN price_text LIKE '(%)' THEN -CAST(replace(replace(price_text, '(', ''), ')', '') AS DOUBLE)
  ELSE CAST(replace(replace(replace(price_text, '$', ''), ',', ''), '%', '') AS DOUBLE) END"""
PRIORITY = "CASE WHEN upper(trim(priority)) <> 'N/A' THEN upper(trim(priority)) END"


def r6(e: str, name: str, d: int = 6) -> str:
    return f"round({e}, {d}) AS {name}"


ORACLES: dict[str, str] = {}
O = ORACLES

# ---- sources and sinks
O["src_01_delimited_scan"] = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,
       c_name || chr(10) || '"' || c_mktsegment || '", ' || c_custkey AS note FROM customer"""
O["src_04_json_scan"] = """SELECT event_id, event_type AS "e.kind", user_id AS "e.user.id", value, props FROM events"""
O["src_05_flatten"] = """SELECT doc_id, lang AS "meta.lang", source AS "meta.origin.source", n_chars AS "meta.origin.size"
FROM documents"""
O["src_06_parquet_scan"] = """SELECT doc_id, text, lang AS "meta.lang", source AS "meta.origin.source", n_chars AS "meta.origin.size" FROM documents"""
O["snk_01_csv"] = "SELECT doc_id, nullif(text, '') AS text, lang, source, n_chars FROM documents"
O["snk_02_parquet"] = "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders"
O["src_07_header_rules"] = """SELECT event_id, event_type, user_id AS event_type_1, value AS feature_3, props AS "VALUE" FROM events"""
O["src_08_type_inference"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
O["src_09_scan_metadata"] = """SELECT 'lineitem.parquet' AS filename, '.parquet' AS extension, 'parquet' AS format,
count(*) AS "rows", CAST(11 AS BIGINT) AS "columns" FROM lineitem"""
O["snk_03_safe_names"] = """SELECT c_custkey AS cust_key, c_name AS cust_name, c_nationkey AS cust_name_2, c_acctbal AS col_3,
c_mktsegment AS CUST_NAME_3 FROM customer"""
O["snk_04_column_schema"] = GAPS + values("gaps", GAPS_ORDER) + """ SELECT name AS "column", count(v) AS non_null,
count(DISTINCT v) AS "unique" FROM val GROUP BY name"""
O["snk_07_preview"] = DIRTY + """ SELECT order_id, price_text, flag, age, CASE WHEN isinf(ratio) THEN NULL ELSE ratio END AS ratio
FROM dirty ORDER BY order_id LIMIT 50"""

# ---- repair
O["qlt_07_strip_whitespace"] = DIRTY + " SELECT order_id, trim(flag) AS flag, trim(priority) AS priority FROM dirty"
O["qlt_01_disguised_missing"] = DIRTY + """ SELECT order_id, nullif(price_text, '?') AS price_text,
CASE WHEN trim(priority) <> 'N/A' THEN trim(priority) END AS priority FROM dirty"""
O["qlt_03_numeric_text"] = DIRTY + f" SELECT order_id, {PRICE} AS price_text, zip FROM dirty"
O["qlt_04_boolean_text"] = DIRTY + " SELECT order_id, CAST(lower(trim(flag)) = 'yes' AS INT) AS flag FROM dirty"
O["qlt_05_label_merge"] = DIRTY + f" SELECT order_id, {PRIORITY} AS priority FROM dirty"
O["qlt_06_infinite"] = DIRTY + " SELECT order_id, CASE WHEN NOT isinf(ratio) THEN ratio END AS ratio FROM dirty"
O["qlt_02_sentinel_codes"] = DIRTY + " SELECT order_id, nullif(age, -999) AS age FROM dirty"
O["qlt_r_replay_all"] = DIRTY + f""" SELECT order_id, {PRICE} AS price_text, CAST(lower(trim(flag)) = 'yes' AS INT) AS flag,
{PRIORITY} AS priority, nullif(age, -999) AS age, CASE WHEN NOT isinf(ratio) THEN ratio END AS ratio, date_text, zip FROM dirty"""
O["qlt_d_repair_log"] = DIRTY + """ SELECT * FROM (
SELECT 'R-QLT-01' AS rule_id, 'price_text' AS "column", CAST(count_if(price_text = '?') AS BIGINT) AS affected FROM dirty
UNION ALL SELECT 'R-QLT-03', 'price_text', CAST(count_if(price_text <> '?') AS BIGINT) FROM dirty
UNION ALL SELECT 'R-QLT-07', 'flag', CAST(count_if(trim(flag) <> flag) AS BIGINT) FROM dirty
UNION ALL SELECT 'R-QLT-04', 'flag', count(flag) FROM dirty
UNION ALL SELECT 'R-QLT-07', 'priority', CAST(count_if(trim(priority) <> priority) AS BIGINT) FROM dirty
UNION ALL SELECT 'R-QLT-01', 'priority', CAST(count_if(trim(priority) = 'N/A') AS BIGINT) FROM dirty
UNION ALL SELECT 'R-QLT-05', 'priority', CAST(count_if(trim(priority) <> upper(trim(priority))) AS BIGINT) FROM dirty
UNION ALL SELECT 'R-QLT-06', 'ratio', CAST(count_if(isinf(ratio)) AS BIGINT) FROM dirty
UNION ALL SELECT 'R-QLT-02', 'age', CAST(count_if(age = -999) AS BIGINT) FROM dirty)"""
O["job_01_audit"] = O["qlt_d_repair_log"]
_CELLS = (
    ("price_text", "R-QLT-01", "price_text", "nullif(price_text, '?')"), ("price_text", "R-QLT-03", "nullif(price_text, '?')", f"CAST({PRICE} AS VARCHAR)"),
    ("flag", "R-QLT-07", "flag", "trim(flag)"), ("flag", "R-QLT-04", "trim(flag)", "CAST(CAST(lower(trim(flag)) = 'yes' AS INT) AS VARCHAR)"),
    ("priority", "R-QLT-07", "priority", "trim(priority)"), ("priority", "R-QLT-01", "trim(priority)", "nullif(trim(priority), 'N/A')"),
    ("priority", "R-QLT-05", "nullif(trim(priority), 'N/A')", "upper(nullif(trim(priority), 'N/A'))"),
    ("age", "R-QLT-02", "CAST(age AS VARCHAR)", "CAST(nullif(age, -999) AS VARCHAR)"),
    ("ratio", "R-QLT-06", "CASE WHEN isinf(ratio) THEN 'Infinity' ELSE 'number' END", "CASE WHEN NOT isinf(ratio) THEN 'number' END"))
O["qlt_e_examples"] = DIRTY + ", cell AS (" + " UNION ALL ".join(
    f"""SELECT order_id, '{c}' AS "column", '{r}' AS rule_id, {b} AS before, {a} AS after FROM dirty""" for c, r, b, a in _CELLS) + """)
SELECT "column", rule_id, rk, before, after FROM (SELECT "column", rule_id, before, after, row_number() OVER (PARTITION BY "column", rule_id ORDER BY order_id) AS rk
FROM cell WHERE before IS NOT NULL AND before IS DISTINCT FROM after) WHERE rk <= 3"""

# ---- column profile
O["prf_01_counts"] = GAPS_FACTS + f""" SELECT name AS "column", non_null, missing, {r6('missing_pct', 'missing_pct')}, uniq AS "unique",
{r6('uniqueness', 'uniqueness')} FROM facts"""
O["prf_02_constant"] = GAPS_FACTS + ' SELECT name AS "column", is_constant FROM facts'
O["prf_03_quasi_constant"] = GAPS_FACTS + f""" SELECT name AS "column", {r6('dominant_pct', 'dominant_pct')},
is_quasi_constant FROM facts"""
O["prf_04_semantic_types"] = GAPS_FACTS + ' SELECT name AS "column", semantic FROM facts'
O["prf_05_date_text"] = DIRTY + r""" SELECT name AS "column", avg(CAST(regexp_matches(v, '^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})') AS INT)) > 0.7 AS is_date_text
FROM (SELECT 'date_text' AS name, date_text AS v FROM dirty UNION ALL SELECT 'zip', zip FROM dirty
UNION ALL SELECT 'priority', priority FROM dirty UNION ALL SELECT 'price_text', price_text FROM dirty
UNION ALL SELECT 'flag', flag FROM dirty) GROUP BY name"""
O["prf_06_identifiers"] = """SELECT * FROM (
SELECT 'events' AS "table", 'event_id' AS "column", count(DISTINCT event_id) > 0.85 * count(*) AS is_identifier FROM events
UNION ALL SELECT 'events', 'user_id', count(DISTINCT user_id) > 0.85 * count(*) FROM events
UNION ALL SELECT 'labels', 'doc_id', count(DISTINCT doc_id) > 0.85 * count(*) FROM labels
UNION ALL SELECT 'conversations', 'conv_id', count(DISTINCT conv_id) > 0.85 * count(*) FROM conversations
UNION ALL SELECT 'customer', 'c_custkey', count(DISTINCT c_custkey) > 0.85 * count(*) AND regexp_matches('c_custkey', '(^|_)(id|key|uuid)(_|$)') FROM customer
UNION ALL SELECT 'customer', 'c_name', count(DISTINCT c_name) > 0.98 * count(*) AND NOT regexp_matches('c_name', '(^|_)name(_|$)') FROM customer)"""
O["prf_07_ordinal"] = GAPS + """ord AS (SELECT DISTINCT lower(trim(tier)) AS w FROM gaps)
SELECT 'tier' AS "column", string_agg(w, ' < ' ORDER BY CASE w WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS ordinal_order FROM ord"""
_STATS = ", ".join(r6(e, n) for e, n in (
    ("lo", '"min"'), ("hi", '"max"'), ("mean", "mean"), ("median", "median"), ("std", "std"), ("q25", "q25"), ("q75", "q75"),
    ("q75 - q25", "iqr"), ("skew", "skewness"), ("kurt", "kurtosis"), ("100.0 * zeros / n", "zero_pct")))
_STAT_ROW = f""" SELECT name AS "column", {_STATS}, abs(skew) <= 0.8 AND kurt >= -1 AND kurt <= 2 AS is_normal, zeros, negatives FROM stats"""
O["prf_08_numeric_stats"] = GAPS + numbers("gaps", GAPS_NUM) + _STAT_ROW
O["prf_08_numeric_stats_lineitem"] = "WITH " + numbers("lineitem", LINE_NUM) + _STAT_ROW
O["prf_08b_outliers"] = GAPS + numbers("gaps", GAPS_NUM) + f""" SELECT name AS "column", outliers, {r6('outlier_pct', 'outlier_pct')},
extremes, {r6('q25 - 1.5 * (q75 - q25)', 'lower_fence')}, {r6('q75 + 1.5 * (q75 - q25)', 'upper_fence')} FROM stats"""
O["prf_09_top_categories"] = GAPS + values("gaps", [c for c in GAPS_TEXT if c != "const"]) + """
SELECT name AS "column", rank, v AS category, c AS "count", round(100.0 * c / n, 4) AS percentage FROM (
SELECT *, row_number() OVER (PARTITION BY name ORDER BY c DESC, v) AS rank, sum(c) OVER (PARTITION BY name) AS n FROM freq) WHERE rank <= 6"""
O["prf_09_category_stats"] = GAPS + values("gaps", [c for c in GAPS_TEXT if c != "const"]) + f""",
p AS (SELECT *, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY name) AS p FROM freq)
SELECT name AS "column", arg_max(v, (c, -ascii(v))) AS mode, round(100 * max(p), 6) AS mode_pct, CAST(count_if(p < 0.01) AS BIGINT) AS rare,
round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY name"""
O["prf_10_histogram"] = GAPS + numbers("gaps", ("user_id", "value", "shifted", "paired")) + f""",
bins AS (SELECT num.name, least(CAST(floor((v - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin FROM num JOIN stats ON num.name = stats.name WHERE v IS NOT NULL),
grid AS (SELECT name, lo, hi, b AS bin FROM stats, range(20) t(b))
SELECT g.name AS "column", CAST(g.bin AS BIGINT) AS bin, round(max(lo + (hi - lo) * g.bin / 20), 4) AS lower, count(b.bin) AS "count"
FROM grid g LEFT JOIN bins b ON g.name = b.name AND g.bin = b.bin GROUP BY g.name, g.bin"""
O["prf_11_datetime_stats"] = DIRTY + """, d AS (SELECT 'ts' AS name, ts AS t FROM events UNION ALL SELECT 'o_orderdate', o_orderdate FROM orders
UNION ALL SELECT 'date_text', CAST(strptime(date_text, '%d/%m/%Y') AS TIMESTAMP) FROM dirty)
SELECT name AS "column", round(epoch(max(t) - min(t)) / 86400.0, 1) AS span_days,
strftime(min(t), '%Y-%m-%d') AS first_day, strftime(max(t), '%Y-%m-%d') AS last_day, bool_or(hour(t) <> 0 OR minute(t) <> 0) AS has_time FROM d GROUP BY name"""
O["prf_13_parse_dates"] = DIRTY + """ SELECT order_id, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m, CAST(day(d) AS INT) AS d FROM (
SELECT order_id, strptime(date_text, '%d/%m/%Y') AS d FROM dirty)"""
O["prf_14_infinite_to_null"] = DIRTY + """ SELECT count(*) AS n_rows, count(CASE WHEN NOT isinf(ratio) THEN ratio END) AS finite,
round(sum(CASE WHEN NOT isinf(ratio) THEN ratio END), 3) AS total FROM dirty"""

# ---- table profile
O["dst_01_shape"] = GAPS_FACTS + """ SELECT max(n_rows) AS "rows", count(*) AS cols, CAST(sum(n_rows) AS BIGINT) AS cells,
CAST(sum(missing) AS BIGINT) AS missing_cells, round(100.0 * sum(missing) / sum(n_rows), 6) AS missing_pct FROM facts"""
O["dst_02_exact_duplicates"] = DUPS + """ SELECT (SELECT count(*) FROM dups) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dups)) AS duplicate_rows,
round(100.0 * ((SELECT count(*) FROM dups) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dups))) / (SELECT count(*) FROM dups), 6) AS duplicate_pct"""
O["dst_03_hidden_duplicates"] = DUPS + """ SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM dups)) -
(SELECT count(*) FROM (SELECT DISTINCT event_type, user_id, ts, value FROM dups)) AS hidden_duplicate_rows"""
O["dst_05_pearson_matrix"] = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 3) AS correlation FROM lineitem"
    for i, a in enumerate(LINE_NUM) for b in LINE_NUM[i + 1:])
O["dst_06_high_pairs"] = GAPS_FACTS + """ SELECT a AS feature_a, b AS feature_b, measure, round(r, 5) AS correlation,
CASE WHEN abs(r) >= 0.9 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM pairs"""
O["dst_07_cramers_v"] = GAPS_FACTS + " SELECT a AS feature_a, b AS feature_b, round(r, 5) AS v FROM cram"
O["dst_08_co_missing"] = GAPS_FACTS + " SELECT a AS feature_a, b AS feature_b, round(r, 5) AS correlation FROM com"
O["dst_09_type_counts"] = GAPS_FACTS + " SELECT semantic, count(*) AS n_columns FROM facts GROUP BY semantic"

# ---- rules
for _r in RULE_SQL:
    O["rule_" + _r.lower().replace("-", "_")] = GAPS_FACTS + " " + rule_rows(_r)
O["rule_r_dat_01"] = simple_facts("events", ("event_id", "user_id", "value"), ("event_type", "props"), ("ts",), ("event_id",)) + " " + rule_rows("R-DAT-01")
O["rule_r_dist_04"] = simple_facts("conversations", ("conv_id", "turn"), ("role", "text")) + " " + rule_rows("R-DIST-04")
O["rule_r_enc_03"] = simple_facts("part", ("p_partkey", "p_size", "p_retailprice"), ("p_name", "p_brand", "p_type")) + " " + rule_rows("R-ENC-03")
O["rule_r_int_01"] = O["dst_03_hidden_duplicates"].replace("hidden_duplicate_rows", "n").replace(
    "SELECT (SELECT", "SELECT '(dataset)' AS \"column\", 'R-INT-01' AS rule_id, 'drop_duplicates_ignoring_ids' AS action, CAST(0.93 AS DOUBLE) AS confidence FROM (SELECT (SELECT", 1) + ") WHERE n > 0"
O["inf_01_resolution"] = GAPS_FACTS + LOG + """, pick AS (SELECT *, row_number() OVER (PARTITION BY col, category ORDER BY
(action = 'impute_knn_or_iterative') DESC, CASE WHEN category = 'IMPUTATION' THEN confidence ELSE 0 END DESC, rule_order) AS rk
FROM log WHERE category IN ('IMPUTATION', 'ENCODING', 'DATETIME') OR (category = 'FILTERING_LEAKAGE' AND action = 'drop_column'))
SELECT col AS "column", category, rule_id, action FROM pick WHERE rk = 1
UNION ALL SELECT col, category, rule_id, action FROM log WHERE category = 'SCALING_OUTLIERS'"""
O["inf_02_status"] = GAPS_FACTS + LOG + """ SELECT f.name AS "column", CASE coalesce(max(CASE WHEN action = 'drop_column' THEN 4
WHEN severity = 'CRITICAL' THEN 3 WHEN severity = 'WARNING' THEN 2 WHEN col IS NOT NULL THEN 1 END), 0)
WHEN 4 THEN 'DROP_RECOMMENDED' WHEN 3 THEN 'CRITICAL_ATTENTION' WHEN 2 THEN 'REQUIRES_TRANSFORMATION'
WHEN 1 THEN 'READY_WITH_PREPROCESSING' ELSE 'HEALTHY' END AS status FROM facts f LEFT JOIN log ON f.name = log.col GROUP BY f.name"""
O["inf_03_rule_log"] = GAPS_FACTS + LOG + """ SELECT '(dataset)' AS "column", 'R-INT-01' AS rule_id, 'WARNING' AS severity
WHERE (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps)) > (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (event_id) FROM gaps))
UNION ALL SELECT col, rule_id, severity FROM log"""
_SCORE = GAPS_FACTS + """, t AS (SELECT 100.0 * sum(missing) / sum(n_rows) AS miss, count_if(missing > 0) AS gappy, count(*) AS cols,
greatest(1, count_if(semantic LIKE 'numerical%')) AS nums, count_if(has_numeric AND abs(skew) >= 1.2) AS skewed,
count_if(has_numeric AND outlier_pct >= 2.5) AS outl, count_if(semantic = 'constant') AS const, count_if(semantic = 'identifier') AS ids,
count_if(semantic = 'categorical_nominal' AND uniq > 10) AS hc, count_if(semantic = 'datetime') AS dts, (SELECT count(*) FROM pairs) AS np FROM facts),
s AS (SELECT *, greatest(0, least(100, 100 - (2 * miss + 20.0 * gappy / cols))) AS c1, greatest(0, least(100, 100 - (35.0 * skewed / nums + 35.0 * outl / nums))) AS c2,
greatest(0, least(100, 100 - (20 * const + 15 * ids + least(25, 6 * np)))) AS c3, greatest(0, least(100, 100 - (12 * hc + 10 * dts))) AS c4 FROM t),
h AS (SELECT *, round(CAST(greatest(5, least(100, 0.3 * c1 + 0.25 * c2 + 0.25 * c3 + 0.2 * c4)) AS DOUBLE), 1) AS o FROM s)"""
O["sco_01_health"] = _SCORE + """ SELECT o AS overall_score, CASE WHEN o >= 92 THEN 'A+' WHEN o >= 83 THEN 'A' WHEN o >= 72 THEN 'B' WHEN o >= 60 THEN 'C'
WHEN o >= 45 THEN 'D' ELSE 'F' END AS grade, round(CAST(c1 AS DOUBLE), 1) AS completeness, round(CAST(c2 AS DOUBLE), 1) AS distribution,
round(CAST(c3 AS DOUBLE), 1) AS parsimony, round(CAST(c4 AS DOUBLE), 1) AS encoding_readiness FROM h"""
O["sco_02_issues"] = _SCORE + """, hid AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM gaps)) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (event_id) FROM gaps)) AS n)
SELECT x.issue FROM (SELECT ids || ' identifier column(s)' AS issue FROM h WHERE ids > 0 UNION ALL SELECT const || ' constant column(s)' FROM h WHERE const > 0
UNION ALL SELECT np || ' strongly associated column pair(s)' FROM h WHERE np > 0 UNION ALL SELECT outl || ' numeric column(s) with many outliers' FROM h WHERE outl > 0
UNION ALL SELECT n || ' row(s) that repeat once identifiers are ignored' FROM hid WHERE n > 0) x"""

# ---- recipe
O["rec_01_infinite"] = O["qlt_06_infinite"]
O["rec_02_prune"] = GAPS + """z AS (SELECT 1) SELECT event_id, user_id, event_type, value, paired, kind, sparse_kind, rare, twin, tier, shifted FROM gaps"""
O["rec_03_drop_duplicates"] = DUPS + " SELECT DISTINCT event_type, user_id, value FROM dups"
_TS = """CAST(year(ts) AS INT) AS ts_year, CAST(month(ts) AS INT) AS ts_month, CAST(day(ts) AS INT) AS ts_day,
CAST(isodow(ts) - 1 AS INT) AS ts_dayofweek, CAST(isodow(ts) >= 6 AS INT) AS ts_is_weekend, round(sin(2 * pi() * month(ts) / 12.0), 9) AS ts_sin_month,
round(cos(2 * pi() * month(ts) / 12.0), 9) AS ts_cos_month, CAST(hour(ts) AS INT) AS ts_hour, round(sin(2 * pi() * hour(ts) / 24.0), 9) AS ts_sin_hour,
round(cos(2 * pi() * hour(ts) / 24.0), 9) AS ts_cos_hour, CAST(hour(ts) < 6 OR hour(ts) > 20 AS INT) AS ts_is_night, CAST(minute(ts) AS INT) AS ts_minute"""
O["rec_04_datetime_features"] = f"SELECT event_id, {_TS} FROM events"
O["rec_05_row_drop"] = GAPS + "z AS (SELECT 1) SELECT event_id, paired FROM gaps WHERE paired IS NOT NULL"
O["rec_07_simple_imputation"] = GAPS + """f AS (SELECT quantile_cont(value, 0.5) AS med, avg(paired) AS mean FROM gaps),
m AS (SELECT kind AS md FROM gaps WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)
SELECT event_id, round(coalesce(value, med), 6) AS value, round(coalesce(paired, mean), 6) AS paired, coalesce(kind, md) AS kind,
coalesce(sparse_kind, 'Missing') AS sparse_kind, round(coalesce(mostly_null, -5), 6) AS mostly_null FROM gaps, f, m"""
O["rec_07b_missing_indicator"] = GAPS + "z AS (SELECT 1) SELECT event_id, CAST(value IS NULL AS INT) AS value_was_missing, CAST(paired IS NULL AS INT) AS paired_was_missing FROM gaps"
_EV = "WITH q AS (SELECT quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b, quantile_cont(value, 0.25) c, quantile_cont(value, 0.75) d, avg(value) m, stddev_samp(value) s FROM events)"
O["rec_08_winsorize"] = _EV + " SELECT event_id, round(least(greatest(value, a), b), 6) AS value FROM events, q"
O["rec_08_clip_iqr"] = _EV + " SELECT event_id, round(least(greatest(value, c - 1.5 * (d - c)), d + 1.5 * (d - c)), 6) AS value FROM events, q"
O["rec_08_zscore_clip"] = _EV + " SELECT event_id, round(least(greatest(value, m - 3 * s), m + 3 * s), 6) AS value FROM events, q"
O["rec_09_standard"] = "WITH q AS (SELECT avg(l_quantity) m, stddev_pop(l_quantity) s FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity FROM lineitem, q"


def _bent(x: str, g: str) -> str:
    """The Yeo-Johnson transform of x with exponent g."""
    branch = lambda p: f"CASE WHEN abs({p}) < 1e-12 THEN ln(1 + abs({x})) ELSE (exp({p} * ln(1 + abs({x}))) - 1) / ({p}) END"
    return f"(CASE WHEN {x} >= 0 THEN {branch(g)} ELSE -({branch(f'(2 - {g})')}) END)"


def _power() -> str:
    """Six grids of 17 exponents, each around the likeliest of the one before."""
    steps = ["s AS (SELECT count(shifted) AS n, sum(sign(shifted) * ln(1 + abs(shifted))) AS ls FROM gaps)",
             "b0 AS (SELECT CAST(-2 AS DOUBLE) AS lo, CAST(2 AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS best)"]
    for k in range(1, 7):
        steps += [
            f"g{k} AS (SELECT lo + (hi - lo) * i / 16 AS g FROM b{k - 1}, range(17) t(i))",
            f"v{k} AS (SELECT g, var_pop({_bent('shifted', 'g')}) AS v FROM g{k}, gaps WHERE shifted IS NOT NULL GROUP BY g)",
            f"w{k} AS (SELECT g FROM v{k}, s WHERE v > 0 ORDER BY -n / 2 * ln(v) + (g - 1) * ls DESC, g DESC LIMIT 1)",
            f"r{k} AS (SELECT g, CASE WHEN (g = lo OR g = hi) AND (lo <= -2 OR hi >= 2) THEN (hi - lo) / 2 ELSE (hi - lo) / 16 END AS r FROM w{k}, b{k - 1})",
            f"b{k} AS (SELECT g - r AS lo, g + r AS hi, g AS best FROM r{k})"]
    y = _bent("shifted", "best")
    return GAPS + ", ".join(steps) + f""", q AS (SELECT avg({y}) AS m, stddev_pop({y}) AS d FROM gaps, b6)
SELECT event_id, round(({y} - m) / d, 5) AS shifted FROM gaps, b6, q"""


O["rec_10_yeo_johnson"] = _power()
O["rec_09_robust"] = "WITH q AS (SELECT quantile_cont(value, 0.5) m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) i FROM events) SELECT event_id, round((value - m) / i, 6) AS value FROM events, q"
O["rec_09_log1p"] = _EV + " SELECT event_id, round(ln(1 + least(greatest(value, a), b)), 6) AS value FROM events, q"
O["rec_11_binary"] = "SELECT l_orderkey, l_linenumber, CAST(l_linestatus = 'O' AS INT) AS l_linestatus FROM lineitem"
O["rec_12_frequency"] = "SELECT p_partkey, round(CAST(count(*) OVER (PARTITION BY p_brand) AS DOUBLE) / count(*) OVER (), 6) AS p_brand FROM part"
O["rec_13_ordinal"] = GAPS + "z AS (SELECT 1) SELECT event_id, CAST(CASE lower(trim(tier)) WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INT) AS tier FROM gaps"
O["rec_13_ordinal_sorted"] = "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS o_orderpriority FROM orders"
O["rec_14_onehot"] = "SELECT event_id, " + ", ".join(
    f"CAST(event_type = '{v}' AS INT) AS event_type_{v}" for v in ("error", "purchase", "signup", "view")) + " FROM events"
O["rec_00_overrides"] = """WITH q AS (SELECT quantile_cont(value, 0.25) c, quantile_cont(value, 0.75) d FROM events), k AS (
SELECT event_id, least(greatest(value, c - 1.5 * (d - c)), d + 1.5 * (d - c)) AS v, event_type FROM events, q),
r AS (SELECT quantile_cont(v, 0.5) m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) i FROM k)
SELECT event_id, round((v - m) / i, 6) AS value, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS event_type FROM k, r"""
O["rec_t_target_protected"] = "SELECT CAST(p_size AS INT) AS p_size, p_retailprice, p_type FROM part"
O["rec_16_report"] = DUPS + """, d AS (SELECT DISTINCT event_type, user_id, ts, value FROM dups)
SELECT (SELECT count(*) FROM dups) AS rows_before, (SELECT count(*) FROM d) AS rows_after, CAST(5 AS BIGINT) AS columns_before, CAST(18 AS BIGINT) AS columns_after,
CAST(0 AS BIGINT) AS missing_after"""
_E = "WITH q AS (SELECT DISTINCT event_type, user_id, ts, value FROM events), b AS (SELECT quantile_cont(value, 0.01) lo, quantile_cont(value, 0.99) hi FROM q)"
O["rec_full_events"] = _E + f""" SELECT user_id, round(ln(1 + least(greatest(value, lo), hi)), 6) AS value, {_TS}, """ + ", ".join(
    f"CAST(event_type = '{v}' AS INT) AS event_type_{v}" for v in ("error", "purchase", "signup", "view")) + " FROM q, b"
O["rec_06_knn_imputation"] = GAPS + """x AS (SELECT event_id, CAST(user_id AS DOUBLE) AS a, value AS b, shifted AS c FROM gaps),
d AS (SELECT q.event_id, o.b AS v, o.event_id AS o_id, sqrt(CAST(3 AS DOUBLE) / 2 * ((q.a - o.a) * (q.a - o.a) + (q.c - o.c) * (q.c - o.c))) AS dist
  FROM x q JOIN x o ON q.b IS NULL AND o.b IS NOT NULL),
k AS (SELECT event_id, avg(v) AS fill FROM (SELECT event_id, v, row_number() OVER (PARTITION BY event_id ORDER BY dist, v, o_id) AS rk FROM d) WHERE rk <= 5 GROUP BY event_id)
SELECT x.event_id, round(coalesce(x.b, k.fill), 6) AS value FROM x LEFT JOIN k ON x.event_id = k.event_id"""

# ---- leakage-safe preparation
_H = "CAST('0x' || substring(md5(CAST(event_id AS VARCHAR) || '|42'), 1, 13) AS BIGINT)"
_SPLIT = f"""WITH e AS (SELECT *, {_H} AS h FROM events), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type),
x AS (SELECT *, ceil(0.2 * sum(n) OVER ()) AS t, ceil(0.2 * sum(n) OVER ()) * n / sum(n) OVER () AS e FROM c),
qa AS (SELECT event_type, floor(e) + CAST(row_number() OVER (ORDER BY e - floor(e) DESC, n DESC, event_type) <= t - sum(floor(e)) OVER () AS INT) AS quota FROM x),
s AS (SELECT e.*, row_number() OVER (PARTITION BY e.event_type ORDER BY h) <= quota AS is_test FROM e JOIN qa ON e.event_type = qa.event_type)"""
O["pip_03_split"] = _SPLIT + " SELECT event_id, is_test FROM s"
O["pip_03_split_quotas"] = _SPLIT + " SELECT event_type, is_test, count(*) AS n FROM s GROUP BY event_type, is_test"
O["pip_04_train_statistics"] = _SPLIT + """, q AS (SELECT quantile_cont(value, 0.01) a, quantile_cont(value, 0.99) b FROM s WHERE NOT is_test),
l AS (SELECT event_id, is_test, ln(1 + least(greatest(value, a), b)) AS v FROM s, q),
r AS (SELECT quantile_cont(v, 0.5) m, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) i FROM l WHERE NOT is_test)
SELECT l.event_id, is_test, round((v - m) / i, 6) AS value FROM l, r"""
O["pip_01_groups"] = simple_facts("events", ("event_id", "user_id", "value"), ("event_type", "props"), ("ts",), ("event_id",)) + """
SELECT name AS "column", CASE WHEN semantic = 'identifier' OR is_constant THEN 'drop' WHEN semantic = 'datetime' THEN 'datetime'
WHEN is_binary THEN 'binary' WHEN semantic LIKE 'numerical%' THEN CASE WHEN skew >= 1.2 AND lo >= 0 THEN 'log1p'
WHEN abs(skew) >= 0.8 OR outlier_pct >= 2 THEN 'skewed' ELSE 'gaussian' END WHEN uniq > 10 THEN 'high_card' ELSE 'onehot' END AS "group" FROM facts"""
O["pip_06_gaussian_group"] = _SPLIT + """, q AS (SELECT avg(user_id) m, stddev_pop(user_id) sd FROM s WHERE NOT is_test)
SELECT event_id, round((user_id - m) / sd, 6) AS user_id FROM s, q"""
O["pip_09_frequency_group"] = _SPLIT + """, q AS (SELECT props, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM s WHERE NOT is_test GROUP BY props)
SELECT event_id, round(CAST(coalesce(share, 0) AS DOUBLE), 6) AS props FROM s LEFT JOIN q ON s.props = q.props"""
O["pip_08_onehot_group"] = "SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'N' AS INT) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INT) AS l_returnflag_R FROM lineitem"
O["pip_10_binary_group"] = O["rec_11_binary"]

# ---- target
_DOCS = "WITH d AS (SELECT documents.lang, documents.source, documents.n_chars, labels.quality, labels.toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id)"
O["tgt_01_task_type"] = """SELECT target, CASE WHEN n = 2 THEN 'binary_classification' WHEN num AND n > 20 THEN 'regression' ELSE 'multiclass_classification' END AS task, n AS "unique" FROM (
SELECT 'l_linestatus' AS target, count(DISTINCT l_linestatus) AS n, false AS num FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), false FROM lineitem
UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), true FROM lineitem UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), true FROM lineitem)"""
O["tgt_02_class_counts"] = "SELECT l_returnflag AS class, count(*) AS \"count\" FROM lineitem GROUP BY l_returnflag"
O["tgt_02_class_balance"] = _DOCS + """, c AS (SELECT toxic, count(*) AS n FROM d GROUP BY toxic), p AS (SELECT CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM c)
SELECT count(*) AS classes, round(100 * min(p), 6) AS minority_pct, round(1 - sum(p * p), 6) AS gini, round(-sum(p * log2(p)), 6) AS entropy,
CASE WHEN 100 * min(p) < 5 THEN 'SEVERE' WHEN 100 * min(p) < 15 THEN 'MODERATE' ELSE 'NONE' END AS severity FROM p"""
O["tgt_03_correlation"] = _DOCS + """ SELECT 'n_chars' AS feature, round(corr(n_chars, toxic), 6) AS correlation FROM d
UNION ALL SELECT 'quality', round(corr(quality, toxic), 6) FROM d"""
def _mi(src: str, table: str, x: str, y: str) -> str:
    return f"""SELECT '{x}' AS feature, round(sum(c / n * ln(c * n / (cx * cy))), 6) AS mi FROM (SELECT CAST(count(*) AS DOUBLE) AS c,
sum(CAST(count(*) AS DOUBLE)) OVER () AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY {x}) AS cx, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY {y}) AS cy FROM {table} GROUP BY {x}, {y})"""
O["tgt_04_mutual_information"] = _DOCS + " " + _mi("", "d", "lang", "toxic") + " UNION ALL " + _mi("", "d", "source", "toxic")
O["tgt_05_leakage"] = """WITH t AS (SELECT l_linestatus, CAST(l_linestatus = 'O' AS INT) AS copy, l_returnflag FROM lineitem)
SELECT 'copy' AS feature, abs(corr(copy, CAST(l_linestatus = 'O' AS INT))) >= 0.95 AS leakage_risk FROM t
UNION ALL SELECT feature, mi >= 0.9 OR mi >= 0.95 * h FROM (""" + _mi("", "t", "l_returnflag", "l_linestatus") + """) AS m,
(SELECT -sum(p * ln(p)) AS h FROM (SELECT CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS p FROM t GROUP BY l_linestatus)) AS e"""
O["tgt_06_ranking"] = _DOCS + ", m AS (" + _mi("", "d", "lang", "toxic") + " UNION ALL " + _mi("", "d", "source", "toxic") + """)
SELECT row_number() OVER (ORDER BY mi DESC) AS rank, feature, mi AS score FROM m"""

# ---- contracts
O["con_01_constraints"] = """WITH s AS (SELECT 'value' AS c, min(value) AS lo, max(value) AS hi FROM events UNION ALL SELECT 'user_id', min(user_id), max(user_id) FROM events)
SELECT c AS "column", 'min' AS "check", lo AS bound FROM s UNION ALL SELECT c, 'max', hi FROM s"""
O["con_02_violations"] = f"""WITH gaps AS ({EVENTS_GAPS}) SELECT * FROM (
SELECT 'value' AS "column", 'not_null' AS "check", CAST(count_if(value IS NULL) AS BIGINT) AS violations FROM gaps
UNION ALL SELECT 'value', 'min', CAST(count_if(value < (SELECT min(value) FROM events)) AS BIGINT) FROM gaps
UNION ALL SELECT 'event_type', 'isin', CAST(count_if(event_type NOT IN (SELECT event_type FROM events)) AS BIGINT) FROM gaps
UNION ALL SELECT 'props', 'not_null', count(*) FROM gaps)"""
O["con_02_failing_rows"] = GAPS + "z AS (SELECT 1) SELECT event_id FROM gaps WHERE value IS NULL"

# ---- charts
O["viz_01_scatter_sample"] = """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey AS row_id, l_quantity AS x, l_extendedprice AS y, l_returnflag AS hue FROM (
SELECT *, CAST('0x' || substring(md5(CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '|42'), 1, 13) AS BIGINT) AS h FROM lineitem)
ORDER BY h, row_id LIMIT 800"""
O["viz_01_scatter_line"] = "SELECT count(*) AS total_points, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_extendedprice, l_quantity), 3) AS r_value, round(corr(l_extendedprice, l_quantity) ** 2, 3) AS r_squared FROM lineitem"
O["viz_02_grouped"] = """WITH t AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 15)
SELECT source AS category, count(*) AS "count", round(avg(n_chars), 4) AS mean, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.25), 4) AS q25,
round(quantile_cont(n_chars, 0.75), 4) AS q75, CAST(min(n_chars) AS DOUBLE) AS "min", CAST(max(n_chars) AS DOUBLE) AS "max" FROM documents SEMI JOIN t ON documents.source = t.source GROUP BY documents.source"""
O["viz_03_missingness_grid"] = GAPS + """o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn, greatest(1, count(*) OVER () // 60) AS size FROM gaps)
SELECT CAST(min(rn) AS BIGINT) AS row_start, CAST(max(rn) + 1 AS BIGINT) AS row_end, """ + ", ".join(
    f"round(100.0 * avg(CAST({c} IS NULL AS INT)), 4) AS {c}" for c in ("value", "kind", "sparse_kind", "mostly_null")) + " FROM o GROUP BY rn // size"
O["viz_04_column_dictionary"] = GAPS_FACTS + """ SELECT name, semantic, uniq AS "unique", round(missing_pct, 4) AS missing_pct FROM facts
WHERE semantic = 'categorical_nominal' AND contains(lower(name), 'kind')"""
O["viz_05_outlier_ranking"] = GAPS + numbers("gaps", GAPS_NUM) + """ SELECT row_number() OVER (ORDER BY round(outlier_pct, 9) DESC,
CASE name WHEN 'event_id' THEN 0 WHEN 'user_id' THEN 1 WHEN 'value' THEN 3 WHEN 'paired' THEN 4 WHEN 'mostly_null' THEN 7 ELSE 12 END) AS rank, name, round(outlier_pct, 6) AS outlier_pct FROM stats"""
O["viz_05_flagged_bins"] = GAPS + numbers("gaps", ("value", "shifted")) + """, g AS (SELECT *, lo + (hi - lo) * b / 20 AS l, lo + (hi - lo) * (b + 1) / 20 AS u FROM stats, range(20) t(b))
SELECT name AS "column", CAST(b AS BIGINT) AS bin, l < q25 - 1.5 * (q75 - q25) OR u > q75 + 1.5 * (q75 - q25) AS outside FROM g"""
O["viz_06_groupable"] = GAPS_FACTS + """ SELECT name, uniq AS "unique" FROM facts WHERE semantic IN ('categorical_nominal', 'categorical_ordinal', 'boolean', 'free_text') AND uniq BETWEEN 2 AND 20"""
O["viz_07_recommendation_filter"] = GAPS_FACTS + """, d AS (SELECT *, missing_pct >= 70 OR is_constant OR semantic = 'identifier' AS dropped FROM facts)
SELECT 'drop' AS filter, name AS "column" FROM d WHERE dropped UNION ALL SELECT 'impute', name FROM d WHERE missing > 0 AND NOT dropped
UNION ALL SELECT 'outliers', name FROM d WHERE has_numeric AND (outlier_pct > 0 OR abs(skew) >= 1)"""

# ---- diff
O["dif_01_cell_status"] = GAPS + """c AS (SELECT 'value' AS "column", CASE WHEN value IS NULL THEN 'imputed' ELSE 'normal' END AS status FROM gaps
UNION ALL SELECT 'kind', CASE WHEN kind IS NULL THEN 'imputed' ELSE 'normal' END FROM gaps UNION ALL SELECT 'tier', CASE WHEN tier <> trim(tier) THEN 'modified' ELSE 'normal' END FROM gaps
UNION ALL SELECT 'extra', 'new' FROM gaps) SELECT "column", status, count(*) AS cells FROM c GROUP BY ALL"""
O["dif_02_column_diff"] = GAPS + """z AS (SELECT 1) SELECT 'value' AS "column", 'kept' AS change, CAST(count_if(value IS NULL) AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after FROM gaps
UNION ALL SELECT 'kind', 'dropped', CAST(count_if(kind IS NULL) AS BIGINT), NULL FROM gaps UNION ALL SELECT 'extra', 'created', NULL, CAST(count_if(event_type NOT IN (SELECT event_type FROM events)) AS BIGINT) FROM gaps"""
O["dif_03_row_search"] = "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')"
