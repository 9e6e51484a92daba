import numpy as np
import pytest

from quern.operators import profile as P
from quern.operators.facts import ColumnFacts
from quern.operators.inference import infer, trace_df
from quern.operators.rules import ProductionRule, RuleBase
from quern.sources.samples import sample_dataset


@pytest.fixture(scope="module")
def passengers(spark):
    f = P.profile(sample_dataset(spark, "titanic"))
    return f, infer(spark, f)


def facts(name, uniqueness=1.0, rows=100, family="integer"):
    return ColumnFacts(0, name, family, family, rows, rows, 0, 0.0, uniqueness=uniqueness)


COMPACT = {"email": 0.0, "words": 1.0, "length": 8.0, "spaced": 0.0}


@pytest.mark.parametrize("name,shape,family,expected", [
    ("user_id", None, "integer", True), ("userId", None, "integer", True), ("order_date", None, "integer", False),
    ("customer_name", COMPACT, "text", False), ("blob", COMPACT, "text", True), ("amount", None, "real", False),
    ("ticket", {**COMPACT, "words": 3.0}, "text", False), ("contact", {**COMPACT, "email": 0.9}, "text", False),
    ("code", {**COMPACT, "length": 80.0}, "text", False), ("price_index", None, "real", True)])
def test_identifier(name, shape, family, expected):
    assert P.is_identifier(facts(name, family=family), shape) is expected


@pytest.mark.parametrize("values,order", [
    (["Low", "high", "medium "], ["low", "medium", "high"]), (["S", "XL"], ["s", "xl"]), (["low"], None),
    (["low", "other"], None), (["good", "bad"], ["bad", "good"])])
def test_ordinal(values, order):
    got = P.ordinal_order(values)
    assert got == order or (values == ["good", "bad"] and got == order)


def test_day_first_dates(spark):
    df = spark.createDataFrame([(f"{d:02d}/03/2021 1{d % 10}:30",) for d in range(1, 29)] + [(None,)], "d string")
    c = P.profile(df).columns["d"]
    assert c.semantic == "datetime" and c.day_first and c.has_time
    assert c.min_date.startswith("2021-03-01") and c.max_date.startswith("2021-03-28")


def test_iso_and_offsets(spark):
    df = spark.createDataFrame([("2021-03-01T10:00:00+02:00",), ("2021-03-01T10:00:00Z",), ("2021/3/2",), ("bad",)] +
                               [("2021-03-05",)] * 20, "d string")
    c = P.profile(df).columns["d"]
    assert c.semantic == "datetime" and c.mixed_offsets and c.min_date == "2021-03-01 08:00:00"


def test_infinities_count_as_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(24)] + [(float("inf"),), (float("-inf"),), (float("nan"),)], "a double")
    c = P.profile(df).columns["a"]
    assert c.missing == 3 and c.max == 23.0


def test_numeric_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.exponential(3, 500)
    c = P.profile(spark.createDataFrame([(float(v),) for v in x], "x double")).columns["x"]
    n, d = len(x), x - x.mean()
    g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
    assert c.skewness == pytest.approx(g1 * (n * (n - 1)) ** 0.5 / (n - 2))
    assert c.kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert sum(c.histogram) == n and c.histogram == list(np.histogram(x, 20)[0])
    assert c.std == pytest.approx(x.std(ddof=1)) and c.median == pytest.approx(np.median(x))


def test_correlation_over_complete_rows_only(spark):
    rows = [(float(i), float(2 * i + (i % 3)) if i % 4 else None, 1e9 + i * 1e-3) for i in range(60)]
    got: dict = {}
    P.numeric_profile(spark.createDataFrame(rows, "a double, b double, c double"), correlation=got)
    ok = [(r[0], r[1]) for r in rows if r[1] is not None]
    assert got[("a", "b")] == pytest.approx(np.corrcoef(*zip(*ok))[0, 1])
    assert got[("a", "c")] == pytest.approx(1.0, abs=1e-6)


def test_cramers_v_agrees_with_chi_squared(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, 400)
    rows = [(f"a{i}", f"b{i if rng.random() < .8 else 0}", "yn"[i % 2], "pq"[(i + (rng.random() < .1)) % 2]) for i in a]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    pairs = [("a", "b"), ("c", "d"), ("a", "d")]
    def expected(x, y):
        t = np.array([[sum(r["abcd".index(x)] == u and r["abcd".index(y)] == v for r in rows) for v in sorted({r["abcd".index(y)] for r in rows})]
                      for u in sorted({r["abcd".index(x)] for r in rows})], float)
        n, (r, k) = t.sum(), t.shape
        e = np.outer(t.sum(1), t.sum(0)) / n
        chi2 = ((np.maximum(abs(t - e) - 0.5, 0) if (r, k) == (2, 2) else t - e) ** 2 / e).sum()
        phi2 = max(0, chi2 / n - (k - 1) * (r - 1) / (n - 1))
        return (phi2 / (min(k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)) - 1)) ** 0.5
    got = P.cramers_v(df, pairs)
    assert [p[:2] for p in got] == sorted(pairs)
    assert [p[2] for p in got] == pytest.approx([expected(*p) for p in sorted(pairs)])


def test_bijection_is_a_critical_pair(spark):
    df = spark.createDataFrame([("xyz"[i % 3], "uvw"[i % 3]) for i in range(36)], "a string, b string")
    pair = P.profile(df).high_pairs[0]
    assert pair.strength >= 0.99 and pair.severity == "CRITICAL"


def test_null_pattern_counts_in_fingerprints(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 1)], "a int, b int")
    assert P.duplicate_counts(df, []) == (1, 0)


def test_hidden_duplicates(spark):
    base = [(f"u{i}", f"city{i % 7}", float(i)) for i in range(20)]
    rows = base + [(f"v{i}", *base[i][1:]) for i in range(10)]
    f = P.profile(spark.createDataFrame(rows, "user_id string, city string, score double"))
    assert (f.duplicate_rows, f.hidden_duplicate_rows) == (0, 10)


def test_long_texts_are_counted_by_digest_and_shown_in_full(spark):
    long = "lorem ipsum " * 30
    f = P.profile(spark.createDataFrame([(long,)] * 30 + [("b",)] * 10, "t string"))
    assert f.columns["t"].values == [(long, 30), ("b", 10)]


def test_tiny_and_empty_tables(spark):
    one = P.profile(spark.createDataFrame([(1, "a")], "x int, t string"))
    assert not one.columns["x"].is_constant
    assert ("DATASET_WARNING", ) == tuple(p for p, _ in infer(spark, one).trace if p == "DATASET_WARNING")
    none = P.profile(spark.createDataFrame([(None, None)] * 3, "x double, t string"))
    assert none.columns["x"].semantic == "numerical_discrete" and none.missing_pct == 100.0
    assert P.profile(spark.createDataFrame([], "x int")).rows == 0


def test_sample_table_end_to_end(spark, passengers):
    f, inf = passengers
    assert f.duplicate_rows == 3 and f.columns["PassengerId"].semantic == "identifier"
    r = inf.recommendations
    assert r["Cabin"].should_drop and r["Manifest_Source"].should_drop and r["PassengerId"].status == "DROP_RECOMMENDED"
    assert r["Age"].imputation in ("impute_median", "impute_mean") and r["Age"].add_indicator
    assert 5 <= inf.health["overall_score"] <= 100 and trace_df(spark, inf).count() == len(inf.trace)


def test_user_rules_and_failing_rules(spark, passengers):
    f, _ = passengers
    base = RuleBase()
    base.register_rule(ProductionRule("R-USR-01", "Wide", "ENCODING", "INFO", 0.5, "note_wide", "unique > 100", "wide"))
    base.register_rule(ProductionRule("R-USR-02", "Broken", "ENCODING", "INFO", 0.5, "none", "no_such_fact > 1", ""))
    inf = infer(spark, f, base=base)
    assert any(e["rule_id"] == "R-USR-01" and e["column"] == "Fare" for e in inf.log)
    assert [p for p, m in inf.trace if p == "RULE_ERROR" and "R-USR-02" in m]


def test_score_ignores_repairs(spark, passengers):
    from quern.operators.repair import Repair
    f, inf = passengers
    again = infer(spark, f, repairs=[Repair("R-QLT-07", "Sex", 3)])
    assert again.health["overall_score"] == inf.health["overall_score"] and again.health["repairs_applied"] == 1
