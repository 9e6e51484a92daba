import numpy as np
import pytest

from quern.operators import quantiles as Q


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 20_000
    hot = np.where(rng.random(n) < 0.35, 7.0, rng.normal(7, 3, n))          # one value holds a third of the rows
    data = {"hot": hot, "skew": rng.exponential(50, n), "few": rng.integers(0, 3, n).astype(float)}
    rows = [tuple(float(data[c][i]) for c in data) for i in range(n)]
    return spark.createDataFrame(rows, list(data)).repartition(6).cache(), data


@pytest.mark.parametrize("gather", [10**6, 500])
def test_quantiles_are_exact(table, gather, monkeypatch):
    df, data = table
    monkeypatch.setattr(Q, "GATHER_VALUES", gather)
    ps = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = Q.quantiles(df, {c: (f"`{c}`", ps) for c in data})
    for c, x in data.items():
        assert [got[c][p] for p in ps] == pytest.approx(list(np.quantile(x, ps)), abs=1e-12)


def test_order_statistics_with_a_small_gather_limit(table):
    df, data = table
    ranks = [0, 1, 5_000, 9_999, 12_345, 19_998, 19_999]
    got = Q.order_statistics(df, {c: (f"`{c}`", ranks) for c in data}, dict.fromkeys(data, 20_000), gather=10)
    for c, x in data.items():
        s = np.sort(x)
        assert [got[c][r] for r in ranks] == [s[r] for r in ranks]


def test_empty_column_has_no_quantiles(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert Q.quantiles(df, {"x": ("x", [0.5])}) == {"x": {0.5: None}}
