"""Sums over pairs of columns against numpy and pandas."""
import numpy as np
import pandas as pd
import pytest

from quern.operators import gram as G
from quern.operators.profile import profile


def table(columns, rows=400, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=rows)
    frame = pd.DataFrame({f"c{i}": base * (i % 3) + draw.normal(size=rows) + 1e6 * (i == 1) for i in range(columns)})
    for i in range(0, columns, 2):
        frame.loc[draw.random(rows) < 0.1 + 0.3 * (i % 4 == 0), f"c{i}"] = np.nan
    frame.loc[frame["c0"].isna(), "c2"] = np.nan
    return frame


def nulls(spark, frame):
    return spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in frame.itertuples(index=False)], ", ".join(f"{c} double" for c in frame)).repartition(5)


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_correlations_and_gaps(spark, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK", block)
    frame = table(6)
    f = profile(nulls(spark, frame), duplicates=False, samples=False)
    want = frame.corr()
    for a in frame:
        for b in frame:
            if a < b:
                assert f.correlation[(a, b)] == pytest.approx(want.loc[a, b], abs=6e-4)
    gaps = frame.isna().astype(float).corr()
    assert {(p.feature_a, p.feature_b): round(p.strength, 9) for p in f.missing_pairs} == {
        (a, b): round(gaps.loc[a, b], 9) for a in frame for b in frame if a < b and gaps.loc[a, b] >= 0.5}
    assert f.columns["c1"].std == pytest.approx(frame["c1"].std()) and f.columns["c3"].skewness == pytest.approx(frame["c3"].skew())
    assert f.columns["c0"].kurtosis == pytest.approx(frame["c0"].kurt())


def jobs_of(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"group {np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, group)
    work()
    return len(tracker.getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_pairs(spark):
    few, many = (nulls(spark, table(k, rows=60)).cache() for k in (5, 200))
    exprs = lambda k: [f"c{i}" for i in range(k)]
    few.count(), many.count()
    counts = [jobs_of(spark, lambda: G.gram(df, exprs(k), exprs(k))) for df, k in ((few, 5), (many, 200))]  # noqa: B023
    assert counts[0] == counts[1] <= 4


def test_no_rows_no_columns(spark):
    empty = spark.createDataFrame([], "a double, b double")
    found = G.gram(empty, ["a", "b"], ["a"])
    assert not found.products.any() and not found.gaps.any() and G.pearson(found, ["a", "b"]) == {}
    assert profile(spark.createDataFrame([(None, None)], "a double, b string")).correlation == {}
