"""k-d cells of vectors with gaps: bounds hold, and they save comparisons."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import cells as C
from quern.operators.knn import KnnFill


def vectors(rows=6000, width=3, gaps=0.3, seed=4):
    draw = np.random.default_rng(seed)
    out = draw.normal(size=(rows, width)) * np.array([9.0, 5.0, 2.0])[:width]
    out[draw.random((rows, width)) < gaps] = np.nan
    out[: rows // 5] = [1.0, 2.0, 3.0][:width]     # a third of a kind
    return out


def distances(a, b):
    gap = a[:, None, :] - b[None, :, :]
    both = ~np.isnan(gap)
    with np.errstate(all="ignore"):
        return np.where(both.any(2), np.sqrt(a.shape[1] / both.sum(2) * np.where(both, gap * gap, 0).sum(2)), np.inf)


@pytest.fixture(scope="module")
def placed(spark):
    data = vectors()
    frame = spark.createDataFrame([([float(x) for x in v],) for v in data], "vec array<double>")
    return data, C.Cells(frame, 3, 150)


def test_every_vector_has_a_cell_and_bounds_hold(placed):
    data, cells = placed
    at = cells.tree.place(data)
    assert len(cells.sizes) > 20 and sum(cells.sizes.values()) == len(data)
    assert dict(zip(*np.unique(at, return_counts=True), strict=True)) == cells.sizes
    asking = vectors(200, seed=9)[60:]
    bound, exact = cells.bounds(asking), distances(asking, data)
    for i, cell in enumerate(cells.cells):
        assert (bound[:, i] <= exact[:, at == cell].min(axis=1) + 1e-9).all()


def test_mixed_cell_bound(spark):
    data = np.vstack([vectors(3000, gaps=0.0), [[np.nan, np.nan, 5.0]] * 3, [[np.nan, 2.0, np.nan]] * 2])
    frame = spark.createDataFrame([([float(x) for x in v],) for v in data], "vec array<double>")
    cells = C.Cells(frame, 3, 200)
    at = cells.tree.place(data)
    assert cells.sizes[C.MIXED] == 5 and (at[-5:] == C.MIXED).all()
    asking = vectors(50, seed=11)
    mixed = list(cells.cells).index(C.MIXED)
    assert (cells.bounds(asking)[:, mixed] <= distances(asking, data[-5:]).min(axis=1) + 1e-9).all()


def test_fewer_pairs_are_compared_where_features_are_missing(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = 5000
    a, b, c = draw.normal(size=rows) * 50, draw.normal(size=rows) * 20, draw.normal(size=rows)
    gone, lost = draw.random(rows) < 0.3, draw.random(rows) < 0.1
    table = [(None if g else float(x), float(y), None if m else float(z)) for x, y, z, g, m in zip(a, b, c, gone, lost, strict=True)]
    df = spark.createDataFrame(table, "a double, b double, c double").repartition(4).cache()
    visited = []
    search = KnnFill._search

    def counted(self, visits, donors, sizes):
        per = {r["visit"]: r["count"] for r in visits.groupBy("visit").count().collect()}
        visited.append(sum(n * sizes.get(v, 0) for v, n in per.items()))
        return search(self, visits, donors, sizes)

    monkeypatch.setattr(KnnFill, "_search", counted)
    fill = KnnFill.fit(df, ["c"], ["a", "b", "c"], cell_rows=100)
    asking = sum(r[2] is None for r in table)
    assert sum(visited) < 0.35 * asking * (rows - asking)
    got = {(r.a, r.b): r.c for r in fill(df).collect()}
    data = np.array([[np.nan if v is None else v for v in r] for r in table])
    known = data[~np.isnan(data[:, 2])]
    for row in data[np.isnan(data[:, 2])][:150]:
        d = distances(row[None, :], known)[0]
        near = np.lexsort((known[:, 2], d))[:5]
        assert got[(None if np.isnan(row[0]) else row[0], row[1])] == pytest.approx(known[near, 2].mean())


def test_no_donors(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "c double, a double")
    fill = KnnFill.fit(df, ["c"], ["a", "c"])
    assert [r.c for r in fill(df).select(F.col("c")).collect()] == [None, None]
