import math

import numpy as np
import pytest

from quern.operators.grouped_prep import GroupPipeline, class_quotas, group_columns, split
from quern.operators.inference import infer
from quern.operators.knn import KnnFill
from quern.operators.power import bend, fit_lambdas
from quern.operators.profile import profile
from quern.operators.recipe import Override, Recipe, run_recipe
from quern.sources.samples import sample_dataset


def nulls(df):
    return sum(r is None for row in df.collect() for r in row)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    rows = [(f"U{i:04d}", None if i % 5 == 0 else float(30 + 5 * rng.normal()), float(rng.exponential(1000)),
             "AB"[i % 2], ["red", "green", "blue", "teal"][i % 4]) for i in range(100)]
    df = spark.createDataFrame(rows, "id_col string, age double, income double, city string, category string")
    f = profile(df)
    return df, f, infer(spark, f)


@pytest.mark.parametrize("name", ["titanic", "telecom", "sensors"])
def test_no_missing_cells_after_cleaning(spark, name):
    df = sample_dataset(spark, name)
    f = profile(df)
    out, model = run_recipe(df, f, infer(spark, f))
    assert nulls(out) == 0 and not [c for c, t in out.dtypes if t == "string" and c != "Cabin"]
    assert model.log


def test_one_hot_names_and_order(people):
    df, f, inf = people
    out, _ = run_recipe(df, f, inf)
    assert out.columns[-3:] == ["category_green", "category_red", "category_teal"] and "id_col" not in out.columns
    assert "age_was_missing" in out.columns


def test_overrides(people):
    df, f, inf = people
    out, model = run_recipe(df, f, inf, Recipe({
        "id_col": {"drop": False, "encoding": "none"}, "age": {"imputation": "constant", "impute_value": 40, "scaling": "none", "outliers": "none"},
        "income": {"scaling": "none", "outliers": "none"}, "city": {"encoding": "frequency"}, "category": {"encoding": "binary"}}))
    rows = out.collect()
    assert sum(r["age"] == 40.0 for r in rows) == 20 and {r["city"] for r in rows} == {0.5}
    assert {r["category"] for r in rows} == {0, 1, 2, 3} and "id_col" in out.columns
    assert any("instead of binary" in line for line in model.log)


def test_none_imputation_is_honoured(people):
    df, f, inf = people
    out, _ = run_recipe(df, f, inf, Recipe({"age": {"imputation": "none"}}))
    assert sum(r["age"] is None for r in out.collect()) == 20


def test_bad_overrides_are_rejected(people):
    df, f, inf = people
    with pytest.raises(ValueError):
        Override(imputation="guess")
    with pytest.raises(ValueError):
        Recipe({"city": {"imputation": "median"}}).fit(df, f, inf)
    with pytest.raises(ValueError):
        Recipe(target="nope").fit(df, f, inf)


def test_target_is_protected(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.normal()), "abc"[i % 3], None if i in (3, 70) else float(rng.exponential(50))) for i in range(150)]
    df = spark.createDataFrame(rows, "x1 double, cat string, y double")
    f = profile(df)
    out, _ = run_recipe(df, f, infer(spark, f), Recipe(target="y"))
    assert out.columns[-1] == "y" and out.count() == 148
    assert sorted(r["y"] for r in out.collect()) == sorted(r[2] for r in rows if r[2] is not None)


def test_pruning_never_empties_the_table(spark):
    df = spark.createDataFrame([("x",)] * 30, "only string")
    f = profile(df)
    out, model = run_recipe(df, f, infer(spark, f), Recipe(drop_duplicates=False))
    assert out.count() == 30 and any("skipped" in line for line in model.log)


def test_ordinal_keeps_its_order_with_a_missing_level(spark):
    df = spark.createDataFrame([(["low", "Medium", "high", None][i % 4], i) for i in range(40)], "level string, i int")
    f = profile(df)
    out, _ = run_recipe(df, f, infer(spark, f), Recipe({"i": Override(drop=False, scaling="none")}))
    assert {(r["i"] % 4, r["level"]) for r in out.collect()} == {(0, 0), (1, 1), (2, 2), (3, -1)}


def test_model_on_new_data(people, spark):
    df, f, inf = people
    model = Recipe(drop_duplicates=False).fit(df, f, inf)
    new = spark.createDataFrame([("Z", None, None, "A", "violet")], df.schema)
    row = model.transform(new).first()
    assert None not in tuple(row) and (row["category_green"], row["category_red"], row["category_teal"]) == (0, 0, 0)


def test_case_insensitive_one_hot_names(spark):
    df = spark.createDataFrame([(["no", "Yes", "yes"][i % 3],) for i in range(30)], "flag string")
    out = Recipe({"flag": {"encoding": "onehot"}}, drop_duplicates=False).fit(df).transform(df)
    assert len({c.lower() for c in out.columns}) == len(out.columns) == 2


# ---------------------------------------------------------------- nearest neighbours

def brute(rows, j, k=5):
    x = np.array([[np.nan if v is None else v for v in r] for r in rows])
    donors = np.flatnonzero(~np.isnan(x[:, j]))
    out = {}
    for i in np.flatnonzero(np.isnan(x[:, j])):
        gap = (x[donors] - x[i]) ** 2
        shared = (~np.isnan(gap)).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(shared > 0, np.sqrt(x.shape[1] / shared * np.nansum(gap, axis=1)), np.inf)
        ok = np.flatnonzero(np.isfinite(d))
        near = ok[np.lexsort((x[donors[ok], j], d[ok]))][:k]
        out[i] = x[donors[near], j].mean() if len(near) else x[donors, j].mean()
    return out


@pytest.mark.parametrize("cell_rows,block", [(10_000, 50_000), (20, 50_000), (20, 15)])
def test_knn_is_exact(spark, monkeypatch, cell_rows, block):
    import quern.operators.knn as K
    monkeypatch.setattr(K, "BLOCK_DONORS", block)
    monkeypatch.setattr(K, "BLOCK_ROWS", 25)
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        wide = 5.0 if rng.random() < 0.35 else float(rng.normal(0, 40))       # a third share one cell value
        rows.append([None if rng.random() < 0.05 else wide, float(rng.integers(0, 6)),
                     None if rng.random() < 0.2 else float(rng.normal(10, 3))])
    rows += [list(r) for r in rows[:40]]                                      # exact copies
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double").repartition(5)
    fill = KnnFill.fit(df, ["c"], ["a", "b", "c"], cell_rows=cell_rows)
    got = {r["i"]: r["c"] for r in fill(df).collect()}
    want = brute(rows, 2)
    assert len(got) == len(rows) and want
    for i, v in want.items():
        assert got[i] == pytest.approx(v, abs=1e-9)
    assert all(got[i] == r[2] for i, r in enumerate(rows) if r[2] is not None)


@pytest.mark.parametrize("power", [14.0, -9.0, 45.0])
def test_exponents_far_from_zero(spark, power):
    draw = np.random.default_rng(3)
    x = draw.normal(10, 1, 3000) ** (1 / power) * (3.0 if power > 0 else 1e3) - 1
    x = x[x > 0]
    def likelihood(lam):
        t = np.expm1(lam * (np.log1p(x) - np.log1p(x).mean())) / lam
        return -len(x) / 2 * (np.log(t.var()) + 2 * lam * np.log1p(x).mean()) + (lam - 1) * np.log1p(x).sum()
    lam = fit_lambdas(spark.createDataFrame([(float(v),) for v in x], "x double"), {"x": "x"})["x"]
    assert abs(lam) > 2.5 and abs(lam - power) < 0.35 * abs(power)
    assert likelihood(lam) >= max(likelihood(lam * (1 + s)) for s in (-0.1, -0.01, -0.001, 0.001, 0.01, 0.1)) - 1e-9 * abs(likelihood(lam))


def test_yeo_johnson_maximises_the_likelihood(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.exponential(20, 400) - 5, rng.normal(0, 1, 100)])
    lam = fit_lambdas(spark.createDataFrame([(float(v),) for v in x], "x double"), {"x": "x"})["x"]

    def score(g):
        y = np.array([bend(v, g) for v in x])
        return -len(x) / 2 * math.log(y.var()) + (g - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
    grid = np.linspace(-2, 3, 2001)
    assert lam == pytest.approx(grid[np.argmax([score(g) for g in grid])], abs=5e-3)


# ---------------------------------------------------------------- leakage-safe preparation

@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 9 == 0 else float(rng.normal()), float(rng.exponential(9)), "abcde"[i % 5], f"{1 + i % 28:02d}/01/2020",
             "rare" if i % 10 == 0 else "often") for i in range(100)]
    df = spark.createDataFrame(rows, "row_key int, num double, skewed double, cat string, day string, label string")
    f = profile(df)
    return df, f, infer(spark, f)


def test_split_is_exact_disjoint_and_stratified(labelled):
    df, _, _ = labelled
    train, test = split(df, "label", row_id="row_key")
    a, b = [r["row_key"] for r in train.collect()], [r["row_key"] for r in test.collect()]
    assert (len(a), len(b)) == (80, 20) and sorted(a + b) == list(range(100))
    assert test.where("label = 'rare'").count() == 2
    again = split(df.repartition(7), "label", row_id="row_key")[1]
    assert sorted(r["row_key"] for r in again.collect()) == sorted(b)


def test_split_without_stratification(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "i int, y double")
    assert split(df, "y", row_id="i")[1].count() == 21
    lone = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "i int, y string")
    assert split(lone, "y")[1].count() == 4


def test_quotas_sum_up(spark):
    made = class_quotas(spark.createDataFrame([("a", 7), ("b", 7), ("c", 6)], "y string, size long"), 20, 4)
    assert {r.y: r.quota for r in made.collect()} == {"a": 2, "b": 1, "c": 1}


def test_statistics_come_from_training_rows(labelled):
    df, f, inf = labelled
    plan = GroupPipeline(f, inf, "label")
    train, test, model = plan.clean_and_transform(df, row_id=None)
    raw_train, _ = split(plan.prepare(df), "label")
    x = np.array([r["num"] for r in raw_train.collect() if r["num"] is not None])
    filled = [(r["num"] if r["num"] is not None else x.mean()) for r in raw_train.collect()]
    want = sorted((np.array(filled) - np.mean(filled)) / np.std(filled))
    assert sorted(r["num"] for r in train.collect()) == pytest.approx(want)
    assert train.columns == test.columns and train.columns[-1] == "label" and nulls(test) == 0
    assert {r["num_was_missing"] for r in train.collect()} == {0, 1}


def test_unseen_category_is_all_zero(labelled, spark):
    df, f, inf = labelled
    plan = GroupPipeline(f, inf, "label")
    model = plan.fit(plan.prepare(df))
    new = spark.createDataFrame([(1, 0.0, 1.0, "zzz", "01/01/2020", "often")], df.schema)
    row = model.transform(plan.prepare(new)).first()
    assert [row[c] for c in row.__fields__ if c.startswith("cat_")] == [0, 0, 0, 0]


def test_every_column_is_in_one_group(labelled):
    _, f, inf = labelled
    g = vars(group_columns(f, inf, "label"))
    assert sorted(sum(g.values(), [])) == sorted(c for c in f.columns if c != "label")
