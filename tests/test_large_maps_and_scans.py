"""Many values and classes, faulty text files, and cells that are not plain numbers."""
import pytest
from pyspark.sql import functions as F

from quern.operators import charts, diff, steps
from quern.operators.grouped_prep import split
from quern.operators.profile import duplicate_counts, profile
from quern.sources import scan as S


def put(tmp_path, name, content, encoding="utf-8"):
    (tmp_path / name).write_bytes(content.encode(encoding))
    return str(tmp_path / name)


def test_quoted_line_breaks(spark, tmp_path):
    df, meta = S.scan(spark, put(tmp_path, "t.csv", 'id,note\n1,"x\ny"\n2,"a ""q"", b"\n3,"p,\n\nq",extra\n4,z\n'))
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, 'a "q", b'), (4, "z")] and meta.rows == 3


def test_every_file_is_probed(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("a,b\n".encode() + "é,1\n".encode("cp1252"))
    (folder / "b.csv").write_bytes(b"a,b\n" + b"plain,2\n" * 3000)
    assert S.text_shape(spark, str(folder)).encoding == "cp1252"
    late = put(tmp_path, "late.csv", "a,b\n" + "x,1\n" * 5000) 
    with open(late, "ab") as out:
        out.write("Genève,2\n".encode("cp1252"))
    assert S.text_shape(spark, late).encoding == "cp1252"


def test_a_faulty_json_line_is_an_error_with_a_count(spark, tmp_path):
    with pytest.raises(ValueError, match="has 1 lines that are no JSON"):
        S.scan(spark, put(tmp_path, "t.jsonl", '{"a": 1}\n{"a": 2}\n{"a": oops\n{"a": 4}\n'))
    df, _ = S.scan(spark, put(tmp_path, "u.json", '[\n{"a": 1},\n{"a": 2}\n]\n'))
    assert sorted(r[0] for r in df.collect()) == [1, 2]


def test_nested_parquet_is_flattened(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.sql("SELECT 1 AS id, named_struct('x', 2) AS s, map('k', 'v') AS m").write.parquet(path)
    df, _ = S.scan(spark, path)
    assert df.columns == ["id", "s.x", "m"] and profile(df).rows == 1


def test_map_columns_have_fingerprints(spark):
    df = spark.sql("SELECT map('k', id % 2) AS m, 1 AS x FROM range(6)")
    assert duplicate_counts(df, []) == (4, 0)


def test_samples_are_the_first_values(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "CASE WHEN id >= 900 THEN id END AS late")
    c = profile(df).columns
    assert c["id"].samples == ["0", "1", "2", "3", "4"] and c["late"].samples == ["900", "901", "902", "903", "904"]


def test_charts_leave_out_what_is_no_number(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", float("inf"))], "k string, v double")
    r = charts.grouped(df, "k", "v").first()
    assert (r["count"], r["mean"], r["max"]) == (2, 2.0, 3.0)
    assert charts.scatter_points(df.withColumn("w", F.lit(1.0)), "v", "w").count() == 2


def test_cell_status_keeps_every_cleaned_row(spark):
    raw = spark.createDataFrame([(1, "a"), (None, "n"), (3, None)], "k int, v string")
    clean = spark.createDataFrame([(1, "b"), (None, "n"), (3, "x"), (9, "y")], "k int, v string")
    assert {(r.row_key, r.status) for r in diff.cell_status(raw, clean, "k").collect()} == {
        (1, "modified"), (None, "normal"), (3, "imputed"), (9, "new")}
    with pytest.raises(ValueError, match="not unique"):
        diff.cell_status(raw.union(raw), clean, "k")


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(9000).selectExpr("CASE WHEN id % 3 = 0 THEN 'v00007' WHEN id % 50 = 1 THEN NULL ELSE concat('v', lpad(cast(id % 3001 AS string), 5, '0')) END AS c")


def test_ranked_codes_of_many_values(spark, many):
    values = sorted({r[0] for r in many.collect() if r[0] is not None})
    code = {v: i for i, v in enumerate(values)}
    assert len(values) > steps.LITERAL_VALUES
    step = steps.ranked_codes(many, "c", "text")
    seen = many.withColumn("raw", F.col("c")).union(spark.createDataFrame([("zz", "zz")], "c string, raw string"))
    for r in step(seen).collect():
        assert r.c == (None if r.raw is None else code.get(r.raw, -1))


@pytest.mark.parametrize("grouped", [False, True])
def test_indicators_of_many_values_are_one_sparse_column(spark, many, monkeypatch, grouped):
    from quern.operators.grouped_prep import GroupPipeline, Groups
    from quern.operators.recipe import Recipe
    df = many.withColumn("raw", F.col("c"))
    values = sorted({r[0] for r in many.collect() if r[0] is not None})
    if grouped:
        model = GroupPipeline(None, None, groups=Groups(onehot=["c"], passthrough=["raw"])).fit(df.na.fill("zz", ["c"]))
        values, df = [*values, "zz"], df.na.fill("zz", ["c", "raw"])
    else:
        model = Recipe({"c": {"encoding": "onehot", "imputation": "none"}, "raw": {"encoding": "none", "imputation": "none"}}, drop_duplicates=False).fit(df)
    assert any("sparse" in line for line in model.log)
    place = {v: [i - 1] if i else [] for i, v in enumerate(values)}
    got = model.transform(df)
    assert "c" not in got.columns and got.count() == 9000
    for r in got.distinct().collect():
        assert r.c_onehot == place.get(r.raw, [])


def test_frequencies_of_many_values(many):
    from collections import Counter
    n = Counter(r[0] for r in many.collect() if r[0] is not None)
    total = sum(n.values())
    step = steps.frequency(many, "c", total, [], "text")
    assert isinstance(step, steps.ValueJoin) and "'v00007'" in step.hot
    for r in step(many.withColumn("raw", F.col("c"))).collect():
        assert r.c == pytest.approx(n[r.raw] / total if r.raw is not None else 0.0)


def test_split_with_many_classes_null_targets_and_equal_rows(spark):
    rows = [(f"c{i % 2001}",) for i in range(20010)] + [(None,)] * 7
    train, test = split(spark.createDataFrame(rows, "y string"), "y")
    left, right = (dict((r.y, r["count"]) for r in d.groupBy("y").count().collect()) for d in (train, test))
    assert None not in left | right and set(right.values()) == {2} and set(left.values()) == {8} and len(right) == 2001
    same = spark.createDataFrame([("ab"[i % 2], i % 4) for i in range(100)], "y string, x int")
    train, test = split(same, "y")
    assert (train.count(), test.count()) == (80, 20) and {r["count"] for r in test.groupBy("y").count().collect()} == {10}
