"""Sources, sinks, jobs, streams, target analysis, contracts, charts and diffs."""
import json

import pytest
from pyspark.sql import functions as F

from quern.functions.names import safe_names, unique_headers
from quern.operators import charts, contracts, diff, target
from quern.operators.inference import infer
from quern.operators.profile import profile
from quern.operators.recipe import Recipe
from quern.operators.repair import RepairPlanner
from quern.plans import jobs
from quern.sources import scan as S
from quern.sources import sinks
from quern.streaming import apply as stream


def test_headers():
    names = unique_headers(["a", "a ", "a_1", "", None, "A"])
    assert len({n.lower() for n in names}) == 6 and names[:2] == ["a", "a_1"] and names[3:5] == ["feature_3", "feature_4"]
    assert safe_names(["col 1!", "col_1", "col-1?", "123 numeric", "??"]) == ["col_1", "col_1_2", "col_1_3", "123_numeric", "col_4"]
    assert safe_names(["flag_yes", "flag_Yes", "FLAG_YES"]) == ["flag_yes", "flag_Yes_2", "FLAG_YES_3"]


@pytest.mark.parametrize("lines,mark", [
    (["a,b", "1,2"], ","), (["a\tb\tc", "1\t2\t3"], "\t"), (["a;b", "1,5;2,5"], ";"), (["a|b", "x|y"], "|"), (["abc"], ","),
    (['a,b', '"x;y;z",2'], ",")])
def test_delimiter(lines, mark):
    assert S.best_delimiter(lines) == mark


def put(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(content.encode(encoding))
    return str(path)


def test_csv_types_short_and_long_rows(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'id, name ,name,ok,x\n1,"a,b",p,True,1.5\n2,c,q,False,NA\n3,d\n4,e,f,True,2,EXTRA\n5,"g ""h""",r,,7\n')
    df, meta = S.scan(spark, path)
    assert df.columns == ["id", "name", "name_1", "ok", "x"] and dict(df.dtypes)["x"] == "double" and dict(df.dtypes)["ok"] == "boolean"
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "a,b", "p", True, 1.5), (2, "c", "q", False, None), (3, "d", None, None, None), (5, 'g "h"', "r", None, 7.0)]
    assert (meta.detected_delimiter, meta.format, meta.rows, meta.columns) == (",", "csv", 4, 5)


def test_semicolons_tabs_and_encodings(spark, tmp_path):
    df, meta = S.scan(spark, put(tmp_path, "t.txt", "ville;n\nGenève;1\nZürich;2\n", "cp1252"))
    assert meta.detected_encoding == "cp1252" and sorted(r[0] for r in df.collect()) == ["Genève", "Zürich"]
    df, meta = S.scan(spark, put(tmp_path, "t.tsv", "a\tb\n1\tx,y\n"))
    assert meta.format == "tsv" and df.first()["b"] == "x,y"
    df, meta = S.scan(spark, put(tmp_path, "long.csv", "a,b\n" + "é" * 4094 + "x,1\n" + "é,2\n"))
    assert meta.detected_encoding == "utf-8"


def test_empty_file_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        S.scan(spark, put(tmp_path, "t.csv", "a,b\n"))


@pytest.mark.parametrize("name,text", [
    ("a.json", '[{"a": 1, "b": {"x": 2, "y": {"z": "q"}}, "t": [1, 2]}, {"a": 3, "b": {"x": 4, "y": {"z": "r"}}, "t": []}]'),
    ("b.json", '{"records": [\n{"a": 1, "b": {"x": 2, "y": {"z": "q"}}, "t": [1, 2]},\n {"a": 3, "b": {"x": 4, "y": {"z": "r"}}, "t": []}]}'),
    ("c.jsonl", '{"a": 1, "b": {"x": 2, "y": {"z": "q"}}, "t": [1, 2]}\n{"a": 3, "b": {"x": 4, "y": {"z": "r"}}, "t": []}\n')])
def test_json_shapes(spark, tmp_path, name, text):
    df, _ = S.scan(spark, put(tmp_path, name, text))
    assert df.columns == ["a", "b.x", "b.y.z", "t"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, "q", "[1,2]"), (3, 4, "r", "[]")]


def test_bad_json(spark, tmp_path):
    with pytest.raises(ValueError):
        S.scan(spark, put(tmp_path, "a.json", "not json at all"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], ["x y", "t"])
    for ext in ("csv", "parquet"):
        sinks.write(df, str(tmp_path / f"out.{ext}"))
        assert S.scan(spark, str(tmp_path / f"out.{ext}"))[0].count() == 2
    with pytest.raises(ValueError):
        sinks.write(df.select(), str(tmp_path / "z.csv"))
    with pytest.raises(ValueError):
        sinks.output_format("a.xyz")
    p = sinks.preview(spark.range(100).selectExpr("id", "timestamp_ntz'2020-01-01' AS d"), "id").collect()
    assert len(p) == 50 and p[0]["d"].startswith("2020-01-01T")
    f = profile(df)
    assert sinks.summary_overview(df, f).count() == 4


DIRTY = "id,price,flag,city,age\n" + "".join(
    f"{i},\"${1 + i % 9},{i % 1000:03d}\",{['Yes', ' no'][i % 2]},{['Paris', 'paris', 'Rome'][i % 3]},{-999 if i % 20 == 0 else 20 + i % 40}\n"
    for i in range(200))


def test_jobs(spark, tmp_path, capsys):
    path = put(tmp_path, "in.csv", DIRTY)
    assert jobs.main(["audit", path, "-o", str(tmp_path / "report")], spark) == 0
    text = capsys.readouterr().out
    assert "R-QLT-03" in text and "grade" in text
    summary = json.loads(spark.read.text(str(tmp_path / "report" / "summary")).first()[0])
    assert summary["repairs"] and summary["metadata"]["rows"] == 200
    assert jobs.main(["clean", path, "-o", str(tmp_path / "clean.parquet"), "--target", "flag"], spark) == 0
    out = spark.read.parquet(str(tmp_path / "clean.parquet"))
    assert out.columns[-1] == "flag" and out.count() > 0
    assert jobs.main(["clean", path, "-o", str(tmp_path / "x.unknown")], spark) == 1
    assert jobs.main(["audit", path, "--no-repair"], spark) == 0


def test_streams_match_tables(spark, tmp_path):
    table = spark.createDataFrame([(f"${i % 9},{i:03d}" if i % 7 else "?", [" a", "A", "a"][i % 3], float(i % 11)) for i in range(60)],
                                  "p string, c string, x double")
    src = str(tmp_path / "src")
    table.write.parquet(src)
    plan = RepairPlanner().fit(table)
    fixed = plan.transform(table)
    f = profile(fixed)
    model = Recipe().fit(fixed, f, infer(spark, f))
    live = spark.readStream.schema(table.schema).parquet(src)
    for name, out, want in (("s1", stream.repair_stream(live, plan), fixed),
                            ("s2", stream.recipe_stream(live, model, plan), model.transform(fixed, rows=False))):
        run = out.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, want.collect()))
    good, bad = stream.contract_stream(live, contracts.infer_constraints(profile(table.where("p <> '?'"))))
    assert good.isStreaming and bad.isStreaming


def test_target(spark):
    df = spark.createDataFrame([(1 if i % 10 == 0 else 0, float(i), 2.0 * (i % 10 == 0), "ab"[i % 2]) for i in range(100)],
                               "y int, x double, leak double, c string")
    a = target.analyze_target(df, "y")
    assert (a.task, a.severity, a.minority_pct) == ("binary_classification", "MODERATE", 10.0)
    assert {f["feature"] for f in a.features if f["leakage_risk"]} == {"leak"} and a.features[0]["feature"] == "leak"
    assert target.analyze_target(df, "x").task == "regression"
    for bad in ("nope",):
        with pytest.raises(ValueError):
            target.analyze_target(df, bad)
    with pytest.raises(ValueError):
        target.analyze_target(df.withColumn("k", F.lit(1)), "k")


def test_contracts(spark):
    good = spark.createDataFrame([(i, float(i), "ab"[i % 2]) for i in range(60)], "n int, x double, c string")
    rules = contracts.infer_constraints(profile(good))
    assert contracts.validate(good, rules).count() == 60
    bad = spark.createDataFrame([("1", 1e9, "z"), ("q", None, "a")], "n string, x double, c string")
    found = {(r["column"], r["check"]): r["violations"] for r in contracts.violations_df(bad, rules).collect()}
    assert found[("c", "isin")] == 1 and found[("x", "max")] == 1 and found[("x", "not_null")] == 1 and found[("n", "type")] == 1
    assert contracts.failing_rows(bad, rules).count() == 2
    with pytest.raises(contracts.ContractViolation):
        contracts.validate(bad, rules)


def test_missingness_slices_agree(spark, tmp_path):
    spark.range(1000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE id END AS x").write.parquet(str(tmp_path / "m"))
    df = spark.read.parquet(str(tmp_path / "m"))
    keyed = charts.missingness_grid(df, 60, "id").orderBy("row_start").collect()
    assert len(keyed) == 63 and keyed[-1]["row_end"] == 1000
    far = df.selectExpr("9007199254740992 + id AS id", "x")   # keys that doubles cannot tell apart
    assert [tuple(r) for r in charts.missingness_grid(far, 60, "id").drop("id").orderBy("row_start").collect()] == [(r["row_start"], r["row_end"], r["x"]) for r in keyed]
    named = df.selectExpr("lpad(cast(id AS string), 9, '0') AS id", "x")
    assert [tuple(r) for r in charts.missingness_grid(named, 60, "id").drop("id").orderBy("row_start").collect()] == [(r["row_start"], r["row_end"], r["x"]) for r in keyed]
    by_position = charts.missingness_grid(df, 60).agg(F.sum(F.col("row_end") - F.col("row_start")), F.count("*")).first()
    assert tuple(by_position) == (1000, 63)


def test_diff(spark):
    raw = spark.createDataFrame([(1, None, "a", 1.0), (2, 5.0, "b", 2.0), (3, 6.0, "", 3.0)], "k int, x double, t string, gone double")
    new = spark.createDataFrame([(1, 4.0, "a", 1), (2, 5.00001, "c", 1), (3, 7.0, "z", 0)], "k int, x double, t string, n int")
    got = {(r["row_key"], r["column"]): r["status"] for r in diff.cell_status(raw, new, "k").collect()}
    assert got == {(1, "x"): "imputed", (2, "x"): "normal", (3, "x"): "modified", (1, "t"): "normal", (2, "t"): "modified",
                   (3, "t"): "imputed", (1, "n"): "new", (2, "n"): "new", (3, "n"): "new"}
    kinds = {r["column"]: r["change"] for r in diff.column_diff(raw, new).collect()}
    assert kinds == {"k": "kept", "x": "kept", "t": "kept", "gone": "dropped", "n": "created"}
    assert diff.search_rows(new, "C").count() == 1
