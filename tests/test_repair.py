"""Each repair rule: when it fires, when it must not, and that replaying equals repairing."""
import pytest
from pyspark.sql import functions as F

from quern.functions.text import collapse, fold, number_layers, strip
from quern.operators import repair as R


def layers(df, column, steps):
    for step in steps:
        df = df.withColumn(column, F.expr(step(column)))
    return df


def fix(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    out, plan = R.repair(df.withColumn("at", F.monotonically_increasing_id()), "at")
    return df, out.drop("at"), plan


def fired(plan, column="c"):
    return [r.rule_id for r in plan.repairs if r.column == column]


def column(spark, values, kind="string"):
    df, out, plan = fix(spark, [(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["c"] for r in out.orderBy("i").collect()], plan


@pytest.mark.parametrize("text,number", [
    ("12", 12.0), ("1,234", 1234.0), ("1,234,567.5", 1234567.5), ("(50)", -50.0), ("(-5)", 5.0), ("$1,200", 1200.0),
    ("10%", 10.0), ("1e3", 1000.0), ("+.5", 0.5), ("5.", 5.0), (" € 7 ", 7.0), ("12,34", None), ("1d", None),
    ("1.5f", None), ("n5", None), ("inf", None), ("1e999", None), ("abc", None), ("--5", None), ("5%%", None), ("", None)])
def test_number_text(spark, text, number):
    df = layers(spark.createDataFrame([(text,)], "c string"), "c", number_layers())
    assert df.first()[0] == number


def test_whitespace_includes_no_break_space_and_tabs(spark):
    df = spark.createDataFrame([("  a\t b \n",)], "c string")
    row = df.selectExpr(strip("c"), collapse("c"), fold("'Straße'")).first()
    assert tuple(row) == ("a\t b", "a b", "strasse")


def test_placeholders_become_missing(spark):
    out, plan = column(spark, ["?", "N/A", "x", "y", "x", " none "])
    assert out == [None, None, "x", "y", "x", None]
    assert [r.params for r in plan.repairs if r.rule_id == "R-QLT-01"] == [{"tokens": ["?", "n/a", "none"]}]


def test_unknown_is_kept_when_it_dominates(spark):
    out, _ = column(spark, ["unknown"] * 5 + ["a", "a", "?"])
    assert out[:5] == ["unknown"] * 5 and out[-1] is None


def test_numbers_need_ninety_percent(spark):
    out, plan = column(spark, ["1", "2", "x", "4"])
    assert "R-QLT-03" not in fired(plan) and out == ["1", "2", "x", "4"]
    out, plan = column(spark, [str(i) for i in range(19)] + ["x"])
    assert "R-QLT-03" in fired(plan) and out[-1] is None and out[3] == 3.0


def test_leading_zeros_are_codes(spark):
    out, plan = column(spark, ["00123", "04567", "12345", "00001"])
    assert fired(plan) == [] and out[0] == "00123"


@pytest.mark.parametrize("values,codes", [
    (["Yes", "no", "YES", "No"], [1, 0, 1, 0]), (["y", "N", "n", "Y"], [1, 0, 0, 1]),
    (["True", "false", "true", None], [1, 0, 1, None]), (["t", "F", "f", "T"], [1, 0, 0, 1])])
def test_boolean_text(spark, values, codes):
    out, plan = column(spark, values)
    assert out == codes and fired(plan) == ["R-QLT-04"]


def test_one_sided_boolean_is_left_alone(spark):
    out, plan = column(spark, ["yes"] * 6)
    assert "R-QLT-04" not in fired(plan) and out == ["yes"] * 6


def test_labels_merge_into_most_frequent_spelling(spark):
    out, plan = column(spark, ["Paris", "paris", "Paris", "PARIS ", "Rome", "Rome", "ro  me", "Rome"] * 2)
    assert out == (["Paris"] * 4 + ["Rome", "Rome", "ro me", "Rome"]) * 2
    assert next(r for r in plan.repairs if r.rule_id == "R-QLT-05").params["mapping"] == {"PARIS": "Paris", "paris": "Paris"}


def test_tied_spellings_go_to_the_first_seen(spark):
    out, _ = column(spark, ["b", "B", "B", "b", "z", "z", "z", "z"])
    assert out[:4] == ["b"] * 4


def test_unique_text_is_not_merged(spark):
    out, plan = column(spark, ["Ab", "aB", "c", "d"])
    assert fired(plan) == [] and out == ["Ab", "aB", "c", "d"]


def test_large_label_maps_are_joined(spark, monkeypatch):
    monkeypatch.setattr(R, "LITERAL_LABELS", 1)
    values = ["Paris", "paris", "Paris", "PARIS", None, "Rome", "rome", "Rome", "Rome"]
    out, plan = column(spark, values * 2)
    assert plan.label_maps and out == (["Paris"] * 4 + [None] + ["Rome"] * 4) * 2


def test_infinite_and_sentinel_numbers(spark):
    out, plan = column(spark, [1.0, float("inf"), 2.0, float("-inf"), 3.0], "double")
    assert out == [1.0, None, 2.0, None, 3.0] and fired(plan) == ["R-QLT-06"]
    out, plan = column(spark, [20 + i % 10 for i in range(95)] + [-999] * 5, "int")
    assert fired(plan) == ["R-QLT-02"] and out[-5:] == [None] * 5


def test_sentinel_guards(spark):
    assert fired(column(spark, list(range(990, 1010)) * 5, "int")[1]) == []                   # inside the range
    assert fired(column(spark, [-1] * 5 + [-50, -60] + [100] * 93, "int")[1]) == []           # other negatives exist
    assert fired(column(spark, [20 + i % 5 for i in range(299)] + [-999], "int")[1]) == []    # under 1 %
    assert fired(column(spark, [-999, -999, 5, 6], "int")[1]) == []                           # under 4 other values


def test_clean_data_is_unchanged(spark):
    df, out, plan = fix(spark, [(1, "a", 2.5), (2, "b", 3.5), (3, "a", 1.0), (4, "b", 0.5)], "i int, c string, x double")
    assert plan.repairs == [] and out.schema == df.schema and sorted(out.collect()) == sorted(df.collect())


def test_odd_column_names(spark):
    df = spark.createDataFrame([("?", "1"), ("a", "2"), ("a", "3")], ["b.x `q`", "é 'n'"])
    out, plan = R.repair(df)
    assert {r.column for r in plan.repairs} == {"b.x `q`", "é 'n'"} and out.columns == df.columns


def test_replay_skips_absent_columns_and_other_types(spark):
    _, _, plan = fix(spark, [(i, "$1,0%02d" % i) for i in range(12)], "i int, c string")
    assert plan.transform(spark.createDataFrame([(1,)], "i int")).columns == ["i"]
    assert plan.transform(spark.createDataFrame([(1, 7)], "i int, c int")).first()["c"] == 7


def test_examples_of_each_rule(spark, monkeypatch):
    df = spark.createDataFrame([(1, "  Yes "), (2, "No"), (3, " N/A"), (4, "yes"), (5, "no "), (6, None)], "k int, f string").repartition(3)
    found = {r.rule_id: r.examples for r in R.RepairPlanner("k").fit(df).repairs}
    assert found == {"R-QLT-07": [("  Yes ", "Yes"), (" N/A", "N/A"), ("no ", "no")], "R-QLT-01": [("N/A", None)],
                     "R-QLT-04": [("Yes", "1"), ("No", "0"), ("yes", "1")]}


def test_examples_of_joined_labels(spark, monkeypatch):
    monkeypatch.setattr(R, "LITERAL_LABELS", 1)
    rows = [(i, v) for i, v in enumerate(["Red ", "red", "Red", "Blue", "BLUE", "Blue", "green", "Red", "Blue", "green"] * 3)]
    plan = R.RepairPlanner("k").fit(spark.createDataFrame(rows, "k int, c string"))
    found = {r.rule_id: r.examples for r in plan.repairs}
    assert plan.label_maps and found == {"R-QLT-07": [("Red ", "Red")] * 3, "R-QLT-05": [("red", "Red"), ("BLUE", "Blue"), ("red", "Red")]}
