"""Equal rows found in two steps, ranks and splits without a task that sees a group."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import duplicates as D
from quern.operators.grouped_prep import split
from quern.operators.ranks import ranked


def rows(n=900):
    draw = random.Random(2)
    out = [(i, draw.choice(["a", "b", None]), draw.choice([0.5, -0.0, None])) for i in range(n)]
    return out + [(1, None, None)] * 5 + [(3, "x", 0.0), (3, "x", -0.0)] + [(7, "hot", 1.0)] * 400 + out[:40]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame(rows(), "k int, s string, v double").repartition(6)


def as_key(r):
    return tuple(x + 0.0 if isinstance(x, float) else x for x in r)


def test_distinct_rows(repeated):
    got = [as_key(r) for r in D.distinct_rows(repeated).collect()]
    assert Counter(got) == Counter({as_key(r) for r in rows()})


@pytest.mark.parametrize("most", [1 << 15, D.MOST_BITS])
def test_only_rows_that_may_repeat_are_shuffled(repeated, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_BITS", most)
    once, rest = D.Repeats(repeated).parts(repeated)
    left = Counter(as_key(r) for r in repeated.collect())
    assert once.count() > 0.9 * sum(n == 1 for n in left.values())
    assert not {as_key(r) for r in once.collect()} & {r for r, n in left.items() if n > 1}
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_no_repeats_no_shuffle(spark):
    df = spark.range(500).selectExpr("id", "cast(id AS string) AS s")
    assert D.Repeats(df).maps is None and D.distinct_rows(df) is df
    assert D.distinct_rows(df.where("false")).count() == 0


def test_numbered_copies(repeated, monkeypatch):
    monkeypatch.setattr(D, "RUN", 30)
    got = D.numbered_copies(repeated, "to_json(struct(*))", "__i").collect()
    assert len(got) == len(rows()) == len({r["__i"] for r in got})
    hot = sorted(int(r["__i"].rsplit("#", 1)[1]) for r in got if r.s == "hot")
    assert hot == list(range(1, 401))


def test_ranks(spark):
    frame = spark.createDataFrame([("a", 5)] * 300 + [(None, i) for i in range(20)] + [("b", i % 4) for i in range(50)], "g string, v int")
    got = ranked(frame, ["g"], [F.col("v").desc()], numbered=True).collect()
    for number, g in enumerate((None, "a", "b")):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and {(r["size"], r["number"]) for r in mine} == {(len(mine), number)}
        assert [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)


def test_split_of_5000_classes_one_of_them_a_third(spark):
    df = spark.range(30000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', cast(id % 5000 AS string)) END AS y")
    train, test = split(df, "y", row_id="id")
    size = Counter(r.y for r in df.collect())
    got = Counter(r.y for r in test.collect())
    exact = {y: 6000 * n / 30000 for y, n in size.items()}
    assert len(size) > 4900 and sum(got.values()) == 6000 and train.count() == 24000
    assert all(int(exact[y]) <= got[y] <= int(exact[y]) + 1 for y in size) and got["hot"] in (2000, 2001)
    again = split(df.repartition(7), "y", row_id="id")[1]
    assert {r.id for r in again.collect()} == {r.id for r in test.collect()}
