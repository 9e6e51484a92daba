"""Date texts are matched once, in projections and in the profile's aggregates."""
import datetime

from quern.functions.dates import offset_minutes, parse_date
from quern.functions.text import strip
from quern.operators import profile as P

TEXTS = [
    ("2024-3-05", "2024-03-05", "2024-03-05"), (" 2024/03/05 10:20\n", "2024-03-05 10:20", "2024-03-05 10:20"), ("5.3.24", "2024-05-03", "2024-03-05"),
    ("5.3.69", "1969-05-03", "1969-03-05"), ("5.3.068", None, None), ("03/25/2024", "2024-03-25", "2024-03-25"), ("25/03/2024", None, "2024-03-25"),
    ("1/2/20245", None, None), ("2024", None, None), ("20-1-", None, None), ("", None, None), (None, None, None), ("2024-02-30", None, None), ("x2024-02-03", None, None),
]


def test_every_text_is_matched_once(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "i int, x string")
    got = df.orderBy("i").selectExpr(f"{parse_date('x')} AS m", f"{parse_date('x', True)} AS d").collect()
    when = lambda t: None if t is None else datetime.datetime.fromisoformat(t)
    assert [(r.m, r.d) for r in got] == [(when(m), when(d)) for _, m, d in TEXTS]
    assert parse_date("x", True).count(strip("x")) == 1
    zones = spark.createDataFrame([("1:20 Z",), ("01:20:30.5+05:30",), ("01:20 -0330",), ("01:20",), ("1+05:30",), (None,)], "x string")
    assert [r[0] for r in zones.selectExpr(offset_minutes("x")).collect()] == [0, 330, -210, None, None, None]


def test_profile_aggregates_read_parsed_dates(spark, monkeypatch):
    asked, run = [], P.agg_row
    monkeypatch.setattr(P, "agg_row", lambda df, expressions: asked.extend(expressions) or run(df, expressions))
    df = spark.createDataFrame([(f"{d}/01/2024 10:20:00+0{d % 2}:00",) for d in range(1, 29)], "when_text string")
    c = P.profile(df).columns["when_text"]
    assert c.is_date_text and c.day_first and c.mixed_offsets and c.has_time
    assert (c.min_date, c.max_date) == ("2024-01-01 09:20:00", "2024-01-28 10:20:00")
    assert not [e for e in asked if "regexp" in e]
