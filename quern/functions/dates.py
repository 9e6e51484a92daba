"""Date text -> TIMESTAMP_NTZ, and calendar features. Wall-clock types keep results independent of the session zone."""

from __future__ import annotations

import math

from quern.functions.names import text
from quern.functions.text import strip

# The shapes that count as a date, anchored at the start of the trimmed text.
DATE_SHAPE = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
DMY = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})(?!\d)(.*)$"
# The same shapes and year-first ones as alternatives of one pattern; the last takes any other text. Groups that took no part are empty.
YEAR_FIRST = r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)(.*)$"
YEAR_LAST = r"[-/.](\d{2}|\d{4})(?!\d)(.*)$"
MONTH_FIRST = (rf"^(?:{YEAR_FIRST}|(\d{{1,2}})[-/.](\d{{1,2}}){YEAR_LAST}|(?s:.*))", "$1$7-$2$5-$3$6$4$8")
DAY_FIRST = (rf"^(?:{YEAR_FIRST}|(\d{{1,2}})[-/.](1[3-9]|[2-9]\d){YEAR_LAST}|(\d{{1,2}})[-/.](\d{{1,2}}){YEAR_LAST}|(?s:.*))",
             "$1$7$11-$2$5$10-$3$6$9$4$8$12")
OFFSET = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$"


def _starts_with_digit(s: str) -> str:
    return f"{s} >= '0' AND {s} < ':'"


def looks_like_date(s: str) -> str:
    """On trimmed text. A byte comparison rejects text that does not start with a digit before the pattern runs."""
    return (f"(CASE WHEN {_starts_with_digit(s)} THEN {s} RLIKE {text(DATE_SHAPE)} "
            f"WHEN {s} IS NOT NULL THEN false END)")


def first_field(s: str) -> str:
    """First number of a trimmed d/m/y-shaped value, NULL for other shapes. A column maximum above 12 means
    day-first."""
    return (f"CASE WHEN {_starts_with_digit(s)} AND NOT (substring({s}, 2, 1) BETWEEN '0' AND '9' "
            f"AND substring({s}, 3, 1) BETWEEN '0' AND '9') "
            f"THEN try_cast(nullif(regexp_extract({s}, {text(DMY)}, 1), '') AS int) END")


def offset_minutes(c: str) -> str:
    """UTC offset written in the text, in minutes; NULL when there is none."""
    found = f"replace(replace(regexp_extract({c}, {text(OFFSET)}, 1), 'Z', '+0000'), ':', '')"   # hours x 100 + minutes
    clock = f"try_cast({found} AS int)"
    return f"(CASE WHEN contains({c}, ':') THEN cast({clock} - {clock} div 100 * 40 AS int) END)"


def parse_date(c: str, day_first: bool = False, to_utc: bool = False) -> str:
    """ISO-like text is always read year-first. d/m/y text follows `day_first`, unless its second field can only be a
    day. `to_utc` shifts values that carry an offset to UTC (for columns that mix offsets). Bad text becomes NULL."""
    s = strip(c)
    shape, order = DAY_FIRST if day_first else MONTH_FIRST
    # each call nests in the next, so a text is matched once: to y-m-d and the rest, then a year of two digits gets its century
    iso = f"regexp_replace({s}, {text(shape)}, {text(order)})"
    for years, century in (("[0-5]\\d|6[0-8]", "20"), ("\\d\\d", "19")):
        iso = f"regexp_replace({iso}, {text(f'^(?=(?:{years})-)')}, '{century}')"
    wall = f"try_cast({iso} AS timestamp_ntz)"
    if to_utc:
        return f"({wall} - make_interval(0, 0, 0, 0, 0, coalesce({offset_minutes(s)}, 0), 0))"
    return wall


def calendar_parts(ts: str, name: str, has_time: bool) -> list[tuple[str, str]]:
    """(feature name, SQL) for one timestamp expression. NULL dates read as 1 January 2000, a Monday, at midnight."""
    month = f"coalesce(month({ts}), 1)"
    parts = [
        (f"{name}_year", f"coalesce(year({ts}), 2000)"),
        (f"{name}_month", month),
        (f"{name}_day", f"coalesce(dayofmonth({ts}), 1)"),
        (f"{name}_dayofweek", f"coalesce(weekday({ts}), 0)"),
        (f"{name}_is_weekend", f"cast(coalesce(weekday({ts}), 0) >= 5 AS int)"),
        (f"{name}_sin_month", f"sin(double('{2 * math.pi!r}') * {month} / double('12'))"),
        (f"{name}_cos_month", f"cos(double('{2 * math.pi!r}') * {month} / double('12'))"),
    ]
    if has_time:
        hour = f"coalesce(hour({ts}), 0)"
        parts += [
            (f"{name}_hour", hour),
            (f"{name}_sin_hour", f"sin(double('{2 * math.pi!r}') * {hour} / double('24'))"),
            (f"{name}_cos_hour", f"cos(double('{2 * math.pi!r}') * {hour} / double('24'))"),
            (f"{name}_is_night", f"cast({hour} < 6 OR {hour} > 20 AS int)"),
            (f"{name}_minute", f"coalesce(minute({ts}), 0)"),
        ]
    return parts
