"""Column-name handling: quoting for SQL text, unique headers, and names safe for a database table."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame


def q(name: str) -> str:
    """Back-tick quoted column reference, safe for dots, spaces and quotes in the name."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float) -> str:
    """A Spark SQL double literal that round-trips exactly."""
    return f"double('{float(value)!r}')"


def take_name(wanted: str, taken: set[str], separator: str = "_", start: int = 1) -> str:
    """`wanted`, or `wanted` with the first free numeric suffix. Case-insensitive, as Spark resolves names."""
    name, n = wanted, start
    while name.lower() in taken:
        name, n = f"{wanted}{separator}{n}", n + 1
    taken.add(name.lower())
    return name


def unique_headers(headers: Iterable[object]) -> list[str]:
    """SRC-7: trimmed text headers; an empty one becomes feature_{i}; a repeated one gets _1, _2, ..."""
    taken: set[str] = set()
    out = []
    for i, header in enumerate(headers):
        name = "" if header is None else str(header).strip()
        out.append(take_name(name or f"feature_{i}", taken))
    return out


def safe_names(headers: Iterable[str]) -> list[str]:
    """SNK-3: letters, digits and underscores only; an empty result becomes col_{i}; repeats get _2, _3, ..."""
    taken: set[str] = set()
    out = []
    for i, header in enumerate(headers):
        base = re.sub(r"[^A-Za-z0-9_]+", "_", str(header)).strip("_") or f"col_{i}"
        out.append(take_name(base, taken, start=2))
    return out


def standardise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_headers(df.columns))


def sanitize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*safe_names(df.columns))
