"""Families of physical Spark types, and the numeric view of a column used for statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.functions.names import q
from quern.functions.text import finite


def family(dtype: T.DataType) -> str:
    """text, integer, real, boolean, time or other."""
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "real"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def is_binary_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def as_double(name: str, fam: str) -> str:
    """Numeric SQL view of a column; booleans count as 0/1."""
    if fam == "boolean":
        return f"cast(cast({q(name)} AS int) AS double)"
    return f"cast({q(name)} AS double)"


def infinite_to_null(df: DataFrame) -> DataFrame:
    """PRF-14 / REC-1: NaN and +/-infinity in floating columns become NULL. One projection, nothing else changes."""
    if not any(is_binary_float(f.dataType) for f in df.schema.fields):
        return df
    return df.selectExpr(*[
        f"{finite(q(f.name))} AS {q(f.name)}" if is_binary_float(f.dataType) else q(f.name)
        for f in df.schema.fields
    ])
