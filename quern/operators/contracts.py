"""CON-*: constraints learned from a profile, and validation of other tables against them."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.dates import parse_date
from quern.functions.names import double, q, text
from quern.functions.types import families
from quern.operators.facts import DatasetFacts, small_frame
from quern.operators.quantiles import agg_row

VALUE_SET = 15


@dataclass(frozen=True)
class Constraint:
    column: str
    kind: str            # type, not_null, min, max or isin
    expected: str
    predicate: str       # SQL that holds for a good cell; written over the raw column
    cast: str            # SQL of the coerced value


def infer_constraints(facts: DatasetFacts) -> list[Constraint]:
    """CON-1: the exact range of numbers and the full value set of columns with few values. Extra columns are allowed."""
    out = []
    for c in facts.columns.values():
        x = q(c.name)
        if c.semantic == "datetime":
            kind, cast = "timestamp", (parse_date(x, c.day_first, c.mixed_offsets) if c.is_date_text
                                       else f"try_cast({x} AS timestamp_ntz)")
        elif c.family == "integer" or c.semantic == "numerical_discrete":
            kind, cast = "bigint", f"try_cast({x} AS bigint)"
        elif c.family == "real":
            kind, cast = "double", f"try_cast({x} AS double)"
        elif c.family == "boolean":
            kind, cast = "boolean", f"try_cast({x} AS boolean)"
        else:
            kind, cast = "string", f"try_cast({x} AS string)"

        def add(name: str, expected: str, test: str) -> None:
            out.append(Constraint(c.name, name, expected, test, cast))
        add("type", kind, f"({x} IS NULL OR {cast} IS NOT NULL)")
        if not c.missing:
            add("not_null", "true", f"{x} IS NOT NULL")
        if c.has_numeric and c.family in ("integer", "real") and c.semantic.startswith("numerical"):
            add("min", repr(c.min), f"({cast} IS NULL OR {cast} >= {double(c.min)})")
            add("max", repr(c.max), f"({cast} IS NULL OR {cast} <= {double(c.max)})")
        elif c.family == "text" and c.semantic != "datetime" and 0 < c.unique <= VALUE_SET:
            values = sorted(v for v, _ in c.values)
            add("isin", ", ".join(values), f"({x} IS NULL OR {x} IN ({', '.join(text(v) for v in values)}))")
    return out


def violations_df(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """CON-2: failing cells per constraint, all constraints in one aggregate. An absent column fails once per row."""
    present = [k for k in constraints if k.column in df.columns]
    rows, *failed = agg_row(df, ["count(*)"] + [f"count_if(NOT coalesce({k.predicate}, false))" for k in present])
    counts = {id(k): n for k, n in zip(present, failed)}
    return small_frame(df.sparkSession, [
        {"column": k.column, "check": k.kind, "expected": k.expected, "violations": counts.get(id(k), rows)}
        for k in constraints], [("column", pa.string()), ("check", pa.string()), ("expected", pa.string()),
                                ("violations", pa.int64())])


def failing_rows(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Rows that break a constraint, with the list of broken ones."""
    broken = ", ".join(f"CASE WHEN NOT coalesce({k.predicate}, false) THEN {text(k.column + ':' + k.kind)} END"
                       for k in constraints if k.column in df.columns)
    return df.withColumn("violations", F.expr(f"array_compact(array({broken}))")).where("size(violations) > 0")


def coerce(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Cast each constrained column to its contract type; a cell that cannot be read becomes NULL."""
    casts = {k.column: k.cast for k in constraints if k.kind == "type"}
    return df.selectExpr(*[f"{casts[c]} AS {q(c)}" if c in casts else q(c) for c in df.columns])


class ContractViolation(ValueError):
    pass


def validate(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """The coerced table, or one error that lists every broken constraint."""
    broken = violations_df(df, constraints).where("violations > 0").collect()
    if broken:
        raise ContractViolation("; ".join(f"{r['column']} {r['check']}: {r['violations']}" for r in broken))
    return coerce(df, constraints)
