"""STR-1, STR-2: fit on a table, apply to a stream. Repairs, recipes and contracts are projections, so they need no
state; duplicates are dropped within a watermark, which bounds the state by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.contracts import Constraint, coerce, failing_rows
from quern.operators.recipe import RecipeModel
from quern.operators.repair import RepairPlan


def repair_stream(stream: DataFrame, plan: RepairPlan) -> DataFrame:
    return plan.transform(stream)


def recipe_stream(stream: DataFrame, model: RecipeModel, plan: RepairPlan | None = None) -> DataFrame:
    """Steps that need the whole table (dropping duplicates, searching neighbours) are left out or replaced by the
    fitted mean; see `deduplicate_stream` for the former."""
    return model.transform(plan.transform(stream) if plan else stream, rows=False)


def deduplicate_stream(stream: DataFrame, event_time: str, delay: str, keys: list[str] | None = None) -> DataFrame:
    """First copy of each row (or key) seen within `delay` of the newest event time."""
    marked = stream.withWatermark(event_time, delay)
    return marked.dropDuplicatesWithinWatermark(keys) if keys else marked.dropDuplicatesWithinWatermark()


def contract_stream(stream: DataFrame, constraints: list[Constraint]) -> tuple[DataFrame, DataFrame]:
    """(good rows coerced to the contract, bad rows with the list of broken constraints)."""
    bad = failing_rows(stream, constraints)
    tests = [k.predicate for k in constraints if k.column in stream.columns]
    good = stream.where(F.expr(" AND ".join(f"coalesce({t}, false)" for t in tests))) if tests else stream
    return coerce(good, constraints), bad
