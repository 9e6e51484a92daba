"""SNK-*: writing results, reports and previews."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.functions.names import q, sanitize_column_names
from quern.operators.facts import DatasetFacts, column_facts_df, pairs_df, small_frame

# Output format by file extension.
FORMAT_BY_EXTENSION = {".csv": "csv", ".parquet": "parquet", ".pqt": "parquet", ".db": "table", ".sqlite": "table",
                       ".sqlite3": "table"}


def output_format(path: str, fmt: str | None = None) -> str:
    """SNK-8: an explicit format, else the one the extension names."""
    found = fmt or FORMAT_BY_EXTENSION.get(os.path.splitext(path)[1].lower())
    if found is None:
        raise ValueError("cannot tell the output format from the extension; name one of csv, parquet, table")
    return found


def write(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists", **jdbc) -> None:
    """SNK-1..3, SNK-5: CSV or Parquet files, or a table with safe column names (the catalog's, or over JDBC when
    `url` is given). Executors write their own part files."""
    if not df.columns:
        raise ValueError("nothing to export: the table has no columns")
    kind = output_format(path, fmt)
    if kind == "csv":
        (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))   # quotes are doubled and spaces kept, as scans read them
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    elif kind == "table" and jdbc:
        sanitize_column_names(df).write.format("jdbc").options(dbtable=path, **jdbc).mode(mode).save()
    elif kind == "table":
        sanitize_column_names(df).write.mode(mode).saveAsTable(path)
    else:
        raise ValueError(f"unknown output format {kind!r}")


def summary_overview(df: DataFrame, facts: DatasetFacts) -> DataFrame:
    """SNK-4: rows, columns, cells and approximate size."""
    rows = [{"metric": m, "value": v} for m, v in (
        ("Total Rows", float(facts.rows)), ("Total Columns", float(len(df.columns))), ("Total Cells", float(facts.cells)),
        ("Memory Usage (MB)", round(facts.data_bytes / 2**20, 2)))]
    return small_frame(df.sparkSession, rows, [("metric", pa.string()), ("value", pa.float64())])


def column_schema(df: DataFrame, facts: DatasetFacts) -> DataFrame:
    """SNK-4: type, non-null count and distinct count of every column."""
    return column_facts_df(df.sparkSession, facts).selectExpr(
        "position", "name AS column", "physical AS dtype", "non_null", "unique")


def preview(df: DataFrame, order_by: str | None = None, rows: int = 50) -> DataFrame:
    """SNK-7: the first rows in a given order (a per-task top-k, not a sort), or any rows without one. Infinities are
    NULL and dates ISO text."""
    from quern.functions.types import families, infinite_to_null
    fams = families(df)
    top = df.orderBy(q(order_by)).limit(rows) if order_by else df.limit(rows)
    top = infinite_to_null(top)
    return top.selectExpr(*[
        f"date_format({q(c)}, \"yyyy-MM-dd'T'HH:mm:ss.SSS\") AS {q(c)}" if fams[c] == "time" else q(c)
        for c in df.columns])


def write_report(spark, path: str, metadata: dict, repairs, facts: DatasetFacts, inference, target: dict | None = None
                 ) -> None:
    """SNK-6: the audit as JSON files under `path`: column facts, pairs, repairs, the rule log, the trace, and one
    summary document. Everything here is a few rows per column."""
    from quern.operators.inference import recommendations_df, trace_df
    from quern.operators.rules import rule_log_df
    parts = {"columns": column_facts_df(spark, facts), "pairs": pairs_df(spark, facts),
             "rule_log": rule_log_df(spark, facts), "trace": trace_df(spark, inference),
             "recommendations": recommendations_df(spark, inference, facts)}
    for name, frame in parts.items():
        frame.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
    document = {"metadata": metadata, "repairs": [r.to_dict() for r in repairs], "summary": facts.summary(),
                "health": inference.health, "target": target}
    line = small_frame(spark, [{"value": json.dumps(document, default=str, ensure_ascii=False)}],
                       [("value", pa.string())])
    line.coalesce(1).write.mode("overwrite").text(f"{path}/summary")
