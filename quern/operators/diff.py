"""DIF-*: what changed between a raw and a cleaned table, matched on a key."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import q, text
from quern.functions.types import families
from quern.operators.facts import small_frame
from quern.operators.quantiles import agg_row


def _nullish(x: str, fam: str) -> str:
    if fam == "text":
        return f"({x} IS NULL OR {x} = '')"
    return f"({x} IS NULL OR isnan({x}))" if fam == "real" else f"({x} IS NULL)"


def cell_status(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """DIF-1: (key, column, status) for every cell of the cleaned table: new, imputed, modified or normal. One join on
    the key; the cells are a stack of literal comparisons, so nothing else is shuffled.

    Every row of the cleaned table is kept: one whose key the raw table lacks is new in all its cells, and a NULL key
    matches a NULL key. Keys must be unique in the raw table, else a row would have several pasts."""
    old, new = families(raw), families(cleaned)
    repeated = raw.groupBy(q(key)).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"key {key!r} is not unique in the raw table, e.g. {repeated[0][0]!r}")
    before = raw.selectExpr(f"{q(key)} AS __raw_key", "true AS __known",
                            *[f"{q(c)} AS {q('raw.' + c)}" for c in raw.columns if c in new])
    after = cleaned.withColumnRenamed(key, "__key")
    entries = []
    columns = [c for c in cleaned.columns if c != key]
    number = ("integer", "real")
    for c in columns:
        x = q(c)
        if c not in old:
            entries.append(f"{text(c)}, 'new'")
            continue
        b = q("raw." + c)
        if old[c] in number and new[c] in number:
            changed = f"coalesce(abs(cast({b} AS double) - cast({x} AS double)) > 0.0001, true)"
        else:
            changed = f"NOT (cast({b} AS string) <=> cast({x} AS string))"
        entries.append(f"{text(c)}, CASE WHEN __known IS NULL THEN 'new' WHEN {_nullish(b, old[c])} THEN "
                       f"CASE WHEN {_nullish(x, new[c])} THEN 'normal' ELSE 'imputed' END "
                       f"WHEN {changed} THEN 'modified' ELSE 'normal' END")
    joined = after.join(before, F.col("__key").eqNullSafe(F.col("__raw_key")), "left")
    return joined.selectExpr("__key AS row_key", f"stack({len(columns)}, {', '.join(entries)}) AS (column, status)")


def cell_status_counts(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    return cell_status(raw, cleaned, key).groupBy("column", "status").agg(F.count("*").alias("cells"))


def column_diff(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """DIF-2: dropped, created and kept columns with their missing cells before and after, from one aggregate per
    table."""
    count = lambda d: dict(zip(d.columns, agg_row(d, [f"count_if({q(c)} IS NULL)" for c in d.columns])))
    before, after = count(raw), count(cleaned)
    rows = [{"column": c, "change": "kept" if c in after else "dropped", "missing_before": before[c],
             "missing_after": after.get(c)} for c in raw.columns]
    rows += [{"column": c, "change": "created", "missing_after": after[c]} for c in cleaned.columns if c not in before]
    return small_frame(raw.sparkSession, rows, [("column", pa.string()), ("change", pa.string()),
                                                ("missing_before", pa.int64()), ("missing_after", pa.int64())])


def search_rows(df: DataFrame, wanted: str) -> DataFrame:
    """DIF-3: rows with a cell that contains the text, in any case."""
    if not wanted:
        return df
    needle = text(wanted.lower())
    return df.where(" OR ".join(f"contains(lower(cast({q(c)} AS string)), {needle})" for c in df.columns))
