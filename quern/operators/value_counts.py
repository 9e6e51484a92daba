"""Exact value counts of many columns in one shuffle, and their per-column summary.

Columns are unpivoted to (column, value) per physical family, so numbers stay numbers in the shuffle. Counting combines
on the map side, so a value that holds a third of the rows arrives as one row per task. Long texts are counted under
their SHA-256 digest: the shuffle moves 32 bytes per text instead of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.names import q, text
from quern.functions.types import families

LONG_TEXT = 96  # bytes; longer texts travel as digests
DIGEST = chr(1) + "sha2:"


def _family_counts(df: DataFrame, pairs: list[tuple[int, str]]) -> DataFrame:
    entries = ", ".join(f"{i}, {expr}" for i, expr in pairs)
    tall = df.selectExpr(f"stack({len(pairs)}, {entries}) AS (col, v)").where("v IS NOT NULL")
    return tall.groupBy("col", "v").agg(F.count("*").alias("cnt"))


def text_key(expr: str) -> str:
    return (f"CASE WHEN octet_length({expr}) > {LONG_TEXT} THEN concat({text(DIGEST)}, sha2({expr}, 256)) "
            f"ELSE {expr} END")


def value_counts(df: DataFrame, columns: list[str] | None = None,
                 expressions: dict[str, str] | None = None) -> list[DataFrame]:
    """Frames (col int, v, cnt bigint), one per physical family; `col` is the position in `columns`. NULLs are not
    counted. `expressions` replaces a text column by a SQL expression over it."""
    columns = list(df.columns if columns is None else columns)
    fams = families(df)
    groups: dict[str, list[tuple[int, str]]] = {}
    for i, c in enumerate(columns):
        fam = fams[c]
        if fam == "text":
            groups.setdefault("text", []).append((i, text_key((expressions or {}).get(c, q(c)))))
        elif fam == "integer":
            groups.setdefault("integer", []).append((i, f"cast({q(c)} AS bigint)"))
        elif fam == "boolean":
            groups.setdefault("boolean", []).append((i, q(c)))
        elif fam == "real":
            groups.setdefault("real", []).append((i, f"cast({q(c)} AS double)"))
        elif fam == "time":
            groups.setdefault("time", []).append((i, f"cast({q(c)} AS timestamp_ntz)"))
        else:
            groups.setdefault("text", []).append((i, text_key(f"to_json(struct({q(c)}))")))
    return [_family_counts(df, pairs) for pairs in groups.values()]


def summarise(counts: list[DataFrame], totals: dict[int, int], top: int = 20) -> DataFrame:
    """One row per column, with distinct count, largest count, base-2 entropy, values rarer than 1 %, and the `top`
    most frequent values (ties in value order). `totals` holds the non-null count per column.

    Both parts read the same exchange. The top values come from a ranked window with a limit, which Spark applies
    inside each input partition first, so no task receives a whole column."""
    n = "CASE col " + " ".join(f"WHEN {i} THEN {max(t, 1)}D" for i, t in totals.items()) + " END"
    order = Window.partitionBy("col").orderBy(F.desc("cnt"), F.asc("v"))

    def one(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        stats = (frame.withColumn("p", F.expr(f"cnt / {n}")).groupBy("col").agg(
            F.count("*").alias("distinct"), F.max("cnt").alias("top_count"),
            F.sum(F.expr("-p * log2(p)")).alias("entropy"), F.count_if(F.expr("p < 0.01")).alias("rare")))
        ranked = (frame.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= top)
                  .select("col", F.struct("rk", F.col("v").cast("string").alias("v"), "cnt").alias("s")))
        return stats, ranked

    parts = [one(f) for f in counts]
    stats = reduce(DataFrame.unionAll, [p[0] for p in parts])
    ranked = reduce(DataFrame.unionAll, [p[1] for p in parts])
    return stats.join(ranked.groupBy("col").agg(F.sort_array(F.collect_list("s")).alias("top")), "col")


def resolve_digests(df: DataFrame, columns: dict[str, str], digests: set[str]) -> dict[str, str]:
    """The texts behind a few digests, found with one scan. `columns` maps column name to its SQL text expression."""
    if not digests:
        return {}
    wanted = ", ".join(text(d[len(DIGEST):]) for d in sorted(digests))
    exprs = ", ".join(columns.values())
    long_texts = (df.selectExpr(f"explode(array({exprs})) AS v").where(f"octet_length(v) > {LONG_TEXT}")
                  .selectExpr("sha2(v, 256) AS d", "v").where(f"d IN ({wanted})")
                  .groupBy("d").agg(F.min("v").alias("v")))
    return {DIGEST + r["d"]: r["v"] for r in long_texts.collect()}
