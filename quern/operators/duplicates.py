"""REC-3, PIP-2: equal rows, found in two steps so that rows that occur once are not shuffled.

First the rows' 128-bit fingerprints are counted, which moves 16 bytes a row and combines copies on the map side. The fingerprints
that occur more than once set bits of a filter of bounded size, which is broadcast; only rows whose bit is set may have a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.lineage import cut
from quern.functions.names import q
from quern.operators.profile import fingerprint

SPARSE = 16               # bits for each fingerprint that repeats: one row in SPARSE is shuffled without need
MOST_BITS = 1 << 29       # 64 MB; beyond, more rows are shuffled without need and the result is the same
MAP_BITS = 1 << 15        # bits of one row of the filter, as bitmap_construct_agg makes them
RUN = 10_000              # copies dealt out at once


class Repeats:
    """The filter of the rows of a table that occur more than once, by `columns` (default: all)."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None) -> None:
        self.hashes = fingerprint(columns or df.columns)
        a, b = self.hashes
        keys = df.selectExpr(f"{a} AS a", f"{b} AS b").groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a").persist()
        n = keys.count()
        self.bits = 1 << max(15, min(MOST_BITS, SPARSE * n).bit_length())
        self.maps = cut(keys.selectExpr(f"pmod(a, {self.bits}L) AS at").selectExpr(f"at DIV {MAP_BITS} AS map", f"at % {MAP_BITS} AS bit")
                        .groupBy("map").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))) if n else None
        keys.unpersist()

    def parts(self, df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(rows that occur once, rows that may occur more often)."""
        if self.maps is None:
            return df, None
        names = [q(c) for c in df.columns]
        marked = (df.selectExpr("*", f"pmod({self.hashes[0]}, {self.bits}L) AS __at").selectExpr("*", f"__at DIV {MAP_BITS} AS __map")
                  .join(F.broadcast(self.maps.selectExpr("map AS __map", "bits AS __bits")), "__map", "left"))
        byte = f"cast(conv(hex(substring(__bits, cast((__at % {MAP_BITS}) DIV 8 + 1 AS int), 1)), 16, 10) AS int)"
        held = f"coalesce((shiftright({byte}, cast(__at % 8 AS int)) & 1) = 1, false)"
        return marked.where(f"NOT {held}").selectExpr(*names), marked.where(held).selectExpr(*names)


def distinct_rows(df: DataFrame, repeats: Repeats | None = None) -> DataFrame:
    """As `df.dropDuplicates()`. `repeats`: the filter of this table, if it is at hand."""
    once, rest = (repeats or Repeats(df)).parts(df)
    return once if rest is None else once.unionByName(rest.dropDuplicates())


def numbered_copies(df: DataFrame, identity: str, name: str) -> DataFrame:
    """`df` with `name`: the SQL text `identity` (the same for equal rows only), `#` and a number from 1 for each copy. Copies are
    counted and dealt out again in runs, so one row that fills a third of the table is not one task."""
    keyed = df.withColumn(name, F.expr(identity))
    once, rest = Repeats(keyed, [name]).parts(keyed)
    once = once.withColumn(name, F.concat(name, F.lit("#1")))
    if rest is None:
        return once
    whole = F.struct(*(F.col(q(c)) for c in df.columns))
    counted = rest.groupBy(name).agg(F.first(whole).alias("__row"), F.count("*").alias("__n"))
    runs = counted.withColumn("__run", F.explode(F.expr(f"sequence(0L, (__n - 1) DIV {RUN})"))).repartition(name, "__run")
    copies = runs.withColumn("__k", F.explode(F.expr(f"sequence(__run * {RUN} + 1, least(__n, (__run + 1) * {RUN}))")))
    return once.unionByName(copies.select("__row.*", F.concat(name, F.lit("#"), F.col("__k").cast("string")).alias(name)))
