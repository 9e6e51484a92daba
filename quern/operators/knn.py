"""REC-6: exact k-nearest-neighbour fill, spread over the cluster without comparing all pairs.

Distance is Euclidean over the coordinates two rows share, scaled by (all coordinates / shared coordinates); the fill
is the plain mean of the k nearest rows that have the value, smaller values first among equal distances.

  1  equal rows collapse: a row vector is searched once, and equal donors travel as one row with a count
  2  donors are placed in cells of k-d trees, one tree for each pattern of present features (see cells.py), as many cells as the
     donors need; a cell that holds too many donors (one value may cover a third of the table) is split into blocks, and so
     are a cell's searching rows
  3  each searching row looks in the cell with the least bound, and gets an upper bound on its k-th distance
  4  it then visits only the cells whose box, over the features that both have, is no farther than that

No donor is left out, so the result is exact; the bounds decide how much is compared. Rows that lack a feature are bounded by
those they share with a cell; a cell without a shared feature is not visited. Pairs live only inside a numpy block; a task
returns k rows per searching row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.lineage import cut
from quern.functions.memory import release
from quern.functions.ship import ship
from quern.functions.names import double, q
from quern.functions.types import as_double, families
from quern.operators.cells import Cells
from quern.operators.profile import fingerprint
from quern.operators.quantiles import agg_row

CELL_ROWS = 4_000        # donors a cell aims for
BLOCK_DONORS = 50_000    # donors compared at once in one task
BLOCK_ROWS = 20_000      # searching rows of one task
PAIRS_AT_ONCE = 250_000  # distances computed at once, each in a few arrays of doubles


def nearest_in_block(rows: np.ndarray, donors: np.ndarray, values: np.ndarray, k: int
                     ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row index, donor indexes, distances) of the k nearest donors of each row, ties by donor value."""
    width = rows.shape[1]
    step = max(1, PAIRS_AT_ONCE // max(1, len(donors)))
    for start in range(0, len(rows), step):
        part = rows[start:start + step]
        total = np.zeros((len(part), len(donors)))
        shared = np.zeros((len(part), len(donors)))
        for j in range(width):
            gap = part[:, j, None] - donors[None, :, j]
            both = ~np.isnan(gap)
            gap *= gap
            np.add(total, gap, out=total, where=both)
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.where(shared > 0, np.sqrt(width / shared * total), np.inf)
        for i, d in enumerate(dist):
            reach = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
            near = np.flatnonzero((d <= reach) & np.isfinite(d))
            near = near[np.lexsort((values[near], d[near]))][:k]
            yield start + i, near, d[near]


@dataclass
class _Target:
    column: str
    mean: float | None


@dataclass
class KnnFill:
    donors: DataFrame           # the fitted rows, features only
    features: list[str]
    targets: list[_Target]
    k: int = 5
    cell_rows: int = CELL_ROWS
    known: tuple[DataFrame, DataFrame] | None = None     # (vectors of the fitted rows, their fills)
    streamable = False

    @classmethod
    def fit(cls, df: DataFrame, targets: list[str], features: list[str], k: int = 5, cell_rows: int = CELL_ROWS
            ) -> KnnFill:
        ship(df.sparkSession)
        fams = families(df)
        donors = df.selectExpr(*[f"{as_double(c, fams[c])} AS {q(c)}" for c in features])
        means = agg_row(donors, [f"avg({q(t)})" for t in targets])
        step = cls(donors, list(features), [_Target(t, m) for t, m in zip(targets, means, strict=True)], k, cell_rows)
        # the search over the fitted rows runs once; its result is one small row per vector with a gap
        step.known = (donors, cut(step._lookup(donors)))
        return step

    def _lookup(self, vectors: DataFrame) -> DataFrame:
        """(h1, h2, one fill per target) for the distinct vectors with a gap."""
        found = None
        for i, t in enumerate(self.targets):
            one = self._fills(vectors, t).select("h1", "h2", F.col("fill").alias(f"__fill_{i}"))
            found = one if found is None else found.join(one, ["h1", "h2"], "full")
        return found

    def __call__(self, df: DataFrame) -> DataFrame:
        """Only the rows that lack a value are shuffled; complete rows pass through."""
        fams = families(df)
        missing = [t for t in self.targets if t.column in df.columns]
        if df.isStreaming:     # a stream has no whole table to search in: fall back to the fitted mean
            return df.selectExpr(*[
                f"coalesce({as_double(c, fams[c])}, {double(self._of(c).mean)}) AS {q(c)}"
                if self._of(c) and self._of(c).mean is not None else q(c) for c in df.columns])
        gap = " OR ".join(f"{q(t.column)} IS NULL" for t in missing)
        names = df.columns
        views = [f"{as_double(c, fams[c])} AS {q(c)}" if self._of(c) else q(c) for c in names]
        vectors = df.selectExpr(*[f"{as_double(c, fams[c])} AS {q(c)}" for c in self.features])
        if self.known and vectors.sameSemantics(self.known[0]):
            lookup = self.known[1]
        else:
            lookup = self._lookup(vectors)
        complete = df.where(f"NOT ({gap})").selectExpr(*views)
        partial = df.where(gap).selectExpr(*views)
        # hash the features in the type they were fitted in
        partial = partial.selectExpr("*", *[f"{as_double(c, fams[c])} AS {q('__f_' + str(i))}"
                                            for i, c in enumerate(self.features)])
        renamed = fingerprint([f"__f_{i}" for i in range(len(self.features))])
        keyed = (partial.withColumn("h1", F.expr(renamed[0])).withColumn("h2", F.expr(renamed[1]))
                 .join(lookup, ["h1", "h2"], "left"))
        out = []
        for c in names:
            i = next((i for i, t in enumerate(self.targets) if t.column == c), None)
            fallback = f", {double(self.targets[i].mean)}" if i is not None and self.targets[i].mean is not None else ""
            out.append(q(c) if i is None else f"coalesce({q(c)}, __fill_{i}{fallback}) AS {q(c)}")
        return complete.unionByName(keyed.selectExpr(*out))

    def _of(self, column: str) -> _Target | None:
        return next((t for t in self.targets if t.column == column), None)

    # ------------------------------------------------------------------ one target column
    def _fills(self, vectors: DataFrame, t: _Target) -> DataFrame:
        """(h1, h2, fill) for each distinct feature vector that lacks the target."""
        h1, h2 = fingerprint(self.features)
        vec = "array(" + ", ".join(f"coalesce({q(c)}, double('NaN'))" for c in self.features) + ")"
        target = q(t.column)
        keyed = lambda d, extra: d.selectExpr(f"{h1} AS h1", f"{h2} AS h2", f"{vec} AS vec", *extra)
        searching = keyed(vectors.where(f"{target} IS NULL"), []).groupBy("h1", "h2").agg(F.first("vec").alias("vec"))
        donors = cut(keyed(self.donors.where(f"{target} IS NOT NULL"), [f"{target} AS val"]).groupBy("h1", "h2")
                     .agg(F.first("vec").alias("vec"), F.first("val").alias("val"), F.count("*").alias("cnt")))
        cells = Cells(donors, len(self.features), self.cell_rows)
        if not cells.sizes:
            return searching.selectExpr("h1", "h2", "cast(NULL AS double) AS fill")
        donors = donors.withColumn("cell", cells.cell_of(F.col("vec")))
        own = cut(searching.withColumn("visit", cells.nearest(F.col("vec"))).where("visit >= 0"))
        best = first_look = cut(self._search(own, donors, cells.sizes))
        if len(cells.sizes) > 1:
            order = Window.partitionBy("h1", "h2").orderBy("dist", "val")
            reach = (first_look.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= self.k)
                     .groupBy("h1", "h2").agg(F.max("dist").alias("r"), F.count("*").alias("found")))
            # a hair wider than the bound, so rounding cannot exclude a donor that ties it
            bound = F.expr(f"coalesce(CASE WHEN found = {self.k} THEN r * 1.000000001 END, double('Infinity'))")
            wider = own.join(reach, ["h1", "h2"], "left").withColumn("others", cells.within(F.col("vec"), bound, F.col("visit")))
            wider = wider.select("h1", "h2", "vec", F.explode("others").alias("visit"))
            best = first_look.unionByName(self._search(cut(wider), donors, cells.sizes))
        order = Window.partitionBy("h1", "h2").orderBy("dist", "val", "cnt")
        top = best.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= self.k)
        before = F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1))
        take = F.greatest(F.lit(0), F.least(F.col("cnt"), F.lit(self.k) - F.coalesce(before, F.lit(0))))
        return (top.withColumn("take", take)
                .groupBy("h1", "h2").agg((F.sum(F.col("take") * F.col("val")) / F.sum("take")).alias("fill")))

    def _search(self, visits: DataFrame, donors: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """Best k donors per searching row and block. Donor blocks and row chunks have bounded size."""
        k = self.k
        blocks = {c: -(-n // BLOCK_DONORS) for c, n in sizes.items()}
        many = {c: b for c, b in blocks.items() if b > 1}
        per_cell = ("CASE {0} " + " ".join(f"WHEN {c} THEN {b}" for c, b in many.items()) + " ELSE 1 END"
                    if many else "1")
        row_counts = {r["visit"]: r["count"] for r in visits.groupBy("visit").count().collect()}
        chunky = {c: -(-n // BLOCK_ROWS) for c, n in row_counts.items() if n > BLOCK_ROWS}
        per_visit = ("CASE {0} " + " ".join(f"WHEN {c} THEN {b}" for c, b in chunky.items()) + " ELSE 1 END"
                     if chunky else "1")
        left = visits.selectExpr(
            "h1", "h2", "vec", "visit", f"cast(pmod(h1, {per_visit.format('visit')}) AS int) AS chunk",
            f"explode(sequence(0, {per_cell.format('visit')} - 1)) AS block")
        right = donors.selectExpr(
            "vec", "val", "cnt", "cell AS visit", f"cast(pmod(h2, {per_cell.format('cell')}) AS int) AS block",
            f"explode(sequence(0, {per_visit.format('cell')} - 1)) AS chunk")

        def look(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(near):
                return pd.DataFrame({"h1": [], "h2": [], "dist": [], "val": [], "cnt": []})
            values, counts = near["val"].to_numpy(), near["cnt"].to_numpy()
            a, b = rows["h1"].to_numpy(), rows["h2"].to_numpy()
            out = [(np.full(len(ix), a[i]), np.full(len(ix), b[i]), d, values[ix], counts[ix])
                   for i, ix, d in nearest_in_block(np.stack(rows["vec"].to_numpy()),
                                                    np.stack(near["vec"].to_numpy()), values, k)]
            best = pd.DataFrame({n: np.concatenate([o[j] for o in out])
                                 for j, n in enumerate(("h1", "h2", "dist", "val", "cnt"))})
            del out
            release()
            return best

        keys = ["visit", "block", "chunk"]
        return (left.groupBy(*keys).cogroup(right.groupBy(*keys))
                .applyInPandas(look, "h1 bigint, h2 bigint, dist double, val double, cnt bigint"))
