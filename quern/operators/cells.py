"""Cells of vectors with gaps: k-d trees, one for each pattern of present features, and boxes that bound distances.

All vectors of a cell have the same features, so a searching vector shares the same features with all of them, and the distance to
the cell's box over these is a lower bound. Patterns with few vectors lie together in a mixed cell with a weaker bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.memory import release

SAMPLE = 40_000          # vectors that the cuts are drawn from; they set the cells, every vector is placed
AT_ONCE = 250_000        # distances to boxes computed at once, each in a few arrays of doubles
MIXED = 0


@dataclass
class Tree:
    """Node i: feature (-1 in a leaf), cut, children, and the leaf's cell. roots: node by pattern."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cell: np.ndarray
    roots: dict[bytes, int]

    def place(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), MIXED, np.int32)
        present = ~np.isnan(vectors)
        patterns, which = np.unique(np.packbits(present, axis=1), axis=0, return_inverse=True)
        for p, pattern in enumerate(patterns):
            root = self.roots.get(pattern.tobytes())
            if root is None:
                continue
            rows = np.flatnonzero(which.ravel() == p)
            node = np.full(len(rows), root)
            while (inner := np.flatnonzero(self.feature[node] >= 0)).size:
                at = node[inner]
                low = vectors[rows[inner], self.feature[at]] <= self.cut[at]
                node[inner] = np.where(low, self.left[at], self.right[at])
            out[rows] = self.cell[node]
        return out


def grow(sample: np.ndarray, rows: int, cell_rows: int) -> Tree:
    """A tree from a sample of `rows` vectors: halves along the widest feature until a cell holds about `cell_rows`."""
    nodes: list[list] = []
    cells = [MIXED]

    def split(part: np.ndarray) -> int:
        here = len(nodes)
        nodes.append([-1, 0.0, 0, 0, MIXED])
        if len(part) * scale > cell_rows and len(part) > 1:
            spread = np.where(np.isnan(part[0]), -1.0, np.ptp(part, axis=0))
            j = int(np.argmax(spread))
            cut = float(np.median(part[:, j]))
            low = part[:, j] <= cut
            low = low if low.any() and not low.all() else part[:, j] < cut
            if spread[j] > 0 and low.any() and not low.all():
                cut = float(part[low, j].max())
                nodes[here] = [j, cut, split(part[low]), split(part[~low]), MIXED]
                return here
        cells.append(len(cells))
        nodes[here][4] = cells[-1]
        return here

    roots, scale = {}, rows / max(1, len(sample))
    if len(sample):
        patterns, which = np.unique(np.packbits(~np.isnan(sample), axis=1), axis=0, return_inverse=True)
        for p, pattern in enumerate(patterns):
            part = sample[which.ravel() == p]
            if len(part) * scale * 4 >= cell_rows or len(patterns) == 1:
                roots[pattern.tobytes()] = split(part)
    table = list(zip(*nodes, strict=True)) or [[]] * 5
    return Tree(*(np.array(c, t) for c, t in zip(table, (np.int32, np.float64, np.int32, np.int32, np.int32), strict=True)), roots)


class Cells:
    """Cells of `donors`, whose column `vec` holds arrays with NaN for gaps. sizes: donors by cell."""

    def __init__(self, donors: DataFrame, width: int, cell_rows: int) -> None:
        self.rows, self.width = donors.count(), width
        share = min(1.0, SAMPLE / max(1, self.rows))
        drawn = [r["vec"] for r in donors.select("vec").sample(share, seed=7).collect()]
        self.tree = grow(np.array(drawn, float).reshape(-1, width), self.rows, cell_rows)
        at = lambda j: F.expr(f"nullif(vec[{j}], double('NaN'))")
        boxes = donors.withColumn("cell", self.cell_of(F.col("vec"))).groupBy("cell").agg(
            F.count("*").alias("n"), *(F.min(at(j)).alias(f"low{j}") for j in range(width)), *(F.max(at(j)).alias(f"high{j}") for j in range(width))).collect()
        self.cells = np.array([b["cell"] for b in boxes], np.int32)
        number = lambda v: np.nan if v is None else v
        self.low = np.array([[number(b[f"low{j}"]) for j in range(width)] for b in boxes], float).reshape(-1, width)
        self.high = np.array([[number(b[f"high{j}"]) for j in range(width)] for b in boxes], float).reshape(-1, width)
        self.sizes = {b["cell"]: b["n"] for b in boxes}
        self.counts = np.array([b["n"] for b in boxes], np.int64)

    def cell_of(self, vec: Column) -> Column:
        tree, width = self.tree, self.width

        @F.pandas_udf("int")
        def cell(x: pd.Series) -> pd.Series:
            try:
                return pd.Series(tree.place(np.array(x.tolist(), float).reshape(-1, width)))
            finally:
                release()
        return cell(vec)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors x cells) the least distance a donor of the cell can have; infinite where no feature is shared."""
        total, shared = (np.zeros((len(vectors), len(self.cells))) for _ in range(2))
        least = np.full((len(vectors), len(self.cells)), np.inf)
        for j in range(self.width):
            x, low, high = vectors[:, j, None], self.low[None, :, j], self.high[None, :, j]
            both = ~np.isnan(x) & ~np.isnan(low)
            gap = np.where(both, np.maximum(0.0, np.maximum(low - x, x - high)), 0.0)
            gap *= gap
            total += gap
            shared += both
            np.minimum(least, gap, out=least, where=both)
        with np.errstate(divide="ignore", invalid="ignore"):
            exact = np.where(shared > 0, np.sqrt(self.width / shared * total), np.inf)
        # in the mixed cell a donor may share any of the features, at best the one with the least gap alone
        return np.where(self.cells[None, :] == MIXED, np.sqrt(self.width * least), exact)

    def nearest(self, vec: Column) -> Column:
        """The cell to look in first: of those with the least bound, the one with most donors; -1 where none shares a feature."""
        me = self

        @F.pandas_udf("int")
        def cell(x: pd.Series) -> pd.Series:
            vectors, out = np.array(x.tolist(), float).reshape(-1, me.width), []
            step = max(1, AT_ONCE // max(1, len(me.cells)))
            for a in range(0, len(vectors), step):
                bound = me.bounds(vectors[a:a + step])
                tied = bound == bound.min(axis=1, keepdims=True)
                best = np.argmax(np.where(tied, me.counts[None, :], -1), axis=1)
                out.append(np.where(np.isfinite(bound[np.arange(len(bound)), best]), me.cells[best], -1))
            release()
            return pd.Series(np.concatenate(out) if out else np.zeros(0, int)).astype("int32")
        return cell(vec)

    def within(self, vec: Column, reach: Column, but: Column) -> Column:
        """The cells whose bound is `reach` or less, without the cell `but`."""
        me = self

        @F.pandas_udf("array<int>")
        def cells(x: pd.Series, r: pd.Series, own: pd.Series) -> pd.Series:
            vectors, out = np.array(x.tolist(), float).reshape(-1, me.width), []
            r, own = r.to_numpy(float), own.to_numpy()
            step = max(1, AT_ONCE // max(1, len(me.cells)))
            for a in range(0, len(vectors), step):
                bound = me.bounds(vectors[a:a + step])
                near = np.isfinite(bound) & (bound <= r[a:a + step, None]) & (me.cells[None, :] != own[a:a + step, None])
                out += [me.cells[line].tolist() for line in near]
            release()
            return pd.Series(out, dtype=object)
        return cells(vec, reach, but)
