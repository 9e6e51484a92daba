"""Sums over all pairs of columns from one pass: products, and what each column sums to where another one is present.

Every task keeps square matrices, one row and column for each column of the table, and adds each Arrow batch to them with matrix
products. The matrices are summed over tasks in two steps of groups, each of which holds one matrix at a time, and come back in
blocks of rows. The number of jobs and expressions is the same for five columns and for hundreds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import q
from quern.functions.ship import ship

BLOCK = 1 << 18  # numbers of a block of matrix rows
GROUPS = 32


@dataclass
class Gram:
    """For values: products[a, b] sums a x b where both are present, sums[a, b] and squares[a, b] sum a and a x a where b is present,
    both[a, b] counts the rows where both are present, powers[a] sums the second to fourth powers. gaps[i, j] counts the rows where
    both flags are set."""
    products: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    both: np.ndarray
    powers: np.ndarray
    gaps: np.ndarray


def gram(df: DataFrame, values: list[str], flags: list[str]) -> Gram:
    """`values`: SQL numbers, NULL where missing, best centred so that sums of products stay accurate. `flags`: columns whose
    NULLs are counted together. A matrix row of `values` holds products, sums, squares, both and powers; then come the flags' rows."""
    ship(df.sparkSession)
    k, g = len(values), len(flags)
    width = 4 * k + 3
    lines = np.concatenate((np.full(k, width), np.full(g, g))).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lines)))
    cuts = [(a, min(a + BLOCK, int(ends[-1]))) for a in range(0, int(ends[-1]), BLOCK)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, gaps, seen = np.zeros((k, width)), np.zeros((g, g)), False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            if k:
                d = np.column_stack([batch[i].to_numpy(zero_copy_only=False) for i in range(k)])
                present = ~np.isnan(d)
                d[~present] = 0.0
                here = present.astype(np.float64)
                square = d * d
                main[:, :k] += d.T @ d
                main[:, k:2 * k] += d.T @ here
                main[:, 2 * k:3 * k] += square.T @ here
                main[:, 3 * k:4 * k] += here.T @ here
                main[:, 4 * k:] += np.stack((square.sum(0), (square * d).sum(0), (square * square).sum(0)), axis=1)
            if g:
                missing = np.column_stack([batch[k + j].to_numpy(zero_copy_only=False) for j in range(g)]).astype(np.float64)
                gaps += missing.T @ missing
        if seen:
            flat = np.concatenate((main.ravel(), gaps.ravel()))
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(cuts)), pa.int32()),
                                              "task": pa.array([TaskContext.get().partitionId()] * len(cuts), pa.int32()),
                                              "data": pa.array([flat[a:b].tobytes() for a, b in cuts], pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, block, task = None, 0, 0
        for batch in batches:
            for block, task, data in zip(batch["block"].to_pylist(), batch["task"].to_pylist(), batch["data"], strict=True):
                part = np.frombuffer(data.as_buffer())
                run = part.copy() if run is None else run + part
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "task": pa.array([task], pa.int32()), "data": pa.array([run.tobytes()], pa.binary())})

    shape = "block int, task int, data binary"
    columns = [F.expr(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)] + [F.col(q(c)).isNull().alias(f"m{j}") for j, c in enumerate(flags)]
    parts = df.select(*columns).mapInArrow(add, shape).withColumn("task", F.pmod("task", F.lit(GROUPS)))
    sums = parts.groupBy("block", "task").applyInArrow(total, shape).groupBy("block").applyInArrow(total, shape)
    flat = np.zeros(int(ends[-1]))
    for r in sums.collect():   # as many numbers as pairs of columns
        a, b = cuts[r["block"]]
        flat[a:b] = np.frombuffer(r["data"])
    main = flat[:k * width].reshape(k, width)
    return Gram(main[:, :k], main[:, k:2 * k], main[:, 2 * k:3 * k], main[:, 3 * k:4 * k], main[:, 4 * k:], flat[k * width:].reshape(g, g))


def pearson(found: Gram, names: list[str]) -> dict[tuple[str, str], float]:
    """Correlation of every pair over the rows where both are present; undefined ones are left out."""
    n = np.maximum(found.both, 1)
    cross = found.products - found.sums * found.sums.T / n
    own = found.squares - found.sums ** 2 / n
    # a spread that cancels to rounding noise means a side that is constant over the pair's rows
    steady = own > 1e-14 * np.maximum(np.diag(own)[:, None], 1e-300)
    with np.errstate(all="ignore"):
        r = np.clip(cross / (np.sqrt(own) * np.sqrt(own.T)), -1.0, 1.0)
    fine = steady & steady.T & (found.both > 0)
    return {(names[i], names[j]): float(r[i, j]) for i in range(len(names)) for j in range(i + 1, len(names)) if fine[i, j]}


def co_missing(gaps: np.ndarray, names: list[str], rows: int, least: float = 0.5) -> list[tuple[str, str, float]]:
    """Pairs of columns whose NULLs correlate by `least` or more, from exact counts."""
    n = np.diag(gaps)
    with np.errstate(all="ignore"):
        r = (rows * gaps - np.outer(n, n)) / np.outer(np.sqrt(n * (rows - n)), np.sqrt(n * (rows - n)))
    return [(names[i], names[j], float(r[i, j])) for i in range(len(names)) for j in range(i + 1, len(names)) if r[i, j] >= least]
