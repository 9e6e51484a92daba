"""Distances are computed in pieces whose memory does not grow with donors or cells."""
import tracemalloc

import numpy as np

from quern.operators import cells, knn


def _peak(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_distances_take_little_memory_at_once():
    draw = np.random.default_rng(4)
    donors = draw.random((50_000, 3))
    rows = np.where(draw.random((60, 3)) < 0.3, np.nan, draw.random((60, 3)))
    assert _peak(lambda: list(knn.nearest_in_block(rows, donors, donors[:, 0], 5))) < 30
    some = object.__new__(cells.Cells)
    some.width, some.cells, some.low = 3, np.arange(7_000), donors[:7_000]
    some.high = some.low + 0.1
    vectors = draw.random((cells.AT_ONCE // 7_000, 3))
    assert _peak(lambda: some.bounds(vectors)) < 30
