"""Python workers live on between tasks; what a task needed for a moment goes back to the system when a block is done."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa

from quern.functions.memory import release


def lean(work: Callable) -> Callable:
    """`work` on a group, a pair of groups, or batches, that gives memory back after every group or batch."""
    if inspect.isgeneratorfunction(work):
        def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for out in work(found):
                yield out
                del out
                release()
        return batches
    if len(inspect.signature(work).parameters) == 2:
        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            try:
                return work(left, right)
            finally:
                release()
        return pair

    def group(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()
    return group
