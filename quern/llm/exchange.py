"""Questions about the whole corpus, asked by blocks of texts and answered by buckets of hashes.

Near-duplicates, repeated passages and word counts need, for every window or word of a text, a number that depends on all
texts. One row per window would cost several times the input in row overhead. Here texts are dealt to blocks of a few
megabytes; a block sends each bucket one row with its sorted distinct hashes packed as bytes; the bucket answers with one
small array per block in the same order. A hash that a third of the corpus holds is one entry per block, so no task sees
it more often than there are blocks. Blocks and buckets grow in number with the corpus and not in size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.ship import ship

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20  # of text for each bucket
QUESTION = "block int, bucket int, keys binary, extra binary"
ANSWER = "block int, bucket int, answer binary"
_U = np.uint64


def checkpoints(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only where `spark.checkpoint.dir` is unset, as in tests, a folder is chosen."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(given or f"/tmp/quern-checkpoints/{uuid.uuid4().hex}")
    return given or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder; its lineage ends there."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("n")).first()["n"] or 0


def sizes(total: int, larger: int = 1) -> tuple[int, int]:
    """Blocks (`larger` times the usual size), and buckets as a power of two, for so many bytes of text."""
    return max(1, math.ceil(total / (BLOCK_BYTES * larger))), 1 << max(0, math.ceil(math.log2(max(1, total / BUCKET_BYTES))))


def blocks(docs: DataFrame, columns: dict[str, str], n: int) -> DataFrame:
    """The wanted columns under the given new names, with `block`, dealt by a hash of all of them: copies of a text under
    different ids are spread. Other columns are left behind, so their names cannot clash."""
    ship(docs.sparkSession)
    own = docs.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))
    parts = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # fewer would be dealt anew
    return own.withColumn("block", F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")).repartition(parts, "block")


def pack(keys: np.ndarray, bits: int) -> bytes:
    """The 40 bits of each key after the bucket's `bits`. Sorted keys are sent as differences, of 4 bytes where all fit."""
    rest = keys << _U(bits) >> _U(24)
    steps = np.diff(rest, prepend=_U(0))
    if len(steps) and steps.max() >> _U(32):
        return b"\5" + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
    return b"\4" + steps.astype("<u4").tobytes()


def unpack(packed: pa.Buffer) -> np.ndarray:
    if memoryview(packed)[0] == 4:
        return np.cumsum(np.frombuffer(packed, "<u4", offset=1), dtype=np.uint64)
    low = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, 5)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :5] = low
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


class Distinct:
    """The distinct hashes of a block, in the order of buckets and then hashes, which is the order of every answer.

    `other`: an independent hash that names the bucket and so adds its bits to the key; else the high bits of the hash."""

    def __init__(self, hashes: np.ndarray, n_buckets: int, other: np.ndarray | None = None) -> None:
        self.bits = (n_buckets - 1).bit_length()
        shift = _U(64 - self.bits)
        named = hashes if other is None else other
        bucket = (named >> shift if n_buckets > 1 else np.zeros(len(hashes), np.uint64)).astype(np.int32)
        order = np.argsort(hashes) if other is None else np.lexsort((hashes, bucket))
        hashes, bucket = hashes[order], bucket[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
        self.inverse = np.empty(len(hashes), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.keys, self.count = hashes[new], np.diff(np.append(self.first, len(hashes)))
        self.order = order
        self.edges = np.searchsorted(bucket[new], np.arange(n_buckets + 1))

    def any(self, flags: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(flags[self.order], self.first) if len(self.first) else np.zeros(0, bool)

    def total(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.order], self.first) if len(self.first) else np.zeros(0, values.dtype)

    def questions(self, block: int, extra: np.ndarray, whole: bool = False) -> pa.Table:
        """`whole`: with all 64 bits of the keys."""
        rows = [(block, k, self.keys[a:b].tobytes() if whole else pack(self.keys[a:b], self.bits), extra[a:b].tobytes())
                for k, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)) if b > a]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "bucket", "keys", "extra"])

    def answers(self, table: pa.Table, dtype: type) -> np.ndarray:
        """What the buckets answered, by distinct hash."""
        out = np.zeros(len(self.keys), dtype)
        for k, part in zip(table["bucket"].to_pylist(), table["answer"], strict=True):
            out[self.edges[k]:self.edges[k + 1]] = np.frombuffer(part.as_buffer(), dtype)
        return out


def answerer(extra: type, decide: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], whole: bool = False
             ) -> Callable[[pa.Table], pa.Table]:
    """For one bucket: `decide(order, first, values)` gets the entries sorted by key, where each key begins, and the
    extras in the sent order; it returns an answer for each key."""
    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p.as_buffer(), np.uint64) if whole else unpack(p.as_buffer()) for p in table["keys"]]
        ends = np.cumsum([0] + [len(p) for p in parts])
        keys = np.concatenate(parts)
        values = np.concatenate([np.frombuffer(p.as_buffer(), extra) for p in table["extra"]])
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        back = np.empty(len(keys), np.int64)
        back[order] = np.cumsum(new) - 1
        got = decide(order, first, values)[back]
        return pa.table([table["block"], table["bucket"],
                         pa.array([got[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                        names=["block", "bucket", "answer"])
    return answer


def slices(column: pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a column of texts that hold about `limit` bytes each; a longer text is a range of its own."""
    _, at = buffer_offsets(column)
    row, n = 0, len(column)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def buffer_offsets(column: pa.ChunkedArray) -> tuple[None, np.ndarray]:
    import pyarrow.compute as pc
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return None, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
