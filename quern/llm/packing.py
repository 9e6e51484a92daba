"""Operator 3: documents packed into training sequences by deficit round-robin over the queues of their sources."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.ship import ship
from quern.llm.exchange import cut, slices
from quern.llm.memory import lean, release
from quern.llm.tokens import WordEncoder

MAX_QUEUES = 1024  # of more sources, the half of this number with the most text keep their own queues and the others share the rest
MAX_STRETCHES = 4096
STRETCH = 1024  # sequences at least in each stretch
BATCH_IDS = 500_000  # ids handed on at once
MAX_BROADCAST = 500_000  # rows of queue starts sent to all; more are joined by shuffle
PIECES = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def deal(totals: np.ndarray, capacities: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """How many tokens each window takes from each queue (windows x queues), by deficit round-robin.

    In each window a queue's deficit grows by its share of the window; the queue gives the whole part and carries the
    rest. Windows are full: what an empty queue leaves is taken from the largest deficits, which then are debts."""
    done, deficit = np.zeros(len(totals), np.int64), np.zeros(len(totals))
    out = np.zeros((len(capacities), len(totals)), np.int64)
    for w, capacity in enumerate(capacities.tolist()):
        left = totals - done
        active = np.where(left > 0, shares, 0.0)
        active = active if active.sum() > 0 else left.astype(float)
        deficit = np.where(left > 0, deficit + capacity * (active / active.sum()), 0.0)
        take = np.clip(np.floor(deficit), 0, left).astype(np.int64)
        short = capacity - int(take.sum())
        while short > 0:
            free = np.flatnonzero(left > take)
            free = free[np.argsort(take[free] - deficit[free], kind="stable")]
            more = np.minimum(left[free] - take[free], max(1, short // len(free)))
            more = np.minimum(more, np.maximum(0, short - (np.cumsum(more) - more)))
            take[free] += more
            short -= int(more.sum())
        while short < 0:
            over = np.flatnonzero(take > 0)
            over = over[np.argsort(deficit[over] - take[over], kind="stable")][:-short]
            take[over] -= 1
            short += len(over)
        deficit -= take
        done += take
        out[w] = take
    return out


class Plan:
    """Where every token of every queue goes. The driver deals queues to stretches of many sequences; what a stretch gives
    its sequences is dealt again, by whoever needs it, with the same result."""

    def __init__(self, totals: np.ndarray, sequence: int, shares: np.ndarray) -> None:
        tokens = int(totals.sum())
        self.sequence, self.shares, windows = sequence, shares, -(-tokens // sequence)
        self.stretch = max(STRETCH, -(-windows // MAX_STRETCHES))
        capacities = np.full(max(1, -(-windows // self.stretch)), self.stretch * sequence, np.int64)
        capacities[-1] = tokens - int(capacities[:-1].sum())
        self.edges = np.concatenate((np.zeros((1, len(totals)), np.int64), np.cumsum(deal(totals, capacities, shares), axis=0)))

    def cuts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For the sequences of stretch k: where each begins in each queue (one row more than sequences), and the offset of
        each queue's share in the sequence."""
        totals = self.edges[k + 1] - self.edges[k]
        tokens = int(totals.sum())
        capacities = np.full(-(-tokens // self.sequence), self.sequence, np.int64)
        capacities[-1] = tokens - int(capacities[:-1].sum())
        take = deal(totals, capacities, self.shares)
        at = self.edges[k] + np.concatenate((np.zeros((1, len(totals)), np.int64), np.cumsum(take, axis=0)))
        return at, np.cumsum(take, axis=1) - take


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         sequence: int = 4096, end: int = 2, proportions: dict[str, float] | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    A document is its token ids and `end`; a NULL or empty text is `end` alone. Every id lies in exactly one piece; pieces of
    a sequence follow one another without gaps; every sequence but the last has `sequence` ids.

    Mixture. Each source is a queue of tokens. Every sequence takes from each queue by deficit round-robin, in
    `proportions` (default: the sources' shares of all tokens); deficits go on from sequence to sequence and across
    partitions. A source that runs out leaves its share to the rest; a source without a proportion waits until the others
    have run out. NULL is a source like any other. Above MAX_QUEUES sources, the MAX_QUEUES // 2 with the most text keep queues
    of their own; the others, each smaller than all of these, share queues by hash, and only the shared queue's share is held.

    Documents keep the order of partitions within a queue. Only sums per partition and queue are shuffled: a token's
    place in its queue names its sequence, so no task sees more than its own documents, however large a source is.
    Repeated rows are separate documents, a NULL id stays NULL, other columns are ignored, no rows give no pieces.
    `tokenizer`: a file of the tokenizers library whose pre-tokenizer splits at white space and drops it."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").cast("string").alias("queue"))
    if proportions is None and own.select("queue").distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        half = MAX_QUEUES // 2
        size = own.groupBy("queue").agg(F.sum(F.octet_length("text")).alias("bytes"))
        large = [r["queue"] for r in size.orderBy(F.col("bytes").desc_nulls_last(), "queue").limit(half).collect()]
        named = F.col("queue").isin([q for q in large if q is not None])
        kept = F.coalesce(named, F.lit(None in large))
        own = own.withColumn("queue", F.when(kept, F.col("queue")).otherwise(F.concat(F.lit("shared "), F.pmod(F.xxhash64("queue"), F.lit(half)).cast("string"))))
    kind = own.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sums = WordEncoder.of(tokenizer), TaskContext.get().partitionId(), {}
        dtype = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            for a, b in slices(batch["text"]):
                rows = batch.slice(a, b - a)
                ids, at = encoder.encode(rows["text"])
                ids = np.insert(ids.astype(dtype), at[1:], end)
                at = at + np.arange(len(at))
                begin = []
                for queue, n in zip(rows["queue"].to_pylist(), np.diff(at).tolist(), strict=True):
                    begin.append(sums.get(queue, 0))
                    sums[queue] = begin[-1] + n
                flat = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), part), pa.int32()), rows["queue"], rows["doc_id"], flat.cast(pa.binary()), pa.array(np.diff(at)),
                    pa.array(begin, pa.int64()), pa.array(np.full(len(rows), ids.itemsize), pa.int32())],
                    names=["part", "queue", "doc_id", "ids", "n", "begin", "width"])
            release()

    encoded = cut(own.mapInArrow(encode, f"part int, queue string, doc_id {kind.simpleString()}, ids binary, n long, begin long, width int"))
    sums = encoded.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    starts = sums.select("part", "queue", (F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")).alias("base"))
    queues = sorted(((r["queue"], r["n"]) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    names = {q: i for i, (q, _) in enumerate(queues)}
    totals = np.array([n for _, n in queues], np.int64)
    shares = totals.astype(float) if proportions is None else np.array([float(proportions.get(q, 0)) for q, _ in queues])
    fields = f"doc_id {kind.simpleString()}, {PIECES}" + (", ids array<int>" if keep_ids else "")
    if not queues:
        return spark.createDataFrame([], fields)
    sent = spark.sparkContext.broadcast(Plan(totals, sequence, shares))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        cuts = lru_cache(16)(plan.cuts)
        names_ = ["doc_id", *_NAMES, *(["ids"] if keep_ids else [])]

        def pieces(out: list[list]) -> pa.RecordBatch:
            arrays = [pa.array(out[0], id_type), *(pa.array(c, pa.int64()) for c in out[1:7])]
            if keep_ids:
                flat = np.concatenate(out[7]) if out[7] else np.zeros(0, np.int32)
                ends = np.cumsum([0] + [len(p) for p in out[7]]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return pa.RecordBatch.from_arrays(arrays, names=names_)

        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            held = 0
            for row in zip(*(batch[c] for c in ("doc_id", "queue", "ids", "width")), batch["n"].to_pylist(),
                           batch["begin"].to_pylist(), batch["base"].to_pylist(), strict=True):
                doc, queue, packed, width, n, begin, base = row
                q, first = names[queue.as_py()], begin + base
                ids = np.frombuffer(packed.as_buffer(), np.uint16 if width.as_py() == 2 else np.uint32).astype("<u4")
                raw, at, doc = memoryview(ids).cast("B"), 0, doc.as_py()
                while at < n:
                    k = int(np.searchsorted(plan.edges[:, q], first + at, "right")) - 1
                    edges, offsets = cuts(k)
                    column = edges[:, q]
                    w = int(np.searchsorted(column, first + at, "right")) - 1
                    stop = min(n, int(column[w + 1]) - first)
                    values = (doc, at, stop - at, zlib.crc32(raw[4 * at:4 * stop]), n, k * plan.stretch + w,
                              int(offsets[w, q]) + first + at - int(column[w]))
                    for column_, value in zip(out, values, strict=False):
                        column_.append(value)
                    if keep_ids:
                        out[7].append(ids[at:stop].astype(np.int32))
                    at = stop
                held += n
                if keep_ids and held >= BATCH_IDS:
                    yield pieces(out)
                    out, held = [[] for _ in range(8)], 0
            yield pieces(out)

    small = sums.count() <= MAX_BROADCAST
    starts = starts.withColumnRenamed("part", "p").withColumnRenamed("queue", "q")
    met = encoded.join(F.broadcast(starts) if small else starts, (F.col("part") == F.col("p")) & F.col("queue").eqNullSafe(F.col("q")))
    return met.select("doc_id", "queue", "ids", "width", "n", "begin", "base").mapInArrow(lean(place), fields)


_NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pieces with ids. A sequence is bounded, so is the group."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
