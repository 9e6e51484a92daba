"""Operator 10: passages that repeat anywhere in the corpus, found with fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange as X
from quern.llm.words import Windows, buffer, starts, words

RESULT = "n_words long, n_removed long, kept_sha256 string"


def _anchors(texts: pa.ChunkedArray, size: int, n_buckets: int):
    data, offsets = buffer(texts)
    hashes, first, last, at = words(data, offsets)
    begin = starts(at, size)
    found = X.Distinct(Windows(hashes).of(begin, begin + size), n_buckets)
    return data, hashes, first, last, at, begin, found


def _candidates(hashes, at, begin, found, reply: pa.Table, size: int, window: int):
    """Windows that hold an anchor hit: the only ones that can repeat."""
    hit = np.zeros(len(hashes) + 1, np.int64)
    hit[begin + 1] = found.answers(reply, np.uint8)[found.inverse]
    run = np.cumsum(hit)
    full = starts(at, window)
    return full[run[full + window - size + 1] > run[full]]


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35,
                      keep_text: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text.

    Words are runs of anything but [\\x20\\x09-\\x0D]. A word goes if it lies in a window of `window` words whose sequence
    begins anywhere else too, in another text or in the same one; windows are judged on the input. Kept words are joined
    by one space.

    Fixed-block anchors. Each text is cut into non-overlapping blocks of (window + 1) // 2 words: the index. A window of
    that length or more always holds one whole block of its own text, so two equal windows share a block of either.
    Every rolling window of the block's size probes the index; where a block occurs twice or more, all its occurrences
    are hits. A hit is extended by comparing every full window around it with all other such windows: runs of windows
    that occur twice make up the maximal exact repeats. Comparing goes by counts per window hash (64 bits and the bucket's
    bits of a second hash), so a passage in a third of all texts costs one entry per block of texts and no pairs. Word
    hashes have 64 bits.

    NULL and blank texts have no words: zeros, and the hash of the empty string. A NULL id stays NULL. Repeated rows are
    separate texts and repeat each other. Other columns are ignored."""
    size = (window + 1) // 2
    n_blocks, n_buckets = X.sizes(X.text_bytes(docs, text))
    dealt = X.blocks(docs, {"doc_id": doc_id, "text": text}, n_blocks)

    def ask_anchors(table: pa.Table) -> pa.Table:
        *_, at, begin, found = _anchors(table["text"], size, n_buckets)
        own = np.repeat(at[:-1], np.diff(at))[begin]
        index = found.any((begin - own) % size == 0)
        return found.questions(table["block"][0].as_py(), (index * 2 + (found.count > 1)).astype(np.uint8))

    def decide_anchors(order, first, values):
        occurs = np.add.reduceat(1 + (values[order] & 1), first)
        index = np.bitwise_or.reduceat(values[order], first) & 2
        return ((occurs > 1) & (index > 0)).astype(np.uint8)

    def ask_windows(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.Distinct(np.zeros(0, np.uint64), n_buckets).questions(0, np.zeros(0, np.uint8), whole=True)
        _, hashes, _, _, at, begin, found = _anchors(table["text"], size, n_buckets)
        near = _candidates(hashes, at, begin, found, reply, size, window)
        full = X.Distinct(Windows(hashes).of(near, near + window), n_buckets,
                          Windows(hashes, second=True).of(near, near + window))
        return full.questions(table["block"][0].as_py(), (full.count > 1).astype(np.uint8), whole=True)

    def decide_windows(order, first, values):
        return (np.add.reduceat(1 + values[order], first) > 1).astype(np.uint8)

    def finish(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], id_type), **{n: pa.array([], t) for n, t in fields}})
        stage = reply["stage"].to_numpy()
        data, hashes, begin_b, end_b, at, begin, found = _anchors(table["text"], size, n_buckets)
        near = _candidates(hashes, at, begin, found, reply.filter(pa.array(stage == 1)), size, window)
        full = X.Distinct(Windows(hashes).of(near, near + window), n_buckets,
                          Windows(hashes, second=True).of(near, near + window))
        twice = near[full.answers(reply.filter(pa.array(stage == 2)), np.uint8)[full.inverse] > 0]
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + window, -1)
        gone = np.cumsum(step)[:-1] > 0
        removed = np.concatenate(([0], np.cumsum(gone)))
        digests, kept = [], []
        space = memoryview(data.tobytes())
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            stay = np.flatnonzero(~gone[a:b]) + a
            line = b" ".join(space[x:y] for x, y in zip(begin_b[stay].tolist(), end_b[stay].tolist(), strict=True))
            digests.append(hashlib.sha256(line).hexdigest())
            if keep_text:
                kept.append(line.decode())
        out = {"doc_id": table["doc_id"], "n_words": np.diff(at), "n_removed": removed[at[1:]] - removed[at[:-1]],
               "kept_sha256": digests}
        return pa.table(out | ({"kept_text": kept} if keep_text else {}))

    kind = dealt.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(kind)
    fields = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept_text", pa.string())] if keep_text else []
    schema = f"doc_id {kind.simpleString()}, {RESULT}" + (", kept_text string" if keep_text else "")
    anchors = (dealt.groupBy("block").applyInArrow(ask_anchors, X.QUESTION)
               .groupBy("bucket").applyInArrow(X.answerer(np.uint8, decide_anchors), X.ANSWER))
    repeats = (dealt.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(ask_windows, X.QUESTION)
               .groupBy("bucket").applyInArrow(X.answerer(np.uint8, decide_windows, whole=True), X.ANSWER))
    replies = anchors.withColumn("stage", F.lit(1)).unionByName(repeats.withColumn("stage", F.lit(2)))
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, schema)
