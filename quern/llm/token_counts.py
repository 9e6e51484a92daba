"""Operator 9: token counts of fields and sections, from one encoding of the whole document."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.ship import ship
from quern.llm.exchange import slices
from quern.llm.words import buffer

COUNTS = "field string, section int, begin long, finish long, n_tokens long, n_crossing long"


class Ranks:
    """A byte-level vocabulary of ranks, and the bytes of each of its tokens."""

    _own: dict[str, Ranks] = {}

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    @classmethod
    def of(cls, path: str, pattern: str) -> Ranks:
        """One for each worker process."""
        if path not in cls._own:
            cls._own[path] = cls(path, pattern)
        return cls._own[path]


def section_tokens(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", fields: tuple[str, ...] = ("text",),
                   rule: str = "first") -> DataFrame:
    """One row per section: doc_id, field, section, begin, finish, n_tokens, n_crossing.

    A document is its `fields` joined by a line break, and is encoded once as a whole. A section is a line of a field with
    the line break that ends it; `begin` and `finish` are its code points in the document. The byte spans of tokens meet
    the spans of sections by binary search. n_crossing counts a section's tokens that also lie in another section. Rule for
    those: "first" gives a token to the section of its first byte, "last" to that of its last byte. So the counts of a
    document add up to its tokens.

    Each field has at least one section; NULL is an empty field. A NULL id stays NULL, repeated rows are counted alike, other
    columns are ignored, no rows give no sections. `ranks`: file of a byte-level vocabulary; `pattern`: how it splits texts."""
    ship(docs.sparkSession)
    if rule not in ("first", "last"):
        raise ValueError(f"no such rule: {rule}")
    parts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.concat_ws("\n", *parts).alias("text"),
                      F.array(*(F.octet_length(p).cast("long") for p in parts)).alias("sizes"))
    kind = own.schema["doc_id"].dataType
    id_type, named = to_arrow_type(kind), list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ranks.of(ranks, pattern)
        for batch in batches:
            for a, b in slices(batch["text"]):
                rows = batch.slice(a, b - a)
                data, offsets = buffer(rows["text"])
                ids = np.array([i for text in rows["text"].to_pylist() for i in known.encoding.encode_ordinary(text)], np.int64)
                end = np.cumsum(known.length[ids])
                begin = end - known.length[ids]
                sizes = np.array(rows["sizes"].to_pylist(), np.int64).reshape(-1, len(named))
                heads = offsets[:-1, None] + np.concatenate((np.zeros((len(sizes), 1), np.int64), np.cumsum(sizes + 1, axis=1)[:, :-1]), axis=1)
                lines = np.flatnonzero(data == 10) + 1
                inner = lines[~np.isin(lines, np.concatenate((heads.ravel(), offsets[1:])))]
                head = np.concatenate((heads.ravel(), inner))
                owner = np.searchsorted(heads.ravel(), inner, "right") - 1
                order = np.argsort(np.concatenate((np.arange(heads.size), owner)) * (len(data) + 1) + head, kind="stable")
                head, field = head[order], np.concatenate((np.arange(heads.size), owner))[order]
                low, high = (np.searchsorted(head, x, "right") - 1 for x in (begin, end - 1))
                taken = low if rule == "first" else high
                first = np.searchsorted(field, field)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                doc = field // len(named)
                stop = np.append(head[1:], len(data))
                yield pa.RecordBatch.from_arrays([
                    rows["doc_id"].take(pa.array(doc)), pa.array([named[f] for f in (field % len(named)).tolist()], pa.string()),
                    pa.array(np.arange(len(field)) - first, pa.int32()), pa.array(chars[head] - chars[offsets[doc]]),
                    pa.array(chars[stop] - chars[offsets[doc]]),
                    pa.array(np.bincount(taken, minlength=len(head))), pa.array(np.bincount(taken[low != high], minlength=len(head)))],
                    names=["doc_id", "field", "section", "begin", "finish", "n_tokens", "n_crossing"])

    return own.mapInArrow(count, f"doc_id {kind.simpleString()}, {COUNTS}")
