"""Operator 6: documents that hold passages of benchmark items, by a prefix-filtered set join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.ship import ship
from quern.llm.exchange import cut, slices
from quern.llm.memory import lean
from quern.llm.words import ALNUM, Windows, buffer, words

SHINGLE = 3
INDEX_WINDOWS = 200_000  # windows sent to the executors at once; a larger benchmark is taken in blocks of so many


def _shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every shingle of `size` words inside a text."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1])
    begin = np.flatnonzero(left >= size)
    return begin, Windows(hashes).of(begin, begin + size)


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows of all items: `length`, `hashes` (of its words, packed), `window` (their digest), `item` (the id
    as text). An item of fewer words than `window` is one window; an item without words has none."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            hashes, _, _, at = words(*buffer(batch["text"]), ALNUM, lower=True)
            for item, a, b in zip(batch["item"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for i in range(a, max(b - window, a) + 1 if b > a else a):
                    part = hashes[i:min(i + window, b)].tobytes()
                    rows.append((len(part) // 8, part, hashlib.blake2b(part, digest_size=16).digest(), item))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int32(), pa.binary(), pa.binary(), pa.string()))], names=["length", "hashes", "window", "item"])
    ship(benchmark.sparkSession)
    own = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(lean(each), "length int, hashes binary, window binary, item string").distinct()


class Index:
    """Windows under the rarest shingle of each: the prefix that a text cannot lack if it holds the whole window.

    A set that must be contained in full needs a prefix of one element. Windows of 3 words or more have word triples as
    elements, shorter ones have single words or pairs."""

    def __init__(self, rows: list[dict], frequency: dict[int, int]) -> None:
        self.items: list[list[str]] = [sorted(i for i in r["items"] if i is not None) for r in rows]
        self.hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        entries = []
        for number, own in enumerate(self.hashes):
            size = min(SHINGLE, len(own))
            begin, keys = _shingles(own, np.array([0, len(own)]), size)
            offset, key = min(zip(begin.tolist(), keys.tolist(), strict=True), key=lambda x: (frequency.get(x[1], 0), x[1], x[0]))
            entries.append((size, key, offset, number))
        self.by_size = {}
        for size in {e[0] for e in entries}:
            own = sorted(e[1:] for e in entries if e[0] == size)
            self.by_size[size] = (np.array([e[0] for e in own], np.uint64), np.array([e[1] for e in own]), np.array([e[2] for e in own]))

    def occurrences(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window number of every occurrence in texts with words `hashes` and offsets `at`."""
        firsts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.repeat(at[1:], np.diff(at))
        heads = np.repeat(at[:-1], np.diff(at))
        for size, (keys, offsets, window) in self.by_size.items():
            begin, probes = _shingles(hashes, at, size)
            table = _table(keys)
            near = np.flatnonzero(table[probes >> np.uint64(48)])  # few probes are left to look up
            begin, probes = begin[near], probes[near]
            low, high = np.searchsorted(keys, probes), np.searchsorted(keys, probes, "right")
            hits = np.flatnonzero(high > low)
            many = (high - low)[hits]
            entry = np.repeat(low[hits] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            place = np.repeat(begin[hits], many)
            first = place - offsets[entry]
            length = np.array([len(self.hashes[w]) for w in window[entry].tolist()], np.int64)
            inside = (first >= heads[place]) & (first + length <= ends[place])  # positional and length bounds
            first, number = first[inside], window[entry][inside]
            same = [np.array_equal(hashes[f:f + len(self.hashes[n])], self.hashes[n])
                    for f, n in zip(first.tolist(), number.tolist(), strict=True)]
            firsts.append(first[same])
            numbers.append(number[same])
        return np.concatenate(firsts), np.concatenate(numbers)


def _table(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(65536, bool)
    out[keys >> np.uint64(48)] = True
    return out


def _frequencies(docs: DataFrame, text: str, windows: DataFrame) -> dict[int, int]:
    """How often the windows' shingles occur in all of `docs`; only shingles of the given windows are counted."""
    spark = docs.sparkSession
    known = [np.frombuffer(r["hashes"], np.uint64) for r in windows.select("hashes").collect()]
    wanted = {}
    for size in range(1, SHINGLE + 1):
        keys = [_shingles(w, np.array([0, len(w)]), size)[1] for w in known if min(SHINGLE, len(w)) == size]
        if keys:
            wanted[size] = np.unique(np.concatenate(keys))
    sent = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {size: np.zeros(len(keys), np.int64) for size, keys in sent.value.items()}
        for batch in batches:
            for a, b in slices(batch["text"]):
                hashes, _, _, at = words(*buffer(batch["text"].slice(a, b - a)), ALNUM, lower=True)
                for size, keys in sent.value.items():
                    probes = _shingles(hashes, at, size)[1]
                    probes = probes[_table(keys)[probes >> np.uint64(48)]]
                    place = np.minimum(np.searchsorted(keys, probes), len(keys) - 1)
                    total[size] += np.bincount(place[keys[place] == probes], minlength=len(keys))
        for size, keys in sent.value.items():
            seen = np.flatnonzero(total[size])
            yield pa.RecordBatch.from_arrays([pa.array(keys[seen].view(np.int64)), pa.array(total[size][seen])], names=["key", "n"])

    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(lean(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"] % (1 << 64): r["n"] for r in rows.collect()}


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  index_windows: int = INDEX_WINDOWS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A-Z are taken as a-z; words are runs of [0-9a-z] and characters beyond ASCII. A window is `window` consecutive words of
    an item, or the whole item if it has fewer. A document word is hit if an occurrence of a window covers it; n_items
    counts the items with a window in the document, items_sha256 is over their ids, sorted as text and comma-joined.

    Prefix-filtered join. Shingles of three words are ordered by rarity in all documents. A text that contains a window
    contains the window's rarest shingle, so only that one is indexed and probed with every shingle of every text; the
    window's place must lie inside the text; then all its words are compared (64 bits each).

    The index goes to the executors in blocks of at most `index_windows` windows, so its size is bounded whatever the
    benchmark's; one block needs no shuffle, more blocks are one scan each and meet by document.

    NULL or blank texts have no words. An item with a NULL id counts for hits and not for n_items. Repeated rows are
    answered alike, repeated items are one. An empty benchmark leaves every document clean. Other columns are ignored."""
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_id, item_text, window).groupBy("window").agg(
        F.first("hashes").alias("hashes"), F.collect_set("item").alias("items")).drop("length")
    windows = cut(windows)
    n_blocks = max(1, -(-windows.count() // index_windows))
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["doc_id"].dataType
    if n_blocks > 1:
        own = own.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = []
    for block in range(n_blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block)
        index = Index([r.asDict() for r in part.collect()], _frequencies(docs, text, part))
        found.append(_scan(own, spark.sparkContext.broadcast(index), to_arrow_type(kind), kind.simpleString(), n_blocks > 1))
    if n_blocks == 1:
        return found[0]
    return _merge(own, found, to_arrow_type(kind))


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _covered(first: list[int], length: list[int]) -> int:
    n, end = 0, -1
    for a, m in sorted(zip(first, length, strict=True)):
        n += max(0, a + m - max(a, end))
        end = max(end, a + m)
    return n


def _scan(own: DataFrame, sent, id_type: pa.DataType, kind: str, parts: bool) -> DataFrame:
    """Without `parts` the result rows; with them the hits of this block of windows, for distinct texts that have any."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for a, b in slices(batch["text"]):
                rows = batch.slice(a, b - a)
                hashes, _, _, at = words(*buffer(rows["text"]), ALNUM, lower=True)
                first, number = index.occurrences(hashes, at)
                text_of = np.searchsorted(at, first, "right") - 1
                hits: dict[int, list[tuple[int, int]]] = {}
                for t, f, n in zip(text_of.tolist(), first.tolist(), number.tolist(), strict=True):
                    hits.setdefault(t, []).append((f - int(at[t]), n))
                if parts:
                    own_hits = list(hits.items())
                    yield pa.RecordBatch.from_arrays([
                        pa.array([rows["text_key"][t].as_py() for t, _ in own_hits], pa.string()),
                        pa.array([[f for f, _ in h] for _, h in own_hits], pa.list_(pa.int64())),
                        pa.array([[len(index.hashes[n]) for _, n in h] for _, h in own_hits], pa.list_(pa.int64())),
                        pa.array([sorted({i for _, n in h for i in index.items[n]}) for _, h in own_hits], pa.list_(pa.string())),
                    ], names=["text_key", "first", "length", "items"])
                    continue
                n_hit, n_items = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
                digest = [_NONE] * (len(at) - 1)
                for t, h in hits.items():
                    items = sorted({i for _, n in h for i in index.items[n]})
                    n_hit[t] = _covered([f for f, _ in h], [len(index.hashes[n]) for _, n in h])
                    n_items[t], digest[t] = len(items), _digest(items)
                yield pa.RecordBatch.from_arrays([rows["doc_id"], pa.array(np.diff(at)), pa.array(n_hit), pa.array(n_items),
                                                  pa.array(digest), pa.array(n_hit > 0)], names=_NAMES)
    if parts:
        return own.mapInArrow(lean(scan), "text_key string, first array<long>, length array<long>, items array<string>")
    return own.mapInArrow(lean(scan), f"doc_id {kind}, {_FIELDS}")


_NONE = _digest([])
_FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def _merge(own: DataFrame, found: list[DataFrame], id_type: pa.DataType) -> DataFrame:
    """Hits of all blocks of windows, met by text."""
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)

    def meet(table: pa.Table) -> pa.Table:
        first, length, items = (sum(table[c].to_pylist(), []) for c in ("first", "length", "items"))
        items = sorted(set(items))
        return pa.table({"text_key": [table["text_key"][0].as_py()], "n_hit": pa.array([_covered(first, length)], pa.int64()),
                         "n_items": pa.array([len(items)], pa.int64()), "items_sha256": [_digest(items)]})

    met = hits.dropDuplicates().groupBy("text_key").applyInArrow(lean(meet), "text_key string, n_hit long, n_items long, items_sha256 string")
    counted = own.select("doc_id", "text_key", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                rows = batch.slice(a, b - a)
                at = words(*buffer(rows["text"]), ALNUM, lower=True)[3]
                yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["text_key"], pa.array(np.diff(at))], names=["doc_id", "text_key", "n_words"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(lean(count), f"doc_id {kind}, text_key string, n_words long").join(met, "text_key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(_NONE)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` without the rows whose text is contaminated. Rows are told apart by the digest of their text, so ids may be
    NULL or repeat."""
    key = "text_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    found = contamination(keyed, benchmark, key, text, **options).where("contaminated").select(F.col("doc_id").alias(key))
    return keyed.join(found.distinct(), key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
