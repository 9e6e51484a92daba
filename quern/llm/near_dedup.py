"""Operator 1: near-duplicate classes by consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm import exchange as X
from quern.llm.components import components
from quern.llm.memory import lean
from quern.llm.words import Windows, buffer, mix, words

_U = np.uint64
OCTAVE = 7  # steps of a document frequency's code in each doubling; code 0: only one document has the shingle
DAMPING = 4
CHUNK = 50_000  # elements of the vectors compared with one another in one go
VECTOR = 50  # elements that a vector counts for besides its own, so that a chunk holds no more than CHUNK / VECTOR vectors or so


def _shingles(texts: pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and n + 1 offsets. A text of fewer words is one shingle; a text of none has none."""
    hashes, _, _, at = words(*buffer(texts), lower=True)
    count = np.diff(at)
    each = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    out = np.concatenate(([0], np.cumsum(each)))
    begin = np.arange(out[-1]) - np.repeat(out[:-1] - at[:-1], each)
    end = np.minimum(begin + size, np.repeat(at[1:], each))
    return Windows(hashes).of(begin, end), out


def _documents(found: X.Distinct, owner: np.ndarray) -> np.ndarray:
    """In how many texts of the block each distinct shingle is."""
    many = found.count > 1
    n = found.count.astype(np.int64)
    at = np.flatnonzero(many[found.inverse])
    if len(at):
        pairs = np.unique(found.inverse[at] * np.int64(owner[-1] + 1) + owner[at])
        n[many] = np.bincount(pairs // (owner[-1] + 1), minlength=len(n))[many]
    return n


def idf(code: np.ndarray, n_docs: int) -> np.ndarray:
    """1 + ln(N / df) / (DAMPING ln N). Copying itself makes a group's shingles common; damping keeps its few edited
    shingles from outweighing them."""
    df = np.exp2(code.astype(np.float64) / OCTAVE)
    return (1 + np.maximum(0, np.log(n_docs / df)) / (DAMPING * math.log(max(n_docs, 3)))).astype(np.float32)


def signature(keys: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """k samples of a weighted set (Ioffe's improved consistent weighted sampling): two sets share a sample with the
    probability of their weighted Jaccard similarity. Gamma(2, 1) variates come from a table of quantiles indexed by bits
    of the key's hash, so every task draws the same ones."""
    gamma, log_gamma = _gamma()
    out, log_w, low = np.empty(k, np.uint64), np.log(weights).astype(np.float32), _U(0xFFFF)
    for i in range(k):
        h = mix(keys ^ _U((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        r = gamma[h & low]
        t = np.floor(log_w / r + ((h >> _U(16)) & low).astype(np.float32) * np.float32(2 ** -16))
        best = int(np.argmin(log_gamma[(h >> _U(32)) & low] - r * (t + 1 - ((h >> _U(16)) & low) * np.float32(2 ** -16))))
        out[i] = mix(np.array([h[best] ^ _U(int(t[best]) & 0xFFFF)]))[0]
    return out


_GAMMA: list[np.ndarray] = []


def _gamma() -> list[np.ndarray]:
    if not _GAMMA:
        x = np.linspace(0, 24, 1_000_001)
        table = np.interp((np.arange(65536) + 0.5) / 65536, 1 - np.exp(-x) * (1 + x), x).astype(np.float32)
        _GAMMA.extend([table, np.log(table)])
    return _GAMMA


KEY = 6  # bytes of a shingle's hash in a vector; within two texts they are distinct enough


def _elements(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and how often the text has each."""
    low = np.frombuffer(keys, np.uint8).reshape(-1, KEY)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :KEY] = low
    k = full.view(np.uint64).ravel()
    return k, (np.frombuffer(times, np.uint32) if times else np.ones(len(k), np.uint32))


def _expanded(keys: bytes, codes: bytes, times: bytes, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The same vector as a set: the j-th occurrence of a shingle is an element with the shingle's idf as weight. Weighted
    Jaccard similarity of tf-idf vectors is that of these sets."""
    k, t = _elements(keys, times)
    w = idf(np.frombuffer(codes, np.uint8), n_docs)
    if not times:
        return k, w
    nth = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
    return np.repeat(k, t) + mix(nth.astype(np.uint64)) * (nth > 0), np.repeat(w, t)


def _similar(a: tuple, b: tuple, n_docs: int) -> float:
    (ka, wa), (kb, wb) = _expanded(*a, n_docs), _expanded(*b, n_docs)
    both, at, _ = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = float(wa[at].sum())
    return shared / (float(wa.sum()) + float(wb.sum()) - shared)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8,
                    bands: int = 16, rows: int = 4) -> DataFrame:
    """One row per row of `docs`: doc_id and class_id, the smallest id of its class.

    A class is a connected component of links; two texts are linked if the weighted Jaccard similarity of their TF-IDF
    vectors of `size`-word shingles is `similarity` or more. Words are runs of anything but [\\x20\\x09-\\x0D], A-Z taken as
    a-z. Document frequencies count all rows of `docs`, copies included (shingles are keyed by 40 bits and their bucket's).

    1. Each block of texts learns the document frequency of its shingles (see exchange.py). A text with less than
       `similarity` of its weight in shingles that another text has cannot be linked, so its search ends here.
    2. Equal vectors are one vector. Each gets bands x rows samples by improved consistent weighted sampling; vectors
       that agree on all samples of a band share a bucket. With 16 x 4, a pair at 0.8 is missed with probability 2e-4.
    3. Each vector is compared with the most popular pivot of its buckets, so a hot bucket costs one comparison a member.
    4. Buckets that still hold several components are compared in full between the members outside the pivot's component
       and all members, chunk against chunk, as matrix products: no link inside a bucket is lost, no pairs are emitted.

    NULL, empty and blank texts have no shingles: each row is a class of its own. A NULL id is NULL in both columns unless
    its class has another id. Repeated rows are copies of one another. Other columns are ignored."""
    n_blocks, n_buckets = X.sizes(X.text_bytes(docs, text))
    n_docs = max(docs.where(F.trim(F.col(f"`{text}`")) != "").count(), 3)
    dealt = X.blocks(docs, {"doc_id": doc_id, "text": text}, n_blocks)
    kind = dealt.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def ask(table: pa.Table) -> pa.Table:
        hashes, at = _shingles(table["text"], size)
        found = X.Distinct(hashes, n_buckets)
        n = _documents(found, np.repeat(np.arange(len(at) - 1), np.diff(at)))
        return found.questions(table["block"][0].as_py(), n.astype(np.uint32))

    def decide(order, first, values):
        df = np.add.reduceat(values[order].astype(np.int64), first)
        return np.minimum(255, np.rint(OCTAVE * np.log2(df))).astype(np.uint8)

    names = ["doc_id", "vector", "weight", "keys", "codes", "times"]
    types = [id_type, pa.binary(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]

    def weigh(table: pa.Table, reply: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if table.num_rows:
            hashes, at = _shingles(table["text"], size)
            found = X.Distinct(hashes, n_buckets)
            code = found.answers(reply, np.uint8)[found.inverse]
            w = idf(code, n_docs).astype(np.float64)
            total, shared = (np.concatenate(([0.0], np.cumsum(x))) for x in (w, w * (code > 0)))
            seen = set()
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                row = (None,) * 5
                if b > a and shared[b] - shared[a] >= similarity * (total[b] - total[a]) - 1e-6:
                    keys, place, times = np.unique(hashes[a:b] >> _U(64 - 8 * KEY), return_index=True, return_counts=True)
                    t = b"" if len(keys) == b - a else times.astype(np.uint32).tobytes()
                    vector = hashlib.blake2b(keys.tobytes() + t, digest_size=16).digest()
                    row = (vector, None, None, None, None)
                    if vector not in seen:
                        seen.add(vector)
                        packed = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()
                        row = (vector, total[b] - total[a], packed, code[a:b][place].tobytes(), t)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        ids = table["doc_id"] if table.num_rows else pa.array([], id_type)
        return pa.table([ids, *(pa.array(c, t) for c, t in zip(out, types[1:], strict=True))], names=names)

    answers = (dealt.groupBy("block").applyInArrow(lean(ask), X.QUESTION)
               .groupBy("bucket").applyInArrow(lean(X.answerer(np.uint32, decide)), X.ANSWER))
    every = X.cut(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lean(weigh), f"doc_id {kind.simpleString()}, vector binary, weight double, keys binary, codes binary, times binary"))
    vectors = X.cut(every.where("keys is not null").groupBy("vector").agg(
        *(F.first(c).alias(c) for c in ("weight", "keys", "codes", "times"))))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, codes, times in zip(*(batch[c] for c in ("keys", "codes", "times")), strict=True):
                k, t = _elements(key.as_buffer(), times.as_py())
                drawn = signature(k, idf(np.frombuffer(codes.as_buffer(), np.uint8), n_docs) * t, bands * rows)
                run = np.zeros(bands, np.uint64)
                for i in range(rows):
                    run = mix(run + drawn.reshape(bands, rows)[:, i])
                out.append(mix(run + np.arange(bands, dtype=np.uint64)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["vector"], pa.array(out, pa.list_(pa.int64()))],
                                             names=["vector", "band"])

    held = X.cut(vectors.mapInArrow(lean(sample), "vector binary, band array<long>")
                 .select("vector", F.explode("band").alias("band")))
    sizes = held.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = held.join(sizes, "band")
    popular = shared.groupBy("vector").agg(F.sum("n").alias("popular"))
    placed = X.cut(shared.select("band", "vector").join(popular, "vector"))
    pivots = placed.groupBy("band").agg(F.max(F.struct("popular", "vector")).alias("pivot"))
    looks = (placed.join(pivots, "band").groupBy("vector").agg(F.max("pivot").alias("pivot"))
             .select(F.col("vector").alias("a"), F.col("pivot.vector").alias("b")).where("a <> b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [list(zip(*(batch[f"{s}_{c}"].to_pylist() for c in ("keys", "codes", "times")), strict=True)) for s in "ab"]
            keep = pa.array([_similar(x, y, n_docs) >= similarity for x, y in zip(*sides, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    side = {s: vectors.select(F.col("vector").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("keys", "codes", "times")))
            for s in "ab"}
    stars = X.cut(looks.join(side["a"], "a").join(side["b"], "b").mapInArrow(lean(compare), "a binary, b binary"))
    found = components(stars)

    # Buckets that hold more than one component: those outside the pivot's component against all.
    named = placed.join(found.select(F.col("node").alias("vector"), "component"), "vector", "left").select(
        "band", "vector", F.coalesce("component", "vector").alias("component"))
    main = pivots.join(found.withColumnRenamed("node", "p"), F.col("pivot.vector") == F.col("p"), "left").select(
        "band", F.coalesce("component", "pivot.vector").alias("main"))
    lengths = vectors.select("vector", (F.octet_length("keys") / KEY).cast("long").alias("n"))
    mixed = (named.join(lengths, "vector").groupBy("band").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.ceil(F.sum(F.col("n") + VECTOR) / CHUNK).cast("int").alias("chunks")).where("low <> high").join(main, "band"))
    members = X.cut(named.join(mixed, "band").select(
        "band", "vector", "component", "chunks", (F.col("component") != F.col("main")).alias("outside"),
        F.pmod(F.xxhash64("vector"), "chunks").cast("int").alias("chunk")))
    packed = F.struct("vector", "component", "outside", "keys", "codes", "times")
    units = members.join(vectors.drop("weight"), "vector")
    left = units.where("outside").select("band", F.col("chunk").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(0).alias("side"), packed.alias("v"))
    right = units.select("band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side"), packed.alias("v"))

    def products(table: pa.Table) -> pa.Table:
        side, rows_ = table["side"].to_numpy(), table["v"].to_pylist()
        left_, right_ = ([r for r, s in zip(rows_, side, strict=True) if s == k] for k in (0, 1))
        a, b = [], []
        if left_ and right_:
            score = _products(left_, right_, n_docs)
            for x, line in zip(left_, score, strict=True):
                linked: set = {x["component"]}
                for y in np.flatnonzero(line >= similarity):
                    if right_[y]["component"] not in linked:
                        linked.add(right_[y]["component"])
                        a.append(x["vector"])
                        b.append(right_[y]["vector"])
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    more = X.cut(left.unionByName(right).groupBy("band", "i", "j").applyInArrow(lean(products), "a binary, b binary"))
    joined = named.select(F.col("vector").alias("node"), "component").distinct()
    if not more.isEmpty():  # these links are between components
        between = more.join(joined.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(
            joined.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
        merged = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
        joined = joined.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component"))

    classes = (every.where("vector is not null").groupBy("vector").agg(F.min("doc_id").alias("least"))
               .join(joined.withColumnRenamed("node", "vector"), "vector", "left")
               .withColumn("component", F.coalesce("component", "vector")))
    least = classes.groupBy("component").agg(F.min("least").alias("class_id"))
    named = classes.join(least, "component").select("vector", "class_id")
    return every.select("doc_id", "vector").join(named, "vector", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _products(left: list[dict], right: list[dict], n_docs: int) -> np.ndarray:
    """Weighted Jaccard similarities of all on the left with all on the right, by columns of a few thousand elements."""
    sides = [[_expanded(r["keys"], r["codes"], r["times"], n_docs) for r in side] for side in (left, right)]
    totals = [np.array([w.sum() for _, w in side], np.float64) for side in sides]
    keys = np.concatenate([k for side in sides for k, _ in side])
    every, place = np.unique(keys, return_inverse=True)
    weight = np.zeros(len(every), np.float32)
    weight[place] = np.concatenate([w for side in sides for _, w in side])
    rows = np.repeat(np.arange(len(left) + len(right)), [len(k) for side in sides for k, _ in side])
    order = np.argsort(place, kind="stable")
    place, rows = place[order], rows[order]
    shared = np.zeros((len(left), len(right)), np.float64)
    step = max(256, 4_000_000 // (len(left) + len(right)))
    for at in range(0, len(every), step):
        a, b = np.searchsorted(place, (at, at + step))
        dense = np.zeros((len(left) + len(right), step), np.float32)
        dense[rows[a:b], place[a:b] - at] = 1
        block = np.zeros(step, np.float32)
        block[:min(step, len(every) - at)] = weight[at:at + step]
        shared += (dense[:len(left)] * block) @ dense[len(left):].T
    return shared / (totals[0][:, None] + totals[1][None, :] - shared)


MAX_BROADCAST = 1_000_000  # keys of removed rows sent to all; more are joined by shuffle


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with one row of each class. Rows are told apart by their id and the digest of their text, so an id may be NULL or
    repeat; rows that agree in both stay once. Texts without words stay."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    ident, words_ = F.col(f"`{doc_id}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    keyed = docs.withColumn(key, F.concat(F.coalesce(F.concat(ident, F.lit("=")), F.lit("")), words_))
    found = X.cut(near_duplicates(keyed, key, text, **options))
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias(key)).distinct()
    if found.count() > found.select("doc_id").distinct().count():
        keyed = keyed.dropDuplicates([key])
    small = gone.count() <= MAX_BROADCAST
    return keyed.join(F.broadcast(gone) if small else gone, key, "left_anti").select(*(f"`{c}`" for c in docs.columns))
