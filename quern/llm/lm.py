"""Operator 7: log probabilities of texts under a hashed maximum-entropy language model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm import exchange as X
from quern.llm.words import SPACED, buffer, mix, words

_U = np.uint64
CLASSES = 32  # word classes; the end of a text is one more
SLOTS = 1024  # hashed words before the predicted one
PAIRS = 8192  # hashed (word before, class before that)
SHARDS = 8  # of the statistics that the model is trained on; their size is fixed
FAN = 64  # blocks, and then sums of blocks, whose statistics are added up together
DEEP = 10  # decisions between the words of a class, at most; two more than the largest class needs if that is less
ROUNDS = ((0,), (1, 2))  # features of words that are fitted together: the word before; both words before, the word before the last
SMOOTH = 4.0  # expected decisions that a weight's observed ones are mixed with
BITS = 16  # of the place of a weight, beyond a sixth of the bits of the number of bytes
PIECE = 1 << 13  # weights whose sums are one row
TASK_BYTES = 128 << 20  # of text for each task that learns; its sums have the size of the weights
AT_ONCE = 1 << 14  # tokens
END, START, SKIP = _U(0x7E5F3A1C9B2D4E61), _U(0x51ED270B4C7F9A13), _U(0x3C79AC492BA7B653)
_NODE, _CELL, _FIVE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), 5  # 2 ** _FIVE classes
_ONES, _PART = 1 << 27, float(1 << 20)  # sums stay exact doubles: a count, the ones among it, expected ones in steps of 2 ** -20
SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_Y = CLASSES + 1  # classes with the end; also the value of "before the first word"


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens with one end for each text, their classes, and n + 1 offsets of the texts."""
    data, offsets = buffer(texts)
    hashes, first, last, at = words(data, offsets, SPACED, lower=True)
    tail = data[last - 1].astype(np.uint64) | data[np.maximum(last - 2, first)].astype(np.uint64) << _U(8)
    kind = (mix(tail | _U(32) | _U(32 << 8)) % _U(CLASSES)).astype(np.int64)
    return np.insert(hashes, at[1:], END), np.insert(kind, at[1:], CLASSES), at + np.arange(len(at))


def _contexts(hashes: np.ndarray, kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Coarse context of every token, whose class counts are summed exactly: the slot of the word before it, and the class of the
    one before that. Whole words of the context are in `_features`."""
    slot = (mix(hashes) % _U(SLOTS - 1)).astype(np.int64) + 1
    before, skipped = np.empty_like(kind), np.empty_like(kind)
    before[1:], skipped[2:] = slot[:-1], kind[:-2]
    before[:1], skipped[:2] = 0, CLASSES
    start, n = at[:-1], len(kind)
    before[start] = 0
    skipped[start] = CLASSES
    second = start + 1
    skipped[second[second < n]] = CLASSES
    return before * _Y + skipped


class Model:
    """Class of the next token: softmax over weights of its coarse n-gram, skip and pair features and a bias. `Tree` adds the
    features of words."""

    def __init__(self) -> None:
        context = np.arange(SLOTS * _Y)
        self.word, self.skip = context // _Y, context % _Y
        self.pair = (mix(context.astype(np.uint64)) % _U(PAIRS)).astype(np.int64)
        self.weights = [np.zeros((n, _Y), np.float64) for n in (SLOTS, _Y, PAIRS, 1)]

    def log_probability(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        a, b, c, d = self.weights
        z = a[self.word[some]] + b[self.skip[some]] + c[self.pair[some]] + d
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradient(self, contexts: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the log likelihood of the given contexts' class counts."""
        lp = self.log_probability(contexts)
        rest = counts - counts.sum(axis=1, keepdims=True) * np.exp(lp)
        out = [np.zeros_like(w) for w in self.weights]
        for g, place in zip(out, (self.word, self.skip, self.pair, np.zeros_like(self.word)), strict=True):
            np.add.at(g, place[contexts], rest)
        return out, float((counts * lp).sum())


def _features(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of every token: the word before it, the two words before it, and the word that is left when the one before is skipped."""
    before = []
    for n in (1, 2):
        word = np.full(len(hashes), START)
        word[n:] = hashes[:-n]
        for place in (at[:-1] + j for j in range(n)):
            word[place[place < at[1:]]] = START
        before.append(word)
    return [mix(before[0]), mix(before[0] * _U(3) + mix(before[1])), mix(before[1] ^ SKIP)]


class Tree:
    """Next token as a path of two-way softmaxes: end or word, five decisions for the class, `depth` for bits of the hash.

    Without weights, the odds of the first six are the class model's in this context and those inside a class are the words'
    counts, so the path's probability is the class model's times the leaf's share of its class. Every feature adds a weight to
    every decision, which lies in its table under a hash of the feature's words and the decision. Words of one leaf keep the
    odds of their counts."""

    def __init__(self, model: Model, types: np.ndarray, mass: np.ndarray, bits: int) -> None:
        """`types` and `mass`: distinct words, and their occurrences, by class and DEEP bits."""
        largest = int(types[:CLASSES << DEEP].reshape(CLASSES, -1).sum(axis=1).max())
        self.depth = min(DEEP, (max(1, largest) - 1).bit_length() + 2)
        self.bits, self.levels = bits, _FIVE + self.depth
        self.mass = (mass + 0.5 * types)[:CLASSES << DEEP].reshape(CLASSES << self.depth, -1).sum(axis=1)
        self.mass[0] += 0.5  # the unknown word
        self.weights: list[np.ndarray | None] = [None] * 3
        inside = self._odds(self.mass)
        chance = np.exp(model.log_probability())
        chance[:, :CLASSES][:, self.mass.reshape(CLASSES, -1).sum(axis=1) == 0] = 0
        top = self._odds(chance[:, :CLASSES])
        top[:, 0] = np.log(chance[:, CLASSES] / chance[:, :CLASSES].sum(axis=1))
        self.top, self.inside = top.astype(np.float32).ravel(), inside.astype(np.float32)

    @staticmethod
    def _odds(leaves: np.ndarray) -> np.ndarray:
        """Log odds of a one at every inner node of a binary tree, by heap number; a side without words is never taken."""
        n = leaves.shape[-1]
        heap = np.zeros((*leaves.shape[:-1], 2 * n))
        heap[..., n:] = leaves
        for a in (1 << d for d in range(n.bit_length() - 2, -1, -1)):
            heap[..., a:2 * a] = heap[..., 2 * a:4 * a:2] + heap[..., 2 * a + 1:4 * a:2]
        out = np.zeros((*leaves.shape[:-1], n))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[..., 1:] = np.log(heap[..., 3::2]) - np.log(heap[..., 2::2])
        return np.nan_to_num(out, nan=0, posinf=40, neginf=-40)

    def leaf(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Leaf of every word; 0 for ends."""
        low = (hashes & _U((1 << DEEP) - 1)) >> _U(DEEP - self.depth)
        return np.where(classes == CLASSES, 0, classes << self.depth | low.astype(np.int64))

    def decisions(self, leaf: np.ndarray, ends: np.ndarray, context: np.ndarray, features: list[np.ndarray | None]
                  ) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]]:
        """Log odds, what was decided (0 or 1), and the place of each feature's weight; first of all tokens, then of all words."""
        for level in range(-1, self.levels):
            if level < 0:
                node, bit, z = None, ends.astype(np.int64), self.top.take(context << _FIVE)
            else:
                if level == 0:
                    own = ~ends
                    leaf, context, features = leaf[own], context[own] << _FIVE, [None if f is None else f[own] for f in features]
                node, bit = (leaf >> self.levels - level) + (1 << level), leaf >> self.levels - 1 - level & 1
                z = self.top.take(context + node) if level < _FIVE else self.inside.take(node)
                node = node.view(np.uint64) * _NODE
            cells = []
            for f, weights in zip(features, self.weights, strict=True):
                if f is None:
                    cells.append(None)
                    continue
                cell = f * _CELL if node is None else (f ^ node) * _CELL
                cell >>= _U(64 - self.bits)
                cells.append(cell.view(np.int64))
                if weights is not None:
                    z += weights.take(cells[-1])
            yield z, bit, cells

    def add(self, sums: dict[int, np.ndarray], hashes: np.ndarray, classes: np.ndarray, at: np.ndarray) -> None:
        """Add the decisions of the tokens to the sums of the features to be fitted: their number, the ones, the expected ones."""
        leaf, ends, context, features = self.leaf(hashes, classes), classes == CLASSES, _contexts(hashes, classes, at), _features(hashes, at)
        features = [f if i in sums or self.weights[i] is not None else None for i, f in enumerate(features)]
        for a in range(0, len(hashes), AT_ONCE):
            some = slice(a, a + AT_ONCE)
            for z, bit, cells in self.decisions(leaf[some], ends[some], context[some], [None if f is None else f[some] for f in features]):
                both = np.empty(len(z), np.complex128)
                both.real = bit * float(_ONES) + 1
                both.imag = np.rint(1 / (1 + np.exp(-z)) * _PART)
                for i, out in sums.items():
                    np.add.at(out, cells[i], both)

    def log_probability(self, hashes: np.ndarray, classes: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Decimal logarithm of the probability of every token, given its count in the training texts."""
        ends, known = classes == CLASSES, counts > 0
        leaf = np.where(known, self.leaf(hashes, classes), 0)
        out = np.where(ends, 0, np.log10(np.where(ends, 1, counts + 0.5) / self.mass[leaf]))
        context, features = _contexts(hashes, classes, at), _features(hashes, at)
        features = [None if w is None else f for f, w in zip(features, self.weights, strict=True)]
        for a in range(0, len(hashes), AT_ONCE):
            some = slice(a, a + AT_ONCE)
            place, rest = np.arange(len(ends[some])), None
            against = np.ones(len(place))
            for z, bit, _ in self.decisions(leaf[some], ends[some], context[some], [None if f is None else f[some] for f in features]):
                z *= (1 - 2 * bit).astype(np.float32)
                if rest is None:
                    against, rest = 1 + np.exp(z).astype(np.float64), np.ones(int((~ends[some]).sum()))
                else:
                    rest *= 1 + np.exp(z)
            against[~ends[some]] *= rest
            out[some] -= np.log10(against)
        return out


def _planes(numbers: np.ndarray) -> bytes:
    """Lowest bytes first, then the next ones: the high bytes are zeros and vanish."""
    return pa.compress(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _numbers(planes: pa.Buffer) -> np.ndarray:
    whole = pa.decompress(planes, PIECE * 8, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _narrow(column: pa.ChunkedArray) -> pa.Array:
    """Packed counts of 8 bytes each, as 4 where all of a row fit."""
    rows = [np.frombuffer(p.as_buffer(), np.int64) for p in column]
    return pa.array([b"\4" + r.astype("<i4").tobytes() if r.max(initial=0) < 1 << 31 else b"\10" + r.tobytes() for r in rows], pa.binary())


def _widen(column: pa.ChunkedArray) -> pa.Array:
    rows = [p.as_buffer() for p in column]
    return pa.array([np.frombuffer(r, "<i4" if memoryview(r)[0] == 4 else "<i8", offset=1).astype(np.int64).tobytes() for r in rows], pa.binary())


def _fit(table: pa.Table) -> pa.Table:
    """What is added to a piece of a feature's weights, so that the ones that the model expects become those observed."""
    n, ones, expected = (np.zeros(PIECE, np.int64) for _ in range(3))
    for counts, part in zip(table["counts"], table["expected"], strict=True):
        both = _numbers(counts.as_buffer())
        n += both % _ONES
        ones += both // _ONES
        expected += _numbers(part.as_buffer())
    chance = np.clip(expected / _PART / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    step = np.log((ones + SMOOTH * chance) / (n - ones + SMOOTH * (1 - chance))) - np.log(chance / (1 - chance))
    return pa.table([table["feature"][:1], table["piece"][:1], pa.array([np.where(n > 0, step, 0).astype(np.float32).tobytes()], pa.binary())],
                    names=["feature", "piece", "step"])


def _learn(texts: DataFrame, tree: Tree, tasks: int) -> None:
    """Weights of words by rounds of iterative scaling over all training texts. A round sends the weights so far, adds up what
    each of its features observes and expects at every decision, and moves each weight to make both agree; features that
    fire together share the move. The sums are whole numbers, so they do not depend on how rows lie in partitions."""
    spark = texts.sparkSession
    for fitted in ROUNDS:
        sent = spark.sparkContext.broadcast(tree)

        def observe(batches: Iterator[pa.RecordBatch], sent=sent, fitted=fitted) -> Iterator[pa.RecordBatch]:
            now, seen = sent.value, 0
            sums = {i: np.zeros(1 << now.bits, np.complex128) for i in fitted}

            def rows() -> Iterator[pa.RecordBatch]:
                for i, whole in sums.items():
                    for piece, a in enumerate(range(0, len(whole), PIECE)):
                        part = whole[a:a + PIECE]
                        if part.any():
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([i], pa.int32()), pa.array([piece], pa.int32()), pa.array([_planes(part.real)], pa.binary()),
                                 pa.array([_planes(part.imag)], pa.binary())], names=["feature", "piece", "counts", "expected"])
                    whole[:] = 0

            for batch in batches:
                column = pa.chunked_array([batch.column(0)])
                for a, b in X.slices(column):
                    hashes, classes, at = _tokens(column[a:b])
                    if seen + len(hashes) >= _ONES // 2:
                        yield from rows()
                        seen = 0
                    now.add(sums, hashes, classes, at)
                    seen += len(hashes)
            yield from rows()

        steps = texts.coalesce(tasks).mapInArrow(observe, "feature int, piece int, counts binary, expected binary").groupBy(
            "feature", "piece").applyInArrow(_fit, "feature int, piece int, step binary").collect()
        for i in fitted:
            tree.weights[i] = np.zeros(1 << tree.bits, np.float32)
        for r in steps:
            tree.weights[r["feature"]][r["piece"] * PIECE:(r["piece"] + 1) * PIECE] = np.frombuffer(r["step"], np.float32) / len(fitted)
        sent.destroy()


def _add(table: pa.Table) -> pa.Table:
    """One row with the sums of the given contexts' class counts."""
    grid = np.zeros((SLOTS * _Y, _Y), np.int64)
    for contexts, counts in zip(table["contexts"], table["counts"], strict=True):
        grid[np.frombuffer(contexts.as_buffer(), np.int32)] += np.frombuffer(counts.as_buffer(), np.int64).reshape(-1, _Y)
    seen = np.flatnonzero(grid.any(axis=1))
    return pa.table([table["part"][:1], pa.array([seen.astype(np.int32).tobytes()], pa.binary()), pa.array([grid[seen].tobytes()], pa.binary())],
                    names=["part", "contexts", "counts"])


def _train(statistics: DataFrame, rounds: int, rate: float, prior: float) -> Model:
    """Gradient updates over statistics that lie spread on the executors: each round sends the weights, adds up the
    gradients of all shards and takes one Adam step. `prior`: precision of a Gaussian prior on every weight."""
    spark, model = statistics.sparkSession, Model()
    fast = [np.zeros_like(w) for w in model.weights]
    slow = [np.zeros_like(w) for w in model.weights]
    for step in range(1, rounds + 1):
        sent = spark.sparkContext.broadcast([w.astype(np.float32) for w in model.weights])

        def gradients(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now = Model()
            now.weights = [w.astype(np.float64) for w in sent.value]
            total = None
            for batch in batches:
                for context, packed in zip(batch["contexts"], batch["counts"], strict=True):
                    own = np.frombuffer(context.as_buffer(), np.int32).astype(np.int64)
                    g, gain = now.gradient(own, np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, _Y).astype(np.float64))
                    total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g.ravel() for g in total]).astype(np.float32).tobytes()], pa.binary())], names=["g"])

        parts = [np.frombuffer(r["g"], np.float32) for r in statistics.mapInArrow(gradients, "g binary").collect()]
        if not parts:
            break
        whole = np.sum(parts, axis=0, dtype=np.float64)
        ends = np.cumsum([w.size for w in model.weights])
        for i, (end, w) in enumerate(zip(ends, model.weights, strict=True)):
            g = (whole[end - w.size:end].reshape(w.shape) - prior * w) / max(1.0, float(np.abs(whole).max()))
            fast[i] = 0.9 * fast[i] + 0.1 * g
            slow[i] = 0.99 * slow[i] + 0.01 * g * g
            w += rate * (fast[i] / (1 - 0.9 ** step)) / (np.sqrt(slow[i] / (1 - 0.99 ** step)) + 1e-8)
        sent.unpersist()
    return model


def language_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: int = 1, folds: int = 5,
                    rounds: int = 20, rate: float = 0.1, prior: float = 2.0) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of anything but [\\x20\\x09-\\x0D], A-Z taken as a-z, and one end. A row is held out if crc32 of its id as
    text, modulo `folds`, is `held_out`; a NULL id counts as the empty text. All other rows, copies included, are learnt from.

    base_score adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens. score adds log10 of P(class | context) times
    P(token | class, context). Classes (by the last two bytes; the end is its own) make the softmax small, and inside a class
    the softmax is factored on into two-way ones (`Tree`). Features of the maximum-entropy model, hashed: the word before,
    both words before, and the word before the last one (skip) at every decision, for the class as inside it; for the class
    also coarser ones (slot of the word before, class of the skipped one, both; `Model`). Unknown words are one type in
    class 0. Probabilities add up to one over all types, the end and the unknown one.

    One exchange counts every word exactly (64-bit hashes) and adds up the class counts of every coarse context, over all
    training documents; the class model is trained on those sums by distributed gradient rounds, the weights of words by rounds
    of iterative scaling over the training texts. Weights grow in number with the sixth root of the text: twenty bits for each
    feature at 16 MB to 160 MB, two more at 30 GB. Scoring is a table look-up in batches. NULL and blank texts are one end.
    Without training documents all counts are 0, base_score is per token log10(0.5 / 0.5) = 0, and the end and the unknown
    word are equally likely. Repeated rows score alike, other columns are ignored."""
    total = X.text_bytes(docs, text)
    n_blocks, n_buckets = X.sizes(total, 2)  # words repeat within a block, so fewer are sent
    name = "held"
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                      (F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % folds == held_out).alias(name))
    dealt = X.blocks(own, {"doc_id": "doc_id", "text": "text", name: name}, n_blocks)
    kind = dealt.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def ask(table: pa.Table) -> pa.Table:
        hashes, classes, at = _tokens(table["text"])
        learnt = np.repeat(~table[name].to_numpy(), np.diff(at))
        found = X.Distinct(hashes, n_buckets)
        n = found.total(learnt.astype(np.int64))
        asked = found.questions(table["block"][0].as_py(), (n * (_Y + 31) + classes[found.order][found.first]).astype(np.int64), whole=True)
        asked = asked.set_column(3, "extra", _narrow(asked["extra"]))
        cells, counts = np.unique((_contexts(hashes, classes, at) * _Y + classes)[learnt], return_counts=True)
        edges = np.searchsorted(cells, np.arange(SHARDS + 1) * (-(-SLOTS // SHARDS) * _Y * _Y))
        first = n_buckets + table["block"][0].as_py() // FAN * SHARDS
        rows = [(-1 - s, first + s, cells[a:b].astype(np.int32).tobytes(), counts[a:b].astype(np.int32).tobytes())
                for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pa.concat_tables([asked, pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(asked.schema)], schema=asked.schema)])

    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket >= n_buckets:  # statistics: sums of every context
            grid = np.zeros((SLOTS * _Y, _Y), np.int64)
            for cells, counts in zip(table["keys"], table["extra"], strict=True):
                grid.ravel()[np.frombuffer(cells.as_buffer(), np.int32)] += np.frombuffer(counts.as_buffer(), np.int32)
            seen = np.flatnonzero(grid.any(axis=1))
            return pa.table([pa.array([-1], pa.int32()), pa.array([bucket], pa.int32()),
                             pa.array([seen.astype(np.int32).tobytes()], pa.binary()), pa.array([grid[seen].tobytes()], pa.binary())], names=names)
        learnt = []

        def decide(order, first, values):
            value = values[order]
            n = np.add.reduceat(value // (_Y + 31), first)
            low = (np.concatenate([np.frombuffer(p.as_buffer(), np.uint64) for p in table["keys"]])[order[first]] & _U((1 << DEEP) - 1)).astype(np.int64)
            leaf, back = np.unique((value[first] % (_Y + 31) << DEEP | low)[n > 0], return_inverse=True)
            learnt[:] = [leaf, np.bincount(back, minlength=len(leaf)), np.bincount(back, n[n > 0], minlength=len(leaf)).astype(np.int64)]
            return n

        table = table.set_column(table.schema.get_field_index("extra"), "extra", _widen(table["extra"]))
        got = X.answerer(np.int64, decide, whole=True)(table)
        got = got.set_column(2, "answer", _narrow(got["answer"]))
        sums = pa.table([pa.array([-2], pa.int32()), pa.array([bucket], pa.int32()), pa.array([learnt[0].tobytes()], pa.binary()), pa.array([np.concatenate(learnt[1:]).astype(np.int64).tobytes()], pa.binary())], names=names)
        return pa.concat_tables([got.append_column("extra", pa.array([b""] * len(got), pa.binary())), sums])

    names = ["block", "bucket", "answer", "extra"]
    answers = X.cut(dealt.groupBy("block").applyInArrow(ask, X.QUESTION).groupBy("bucket").applyInArrow(answer, X.ANSWER + ", extra binary"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, _Y << DEEP), np.int64)
        for batch in batches:
            for leaf, sums in zip(batch["answer"], batch["extra"], strict=True):
                both[:, np.frombuffer(leaf.as_buffer(), np.int64)] += np.frombuffer(sums.as_buffer(), np.int64).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["both"])

    types, mass = np.zeros((2, _Y << DEEP), np.int64)
    for r in answers.where("block = -2").select("answer", "extra").repartition(SHARDS).mapInArrow(leaves, "both binary").collect():
        types, mass = (types, mass) + np.frombuffer(r["both"], np.int64).reshape(2, -1)
    n_train, n_types = int(mass.sum()), int(types.sum())
    statistics = answers.where("block = -1").selectExpr(f"bucket - {n_buckets} AS part", "answer AS contexts", "extra AS counts")
    sums_left = -(-n_blocks // FAN)
    while sums_left > 1:  # each level adds up FAN sums of the one before
        statistics = statistics.withColumn("part", F.expr(f"cast(part div {SHARDS} div {FAN} * {SHARDS} + part % {SHARDS} AS int)")).groupBy(
            "part").applyInArrow(_add, "part int, contexts binary, counts binary")
        sums_left = -(-sums_left // FAN)
    statistics = X.cut(statistics)
    model = _train(statistics, rounds if n_train else 0, rate, prior)
    tree = Tree(model, types, mass, min(24, round(BITS + np.log2(max(1, total)) / 6)))
    if n_train:
        tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
        _learn(own.where(f"NOT `{name}`").select("text"), tree, tasks)
    sent = docs.sparkSession.sparkContext.broadcast(tree)

    def score(texts: pa.Table, reply: pa.Table) -> pa.Table:
        fields = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in (id_type, *fields)], names=columns)
        hashes, classes, at = _tokens(texts["text"])
        found = X.Distinct(hashes, n_buckets)
        c = found.answers(reply.set_column(reply.schema.get_field_index("answer"), "answer", _widen(reply["answer"])), np.int64)[found.inverse]
        add = lambda x: np.add.reduceat(x, at[:-1])  # every text has its end, so no range is empty
        n = np.diff(at)
        return pa.table([texts["doc_id"], texts[name], pa.array(n), pa.array(add((c > 0).astype(np.int64))),
                         pa.array(np.full(len(n), n_train)), pa.array(add(np.log10(c + 0.5)) - n * np.log10(n_train + 0.5 * (n_types + 1))),
                         pa.array(add(sent.value.log_probability(hashes, classes, at, c)))], names=columns)

    replies = answers.where("block >= 0").select("block", "bucket", "answer")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, f"doc_id {kind.simpleString()}, {SCORES}")
