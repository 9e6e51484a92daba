"""Words inside a class are predicted from hashed n-gram and skip features, as classes are."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from quern.llm import lm

ALIKE = [f"{a}{b}xx" for a in "abcdefgh" for b in "pqrstuvw"]  # the same last two bytes: one class


def held_out_gain(spark, back, seed):
    """Of texts in which the word `back` places before leaves two choices; decimal digits a token."""
    draw = random.Random(seed)
    follow = {w: draw.sample(ALIKE, 2) for w in ALIKE}
    rows = []
    for i in range(300):
        w = [draw.choice(ALIKE) for _ in range(back)]
        while len(w) < 80:
            w.append(draw.choice(follow[w[-back]]))
        rows.append((i, " ".join(w)))
    assert len(set(lm._tokens(pa.chunked_array([[r[1] for r in rows]]))[1])) == 2
    got = lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    return sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)


def test_the_word_before_tells_words_of_a_class_apart(spark):
    assert held_out_gain(spark, 1, 1) > 0.8


def test_the_skipped_to_word_tells_words_of_a_class_apart(spark):
    assert held_out_gain(spark, 2, 2) > 0.5


def brute(rows):
    """Scores where the class model is uniform, with weights in dictionaries."""
    texts = {i: t.split() for i, t in rows}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for i in train for w in texts[i])
    tokens = {w: lm._tokens(pa.chunked_array([[w]])) for w in count}
    depth = math.ceil(math.log2(max(Counter(int(t[1][0]) for t in tokens.values()).values()))) + 2

    def path(w):
        if w not in count:
            return "0" * (5 + depth)
        h, k, _ = tokens[w]
        return f"{k[0]:05b}" + f"{int(h[0]) % (1 << lm.DEEP):0{lm.DEEP}b}"[:depth]

    paths = {w: path(w) for t in texts.values() for w in t}
    mass, classes = defaultdict(float, {"0" * (5 + depth): 0.5}), {"00000"} | {paths[w][:5] for w in count}
    for w, n in count.items():
        mass[paths[w]] += n + 0.5

    def odds(node):
        below = (lambda s: sum(c.startswith(s) for c in classes)) if len(node) < 5 else (lambda s: sum(m for q, m in mass.items() if q.startswith(s)))
        zero, one = below(node + "0"), below(node + "1")
        return 0 if not one + zero else 40 if not zero else -40 if not one else math.log(one / zero)

    def decisions(words):
        for i, w in enumerate([*words, None]):
            a, b = ([None, None, *words])[i + 1], ([None, None, *words])[i]
            keys = [("before", a), ("both", a, b), ("skip", b)]
            yield w, keys, [("end", w is None, math.log(1 / len(classes)))] + ([] if w is None else [
                (paths[w][:d], paths[w][d] == "1", odds(paths[w][:d])) for d in range(5 + depth)])

    weights = {}
    z = lambda keys, node, start: start + sum(weights.get((*k, node), 0) for k in keys)
    for fitted in ((0,), (1, 2)):
        seen = defaultdict(lambda: [0, 0, 0.0])
        for i in train:
            for _, keys, taken in decisions(texts[i]):
                for node, one, start in taken:
                    for f in fitted:
                        s = seen[(*keys[f], node)]
                        s[0], s[1], s[2] = s[0] + 1, s[1] + one, s[2] + 1 / (1 + math.exp(-z(keys, node, start)))
        for key, (n, ones, expected) in seen.items():
            p = min(max(expected / n, 1e-6), 1 - 1e-6)
            weights[key] = (math.log((ones + 4 * p) / (n - ones + 4 * (1 - p))) - math.log(p / (1 - p))) / len(fitted)
    out = {}
    for i, words in texts.items():
        out[i] = 0.0
        for w, keys, taken in decisions(words):
            out[i] -= sum(math.log10(1 + math.exp((-1 if one else 1) * z(keys, node, start))) for node, one, start in taken)
            out[i] += 0 if w is None else math.log10((count[w] + 0.5) / mass[paths[w]])
    return out


def test_scores_agree_with_brute_force(spark, monkeypatch):
    draw = random.Random(5)
    known = ["".join(draw.choice("abcdefgh") for _ in range(3)) for _ in range(100)]
    rows = [(i, " ".join(draw.choice(known[:draw.choice((5, 100))]) for _ in range(draw.randint(0, 12)))) for i in range(40)]
    monkeypatch.setattr(lm, "BITS", 22)  # hardly any weights share a place
    want = brute(rows)
    got = {r.doc_id: r.score for r in lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rounds=0).collect()}
    assert sum(abs(got[i] - want[i]) < 1e-3 for i in want) >= 38 and len(got) == 40
    assert any(zlib.crc32(str(i).encode()) % 5 == 1 and t for i, t in rows)


def test_the_next_token_has_a_distribution():
    """Whatever the weights: all types, the unknown one and the end have probabilities that add up to one."""
    draw = np.random.default_rng(3)
    texts = pa.chunked_array([[" ".join(f"w{draw.integers(3000)}" for _ in range(4000))]])
    hashes, classes, _ = lm._tokens(texts)
    types, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    kind = classes[first]
    leaf = kind << lm.DEEP | (types & np.uint64((1 << lm.DEEP) - 1)).astype(np.int64)
    size = lm._Y << lm.DEEP
    model = lm.Model()
    model.weights[0] += draw.normal(size=model.weights[0].shape)
    tree = lm.Tree(model, np.bincount(leaf, minlength=size), np.bincount(leaf, counts, minlength=size).astype(np.int64), 14)
    tree.weights = [draw.normal(size=1 << 14).astype(np.float32) for _ in range(3)]
    assert tree.depth > 3
    some = np.append(types, np.uint64(12345)), np.append(kind, 7), np.append(counts, 0)  # with the unknown word
    history, known = hashes[:2], classes[:2]
    n = len(some[0])
    rows = np.column_stack([np.repeat(history[None], n, 0), some[0][:, None]]).ravel()
    kinds = np.column_stack([np.repeat(known[None], n, 0), some[1][:, None]]).ravel()
    total = np.column_stack([np.ones((n, 2), np.int64), some[2][:, None]]).ravel()
    got = tree.log_probability(rows, kinds, np.arange(n + 1) * 3, total)[2::3]
    assert abs((10 ** got).sum() - 1) < 1e-4
