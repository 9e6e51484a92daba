"""Operators 1, 6, 7 and 10 against brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quern.llm import decontaminate, exchange, lm, near_dedup, substrings, words
from quern.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def removed(texts, window):
    """(n_words, n_removed, kept_sha256) of each text."""
    rows = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in rows for i in range(len(w) - window + 1))
    out = []
    for w in rows:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 8, 3])
def test_repeated_passages(odd, window):
    got = substrings.repeated_passages(odd, window=window, keep_text=True).collect()
    rows = odd.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, removed([r.text for r in rows], window))]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == sorted(want, key=str)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_over_many_blocks(odd, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 20000)
    rows = odd.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, removed([r.text for r in rows], 35))]
    got = substrings.repeated_passages(odd).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)


def test_nothing_in_nothing_out(none, odd, spark):
    bench = odd.selectExpr("doc_id AS item_id", "text")
    assert substrings.repeated_passages(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.keep_one(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert lm.language_scores(none).count() == 0
    clean = decontaminate.contamination(odd, bench.where("false")).collect()
    assert len(clean) == odd.count() and not any(r.contaminated for r in clean)


def classes(rows, similarity=0.8):
    """Class of each row by comparing all pairs."""
    def vector(t):
        w = WORD.findall(lower(t))
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    vectors = [vector(t) for _, t in rows]
    df = Counter(s for v in vectors for s in v)
    n = max(sum(1 for v in vectors if v), 3)
    idf = {s: 1 + math.log(n / c) / (near_dedup.DAMPING * math.log(n)) for s, c in df.items()}
    parent = list(range(len(rows)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, v in enumerate(vectors):
        for j in range(i):
            u = vectors[j]
            if v and u:
                both = sum(min(v[s], u[s]) * idf[s] for s in v if s in u)
                every = sum(c * idf[s] for s, c in v.items()) + sum(c * idf[s] for s, c in u.items()) - both
                if both / every >= similarity:
                    parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    known = {k: [d for d in v if d is not None] for k, v in ids.items()}
    return [(d, min(known[root(i)]) if known[root(i)] else None) for i, (d, _) in enumerate(rows)]


def test_near_duplicates(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = [(d, d if not WORD.search(t or "") else c) for (d, t), (_, c) in zip(rows, classes(rows))]
    got = [tuple(r) for r in near_dedup.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_copies_of_one_text_form_one_class(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        w[3 * i] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"q{i}x{j}" for j in range(100))) for i in range(20)]
    found = dict(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {found[i] for i in range(60)} == {0}
    assert all(found[1000 + i] == 1000 + i for i in range(20))


def test_buckets_of_several_classes_are_compared_in_full(spark):
    """Two families share most of their words: buckets mix them, and chains inside are still found."""
    rows, base = [], [f"w{i}" for i in range(300)]
    for k in range(12):
        w = base[:200] + [f"v{k}_{i}" for i in range(12 * k)] + base[200:]
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == sorted(classes(rows))


def test_signatures_estimate_weighted_similarity():
    import numpy as np
    draw = np.random.default_rng(0)
    keys = draw.integers(0, 1 << 63, 300).astype(np.uint64)
    w = draw.uniform(1, 5, 300)
    other = np.where(np.arange(300) < 220, w, w * 2)
    true = np.minimum(w, other).sum() / np.maximum(w, other).sum()
    a, b = near_dedup.signature(keys, w, 600), near_dedup.signature(keys, other, 600)
    assert abs((a == b).mean() - true) < 0.06


def test_keep_one(odd):
    kept = near_dedup.keep_one(odd)
    rows = kept.select("doc_id", "text").collect()
    assert kept.columns == odd.columns
    words_of = lambda t: tuple(WORD.findall(lower(t)))
    assert Counter(words_of(r.text) for r in rows if words_of(r.text)).most_common(1)[0][1] == 1
    hot = odd.where("doc_id = 100").first().text
    assert sum(r.text == hot or "edited" in (r.text or "") for r in rows) == 1
    assert sum(r.text is None for r in rows) == 2 and {2, 3, 4, 5} <= {r.doc_id for r in rows}


def test_components(spark):
    links = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40)] + [(b"x", b"y"), (b"y", b"x"), (b"z", b"z")]
    got = dict(components(spark.createDataFrame(links, "a binary, b binary")).collect())
    named = {bytes(k): bytes(v) for k, v in got.items()}
    assert len({named[b"%03d" % i] for i in range(41)}) == 1 and named[b"x"] == named[b"y"] in (b"x", b"y") and b"z" not in named


def contaminated(rows, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(i)
    out = []
    for d, t in rows:
        w = pattern.findall(lower(t))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("most", [200_000, 7])
def test_contamination(spark, odd, most):
    text = odd.where("doc_id = 8").first().text
    items = [(1, text[100:400]), (2, "One, two THREE"), (3, None), (4, "..."), (None, text[50:200]), (5, text[100:400]), (5, text[100:400]), (6, "nothing like it in any text at all, not one word of these twelve")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontaminate.contamination(odd, bench, index_windows=most).collect()]
    want = contaminated([tuple(r) for r in odd.select("doc_id", "text").collect()], items)
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[-1] for w in want)
    if most > 7:
        clean = decontaminate.clean_documents(odd, bench)
        assert clean.columns == odd.columns and clean.count() == sum(not w[-1] for w in want)


def test_language_scores(odd):
    rows = odd.select("doc_id", "text").collect()
    tokens = [WORD.findall(lower(r.text)) + [None] for r in rows]
    out = [zlib.crc32((str(r.doc_id) if r.doc_id is not None else "").encode()) % 5 == 1 for r in rows]
    count = Counter(w for t, held in zip(tokens, out) if not held for w in t)
    total = sum(count.values())
    base = lambda t: sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in t)
    want = sorted((str(r.doc_id), held, len(t), sum(count[w] > 0 for w in t), total, round(base(t), 6)) for r, t, held in zip(rows, tokens, out))
    got = lm.language_scores(odd).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_the_model_is_a_distribution_and_learns_order(spark):
    """Where words follow one another by rule, the model beats single-word frequencies on held-out texts."""
    import random
    draw = random.Random(1)
    follow = {w: draw.sample([f"{c}{d}" for c in "abcdefgh" for d in "pqrstuvw"], 2) for w in [f"{c}{d}" for c in "abcdefgh" for d in "pqrstuvw"]}
    rows = []
    for i in range(300):
        w = [draw.choice(list(follow))]
        while len(w) < 80:
            w.append(draw.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    got = lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)
    model = lm.Model()
    model.weights[0] += 0.3
    import numpy as np
    assert np.allclose(np.exp(model.log_probability(slice(0, 50))).sum(axis=1), 1)


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    import numpy as np
    import pyarrow as pa
    texts = ["ab cd ab", None, "", "cd", "é" * 30 + " ab", "  x  "]
    monkeypatch.setattr(words, "PIECE", 16)
    small = words.words(*words.buffer(pa.array(texts)))
    monkeypatch.undo()
    whole = words.words(*words.buffer(pa.array(texts)))
    for a, b in zip(small, whole):
        assert np.array_equal(a, b)
    h = whole[0]
    assert h[0] == h[2] and h[1] == h[3] and h[0] == h[5] and np.diff(whole[3]).tolist() == [3, 0, 0, 1, 2, 1]
