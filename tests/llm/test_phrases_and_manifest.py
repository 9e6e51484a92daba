"""Operators 11 to 13 against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quern.llm import collocations, exchange, manifest, quotient, urls
from quern.operators.ranks import ranked

lower = lambda t: re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def phrases(rows, least, longest=5, top=2000):
    """rows: (lang, text) -> {(lang, rank, phrase, a, l, r, n, score)}."""
    seen, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            seen.update((lang, *w[i:i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    often = {g: a for g, a in seen.items() if len(g) > 2 and a >= least}
    inside = {(g[0], *g[1 + i:1 + i + m]) for g in often for m in range(2, len(g) - 1) for i in range(len(g) - m)
              if often[g] >= seen[(g[0], *g[1 + i:1 + i + m])]}
    out = []
    for lang in n:
        found = []
        for g, a in often.items():
            if g[0] == lang and g not in inside:
                cuts = [(1000 * a * n[lang] // (seen[(lang, *g[1:1 + k])] * seen[(lang, *g[1 + k:])]), k) for k in range(1, len(g) - 1)]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(g[1:]).encode(), seen[(lang, *g[1:1 + k])], seen[(lang, *g[1 + k:])]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


ORDER = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (2, 4, 7), (12, 2, 2000)])
def test_collocations(odd, monkeypatch, least, longest, top):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 30000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 40000)
    docs = odd.withColumnRenamed("source", "lang")
    got = collocations.collocations(docs, least=least, longest=longest, top=top).select(*ORDER).collect()
    want = phrases([(r.lang, r.text) for r in docs.select("lang", "text").collect()], least, longest, top)
    assert want and sorted(map(tuple, got)) == want


def test_collocations_of_hard_texts(spark):
    texts = [("en", "A a a a a a"), ("en", "x\x01y x\x01y. x y,x y;x y\tx  y"), (None, "né né né né"), ("und", "né né"), ("fr", ""), ("fr", None),
             ("en", "end.of:text"), ("en", "of text end."), ("de", "." * 50), ("de", "w" * 5000 + " " + "w" * 5000)]
    docs = spark.createDataFrame(texts * 2, "lang string, text string")
    got = collocations.collocations(docs, least=2).select(*ORDER).collect()
    assert sorted(map(tuple, got)) == phrases(texts * 2, 2)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs, least=10 ** 6).count() == 0


def test_collocations_of_blocks_whose_rows_come_in_another_order_each_time(odd, monkeypatch):
    deal = exchange.blocks

    def shuffled(batches):
        for batch in batches:
            yield batch.take(pa.array(np.random.default_rng().permutation(batch.num_rows)))

    def blocks(docs, columns, n):
        dealt = deal(docs, columns, n)
        return dealt.mapInArrow(shuffled, dealt.schema)

    monkeypatch.setattr(exchange, "BLOCK_BYTES", 30000)
    monkeypatch.setattr(exchange, "blocks", blocks)
    docs = odd.withColumnRenamed("source", "lang")
    got = collocations.collocations(docs, least=3).select(*ORDER).collect()
    assert sorted(map(tuple, got)) == phrases([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 3)


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 15), (4, 16), (5, 15), (5, 13), (3, 21), (5, 26), (5, 40), (3, 64)])
@pytest.mark.parametrize("shard_bits", [0, 1, 2])
def test_filters_lose_nothing(n, bits, shard_bits):
    draw = np.random.default_rng(bits)
    ids = [draw.integers(0, min(2 ** bits, 2 ** 62), 3000) for _ in range(n)]
    ids[0][:1200], ids[1][:1200] = 1, 0
    limbs = quotient.permute(quotient.pack(ids, bits), n, bits)
    want = Counter(zip(*(i.tolist() for i in ids), strict=True))
    halves, merged = [], []
    for half in (slice(0, 1000), slice(1000, 3000)):
        halves.append(quotient.tally([limb[half] for limb in limbs])[:2])
    width = quotient.widths(n, bits)[0]
    for shard in range(1 << shard_bits):
        for entries, counts in halves:
            mine = (entries[0] >> np.uint64(width - shard_bits) if shard_bits else np.zeros(len(counts), np.uint64)) == shard
            packed = quotient.encode([e[mine] for e in entries], counts[mine], n, bits, shard_bits)
            merged.append(quotient.decode(memoryview(packed), n, bits, shard_bits, shard))
    total, counts, place = quotient.tally([np.concatenate(p) for p in zip(*(m[0] for m in merged), strict=True)], np.concatenate([m[1] for m in merged]))
    assert len(place) == sum(len(m[1]) for m in merged) and place.max() == len(counts) - 1
    back = quotient.unpack(quotient.restore(total, n, bits), n, bits)
    assert Counter(dict(zip(zip(*(b.tolist() for b in back), strict=True), counts.tolist(), strict=True))) == want


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, [siblings left and right of each level] of each node)."""
    levels, level = [], nodes
    while len(level) > 1:
        levels.append(level)
        level = [H(*level[i:i + 8]) for i in range(0, len(level), 8)]
    paths = []
    for i in range(len(nodes)):
        path, at = [], i
        for row in levels:
            run = row[at // 8 * 8:at // 8 * 8 + 8]
            path.append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
            at //= 8
        paths.append(path)
    return level[0] if level else None, paths


def proved(rows):
    groups = {}
    for r in rows:
        own = H(*(part(v) for v in r))
        struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        changed = H(*(part(v) for v in r[:4]), part(None if r[4] is None else lower(r[4]))) if struck else own
        groups.setdefault(r[2], []).append((r[0], own, changed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        made[g] = tree([x[1] for x in groups[g]])
    root, tops = tree([made[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for (key, own, changed), path in zip(groups[g], made[g][1]):
            at = changed
            for left, right in path + top:
                at = H(left, at, right)
            out.append((key, own, made[g][0], root, H(*(a + b for a, b in path + top)), at, at == root))
    return sorted(out, key=str)


MADE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("n", "levels"), [(0, 4), (1, 4), (9, 4), (70, 1), (600, 1), (600, 4)])
def test_manifest(spark, n, levels):
    draw = random.Random(n)
    rows = [(draw.choice([None, 1, 2, 7]) if i % 40 == 3 else i, draw.choice(["s", None]), draw.choice(["en", "en", "en", "é", "z", None]), None if i % 9 == 0 else i,
             draw.choice([None, "", "Some Text", "é" * 3 + "X", "q" * 40000])) for i in range(n)]
    rows += [(5, "s", "en", 1, "Twice")] * (n // 3)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("z") for c in ("number", "idx", "path", "digest")})
    got = manifest.verified_rows(docs.repartition(5), levels=levels).select(*MADE).collect()
    assert sorted([tuple(r) for r in got], key=str) == proved(rows)


def test_many_groups_have_an_upper_tree(spark):
    rows = [(i, None, f"g{i % 75:02d}", 1, f"Text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.verified_rows(docs).select(*MADE).collect()
    assert sorted([tuple(r) for r in got], key=str) == proved(rows)


def test_proofs_of_some_leaves(spark):
    docs = spark.range(500).selectExpr("id", "cast(id % 3 as string) AS lang", "sha2(cast(id as string), 256) AS leaf")
    made = manifest.build(docs, "lang", [docs["id"].asc()])
    got = manifest.proofs(made, made.leaves.where("id IN (7, 8, 499)"), ["id", "leaf"]).collect()
    assert sorted(r.id for r in got) == [7, 8, 499]
    assert all(manifest.fold(r.leaf, [side.asDict() for side in r.path[::-1]]) == r.root and r.digest == r.leaf for r in got)


def test_ranks_of_a_hot_group(spark):
    rows = [("a", 5)] * 300 + [(None, i) for i in range(20)] + [("b", i % 4) for i in range(50)]
    frame = spark.createDataFrame(rows, "g string, v int")
    got = ranked(frame, ["g"], [frame["v"].desc()], numbered=True).collect()
    for number, g in enumerate((None, "a", "b")):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(len(mine))) and {(r["size"], r["number"]) for r in mine} == {(len(mine), number)}
        assert [r.v for r in mine] == sorted((r.v for r in mine), reverse=True)


URLS = ["http://a.net/x", "https://Example.NET/en/1?q", "http://www.example.net/en/", "http://example.net/EN/", "http://example.net/en", "http://net", "http://net/", "http://xnet/",
        "http://example.com/de/#f", "http://u:p@shop.example.com:80/de/1", "http://org/fr/", "http://deep.a.b.org/fr/x", "no scheme", "", None, "://", "x://?q=http://a.net/", "http://a..net/", "http://.net/",
        "http://net./", "//a.net/", "http://a.net/x", "http://a.net/x", "http://" + "a." * 3000 + "net/" + "p/" * 9000, "http://é.net/ü", "http://a.net\n/x"]


def verdicts(addresses, rules):
    out = []
    for i, u in enumerate(addresses):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest).group()
        path, host = re.match(r"[^?#]*", rest[len(raw):]).group(), lower(raw)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((i, host, path, max(fit)[2] if fit else None, max(fit)[3] if fit else "allow"))
    return out


NESTED = [("net", "/", "block"), ("a.net", "/x", "allow"), ("a.net", "/", "block"), ("net", "/x/y", "block"), ("b.org", "/fr/x", "block"), ("org", "/fr/xyz/", "allow"), ("com", "", "block"), ("", "", "block")]


@pytest.mark.parametrize("rules", [list(urls.RULES), NESTED, NESTED + [(f"h{i}.net", f"/{i % 7}/", "allow") for i in range(60)]])
def test_url_verdicts(spark, rules, monkeypatch):
    monkeypatch.setattr(urls, "RANGE_ROWS", 20)
    draw = random.Random(1)
    addresses = URLS + [f"http://{draw.choice(['', 'w.', 'x.y.'])}{draw.choice(['a', 'b', 'h3', 'h5', 'example'])}.{draw.choice(['net', 'org', 'com'])}/{draw.choice(['x', 'fr/x', 'x/y', '3/', 'fr/xyz/1'])}" for _ in range(200)]
    addresses += ["http://a.net/x"] * 150
    pages = spark.createDataFrame([(i, u, "z", "z", "z") for i, u in enumerate(addresses)], "page_id long, url string, key string, host string, uid string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = urls.judge(pages.repartition(4), table).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == verdicts(addresses, rules)


def test_no_urls_or_rules(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x"), (None, None), (2, None)], "page_id long, url string")
    table = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow")], "host string, path string, verdict string")
    assert urls.judge(pages.where("false"), table).count() == 0
    assert [r.verdict for r in urls.judge(pages, table.where("false")).collect()] == ["allow"] * 3
    assert sorted(r.verdict for r in urls.judge(pages, table).collect()) == ["allow", "allow", "block"]
