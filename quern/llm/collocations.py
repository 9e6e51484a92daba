"""Operator 11: phrases that occur more often than their parts explain, counted in merged quotient filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import exchange as X
from quern.llm import quotient as Q
from quern.llm.memory import lean
from quern.llm.words import LOWER, buffer, words
from quern.operators.ranks import ranked

HOT = 1000  # a key that holds more than one in HOT of all words is looked up by broadcast; at most HOT such keys a length
_WORD = np.ones(256, bool)  # words are runs of anything but \x20, \x09 and what ends a piece
_END = np.zeros(256, bool)  # a piece ends at [.,;:!?\x0A-\x0D]
_END[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD[_END] = False
_WORD[[32, 9]] = False


def _words(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Every word as a number, the distinct words, whether a word begins a piece, and offsets of the texts into the words."""
    data, offsets = buffer(texts)
    data = LOWER[data]
    inside = _WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    starts[cuts] |= inside[cuts]
    first = np.flatnonzero(starts)
    at = np.searchsorted(first, offsets)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_END[data], out=ends[1:])
    fresh = np.ones(len(first), bool)
    fresh[1:] = np.diff(ends[first]) > 0
    fresh[at[:-1][at[:-1] < len(first)]] = True
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=kept[1:])
    edges = np.append(kept[first], kept[-1])
    space = pa.py_buffer(np.ascontiguousarray(data[inside]))
    found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edges), space).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary, fresh, at


def _languages(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """A language's number for every text, and the languages."""
    coded = pc.fill_null(column.combine_chunks(), "und").dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _sequences(ids: np.ndarray, fresh: np.ndarray, n: int) -> np.ndarray:
    """Where sequences of n numbered words begin that stay inside a piece."""
    gap = np.concatenate(([0], np.cumsum(ids == 0)))
    new = np.concatenate((np.cumsum(fresh), [0]))
    begin = np.arange(max(0, len(ids) - n + 1))
    return begin[(gap[begin + n] == gap[begin]) & (new[begin] == new[begin + n - 1])]


def _lookup(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join with a table of unique keys. Rows of `table` that are hot, which no more than a few thousand can be, are broadcast;
    the other keys, each with a small share of the rows, are joined by shuffle. The rows are read by both joins, so their lineage is
    cut before and after."""
    few = table.where(hot).select(*keys, F.struct(*(c for c in table.columns if c not in keys)).alias("met"))
    rest = table.where(~hot)
    tried = rows.join(F.broadcast(few), keys, "left")
    others = [c for c in table.columns if c not in keys]
    ready = tried.where("met IS NOT NULL").select(*rows.columns, *(F.col(f"met.{c}").alias(c) for c in others))
    return X.cut(ready.unionByName(tried.where("met IS NULL").drop("met").join(rest, keys).select(*rows.columns, *others)))


def _dealt(table: pa.Table, n_buckets: int):
    """The words of a block: every word's entry; and of each entry (a word in a language) the bucket, language and word in the order
    in which buckets are asked, with the edges of runs of one bucket and language. A block is dealt anew for each answer, and its rows
    may then come in another order; they are sorted first, so that an answer finds the entries where the question had them."""
    table = table.sort_by([("lang", "ascending"), ("text", "ascending")])
    codes, found, fresh, at = _words(table["text"])
    spoken, names = _languages(table["lang"])
    pairs, entry, counts = np.unique(codes * len(names) + np.repeat(spoken, np.diff(at)), return_inverse=True, return_counts=True)
    hashes = words(*buffer(found), kind=np.ones(256, bool))[0] if len(found) else np.zeros(0, np.uint64)
    bucket = (hashes[pairs // len(names)] % np.uint64(n_buckets)).astype(np.int64) if len(pairs) else pairs
    order = np.lexsort((pairs // max(1, len(names)), pairs % max(1, len(names)), bucket))
    bucket, lang = bucket[order], pairs[order] % max(1, len(names))
    edges = np.concatenate(([0], np.flatnonzero((np.diff(bucket) != 0) | (np.diff(lang) != 0)) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    return entry, order, bucket[edges[:-1]], [names[k] for k in lang[edges[:-1]]], edges, found.take(pa.array(pairs[order] // max(1, len(names)))), counts[order], fresh


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5
                  ) -> tuple[DataFrame, DataFrame, int]:
    """Words (id from 1, lang, word, f, n: words of the language) with f >= least, phrases (ids, a) of 2 to `longest` words with
    a >= least, and the number of all words.

    Texts are dealt to blocks. A block sends its words and their counts to buckets of words; a bucket adds them up, numbers the words
    that reach `least`, and answers with these numbers: no other word can be part of a phrase that reaches it. The block then packs
    every pair of numbered words and sends each shard one sorted filter; a shard merges the filters into one and tells each block
    which of its pairs reach `least`. Longer phrases are packed and merged likewise, but for those with a pair that does not reach
    it, as they cannot either. Numbers are unique over all languages. Buckets and shards grow in number with the texts; a word or
    phrase that every text has is one entry a block."""
    size = X.text_bytes(docs, text)
    n_blocks, n_shards = X.sizes(size)
    shard_bits = n_shards.bit_length() - 1
    dealt = X.blocks(docs, {"lang": lang, "text": text}, n_blocks)

    def ask(table: pa.Table) -> pa.Table:
        _, _, bucket, names, edges, spelled, counts, _ = _dealt(table, n_shards)
        cuts = pa.array(edges, pa.int32())
        return pa.table([pa.array([table["block"][0].as_py()] * len(bucket), pa.int32()), pa.array(bucket, pa.int32()), pa.array(names, pa.string()),
                         pa.ListArray.from_arrays(cuts, spelled.cast(pa.string())), pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64()))],
                        names=["block", "bucket", "lang", "words", "n"])

    def number(table: pa.Table) -> pa.Table:
        bucket, known, out = table["bucket"][0].as_py(), 0, []
        for name in table["lang"].unique().to_pylist():
            mine = table.filter(pc.equal(table["lang"], name)).combine_chunks()
            lists = mine["words"].combine_chunks()
            coded = lists.flatten().dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            total = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(total, codes, mine["n"].combine_chunks().flatten().to_numpy())
            enough = np.flatnonzero(total >= least)
            ids = np.zeros(len(total), np.int32)
            ids[enough] = known + 1 + np.arange(len(enough))
            known += len(enough)
            cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out += [(block, name, ids[codes[a:b]], None, None) for block, a, b in zip(mine["block"].to_pylist(), cuts[:-1], cuts[1:], strict=True)]
            out.append((-1, name, ids[enough], coded.dictionary.take(pa.array(enough)).to_pylist(), total[enough]))
            out.append((-2, name, None, None, [int(total.sum())]))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.table([pa.array([bucket] * len(out), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                        names=["bucket", "block", "lang", "ids", "words", "f"])

    answers = X.cut(dealt.groupBy("block").applyInArrow(lean(ask), "block int, bucket int, lang string, words array<string>, n array<long>")
                    .groupBy("bucket").applyInArrow(lean(number), "bucket int, block int, lang string, ids array<int>, words array<string>, f array<long>"))
    spoken = X.cut(answers.where("block = -2").groupBy("lang").agg(F.sum(F.col("f")[0]).alias("n")))
    total = spoken.agg(F.sum("n")).first()[0] or 0
    most = (answers.where("block = -1").groupBy("bucket").agg(F.sum(F.size("ids")).alias("n")).agg(F.max("n")).first()[0] or 0) + 1
    frequent = answers.where("block = -1").select("bucket", "lang", F.explode(F.arrays_zip("ids", "words", "f")).alias("w")).select(
        (F.col("bucket").cast("long") * most + F.col("w.ids")).alias("id"), "lang", F.col("w.words").alias("word"), F.col("w.f").alias("f"))
    frequent = _lookup(frequent, spoken, ["lang"], F.col("n") > total // HOT)
    bits = max(1, (n_shards * most).bit_length())

    def numbered(table: pa.Table, reply: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The number of every word of a block, 0 where it has none, and whether it begins a piece."""
        entry, order, bucket, names, edges, _, _, fresh = _dealt(table, n_shards)
        mine = reply.filter(pc.is_valid(reply["lang"]))
        told = dict(zip(zip(mine["bucket"].to_pylist(), mine["lang"].to_pylist(), strict=True), mine["ids"], strict=True))
        of_entry = np.zeros(len(order), np.int64)
        for k, name, a, b in zip(bucket.tolist(), names, edges[:-1], edges[1:], strict=True):
            ids = told[(k, name)].values.to_numpy().astype(np.int64)
            of_entry[order[a:b]] = np.where(ids > 0, k * most + ids, 0)
        return of_entry[entry], fresh

    def counted(ids: np.ndarray, begin: np.ndarray, n: int):
        """Distinct phrases that begin at the given words, their counts, the place of each beginning's phrase, and the shards' edges."""
        limbs, counts, place = Q.tally(Q.permute(Q.pack([ids[begin + k] for k in range(n)], bits), n, bits))
        own = min(shard_bits, Q.widths(n, bits)[0])
        shard = limbs[0] >> np.uint64(Q.widths(n, bits)[0] - own) if own else np.zeros(len(counts), np.uint64)
        return limbs, counts, place, own, np.searchsorted(shard, np.arange((1 << own) + 1, dtype=np.uint64))

    def filters(block: int, ids: np.ndarray, begin: np.ndarray, n: int) -> list[tuple]:
        limbs, counts, _, own, cuts = counted(ids, begin, n)
        return [(block, n, k, Q.encode([limb[a:b] for limb in limbs], counts[a:b], n, bits, own))
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]

    def sent(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                        names=["block", "n", "shard", "filter"])

    def pairs(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows or not reply.num_rows:
            return sent([])
        ids, fresh = numbered(table, reply)
        return sent(filters(table["block"][0].as_py(), ids, _sequences(ids, fresh, 2), 2))

    def longer(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows or not reply.num_rows:
            return sent([])
        ids, fresh = numbered(table, reply)
        begin = _sequences(ids, fresh, 2)
        limbs, counts, place, _, cuts = counted(ids, begin, 2)
        flags = np.zeros(len(counts), bool)
        mine = reply.filter(pc.is_null(reply["lang"]))
        for k, packed in zip(mine["bucket"].to_pylist(), mine["flags"], strict=True):
            flags[cuts[k]:cuts[k + 1]] = np.unpackbits(np.frombuffer(packed.as_buffer(), np.uint8), count=int(cuts[k + 1] - cuts[k]))
        frequent_pair = np.zeros(len(ids) + 1, np.int64)
        frequent_pair[begin] = flags[place]
        gaps = np.concatenate(([0], np.cumsum(frequent_pair == 0)))
        rows = []
        for n in range(3, longest + 1):
            at = _sequences(ids, fresh, n)
            rows += filters(table["block"][0].as_py(), ids, at[gaps[at + n - 1] == gaps[at]], n)
        return sent(rows)

    def merged(table: pa.Table):
        n, shard = table["n"][0].as_py(), table["shard"][0].as_py()
        own = min(shard_bits, Q.widths(n, bits)[0])
        parts = [Q.decode(memoryview(f.as_buffer()), n, bits, own, shard) for f in table["filter"]]
        limbs, counts, place = Q.tally([np.concatenate(one) for one in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]))
        enough = counts >= least
        ids = np.stack(Q.unpack(Q.restore([limb[enough] for limb in limbs], n, bits), n, bits), axis=1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n, pa.int32()), pa.array(ids.ravel()))
        return parts, lists, counts[enough], enough[place]

    def merge(table: pa.Table) -> pa.Table:
        _, lists, counts, _ = merged(table)
        return pa.table({"ids": lists, "a": counts})

    def merge_pairs(table: pa.Table) -> pa.Table:
        """Frequent pairs, and for each block which entries of its filter they are."""
        parts, lists, counts, flags = merged(table)
        ends = np.cumsum([0] + [len(p[1]) for p in parts])
        told = [np.packbits(flags[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        none = len(counts)
        return pa.table([pa.concat_arrays([lists, pa.nulls(len(told), lists.type)]), pa.array([*counts.tolist(), *[None] * len(told)], pa.int64()),
                         pa.concat_arrays([pa.nulls(none, pa.int32()), table["block"].combine_chunks()]),
                         pa.concat_arrays([pa.nulls(none, pa.int32()), table["shard"].combine_chunks()]), pa.array([None] * none + told, pa.binary())],
                        names=["ids", "a", "block", "bucket", "flags"])

    shape = "block int, n int, shard int, filter binary"
    words_told = answers.where("block >= 0").select("block", "bucket", "lang", "ids")
    found = X.cut(dealt.groupBy("block").cogroup(words_told.groupBy("block")).applyInArrow(lean(pairs), shape)
                  .groupBy("n", "shard").applyInArrow(lean(merge_pairs), "ids array<long>, a long, block int, bucket int, flags binary"))
    told = words_told.unionByName(found.where("flags IS NOT NULL").select("block", "bucket", "flags"), allowMissingColumns=True)
    phrases = found.where("a IS NOT NULL").select("ids", "a")
    if longest > 2:
        more = (dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lean(longer), shape)
                .groupBy("n", "shard").applyInArrow(lean(merge), "ids array<long>, a long"))
        phrases = phrases.unionByName(X.cut(more))
    return frequent, phrases, total


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z become lower case; pieces end at [.,;:!?\\x0A-\\x0D], words at [\\x20\\x09]. A candidate is a phrase of 2 to `longest` words with
    a >= least occurrences inside pieces, overlaps included. A cut gives l and r, the counts of its parts, and floor(1000 a n / (l r));
    the lowest cut counts, of equal ones the earliest. A candidate goes if a longer one holds its words and occurs as often: then one
    that is longer by a single word does too, so only those are looked at. Sums are exact 64-bit numbers, products exact decimals.

    NULL and blank texts have no words; a NULL language is `und`. Repeated rows count each time. Ties are ranked by phrase in the order
    of its UTF-8 bytes. Other columns are ignored."""
    known, phrases, total = phrase_counts(docs, text, lang, least, longest)
    counts = known.select(F.array("id").alias("part"), "f").unionByName(phrases.where(F.size("ids") < longest).select(F.col("ids").alias("part"), F.col("a").alias("f")))
    counts = X.cut(counts)
    inner = (phrases.where(F.size("ids") > 2).select(F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"), "a").distinct())
    left = X.cut(phrases.join(inner, ["ids", "a"], "left_anti"))
    hot = F.col("f") > total // HOT
    parted = (left.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
              .withColumn("part", F.slice("ids", F.lit(1), F.col("k"))))
    parted = _lookup(parted, counts, ["part"], hot).withColumnRenamed("f", "l").withColumn("part", F.slice("ids", F.col("k") + 1, F.size("ids")))
    parted = _lookup(parted, counts, ["part"], hot).withColumnRenamed("f", "r").withColumn("id", F.col("ids")[0])
    spoken = known.select("id", "lang", "n", "f")
    parted = _lookup(parted, spoken, ["id"], hot).drop("f")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    parted = parted.withColumn("top", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n")).withColumn("low", big("l") * big("r")).withColumn("score", F.expr("top div low"))
    best = X.cut(parted.groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    spelled = best.select("*", F.posexplode("ids").alias("at", "id"))
    spelled = (_lookup(spelled, known.select("id", "word", "f"), ["id"], hot)
               .groupBy("ids", "a", "lang", "n", "cut").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase")))
    listed = ranked(spelled.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"), ["lang"],
                    [F.col("score").desc(), F.col("a").desc(), F.col("phrase")])
    return listed.where(F.col("rank") < top).select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
