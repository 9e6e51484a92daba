"""Operator 2: quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, characters: str) -> Column:
    """Characters of the text that are in the class: what is left when the runs of all others are taken out."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def word_characters(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text. Windows are compared by 64-bit hashes, sorted with
    their places; a place covers up to three words, as far as the next one."""
    def covered(places: Column) -> Column:
        n = F.size(places)
        gaps = F.zip_with(F.slice(places, 2, n - 1), F.slice(places, 1, n - 1), lambda b, a: F.least(b - a, F.lit(3)))
        return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap))

    def sorted_windows(windows: Column) -> Column:
        twice = F.filter(windows, lambda w, i: (w["h"] == F.get(windows, i - 1)["h"]) | (w["h"] == F.get(windows, i + 1)["h"]))
        return _let(F.sort_array(F.transform(twice, lambda w: w["i"])), covered)

    def hashed(h: Column) -> Column:
        n = F.size(h)
        thirds = F.arrays_zip(F.slice(h, 1, n - 2).alias("a"), F.slice(h, 2, n - 2).alias("b"), F.slice(h, 3, n - 2).alias("c"))
        windows = F.transform(thirds, lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("h"), i.alias("i")))
        return F.when(n < 4, F.lit(0)).otherwise(_let(F.sort_array(windows), sorted_windows))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), hashed).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return _let(_lines(text), lambda some: F.size(some) - F.size(F.array_distinct(some))).cast("long")


@dataclass(frozen=True)
class Rule:
    """`rejects` and `work` are made from the text, its words and facts that are at hand. `work`: the rule's cost in about
    nanoseconds, estimated from what it has to look at."""

    name: str
    rejects: Callable[[Column, Column, dict[str, Column]], Column]
    work: Callable[[Column, Column], Column]


def _chars(each: float) -> Callable[[Column, Column], Column]:
    return lambda text, words: F.length(text) * each


def _fact(facts: dict[str, Column], name: str, otherwise: Column) -> Column:
    return facts[name] if name in facts else otherwise


BASE = (
    Rule("short", lambda t, w, f: F.size(w) < 50, lambda t, w: F.lit(1.0)),
    Rule("repeated words", lambda t, w, f: _fact(f, "n_repeat_words", repeated_words(w)) * 100 > F.size(w) * 50,
         lambda t, w: F.size(w) * F.log2(F.size(w) + 2.0) * 60),
)
MORE = (
    Rule("symbols", lambda t, w, f: _fact(f, "n_symbols", _count(t, SYMBOLS)) * 10 > F.size(w) * 3, _chars(8)),
    Rule("shouting", lambda t, w, f: _count(t, "A-Z") * 2 > _fact(f, "word_chars", word_characters(w)), _chars(12)),
    Rule("exclamations", lambda t, w, f: _count(t, "!") * 2 > F.size(w), _chars(8)),
    Rule("digits", lambda t, w, f: _count(t, "0-9") * 10 > _fact(f, "word_chars", word_characters(w)) * 3, _chars(8)),
    Rule("repeated lines", lambda t, w, f: _fact(f, "n_dup_lines", repeated_lines(t)) * 2 > F.size(_lines(t)), _chars(6)),
    Rule("word length", lambda t, w, f: ~_fact(f, "word_chars", word_characters(w)).between(2 * F.size(w), 15 * F.size(w)), _chars(4)),
)


def cascade(docs: DataFrame, rules: tuple[Rule, ...], text: str, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules ordered by rejection per cost, both measured on a sample of about `sample_rows` rows. Only the order comes
    from the sample; every rule still judges all rows. Rules that reject alike keep the given order."""
    n = docs.count()
    if not n or len(rules) < 2:
        return list(rules)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    some = docs.select(t.alias("t")).sample(min(1.0, sample_rows / n), 42).select("t", words_of(F.col("t")).alias("w"))
    t, w = F.col("t"), F.col("w")
    found = some.agg(*(F.avg(r.rejects(t, w, {}).cast("double")).alias(f"r{i}") for i, r in enumerate(rules)),
                     *(F.avg(r.work(t, w)).alias(f"c{i}") for i, r in enumerate(rules))).first()
    gain = [(found[f"r{i}"] or 0.0) / max(found[f"c{i}"] or 0.0, 1e-9) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -gain[i])]


def verdict(rules: list[Rule], text: Column, words: Column, facts: dict[str, Column]) -> Column:
    """The name of the first rule that rejects the text, or NULL; later rules are then not evaluated."""
    out = None
    for rule in rules:
        bad = F.coalesce(rule.rejects(text, words, facts), F.lit(False))
        out = F.when(bad, F.lit(rule.name)) if out is None else out.when(bad, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def quality_facts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Words are runs of anything but [\\x20\\x09-\\x0D]. base_failed: fewer than 50 words, or more than half of the words in
    3-word windows that occur twice or more. kept: not base_failed, and no rule of the cascade rejects. The facts are given for
    all rows; the rules beyond them run in the cascade's order and only until one rejects.

    NULL is an empty text: zeros, base_failed. A NULL id stays NULL. Repeated rows are judged alike. Other columns are ignored."""
    order = cascade(docs, rules, text)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    own = own.select("doc_id", "t", words_of(F.col("t")).alias("w"))
    t, w = F.col("t"), F.col("w")
    own = own.select("doc_id", "t", "w", F.size(w).cast("long").alias("n_words"), word_characters(w).alias("word_chars"),
                     _count(t, SYMBOLS).alias("n_symbols"), repeated_lines(t).alias("n_dup_lines"),
                     repeated_words(w).alias("n_repeat_words"))
    facts = {n: F.col(n) for n in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                      F.when(failed, F.lit(False)).otherwise(verdict(order, t, w, facts).isNull()).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """`docs` without the rows that a rule rejects. All rules, those of the base too, are one cascade: a text that a cheap
    rule rejects is never hashed or sorted. A NULL text is rejected as short."""
    order = cascade(docs, rules, text)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.where(_let(t, lambda own: _let(words_of(own), lambda w: verdict(order, own, w, {}).isNull())))
