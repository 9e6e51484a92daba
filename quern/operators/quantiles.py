"""Exact order statistics and quantiles of many columns at once, without holding a column in one task.

Spark's `percentile` keeps a map of every distinct value in the final task, which is fatal for a long column of many
values. Here each wanted rank is bracketed with `approx_percentile`, the bracket is counted exactly, and the search goes
on inside it until few enough values are left to gather. Every pass is one aggregation with map-side combining and no row
shuffle; a pass narrows a bracket by a factor of a few thousand, so 10^12 values need about three. The ends of a bracket
are excluded from the next one, so a value that holds a third of all rows is resolved as soon as it becomes an end.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.names import double

GATHER_VALUES = 300_000    # values collected in one job to finish searches, over all brackets
ACCURACY = 10_000
EXPRESSIONS = 240          # aggregate expressions per job


def chunks(items: list, size: int) -> Iterable[list]:
    for i in range(0, len(items), size):
        yield items[i:i + size]


def agg_row(df: DataFrame, expressions: list[str]) -> list:
    """One row of aggregates, split over several jobs when there are very many. Jobs touch different columns, so
    column pruning keeps the total scan the same."""
    out: list = []
    for part in chunks(expressions, EXPRESSIONS):
        row = df.agg(*[F.expr(e).alias(f"a{i}") for i, e in enumerate(part)]).first()
        out.extend(row)
    return out


def quantiles(df: DataFrame, wanted: dict[str, tuple[str, list[float]]], counts: dict[str, int] | None = None
              ) -> dict[str, dict[float, float | None]]:
    """Linear-interpolation quantiles. `wanted` maps a key to (SQL double expression, probabilities)."""
    if not wanted:
        return {}
    keys = list(wanted)
    if counts is None:
        counts = dict(zip(keys, agg_row(df, [f"count({wanted[k][0]})" for k in keys])))
    out: dict[str, dict[float, float | None]] = {k: {} for k in keys}
    live = []
    for k in keys:
        if counts[k]:
            live.append(k)
        else:
            out[k] = {p: None for p in wanted[k][1]}
    ranks: dict[str, tuple[str, list[int]]] = {}
    for k in live:
        expr, ps = wanted[k]
        places = [p * (counts[k] - 1) for p in ps]
        ranks[k] = (expr, sorted({math.floor(h) for h in places} | {math.ceil(h) for h in places}))
    found = order_statistics(df, ranks, counts)
    for k in live:
        for p in wanted[k][1]:
            h = p * (counts[k] - 1)
            low, high = found[k][math.floor(h)], found[k][math.ceil(h)]
            out[k][p] = low + (high - low) * (h - math.floor(h))
    return out


def order_statistics(df: DataFrame, wanted: dict[str, tuple[str, list[int]]], counts: dict[str, int],
                     gather: int | None = None) -> dict[str, dict[int, float]]:
    """Exact values at zero-based ranks of the non-null values of each expression."""
    found: dict[str, dict[int, float]] = {k: {} for k in wanted}
    # one open search per (key, rank): the open interval (low, high), rows below it and rows inside it
    searches = {(k, r): (None, None, 0, counts[k]) for k, (_, rs) in wanted.items() for r in rs}

    def inside(key: str, low, high) -> str:
        expr = wanted[key][0]
        tests = [f"({expr}) > {double(low)}"] if low is not None else []
        tests += [f"({expr}) < {double(high)}"] if high is not None else []
        return " AND ".join(tests) or "true"

    while searches:
        share = gather or GATHER_VALUES // len({(k, v[0], v[1]) for (k, _), v in searches.items()}) or 1
        ready = {s: v for s, v in searches.items() if v[3] <= share}
        brackets = sorted({(k, v[0], v[1]) for (k, _), v in ready.items()}, key=str)
        for part in chunks(brackets, EXPRESSIONS):
            lists = df.agg(*[
                F.expr(f"sort_array(collect_list(CASE WHEN {inside(*b)} THEN {wanted[b[0]][0]} END))").alias(f"a{i}")
                for i, b in enumerate(part)])
            asked = [[(s, s[1] - v[2]) for s, v in ready.items() if (s[0], v[0], v[1]) == b] for b in part]
            row = lists.selectExpr(*[f"array({', '.join(f'a{i}[{place}]' for _, place in a)}) AS b{i}"
                                     for i, a in enumerate(asked)]).first()
            for values, a in zip(row, asked):
                for ((k, r), _), value in zip(a, values):
                    found[k][r] = value
                    del searches[(k, r)]
        if not searches:
            break
        # one sketch per open bracket, however many ranks are searched in it
        groups: dict[tuple, list[int]] = {}
        for (k, r), (low, high, below, n) in searches.items():
            groups.setdefault((k, low, high, below, n), []).append(r)
        sketches = []
        for (k, low, high, below, n), rs in groups.items():
            slack = 2 * n / ACCURACY + 1
            cuts = [p for r in rs for p in (max(0.0, (r - below - slack) / n), min(1.0, (r - below + slack) / n))]
            sketches.append(f"approx_percentile(CASE WHEN {inside(k, low, high)} THEN {wanted[k][0]} END, "
                            f"array({', '.join(f'{p!r}D' for p in cuts)}), {ACCURACY})")
        cuts_found = agg_row(df, sketches)
        tests, places = [], []
        for (k, low, high, below, n), ends in zip(groups, cuts_found):
            within, e = inside(k, low, high), wanted[k][0]
            for cut in sorted(set(ends)):
                places.append((k, low, high, cut))
                tests += [f"count_if({within} AND ({e}) < {double(cut)})", f"count_if(({e}) = {double(cut)})"]
        flat = agg_row(df, tests)
        tally = {place: (flat[2 * i], flat[2 * i + 1]) for i, place in enumerate(places)}
        for (k, low, high, below, n), rs in groups.items():
            cuts = [(c, *tally[(k, low, high, c)]) for kk, ll, hh, c in places if (kk, ll, hh) == (k, low, high)]
            for r in rs:
                place = r - below
                lower, upper, start, end = low, high, 0, n
                for cut, under, at in cuts:
                    if under <= place < under + at:
                        found[k][r] = cut
                        break
                    if place >= under + at:
                        lower, start = cut, under + at
                    else:
                        upper, end = cut, under
                        break
                if r in found[k]:
                    del searches[(k, r)]
                else:
                    searches[(k, r)] = (lower, upper, below + start, end - start)
    return found
