"""REC-10: Yeo-Johnson power transform. The exponent maximises the Gaussian likelihood; candidates for all columns are
evaluated side by side, a grid per pass. The grid moves outwards, doubling its reach, until the best candidate lies inside it,
and then narrows around the best. Every pass is one aggregate."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from quern.functions.names import double
from quern.operators.quantiles import agg_row

GRID = 17
WIDTH = 4 / 8 ** 5     # of the last grid
FARTHEST = 1e6         # a likelihood that still rises there has no maximum in doubles


def yeo_johnson(x: str, lam: float) -> str:
    """SQL of the transform for a fixed exponent."""
    def branch(base: str, power: float, sign: str) -> str:
        if abs(power) < 1e-12:
            return f"{sign}log1p({base})"
        return f"{sign}(expm1({double(power)} * log1p({base})) / {double(power)})"
    return (f"CASE WHEN {x} >= 0 THEN {branch(x, lam, '')} "
            f"WHEN {x} < 0 THEN {branch('-(' + x + ')', 2 - lam, '-')} END")


def fit_lambdas(df: DataFrame, columns: dict[str, str]) -> dict[str, float]:
    """Exponent per key; `columns` maps a key to a SQL double expression."""
    keys = list(columns)
    if not keys:
        return {}
    flat = agg_row(df, [e for k in keys for e in (
        f"count({columns[k]})", f"avg({columns[k]})", f"sum(sign({columns[k]}) * log1p(abs({columns[k]})))", f"min({columns[k]})")])
    n = {k: flat[4 * i] for i, k in enumerate(keys)}
    centre = {k: flat[4 * i + 1] or 0.0 for i, k in enumerate(keys)}
    log_sum = {k: flat[4 * i + 2] or 0.0 for i, k in enumerate(keys)}
    positive = {k: n[k] > 0 and flat[4 * i + 3] >= 0 for i, k in enumerate(keys)}
    spans, inside, best = {k: (-2.0, 2.0) for k in keys if n[k]}, set(), dict.fromkeys(keys, 1.0)
    while spans:
        grid = [(k, low + (high - low) * i / (GRID - 1)) for k, (low, high) in spans.items() for i in range(GRID)]
        terms = [_spread_term(columns[k], g, centre[k], positive[k]) for k, g in grid]
        sums = agg_row(df, [e for t in terms for e in (f"sum({t})", f"sum({t} * {t})")])
        scores: dict[str, list[tuple[float, float]]] = {k: [] for k in spans}
        for i, (k, g) in enumerate(grid):
            spread = sums[2 * i + 1] / n[k] - (sums[2 * i] / n[k]) ** 2
            if 0 < spread < math.inf:
                log_spread = math.log(spread) + (2 * g * math.log1p(centre[k]) if positive[k] else 0.0)
                scores[k].append((-n[k] / 2 * log_spread + (g - 1) * log_sum[k], g))
        for k, (low, high) in list(spans.items()):
            if not scores[k]:
                del spans[k]
                continue
            best[k] = max(scores[k])[1]
            if k not in inside and best[k] in (low, high) and abs(best[k]) < FARTHEST:
                spans[k] = (best[k] - (high - low), best[k] + (high - low))
            elif high - low <= WIDTH * 1.0001:
                del spans[k]
            else:
                inside.add(k)
                reach = (high - low) / (GRID - 1)
                spans[k] = (best[k] - reach, best[k] + reach)
    return best


def _spread_term(x: str, lam: float, centre: float, positive: bool) -> str:
    """The transform less its value at the mean, which keeps plain sums accurate. For columns without negative values it is also
    divided by the power of the mean, so that large exponents do not overflow."""
    if not positive:
        return f"({yeo_johnson(x, lam)} - {double(bend(centre, lam))})"
    gap = f"(log1p({x}) - {double(math.log1p(centre))})"
    return gap if abs(lam) < 1e-12 else f"(expm1({double(lam)} * {gap}) / {double(lam)})"


def bend(x: float, lam: float) -> float:
    """The transform of one number."""
    base, power, sign = (x, lam, 1.0) if x >= 0 else (-x, 2 - lam, -1.0)
    return sign * (math.log1p(base) if abs(power) < 1e-12 else math.expm1(power * math.log1p(base)) / power)
