"""Binomial and hypergeometric counts by inversion of one uniform draw, as column expressions.

The weights of the distribution start at 1 at its mode and follow from the ratio of neighbours. Their sum is one over the
share of the mode, which has a closed form (Loader's: Stirling's rest and deviance terms, so nothing is lost at large
counts). A walk outwards from the mode stops where the running sum passes the draw's share: mode, mode + 1, mode - 1,
mode + 2 and so on. It goes as far as a normal law would need for this draw, and only if that is not enough nine
deviations and 30 steps from the mode (the rest is below 1e-15). So a count of n costs a little more than a deviation.
"""
from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

DEVIATIONS, STEPS, NEAR = 9, 30, 3
# what Stirling's formula leaves of ln(n!), for n from 0 to 15; 0 has nothing to leave
REST = [0.0, *(math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16))]


def _let(fields: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``fields`` once and hand them to ``body`` as a struct."""
    one = F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.transform(one, body)[0]


def _rest(n: Column) -> Column:
    """What Stirling's formula leaves of ln(n!)."""
    q = 1 / (n * n)
    series = (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q * (1 / 1188))))) / n
    return F.when(n < len(REST), F.element_at(F.expr(f"array({', '.join(f'{r!r}D' for r in REST)})"), n.cast("int") + 1)).otherwise(series)


def _deviance(s: Column) -> Column:
    """x ln(x / mean) + mean - x, without loss where x is near the mean; ``v`` is their difference over their sum."""
    w = s["v"] * s["v"]
    series = s["v"] * (s["x"] - s["mean"] + 2 * s["x"] * w * (1 / 3 + w * (1 / 5 + w / 7)))
    return F.when(F.abs(s["v"]) < 0.02, series).otherwise(s["x"] * F.log(s["x"] / s["mean"]) + s["mean"] - s["x"])


def _trials(x: Column, n: Column, hits: Column, misses: Column, sign: int = 1) -> Column:
    return F.struct(x.alias("x"), n.alias("n"), hits.alias("hits"), misses.alias("misses"), F.lit(float(sign)).alias("sign"))


def _one_over_share(*trials: Column) -> Column:
    """One over the chance of ``x`` hits in ``n`` trials that have ``hits`` and ``misses`` on average, over all ``trials``."""
    def log_share(s: Column) -> Column:
        x, n = s["x"], s["n"]
        sides = F.array(*(F.struct(y.alias("x"), mean.alias("mean"), ((y - mean) / (y + mean)).alias("v")) for y, mean in ((x, s["hits"]), (n - x, s["misses"]))))
        rest = F.aggregate(F.array(n, -x, x - n), F.lit(0.0), lambda t, y: t + F.signum(y) * _rest(F.abs(y)))
        both = F.aggregate(sides, rest + F.log(n / (2 * math.pi * x * (n - x))) / 2, lambda t, y: t - _deviance(y))
        return F.when(x <= 0, n * F.log1p(-s["hits"] / n)).when(x >= n, n * F.log1p(-s["misses"] / n)).otherwise(both)

    return F.exp(F.aggregate(F.array(*trials), F.lit(0.0), lambda t, s: t - s["sign"] * log_share(s)))


def _walk(v: Column, total: Column, up: Callable[[Column, Column], Column], down: Callable[[Column, Column], Column]) -> Column:
    """The count for the struct ``v`` with u, low, high, mode, sd and what the ratios need (all doubles)."""
    reach = F.least(v["high"] - v["low"], F.ceil(DEVIATIONS * v["sd"]).cast("double") + STEPS)
    near = F.least(reach, F.ceil(v["sd"] * F.sqrt(-2 * F.log1p(-v["u"]))) + NEAR)
    above = lambda w, i: F.when(v["mode"] + i <= v["high"], w * up(v, v["mode"] + i - 1)).otherwise(F.lit(0.0))
    below = lambda w, i: F.when(v["mode"] - i >= v["low"], w * down(v, v["mode"] - i + 1)).otherwise(F.lit(0.0))
    one, none = F.lit(1.0), F.lit(None).cast("double")

    def stop(s: Column, i: Column) -> Column:
        def on(w: Column) -> Column:
            after = s["left"] - w["a"]
            got = F.when(after < 0, v["mode"] + i).when(after - w["b"] < 0, v["mode"] - i)
            return F.struct((after - w["b"]).alias("left"), w["a"].alias("a"), w["b"].alias("b"), got.alias("got"))
        return F.when(s["got"].isNotNull(), s).otherwise(_let({"a": above(s["a"], i), "b": below(s["b"], i)}, on))

    def find(t: Column) -> Column:
        start = F.struct(t["left"].alias("left"), one.alias("a"), one.alias("b"), none.alias("got"))
        upto = lambda got, steps: F.coalesce(got, F.aggregate(F.sequence(F.lit(1), steps.cast("int")), start, stop)["got"])       # noqa: E731
        return F.when(t["left"] < 0, v["mode"]).otherwise(F.coalesce(F.aggregate(F.array(near, reach), none, upto), v["mode"]))

    return F.when(v["high"] <= v["low"], v["low"]).otherwise(_let({"left": v["u"] * total - 1}, find)).cast("bigint")


def binomial_count(u: Column, n: Column, part: Column, whole: Column) -> Column:
    """Hits among ``n`` trials with chance ``part / whole`` for a uniform ``u``; all trials hit when part reaches whole."""
    d = lambda c: c.cast("double")
    fields = {"u": u, "n": d(n), "w": d(part), "t": d(whole)}

    def body(s: Column) -> Column:
        p = s["w"] / s["t"]
        more = {"u": s["u"], "n": s["n"], "low": F.lit(0.0), "high": s["n"], "mode": F.least(s["n"], F.floor((s["n"] + 1) * s["w"] / s["t"]).cast("double")),
                "sd": F.sqrt(s["n"] * p * (1 - p)), "odds": s["w"] / (s["t"] - s["w"])}
        total = lambda v: _one_over_share(_trials(v["mode"], v["n"], v["n"] * s["w"] / s["t"], v["n"] * (s["t"] - s["w"]) / s["t"]))       # noqa: E731
        drawn = _let(more, lambda v: _walk(v, total(v), lambda v, x: (v["n"] - x) / (x + 1) * v["odds"],
                                           lambda v, x: x / (v["n"] - x + 1) / v["odds"]))
        return (F.when((s["n"] <= 0) | (s["w"] <= 0), F.lit(0).cast("bigint"))
                .when(s["w"] >= s["t"], s["n"].cast("bigint")).otherwise(drawn))

    return _let(fields, body)


def hypergeometric_count(u: Column, size: Column, marked: Column, taken: Column) -> Column:
    """Marked members among ``taken`` drawn without replacement from ``size`` members, ``marked`` of them marked."""
    d = lambda c: c.cast("double")
    fields = {"u": u, "n": d(size), "k": d(marked), "m": d(taken)}

    def body(s: Column) -> Column:
        n, k, m = s["n"], s["k"], s["m"]
        low, high = F.greatest(F.lit(0.0), m + k - n), F.least(k, m)
        mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
        var = F.try_divide(m * (k / n) * ((n - k) / n) * (n - m), n - 1)
        more = {"u": s["u"], "n": n, "k": k, "m": m, "low": low, "high": high, "mode": mode, "sd": F.sqrt(F.coalesce(var, F.lit(0.0)))}

        def total(v: Column) -> Column:
            n, k, m = v["n"], v["k"], v["m"]
            part = lambda x, k: _trials(x, k, k * m / n, k * (n - m) / n)       # noqa: E731
            return _one_over_share(part(v["mode"], k), part(m - v["mode"], n - k), _trials(m, n, m, n - m, -1))

        drawn = _let(more, lambda v: _walk(
            v, total(v), lambda v, x: (v["k"] - x) * (v["m"] - x) / ((x + 1) * (v["n"] - v["k"] - v["m"] + x + 1)),
            lambda v, x: x * (v["n"] - v["k"] - v["m"] + x) / ((v["k"] - x + 1) * (v["m"] - x + 1))))
        return F.when((n <= 0) | (k <= 0) | (m <= 0), F.lit(0).cast("bigint")).otherwise(drawn)

    return _let(fields, body)


def _count_sql(src: str, ids: str, low: str, high: str, mode: str, log_p: str) -> str:
    """One row per row of ``src`` (columns ``ids`` and ``u``) with the drawn count ``x``, from plain log probabilities.

    ``log_p`` is a template over the value in braces."""
    return (f"SELECT {ids}, arg_min(x, z) FILTER (c > u * t) AS x FROM (SELECT *, sum(p) OVER (PARTITION BY {ids} ORDER BY z) AS c, sum(p) OVER (PARTITION BY {ids}) AS t FROM "
            f"(SELECT *, CASE WHEN lo = hi THEN 1 ELSE exp({log_p.format('x')} - ({log_p.format('mo')})) END AS p, CASE WHEN x > mo THEN 2 * (x - mo) - 1 ELSE 2 * (mo - x) END AS z FROM "
            f"(SELECT *, unnest(range(lo, hi + 1)) AS x FROM (SELECT *, least(hi, greatest(lo, {mode}))::BIGINT AS mo FROM (SELECT *, ({low})::BIGINT AS lo, ({high})::BIGINT AS hi FROM {src}))))) GROUP BY {ids}")


def binomial_sql(src: str, ids: str) -> str:
    """The SQL side of ``binomial_count``; ``src`` has n, w (part), t0 (whole) and u."""
    return _count_sql(src, ids, "CASE WHEN w >= t0 THEN n ELSE 0 END", "CASE WHEN w <= 0 THEN 0 ELSE n END", "floor((n + 1) * w::DOUBLE / t0)",
                      "CASE WHEN {0} > 0 THEN {0} * ln(w::DOUBLE / t0) ELSE 0 END + CASE WHEN n > {0} THEN (n - {0}) * ln(1 - w::DOUBLE / t0) ELSE 0 END - lgamma({0} + 1.0) - lgamma(n - {0} + 1.0)")


def hypergeometric_sql(src: str, ids: str) -> str:
    """The SQL side of ``hypergeometric_count``; ``src`` has n (size), k (marked), m (taken) and u."""
    return _count_sql(src, ids, "greatest(0, m + k - n)", "least(k, m)", "floor((m + 1) * (k + 1)::DOUBLE / (n + 2))",
                      "- lgamma({0} + 1.0) - lgamma(k - {0} + 1.0) - lgamma(m - {0} + 1.0) - lgamma(n - k - m + {0} + 1.0)")
