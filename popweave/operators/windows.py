"""Ordered statistics inside groups, first-wins choices and top-k."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.plans.ranking import (average_rank, join_keys, magnitude_slice, previous_value, quantiles, rank_by_value,
                                    running_total)
from popweave.session import cut_lineage

__all__ = ["average_rank", "terciles", "coverage", "consecutive_gaps", "strata_by_size", "first_wins", "carry_forward",
           "top_k", "cumulative_share", "spearman"]


def terciles(df: DataFrame, group: Sequence[str], value: str, tie: str, out: str = "tercile", k: int = 3) -> DataFrame:
    """Quantile class 1..k of the first-rank of ``value`` inside a group."""
    ranked = rank_by_value(df, group, value, tie, "__r")
    n = df.groupBy(*group).agg(F.count("*").alias("__n"))
    j = join_keys(ranked, n, list(group))
    cls = F.greatest(F.lit(1), F.ceil(F.try_divide(F.lit(k) * (F.col("__r") - 1), F.col("__n") - 1)))
    return j.withColumn(out, F.coalesce(cls, F.lit(1)).cast("int")).drop("__r", "__n")


def cumulative_share(df: DataFrame, keys: Sequence[str], label: str, weight: str) -> DataFrame:
    """Shares in falling order with their running sum; one row per (keys, label)."""
    g = df.groupBy(*keys, label).agg(F.sum(weight).alias("w"))
    cum = running_total(g, keys, [F.desc("w"), F.col(label)], -magnitude_slice(F.col("w")), F.col("w"), "cum")
    tot = g.groupBy(*keys).agg(F.sum("w").alias("total"))
    return join_keys(cum, tot, list(keys)) if keys else cum.withColumn("total", tot.scalar())


def coverage(df: DataFrame, keys: Sequence[str], label: str, weight: str, levels: Sequence[float] = (0.9, 0.95)) -> DataFrame:
    """How many labels, most frequent first, reach each share of the mass."""
    c = cumulative_share(df, keys, label, weight)
    return c.groupBy(*keys).agg(F.count("*").alias("labels"), *[
        (F.sum(F.when(F.col("cum") < F.lit(q) * F.col("total"), 1).otherwise(0)) + 1).alias(f"n{round(q * 100)}") for q in levels])


def consecutive_gaps(df: DataFrame, group: Sequence[str], value: str, tie: str) -> DataFrame:
    """Difference to the next smaller value of the same group."""
    d = previous_value(df, group, value, tie, [value])
    return d.filter(F.col(f"prev_{value}").isNotNull()).withColumn("gap", F.col(value) - F.col(f"prev_{value}")).drop(f"prev_{value}")


def strata_by_size(df: DataFrame, unit: str, k: int = 3) -> DataFrame:
    """Units with their size and the size class between interpolated quantile bounds."""
    u = cut_lineage(df.groupBy(unit).agg(F.count("*").alias("size")))
    b = quantiles(u, [], "size", {f"b{i}": i / k for i in range(1, k)})
    s = b.select(F.struct(*b.columns)).scalar()
    return u.withColumn("stratum", sum(((F.col("size") > s[f"b{i}"]).cast("int") for i in range(1, k)), F.lit(1)))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key, the smallest in ``order``; an aggregate, so copies shrink before the shuffle."""
    rest = [c for c in keep if c not in order and c not in keys]
    m = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__m"))
    return m.select(*keys, *[F.col(f"__m.{c}").alias(c) for c in keep if c not in keys])


def carry_forward(df: DataFrame, group: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Last non-null value at or before the numeric ``order``.

    A long group is cut into slices: what a slice lacks comes from the last slice before it that has a value.
    """
    marked = df.withColumn("__g", F.struct(*group, magnitude_slice(F.col(order)).alias("__s")))
    inside = W.partitionBy("__g").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*[f"__g.{k}" for k in group]).orderBy("__g.__s").rowsBetween(W.unboundedPreceding, -1)
    last = marked.groupBy("__g").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__l"))
    last = last.select("__g", F.last("__l", ignorenulls=True).over(before).alias("__p"))
    got = marked.withColumn("__q", F.last(value, ignorenulls=True).over(inside)).join(last, "__g")
    return got.withColumn(out, F.coalesce("__q", "__p")).drop("__g", "__q", "__p")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group; every task keeps only its own k before the shuffle."""
    if not group:
        return df.orderBy(*order).limit(k)
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman correlation per group over rows where both are present."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    c = d.groupBy(*keys, x, y).agg(F.count("*").alias("__n"))
    def ranks(v, out):
        n = c.groupBy(*keys, v).agg(F.sum("__n").alias("__k"))
        cum = running_total(n, keys, [F.col(v)], magnitude_slice(F.col(v)), F.col("__k"), "__c")
        return cum.select(*keys, v, (F.col("__c") - (F.col("__k") - 1) / F.lit(2.0)).alias(out))
    j = join_keys(join_keys(c, ranks(x, "rx"), [*keys, x]), ranks(y, "ry"), [*keys, y])
    n, rx, ry = F.col("__n"), F.col("rx"), F.col("ry")
    g = j.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * rx).alias("sx"), F.sum(n * ry).alias("sy"), F.sum(n * rx * ry).alias("sxy"),
                             F.sum(n * rx * rx).alias("sxx"), F.sum(n * ry * ry).alias("syy"))
    c_ = lambda a: F.col(a)
    cov = c_("sxy") - c_("sx") * c_("sy") / c_("n")
    var = (c_("sxx") - c_("sx") * c_("sx") / c_("n")) * (c_("syy") - c_("sy") * c_("sy") / c_("n"))
    return g.select(*keys, "n", F.when(var > 0, cov / F.sqrt(var)).alias("rho"))
