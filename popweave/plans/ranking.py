"""Ranks, running totals and quantiles that never put a whole group in one task.

A plain window over a group sorts the group in a single task. Here every group is
cut into ordered slices by a pure function of the ordering value: the window works
inside a slice and the slice totals, a small table, supply the offset.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.session import salt_count

Key = Sequence[str]
SLICE_BITS = 12


def join_keys(left: DataFrame, right: DataFrame, keys: Key, how: str = "inner") -> DataFrame:
    """Null-safe equi-join on same-named keys; the left keys are kept."""
    if not keys:
        raise ValueError("join_keys needs at least one key")
    ren = {k: f"__r_{k}" for k in keys}
    r = right.withColumnsRenamed(ren)
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[ren[k]])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*ren.values())


def magnitude_slice(value: Column) -> Column:
    """Monotone slice number of a numeric value, from integer bit arithmetic only.

    2048 slices per power of two, so it adapts to any scale without a pass over the
    data for bounds, and consecutive ids spread over thousands of slices. Below 9e12 millionths count; above, whole
    numbers do, and their slices follow on.
    """
    v = value.cast("double")
    large = F.abs(v) >= F.lit(9e12)
    mag = F.when(large, F.least(F.abs(v), F.lit(9e18))).otherwise(F.abs(v) * F.lit(1e6)).cast("bigint")
    width = F.length(F.bin(mag))
    top = F.call_function("shiftright", mag, F.greatest(width - F.lit(SLICE_BITS), F.lit(0)))
    level = width + F.when(large, F.lit(64)).otherwise(F.lit(0))
    return (F.signum(v).cast("int") * (level * F.lit(1 << SLICE_BITS) + top).cast("int")).cast("int")


def key_slice(df: DataFrame, column: str) -> Column:
    """Monotone slice number of an ordering key: the magnitude of a number, the first seven bytes of a text."""
    if dict(df.dtypes)[column] != "string":
        return magnitude_slice(F.col(column))
    head = F.hex(F.substring(F.col(column).cast("binary"), 1, 7))
    return F.conv(F.rpad(head, 14, "0"), 16, 10).cast("bigint")


def _sliced(df: DataFrame, keys: Key, slice_: Column, value: Column) -> DataFrame:
    return df.withColumn("__v", value).withColumn("__g", F.struct(*keys, slice_.alias("__s")))


def _slice_totals(marked: DataFrame) -> DataFrame:
    return marked.groupBy("__g").agg(F.sum("__v").alias("__t"))


def running_total(df: DataFrame, keys: Key, order: Sequence[Column], slice_: Column, value: Column,
                  out: str, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` inside ``keys`` ordered by ``order``.

    ``slice_`` must never decrease along ``order``. ``order`` must be total. Group and slice travel
    as one struct: equality on it is null-safe, and the join reuses the window's partitioning.
    """
    marked = _sliced(df, keys, slice_, value)
    before = W.partitionBy(*[f"__g.{k}" for k in keys]).orderBy("__g.__s").rowsBetween(W.unboundedPreceding, -1)
    offsets = _slice_totals(marked).select("__g", F.sum("__t").over(before).alias("__o"))
    inside = W.partitionBy("__g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    got = marked.withColumn("__i", F.sum("__v").over(inside)).join(offsets, "__g")
    total = F.col("__i") + F.coalesce(F.col("__o"), F.lit(0))
    if not inclusive:
        total = total - F.col("__v")
    return got.withColumn(out, total).drop("__g", "__v", "__i", "__o")


def _draw_slice(df: DataFrame, draw_col: str) -> Column:
    return F.floor(F.col(draw_col) * salt_count(df.sparkSession)).cast("int")


def rank_by_draw(df: DataFrame, keys: Key, draw_col: str, ties: Key, out: str = "rank", slices: DataFrame | None = None, most: DataFrame | None = None) -> DataFrame:
    """1-based rank inside ``keys`` by a uniform draw in [0, 1), ties by ``ties``.

    With the written ``slices`` of ``slices_by_draw`` and ``most(keys, __most)``, slices that begin at rank ``__most`` or
    above, and groups without one, are left out before rows are dealt and sorted.
    """
    order, slice_, one = [F.col(draw_col), *map(F.col, ties)], _draw_slice(df, draw_col), F.lit(1).cast("bigint")
    if slices is None:
        return running_total(df, keys, order, slice_, one, out)
    before = W.partitionBy(*[f"__g.{k}" for k in keys]).orderBy("__g.__s").rowsBetween(W.unboundedPreceding, -1)
    wanted = (slices.withColumn("__o", F.coalesce(F.sum("__t").over(before), F.lit(0))).select("__g", "__o", *[F.col(f"__g.{k}").alias(k) for k in keys])
              .join(most, list(keys)).where("__o < __most").select("__g", "__o"))
    inside = W.partitionBy("__g").orderBy(*order)
    got = _sliced(df, keys, slice_, one).join(wanted, "__g").withColumn(out, F.col("__o") + F.row_number().over(inside))
    return got.drop("__g", "__v", "__o")


def slices_by_draw(df: DataFrame, keys: Key, draw_col: str) -> DataFrame:
    """Rows of every slice that ``rank_by_draw`` cuts."""
    return _slice_totals(_sliced(df, keys, _draw_slice(df, draw_col), F.lit(1).cast("bigint")))


def sizes_of_slices(slices: DataFrame, keys: Key) -> DataFrame:
    """``(keys, __most)``: rows of every group, from its slices."""
    return slices.groupBy(*[F.col(f"__g.{k}").alias(k) for k in keys]).agg(F.sum("__t").alias("__most"))


def sizes_by_draw(df: DataFrame, keys: Key, draw_col: str, out: str = "n") -> DataFrame:
    """Rows per group, added up from the slice counts of ``rank_by_draw`` so that one exchange serves both."""
    return _slice_totals(_sliced(df, keys, _draw_slice(df, draw_col), F.lit(1).cast("bigint"))).groupBy(*[F.col(f"__g.{k}").alias(k) for k in keys]).agg(F.sum("__t").alias(out))


def rank_by_value(df: DataFrame, keys: Key, value: str, tie: str, out: str = "rank") -> DataFrame:
    """1-based rank by (value, tie); equal values are counted first, so a value that
    holds most rows is still split by the numeric ``tie``."""
    marked = df.withColumn("__h", F.struct(*keys, value, magnitude_slice(F.col(tie)).alias("__ts")))
    groups = marked.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).select("__h", "__n", *[f"__h.{k}" for k in keys])
    base = running_total(groups, keys, [F.col(f"__h.{value}"), F.col("__h.__ts")], magnitude_slice(F.col(f"__h.{value}")),
                         F.col("__n"), "__base", inclusive=False).select("__h", "__base")
    inner = marked.withColumn("__i", F.row_number().over(W.partitionBy("__h").orderBy(tie)))
    return inner.join(base, "__h").withColumn(out, F.col("__base") + F.col("__i")).drop("__h", "__i", "__base")


def average_rank(df: DataFrame, keys: Key, value: str, out: str = "rank") -> DataFrame:
    """Rank with ties averaged, as used by Spearman correlation."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cum = running_total(counts, keys, [F.col(value)], magnitude_slice(F.col(value)), F.col("__n"), "__c")
    ranks = cum.select(*keys, value, (F.col("__c") - (F.col("__n") - 1) / F.lit(2.0)).alias(out))
    return join_keys(df, ranks, [*keys, value])


def quantiles(df: DataFrame, keys: Key, value: str, qs: dict[str, float], weight: Column | None = None,
              method: str = "linear") -> DataFrame:
    """Exact quantiles per group, one column per entry of ``qs``.

    ``linear`` interpolates between order statistics; ``first`` takes the first
    value whose cumulative weight share reaches q.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight
    vals = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(w).alias("__w"))
    vals = vals.filter(F.col("__w") > 0)
    cum = running_total(vals, keys, [F.col(value)], magnitude_slice(F.col(value)), F.col("__w"), "__c")
    tot = vals.groupBy(*keys).agg(F.sum("__w").alias("__t"))
    j = join_keys(cum, tot, keys) if keys else cum.withColumn("__t", tot.scalar())
    v = F.col(value)
    aggs = []
    for name, q in qs.items():
        if method == "linear":
            pos = (F.col("__t") - 1) * F.lit(float(q))
            lo = F.min(F.when(F.col("__c") > F.floor(pos), v))
            hi = F.min(F.when(F.col("__c") > F.ceil(pos), v))
            frac = F.max(pos - F.floor(pos))
            aggs.append((lo + (hi - lo) * frac).alias(name))
        else:
            aggs.append(F.min(F.when(F.col("__c") >= F.col("__t") * F.lit(float(q)), v)).alias(name))
    return j.groupBy(*keys).agg(*aggs)


def previous_value(df: DataFrame, keys: Key, value: str, tie: str, carry: Sequence[str]) -> DataFrame:
    """``prev_<c>`` of the row before, inside ``keys`` ordered by (value, tie).

    The first row of a slice takes the last row of the nearest earlier slice.
    """
    marked = df.withColumn("__g", F.struct(*keys, magnitude_slice(F.col(value)).alias("__s")))
    packed = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"), *[F.col(c).alias(f"c_{c}") for c in carry])
    last = marked.groupBy("__g").agg(F.max(packed).alias("__l"))
    last = last.select("__g", F.lag("__l").over(W.partitionBy(*[f"__g.{k}" for k in keys]).orderBy("__g.__s")).alias("__p"))
    inside = W.partitionBy("__g").orderBy(value, tie)
    got = marked.withColumn("__q", F.lag(packed).over(inside)).join(last, "__g")
    src = F.coalesce(F.col("__q"), F.col("__p"))
    return got.select(*df.columns, *[src[f"c_{c}"].alias(f"prev_{c}") for c in carry])
