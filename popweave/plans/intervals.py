"""Lookups by interval, planned as hash joins on a slot number plus a residual test."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.plans.ranking import join_keys, running_total
from popweave.session import cut_lineage


def cumulative_table(table: DataFrame, cell: Sequence[str], weight: str, order: Sequence[str],
                     slice_: Column | None = None) -> DataFrame:
    """Add ``lo``/``hi`` (running weight) to a weight table, zero weights dropped.

    Pass ``slice_`` when a cell can hold many entries. Real weights are added as decimals, which is exact, so ``lo`` is
    always the ``hi`` of the entry before: no gaps, no overlaps.
    """
    kept = table.filter(F.col(weight) > 0)
    real = dict(kept.dtypes)[weight] in ("double", "float")
    value = F.col(weight).cast("decimal(38,18)") if real else F.col(weight)
    if slice_ is not None:
        got = running_total(kept, cell, [F.col(o) for o in order], slice_, value, "hi")
    else:
        w = W.partitionBy(*cell).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        got = kept.withColumn("hi", F.sum(value).over(w))
    got = got.withColumn("lo", F.col("hi") - value)
    return got.withColumns({c: F.col(c).cast("double") for c in ("lo", "hi")}) if real else got


def pick(people: DataFrame, table: DataFrame, cell: Sequence[str], take: Sequence[str],
         u: Column | None = None, position: Column | None = None, how: str = "inner") -> DataFrame:
    """Give every person the entry of its cell whose [lo, hi) holds the position.

    ``table`` comes from ``cumulative_table``. The position is ``u * total`` for a
    draw, or a 0-based rank for an exact allocation. Each cell is cut into as many
    slots as it has entries (16 at least): the exploded table has at most twice its
    rows plus 16 per cell, and a person meets two candidates on average. No ``cell`` means one table for all.
    """
    if not cell:
        table = cut_lineage(table)
    slots = table.groupBy(*cell).agg(F.greatest(F.count(F.lit(1)), F.lit(16)).alias("__n"),
                                     F.max("hi").alias("__t"))
    slot_of = lambda x: F.least(F.floor(x.cast("double") * F.col("__n") / F.col("__t")), F.col("__n") - 1)
    if cell:
        sized = lambda df, how: join_keys(df, slots, cell, how)
    else:
        one = slots.select(F.struct("__n", "__t")).scalar()
        sized = lambda df, how: df.withColumns({"__n": one["__n"], "__t": one["__t"]})
    wide = (sized(table, "inner")
            .select(*cell, *take, "lo", "hi", F.explode(F.sequence(slot_of(F.col("lo")), slot_of(F.col("hi")))).alias("__slot")))
    who = sized(people, how)
    pos = u * F.col("__t") if position is None else position
    who = who.withColumn("__pos", pos).withColumn("__slot", slot_of(F.col("__pos")))
    keys = [*cell, "__slot"]
    r = wide.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = (F.col("__pos") >= F.col("lo")) & (F.col("__pos") < F.col("hi"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return who.join(r, cond, how).select(*people.columns, *take)


def range_lookup(df: DataFrame, value: str, bands: DataFrame, lo: str, hi: str, how: str = "inner") -> DataFrame:
    """Attach every band with lo <= value <= hi for whole values; a fraction lies in no band.

    Bands are opened to one row per integer, so the join is a hash join.
    """
    wide = bands.withColumn("__x", F.explode(F.sequence(F.col(lo), F.col(hi))))
    return df.join(wide, (df[value].cast("bigint") == wide["__x"].cast("bigint")) & (df[value] == wide["__x"]), how).drop("__x")
