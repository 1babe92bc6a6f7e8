"""Null models on cells: replicates multiply cells ``(base, unit, category, n)`` and never persons.

A replicate is drawn as counts. The work of one draw grows with its deviation (the square root of its count at most), a row holds the category
counts of one base or block of units (as many entries as the base has categories), and only cells are shuffled.
Counts must be whole numbers; null bases, units and categories are values of their own.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions.counts import binomial_count, hypergeometric_count
from popweave.functions.draws import draw
from popweave.operators.distances import unit_distances, weighted_distance
from popweave.plans.ranking import join_keys, rank_by_draw
from popweave.session import cut_lineage, salt_count

ROUNDS_IN_A_PLAN = 6


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("\x00"))


def _composition(cells: DataFrame, base: Sequence[str], category: str, n: str) -> DataFrame:
    """Per base the category counts in order of category, as one array, and their sum."""
    c = cells.groupBy(*base, category).agg(F.sum(n).cast("bigint").alias("__w")).filter("__w > 0")
    listed = F.array_sort(F.collect_list(F.struct(F.col(category).alias("k"), F.col("__w").alias("n"))))
    return c.groupBy(*base).agg(listed.alias("__cats"), F.sum("__w").alias("__size"))


def _replicated(df: DataFrame, replicates: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))


def drawn_cells(cells: DataFrame, base: Sequence[str], unit: str, category: str, n: str, replicates: int, channel: str = "floor") -> DataFrame:
    """Cells of B replicates in which each unit draws its total from its base composition (multinomial).

    The categories are drawn one after the other, each as a binomial share of what is left. Result: replicate, base,
    unit, category, n (positive counts only).
    """
    if not base:
        return drawn_cells(cells.withColumn("__all", F.lit(0)), ["__all"], unit, category, n, replicates, channel).drop("__all")
    units = cells.groupBy(*base, unit).agg(F.sum(n).cast("bigint").alias("__n")).filter("__n > 0")
    rows = _replicated(join_keys(units, _composition(cells, base, category, n), base), replicates)
    ids = [_named(F.col(c)) for c in [*base, unit]]
    kind = dict(cells.dtypes)[category]
    start = F.struct(F.col("__n").alias("rest"), F.col("__size").alias("whole"), F.array().cast(f"array<struct<k:{kind},n:bigint>>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        x = binomial_count(draw(channel, "replicate", *ids, _named(c["k"])), s["rest"], c["n"], s["whole"])
        return F.transform(F.array(x), lambda x: F.struct(
            (s["rest"] - x).alias("rest"), (s["whole"] - c["n"]).alias("whole"),
            F.concat(s["out"], F.filter(F.array(F.struct(c["k"].alias("k"), x.alias("n"))), lambda e: e["n"] > 0)).alias("out")))[0]

    got = rows.select("replicate", *base, unit, F.aggregate("__cats", start, step)["out"].alias("__out"))
    return got.select("replicate", *base, unit, F.inline("__out").alias(category, "n"))


def permuted_cells(cells: DataFrame, base: Sequence[str], unit: str, category: str, n: str, replicates: int, channel: str = "perm") -> DataFrame:
    """Cells of B shuffles of the labels inside the base: unit totals and label counts are kept.

    The units of a base, in a drawn order, are the leaves of a binary tree. From the top down each block of units is
    halved: the left half's labels are a hypergeometric draw from the block's, category after category, and the right
    half keeps the rest. Rounds grow with the logarithm of the number of units; a round is one join of blocks.
    Result: replicate, base, unit, category, n (positive counts only).
    """
    if not base:
        return permuted_cells(cells.withColumn("__all", F.lit(0)), ["__all"], unit, category, n, replicates, channel).drop("__all")
    units = cells.groupBy(*base, unit).agg(F.sum(n).cast("bigint").alias("__n")).filter("__n > 0")
    units = rank_by_draw(units.withColumn("__u", draw(f"{channel} order", _named(F.col(unit)))), base, "__u", [unit], "__rank")
    units = cut_lineage(units.select(*base, unit, "__n", (F.col("__rank") - 1).alias("__rank")))
    last = units.agg(F.max("__rank")).first()[0]
    height = int(last or 0).bit_length()
    halves = (units.withColumn("__h", F.explode(F.sequence(F.lit(0), F.lit(height))))
              .groupBy(*base, "__h", F.call_function("shiftright", F.col("__rank"), F.col("__h")).alias("__node")).agg(F.sum("__n").alias("__left")))
    halves = cut_lineage(halves.filter("__node % 2 = 0"))
    kind = f"array<struct<k:{dict(cells.dtypes)[category]},a:bigint,b:bigint>>"
    ids = [_named(F.col(c)) for c in base]
    blocks = _replicated(_composition(cells, base, category, n), replicates).withColumn("__node", F.lit(0).cast("bigint"))

    def split(h: int):
        def step(s: Column, c: Column) -> Column:
            u = draw(channel, "replicate", *ids, F.lit(h), "__node", _named(c["k"]))
            x = hypergeometric_count(u, s["size"], c["n"], s["taken"])
            return F.transform(F.array(x), lambda x: F.struct(
                (s["size"] - c["n"]).alias("size"), (s["taken"] - x).alias("taken"),
                F.concat(s["out"], F.array(F.struct(c["k"].alias("k"), x.alias("a"), (c["n"] - x).alias("b")))).alias("out")))[0]
        return step

    def side(node: Column, size: Column, part: str) -> Column:
        kept = F.filter("__out", lambda e: e[part] > 0)
        return F.struct(node.alias("__node"), size.alias("__size"), F.transform(kept, lambda e: F.struct(e["k"].alias("k"), e[part].alias("n"))).alias("__cats"))

    # a round may be a broadcast join, which leaves blocks where they are: they start from one row a base
    dealt = lambda blocks: blocks.repartition(salt_count(blocks.sparkSession), "replicate", *base, "__node")       # noqa: E731
    blocks = dealt(blocks)
    for done, h in enumerate(range(height, 0, -1), 1):
        child = halves.filter(F.col("__h") == h - 1).select(*base, (F.col("__node") / 2).cast("bigint").alias("__node"), "__left")
        j = join_keys(blocks, child, [*base, "__node"])
        start = F.struct(F.col("__size").alias("size"), F.col("__left").alias("taken"), F.array().cast(kind).alias("out"))
        j = j.withColumn("__out", F.aggregate("__cats", start, split(h))["out"])
        two = F.array(side(F.col("__node") * 2, F.col("__left"), "a"), side(F.col("__node") * 2 + 1, F.col("__size") - F.col("__left"), "b"))
        blocks = j.select("replicate", *base, F.inline(two)).filter("__size > 0")
        if done % ROUNDS_IN_A_PLAN == 0:
            blocks = dealt(cut_lineage(blocks))
    leaves = join_keys(blocks, units.select(*base, F.col("__rank").alias("__node"), unit), [*base, "__node"])
    return leaves.select("replicate", *base, unit, F.inline("__cats").alias(category, "n"))


def leave_one_out_floor(cells: DataFrame, base: Sequence[str], unit: str, category: str, n: str, replicates: int, channel: str = "loo") -> DataFrame:
    """Mean leave-one-out distance per replicate of the multinomial floor.

    The base totals of a replicate are added up again from its simulated units, and each unit is compared with them
    minus itself. Result: replicate, mean_tvd.
    """
    drawn = cut_lineage(drawn_cells(cells, base, unit, category, n, replicates, channel))
    return weighted_distance(unit_distances(drawn, base, unit, category, "n", extra=["replicate"], leave_out=True), ["replicate"]).select("replicate", "mean_tvd")
