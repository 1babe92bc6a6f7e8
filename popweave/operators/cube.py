"""The constraint cube: blocks of cells over shared dictionaries, and counts over many margins."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from popweave.operators.joins import lattice
from popweave.plans.ranking import join_keys

ABSENT = "*"


def cell_key(names: Sequence[str]) -> Column:
    """``a=1|b=2`` over the attributes of a block."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])


def structural_fill(cells: DataFrame, keys: Sequence[str], value: str, forced: Sequence[tuple[Column, dict[str, str]]]) -> DataFrame:
    """Deterministic implications: rows that meet a condition take the forced categories, then cells merge."""
    d = cells
    for cond, put in forced:
        for c, v in put.items():
            d = d.withColumn(c, F.when(cond, F.lit(v)).otherwise(F.col(c)))
    return d.groupBy(*keys).agg(F.sum(value).alias(value))


def exclusion_cells(domains: DataFrame, a: str, b: str, rules: Sequence[tuple[Sequence[str], Sequence[str]]],
                    constrained: DataFrame) -> DataFrame:
    """Forbidden (a, b) pairs at zero, without pairs some block already constrains."""
    pairs = [F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for va, vb in rules for x in va for y in vb]
    bad = domains.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()
    return bad.join(constrained.select(a, b).distinct(), [a, b], "left_anti").withColumn("alpha", F.lit(0.0))


def one_row(df: DataFrame) -> DataFrame:
    """A one-row frame to hang constant rows on."""
    return df.sparkSession.range(1)


def margins(df: DataFrame, blocks: Sequence[Sequence[str]], values: dict[str, Column] | None = None) -> DataFrame:
    """(block, cell, n) over every block of attributes; ``values`` names other sums than the row count.

    Rows are first reduced to full cells, so the grouping sets multiply cells, not rows.
    """
    names = sorted({c for b in blocks for c in b})
    sums = {n: F.sum(v) for n, v in values.items()} if values else {"n": F.count("*")}
    full = df.groupBy(*names).agg(*[e.alias(n) for n, e in sums.items()])
    sets = [[F.col(c) for c in b] for b in blocks]
    gid = F.grouping_id(*names)
    g = full.groupingSets(sets, *names).agg(*[F.sum(n).alias(n) for n in sums], gid.alias("__g"))
    code = lambda b: sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in b)
    block = reduce(lambda acc, b: acc.when(F.col("__g") == code(b), F.lit("*".join(b))), blocks[1:],
                   F.when(F.col("__g") == code(blocks[0]), F.lit("*".join(blocks[0]))))
    cell = reduce(lambda acc, b: acc.when(F.col("__g") == code(b), cell_key(b)), blocks[1:],
                  F.when(F.col("__g") == code(blocks[0]), cell_key(blocks[0])))
    return g.select(block.alias("block"), cell.alias("cell"), *sums)


def all_subsets(names: Sequence[str], k: int) -> list[list[str]]:
    return [list(c) for r in range(1, k + 1) for c in combinations(names, r)]


def constraint_cube(blocks: Sequence[tuple[str, DataFrame, Sequence[str], str]], population: Column) -> DataFrame:
    """(block, attrs, cell map, key, alpha) from blocks of counts."""
    parts = []
    for name, df, attrs, value in blocks:
        m = F.create_map(*[x for a in attrs for x in (F.lit(a), F.col(a).cast("string"))])
        parts.append(df.select(F.lit(name).alias("block"), F.array(*[F.lit(a) for a in attrs]).alias("attrs"), m.alias("cell"),
                               cell_key(attrs).alias("key"), (F.col(value) / population).alias("alpha")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def block_inspection(cube: DataFrame) -> DataFrame:
    """Cells, mass and zero cells per block."""
    return cube.groupBy("block").agg(F.count("*").alias("cells"), F.sum("alpha").alias("mass"),
                                     F.sum((F.col("alpha") <= 0).cast("bigint")).alias("zeros"))


def filter_constraints(cube: DataFrame, least: float = 0.0, epsilon: float | None = None,
                       skip: Sequence[str] = ()) -> DataFrame:
    """Drop zero constraints (or raise them to epsilon), small ones and whole blocks."""
    d = cube.filter(~F.col("block").isin(list(skip))) if skip else cube
    d = d.withColumn("alpha", F.when(F.col("alpha") <= 0, F.lit(epsilon)).otherwise(F.col("alpha"))) if epsilon is not None \
        else d.filter("alpha > 0")
    return d.filter(F.col("alpha") >= least)


def block_consistency(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Largest difference of two blocks on their shared margin."""
    x = a.groupBy(*keys).agg(F.sum(value).alias("x"))
    y = b.groupBy(*keys).agg(F.sum(value).alias("y"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return x.join(y, list(keys), "full_outer").agg(F.max(F.abs(z("x") - z("y"))).alias("largest"), F.count("*").alias("cells"))
