"""Filters, samples, publication regimes."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions import fixed_values as V
from popweave.functions.draws import draw


def _values(v) -> list[str]:
    return [str(x) for x in (v if isinstance(v, (list, tuple, set)) else [v])]


def exact_filter(df: DataFrame, spec: dict) -> DataFrame:
    """Rows whose columns equal the wanted value, or one of them, compared as text."""
    for c, v in spec.items():
        df = df.filter(F.col(c).cast("string").isin(_values(v)))
    return df


def unknown_values(df: DataFrame, spec: dict) -> DataFrame:
    """(asked_column, value, held_by): wanted values that no row has, and the columns that do have them.

    One scan with one flag per (column, value); the result has one row per missing value.
    """
    cols = df.columns
    wanted = [(c, x) for c, v in spec.items() for x in _values(v)]
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(c).cast("string") == x), F.lit(False)).alias(f"f{i}_{j}")
                     for i, (_, x) in enumerate(wanted) for j, c in enumerate(cols)])
    rows = []
    for i, (asked, x) in enumerate(wanted):
        held = F.concat_ws(",", *[F.when(F.col(f"f{i}_{j}"), F.lit(c)) for j, c in enumerate(cols)])
        rows.append(F.struct(F.lit(asked).alias("asked_column"), F.lit(x).alias("value"), held.alias("held_by"),
                             F.col(f"f{i}_{cols.index(asked)}").alias("known")))
    return (flags.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter(~F.col("known")).drop("known"))


def seeded_sample(df: DataFrame, key: str, n: int, channel: str = "sample") -> DataFrame:
    """n rows without replacement by hash draw, shown in key order (all rows, if there are fewer)."""
    return (df.withColumn("__u", draw(channel, key)).orderBy("__u", key).limit(n).drop("__u").orderBy(key))


def regime(df: DataFrame, rules: dict[str, dict], name: str) -> DataFrame:
    """Publication regime: drop columns and add derived ones."""
    r = rules[name]
    out = df
    for c, e in r.get("add", {}).items():
        out = out.withColumn(c, e)
    return out.drop(*r.get("drop", []))


def public_export(people: DataFrame, members: DataFrame, uid: str) -> DataFrame:
    """Every person with household ordinal (-1 when none) and role ("" when none).

    ``members(uid, id_nucleo, ruolo)`` holds at most one row per person.
    """
    j = people.join(members, uid, "left")
    ordinal = F.coalesce(F.regexp_extract("id_nucleo", r"(\d+)$", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
    return j.withColumn("nucleo", ordinal).withColumn("ruolo", F.coalesce("ruolo", F.lit(""))).drop("id_nucleo")


def export_summary(export: DataFrame, unit: str) -> DataFrame:
    """Persons, distinct households and the share without one."""
    return export.agg(F.count("*").alias("persons"),
                      F.countDistinct(F.when(F.col("nucleo") >= 0, F.struct(unit, "nucleo"))).alias("households"),
                      F.round(F.avg((F.col("nucleo") < 0).cast("double")), 6).alias("unplaced"))


def scatter_in_unit(df: DataFrame, unit: str, x: str, y: str, key: str) -> DataFrame:
    """Replace coordinates by a uniform point of the unit's bounding box when the box has area."""
    box = df.groupBy(unit).agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"), F.min(y).alias("__y0"), F.max(y).alias("__y1"))
    j = df.join(box, unit)
    ok = (F.col("__x1") > F.col("__x0")) & (F.col("__y1") > F.col("__y0"))
    put = lambda c, a, b, ch: F.when(ok, F.col(a) + draw(ch, key) * (F.col(b) - F.col(a))).otherwise(F.col(c))
    return (j.withColumn("__nx", put(x, "__x0", "__x1", "x")).withColumn("__ny", put(y, "__y0", "__y1", "y"))
            .withColumn(x, F.col("__nx")).withColumn(y, F.col("__ny"))
            .drop("__x0", "__x1", "__y0", "__y1", "__nx", "__ny"))


def filter_caveats(lineage: DataFrame, asked: Sequence[str], geography: str) -> DataFrame:
    """Messages for asked attributes that are known only at a coarser level than the asked geography.

    ``lineage(attribute, finest, rank)``: rank 0 is the finest level.
    """
    geo = lineage.filter(F.col("attribute") == geography).select(F.max("rank")).scalar()
    return (lineage.filter(F.col("attribute").isin(list(asked)) & (F.col("attribute") != geography)).filter(F.col("rank") > geo)
            .select("attribute", F.concat(F.col("attribute"), F.lit(" is known by "), F.col("finest"),
                                          F.lit(f": crossing it with {geography} adds no information")).alias("message")))


def elementary_classes(codes: DataFrame, code: str = "code", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Interval codes that contain no other code; found through the starts inside each interval."""
    inner = codes.select(F.col(code).alias("__c"), F.col(lo).alias("__lo"), F.col(hi).alias("__hi"))
    wide = inner.withColumn("__x", F.col("__lo"))
    outer = codes.withColumn("__x", F.explode(F.sequence(F.col(lo), F.col(hi))))
    holds = (outer.join(wide, "__x").filter((F.col("__hi") <= F.col(hi)) & (F.col("__c") != F.col(code)))
             .select(code).distinct())
    return codes.join(holds, code, "left_anti")


def drop_aggregate_codes(df: DataFrame, group: Sequence[str], code: str, always: Sequence[str] = tuple(V.STATUS_AGGREGATES),
                         redundant: dict[str, tuple[str, Sequence[str]]] | None = None) -> DataFrame:
    """Drop totals, and subtotals made redundant by the detail present in the same group.

    ``redundant[total] = ("all"|"any", detail codes)``.
    """
    redundant = redundant or {V.LABOUR_FORCE: ("all", V.LABOUR_FORCE_DETAIL), V.NON_LABOUR: ("any", V.NON_LABOUR_DETAIL)}
    aggs = []
    for total, (how, detail) in redundant.items():
        seen = [F.bool_or(F.col(code) == d) for d in detail]
        aggs.append(reduce(lambda a, b: (a & b) if how == "all" else (a | b), seen).alias(f"__d_{total}"))
    flags = df.groupBy(*group).agg(*aggs)
    keep = ~F.col(code).isin(list(always))
    for total in redundant:
        keep = keep & ~((F.col(code) == total) & F.coalesce(F.col(f"__d_{total}"), F.lit(False)))
    return df.join(flags, list(group)).filter(keep).drop(*[f"__d_{t}" for t in redundant])


def special_units(df: DataFrame, code: str, mass: Column, pattern: str = V.SPECIAL_SECTIONS) -> DataFrame:
    """Rows and mass held by special ids against the rest."""
    return (df.groupBy(F.col(code).cast("string").rlike(pattern).alias("special"))
            .agg(F.count("*").alias("rows"), F.sum(mass).alias("mass")))


def without_identity(df: DataFrame, agents: str, fields: Sequence[str]) -> DataFrame:
    """Remove identity fields from every struct of an array and list which ones were there."""
    present = [f for f in fields if f in df.schema[agents].dataType.elementType.names]
    return (df.withColumn(agents, F.transform(agents, lambda a: a.dropFields(*present)) if present else F.col(agents))
            .withColumn("removed", F.lit(",".join(present))))


def in_tension(df: DataFrame, base: Column, high: Column, low: Column, key: str, n: int) -> DataFrame:
    """n rows of the base filter, those high on one score and low on another first."""
    match = (high & low).cast("int")
    return (df.filter(base).withColumn("tension", match).withColumn("__u", draw("tension", key))
            .orderBy(F.desc("tension"), "__u", key).limit(n).drop("__u"))
