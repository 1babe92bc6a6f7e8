"""Joins: reconciliation, fallback chains, hierarchies, spatial matches."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.operators.spatial import finite
from popweave.plans.ranking import join_keys
from popweave.session import cut_lineage


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full join of two counts per cell, missing cells as 0, with the difference."""
    a = left.groupBy(*keys).agg(F.sum(value).alias("a"))
    b = right.groupBy(*keys).agg(F.sum(value).alias("b"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return a.join(b, list(keys), "full_outer").select(*keys, z("a").alias("a"), z("b").alias("b"), (z("a") - z("b")).alias("diff"))


def parent_map(df: DataFrame, child: str, parent: str) -> DataFrame:
    """child -> parent with the number of parents seen; more than one is a violation."""
    d = df.select(child, parent).distinct()
    return d.groupBy(child).agg(F.min(parent).alias("parent"), F.count("*").alias("parents"),
                                (F.count("*") > 1).alias("violation"))


def lattice(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every combination of the category domains (nulls left out), of any size.

    The cells are born distributed: a range as long as the product of the domain sizes, decoded by mixed radix. Each
    digit meets its category by a hash join with the numbered domain, a table of one row per category.
    """
    parts = [df.select(F.lit(c).alias("v"), F.col(c).cast("string").alias("c")) for c in columns]
    dom = cut_lineage(reduce(lambda a, b: a.unionByName(b), parts).filter("c is not null").distinct()
                      .withColumn("digit", F.row_number().over(W.partitionBy("v").orderBy("c")).cast("bigint") - 1))
    sizes = {r["v"]: r["n"] for r in dom.groupBy("v").agg(F.count("*").alias("n")).collect()}
    total = reduce(lambda a, b: a * b, [sizes.get(c, 0) for c in columns], 1)
    out, stride = df.sparkSession.range(total).withColumnRenamed("id", "__cell"), 1
    for c in reversed(columns):
        out = out.withColumn("__d", F.expr(f"(__cell div {stride}L) % {max(1, sizes.get(c, 0))}L"))
        own = dom.filter(F.col("v") == c).select(F.col("digit").alias("__d"), F.col("c").alias(c))
        out = out.join(own, "__d").drop("__d")
        stride *= max(1, sizes.get(c, 0))
    return out.select(*columns)


def completed(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts over the whole lattice, absent cells as 0."""
    got = df.groupBy(*[F.col(k).cast("string").alias(k) for k in keys]).agg(F.sum(value).alias(value))
    return (lattice(df, keys).join(got, list(keys), "left")
            .withColumn(value, F.coalesce(value, F.lit(0))))


def fallback_level(people: DataFrame, donors: DataFrame, levels: Sequence[Sequence[str]], least: int) -> DataFrame:
    """Finest key level whose donor pool has ``least`` records; the level number is kept
    (``len(levels)`` means the whole file)."""
    out, flags = people, []
    for i, keys in enumerate(levels):
        pool = (donors.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
                .select(*keys, F.lit(i).alias(f"__l{i}")))
        out = join_keys(out, pool, list(keys), "left")
        flags.append(F.col(f"__l{i}"))
    return (out.withColumn("level", F.coalesce(*flags, F.lit(len(levels))))
            .drop(*[f"__l{i}" for i in range(len(levels))]))


def chained_lookup(df: DataFrame, tables: Sequence[tuple[str, DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """Try each (name, table, keys) in order; keep the value and the chain of misses before it."""
    out = df
    for i, (_, tab, keys) in enumerate(tables):
        out = join_keys(out, tab.select(*keys, F.col(value).alias(f"__v{i}")), list(keys), "left")
    vals = [F.col(f"__v{i}") for i in range(len(tables))]
    chain = None
    for i in range(len(tables)):
        text = F.lit(">".join(n for n, _, _ in tables[:i + 1]))
        chain = F.when(vals[i].isNotNull(), text) if chain is None else chain.when(vals[i].isNotNull(), text)
    return (out.withColumn(value, F.coalesce(*vals)).withColumn("chain", chain)
            .drop(*[f"__v{i}" for i in range(len(tables))]))


def tree(edges: DataFrame, code: str, parent: str) -> DataFrame:
    """(code, root, leaf, is_root) from parent pointers; a root points to itself.

    Pointer doubling: each step joins the table with itself and doubles the reach, until no pointer moves. What still
    moves once the reach passes the number of codes is on a cycle or leads into one; such codes get a null root.
    """
    jump = cut_lineage(edges.select(F.col(code).alias("code"), F.coalesce(F.col(parent), F.col(code)).alias("up")))
    reach, codes = 1, jump.count()
    while reach <= codes:
        nxt = jump.select(F.col("code").alias("up"), F.col("up").alias("up2"))
        step = cut_lineage(jump.join(nxt, "up", "left").select("code", F.coalesce("up2", "up").alias("up"), (F.coalesce("up2", "up") != F.col("up")).alias("moved")))
        jump, reach = step.select("code", "up"), 2 * reach
        if step.filter("moved").isEmpty():
            break
    roots = edges.filter((F.col(parent) == F.col(code)) | F.col(parent).isNull()).select(F.col(code).alias("up"), F.lit(True).alias("ok"))
    inner = edges.filter(F.col(parent) != F.col(code)).select(F.col(parent).alias("code")).distinct().withColumn("has", F.lit(True))
    return (jump.join(roots, "up", "left").join(inner, "code", "left")
            .select("code", F.when(F.col("ok"), F.col("up")).alias("root"), F.col("has").isNull().alias("leaf"),
                    (F.coalesce(F.col("ok"), F.lit(False)) & (F.col("code") == F.col("up"))).alias("is_root")))


def family_roles(persons: DataFrame) -> DataFrame:
    """Roles from pointers inside a household.

    ``persons(hh, pid, age, father, mother, partner)``. Ids used twice in a household are
    ambiguous and left out. Reference: most links (as partner or parent), then oldest, then
    smallest id. R reference, P partner of it, F child of R or P, G parent of R or P, A other.
    """
    ids = persons.groupBy("hh", "pid").agg(F.count("*").alias("__n"))
    ok = persons.join(ids.filter("__n = 1").select("hh", "pid"), ["hh", "pid"])
    links = [ok.filter(F.col(c).isNotNull()).select("hh", F.col(c).alias("pid")) for c in ("father", "mother", "partner")]
    n = reduce(lambda a, b: a.unionByName(b), links).groupBy("hh", "pid").agg(F.count("*").alias("links"))
    d = ok.join(n, ["hh", "pid"], "left").withColumn("links", F.coalesce("links", F.lit(0).cast("bigint")))
    best = F.min(F.struct((-F.col("links")).alias("l"), F.col("age").isNull().alias("u"), (-F.col("age")).alias("a"), "pid", "age", "father", "mother", "partner"))
    ref = d.groupBy("hh").agg(best.alias("r")).select("hh", F.col("r.pid").alias("ref"), F.col("r.age").alias("ref_age"),
                                                      F.col("r.father").alias("rf"), F.col("r.mother").alias("rm"),
                                                      F.col("r.partner").alias("rp"))
    j = d.join(ref, "hh")
    mate = j.select("hh", "ref", "rp").distinct().join(
        ok.select("hh", F.col("pid").alias("rp"), F.col("father").alias("pf"), F.col("mother").alias("pm")), ["hh", "rp"], "left"
    ).select("hh", "pf", "pm")
    j = j.join(mate, "hh", "left")
    among = lambda x, *c: reduce(lambda a, b: a | b, [F.coalesce(F.col(x) == F.col(i), F.lit(False)) for i in c])
    role = (F.when(F.col("pid") == F.col("ref"), "R")
            .when(among("pid", "rp") | among("partner", "ref"), "P")
            .when(among("father", "ref", "rp") | among("mother", "ref", "rp"), "F")
            .when(among("pid", "rf", "rm", "pf", "pm"), "G").otherwise("A"))
    return j.select("hh", "pid", "age", role.alias("role"), "links",
                    F.when(role == "F", F.col("ref_age") - F.col("age")).alias("generation_gap"),
                    F.when(role == "P", F.col("ref_age") - F.col("age")).alias("partner_gap"))


# ---------------------------------------------------------------- spatial

def _cells(lo: Column, hi: Column, g: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / g), F.floor(hi / g)))


def crossing_inside(x: Column, y: Column, verts: Column) -> Column:
    """Even-odd rule over a ring of ``struct<x,y>`` vertices."""
    n = F.size(verts)
    def crosses(i):
        a = F.get(verts, i)
        b = F.get(verts, F.pmod(i + 1, n))
        spans = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return (spans & (x < at)).cast("int")
    hits = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.coalesce(crosses(i), F.lit(0)))
    return hits % 2 == 1


def ring_distance(x: Column, y: Column, verts: Column) -> Column:
    """Distance from a point to the nearest edge of the ring."""
    n = F.size(verts)
    def edge(i):
        a = F.get(verts, i)
        b = F.get(verts, F.pmod(i + 1, n))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(
            F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.sqrt(F.pow(x - a["x"] - t * dx, F.lit(2.0)) + F.pow(y - a["y"] - t * dy, F.lit(2.0)))
    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), edge))


def point_in_polygon(points: DataFrame, polygons: DataFrame, pid: str, poly: str, grid: float, near: float) -> DataFrame:
    """Each point with its polygon: inside first, else the nearest edge within ``near``.

    ``points(pid, x, y)``; ``polygons(poly, verts)``. Both sides meet on a grid cell, so the
    join is a hash join; the exact test follows. (method, distance, id) decides.
    """
    vx, vy = F.transform("verts", lambda v: v["x"]), F.transform("verts", lambda v: v["y"])
    boxed = (polygons.withColumn("__cx", _cells(F.array_min(vx) - near, F.array_max(vx) + near, grid))
             .withColumn("__cy", _cells(F.array_min(vy) - near, F.array_max(vy) + near, grid)))
    pts = points.withColumn("__cx", F.floor(F.col("x") / grid)).withColumn("__cy", F.floor(F.col("y") / grid))
    inside = crossing_inside(F.col("x"), F.col("y"), F.col("verts"))
    cand = (pts.join(boxed, ["__cx", "__cy"]).withColumn("__in", inside)
            .withColumn("__d", F.when(F.col("__in"), F.lit(0.0)).otherwise(ring_distance(F.col("x"), F.col("y"), F.col("verts"))))
            .filter(F.col("__in") | (F.col("__d") <= near)))
    best = cand.groupBy(pid).agg(F.min(F.struct((~F.col("__in")).alias("o"), F.col("__d").alias("d"), F.col(poly).alias("p"))).alias("__b"))
    return (points.join(best, pid, "left")
            .select(*points.columns, F.col("__b.p").alias(poly), F.col("__b.d").alias("distance"),
                    F.when(F.col("__b").isNull(), "unmatched").when(F.col("__b.o"), "nearest").otherwise("within").alias("method")))


CANDIDATES = 4                 # nearest free points that each point is shown at a time


def one_to_one(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Greedy one-to-one match by distance: (a_id, b_id, distance), as if all pairs within ``threshold`` were taken in the order (distance, a_id, b_id).

    ``a(a_id, x, y)``, ``b(b_id, x, y)``. Pairs are looked for ring by ring among points that are still free: the first
    radius follows the density of the points, later ones double up to the threshold. In a ring each point is shown its
    ``CANDIDATES`` nearest free ones. A pair is final when each is first on the other's list, which then is the
    other's nearest free point; lists that run out are drawn again. So what is written stays a few rows per point
    however large the threshold is. Points without finite coordinates match nothing.
    """
    free_a, free_b = cut_lineage(a.select("a_id", "x", "y").where(finite("x", "y"))), cut_lineage(b.select("b_id", "x", "y").where(finite("x", "y")))
    size = lambda d: d.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()       # noqa: E731
    na, nb = size(free_a), size(free_b)
    if not (na["n"] and nb["n"]):
        return free_a.select(F.lit(0.0).alias("distance"), "a_id").where(F.lit(False)).join(free_b.select("b_id"), F.lit(False))
    area = max((nb["hix"] - nb["lox"]) * (nb["hiy"] - nb["loy"]), (na["hix"] - na["lox"]) * (na["hiy"] - na["loy"]))
    radius = min(threshold, (CANDIDATES * area / (3 * max(na["n"], nb["n"]))) ** 0.5 or threshold)
    out = []
    while True:
        shown = _shown(free_a, free_b, radius)
        if shown.isEmpty():
            if radius >= threshold:
                return reduce(lambda x, y: x.unionByName(y), out) if out else shown.select("distance", "a_id", "b_id")
            radius = min(2 * radius, threshold)
            continue
        # a point's first is known to be its nearest free one as long as its own list is not empty
        while True:
            own = lambda flag, by: shown.where(flag).groupBy(by).agg(F.min(F.struct("distance", "a_id", "b_id")).alias("k")).select("k")     # noqa: E731
            final = cut_lineage(own("of_a", "a_id").join(own("of_b", "b_id"), "k", "left_semi").select("k.*"))
            if final.isEmpty():
                break
            out.append(final)
            rest = lambda d, *c: reduce(lambda x, y: x.join(final.select(y), y, "left_anti"), c, d)        # noqa: E731
            shown = cut_lineage(rest(shown, "a_id", "b_id"))
            free_a, free_b = rest(free_a, "a_id"), rest(free_b, "b_id")
        free_a, free_b = cut_lineage(free_a), cut_lineage(free_b)


def _shown(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs within ``radius`` that are among the nearest of their left (``of_a``) or right point (``of_b``)."""
    at = lambda c: F.floor(F.col(c) / radius)                              # noqa: E731
    around = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))         # noqa: E731
    cells = b.withColumnsRenamed({"x": "bx", "y": "by"}).withColumn("__cx", around("bx")).withColumn("__cy", around("by"))
    d = F.sqrt(F.pow(F.col("x") - F.col("bx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("by"), F.lit(2.0)))
    pairs = a.withColumn("__cx", at("x")).withColumn("__cy", at("y")).join(cells, ["__cx", "__cy"]).select("a_id", "b_id", d.alias("distance")).where(F.col("distance") <= radius)
    first = lambda by, other: F.row_number().over(W.partitionBy(by).orderBy("distance", other)) <= CANDIDATES       # noqa: E731
    return cut_lineage(pairs.withColumn("of_a", first("a_id", "b_id")).withColumn("of_b", first("b_id", "a_id")).where("of_a or of_b"))
