"""Zone geometry, concentrated place names, accessibility and unit checks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from popweave.functions.scalars import toponym_core
from popweave.operators.aggregates import with_totals
from popweave.operators.joins import one_to_one
from popweave.operators.spatial import nearest_place
from popweave.plans.ranking import quantiles

# Kilometres per degree of longitude at the equator and of latitude.
KM_LON, KM_LAT = 111.320, 110.574


def zone_geometry(points: DataFrame, zone: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Barycentre in km from the centre of all points, mean-square radius and share per zone.

    One pass of sums: the radius is E|x|^2 - |E x|^2.
    """
    c = points.agg(F.avg(lon).alias("lon0"), F.avg(lat).alias("lat0"))
    s = c.select(F.struct("lon0", "lat0")).scalar()
    lon0, lat0 = s["lon0"], s["lat0"]
    d = points.withColumn("__x", (F.col(lon) - lon0) * F.lit(KM_LON) * F.cos(F.radians(lat0))).withColumn("__y", (F.col(lat) - lat0) * F.lit(KM_LAT))
    g = d.groupBy(zone).agg(F.count("*").alias("points"), F.avg("__x").alias("east_km"), F.avg("__y").alias("north_km"),
                            F.avg(F.col("__x") * F.col("__x") + F.col("__y") * F.col("__y")).alias("__q"))
    e, n = F.col("east_km"), F.col("north_km")
    g = with_totals(g, [], {"__t": F.sum("points")})
    return g.select(zone, "points", (F.col("points") / F.col("__t")).alias("share"), "east_km", "north_km", F.sqrt(e * e + n * n).alias("distance_km"),
                    F.sqrt(F.greatest(F.col("__q") - e * e - n * n, F.lit(0.0))).alias("radius_km"))


def concentrated_names(df: DataFrame, name: str, zone: str, generic: Sequence[str], least: int, share: float) -> DataFrame:
    """Names whose core mostly occurs in one zone: cells first, then the best zone per core."""
    c = df.select(toponym_core(name, generic).alias("core"), zone).filter("core <> ''").groupBy("core", zone).agg(F.count("*").alias("n"))
    g = c.groupBy("core").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("less"), F.col(zone).alias("z"))).alias("b"))
    return (g.select("core", F.col("b.z").alias(zone), "total", (-F.col("b.less") / F.col("total")).alias("concentration"))
            .filter((F.col("total") >= least) & (F.col("concentration") >= share)))


def uncovered_target(sections: DataFrame, services: DataFrame, radius: float | None = None, farthest: float | None = None, globe: bool = False) -> DataFrame:
    """Three estimates of the target people far from any service, and the gaps of the first two against the joint count.

    ``sections(sid, x, y, n, old, low, target)``, ``services(fid, x, y)``; far = beyond ``radius`` or in the farthest share.
    A: municipal share times far people. B: product of the section margins. C: joint count. Sections without coordinates
    count among sections and people, never as far.
    """
    d = sections.join(nearest_place(sections, services, "sid", "fid", globe).select("sid", "distance"), "sid", "left")
    if farthest is not None:
        bound = quantiles(d, [], "distance", {"q": 1 - farthest}).scalar()
        d = d.withColumn("far", F.col("distance") >= bound)
    else:
        d = d.withColumn("far", F.col("distance") > radius)
    s = lambda c: F.coalesce(F.sum(F.when(F.col("far"), c)), F.lit(0))
    n = F.when(F.col("n") > 0, F.col("n")).otherwise(1)
    g = d.agg(F.count("*").alias("sections"), s(F.lit(1)).alias("far_sections"), F.sum("n").alias("people"), s(F.col("n")).alias("far_people"),
              (F.sum("target") / F.sum("n") * s(F.col("n"))).alias("a"), s(F.col("old") * F.col("low") / n).cast("double").alias("b"), s(F.col("target")).alias("c"))
    return g.withColumn("gap_a", F.try_divide(F.col("a") - F.col("c"), F.col("c"))).withColumn("gap_b", F.try_divide(F.col("b") - F.col("c"), F.col("c")))


def match_rates(a: DataFrame, b: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Share of left points matched one-to-one within each distance, with orphans on both sides."""
    m = one_to_one(a, b, max(thresholds))
    na, nb = a.agg(F.count("*")).scalar(), b.agg(F.count("*")).scalar()
    w = m.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds]))).filter(F.col("distance") <= F.col("threshold"))
    g = w.groupBy("threshold").agg(F.count("*").alias("matched"), F.max("distance").alias("max_distance")).join(quantiles(w, ["threshold"], "distance", {"median_distance": 0.5}), "threshold")
    return g.select("threshold", "matched", (F.col("matched") / na).alias("share"), (na - F.col("matched")).alias("orphans_a"), (nb - F.col("matched")).alias("orphans_b"), "median_distance", "max_distance")


def articulation(df: DataFrame, place: str, levels: Sequence[str]) -> DataFrame:
    """Per municipality and level: distinct sub-zones, sections without one, and whether it is articulated."""
    pairs = F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("zone")) for c in levels])
    c = df.groupBy(place, *levels).agg(F.count("*").alias("__n")).select(place, "__n", F.explode(pairs).alias("p")).select(place, "__n", "p.*")
    z = c.groupBy(place, "level", "zone").agg(F.sum("__n").alias("__n"))
    g = z.groupBy(place, "level").agg(F.count("zone").alias("zones"), F.sum(F.when(F.col("zone").isNull(), F.col("__n")).otherwise(0)).alias("without"), F.sum("__n").alias("sections"))
    return g.withColumn("state", F.when(F.col("zones") == 0, "absent").otherwise("present"))


def unit_checks(df: DataFrame, place: str, total: str, parts: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Rows where the parts do not add up, and whether every coarse zone holds whole finer zones."""
    from functools import reduce
    s = reduce(lambda a, b: a + b, [F.col(p) for p in parts])
    cells = df.groupBy(place, *levels).agg(F.count("*").alias("n"), F.sum(total).alias("t"), F.sum((s != F.col(total)).cast("bigint")).alias("bad"))
    g = cells.groupBy(place).agg(F.sum("n").alias("sections"), F.sum("t").alias("total"), F.sum("bad").alias("not_adding_up"))
    for fine, coarse in zip(levels, levels[1:]):
        v = cells.groupBy(place, fine).agg(F.countDistinct(coarse).alias("k")).groupBy(place).agg(F.sum((F.col("k") > 1).cast("bigint")).alias(f"split_{fine}"))
        g = g.join(v, place)
    return g


def zone_cards(sections: DataFrame, population: DataFrame, zone: str) -> DataFrame:
    """Population and sections per zone with the area-weighted centroid; zones on one side only are kept.

    ``sections(zone, area, x, y)``, ``population(zone, n)``.
    """
    a = F.sum("area")
    s = sections.groupBy(zone).agg(F.count("*").alias("sections"), (F.sum(F.col("x") * F.col("area")) / a).alias("cx"), (F.sum(F.col("y") * F.col("area")) / a).alias("cy"), a.alias("area"))
    p = population.groupBy(zone).agg(F.sum("n").alias("population"))
    return s.join(p, zone, "full_outer")
