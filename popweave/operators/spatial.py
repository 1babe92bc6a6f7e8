"""Spatial joins on edges and trees: polygons with holes and parts, nearest places in the plane and on the globe."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.session import cut_lineage

EARTH_M = 6371000.0
SHIFT = 0.6180339887           # grid lines stand off round numbers, where vertices like to be
LEAF = 16                      # places in a cell that is not split further
STEP = 2                       # halvings of a cell side per level
DEEPEST = 20                   # halvings in all
SLACK = 1e-9                   # bounds are loosened by this share, so rounding never rules a nearest place out


def finite(*columns: str) -> Column:
    """All columns hold ordinary numbers: no null, NaN or infinity."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in columns])


# ---------------------------------------------------------------- polygons

def ring_edges(vertices: DataFrame, poly: str, ring: str = "ring", seq: str = "seq") -> DataFrame:
    """Edges ``(poly, ax, ay, bx, by)`` of rings given as vertex rows ``(poly, ring, seq, x, y)``.

    A polygon has any number of rings: parts, holes in them, islands in holes. A ring closes by itself; edges of length
    zero and vertices without finite coordinates are left out.
    """
    of_ring = W.partitionBy(poly, ring).orderBy(seq)
    v = vertices.where(finite("x", "y"))
    first = F.first(F.struct("x", "y")).over(of_ring)
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(of_ring), first)
    return (v.withColumn("__n", nxt).select(F.col(poly), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("__n.x").alias("bx"), F.col("__n.y").alias("by"))
            .where("ax <> bx or ay <> by"))


def _at(c: Column, grid: float) -> Column:
    return F.floor(c / F.lit(grid) - F.lit(SHIFT))


def _line(i: Column, grid: float) -> Column:
    return (i + F.lit(SHIFT)) * F.lit(grid)


def _x_at(y: Column) -> Column:
    """Where an edge that is not level stands at height y."""
    return F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))


def _edge_cells(edges: DataFrame, grid: float, near: float) -> DataFrame:
    """Each edge in the cells that it passes within ``near``: row by row, only the columns it reaches there."""
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.withColumn("cy", F.explode(F.sequence(_at(lo - near, grid), _at(hi + near, grid))))
    # the part of the edge that lies in the row, widened
    bottom = F.least(F.greatest(_line(F.col("cy"), grid) - near, lo), hi)
    top = F.greatest(F.least(_line(F.col("cy") + 1, grid) + near, hi), lo)
    x0, x1 = F.coalesce(_x_at(bottom), F.col("ax")), F.coalesce(_x_at(top), F.col("bx"))
    return rows.withColumn("cx", F.explode(F.sequence(_at(F.least(x0, x1) - near, grid), _at(F.greatest(x0, x1) + near, grid))))


def _inner_corners(edges: DataFrame, poly: str, grid: float) -> DataFrame:
    """Cells whose lower left corner lies inside: ``(poly, cx, cy)``, from where edges cross the grid's level lines."""
    y = _line(F.col("cy"), grid)
    lines = edges.withColumn("cy", F.explode(F.sequence(_at(F.least("ay", "by"), grid), _at(F.greatest("ay", "by"), grid))))
    crossed = lines.where((F.col("ay") > y) != (F.col("by") > y))
    # the first corner to the right of the crossing, and from there on
    flips = (crossed.select(poly, "cy", (_at(_x_at(y), grid) + 1).alias("cx")).groupBy(poly, "cy", "cx").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1"))
    along = W.partitionBy(poly, "cy").orderBy("cx")
    spans = flips.withColumn("k", F.row_number().over(along)).withColumn("to", F.lead("cx").over(along)).where("k % 2 = 1")
    return spans.select(poly, "cy", F.explode(F.sequence(F.col("cx"), F.col("to") - 1)).alias("cx"))


def ring_cells(edges: DataFrame, poly: str, grid: float, near: float) -> tuple[DataFrame, DataFrame]:
    """What ``point_in_rings`` joins points with, written once for many calls: edges by cell, and cells whose corner is inside."""
    return cut_lineage(_edge_cells(edges, grid, near)), cut_lineage(_inner_corners(edges, poly, grid))


def point_in_rings(points: DataFrame, edges: DataFrame, pid: str, poly: str, grid: float, near: float, cells: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Each row of ``points(pid, x, y, ...)`` with its polygon: inside first, else the nearest edge within ``near``.

    Returns the columns of ``points`` with ``poly``, ``distance`` (0 inside) and ``method`` (within, nearest or
    unmatched); (method, distance, polygon) decides. ``edges`` are those of ``ring_edges``; inside means an odd number of
    rings around the point.

    Points and edges meet on grid cells. Whether the corner of a cell lies inside a polygon is known beforehand; a point
    is on the same side as the corner, unless the way from the corner up and then across to it meets an odd number of
    the edges in that cell. So a joined row holds one point and one edge, and the rest is a count per point and polygon;
    no outline is ever copied to a cell or held in one row, however many vertices it has.

    Points without finite coordinates are unmatched. ``pid`` is unique; a polygon's id may have any type that sorts.
    ``cells`` are those of ``ring_cells`` for the same grid and reach, for points that come in portions.
    """
    edge_cells, corners = cells or (_edge_cells(edges, grid, near), _inner_corners(edges, poly, grid))
    pts = points.select(pid, "x", "y").where(finite("x", "y")).withColumn("cx", _at(F.col("x"), grid)).withColumn("cy", _at(F.col("y"), grid))
    left, bottom = _line(F.col("cx"), grid), _line(F.col("cy"), grid)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = lambda x, y: dx * (y - F.col("ay")) - dy * (x - F.col("ax"))                  # noqa: E731
    before = lambda x: F.when(dy > 0, side(x, F.col("y")) < 0).otherwise(side(x, F.col("y")) > 0)          # noqa: E731
    below = lambda y: F.when(dx > 0, side(left, y) >= 0).otherwise(side(left, y) <= 0)
    across = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & before(F.col("x")) & ~before(left)
    up = ((F.col("ax") < left) != (F.col("bx") < left)) & below(F.col("y")) & ~below(bottom)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    away = F.sqrt(F.pow(F.col("x") - F.col("ax") - t * dx, F.lit(2.0)) + F.pow(F.col("y") - F.col("ay") - t * dy, F.lit(2.0)))
    met = pts.join(edge_cells, ["cx", "cy"]).select(pid, poly, (across.cast("int") + up.cast("int")).alias("odd"), away.alias("d"))
    corner = pts.join(corners, ["cx", "cy"]).select(pid, poly, F.lit(1).alias("odd"), F.lit(None).cast("double").alias("d"))
    each = met.unionByName(corner).groupBy(pid, poly).agg(F.sum("odd").alias("odd"), F.min("d").alias("d"))
    out = F.col("odd") % 2 == 0
    best = (each.where(~out | (F.col("d") <= near)).groupBy(pid)
            .agg(F.min(F.struct(out.alias("o"), F.when(out, F.col("d")).otherwise(0.0).alias("d"), F.col(poly).alias("p"))).alias("__b")))
    return (points.join(best, pid, "left")
            .select(*points.columns, F.col("__b.p").alias(poly), F.col("__b.d").alias("distance"),
                    F.when(F.col("__b").isNull(), "unmatched").when(F.col("__b.o"), "nearest").otherwise("within").alias("method")))


# ---------------------------------------------------------------- nearest place

def on_globe(lon: str, lat: str) -> list[Column]:
    """A place given in degrees as a point of the unit sphere; straight-line order is the order of great circles."""
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along a great circle."""
    s = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))              # noqa: E731
    h = s(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s(lon2 - lon1)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _cell(bounds: list[tuple[float, float]], level: int) -> Column:
    """Number of the cell of side 2^-level (of the whole extent) in which coordinates ``u0, u1, ..`` stand."""
    key = F.lit(0).cast("bigint")
    for i, (lo, hi) in enumerate(bounds):
        share = (F.col(f"u{i}") - F.lit(lo)) / F.lit((hi - lo) or 1.0)
        key = key * (1 << DEEPEST) + F.least(F.floor(share * (1 << level)), F.lit((1 << level) - 1)).cast("bigint")
    return key


def _tree(places: DataFrame, dims: int) -> list[DataFrame]:
    """Levels of a tree of cells over the places: ``up, cell, leaf`` and the box of the places in each.

    A cell with more than ``LEAF`` places is split; counts of one level decide what the next one still has to look at.
    Empty cells do not exist, so the tree follows the density of the places, whatever it is.
    """
    span = places.agg(*[f(f"u{i}").alias(f"{n}{i}") for i in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    bounds = [(span[f"lo{i}"], span[f"hi{i}"]) for i in range(dims)]
    levels, open_, level = [], places.withColumn("up", F.lit(-1).cast("bigint")), 0
    while True:
        here = open_.withColumn("cell", _cell(bounds, level))
        box = [f(f"u{i}").alias(f"{n}{i}") for i in range(dims) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        nodes = cut_lineage(here.groupBy("up", "cell").agg(F.count(F.lit(1)).alias("n"), *box).withColumn("leaf", (F.col("n") <= LEAF) | F.lit(level >= DEEPEST)))
        levels.append((nodes, here.join(nodes.where("leaf").select("cell"), "cell").drop("up")))
        split = nodes.where("not leaf").select("cell")
        if split.isEmpty():
            return levels
        open_ = cut_lineage(here.join(split, "cell").drop("up").withColumnRenamed("cell", "up"))
        level = min(level + STEP, DEEPEST)


def _box_distances(dims: int, box: Column) -> tuple[Column, Column]:
    """Least and greatest squared distance from a point to the box of a cell."""
    near, far = F.lit(0.0), F.lit(0.0)
    for i in range(dims):
        u, lo, hi = F.col(f"u{i}"), box[f"lo{i}"], box[f"hi{i}"]
        near = near + F.pow(F.greatest(lo - u, u - hi, F.lit(0.0)), F.lit(2.0))
        far = far + F.pow(F.greatest(F.abs(u - lo), F.abs(u - hi)), F.lit(2.0))
    return near, far


def nearest_place(points: DataFrame, facilities: DataFrame, pid: str, fid: str, globe: bool = False) -> DataFrame:
    """Exact nearest facility: ``(pid, fid, distance)``, ties to the smaller ``fid``.

    ``x, y`` are planar coordinates, or with ``globe`` longitude and latitude in degrees (distance in metres along great
    circles; across the date line and the poles as well).

    Facilities form a tree of cells. All points go down it together: a point keeps the cells that may hold its nearest
    place, which is where the cell's box is no farther than the farthest place of the best box so far. Rounds are as many as levels, rows
    per round a few per point, and neither side nor any cell is held in one task. Points and facilities at one place are
    one. Rows without finite coordinates give none; without facilities there are no rows.
    """
    dims = 3 if globe else 2
    ok = finite("x", "y")
    at = lambda d: d.select("*", *[c.alias(f"u{i}") for i, c in enumerate(on_globe("x", "y") if globe else [F.col("x"), F.col("y")])])     # noqa: E731
    u = [f"u{i}" for i in range(dims)]
    places = cut_lineage(at(facilities.where(ok).select(fid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy("x", "y").agg(F.min(fid).alias(fid))))
    named = points.where(ok).select(pid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if places.isEmpty():
        return named.select(pid).where(F.lit(False)).join(facilities.select(fid), F.lit(False)).withColumn("distance", F.lit(0.0))
    front = at(named.select("x", "y").distinct()).withColumn("up", F.lit(-1).cast("bigint")).withColumn("bound", F.lit(float("inf")))
    within = lambda near, bound: near <= bound * (1 + SLACK) + F.lit(SLACK ** 2)           # noqa: E731
    sides = [f"{n}{i}" for i in range(dims) for n in ("lo", "hi")]
    found = []
    for nodes, held in _tree(places, dims):
        of_point = W.partitionBy("x", "y")
        # the parts of a cell are at most 2 ^ (STEP * dims), in one row: a point drops those beyond the best of them before it is dealt
        parts = nodes.groupBy("up").agg(F.collect_list(F.struct("cell", "leaf", *sides)).alias("parts"))
        met = (front.join(parts, "up").withColumn("bound", F.least("bound", F.array_min(F.transform("parts", lambda p: _box_distances(dims, p)[1]))))
               .select("x", "y", *u, "bound", F.explode("parts").alias("p")).select("x", "y", *u, "bound", "p.cell", "p.leaf", _box_distances(dims, F.col("p"))[0].alias("near")))
        met = met.where(within(F.col("near"), F.col("bound"))).withColumn("bound", F.min("bound").over(of_point)).where(within(F.col("near"), F.col("bound")))
        met = cut_lineage(met)
        found.append((met.where("leaf"), held))
        front = met.where("not leaf").select("x", "y", *u, F.col("cell").alias("up"), "bound")
    # cells that later, closer ones ruled out are not opened
    closest = reduce(lambda a, b: a.unionByName(b), [m.select("x", "y", "bound") for m, _ in found]).groupBy("x", "y").agg(F.min("bound").alias("closest"))
    answers = []
    for met, held in found:
        left = met.join(closest, ["x", "y"]).where(within(F.col("near"), F.col("closest"))).select("x", "y", "cell")
        both = left.join(held.select("cell", F.col(fid), F.col("x").alias("px"), F.col("y").alias("py")), "cell")
        x, y, px, py = (F.col(c) for c in ("x", "y", "px", "py"))
        d = haversine(x, y, px, py) if globe else F.sqrt(F.pow(x - px, F.lit(2.0)) + F.pow(y - py, F.lit(2.0)))
        answers.append(both.select("x", "y", F.struct(d.alias("d"), F.col(fid).alias("f")).alias("b")))
    best = reduce(lambda a, b: a.unionByName(b), answers).groupBy("x", "y").agg(F.min("b").alias("b"))
    return named.join(best, ["x", "y"]).select(pid, F.col("b.f").alias(fid), F.col("b.d").alias("distance"))
