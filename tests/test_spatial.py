"""Polygons with holes and parts, and nearest places, against brute force."""
import math
import random

import pytest
from pyspark.sql import functions as F

from popweave.operators import spatial as S

BAD = [float("nan"), float("inf"), float("-inf"), None]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x > ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return odd


def away(x, y, rings):
    best = math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            dx, dy = bx - ax, by - ay
            if dx or dy:
                t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
                best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


def star(cx, cy, r, n, rnd):
    return [(cx + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), cy + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)) for i in range(n)]


@pytest.mark.parametrize("grid", [0.7, 3.0, 100.0])
def test_rings_against_brute_force(spark, grid):
    rnd = random.Random(int(grid * 10))
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]     # noqa: E731
    shapes = {"a": [square(0, 0, 10), square(3, 3, 4), square(4, 4, 1)], "b": [star(20, 5, 6, 40, rnd), star(20, 5, 1.2, 7, rnd)],
              "c": [square(-8, -8, 5), star(-15, 10, 4, 9, rnd), [(-5, 12), (5, 12), (5, 12.5), (-5, 13)]], "d": [star(5, 5, 9, 300, rnd)]}
    vertices = [(p, i, j, float(x), float(y)) for p, rings in shapes.items() for i, ring in enumerate(rings) for j, (x, y) in enumerate(ring)]
    pts = [(i, rnd.uniform(-22, 28), rnd.uniform(-12, 16)) for i in range(700)] + [(900 + i, float(x), float(y)) for i, (x, y) in enumerate([(2, 2), (3, 3), (5, 3), (4.5, 4.5), (10, 5), (0, 0), (5, 10), (6, 4)])]
    odd = [(2000 + i, v, 1.0) for i, v in enumerate(BAD)]
    edges = S.ring_edges(spark.createDataFrame(vertices, "p string, ring int, seq int, x double, y double"), "p")
    got = {r["id"]: r for r in S.point_in_rings(spark.createDataFrame(pts + odd, "id int, x double, y double"), edges, "id", "p", grid, 0.8).collect()}
    assert len(got) == len(pts) + len(odd)
    for i, x, y in pts:
        in_ = sorted(p for p, rings in shapes.items() if inside(x, y, rings))
        d = sorted((away(x, y, rings), p) for p, rings in shapes.items())[0]
        if i >= 900 and d[0] == 0:
            continue                                                       # on a border: either side
        want = ("within", in_[0], 0.0) if in_ else ("nearest", d[1], d[0]) if d[0] <= 0.8 else ("unmatched", None, None)
        assert (got[i]["method"], got[i]["p"]) == want[:2], (x, y)
        assert want[2] is None or abs(got[i]["distance"] - want[2]) < 1e-9
    assert {got[i]["method"] for i, _, _ in odd} == {"unmatched"}


def test_joined_rows_hold_no_outline(spark):
    edges = S.ring_edges(spark.createDataFrame([("a", 0, i, *v) for i, v in enumerate([(0.0, 0.0), (9.0, 0.0), (4.0, 9.0)])], "p string, ring int, seq int, x double, y double"), "p")
    plan = S.point_in_rings(spark.createDataFrame([(1, 4.0, 3.0)], "id int, x double, y double"), edges, "id", "p", 1.0, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def haversine(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * S.EARTH_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("globe", [False, True])
def test_nearest_against_brute_force(spark, globe):
    rnd = random.Random(4)
    place = (lambda: (rnd.uniform(-180, 180), rnd.choice([rnd.uniform(-90, 90), 89.9, -89.99]))) if globe else (lambda: (rnd.uniform(0, 50), rnd.uniform(0, 50)))
    f = [place() for _ in range(300)] + [(10 + rnd.gauss(0, 1e-3), 20 + rnd.gauss(0, 1e-3)) for _ in range(900)] + [(7.0, 7.0)] * 40 + [(180.0, 5.0), (-179.99, -5.0)]
    p = [place() for _ in range(400)] + [(10 + rnd.gauss(0, 1e-3), 20 + rnd.gauss(0, 1e-3)) for _ in range(200)] + [(179.999, 5.1), (-180.0, -5.1), (7.0, 7.0), (7.0, 7.0)]
    fs = spark.createDataFrame([(i, *v) for i, v in enumerate(f)] + [(5000 + i, v, 1.0) for i, v in enumerate(BAD)], "fid int, x double, y double")
    ps = spark.createDataFrame([(i, *v) for i, v in enumerate(p)] + [(5000 + i, 1.0, v) for i, v in enumerate(BAD)], "pid int, x double, y double")
    got = {r["pid"]: r for r in S.nearest_place(ps, fs, "pid", "fid", globe).collect()}
    assert sorted(got) == list(range(len(p)))
    for i, v in enumerate(p):
        d = [haversine(v, w) if globe else math.dist(v, w) for w in f]
        assert abs(got[i]["distance"] - min(d)) < (1e-3 if globe else 1e-12)
        assert got[i]["fid"] == d.index(min(d)) or d[got[i]["fid"]] - min(d) < 1e-9


def test_no_facility(spark):
    ps = spark.createDataFrame([(1, 0.0, 0.0)], "pid int, x double, y double")
    assert S.nearest_place(ps, spark.createDataFrame([(1, float("nan"), 0.0)], "fid int, x double, y double"), "pid", "fid").collect() == []


def test_work_grows_with_points_not_with_density(spark, monkeypatch):
    """Ten times the facilities: about as many cells and places per point."""
    kept = []
    real = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: kept.append(real(df)) or kept[-1])
    rows = {}
    for n in (1000, 10_000):
        kept.clear()
        draw = lambda c, k, m: (F.pmod(F.xxhash64(F.lit(c), k), F.lit(1 << 30)) / float(1 << 30) * m)      # noqa: E731
        make = lambda c, k, n: spark.range(n).select(F.col("id").alias(k), draw(c + "x", "id", 50.0).alias("x"), draw(c + "y", "id", 50.0).alias("y"))
        assert S.nearest_place(make("p", "pid", 500), make("f", "fid", n), "pid", "fid").count() == 500
        rows[n] = sum(df.count() for df in kept if "near" in df.columns) / 500
    assert rows[10_000] <= 2 * rows[1000] and rows[10_000] < 40


@pytest.mark.parametrize("seed", range(3))
def test_one_to_one_against_greedy(spark, monkeypatch, seed):
    """Clusters, equal distances and points at one place; what is written stays a few rows per point."""
    from popweave.operators import joins as J
    rnd = random.Random(seed)
    spot = lambda: rnd.choice([(rnd.uniform(0, 30), rnd.uniform(0, 30)), (5 + rnd.gauss(0, 0.05), 5 + rnd.gauss(0, 0.05)), (float(rnd.randrange(6)), float(rnd.randrange(6)))])     # noqa: E731
    a, b = [(i, *spot()) for i in range(250)], [(i, *spot()) for i in range(200)]
    kept, real = [], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda df: kept.append(real(df)) or kept[-1])
    make = lambda rows, k: spark.createDataFrame(rows + [(900 + i, v, 1.0) for i, v in enumerate(BAD)], f"{k} int, x double, y double")     # noqa: E731
    got = {(r["a_id"], r["b_id"]) for r in J.one_to_one(make(a, "a_id"), make(b, "b_id"), 20.0).collect()}
    want, ua, ub = set(), set(), set()
    for d, i, j in sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), i, j) for i, x, y in a for j, u, v in b):
        if d <= 20 and i not in ua and j not in ub:
            want.add((i, j))
            ua.add(i)
            ub.add(j)
    assert got == want
    assert max(df.count() for df in kept) <= 2 * J.CANDIDATES * (len(a) + len(b))


def test_parts_of_a_cell_are_ruled_out_before_points_are_dealt(spark, monkeypatch):
    plans = []
    kept = S.cut_lineage
    monkeypatch.setattr(S, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or kept(df))
    ps = spark.range(300).select(F.col("id").alias("pid"), (F.col("id") * 7 % 101 / 10.0).alias("x"), (F.col("id") * 13 % 97 / 10.0).alias("y"))
    fs = spark.range(200).select(F.col("id").alias("fid"), (F.col("id") * 11 % 103 / 10.0).alias("x"), (F.col("id") * 5 % 89 / 10.0).alias("y"))
    assert S.nearest_place(ps, fs, "pid", "fid").count() == 300
    rounds = [p.split("Window", 1)[1] for p in plans if "Window" in p]
    assert rounds and all("Filter" in p and "Generate explode" in p for p in rounds)
