"""Geography and accessibility on stand-in coordinates."""
from pyspark.sql import functions as F

from popweave.catalog import match_sql, located, located_sql, query, r
from popweave.catalog.aggregate_queries import COL
from popweave.operators import geography as G

LL = f"(SELECT c_custkey, c_nationkey AS z, 9 + x / 1000 AS lon, 44 + y / 1000 AS lat FROM {located_sql()})"


@query("ge1_zone_geometry", f"""WITH p AS {LL}, c AS (SELECT avg(lon) AS lon0, avg(lat) AS lat0 FROM p), q AS (SELECT z, (lon - lon0) * 111.320 * cos(radians(lat0)) AS x, (lat - lat0) * 110.574 AS y FROM p, c),
b AS (SELECT z, count(*) AS n, avg(x) AS xb, avg(y) AS yb FROM q GROUP BY 1)
SELECT q.z, any_value(n) AS points, round(any_value(n) / (SELECT count(*) FROM q), 6) AS share, round(any_value(xb), 5) AS east_km, round(any_value(yb), 5) AS north_km, round(any_value(sqrt(xb * xb + yb * yb)), 5) AS distance_km, round(sqrt(avg((x - xb) ** 2 + (y - yb) ** 2)), 5) AS radius_km FROM q JOIN b ON b.z = q.z GROUP BY 1""")
def _(t):
    p = located(t).select(COL("c_nationkey").alias("z"), (9 + COL("x") / 1000).alias("lon"), (44 + COL("y") / 1000).alias("lat"))
    return r(r(G.zone_geometry(p, "z"), "east_km", "north_km", "distance_km", "radius_km", digits=5), "share")


@query("ge2_concentrated_names", """WITH c AS (SELECT array_to_string(list_filter(string_split_regex(upper(p_name), '[^\\p{L}0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('RED', 'BLUE', 'SMALL')), ' ') AS core, l_suppkey % 6 AS z FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT core, z, count(*) AS n FROM c WHERE core <> '' GROUP BY ALL) SELECT core, arg_max(z, n * 100 - z) AS z, sum(n)::BIGINT AS total, round(max(n) / sum(n), 6) AS concentration FROM g GROUP BY 1 HAVING sum(n) >= 100 AND max(n) / sum(n) >= 0.17""")
def _(t):
    d = t.lineitem.join(t.part, COL("l_partkey") == COL("p_partkey")).select("p_name", (COL("l_suppkey") % 6).alias("z"))
    return r(G.concentrated_names(d, "p_name", "z", ["RED", "BLUE", "SMALL"], 100, 0.17), "concentration")


NEAR3 = f"""WITH s AS (SELECT c_custkey AS sid, x, y, c_custkey % 90 + 10 AS n, (c_custkey % 90 + 10) // 3 AS old, (c_custkey % 90 + 10) // 4 AS low, (c_custkey % 90 + 10) // 9 AS target FROM {located_sql()}), f AS (SELECT x AS fx, y AS fy FROM {located_sql('supplier', 's_suppkey')}),
d AS (SELECT sid, any_value(n) AS n, any_value(old) AS old, any_value(low) AS low, any_value(target) AS target, min(sqrt((x - fx) ** 2 + (y - fy) ** 2)) AS dist FROM s, f GROUP BY 1), b AS (SELECT *, dist >= (SELECT quantile_cont(dist, 0.9) FROM d) AS far FROM d),
g AS (SELECT count(*) AS sections, count(*) FILTER (far) AS far_sections, sum(n)::BIGINT AS people, (sum(n) FILTER (far))::BIGINT AS far_people, sum(target) / sum(n) * sum(n) FILTER (far) AS a, sum(old * low / n) FILTER (far) AS b, (sum(target) FILTER (far))::BIGINT AS c FROM b)
SELECT sections, far_sections, people, far_people, round(a, 5) AS a, round(b, 5) AS b, c, round((a - c) / c, 6) AS gap_a, round((b - c) / c, 6) AS gap_b FROM g"""


@query("ge3_uncovered_target", NEAR3)
def _(t):
    n = COL("c_custkey") % 90 + 10
    s = located(t).select(COL("c_custkey").alias("sid"), "x", "y", n.alias("n"), F.floor(n / 3).alias("old"), F.floor(n / 4).alias("low"), F.floor(n / 9).alias("target"))
    f = located(t, "supplier", "s_suppkey").select(COL("s_suppkey").alias("fid"), "x", "y")
    return r(r(G.uncovered_target(s, f, farthest=0.1).withColumn("far_sections", COL("far_sections").cast("bigint")), "a", "b", digits=5), "gap_a", "gap_b")


@query("ge4_match_rates", match_sql(4.0) + """, t AS (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS threshold), n AS (SELECT (SELECT count(*) FROM customer) AS na, (SELECT count(*) FROM supplier) AS nb)
SELECT threshold, count(*) AS matched, round(count(*) / any_value(na), 6) AS share, any_value(na) - count(*) AS orphans_a, any_value(nb) - count(*) AS orphans_b, round(median(d), 6) AS median_distance, round(max(d), 6) AS max_distance
FROM t JOIN m ON m.d <= threshold, n GROUP BY threshold""")
def _(t):
    a = located(t).select(COL("c_custkey").alias("a_id"), "x", "y")
    b = located(t, "supplier", "s_suppkey").select(COL("s_suppkey").alias("b_id"), "x", "y")
    return r(G.match_rates(a, b, [0.5, 1.0, 2.0, 4.0]), "share", "median_distance", "max_distance")


ART = "WITH s AS (SELECT s_nationkey % 6 AS place, CASE WHEN s_suppkey % 5 > 0 AND s_nationkey % 6 <> 2 THEN s_suppkey % 9 END AS asc1, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey % 9 // 3 END AS asc2, s_suppkey FROM supplier) "


def zones(t):
    k = COL("s_suppkey")
    return t.supplier.select((COL("s_nationkey") % 6).alias("place"), F.when((k % 5 > 0) & (COL("s_nationkey") % 6 != 2), k % 9).alias("asc1"), F.when(k % 7 > 0, F.floor((k % 9) / 3)).alias("asc2"), "s_suppkey")


@query("ge5_articulation", ART + " UNION ALL ".join(["SELECT place, 'asc1' AS level, count(DISTINCT asc1) AS zones, count(*) FILTER (asc1 IS NULL) AS without, count(*) AS sections, CASE WHEN count(asc1) = 0 THEN 'absent' ELSE 'present' END AS state FROM s GROUP BY 1",
       "SELECT place, 'asc2', count(DISTINCT asc2), count(*) FILTER (asc2 IS NULL), count(*), CASE WHEN count(asc2) = 0 THEN 'absent' ELSE 'present' END FROM s GROUP BY 1"]))
def _(t):
    return G.articulation(zones(t), "place", ["asc1", "asc2"])


@query("ge6_unit_checks", """WITH d AS (SELECT o_custkey % 5 AS place, o_custkey % 30 AS a1, o_custkey % 10 + CASE WHEN o_orderkey % 900 = 0 THEN 1 ELSE 0 END AS a2, 10 AS p1, 4 AS p2, CASE WHEN o_orderkey % 70 = 0 THEN 5 ELSE 6 END AS p3 FROM orders)
SELECT place, count(*) AS sections, sum(p1)::BIGINT AS total, count(*) FILTER (p1 <> p2 + p3) AS not_adding_up, (SELECT count(*) FROM (SELECT a1 FROM d x WHERE x.place = d.place GROUP BY a1 HAVING count(DISTINCT a2) > 1)) AS split_a1 FROM d GROUP BY 1""")
def _(t):
    k = COL("o_custkey")
    d = t.orders.select((k % 5).alias("place"), (k % 30).alias("a1"), (k % 10 + F.when(COL("o_orderkey") % 900 == 0, 1).otherwise(0)).alias("a2"), F.lit(10).alias("p1"), F.lit(4).alias("p2"), F.when(COL("o_orderkey") % 70 == 0, 5).otherwise(6).alias("p3"))
    return G.unit_checks(d, "place", "p1", ["p2", "p3"], ["a1", "a2"])


@query("ge7_zone_cards", f"""WITH s AS (SELECT s_nationkey AS z, s_suppkey % 7 + 1 AS area, x, y FROM {located_sql('supplier', 's_suppkey')} WHERE s_nationkey <> 5), p AS (SELECT c_nationkey AS z, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1),
g AS (SELECT z, count(*) AS sections, sum(x * area) / sum(area) AS cx, sum(y * area) / sum(area) AS cy, sum(area)::BIGINT AS area FROM s GROUP BY 1)
SELECT coalesce(g.z, p.z) AS z, coalesce(sections, 0) AS sections, round(cx, 5) AS cx, round(cy, 5) AS cy, coalesce(area, 0) AS area, coalesce(n, 0) AS population FROM g FULL JOIN p ON g.z = p.z""")
def _(t):
    s = located(t, "supplier", "s_suppkey").filter("s_nationkey <> 5").select(COL("s_nationkey").alias("z"), (COL("s_suppkey") % 7 + 1).alias("area"), "x", "y")
    p = t.customer.filter("c_nationkey <> 3").select(COL("c_nationkey").alias("z"), F.lit(1).alias("n"))
    return r(G.zone_cards(s, p, "z").na.fill(0, ["sections", "area", "population"]), "cx", "cy", digits=5)
