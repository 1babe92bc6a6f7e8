"""Joins: reconciliation, fallback, hierarchies and spatial matches."""
from pyspark.sql import functions as F

from popweave.catalog import located, located_sql, match_sql, query, r
from popweave.functions.draws import draw, draw_sql
from popweave.operators import joins as J, spatial as S
from popweave.plans.intervals import range_lookup


@query("jn1_merge_on_key", """SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "c_nationkey")


RECON = """WITH a AS (SELECT c_nationkey AS k, count(*) AS a FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_acctbal > 0 GROUP BY 1),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a, 0)::BIGINT AS a, coalesce(b, 0)::BIGINT AS b, (coalesce(a, 0) - coalesce(b, 0))::BIGINT AS diff FROM a FULL JOIN b ON a.k = b.k) """


def _recon(t):
    return J.reconcile(t.customer.select(F.col("c_nationkey").alias("k"), F.lit(1).alias("v")),
                       t.supplier.filter("s_acctbal > 0").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("v")), ["k"], "v")


@query("jn2_reconcile", RECON + "SELECT * FROM j")
def _(t):
    return _recon(t)


@query("jn2_reconcile_worst", RECON + "SELECT k, diff, (SELECT round(avg(abs(diff)), 6) FROM j) AS mae FROM j ORDER BY abs(diff) DESC, k LIMIT 5")
def _(t):
    d = _recon(t)
    return d.orderBy(F.desc(F.abs("diff")), "k").limit(5).select("k", "diff").withColumn("mae", d.agg(F.round(F.avg(F.abs("diff")), 6)).scalar())


@query("jn3_missing_groups", """SELECT count(*) AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def _(t):
    return (t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
            .agg(F.count("*").alias("missing")))


@query("jn4_membership", """
SELECT known, count(*) AS n, round(sum(l_quantity), 2) AS mass FROM (SELECT l_quantity, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS known FROM lineitem) GROUP BY 1""")
def _(t):
    ref = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey")).distinct().withColumn("known", F.lit(True))
    known = t.lineitem.join(ref, "l_partkey", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return known.groupBy("known").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("mass"))


@query("jn5_parent_map", """
SELECT c_mktsegment AS child, min(c_nationkey % 2) AS parent, count(DISTINCT c_nationkey % 2) AS parents, count(DISTINCT c_nationkey % 2) > 1 AS violation FROM customer GROUP BY 1
UNION ALL SELECT n_name, min(n_regionkey), 1, false FROM nation GROUP BY 1""")
def _(t):
    a = J.parent_map(t.customer.select("c_mktsegment", (F.col("c_nationkey") % 2).alias("p")), "c_mktsegment", "p").withColumnRenamed("c_mktsegment", "child")
    b = J.parent_map(t.nation, "n_name", "n_regionkey").withColumnRenamed("n_name", "child")
    return a.unionByName(b)


def boxes(t):
    """Nation boxes of 17 x 17 on a grid of 20, as rings of vertices."""
    x0, y0 = (F.col("n_nationkey") % 5) * 20 + 1.0, F.floor(F.col("n_nationkey") / 5) * 20 + 1.0
    v = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return t.nation.select("n_nationkey", F.array(v(x0, y0), v(x0 + 17, y0), v(x0 + 17, y0 + 17), v(x0, y0 + 17)).alias("verts"))


PIP = f"""WITH p AS (SELECT c_custkey, c_nationkey, x, y FROM {located_sql()}),
b AS (SELECT n_nationkey, n_nationkey % 5 * 20 + 1.0::DOUBLE AS x0, n_nationkey // 5 * 20 + 1.0::DOUBLE AS y0 FROM nation),
d AS (SELECT c_custkey, n_nationkey, sqrt(greatest(x0 - x, 0, x - x0 - 17) ** 2 + greatest(y0 - y, 0, y - y0 - 17) ** 2) AS d FROM p, b),
m AS (SELECT c_custkey, min(d) AS d, arg_min(n_nationkey, d * 1000 + n_nationkey * 1e-9) AS k FROM d WHERE d <= 1.2 GROUP BY 1),
j AS (SELECT p.*, m.d, m.k, CASE WHEN m.d IS NULL THEN 'unmatched' WHEN m.d = 0 THEN 'within' ELSE 'nearest' END AS method FROM p LEFT JOIN m USING (c_custkey)) """


def _pip(t):
    return J.point_in_polygon(located(t).select("c_custkey", "c_nationkey", "x", "y"), boxes(t), "c_custkey", "n_nationkey", 10.0, 1.2)


@query("jn6_point_in_polygon", PIP + "SELECT c_custkey, coalesce(k, -1) AS section, round(coalesce(d, -1), 6) AS distance, method FROM j")
def _(t):
    return _pip(t).select("c_custkey", F.coalesce("n_nationkey", F.lit(-1)).alias("section"), F.round(F.coalesce("distance", F.lit(-1.0)), 6).alias("distance"), "method")


# corners of a nation's rings, from the lower left corner of its box: an outline, a slanted hole, an island in it, a second part
RINGS = [[(0, 0), (17, 0), (17, 17), (0, 17)], [(4, 8.5), (8.5, 3), (13, 8.5), (8.5, 14)], [(7, 7), (10, 8), (8, 10)], [(17.4, 4), (19.4, 9), (17.4, 12)]]
CORNERS = [(i, j, float(x), float(y)) for i, ring in enumerate(RINGS) for j, (x, y) in enumerate(ring)]
SIDES = [(*map(float, a), *map(float, b)) for ring in RINGS for a, b in zip(ring, ring[1:] + ring[:1])]


def ringed(points: str, key: str) -> str:
    """SQL of ``points`` matched with the nations' rings: ``p`` and the match ``m(key, b)``."""
    return f"""WITH p AS ({points}), s(ax, ay, bx, bz) AS (VALUES {', '.join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in SIDES)}),
e AS (SELECT n_nationkey AS k, ax + x0 AS ax, ay + y0 AS ay, bx + x0 AS bx, bz + y0 AS bz FROM s, (SELECT n_nationkey, n_nationkey % 5 * 20 + 1.0 AS x0, n_nationkey // 5 * 20 + 1.0 AS y0 FROM nation)),
t AS (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (bz - ay)) / ((bx - ax) ** 2 + (bz - ay) ** 2))) AS t FROM p, e),
g AS (SELECT {key}, k, min(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (bz - ay)) ** 2)) AS d,
             count(*) FILTER ((ay > y) <> (bz > y) AND x > ax + (bx - ax) * (y - ay) / nullif(bz - ay, 0)) % 2 = 1 AS inside FROM t GROUP BY ALL),
m AS (SELECT {key}, min({{'o': NOT inside, 'd': CASE WHEN inside THEN 0 ELSE d END, 'k': k}}) AS b FROM g WHERE inside OR d <= 1.2 GROUP BY 1) """


def nation_edges(t):
    corners = F.inline(F.array(*[F.struct(F.lit(i).alias("ring"), F.lit(j).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, j, x, y in CORNERS]))
    x0, y0 = (F.col("n_nationkey") % 5) * 20 + 1.0, F.floor(F.col("n_nationkey") / 5) * 20 + 1.0
    vertices = t.nation.select("n_nationkey", x0.alias("x0"), y0.alias("y0"), corners).select("n_nationkey", "ring", "seq", (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y"))
    return S.ring_edges(vertices, "n_nationkey")


@query("jn6_rings", ringed(f"SELECT c_custkey, x, y FROM {located_sql()}", "c_custkey") + """SELECT c_custkey, coalesce(b.k, -1) AS section, round(coalesce(b.d, -1), 6) AS distance, CASE WHEN b IS NULL THEN 'unmatched' WHEN b.o THEN 'nearest' ELSE 'within' END AS method FROM p LEFT JOIN m USING (c_custkey)""")
def _(t):
    got = S.point_in_rings(located(t).select("c_custkey", "x", "y"), nation_edges(t), "c_custkey", "n_nationkey", 5.0, 1.2)
    return got.select("c_custkey", F.coalesce("n_nationkey", F.lit(-1)).alias("section"), F.round(F.coalesce("distance", F.lit(-1.0)), 6).alias("distance"), "method")


@query("jn7_match_counters", PIP + """
SELECT c_nationkey % 5 AS province, count(*) AS input, count(*) FILTER (x BETWEEN 2 AND 95 AND y BETWEEN 2 AND 85) AS in_box,
 count(*) FILTER (method = 'within') AS within, count(*) FILTER (method = 'nearest') AS nearest, count(*) FILTER (method = 'unmatched') AS unmatched,
 count(*) FILTER (k IS NOT NULL AND k <> c_nationkey) AS elsewhere FROM j GROUP BY 1""")
def _(t):
    c = lambda cond, n: F.sum(F.when(cond, 1).otherwise(0)).alias(n)
    m = F.col("method")
    return (_pip(t).groupBy((F.col("c_nationkey") % 5).alias("province"))
            .agg(F.count("*").alias("input"), c(F.col("x").between(2, 95) & F.col("y").between(2, 85), "in_box"), c(m == "within", "within"),
                 c(m == "nearest", "nearest"), c(m == "unmatched", "unmatched"), c(F.col("n_nationkey") != F.col("c_nationkey"), "elsewhere")))


NEAR = f"""WITH p AS (SELECT c_custkey, x, y FROM {located_sql()}), f AS (SELECT s_suppkey, x AS fx, y AS fy FROM {located_sql('supplier', 's_suppkey')}),
d AS (SELECT c_custkey, s_suppkey, sqrt((x - fx) ** 2 + (y - fy) ** 2) AS d FROM p, f) """


@query("jn8_nearest_facility", NEAR + "SELECT c_custkey, arg_min(s_suppkey, d) AS s_suppkey, round(min(d), 6) AS distance FROM d GROUP BY 1")
def _(t):
    return r(S.nearest_place(located(t), located(t, "supplier", "s_suppkey"), "c_custkey", "s_suppkey"), "distance")


# degrees: 0 to 97 and 0 to 90 spread over the whole globe, poles and date line too
GLOBE = f"""WITH p AS (SELECT c_custkey, radians(x * 3.7 - 180) AS lon, radians(y * 2 - 90) AS lat FROM {located_sql()}), f AS (SELECT s_suppkey, radians(x * 3.7 - 180) AS flon, radians(y * 2 - 90) AS flat FROM {located_sql('supplier', 's_suppkey')}),
d AS (SELECT c_custkey, s_suppkey, 2 * 6371000.0 * asin(sqrt(least(1.0, sin((flat - lat) / 2) ** 2 + cos(lat) * cos(flat) * sin((flon - lon) / 2) ** 2))) AS d FROM p, f) """


@query("jn8_lonlat", GLOBE + "SELECT c_custkey, arg_min(s_suppkey, d) AS s_suppkey, round(min(d), 3) AS metres FROM d GROUP BY 1")
def _(t):
    place = lambda d: d.withColumn("x", F.col("x") * 3.7 - 180).withColumn("y", F.col("y") * 2 - 90)         # noqa: E731
    got = S.nearest_place(place(located(t)), place(located(t, "supplier", "s_suppkey")), "c_custkey", "s_suppkey", globe=True)
    return got.select("c_custkey", "s_suppkey", F.round("distance", 3).alias("metres"))


@query("jn9_one_to_one_match", match_sql(3.0) + "SELECT a AS a_id, b AS b_id, round(d, 6) AS distance FROM m")
def _(t):
    a = located(t).select(F.col("c_custkey").alias("a_id"), "x", "y")
    b = located(t, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("b_id"), "x", "y")
    return r(J.one_to_one(a, b, 3.0), "distance")


BANDS = [("0-8", 0, 8), ("9-14", 9, 14), ("15-24", 15, 24), ("25-34", 25, 34), ("35-49", 35, 49), ("50+", 50, 199)]


def band_table(t):
    return t.region.agg(F.count("*").alias("k")).select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, lo, hi in BANDS])).alias("r")).select("r.*")


BAND_SQL = "(VALUES ('0-8', 0, 8), ('9-14', 9, 14), ('15-24', 15, 24), ('25-34', 25, 34), ('35-49', 35, 49), ('50+', 50, 199)) b(band, lo, hi)"


@query("jn10_interval_lookup", f"SELECT band, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN {BAND_SQL} ON l_quantity BETWEEN lo AND hi GROUP BY 1")
def _(t):
    return r(range_lookup(t.lineitem, "l_quantity", band_table(t), "lo", "hi").groupBy("band").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price")), "price", digits=2)


@query("jn11_lattice", """
SELECT a.s AS c_mktsegment, p.p AS o_orderpriority, f.f AS o_orderstatus, count(o_orderkey) AS n FROM (SELECT DISTINCT c_mktsegment AS s FROM customer) a,
 (SELECT DISTINCT o_orderpriority AS p FROM orders) p, (SELECT DISTINCT o_orderstatus AS f FROM orders) f
LEFT JOIN (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) o ON c_mktsegment = s AND o_orderpriority = p AND o_orderstatus = f GROUP BY ALL""")
def _(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    got = o.groupBy("c_mktsegment", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return (J.lattice(o, ["c_mktsegment", "o_orderpriority", "o_orderstatus"]).join(got, ["c_mktsegment", "o_orderpriority", "o_orderstatus"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))))


@query("jn12_fallback_level", """
WITH a AS (SELECT p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING count(*) >= 17),
c AS (SELECT p_brand FROM part GROUP BY ALL HAVING count(*) >= 80)
SELECT p_partkey, CASE WHEN a.p_size IS NOT NULL THEN 0 WHEN b.p_type IS NOT NULL THEN 1 WHEN c.p_brand IS NOT NULL THEN 2 ELSE 3 END AS level FROM part p
LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_type = p.p_type AND a.p_size = p.p_size LEFT JOIN b ON b.p_brand = p.p_brand AND b.p_type = p.p_type LEFT JOIN c ON c.p_brand = p.p_brand""")
def _(t):
    p = t.part
    # every level has its own threshold here, so three single-level calls are combined
    a = J.fallback_level(p.select("p_partkey", "p_brand", "p_type", "p_size"), p, [["p_brand", "p_type", "p_size"]], 2).withColumnRenamed("level", "l0")
    b = J.fallback_level(a, p, [["p_brand", "p_type"]], 17).withColumnRenamed("level", "l1")
    c = J.fallback_level(b, p, [["p_brand"]], 80).withColumnRenamed("level", "l2")
    return c.select("p_partkey", F.when(F.col("l0") == 0, 0).when(F.col("l1") == 0, 1).when(F.col("l2") == 0, 2).otherwise(3).alias("level"))


@query("jn13_repertoire_chain", """
WITH a AS (SELECT c_nationkey AS k, c_mktsegment AS s, max(c_name) AS v FROM customer WHERE c_acctbal > 9500 GROUP BY ALL),
b AS (SELECT c_nationkey AS k, max(c_name) AS v FROM customer WHERE c_acctbal > 9800 GROUP BY ALL), c AS (SELECT c_mktsegment AS s, max(c_name) AS v FROM customer GROUP BY ALL)
SELECT c_custkey, coalesce(a.v, b.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'local' WHEN b.v IS NOT NULL THEN 'local>zone' WHEN c.v IS NOT NULL THEN 'local>zone>all' END AS chain
FROM customer LEFT JOIN a ON a.k = c_nationkey AND a.s = c_mktsegment LEFT JOIN b ON b.k = c_nationkey LEFT JOIN c ON c.s = c_mktsegment""")
def _(t):
    d = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s"))
    src = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("s"), "c_acctbal", "c_name")
    tab = lambda df, *k: df.groupBy(*k).agg(F.max("c_name").alias("v"))
    return J.chained_lookup(d, [("local", tab(src.filter("c_acctbal > 9500"), "k", "s"), ["k", "s"]), ("zone", tab(src.filter("c_acctbal > 9800"), "k"), ["k"]),
                                ("all", tab(src, "s"), ["s"])], "v").select("c_custkey", "v", "chain")


@query("jn14_tree", """
WITH RECURSIVE e AS (SELECT p_partkey AS code, CASE WHEN p_partkey < 7 THEN p_partkey ELSE p_partkey // 3 END AS up FROM part),
w AS (SELECT code, up, 1 AS h FROM e UNION ALL SELECT w.code, e.up, h + 1 FROM w JOIN e ON w.up = e.code AND e.up <> e.code)
SELECT e.code, (SELECT arg_max(up, h) FROM w WHERE w.code = e.code) AS root, NOT EXISTS (SELECT 1 FROM e c WHERE c.up = e.code AND c.code <> e.code) AS leaf, e.up = e.code AS is_root FROM e""")
def _(t):
    e = t.part.select("p_partkey", F.when(F.col("p_partkey") < 7, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 3)).alias("up"))
    return J.tree(e, "p_partkey", "up")


def persons(t):
    """Lines of an order as members of a household, pointers by line number."""
    n = F.col("l_linenumber")
    d = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").cast("int").alias("age"))
    return d.select(F.col("l_orderkey").alias("hh"), n.alias("pid"), "age", F.when(n > 4, n - 4).alias("father"),
                    F.when(n == 6, F.lit(3)).alias("mother"), F.when(n == 1, F.lit(2)).when(n == 2, F.lit(1)).alias("partner"))


@query("jn15_family_roles", """
WITH d AS (SELECT l_orderkey AS hh, l_linenumber AS pid, l_partkey, CAST(max(l_quantity) AS INT) AS age FROM lineitem GROUP BY ALL),
p AS (SELECT hh, pid, age, CASE WHEN pid > 4 THEN pid - 4 END AS father, CASE WHEN pid = 6 THEN 3 END AS mother, CASE pid WHEN 1 THEN 2 WHEN 2 THEN 1 END AS partner FROM d),
ok AS (SELECT * FROM p WHERE (hh, pid) IN (SELECT (hh, pid) FROM p GROUP BY hh, pid HAVING count(*) = 1)),
l AS (SELECT hh, t AS pid, count(*) AS c FROM (SELECT hh, father AS t FROM ok UNION ALL SELECT hh, mother FROM ok UNION ALL SELECT hh, partner FROM ok) WHERE t IS NOT NULL GROUP BY ALL),
o AS (SELECT ok.*, coalesce(c, 0) AS links FROM ok LEFT JOIN l USING (hh, pid)),
rf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hh ORDER BY links DESC, age DESC, pid) AS rn FROM o) WHERE rn = 1),
z AS (SELECT o.*, r.pid AS ref, r.age AS ra, r.father AS rfa, r.mother AS rmo, r.partner AS rp, m.father AS pf, m.mother AS pm FROM o JOIN rf r ON r.hh = o.hh LEFT JOIN ok m ON m.hh = r.hh AND m.pid = r.partner),
w AS (SELECT *, CASE WHEN pid = ref THEN 'R' WHEN coalesce(pid = rp, false) OR coalesce(partner = ref, false) THEN 'P'
 WHEN coalesce(father IN (ref, rp), false) OR coalesce(mother IN (ref, rp), false) THEN 'F'
 WHEN coalesce(pid = rfa, false) OR coalesce(pid = rmo, false) OR coalesce(pid = pf, false) OR coalesce(pid = pm, false) THEN 'G' ELSE 'A' END AS role FROM z)
SELECT role, count(*) AS n, sum(links)::BIGINT AS links, sum(CASE WHEN role = 'F' THEN ra - age END)::BIGINT AS generation, sum(CASE WHEN role = 'P' THEN ra - age END)::BIGINT AS partner FROM w GROUP BY 1""")
def _(t):
    return (J.family_roles(persons(t)).groupBy("role").agg(F.count("*").alias("n"), F.sum("links").alias("links"),
            F.sum("generation_gap").alias("generation"), F.sum("partner_gap").alias("partner")))
