"""Raking to margins: fixed sweeps against chained SQL, plus the tolerance form."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.aggregate_queries import CUBE, COL, constraint_cube
from popweave.operators import aggregates as A, cube as C, joins as J, raking as R

OC = "orders JOIN customer ON o_custkey = c_custkey"


def oc(t):
    return t.orders.join(t.customer, COL("o_custkey") == COL("c_custkey")).select(
        "o_orderkey", COL("o_orderstatus").alias("s"), COL("c_mktsegment").alias("a"), COL("o_orderpriority").alias("b"), F.year("o_orderdate").alias("y"), "c_nationkey")


def sweeps(first, rows, cols, n):
    """CTE chain: ``n`` sweeps over ``first(.., m)`` with targets rt(rows.., target), ct(cols.., target)."""
    out, prev = "", first
    half = lambda name, src, keys, target: f""", {name} AS (SELECT p.* EXCLUDE (m, s0), m * coalesce(target, 0) / CASE WHEN s0 = 0 THEN 1 ELSE s0 END AS m
 FROM (SELECT *, sum(m) OVER (PARTITION BY {keys}) AS s0 FROM {src}) p LEFT JOIN {target} USING ({keys}))"""
    for i in range(1, n + 1):
        out += half(f"r{i}", prev, ", ".join(rows), "rt") + half(f"c{i}", f"r{i}", ", ".join(cols), "ct")
        prev = f"c{i}"
    return out, prev


def rake_sql(head, rows, cols, n, select):
    chain, last = sweeps("cells", rows, cols, n)
    return f"WITH {head}{chain} {select.format(last=last)}"


BASE = f"""d AS (SELECT o_orderstatus AS s, c_mktsegment AS a, o_orderpriority AS b, year(o_orderdate) AS y, c_nationkey FROM {OC}), cells AS (SELECT s, a, b, count(*) + 1e-9::DOUBLE AS m FROM d WHERE y < 1998 GROUP BY ALL),
rt AS (SELECT s, a, count(*)::DOUBLE AS target FROM d WHERE y >= 1998 GROUP BY ALL), ct AS (SELECT s, b, count(*)::DOUBLE AS target FROM d WHERE y >= 1998 GROUP BY ALL)"""


def base(t):
    d = oc(t)
    late = d.filter("y >= 1998")
    cells = d.filter("y < 1998").groupBy("s", "a", "b").agg((F.count("*") + R.SUPPORT).alias("m"))
    return d, cells, late.groupBy("s", "a").agg(F.count("*").alias("target")), late.groupBy("s", "b").agg(F.count("*").alias("target"))


@query("ip1_two_margins", rake_sql(BASE, ["s", "a"], ["s", "b"], 3, "SELECT s, a, b, round(m, 5) AS fitted FROM {last}"))
def _(t):
    _, cells, rt, ct = base(t)
    return r(R.rake_two(cells, "m", ["s", "a"], ["s", "b"], rt, ct, 3).select("s", "a", "b", "fitted"), "fitted", digits=5)


@query("ip1_two_margins_converged", f"WITH {BASE} SELECT s, a, round(target, 4) AS mass FROM rt")
def _(t):
    _, cells, rt, ct = base(t)
    f = R.rake_two(cells, "m", ["s", "a"], ["s", "b"], rt, ct, 60, tolerance=1e-8)
    return r(f.groupBy("s", "a").agg(F.sum("fitted").alias("mass")), "mass", digits=4)


ZERO = """lq AS (SELECT l_returnflag AS s, CAST(l_quantity AS INT) AS age, 'L' || l_linenumber AS attr, l_shipdate FROM lineitem),
allc AS (SELECT s, age, attr FROM (SELECT DISTINCT s, age FROM lq) CROSS JOIN (SELECT DISTINCT attr FROM lq)),
rt AS (SELECT s, age, count(*)::DOUBLE AS target FROM lq GROUP BY ALL), ct AS (SELECT s, attr, count(*)::DOUBLE AS target FROM lq GROUP BY ALL),
ok AS (SELECT *, age >= CASE attr WHEN 'L1' THEN 0 WHEN 'L7' THEN 60 ELSE CAST(substr(attr, 2) AS INT) * 4 END AS ok FROM allc), dead AS (SELECT s, attr FROM ok JOIN ct USING (s, attr) WHERE target > 0 GROUP BY ALL HAVING NOT bool_or(ok)),
cells AS (SELECT s, age, attr, 1.0::DOUBLE AS m FROM ok WHERE ok OR (s, attr) IN (SELECT (s, attr) FROM dead))"""


@query("ip2_structural_zeros", rake_sql(ZERO, ["s", "age"], ["s", "attr"], 3, "SELECT s, age, attr, round(m, 5) AS fitted FROM {last}"))
def _(t):
    d = t.lineitem.select(COL("l_returnflag").alias("s"), COL("l_quantity").cast("int").alias("age"), F.concat(F.lit("L"), "l_linenumber").alias("attr"))
    rt = d.groupBy("s", "age").agg(F.count("*").alias("target"))
    ct = d.groupBy("s", "attr").agg(F.count("*").alias("target"))
    attrs = ct.groupBy("s").agg(F.collect_set("attr").alias("at"))
    cells = rt.select("s", "age").join(attrs, "s").select("s", "age", F.explode("at").alias("attr"), F.lit(1.0).alias("m"))
    least = F.when(COL("attr") == "L1", 0).when(COL("attr") == "L7", 60).otherwise(F.substring("attr", 2, 9).cast("int") * 4)
    return r(R.rake_two(R.release_dead_targets(cells, COL("age") >= least, ["s", "attr"], ct), "m", ["s", "age"], ["s", "attr"], rt, ct, 3).select("s", "age", "attr", "fitted"), "fitted", digits=5)


SEED3 = f"""cu AS (SELECT 'N' || (n_nationkey % 8) AS paese, CASE WHEN c_custkey % 3 = 0 THEN 'F' ELSE 'M' END AS sesso, 'G' || (c_nationkey % 4) AS geo, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
mg AS (SELECT paese, sesso, count(*) AS n FROM cu GROUP BY ALL), loc AS (SELECT geo, CASE WHEN geo = 'G1' THEN '*' ELSE sesso END AS slot, CASE WHEN paese IN ('N5', 'N6', 'N7') AND geo <> 'G0' THEN 'ALTRI' ELSE paese END AS paese, count(*)::DOUBLE AS n FROM cu WHERE c_custkey % 5 <> 0 GROUP BY ALL),
nat AS (SELECT paese, sum(n) / (SELECT sum(n) FROM mg) AS nat FROM mg GROUP BY 1), qu AS (SELECT p.paese, x.sesso, p.nat, coalesce(mg.n, 0) / (SELECT sum(n) FROM mg z WHERE z.paese = p.paese) AS quota FROM nat p CROSS JOIN (VALUES ('M'), ('F')) x(sesso) LEFT JOIN mg ON mg.paese = p.paese AND mg.sesso = x.sesso),
gs AS (SELECT g.geo, q.*, sl.slot FROM (SELECT DISTINCT geo FROM cu) g CROSS JOIN qu q CROSS JOIN (VALUES ('own'), ('*')) sl(slot)), gw AS (SELECT geo, paese, sesso, nat, quota, CASE WHEN slot = 'own' THEN sesso ELSE '*' END AS slot FROM gs),
jj AS (SELECT gw.*, l.n AS named, z.n AS rest FROM gw LEFT JOIN loc l ON l.geo = gw.geo AND l.slot = gw.slot AND l.paese = gw.paese LEFT JOIN loc z ON z.geo = gw.geo AND z.slot = gw.slot AND z.paese = 'ALTRI'),
fr AS (SELECT *, sum(CASE WHEN named IS NULL THEN nat ELSE 0 END) OVER (PARTITION BY geo, slot, sesso) AS free FROM jj),
cells AS (SELECT paese, sesso, geo, greatest(sum(coalesce(named, coalesce(rest * nat / nullif(free, 0), 0)) * CASE WHEN slot = '*' THEN quota ELSE 1 END), 1e-12) AS m FROM fr GROUP BY ALL),
rt AS (SELECT paese, sesso, n::DOUBLE AS target FROM mg), ct AS (SELECT geo, count(*)::DOUBLE AS target FROM cu GROUP BY 1)"""


def seed3(t):
    d = t.customer.join(t.nation, COL("c_nationkey") == COL("n_nationkey")).select(
        F.concat(F.lit("N"), COL("n_nationkey") % 8).alias("paese"), F.when(COL("c_custkey") % 3 == 0, "F").otherwise("M").alias("sesso"), F.concat(F.lit("G"), COL("c_nationkey") % 4).alias("geo"), "c_custkey")
    mg = d.groupBy("paese", "sesso").agg(F.count("*").alias("n"))
    loc = d.filter("c_custkey % 5 <> 0").select("geo", F.when(COL("geo") != "G1", COL("sesso")).alias("sesso"),
            F.when(COL("paese").isin("N5", "N6", "N7") & (COL("geo") != "G0"), "ALTRI").otherwise(COL("paese")).alias("paese"), F.lit(1.0).alias("n"))
    return d, mg, R.country_seed(loc, mg, d, "ALTRI")


@query("ip3_country_seed", f"WITH {SEED3} SELECT paese, sesso, geo, round(m, 6) AS seed FROM cells")
def _(t):
    return r(seed3(t)[2], "seed")


def three(t, n=2):
    d, mg, seed = seed3(t)
    geo = d.groupBy("geo").agg(F.count("*").alias("target"))
    return R.rake_two(seed, "seed", ["paese", "sesso"], ["geo"], mg.withColumnRenamed("n", "target"), geo, n)


@query("ip3_three_way", rake_sql(SEED3, ["paese", "sesso"], ["geo"], 2, "SELECT paese, sesso, geo, round(m, 5) AS fitted FROM {last}"))
def _(t):
    return r(three(t).select("paese", "sesso", "geo", "fitted"), "fitted", digits=5)


CAL = f"""d AS (SELECT o_orderstatus AS s, c_mktsegment AS a, o_orderpriority AS b, year(o_orderdate) AS y, c_nationkey FROM {OC}), j AS (SELECT s, a, b, count(*) AS w FROM d WHERE y < 1999 GROUP BY ALL),
cells AS (SELECT s, CASE WHEN a IN ('BUILDING', 'MACHINERY') THEN 'works' ELSE 'home' END AS ma, CASE WHEN b < '3' THEN 'fast' WHEN b < '4' THEN 'mid' ELSE 'slow' END AS mb, a, b, w, w / sum(w) OVER (PARTITION BY s)::DOUBLE AS m FROM j),
late AS (SELECT s, CASE WHEN a IN ('BUILDING', 'MACHINERY') THEN 'works' ELSE 'home' END AS ma, CASE WHEN b < '3' THEN 'fast' WHEN b < '4' THEN 'mid' ELSE 'slow' END AS mb FROM d WHERE y >= 1999),
rt AS (SELECT s, ma, target / sum(target) OVER (PARTITION BY s) AS target FROM (SELECT s, ma, count(*)::DOUBLE AS target FROM late GROUP BY ALL)), ct AS (SELECT s, mb, target / sum(target) OVER (PARTITION BY s) AS target FROM (SELECT s, mb, count(*)::DOUBLE AS target FROM late GROUP BY ALL))"""


def cal(t):
    ma = F.when(COL("a").isin("BUILDING", "MACHINERY"), "works").otherwise("home")
    mb = F.when(COL("b") < "3", "fast").when(COL("b") < "4", "mid").otherwise("slow")
    d = oc(t).withColumn("ma", ma).withColumn("mb", mb)
    j = d.filter("y < 1999").groupBy("s", "a", "b", "ma", "mb").agg(F.count("*").alias("w"))
    late = d.filter("y >= 1999")
    return j, late.groupBy("s", "ma").agg(F.count("*").cast("double").alias("target")), late.groupBy("s", "mb").agg(F.count("*").cast("double").alias("target"))


@query("ip4_calibrated_joint", rake_sql(CAL, ["s", "ma"], ["s", "mb"], 3, "SELECT s, a, b, round(m / (sum(m) OVER (PARTITION BY s)) * sum(w) OVER (PARTITION BY s), 5) AS calibrated FROM {last}"))
def _(t):
    j, ta, tb = cal(t)
    return r(R.calibrate(j, "w", ["s"], "ma", "mb", ta, tb, 3).select("s", "a", "b", "calibrated"), "calibrated", digits=5)


@query("ip4_usable_margin", """SELECT c_nationkey, count(DISTINCT c_mktsegment) AS classes, count(*) AS units, count(DISTINCT c_mktsegment) >= 5 AND count(*) >= 60 AS usable FROM customer WHERE NOT (c_nationkey = 3 AND c_mktsegment = 'BUILDING') GROUP BY 1""")
def _(t):
    d = t.customer.filter("NOT (c_nationkey = 3 AND c_mktsegment = 'BUILDING')").withColumn("one", F.lit(1).cast("bigint"))
    return R.usable_margin(d, ["c_nationkey"], "c_mktsegment", "one", 5, 60)


@query("ip5_calibration_miss", f"WITH {CAL}, g AS (SELECT s, ma, sum(m) AS g FROM cells GROUP BY ALL) SELECT s, round(sum(abs(g - target)) / 2, 6) AS miss FROM rt JOIN g USING (s, ma) GROUP BY 1")
def _(t):
    j, ta, _ = cal(t)
    return r(R.calibration_miss(j, "w", ["s"], "ma", ta), "miss")


Z23 = f"""d AS (SELECT o_orderstatus AS s, c_mktsegment AS a, o_orderpriority AS b, year(o_orderdate) AS y, c_nationkey AS z FROM {OC}),
sh AS (SELECT s, z, n / sum(n) OVER (PARTITION BY s)::DOUBLE AS share FROM (SELECT s, z, count(*) AS n FROM d GROUP BY ALL)), mu AS (SELECT s, a, count(*)::DOUBLE AS n FROM d WHERE y >= 1998 GROUP BY ALL),
cells AS (SELECT s, z, a, share * n + 1e-9 AS m FROM sh JOIN mu USING (s)), zt AS (SELECT s, z, count(*)::DOUBLE AS target FROM d WHERE y >= 1998 GROUP BY ALL), rt AS (SELECT * FROM zt), ct AS (SELECT s, a, n AS target FROM mu)"""


@query("ip6_zone_attribute", rake_sql(Z23, ["s", "z"], ["s", "a"], 2, "SELECT s, z, a, round(m, 5) AS fitted FROM {last}"))
def _(t):
    d = oc(t).withColumnRenamed("c_nationkey", "z").withColumn("one", F.lit(1))
    late = d.filter("y >= 1998")
    sh = A.zone_shares(d, ["s"], "z", "one")
    mu = late.groupBy("s", "a").agg(F.count("*").cast("double").alias("n"))
    cells = A.expand_shares(mu, sh, ["s"], "n").select("s", "z", "a", (COL("n") + R.SUPPORT).alias("m"))
    return r(R.rake_two(cells, "m", ["s", "z"], ["s", "a"], late.groupBy("s", "z").agg(F.count("*").alias("target")), mu.withColumnRenamed("n", "target"), 2).select("s", "z", "a", "fitted"), "fitted", digits=5)


LAT = f"""d AS (SELECT o_orderstatus AS s, c_mktsegment AS a, o_orderpriority AS b FROM {OC}), n AS (SELECT count(*)::DOUBLE AS n FROM d),
lat AS (SELECT s, a, b FROM (SELECT DISTINCT s FROM d) CROSS JOIN (SELECT DISTINCT a FROM d) CROSS JOIN (SELECT DISTINCT b FROM d) WHERE NOT (s = 'F' AND b = '5-LOW')),
p0 AS (SELECT s, a, b, 1.0::DOUBLE / (SELECT count(*) FROM lat) AS p FROM lat),
k1 AS (SELECT s, a, count(*) / (SELECT n FROM n) AS alpha FROM d GROUP BY ALL), k2 AS (SELECT a, b, count(*) / (SELECT n FROM n) AS alpha FROM d WHERE a <> 'BUILDING' GROUP BY ALL), k3 AS (SELECT b, count(*) / (SELECT n FROM n) AS alpha FROM d GROUP BY ALL)"""


def _ip7_sql(n=2):
    out, prev, i = f"WITH {LAT}", "p0", 0
    for _ in range(n):
        for k, attrs in (("k1", "s, a"), ("k2", "a, b"), ("k3", "b")):
            i += 1
            on = " AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in attrs.split(","))
            out += f""", g{i} AS (SELECT {attrs}, sum(p) AS q FROM {prev} GROUP BY ALL), h{i} AS (SELECT x.*, y.alpha FROM g{i} x LEFT JOIN {k} y ON {on}),
 t{i} AS (SELECT sum(alpha) AS sa, sum(CASE WHEN alpha IS NOT NULL THEN q END) AS sq FROM h{i}),
 p{i} AS (SELECT p.s, p.a, p.b, p.p * CASE WHEN h.alpha IS NOT NULL THEN h.alpha / h.q WHEN 1 - t.sq > 1e-15 THEN greatest(1 - t.sa, 0) / (1 - t.sq) ELSE 1 END AS p FROM {prev} p JOIN h{i} h USING ({attrs}), t{i} t)"""
            prev = f"p{i}"
    return out, prev


def lattice_blocks(t):
    d = oc(t).select("s", "a", "b")
    n = d.agg(F.count("*").cast("double")).scalar()
    lat = J.lattice(d, ["s", "a", "b"]).filter("NOT (s = 'F' AND b = '5-LOW')")
    blk = lambda df, *k: (list(k), df.groupBy(*k).agg((F.count("*") / n).alias("alpha")))
    return lat, [blk(d, "s", "a"), blk(d.filter("a <> 'BUILDING'"), "a", "b"), blk(d, "b")]


SQL7, LAST7 = _ip7_sql(2)


@query("ip7_block_raking", SQL7 + f" SELECT s, a, b, round(p / (SELECT sum(p) FROM {LAST7}), 9) AS p FROM {LAST7}")
def _(t):
    lat, blocks = lattice_blocks(t)
    return r(R.rake_blocks(lat, blocks, 2), "p", digits=9)


def part_fit(t):
    """A lattice of brands, types and sizes and two overlapping margins of it."""
    d = t.part.select("p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    n = d.agg(F.count("*").cast("double")).scalar()
    blk = lambda *k: (list(k), d.groupBy(*k).agg((F.count("*") / n).alias("alpha")))
    return J.lattice(d, ["p_brand", "p_type", "p_size"]), [blk("p_brand", "p_type"), blk("p_type", "p_size"), blk("p_brand")]


@query("ip7_converged", "SELECT p_brand, p_type, round(count(*) / (SELECT count(*) FROM part)::DOUBLE, 8) AS mass FROM part GROUP BY 1, 2")
def _(t):
    """Fit to convergence; the fitted margin is the wanted one, and nothing is left elsewhere."""
    lat, blocks = part_fit(t)
    f = R.rake_blocks(lat, blocks, 100, tolerance=1e-9)
    return r(f.groupBy("p_brand", "p_type").agg(F.sum("p").alias("mass")).filter("mass > 1e-12"), "mass", digits=8)


@query("ip8_constraint_filter", CUBE + "SELECT block, key, round(alpha, 8) AS alpha FROM cube WHERE alpha > 0 AND alpha >= 0.04 AND block <> 'Z'")
def _(t):
    return r(C.filter_constraints(constraint_cube(t), 0.04, skip=["Z"]).select("block", "key", "alpha"), "alpha", digits=8)


@query("ip9_fit_diagnostics", SQL7 + f""", fp AS (SELECT s, a, b, p / (SELECT sum(p) FROM {LAST7}) AS p FROM {LAST7}), e AS (
 SELECT abs(q - alpha) / alpha AS re FROM k1 JOIN (SELECT s, a, sum(p) AS q FROM fp GROUP BY ALL) USING (s, a) UNION ALL SELECT abs(q - alpha) / alpha FROM k2 JOIN (SELECT a, b, sum(p) AS q FROM fp GROUP BY ALL) USING (a, b)
 UNION ALL SELECT abs(q - alpha) / alpha FROM k3 JOIN (SELECT b, sum(p) AS q FROM fp GROUP BY ALL) USING (b))
SELECT round(sum(CASE WHEN s = 'O' AND b = '1-URGENT' THEN p ELSE 0 END), 7) AS forbidden_mass, round(-sum(p * ln(p)), 6) AS entropy, count(*) FILTER (p > 1e-12) AS support, count(*) AS states, round((SELECT avg(re) FROM e), 6) AS mre FROM fp""")
def _(t):
    lat, blocks = lattice_blocks(t)
    f = R.rake_blocks(lat, blocks, 2)
    return r(r(R.fit_diagnostics(f, "p", blocks, (COL("s") == "O") & (COL("b") == "1-URGENT")), "entropy", "mre"), "forbidden_mass", digits=7)


@query("ip9_divergence", f"""WITH d AS (SELECT o_orderstatus AS s, o_orderpriority AS b, year(o_orderdate) AS y FROM {OC}), a AS (SELECT s, b, count(*) / (SELECT count(*) FROM d WHERE y < 1998)::DOUBLE AS p FROM d WHERE y < 1998 GROUP BY ALL), c AS (SELECT s, b, count(*) / (SELECT count(*) FROM d WHERE y >= 1998)::DOUBLE AS p FROM d WHERE y >= 1998 GROUP BY ALL)
SELECT round(sum(a.p * ln(a.p / c.p)), 8) AS kl_ab, round(sum(c.p * ln(c.p / a.p)), 8) AS kl_ba FROM a JOIN c USING (s, b)""")
def _(t):
    d = oc(t)
    side = lambda f: A.with_totals(f.groupBy("s", "b").agg(F.count("*").alias("c")), [], {"t": F.sum("c")}).select("s", "b", (COL("c") / COL("t")).alias("p"))
    return r(R.divergence(side(d.filter("y < 1998")), side(d.filter("y >= 1998")), ["s", "b"], "p"), "kl_ab", "kl_ba", digits=8)


@query("ip10_national_mix", "WITH s AS (SELECT c_mktsegment AS item, count(*) / (SELECT count(*) FROM customer)::DOUBLE AS share FROM customer GROUP BY 1) SELECT s_suppkey, item, round(s_acctbal * share, 6) AS n FROM supplier CROSS JOIN s")
def _(t):
    sh = A.with_totals(t.customer.groupBy(COL("c_mktsegment").alias("item")).agg(F.count("*").alias("c")), [], {"t": F.sum("c")}).select("item", (COL("c") / COL("t")).alias("share"))
    return r(R.national_mix(t.supplier, "s_suppkey", "s_acctbal", sh, "item"), "n")


@query("ds21_geographic_information", rake_sql(SEED3, ["paese", "sesso"], ["geo"], 2, """, u AS (SELECT geo, paese, sum(m) AS m FROM {last} GROUP BY ALL), g AS (SELECT *, sum(m) OVER (PARTITION BY geo) AS n, sum(m) OVER (PARTITION BY paese) AS gk, sum(m) OVER () AS gn FROM u)
SELECT geo, round(n, 4) AS n, round(sum(abs(m / n - gk / gn)) / 2, 5) AS tvd FROM g GROUP BY ALL"""))
def _(t):
    from popweave.operators.distances import unit_distances
    return r(r(unit_distances(three(t), [], "geo", "paese", "fitted"), "n", digits=4), "tvd", digits=5).select("geo", "n", "tvd")


@query("ds21_top_categories", rake_sql(SEED3, ["paese", "sesso"], ["geo"], 2, """, u AS (SELECT geo, paese, sum(m) AS m FROM {last} GROUP BY ALL) SELECT geo, paese, round(m, 4) AS n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY geo ORDER BY m DESC, paese) AS rank FROM u) WHERE rank <= 3"""))
def _(t):
    from popweave.operators.windows import top_k
    u = three(t).groupBy("geo", "paese").agg(F.sum("fitted").alias("n"))
    return r(top_k(u, ["geo"], [F.desc("n"), COL("paese")], 3), "n", digits=4)
