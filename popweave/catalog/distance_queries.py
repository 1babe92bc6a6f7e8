"""Distances, profiles, information measures and null models."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.aggregate_queries import COL, CUBE, constraint_cube, cust
from popweave.functions.counts import binomial_sql, hypergeometric_sql
from popweave.functions.draws import draw_sql
from popweave.operators import aggregates as A, cube as C, distances as D, nulls as N, windows as X
from popweave.session import cut_lineage

LP = "lineitem JOIN part ON l_partkey = p_partkey"


def lp(t):
    return t.lineitem.join(t.part, COL("l_partkey") == COL("p_partkey"))


@query("ds1_tvd", """
WITH a AS (SELECT c_nationkey % 5 AS k, c_mktsegment AS c, count(*)::DOUBLE AS a FROM customer WHERE c_nationkey < 10 AND NOT (c_nationkey % 5 = 3 AND c_mktsegment <> 'BUILDING') GROUP BY ALL),
b AS (SELECT c_nationkey % 5 AS k, c_mktsegment AS c, count(*)::DOUBLE AS b FROM customer WHERE c_nationkey >= 10 GROUP BY ALL),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.k = b.k AND a.c = b.c),
s AS (SELECT *, sum(a) OVER (PARTITION BY k) AS sa, sum(b) OVER (PARTITION BY k) AS sb FROM j)
SELECT k, CASE WHEN count(*) FILTER (a > 0 AND b > 0) >= 0.5 * count(*) THEN round(sum(abs(a / sa - b / sb)) / 2, 6) END AS tvd, count(*) FILTER (a > 0) AS support_a, count(*) FILTER (b > 0) AS support_b,
 count(*) FILTER (a > 0 AND b > 0) AS common, CASE WHEN count(*) FILTER (a > 0 AND b > 0) >= 0.5 * count(*) THEN '' ELSE 'supports too different' END AS note FROM s GROUP BY 1""")
def _(t):
    d = t.customer.withColumn("k", COL("c_nationkey") % 5)
    a = A.composition(d.filter("c_nationkey < 10 AND NOT (c_nationkey % 5 = 3 AND c_mktsegment <> 'BUILDING')"), "c_mktsegment", keys=["k"])
    b = A.composition(d.filter("c_nationkey >= 10"), "c_mktsegment", keys=["k"])
    return r(D.tvd(a, b, "c_mktsegment", ["k"]), "tvd")


PROFILE = f"""WITH d AS (SELECT p_type, l_returnflag, l_linenumber, p_brand, CASE WHEN l_quantity > 25 THEN 'TOTAL' ELSE l_linestatus END AS st FROM {LP}),
c AS (SELECT 'l_returnflag' AS conditioner, l_returnflag AS value, p_type AS cat, count(*)::DOUBLE AS n FROM d GROUP BY ALL UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), p_type, count(*) FROM d GROUP BY ALL
 UNION ALL SELECT 'p_brand', p_brand, p_type, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'st', st, p_type, count(*) FROM d WHERE st <> 'TOTAL' GROUP BY ALL),
m AS (SELECT cat, n / sum(n) OVER () AS q FROM (SELECT p_type AS cat, count(*) AS n FROM d GROUP BY 1)),
v AS (SELECT DISTINCT conditioner, value FROM c), x AS (SELECT v.conditioner, v.value, m.cat, q, coalesce(n, 0) AS n FROM v CROSS JOIN m LEFT JOIN c ON c.conditioner = v.conditioner AND c.value = v.value AND c.cat = m.cat),
s AS (SELECT *, sum(n) OVER (PARTITION BY conditioner, value) AS t FROM x),
p AS (SELECT conditioner, value, sum(n) AS n, count(*) FILTER (n > 0) AS support, CASE WHEN count(*) FILTER (n > 0) >= 0.5 * count(*) THEN sum(abs(n / t - q)) / 2 END AS tvd, CASE WHEN count(*) FILTER (n > 0) >= 0.5 * count(*) THEN '' ELSE 'supports too different' END AS note FROM s GROUP BY ALL) """


def profile(t):
    d = lp(t).select("p_type", "l_returnflag", "l_linenumber", "p_brand", F.when(COL("l_quantity") > 25, "TOTAL").otherwise(COL("l_linestatus")).alias("st"))
    return D.conditional_profile(d, "p_type", ["l_returnflag", "l_linenumber", "p_brand", "st"])


@query("ds2_conditional_profile", PROFILE + "SELECT conditioner, value, n, support, round(tvd, 6) AS tvd, note FROM p")
def _(t):
    return r(profile(t), "tvd")


@query("ds3_conditioner_ranking", PROFILE + "SELECT conditioner, count(*) AS cells, round(min(tvd), 6) AS min, round(median(tvd), 6) AS median, round(max(tvd), 6) AS max, count(*) FILTER (tvd IS NULL) AS unmeasured FROM p GROUP BY 1")
def _(t):
    return r(D.conditioner_ranking(profile(t)), "min", "median", "max")


@query("ds4_independence_gap", f"""
WITH c AS (SELECT l_returnflag AS k, p_type AS x, p_size // 10 AS y, count(*)::DOUBLE AS c FROM {LP} GROUP BY ALL),
g AS (SELECT k, x, y, c, sum(c) OVER (PARTITION BY k, x) AS cx, sum(c) OVER (PARTITION BY k, y) AS cy, sum(c) OVER (PARTITION BY k) AS n FROM c)
SELECT k, round((sum(abs(c / n - cx * cy / n / n)) + greatest(1 - sum(cx * cy / n / n), 0)) / 2, 6) AS tvd, count(*) AS cells FROM g GROUP BY 1""")
def _(t):
    d = lp(t).select(COL("l_returnflag").alias("k"), COL("p_type").alias("x"), F.floor(COL("p_size") / 10).alias("y"))
    return r(D.independence_gap(d, "x", "y", ["k"]), "tvd")


def _subsets_sql():
    v = ["l_returnflag", "l_linestatus", "l_linenumber", "band"]
    parts = []
    for s in C.all_subsets(v, 3):
        k = ", ".join(s)
        parts.append(f"SELECT '{'*'.join(s)}' AS block, sum(abs(a / ta - b / tb)) / 2 AS tvd, count(*) AS cells FROM (SELECT count(*) FILTER (run = 'a') AS a, count(*) FILTER (run = 'b') AS b FROM d GROUP BY {k}), (SELECT count(*) FILTER (run = 'a') AS ta, count(*) FILTER (run = 'b') AS tb FROM d)")
    return ("WITH d AS (SELECT l_returnflag, l_linestatus, l_linenumber, CAST(floor(l_quantity / 10) AS BIGINT) AS band, CASE WHEN year(l_shipdate) < 1998 THEN 'a' ELSE 'b' END AS run FROM lineitem) "
            "SELECT block, round(tvd, 6) AS tvd, cells FROM (" + " UNION ALL ".join(parts) + ")")


@query("ds5_all_margins", _subsets_sql())
def _(t):
    d = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", F.floor(COL("l_quantity") / 10).alias("band"), F.when(F.year("l_shipdate") < 1998, "a").otherwise("b").alias("run"))
    return r(D.margin_distances(d, "run", "a", "b", ["l_returnflag", "l_linestatus", "l_linenumber", "band"], 3), "tvd")


PAIR = """WITH d AS (SELECT l_returnflag, l_linestatus, CASE WHEN year(l_shipdate) < 1998 THEN 'a' ELSE 'b' END AS run, CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS nul FROM lineitem),
m AS ({blocks}) SELECT block, round(tvd, 6) AS tvd, cells, round(nt, 6) AS null_tvd, round(tvd / nt, 3) AS ratio FROM m"""
PAIR = PAIR.format(blocks=" UNION ALL ".join(f"""SELECT '{'*'.join(s)}' AS block, sum(abs(a / ta - b / tb)) / 2 AS tvd, count(*) AS cells, sum(abs(na / nta - nb / ntb)) / 2 AS nt FROM (SELECT count(*) FILTER (run = 'a') AS a, count(*) FILTER (run = 'b') AS b, count(*) FILTER (nul = 'a') AS na,
 count(*) FILTER (nul = 'b') AS nb FROM d GROUP BY {', '.join(s)}), (SELECT count(*) FILTER (run = 'a') AS ta, count(*) FILTER (run = 'b') AS tb, count(*) FILTER (nul = 'a') AS nta, count(*) FILTER (nul = 'b') AS ntb FROM d)""" for s in C.all_subsets(["l_returnflag", "l_linestatus"], 2)))


@query("ds5_against_null_pair", PAIR)
def _(t):
    v = ["l_returnflag", "l_linestatus"]
    d = t.lineitem.select(*v, F.when(F.year("l_shipdate") < 1998, "a").otherwise("b").alias("run"), F.when(COL("l_partkey") % 2 == 0, "a").otherwise("b").alias("nul"))
    return r(r(D.against_null_pair(D.margin_distances(d, "run", "a", "b", v, 2), D.margin_distances(d, "nul", "a", "b", v, 2)), "tvd", "null_tvd"), "ratio", digits=3)


HOLD = """WITH d AS (SELECT l_returnflag || '|' || l_linenumber AS c, l_returnflag AS x, l_linenumber AS y, year(l_shipdate) AS yr FROM lineitem),
t AS (SELECT c, count(*)::DOUBLE / (SELECT count(*) FROM d) AS p FROM d GROUP BY 1), f AS (SELECT c, count(*)::DOUBLE / (SELECT count(*) FROM d WHERE yr < 2001) AS p FROM d WHERE yr < 2001 GROUP BY 1),
h AS (SELECT c, count(*)::DOUBLE / (SELECT count(*) FROM d WHERE yr = 1996) AS p FROM d WHERE yr = 1996 GROUP BY 1),
i AS (SELECT a.x || '|' || b.y AS c, a.p * b.p AS p FROM (SELECT x, count(*)::DOUBLE / (SELECT count(*) FROM d WHERE yr < 1997) AS p FROM d WHERE yr < 1997 GROUP BY 1) a, (SELECT y, count(*)::DOUBLE / (SELECT count(*) FROM d WHERE yr < 1997) AS p FROM d WHERE yr < 1997 GROUP BY 1) b),
z AS (SELECT (SELECT sum(abs(coalesce(t.p, 0) - coalesce(f.p, 0))) / 2 FROM t FULL JOIN f USING (c)) AS fl, (SELECT sum(abs(coalesce(t.p, 0) - coalesce(h.p, 0))) / 2 FROM t FULL JOIN h USING (c)) AS ho,
 (SELECT sum(abs(coalesce(t.p, 0) - coalesce(i.p, 0))) / 2 FROM t FULL JOIN i USING (c)) AS ind, (SELECT count(*) FROM t) AS cells)
SELECT cells, round(fl, 6) AS floor, round(ho, 6) AS holdout, round(ind, 6) AS independence, CASE WHEN ind > fl THEN round((ho - fl) / (ind - fl), 4) END AS position FROM z"""


@query("ds6_holdout_position", HOLD)
def _(t):
    d = t.lineitem.select(F.concat_ws("|", "l_returnflag", "l_linenumber").alias("c"), COL("l_returnflag").alias("x"), COL("l_linenumber").alias("y"), F.year("l_shipdate").alias("yr"))
    comp = lambda df: df.groupBy("c").agg(F.count("*").alias("w"))
    e = d.filter("yr < 1997")
    px, py = e.groupBy("x").agg(F.count("*").alias("wx")), e.groupBy("y").agg(F.count("*").alias("wy"))
    ind = (e.select("x", "y").distinct().join(px, "x").join(py, "y").select(F.concat_ws("|", "x", "y").alias("c"), (COL("wx") * COL("wy")).alias("w")))
    return r(r(D.holdout_position(comp(d), comp(d.filter("yr < 2001")), comp(d.filter("yr = 1996")), ind, "c"), "floor", "holdout", "independence"), "position", digits=4)


AUDIT = CUBE + """, n AS (SELECT count(*) * 1.0::DOUBLE AS big FROM lineitem WHERE year(l_shipdate) >= 1997), o AS (
 SELECT 'A' AS block, 'l_returnflag=' || l_returnflag || '|l_linestatus=' || l_linestatus AS key, count(*) AS n FROM lineitem WHERE year(l_shipdate) >= 1997 GROUP BY ALL
 UNION ALL SELECT 'B', 'l_returnflag=' || l_returnflag || '|l_linenumber=' || l_linenumber, count(*) FROM lineitem WHERE year(l_shipdate) >= 1997 GROUP BY ALL),
z AS (SELECT cube.block, cube.key AS cell, alpha, coalesce(o.n, 0) AS n, big, (coalesce(o.n, 0) - alpha * big) / sqrt(big * alpha * (1 - alpha)) AS z, abs(coalesce(o.n, 0) - alpha * big) / (alpha * big) AS re,
 sqrt((1 - alpha) / (alpha * big)) AS fl FROM cube LEFT JOIN o ON o.block = cube.block AND o.key = cube.key CROSS JOIN n) """.replace(", n AS (SELECT count(*) * 1.0", ", nn AS (SELECT count(*) * 1.0").replace("CROSS JOIN n)", "CROSS JOIN nn)")


def audit(t):
    late = t.lineitem.filter(F.year("l_shipdate") >= 1997)
    m = C.margins(late, [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linenumber"]])
    m = m.withColumn("block", F.when(COL("block") == "l_returnflag*l_linestatus", "A").otherwise("B"))
    return D.cell_audit(m, constraint_cube(t).select("block", COL("key").alias("cell"), "alpha"), late.agg(F.count("*").cast("double")).scalar())


@query("ds7_cell_audit", AUDIT + "SELECT block, cell, n, round(alpha * big, 4) AS expected, round(z, 5) AS z, round(re, 6) AS rel_error, round(fl, 6) AS floor, false AS violation FROM z")
def _(t):
    return r(r(r(audit(t).drop("alpha"), "expected", digits=4), "z", digits=5), "rel_error", "floor")


@query("ds7_audit_summary", AUDIT + "SELECT block, count(*) AS cells, round(avg(re), 6) AS mre, round(avg(fl), 6) AS floor, round(avg(abs(z)), 5) AS mean_abs_z, round(max(abs(z)), 5) AS max_abs_z, round(avg(CASE WHEN abs(z) > 3 THEN 1.0 ELSE 0.0 END), 6) AS share_above_3, 0::BIGINT AS violations FROM z GROUP BY 1")
def _(t):
    return r(r(D.audit_summary(audit(t)), "mean_abs_z", "max_abs_z", digits=5), "mre", "floor", "share_above_3")


MI = """SELECT round(sum(c / n * ln(c * n / (cg * ck))), 6) AS mi, round(sum(-c / n * ln(ck / n)), 6) AS entropy, count(DISTINCT g) AS groups, count(DISTINCT k) AS categories, max(n) AS n,
 round((count(DISTINCT g) - 1) * (count(DISTINCT k) - 1) / (2 * max(n)), 8) AS bias FROM (SELECT g, k, c, sum(c) OVER (PARTITION BY g) AS cg, sum(c) OVER (PARTITION BY k) AS ck, sum(c) OVER () AS n FROM c)"""


@query("ds8_mutual_information", "WITH c AS (SELECT c_nationkey AS g, c_mktsegment AS k, count(*)::DOUBLE AS c FROM customer GROUP BY ALL) " + MI)
def _(t):
    c = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("c"))
    return r(r(D.information(c, "c_nationkey", "c_mktsegment", "c"), "mi", "entropy"), "bias", digits=8)


UNIT = """WITH c AS (SELECT n_regionkey AS b, c_nationkey AS u, c_mktsegment AS k, count(*)::DOUBLE AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
kk AS (SELECT DISTINCT k FROM c), uu AS (SELECT DISTINCT b, u FROM c), f AS (SELECT uu.b, uu.u, kk.k, coalesce(c, 0) AS c FROM uu CROSS JOIN kk LEFT JOIN c ON c.b = uu.b AND c.u = uu.u AND c.k = kk.k),
g AS (SELECT *, sum(c) OVER (PARTITION BY b, u) AS n, sum(c) OVER (PARTITION BY b, k) AS gk, sum(c) OVER (PARTITION BY b) AS gn FROM f) """


def unit_cells(t):
    return cust(t).groupBy(COL("n_regionkey").alias("b"), COL("c_nationkey").alias("u"), COL("c_mktsegment").alias("k")).agg(F.count("*").alias("c"))


@query("ds9_unit_distances", UNIT + "SELECT b, u, n, round(sum(abs(c / n - gk / gn)) / 2, 6) AS tvd FROM g GROUP BY ALL HAVING n >= 50")
def _(t):
    return r(D.unit_distances(unit_cells(t), ["b"], "u", "k", "c", 50), "tvd")


@query("ds9_weighted_distance", UNIT + "SELECT b, round(sum(n * tvd) / sum(n), 6) AS mean_tvd, count(*) AS units FROM (SELECT b, u, n, sum(abs(c / n - gk / gn)) / 2 AS tvd FROM g GROUP BY ALL) GROUP BY 1")
def _(t):
    return r(D.weighted_distance(D.unit_distances(unit_cells(t), ["b"], "u", "k", "c"), ["b"]), "mean_tvd")


B = 20
MEMBERS = "m AS (SELECT n_regionkey AS b, c_nationkey AS u, c_mktsegment AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)"
CATS = """w AS MATERIALIZED (SELECT b, k, count(*) AS w FROM m GROUP BY ALL), cat AS MATERIALIZED (SELECT b, k, w, row_number() OVER (PARTITION BY b ORDER BY k) AS i FROM w),
un AS MATERIALIZED (SELECT b, u, count(*) AS n FROM m GROUP BY ALL)"""


def drawn_cells_sql(channel: str, categories: int) -> str:
    """``c(replicate, b, u, k, c)``: each unit's total drawn category by category from its base; needs ``m``."""
    parts = [CATS, f"s0 AS MATERIALIZED (SELECT r.r AS replicate, un.b, u, n AS rest, (SELECT sum(w) FROM w WHERE w.b = un.b)::BIGINT AS whole FROM un, range(1, {B + 1}) r(r))"]
    for i in range(1, categories + 1):
        parts.append(f"d{i} AS MATERIALIZED (SELECT replicate, s.b, u, rest AS n, w, whole AS t0, {draw_sql(channel, 'replicate', 's.b', 'u', 'k')} AS u0 FROM s{i - 1} s JOIN cat ON cat.b = s.b AND i = {i})")
        parts.append(f"x{i} AS MATERIALIZED ({binomial_sql(f'(SELECT replicate, b, u AS unit, n, w, t0, u0 AS u FROM d{i})', 'replicate, b, unit')})")
        parts.append(f"s{i} AS MATERIALIZED (SELECT s.replicate, s.b, s.u, rest - x AS rest, whole - w AS whole FROM s{i - 1} s JOIN x{i} x ON x.replicate = s.replicate AND x.b = s.b AND x.unit = s.u JOIN cat ON cat.b = s.b AND i = {i})")
    cells = " UNION ALL ".join(f"SELECT replicate, x.b, unit AS u, k, x::DOUBLE AS c FROM x{i} x JOIN cat ON cat.b = x.b AND i = {i} WHERE x > 0" for i in range(1, categories + 1))
    return ", ".join([*parts, f"c AS ({cells})"])


def permuted_cells_sql(channel: str, categories: int, height: int) -> str:
    """``c(replicate, b, u, k, c)``: labels dealt down a binary tree of units; needs ``m``."""
    parts = [CATS, f"rk AS MATERIALIZED (SELECT b, u, n, row_number() OVER (PARTITION BY b ORDER BY {draw_sql(channel + ' order', 'u')}, u) - 1 AS rank FROM un)",
             f"bl{height} AS MATERIALIZED (SELECT r.r AS replicate, b, 0 AS node, k, w AS n FROM w, range(1, {B + 1}) r(r))"]
    on = "{0}.replicate = s.replicate AND {0}.b = s.b AND {0}.node = s.node".format
    for h in range(height, 0, -1):
        parts.append(f"t{h}_0 AS MATERIALIZED (SELECT replicate, s.b, s.node, size, lft AS taken FROM (SELECT replicate, b, node, sum(n)::BIGINT AS size FROM bl{h} GROUP BY ALL) s "
                     f"JOIN (SELECT b, rank >> {h - 1} AS half, sum(n)::BIGINT AS lft FROM rk GROUP BY ALL) l ON l.b = s.b AND half = 2 * s.node)")
        kids = []
        for i in range(1, categories + 1):
            src = f"(SELECT s.replicate, s.b, s.node, size AS n, coalesce(e.n, 0) AS k, taken AS m, {draw_sql(channel, 's.replicate', 's.b', str(h), 's.node', 'cat.k')} AS u FROM t{h}_{i - 1} s JOIN cat ON cat.b = s.b AND i = {i} LEFT JOIN bl{h} e ON {on('e')} AND e.k = cat.k)"
            parts.append(f"y{h}_{i} AS MATERIALIZED ({hypergeometric_sql(src, 'replicate, b, node')})")
            parts.append(f"t{h}_{i} AS MATERIALIZED (SELECT s.replicate, s.b, s.node, size - coalesce(e.n, 0) AS size, taken - x AS taken FROM t{h}_{i - 1} s JOIN y{h}_{i} y ON {on('y')} JOIN cat ON cat.b = s.b AND i = {i} LEFT JOIN bl{h} e ON {on('e')} AND e.k = cat.k)")
            kids.append(f"SELECT s.replicate, s.b, unnest([2 * s.node, 2 * s.node + 1]) AS node, s.k, unnest([x, s.n - x]) AS n FROM bl{h} s JOIN cat ON cat.b = s.b AND cat.k = s.k AND i = {i} JOIN y{h}_{i} y ON {on('y')}")
        parts.append(f"bl{h - 1} AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(kids)}) WHERE n > 0)")
    return ", ".join([*parts, "c AS (SELECT replicate, e.b, u, k, e.n::DOUBLE AS c FROM bl0 e JOIN rk ON rk.b = e.b AND rank = node)"])


SEGMENTS = 5
DRAWN = f"WITH {MEMBERS}, {drawn_cells_sql('floor', SEGMENTS)}, "
PERM = f"WITH {MEMBERS}, {permuted_cells_sql('perm', SEGMENTS, 3)}, "
TAIL = """kk AS (SELECT DISTINCT k FROM m), uu AS (SELECT DISTINCT replicate, b, u FROM c), f AS (SELECT uu.replicate, uu.b, uu.u, kk.k, coalesce(c, 0) AS c FROM uu CROSS JOIN kk LEFT JOIN c ON c.replicate = uu.replicate AND c.b = uu.b AND c.u = uu.u AND c.k = kk.k),
q AS (SELECT b, k, w / sum(w) OVER (PARTITION BY b) AS q FROM w), g AS (SELECT f.*, q, sum(c) OVER (PARTITION BY replicate, f.b, u) AS n FROM f JOIN q ON q.b = f.b AND q.k = f.k),
s AS (SELECT replicate, sum(n * tvd) / sum(n) AS mean_tvd FROM (SELECT replicate, b, u, n, sum(abs(c / n - q)) / 2 AS tvd FROM g GROUP BY ALL) GROUP BY 1) """


def against_base(observed, cells):
    """Mean distance per replicate, each unit against the real base composition."""
    comp = A.with_totals(observed.groupBy("b", "k").agg(F.sum("c").alias("w")), ["b"], {"t": F.sum("w")})
    c = A.with_totals(cells, ["replicate", "b", "u"], {"nn": F.sum("n")}).join(comp, ["b", "k"])
    q = COL("w") / COL("t")
    u = c.groupBy("replicate", "b", "u").agg(F.max("nn").alias("n"), ((F.sum(F.abs(COL("n") / COL("nn") - q)) + F.greatest(1 - F.sum(q), F.lit(0.0))) / 2).alias("tvd"))
    return D.weighted_distance(u, ["replicate"]).drop("units")


@query("ds10_multinomial_floor", DRAWN + TAIL + "SELECT round(avg(mean_tvd), 6) AS mean, round(quantile_cont(mean_tvd, 0.95), 6) AS p95 FROM s")
def _(t):
    c = unit_cells(t)
    s = against_base(c, N.drawn_cells(c, ["b"], "u", "k", "c", B))
    return r(D.against_null(F.lit(0.0), s, "mean_tvd").select("mean", "p95"), "mean", "p95")


OBS = "(SELECT sum(n * tvd) / sum(n) FROM (SELECT b, u, sum(c) AS n, sum(abs(c / n - q)) / 2 AS tvd FROM (SELECT uu.b, uu.u, q.k, q.q, coalesce(o.c, 0) AS c, sum(coalesce(o.c, 0)) OVER (PARTITION BY uu.b, uu.u) AS n FROM (SELECT DISTINCT b, u FROM m) uu JOIN q ON q.b = uu.b LEFT JOIN (SELECT b, u, k, count(*)::DOUBLE AS c FROM m GROUP BY ALL) o ON o.b = uu.b AND o.u = uu.u AND o.k = q.k) GROUP BY b, u))"


@query("ds11_permutation_null", PERM + TAIL + f", o AS (SELECT {OBS} AS o) SELECT round(max(o), 6) AS observed, round(avg(mean_tvd), 6) AS mean, round(stddev_samp(mean_tvd), 6) AS sd, count(*) AS replicates, round(median(mean_tvd), 6) AS median, round(quantile_cont(mean_tvd, 0.95), 6) AS p95, round(max(o) - median(mean_tvd), 6) AS excess, round((max(o) - avg(mean_tvd)) / stddev_samp(mean_tvd), 3) AS z, (1 + count(*) FILTER (mean_tvd >= o)) / (1 + count(*))::DOUBLE AS p FROM s, o")
def _(t):
    c = unit_cells(t)
    s = against_base(c, N.permuted_cells(c, ["b"], "u", "k", "c", B))
    obs = D.weighted_distance(D.unit_distances(c, ["b"], "u", "k", "c")).select("mean_tvd").scalar()
    return r(r(D.against_null(obs, s, "mean_tvd"), "z", digits=3), "observed", "mean", "sd", "median", "p95", "excess")


@query("ds12_leave_one_out", UNIT + "SELECT b, u, n, round(sum(abs(c / n - (gk - c) / (gn - n))) / 2, 6) AS tvd FROM g GROUP BY b, u, n")
def _(t):
    return r(D.unit_distances(unit_cells(t), ["b"], "u", "k", "c", leave_out=True), "tvd")


LOO = "(SELECT {0} sum(n * tvd) / sum(n) AS d FROM (SELECT {0} b, u, n, sum(abs(c / n - (gk - c) / (gn - n))) / 2 AS tvd FROM (SELECT *, sum(c) OVER (PARTITION BY {0} b, u) AS n, sum(c) OVER (PARTITION BY {0} b, k) AS gk, sum(c) OVER (PARTITION BY {0} b) AS gn FROM (SELECT {1}.*, cat.k, coalesce(e.c, 0) AS c FROM {1} JOIN cat ON cat.b = {1}.b LEFT JOIN {2} e ON {3} e.b = {1}.b AND e.u = {1}.u AND e.k = cat.k)) GROUP BY ALL) {4})".format


@query("ds12_floor", f"WITH {MEMBERS}, {drawn_cells_sql('loo', SEGMENTS)}, uu AS (SELECT DISTINCT replicate, b, u FROM c), ou AS (SELECT b, u FROM un), oc AS (SELECT b, u, k, count(*)::DOUBLE AS c FROM m GROUP BY ALL), "
       f"f AS {LOO('replicate,', 'uu', 'c', 'e.replicate = uu.replicate AND', 'GROUP BY replicate')}, o AS {LOO('', 'ou', 'oc', '', '')} "
       "SELECT round(max(o.d), 6) AS observed, round(avg(f.d), 6) AS mean, round(quantile_cont(f.d, 0.95), 6) AS p95, count(*) AS replicates, round(greatest(max(o.d) - quantile_cont(f.d, 0.95), 0), 6) AS net FROM f, o")
def _(t):
    c = cut_lineage(unit_cells(t))
    obs = D.weighted_distance(D.unit_distances(c, ["b"], "u", "k", "c", leave_out=True)).select("mean_tvd").scalar()
    s = D.against_null(obs, N.leave_one_out_floor(c, ["b"], "u", "k", "c", B), "mean_tvd").select("observed", "mean", "p95", "replicates")
    return r(s.withColumn("net", F.greatest(COL("observed") - COL("p95"), F.lit(0.0))), "observed", "mean", "p95", "net")


PLACEBO = f"""WITH u AS (SELECT l_suppkey AS u, l_suppkey % 2 AS z, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*)::DOUBLE AS share, {draw_sql('placebo', 'l_suppkey')} AS x FROM lineitem GROUP BY 1),
s AS (SELECT u, z, 'real' AS kind, row_number() OVER (PARTITION BY z ORDER BY share, u) AS r, count(*) OVER (PARTITION BY z) AS m FROM u UNION ALL SELECT u, z, 'size', row_number() OVER (PARTITION BY z ORDER BY n, u), count(*) OVER (PARTITION BY z) FROM u
 UNION ALL SELECT u, z, 'random', row_number() OVER (PARTITION BY z ORDER BY x, u), count(*) OVER (PARTITION BY z) FROM u),
st AS (SELECT u, z, kind, CAST(greatest(1, ceil(3 * (r - 1) / (m - 1))) AS INT) AS s FROM s UNION ALL SELECT u, z, 'none', 1 FROM u),
c AS (SELECT l_suppkey AS u, l_returnflag AS k, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL), f AS (SELECT kind, z, s, st.u, kk.k, coalesce(c, 0) AS c FROM st CROSS JOIN (SELECT DISTINCT k FROM c) kk LEFT JOIN c ON c.u = st.u AND c.k = kk.k),
g AS (SELECT *, sum(c) OVER (PARTITION BY kind, z, s, u) AS n, sum(c) OVER (PARTITION BY kind, z, s, k) AS gk, sum(c) OVER (PARTITION BY kind, z, s) AS gn FROM f)
SELECT kind, round(sum(n * tvd) / sum(n), 6) AS mean_tvd, count(*) AS units FROM (SELECT kind, z, s, u, n, sum(abs(c / n - gk / gn)) / 2 AS tvd FROM g GROUP BY kind, z, s, u, n) GROUP BY 1"""


@query("ds13_stratification_placebo", PLACEBO)
def _(t):
    from popweave.functions.draws import draw
    u = (t.lineitem.groupBy(COL("l_suppkey").alias("u")).agg(F.count("*").alias("n"), (F.sum(F.when(COL("l_returnflag") == "R", 1).otherwise(0)) / F.count("*").cast("double")).alias("share"))
         .withColumn("z", COL("u") % 2).withColumn("x", draw("placebo", "u")))
    st = None
    for kind, v in (("real", "share"), ("size", "n"), ("random", "x")):
        s = X.terciles(u, ["z"], v, "u").select("u", "z", F.lit(kind).alias("kind"), COL("tercile").alias("s"))
        st = s if st is None else st.unionByName(s)
    st = st.unionByName(u.select("u", "z", F.lit("none").alias("kind"), F.lit(1).alias("s")))
    c = t.lineitem.groupBy(COL("l_suppkey").alias("u"), COL("l_returnflag").alias("k")).agg(F.count("*").alias("c"))
    d = D.unit_distances(c.join(st, "u"), ["z", "s"], "u", "k", "c", extra=["kind"])
    return r(D.weighted_distance(d, ["kind"]), "mean_tvd")


@query("ds14_section_ceiling", f"""
WITH m AS (SELECT 0 AS b, l_suppkey AS u, l_returnflag AS k FROM lineitem), {permuted_cells_sql('perm', 3, 10).replace(", c AS (", ", pc AS (")},
c AS (SELECT replicate, u, u % 5 AS z, k, c FROM pc UNION ALL SELECT 0, u, u % 5, k, count(*)::DOUBLE FROM m GROUP BY ALL),
su AS (SELECT replicate, sum(c / n * ln(c * n / (cg * ck))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY replicate, u) AS cg, sum(c) OVER (PARTITION BY replicate, k) AS ck, sum(c) OVER (PARTITION BY replicate) AS n FROM c) GROUP BY 1),
cz AS (SELECT replicate, z, k, sum(c) AS c FROM c GROUP BY ALL),
sz AS (SELECT replicate, sum(c / n * ln(c * n / (cg * ck))) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY replicate, z) AS cg, sum(c) OVER (PARTITION BY replicate, k) AS ck, sum(c) OVER (PARTITION BY replicate) AS n FROM cz) GROUP BY 1),
e AS (SELECT (SELECT mi FROM su WHERE replicate = 0) - (SELECT median(mi) FROM su WHERE replicate > 0) AS section_net, (SELECT mi FROM sz WHERE replicate = 0) - (SELECT median(mi) FROM sz WHERE replicate > 0) AS zone_net)
SELECT round(section_net, 6) AS section_net, round(zone_net, 6) AS zone_net, round(zone_net / section_net, 3) AS kept FROM e""")
def _(t):
    m = cut_lineage(t.lineitem.groupBy(COL("l_suppkey").alias("u"), COL("l_returnflag").alias("k")).agg(F.count("*").alias("n")))
    perm = N.permuted_cells(m, [], "u", "k", "n", B)
    cells = cut_lineage(perm.unionByName(m.withColumn("replicate", F.lit(0))).withColumn("z", COL("u") % 5))
    def net(level):
        mi = cut_lineage(D.information(cells, level, "k", "n", ["replicate"]).select("replicate", "mi"))
        med = X.quantiles(mi.filter("replicate > 0"), [], "mi", {"m": 0.5})
        return mi.filter("replicate = 0").select("mi").scalar() - med.scalar()
    out = t.region.agg(F.count("*").alias("one")).select(net("u").alias("section_net"), net("z").alias("zone_net"))
    return r(r(out.withColumn("kept", COL("zone_net") / COL("section_net")), "kept", digits=3), "section_net", "zone_net")


@query("ds15_share_correlation", """
WITH u AS (SELECT l_suppkey, count(*)::DOUBLE AS w, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*)::DOUBLE AS a, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END), 0)::DOUBLE AS b FROM lineitem GROUP BY 1),
m AS (SELECT sum(w) AS sw, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM u), q AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM u)
SELECT count(*) AS units, round(sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) ** 2) * sum(w * (b - mb) ** 2)), 5) AS pearson, round((SELECT corr(ra, rb) FROM q), 6) AS spearman FROM u, m""")
def _(t):
    s = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    u = t.lineitem.groupBy("l_suppkey").agg(F.count("*").cast("double").alias("w"), (s(COL("l_returnflag") == "R") / F.count("*")).alias("a"),
                                            (s(COL("l_linestatus") == "O") / F.nullif(s(COL("l_linenumber") > 1), F.lit(0.0))).alias("b"))
    return r(r(D.weighted_correlation(u, "a", "b", "w").withColumn("spearman", X.spearman(u, [], "a", "b").select("rho").scalar()), "pearson", digits=5), "spearman")


@query("ds16_denominators", """
SELECT l_suppkey % 7 AS k, sum(l_quantity) AS a, sum(l_linenumber * 6.375::DOUBLE) AS b, round(sum(l_quantity) / sum(l_linenumber * 6.375::DOUBLE), 6) AS ratio, abs(sum(l_quantity) / sum(l_linenumber * 6.375::DOUBLE) - 1) <= 0.02 AS ok FROM lineitem GROUP BY 1""")
def _(t):
    d = t.lineitem.select((COL("l_suppkey") % 7).alias("k"), COL("l_quantity").alias("qa"), (COL("l_linenumber") * 6.375).alias("qb"))
    return r(D.denominators_agree(d, ["k"], "qa", "qb"), "ratio")


@query("ds17_age_against_register", """
WITH c AS (SELECT l_returnflag AS s, CAST(l_quantity AS INT) AS a, CAST(l_quantity AS INT) // 5 AS b, count(*) FILTER (year(l_shipdate) >= 1998)::DOUBLE AS t, count(*) FILTER (year(l_shipdate) < 1998)::DOUBLE AS r FROM lineitem GROUP BY ALL),
x AS (SELECT *, t / sum(t) OVER () AS pt, r / sum(r) OVER () AS pa, sum(t) OVER () AS n FROM c), y AS (SELECT *, sum(pt) OVER (PARTITION BY s, b) AS bt, sum(pa) OVER (PARTITION BY s, b) AS ba FROM x)
SELECT max(n) AS n, round(sum(abs(pa - pt)) / 2, 6) AS tvd, round(sum(abs(pt - bt * pa / ba)) / 2, 6) AS within, round(min(t / r) FILTER (r >= 50), 6) AS ratio_min, round(max(t / r) FILTER (r >= 50), 6) AS ratio_max,
 round((SELECT sum(abs(ba - bt)) / 2 FROM (SELECT DISTINCT s, b, ba, bt FROM y)), 6) AS between FROM y""")
def _(t):
    late = F.year("l_shipdate") >= 1998
    c = t.lineitem.groupBy(COL("l_returnflag").alias("s"), COL("l_quantity").cast("int").alias("a")).agg(
        F.sum(F.when(late, 1).otherwise(0)).cast("double").alias("t"), F.sum(F.when(late, 0).otherwise(1)).cast("double").alias("r")).withColumn("b", F.floor(COL("a") / 5))
    return r(D.age_against_register(c, "s", "a", "b", "t", "r"), "tvd", "within", "ratio_min", "ratio_max", "between")


@query("ds18_drift", """
WITH d AS (SELECT o_custkey % 10 AS place, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'mid' ELSE 'low' END AS c, year(o_orderdate) AS y FROM orders),
p AS (SELECT place, c, count(*) FILTER (y = 1996)::DOUBLE AS a, count(*) FILTER (y = 2000)::DOUBLE AS b FROM d GROUP BY ALL), s AS (SELECT *, sum(a) OVER (PARTITION BY place) AS ta, sum(b) OVER (PARTITION BY place) AS tb FROM p),
rg AS (SELECT c, b / sum(b) OVER () AS q FROM (SELECT c, sum(b) AS b FROM p GROUP BY 1))
SELECT s.place, round(sum(abs(a / ta - b / tb)) / 2, 6) AS over_time, round(sum(abs(b / tb - q)) / 2, 6) AS against_region FROM s JOIN rg ON rg.c = s.c GROUP BY 1""")
def _(t):
    c = F.when(COL("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(COL("o_orderpriority") == "3-MEDIUM", "mid").otherwise("low")
    d = t.orders.select((COL("o_custkey") % 10).alias("place"), c.alias("c"), F.year("o_orderdate").alias("y"))
    comp = lambda y: d.filter(COL("y") == y).groupBy("place", "c").agg(F.count("*").alias("w"))
    time = D.tvd(comp(1996), comp(2000), "c", ["place"]).select("place", COL("tvd").alias("over_time"))
    space = D.unit_distances(comp(2000), [], "place", "c", "w").select("place", COL("tvd").alias("against_region"))
    return r(time.join(space, "place"), "over_time", "against_region")


@query("ds19_age_exchangeability", """
WITH d AS (SELECT CASE WHEN l_quantity <= 24 THEN 'young' ELSE 'old' END AS bin, l_returnflag || l_linestatus AS grp, CAST(l_quantity AS INT) AS age, count(*)::DOUBLE AS c FROM lineitem GROUP BY ALL),
g AS (SELECT *, sum(c) OVER (PARTITION BY bin, grp) AS n, sum(c) OVER (PARTITION BY bin, age) AS gk, sum(c) OVER (PARTITION BY bin) AS gn FROM d)
SELECT bin, round(sum(n * tvd) / sum(n), 6) AS mean_tvd, count(*) AS units FROM (SELECT bin, grp, n, sum(abs(c / n - gk / gn)) / 2 AS tvd FROM g GROUP BY ALL HAVING n >= 200) GROUP BY 1""")
def _(t):
    c = t.lineitem.groupBy(F.when(COL("l_quantity") <= 24, "young").otherwise("old").alias("bin"), F.concat("l_returnflag", "l_linestatus").alias("grp"),
                           COL("l_quantity").cast("int").alias("age")).agg(F.count("*").alias("c"))
    return r(D.weighted_distance(D.unit_distances(c, ["bin"], "grp", "age", "c", 200), ["bin"]), "mean_tvd")


@query("ds20_snapshot_change", """
WITH s AS (SELECT o_custkey AS id, year(o_orderdate) < 1998 AS early, max(o_orderstatus) AS st, min(o_orderpriority) AS pr FROM orders GROUP BY ALL), j AS (SELECT a.st AS a1, b.st AS b1, a.pr AS a2, b.pr AS b2 FROM s a JOIN s b ON a.id = b.id AND a.early AND NOT b.early),
c AS (SELECT 'st' AS variable, a1 AS o, b1 AS n, count(*)::DOUBLE AS c FROM j GROUP BY ALL UNION ALL SELECT 'pr', a2, b2, count(*) FROM j GROUP BY ALL), x AS (SELECT *, sum(c) OVER (PARTITION BY variable, o) AS co, sum(c) OVER (PARTITION BY variable) AS t FROM c)
SELECT variable, round(sum(CASE WHEN o <> n THEN c ELSE 0 END) / max(t), 6) AS changed, round(-sum(c / t * ln(c / co)), 6) AS conditional_entropy, CAST(max(t) AS BIGINT) AS ids FROM x GROUP BY 1""")
def _(t):
    snap = lambda c: t.orders.filter(c).groupBy(COL("o_custkey").alias("id")).agg(F.max("o_orderstatus").alias("st"), F.min("o_orderpriority").alias("pr"))
    y = F.year("o_orderdate")
    return r(D.snapshot_change(snap(y < 1998), snap(y >= 1998), "id", ["st", "pr"]), "changed", "conditional_entropy")
