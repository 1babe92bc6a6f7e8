"""Compositions, blocks, the cube and weighted statistics."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.join_queries import BAND_SQL, band_table
from popweave.operators import aggregates as A, cube as C
from popweave.plans.ranking import quantiles

COL = F.col


def cust(t):
    return t.customer.join(t.nation, COL("c_nationkey") == COL("n_nationkey"))


CUST = "customer JOIN nation ON c_nationkey = n_nationkey"


@query("ag1_composition", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS w FROM customer WHERE c_nationkey IN (1, 2, 3, 4) GROUP BY 1 HAVING sum(c_acctbal) > 0")
def _(t):
    return r(A.composition(t.customer, "c_mktsegment", "c_acctbal", {"c_nationkey": [1, 2, 3, 4]}), "w", digits=2)


@query("ag2_conditional_rescale", f"""
WITH g AS (SELECT n_regionkey AS k, c_mktsegment AS a, count(*) AS v FROM {CUST} GROUP BY ALL), tot AS (SELECT s_nationkey % 5 AS k, sum(s_acctbal) AS total FROM supplier GROUP BY 1)
SELECT g.k, a, round(v / sum(v) OVER (PARTITION BY g.k)::DOUBLE * total, 4) AS count FROM g JOIN tot USING (k)""")
def _(t):
    c = cust(t).select(COL("n_regionkey").alias("k"), COL("c_mktsegment").alias("a"), F.lit(1).alias("v"))
    g = t.supplier.groupBy((COL("s_nationkey") % 5).alias("k")).agg(F.sum("s_acctbal").alias("total"))
    return r(A.conditional_rescale(g, c, ["k"], "a", "v"), "count", digits=4)


@query("ag3_rounding_residual", """
WITH d AS (SELECT l_suppkey AS k, l_returnflag AS a, l_quantity AS v FROM lineitem), s AS (SELECT k, sum(v) AS parts, sum(v) + k % 3 - 1 AS published FROM d GROUP BY 1)
SELECT k, parts, published, published - parts AS residual, round((SELECT stddev_samp(published - parts) FROM s), 6) AS sigma FROM s""")
def _(t):
    d = t.lineitem.groupBy(COL("l_suppkey").alias("k"), COL("l_returnflag").alias("a")).agg(F.sum("l_quantity").alias("v"))
    tot = d.groupBy("k").agg((F.sum("v") + COL("k") % 3 - 1).alias("v")).withColumn("a", F.lit("TOTAL"))
    res = A.rounding_residual(d.unionByName(tot), ["k"], "a", "TOTAL", "v")
    return res.withColumn("sigma", res.agg(F.round(F.stddev_samp("residual"), 6)).scalar())


BLOCK = """SELECT l_returnflag AS sex, {band} AS age, CASE l_linestatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS marital, sum(l_extendedprice) AS v
 FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY ALL"""
BAND_CASE = "CASE WHEN l_quantity <= 8 THEN '0-8' WHEN l_quantity <= 14 THEN '9-14' WHEN l_quantity <= 24 THEN '15-24' WHEN l_quantity <= 34 THEN '25-34' WHEN l_quantity <= 49 THEN '35-49' ELSE '50-64' END"


def block(t, groups=None):
    from popweave.functions.scalars import band_of, mapped
    return A.demographic_block(t.lineitem, F.year("l_shipdate") == 1998, {"sex": COL("l_returnflag"), "age": band_of("l_quantity"),
                               "marital": mapped("l_linestatus", {"O": "open", "F": "done"})}, COL("l_extendedprice"), groups, "marital")


@query("ag4_demographic_block", BLOCK.format(band=BAND_CASE).replace("sum(l_extendedprice) AS v", "round(sum(l_extendedprice), 2) AS count"))
def _(t):
    return r(block(t), "count", digits=2)


@query("ag4_rescaled_block", f"""
WITH b AS ({BLOCK.format(band=BAND_CASE)}), g AS (SELECT l_returnflag AS sex, {BAND_CASE} AS age, count(*) AS total FROM lineitem GROUP BY ALL)
SELECT sex, age, marital, round(v / sum(v) OVER (PARTITION BY sex, age) * total, 4) AS count FROM b JOIN g USING (sex, age)""")
def _(t):
    from popweave.functions.scalars import band_of
    g = t.lineitem.groupBy(COL("l_returnflag").alias("sex"), band_of("l_quantity").alias("age")).agg(F.count("*").alias("total"))
    return r(block(t, g), "count", digits=4)


@query("ag5_harmonise", """
WITH b AS (SELECT l_returnflag AS k, l_linestatus AS a, sum(l_quantity) AS count FROM lineitem GROUP BY ALL), g AS (SELECT l_returnflag AS k, count(*) * 30.0::DOUBLE AS target FROM lineitem GROUP BY 1),
f AS (SELECT k, target / s AS factor FROM (SELECT k, sum(count) AS s FROM b GROUP BY 1) JOIN g USING (k))
SELECT k, a, round(count * factor, 4) AS count, round(factor, 6) AS factor, round((SELECT max(abs(factor - 1)) FROM f), 6) AS largest FROM b JOIN f USING (k)""")
def _(t):
    b = t.lineitem.groupBy(COL("l_returnflag").alias("k"), COL("l_linestatus").alias("a")).agg(F.sum("l_quantity").alias("count"))
    g = t.lineitem.groupBy(COL("l_returnflag").alias("k")).agg((F.count("*") * 30.0).alias("target"))
    h = A.harmonise(b, g, ["k"])
    return r(r(h.withColumn("largest", h.agg(F.max(F.abs(COL("factor") - 1))).scalar()), "count", digits=4), "factor", "largest")


@query("ag6_difference_category", """
WITH g AS (SELECT o_orderpriority AS k, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS tot, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS itl FROM orders GROUP BY 1)
SELECT k, 'O' AS a, round(itl, 2) AS v FROM g UNION ALL SELECT k, 'FRG', round(greatest(tot - itl, 0), 2) FROM g""")
def _(t):
    d = t.orders.select(COL("o_orderpriority").alias("k"), COL("o_orderstatus").alias("a"), COL("o_totalprice").alias("v"))
    return r(A.difference_category(d, ["k"], "a", "F", "O", "FRG", "v"), "v", digits=2)


@query("ag7_country_shares", """
WITH g AS (SELECT n_name AS country, sum(s_acctbal) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT regexp_matches(n_name, '_(1|7)$') GROUP BY 1 HAVING sum(s_acctbal) > 0)
SELECT country, round(n, 2) AS n, round(n / sum(n) OVER (), 6) AS share FROM g""")
def _(t):
    d = t.supplier.join(t.nation, COL("s_nationkey") == COL("n_nationkey")).select(COL("n_name").alias("country"), "s_acctbal")
    return r(r(A.country_shares(d, "country", "s_acctbal", "_(1|7)$"), "n", digits=2), "share")


@query("ag8_zone_table", """
WITH z AS (SELECT s_nationkey AS zone, sum(l_quantity) AS q, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS ret, sum(l_linenumber)::DOUBLE AS num FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
SELECT zone, 'returned' AS category, ret AS count FROM z UNION ALL SELECT zone, 'kept', greatest(q - ret, 0) FROM z UNION ALL SELECT zone, 'number', num FROM z""")
def _(t):
    d = t.lineitem.join(t.supplier, COL("l_suppkey") == COL("s_suppkey"))
    return A.zone_table(d.withColumnRenamed("s_nationkey", "zone"), "zone", {"all": COL("l_quantity"), "returned": F.when(COL("l_returnflag") == "R", COL("l_quantity")).otherwise(0.0),
                        "number": COL("l_linenumber").cast("double")}, ("kept", "all", "returned"))


@query("ag9_zone_shares", "SELECT c_mktsegment, c_nationkey, round(n / sum(n) OVER (PARTITION BY c_mktsegment)::DOUBLE, 6) AS share FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)")
def _(t):
    return r(A.zone_shares(t.customer.withColumn("one", F.lit(1)), ["c_mktsegment"], "c_nationkey", "one"), "share")


@query("ag10_expand_shares", f"""
WITH s AS (SELECT band, zone, n / sum(n) OVER (PARTITION BY band)::DOUBLE AS share FROM (SELECT band, l_returnflag AS zone, count(*) AS n FROM lineitem JOIN {BAND_SQL} ON l_quantity BETWEEN lo AND hi WHERE l_quantity <= 34 GROUP BY ALL)),
c AS (SELECT CAST(l_quantity AS INT) AS age, band, sum(l_tax) AS n FROM lineitem JOIN {BAND_SQL} ON l_quantity BETWEEN lo AND hi GROUP BY ALL)
SELECT age, zone, share IS NULL AS missing, round(share * n, 4) AS n FROM c LEFT JOIN s USING (band)""")
def _(t):
    from popweave.plans.intervals import range_lookup
    d = range_lookup(t.lineitem, "l_quantity", band_table(t), "lo", "hi")
    s = A.zone_shares(d.filter("l_quantity <= 34").select("band", COL("l_returnflag").alias("zone"), F.lit(1).alias("one")), ["band"], "zone", "one")
    c = d.groupBy(COL("l_quantity").cast("int").alias("age"), "band").agg(F.sum("l_tax").alias("n"))
    return r(A.expand_shares(c, s, ["band"], "n").select("age", "zone", "missing", "n"), "n", digits=4)


@query("ag11_rebin", f"SELECT l_returnflag, band, sum(l_linenumber)::BIGINT AS v FROM lineitem JOIN {BAND_SQL} ON l_quantity BETWEEN lo AND hi GROUP BY ALL")
def _(t):
    return A.rebin(t.lineitem.withColumn("v", COL("l_linenumber").cast("bigint")), "l_quantity", band_table(t), ["l_returnflag"], "v")


CAPPED = """WITH g AS (SELECT c_mktsegment AS k, c_nationkey AS z, sum(CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 1 END) AS w, count(*)::DOUBLE AS cap FROM customer GROUP BY ALL),
c AS (SELECT k, z, w / sum(w) OVER (PARTITION BY k)::DOUBLE AS share, cap, 0.85::DOUBLE * sum(cap) OVER (PARTITION BY k) AS target FROM g),
r0 AS (SELECT *, share * target AS v FROM c)"""


def _capped_sql(rounds=30):
    s = CAPPED
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        s += f""", r{i} AS (SELECT k, z, share, cap, target, CASE WHEN v > cap THEN cap ELSE v + CASE WHEN sum(CASE WHEN v <= cap THEN v ELSE 0 END) OVER (PARTITION BY k) > 0
 THEN sum(CASE WHEN v > cap THEN v - cap ELSE 0 END) OVER (PARTITION BY k) * v / sum(CASE WHEN v <= cap THEN v ELSE 0 END) OVER (PARTITION BY k) ELSE 0 END END AS v FROM {p})"""
    return s + f" SELECT k, z, round(v, 5) AS value FROM r{rounds}"


@query("ag12_capped_redistribution", _capped_sql(20))
def _(t):
    g = t.customer.groupBy(COL("c_mktsegment").alias("k"), COL("c_nationkey").alias("z")).agg(
        F.sum(F.when(COL("c_custkey") % 4 == 0, 3).otherwise(1)).alias("w"), F.count("*").cast("double").alias("cap"))
    c = A.with_totals(g, ["k"], {"tw": F.sum("w"), "tc": F.sum("cap")})
    c = c.select("k", "z", (COL("w") / COL("tw").cast("double")).alias("share"), "cap", (COL("tc") * 0.85).alias("target"))
    return r(A.capped_redistribution(c, ["k"], "z").select("k", "z", "value"), "value", digits=5)


@query("ag13_structural_fill", """
SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'none' ELSE CASE WHEN l_quantity <= 8 THEN 'kid' ELSE 'adult' END END AS age,
 sum(l_quantity) AS v FROM lineitem GROUP BY ALL""")
def _(t):
    d = t.lineitem.groupBy("l_returnflag", "l_linestatus", F.when(COL("l_quantity") <= 8, "kid").otherwise("adult").alias("age")).agg(F.sum("l_quantity").alias("v"))
    return C.structural_fill(d, ["l_returnflag", "l_linestatus", "age"], "v", [(COL("l_returnflag") == "R", {"age": "none"})])


@query("ag14_exclusion_cells", """
WITH p AS (SELECT a, b FROM (VALUES ('BUILDING'), ('MACHINERY'), ('FURNITURE')) x(a), (VALUES (1), (2), (99)) y(b) WHERE NOT (a = 'FURNITURE' AND b <> 99))
SELECT a AS c_mktsegment, b AS c_nationkey, 0.0::DOUBLE AS alpha FROM p WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = a AND c_nationkey = b AND c_acctbal > 5000)""")
def _(t):
    return C.exclusion_cells(t.region, "c_mktsegment", "c_nationkey", [(["BUILDING", "MACHINERY"], [1, 2, 99]), (["FURNITURE"], [99])], t.customer.filter("c_acctbal > 5000"))


CUBE = """WITH n AS (SELECT count(*)::DOUBLE AS n FROM lineitem), b1 AS (SELECT 'l_returnflag=' || l_returnflag || '|l_linestatus=' || l_linestatus AS key, count(*) AS c FROM lineitem GROUP BY 1),
b2 AS (SELECT 'l_returnflag=' || l_returnflag || '|l_linenumber=' || l_linenumber AS key, sum(CASE WHEN l_quantity > 10 OR l_linenumber > 2 THEN 1 ELSE 0 END) AS c FROM lineitem GROUP BY 1),
cube AS (SELECT 'A' AS block, key, c / n.n AS alpha FROM b1, n UNION ALL SELECT 'B', key, c / n.n FROM b2, n) """


def constraint_cube(t):
    one = F.lit(1)
    n = t.lineitem.agg(F.count("*").cast("double")).scalar()
    a = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("c"))
    b = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.sum(F.when((COL("l_quantity") > 10) | (COL("l_linenumber") > 2), one).otherwise(0)).alias("c"))
    return C.constraint_cube([("A", a, ["l_returnflag", "l_linestatus"], "c"), ("B", b, ["l_returnflag", "l_linenumber"], "c")], n)


@query("ag15_constraint_cube", CUBE + "SELECT block, key, round(alpha, 8) AS alpha, CASE block WHEN 'A' THEN 'l_returnflag,l_linestatus' ELSE 'l_returnflag,l_linenumber' END AS attrs FROM cube")
def _(t):
    return r(constraint_cube(t).select("block", "key", "alpha", F.array_join("attrs", ",").alias("attrs")), "alpha", digits=8)


@query("ag16_multi_margin_counts", """
WITH d AS (SELECT l_returnflag, l_linestatus, l_linenumber, CAST(l_discount * 100 AS INT) AS disc FROM (SELECT *, round(l_discount, 2) FROM lineitem))
SELECT 'l_returnflag' AS block, 'l_returnflag=' || l_returnflag AS cell, count(*) AS n FROM d GROUP BY ALL
UNION ALL SELECT 'l_linestatus*l_linenumber', 'l_linestatus=' || l_linestatus || '|l_linenumber=' || l_linenumber, count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'l_returnflag*l_linestatus*disc', 'l_returnflag=' || l_returnflag || '|l_linestatus=' || l_linestatus || '|disc=' || disc, count(*) FROM d GROUP BY ALL""")
def _(t):
    d = t.lineitem.withColumn("disc", F.round(COL("l_discount") * 100).cast("int"))
    return C.margins(d, [["l_returnflag"], ["l_linestatus", "l_linenumber"], ["l_returnflag", "l_linestatus", "disc"]])


@query("ag17_block_consistency", """
WITH a AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_returnflag, l_linenumber, sum(CASE WHEN l_tax > 0 THEN l_quantity ELSE 0 END) AS v FROM lineitem GROUP BY ALL)
SELECT max(abs(x - y)) AS largest, count(*) AS cells FROM (SELECT l_returnflag, sum(v) AS x FROM a GROUP BY 1) JOIN (SELECT l_returnflag, sum(v) AS y FROM b GROUP BY 1) USING (l_returnflag)""")
def _(t):
    a = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("v"))
    b = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(F.sum(F.when(COL("l_tax") > 0, COL("l_quantity")).otherwise(0.0)).alias("v"))
    return C.block_consistency(a, b, ["l_returnflag"], "v")


@query("ag18_crosstab", """
SELECT l_linenumber, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS "A", sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS "N",
 sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS "R",
 sum(CASE WHEN l_returnflag = 'X' THEN l_quantity ELSE 0 END) AS "X" FROM lineitem GROUP BY 1""")
def _(t):
    return A.crosstab(t.lineitem, "l_linenumber", "l_returnflag", ["A", "N", "R", "X"], COL("l_quantity"))


@query("ag19_partition_check", """
SELECT l_suppkey, declared, leaves, round((leaves - declared) * 100.0 / nullif(declared, 0), 6) AS gap_pct FROM (
 SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS declared, sum(CASE WHEN l_returnflag IN ('N', 'R') THEN l_quantity ELSE 0 END) AS leaves FROM lineitem GROUP BY 1)""")
def _(t):
    return r(A.partition_check(t.lineitem, ["l_suppkey"], "l_returnflag", "A", ["N", "R"], "l_quantity"), "gap_pct")


@query("ag20_candidate_leaves", """
WITH s AS (SELECT CAST(l_linenumber AS INT) AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1), t AS (SELECT sum(l_quantity) / 7.0 * 2 AS total FROM lineitem)
SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS codes, sum(v) AS sum, round(any_value(total), 4) AS total FROM range(1, 128) m(mask), s, t WHERE (mask >> (k - 1)) & 1 = 1 GROUP BY mask
HAVING abs(sum(v) - any_value(total)) <= 0.01 * any_value(total)""")
def _(t):
    d = t.lineitem.groupBy(COL("l_linenumber").cast("string").alias("code")).agg(F.sum("l_quantity").alias("v"))
    tot = t.lineitem.agg((F.sum("l_quantity") / 7.0 * 2).alias("v")).withColumn("code", F.lit("TOT"))
    return r(A.candidate_leaf_sets(d.unionByName(tot), "code", list("1234567"), "TOT", "v", 0.01), "total", digits=4)


MOMENTS = """SELECT '{v}' AS variable, count({v}) AS n, round(sum(CASE WHEN {v} IS NOT NULL THEN w END) / (SELECT sum(l_quantity) FROM lineitem), 6) AS coverage, round(sum(w * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN w END), 5) AS mean,
 round(sqrt(sum(w * {v} * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN w END) - (sum(w * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN w END)) ** 2), 4) AS sd,
 round(sum(CASE WHEN {v} IS NOT NULL THEN w END) ** 2 / sum(CASE WHEN {v} IS NOT NULL THEN w * w END), 4) AS n_eff, min({v})::DOUBLE AS min, max({v})::DOUBLE AS max FROM d"""


@query("ag21_weighted_moments", "WITH d AS (SELECT l_quantity AS w, l_extendedprice AS price, CASE WHEN l_linenumber <> 3 THEN l_discount END AS disc FROM lineitem) " + MOMENTS.format(v="price") + " UNION ALL " + MOMENTS.format(v="disc"))
def _(t):
    d = t.lineitem.select(COL("l_quantity").alias("w"), COL("l_extendedprice").alias("price"), F.when(COL("l_linenumber") != 3, COL("l_discount")).alias("disc"))
    m = A.weighted_moments(d, ["price", "disc"], "w").drop("se", "se_cluster")
    return r(r(r(m, "sd", "n_eff", digits=4), "mean", digits=5), "coverage")


@query("ag22_weighted_quantile", """
WITH g AS (SELECT l_returnflag AS k, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS cum, sum(w) OVER (PARTITION BY k) AS t FROM g)
SELECT k, min(v) FILTER (cum >= t * 0.05::DOUBLE) AS q05, min(v) FILTER (cum >= t * 0.5::DOUBLE) AS q50, min(v) FILTER (cum >= t * 0.95::DOUBLE) AS q95 FROM c GROUP BY 1""")
def _(t):
    return quantiles(t.lineitem.withColumnRenamed("l_returnflag", "k"), ["k"], "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, COL("l_quantity"), "first")


@query("ag23_kish_reuse", """
SELECT l_returnflag, sum(m)::BIGINT AS n, count(*) AS donors, round(sum(m) ** 2 / sum(m * m), 6) AS n_eff, round(sqrt(sum(m) / (sum(m) ** 2 / sum(m * m))), 6) AS band
FROM (SELECT l_returnflag, l_suppkey, count(*) AS m FROM lineitem GROUP BY ALL) GROUP BY 1""")
def _(t):
    return r(A.kish_reuse(t.lineitem, "l_suppkey", ["l_returnflag"]), "n_eff", "band")


@query("ag24_signature_reuse", """
WITH s AS (SELECT CAST(l_linenumber AS VARCHAR) || '|' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '|' || l_returnflag || '|' || CASE WHEN l_linenumber = 3 THEN '-' ELSE l_linestatus END AS sig, l_suppkey FROM lineitem),
m AS (SELECT sig, count(*) AS m, count(DISTINCT l_suppkey) AS cells FROM s GROUP BY 1)
SELECT count(*) AS signatures, round(avg(m), 6) AS mean, min(m) AS min, max(m) AS max, count(*) FILTER (m = 1) AS singletons, round(avg(CASE WHEN cells = 1 THEN 1.0 ELSE 0.0 END), 6) AS one_cell,
 median(m) AS median, quantile_cont(m, 0.9) AS q90, (SELECT sig FROM m ORDER BY m DESC, sig DESC LIMIT 1) AS heaviest FROM m""")
def _(t):
    d = t.lineitem.withColumn("q", COL("l_quantity").cast("int")).withColumn("ls", F.when(COL("l_linenumber") != 3, COL("l_linestatus")))
    return r(A.signature_reuse(d, ["l_linenumber", "q", "l_returnflag", "ls"], "l_suppkey"), "mean", "one_cell")


@query("ag25_correlation_gap", " UNION ALL ".join(f"""SELECT '{x}~{y}' AS pair, round(corr({x}, {y}) FILTER (l_returnflag = 'A'), 6) AS r_a, count(*) FILTER (l_returnflag = 'A') AS n_a,
 round(corr({x}, {y}) FILTER (l_returnflag <> 'A'), 6) AS r_b, count(*) FILTER (l_returnflag <> 'A') AS n_b, round(abs(corr({x}, {y}) FILTER (l_returnflag = 'A') - corr({x}, {y}) FILTER (l_returnflag <> 'A')), 6) AS gap FROM lineitem"""
                                                for x, y in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]))
def _(t):
    g = A.correlation_gap(t.lineitem.filter("l_returnflag = 'A'"), t.lineitem.filter("l_returnflag <> 'A'"), ["l_quantity", "l_extendedprice", "l_discount"])
    return r(g, "r_a", "r_b", "gap")


@query("ag26_intraclass", """
WITH c AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem GROUP BY 1 HAVING count(*) > 1),
t AS (SELECT count(*) AS k, sum(n) AS nn, sum(n * n) AS n2, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM c),
v AS (SELECT *, (b - s * s / nn) / (k - 1) AS msb, (q - b) / (nn - k) AS msw, (nn - n2 / nn) / (k - 1) AS n0 FROM t)
SELECT k AS clusters, nn::BIGINT AS persons, round(n0, 6) AS n0, round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc FROM v""")
def _(t):
    return r(A.intraclass(t.lineitem, "l_orderkey", "l_quantity"), "n0", "icc")


PROFILE = """SELECT '{c}' AS name, count(*) AS rows, count(try_cast({c} AS DOUBLE)) >= 0.9 * count({c}) AS numeric,
 CASE WHEN count(try_cast({c} AS DOUBLE)) >= 0.9 * count({c}) THEN min(try_cast({c} AS DOUBLE)) END AS min, CASE WHEN count(try_cast({c} AS DOUBLE)) >= 0.9 * count({c}) THEN max(try_cast({c} AS DOUBLE)) END AS max,
 count(*) FILTER (try_cast({c} AS DOUBLE) < 0) AS negatives, count(DISTINCT {c}) AS "distinct" FROM lineitem"""
COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]


@query("ag27_column_shape", "SELECT * FROM (" + " UNION ALL ".join(PROFILE.format(c=c) for c in COLS) + ") WHERE numeric AND \"distinct\" BETWEEN 8 AND 23 AND min >= 0 AND max <= 8")
def _(t):
    return A.column_shape(A.column_profile(t.lineitem, COLS), 8, 23, 0, 8)


@query("ag28_fit_to_census", """
WITH s AS (SELECT l_suppkey AS k, count(*) AS p, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY 1), c AS (SELECT s_suppkey AS k, CAST(floor(s_acctbal) AS BIGINT) AS p, s_nationkey AS f FROM supplier),
j AS (SELECT coalesce(s.p, 0) AS sp, coalesce(s.f, 0) AS sf, c.p, c.f FROM c LEFT JOIN s USING (k))
SELECT 'p' AS measure, sum(sp)::DOUBLE AS synthetic, sum(p)::DOUBLE AS census, round(avg(abs(sp - p)), 6) AS mae, round(corr(sp, p), 6) AS pearson FROM j
UNION ALL SELECT 'f', sum(sf)::DOUBLE, sum(f)::DOUBLE, round(avg(abs(sf - f)), 6), round(corr(sf, f), 6) FROM j""")
def _(t):
    s = t.lineitem.groupBy(COL("l_suppkey").alias("k")).agg(F.count("*").alias("p"), F.sum(F.when(COL("l_returnflag") == "R", 1).otherwise(0)).alias("f"))
    c = t.supplier.select(COL("s_suppkey").alias("k"), F.floor("s_acctbal").alias("p"), COL("s_nationkey").alias("f"))
    return r(A.fit_to_census(s, c, "k", ["p", "f"]), "mae", "pearson")


@query("ag29_variance_split", """
WITH u AS (SELECT l_suppkey % 10 AS z, l_suppkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS k FROM lineitem GROUP BY ALL), p AS (SELECT *, k / n AS p FROM u),
z AS (SELECT z, sum(n) AS n, sum(k) AS k, sum(n * p * p) AS q, sum(p * (1 - p)) AS e FROM p GROUP BY 1), t AS (SELECT sum(n) AS n, sum(k) AS k, sum(n * (k / n) ** 2) AS b, sum(q) AS q, sum(e) AS e FROM z),
v AS (SELECT b / n - (k / n) ** 2 AS between, (q - b) / n AS within, e / n AS noise FROM t)
SELECT round(between, 8) AS between, round(within, 8) AS within, round(noise, 8) AS noise, round(between / (between + greatest(within - noise, 0)), 5) AS ratio FROM v""")
def _(t):
    u = t.lineitem.groupBy((COL("l_suppkey") % 10).alias("z"), "l_suppkey").agg(F.count("*").alias("n"), F.sum(F.when(COL("l_returnflag") == "R", 1).otherwise(0)).alias("k"))
    return r(r(A.variance_split(u, "z", "n", "k"), "between", "within", "noise", digits=8), "ratio", digits=5)


RESID = """WITH w AS (SELECT s_suppkey AS unit, CAST(floor(s_acctbal / 10) AS BIGINT) AS a, CAST(s_nationkey * 20 AS BIGINT) AS b FROM supplier), l AS (SELECT unit, 'Y0-4' AS klass, a AS census FROM w UNION ALL SELECT unit, 'Y5-9', b FROM w),
s AS (SELECT l_suppkey AS unit, CASE WHEN l_quantity < 25 THEN 'Y0-4' WHEN l_quantity < 50 THEN 'Y5-9' ELSE 'Y10' END AS klass, count(*) AS synthetic FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(l.unit, s.unit) AS unit, coalesce(l.klass, s.klass) AS klass, coalesce(census, 0) AS census, coalesce(synthetic, 0) AS synthetic FROM l FULL JOIN s ON l.unit = s.unit AND l.klass = s.klass) """


def _resid(t):
    w = t.supplier.select(COL("s_suppkey").alias("unit"), F.floor(COL("s_acctbal") / 10).alias("a"), (COL("s_nationkey") * 20).cast("bigint").alias("b"))
    s = t.lineitem.select(COL("l_suppkey").alias("unit"), F.when(COL("l_quantity") < 25, "Y0-4").when(COL("l_quantity") < 50, "Y5-9").otherwise("Y10").alias("klass"))
    return A.class_residuals(s, w, "unit", {"Y0-4": "a", "Y5-9": "b"})


@query("ag30_class_residuals", RESID + "SELECT unit, klass, census, synthetic, synthetic - census AS residual FROM j")
def _(t):
    return _resid(t)


@query("ag30_residual_summary", RESID + "SELECT klass, count(*) AS n, round(avg(abs(synthetic - census)), 6) AS mae, round(avg(synthetic - census), 6) AS bias FROM j GROUP BY 1")
def _(t):
    return r(A.residual_summary(_resid(t), "klass"), "mae", "bias")


@query("ag31_design_cells", """
SELECT c_mktsegment, count(*) FILTER (n_regionkey = 0) AS "0", count(*) FILTER (n_regionkey = 1) AS "1", count(*) FILTER (n_regionkey = 2) AS "2", count(*) FILTER (n_regionkey = 3) AS "3", count(*) FILTER (n_regionkey = 4) AS "4", count(*) AS pooled,
 least(count(*), 180) AS take FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    return A.design_cells(cust(t), "n_regionkey", [0, 1, 2, 3, 4], "c_mktsegment", 180).withColumn("take", COL("take").cast("bigint"))
