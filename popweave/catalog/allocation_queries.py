"""Apportionment, allocation, donation and draws: orders and customers play the persons."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.aggregate_queries import COL, cust
from popweave.functions.draws import draw_sql
from popweave.functions.fixed_values import BAND_BLOCKS
from popweave.operators import allocation as L, joins as J
from popweave.plans.ranking import magnitude_slice


def lr(p, w, n, cell, cat, real=False):
    """CTEs ``<p>``: largest remainder of weights ``w`` to totals ``n`` per cell."""
    c = ", ".join(cell)
    quota = ("floor(n * w / t) AS b, n * w / t - floor(n * w / t) AS m" if real else "n * w // t AS b, (n * w) % t AS m")
    return f"""{p}_t AS (SELECT {c}, {cat}, w, sum(w) OVER (PARTITION BY {c}) AS t FROM (SELECT {c}, {cat}, greatest(w, 0) AS w FROM {w})),
{p}_q AS (SELECT {c}, {cat}, n, {quota} FROM {p}_t JOIN {n} USING ({c}) WHERE t > 0),
{p} AS (SELECT {c}, {cat}, CAST(b + CASE WHEN row_number() OVER (PARTITION BY {c} ORDER BY m DESC, {cat}) <= n - sum(b) OVER (PARTITION BY {c}) THEN 1 ELSE 0 END AS BIGINT) AS k FROM {p}_q)"""


def hand(p, members, counts, cell, cat, key, channel):
    """CTEs ``<p>``: members with the value of their block of counts."""
    c = ", ".join(cell)
    on = " AND ".join(f"m.{x} IS NOT DISTINCT FROM i.{x}" for x in cell)
    return f"""{p}_m AS (SELECT *, row_number() OVER (PARTITION BY {c} ORDER BY {draw_sql(channel, key)}, {key}) - 1 AS pos FROM {members}),
{p}_i AS (SELECT *, sum(k) OVER (PARTITION BY {c} ORDER BY {cat}) AS hi FROM {counts} WHERE k > 0),
{p} AS (SELECT m.* EXCLUDE (pos), i.{cat} FROM {p}_m m LEFT JOIN {p}_i i ON {on} AND pos >= hi - k AND pos < hi)"""


def alloc(p, members, weights, cell, cat, key, channel, real=False):
    c = ", ".join(cell)
    return (f"{p}_n AS (SELECT {c}, count(*) AS n FROM {members} GROUP BY ALL), " + lr(f"{p}_k", weights, f"{p}_n", cell, cat, real) + ", "
            + hand(p, members, f"{p}_k", cell, cat, key, channel))


def pull(p, people, table, cell, val, key, channel, take=()):
    """CTEs ``<p>``: one weighted draw per person from its cell."""
    c = ", ".join(cell)
    on = " AND ".join(f"m.{x} IS NOT DISTINCT FROM i.{x}" for x in cell)
    more = "".join(f", i.{x}" for x in take)
    return f"""{p}_i AS (SELECT *, sum(w) OVER (PARTITION BY {c} ORDER BY {val}) AS hi, sum(w) OVER (PARTITION BY {c}) AS tt FROM {table} WHERE w > 0),
{p} AS (SELECT m.*, i.{val}{more} FROM (SELECT *, {draw_sql(channel, key)} AS uu FROM {people}) m JOIN {p}_i i ON {on} AND uu * tt >= hi - w AND uu * tt < hi)"""


@query("as1_largest_remainder", "WITH w AS (SELECT c_nationkey, c_mktsegment, count(*) AS w FROM customer GROUP BY ALL), n AS (SELECT s_nationkey AS c_nationkey, 17 + 3 * count(*) AS n FROM supplier GROUP BY 1), "
       + lr("k", "w", "n", ["c_nationkey"], "c_mktsegment") + " SELECT * FROM k")
def _(t):
    w = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("w"))
    n = t.supplier.groupBy(COL("s_nationkey").alias("c_nationkey")).agg((17 + 3 * F.count("*")).alias("n"))
    return L.apportion(w, n, ["c_nationkey"], "c_mktsegment", "w").select("c_nationkey", "c_mktsegment", "k")


@query("as1_largest_remainder_real", "WITH w AS (SELECT c_nationkey, c_mktsegment, count(*) * 0.25::DOUBLE AS w FROM customer GROUP BY ALL), n AS (SELECT s_nationkey AS c_nationkey, 17 + 3 * count(*) AS n FROM supplier GROUP BY 1), "
       + lr("k", "w", "n", ["c_nationkey"], "c_mktsegment", True) + " SELECT * FROM k")
def _(t):
    w = t.customer.groupBy("c_nationkey", "c_mktsegment").agg((F.count("*") * 0.25).alias("w"))
    n = t.supplier.groupBy(COL("s_nationkey").alias("c_nationkey")).agg((17 + 3 * F.count("*")).alias("n"))
    return L.apportion(w, n, ["c_nationkey"], "c_mktsegment", "w").select("c_nationkey", "c_mktsegment", "k")


MS = "m AS (SELECT c_custkey AS uid, c_nationkey AS z FROM customer), w AS (SELECT s_nationkey AS z, s_suppkey AS s, CAST(floor(s_acctbal) AS BIGINT) AS w FROM supplier)"


def ms(t):
    return (t.customer.select(COL("c_custkey").alias("uid"), COL("c_nationkey").alias("z")),
            t.supplier.select(COL("s_nationkey").alias("z"), COL("s_suppkey").alias("s"), F.floor("s_acctbal").alias("w")))


@query("as2_hand_out", f"WITH {MS}, " + alloc("a", "m", "w", ["z"], "s", "uid", "hand") + " SELECT * FROM a")
def _(t):
    m, w = ms(t)
    return L.allocate(m, w, ["z"], "s", "w", "uid", "hand")


SECT = """m AS (SELECT o_orderkey AS uid, c_nationkey AS z, CASE WHEN o_orderstatus = 'F' THEN 'FRG' ELSE 'ITL' END AS cit FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT s_nationkey AS z, s_suppkey AS s, CASE WHEN s_nationkey % 5 = 0 THEN 0.0 ELSE floor(s_acctbal / 100) END AS base, (s_suppkey % 10) / 10.0::DOUBLE AS q, 1.0::DOUBLE AS tot FROM supplier),
w0 AS (SELECT z, s, 'FRG' AS cit, base * q AS w0, base AS w1, tot AS w2 FROM s UNION ALL SELECT z, s, 'ITL', base * (1 - q), base, tot FROM s),
wt AS (SELECT *, sum(w0) OVER (PARTITION BY z, cit) AS t0, sum(w1) OVER (PARTITION BY z, cit) AS t1 FROM w0), w AS (SELECT z, cit, s, CASE WHEN t0 > 0 THEN w0 WHEN t1 > 0 THEN w1 ELSE w2 END AS w FROM wt)"""


@query("as3_section_allocation", f"WITH {SECT}, " + alloc("a", "m", "w", ["z", "cit"], "s", "uid", "section", True) + " SELECT * FROM a")
def _(t):
    m = t.orders.join(t.customer, COL("o_custkey") == COL("c_custkey")).select(COL("o_orderkey").alias("uid"), COL("c_nationkey").alias("z"), F.when(COL("o_orderstatus") == "F", "FRG").otherwise("ITL").alias("cit"))
    s = t.supplier.select(COL("s_nationkey").alias("z"), COL("s_suppkey").alias("s"), F.when(COL("s_nationkey") % 5 == 0, 0.0).otherwise(F.floor(COL("s_acctbal") / 100).cast("double")).alias("base"),
                          ((COL("s_suppkey") % 10) / 10.0).alias("q"), F.lit(1.0).alias("tot"))
    w = L.section_weights(s, "z", "s", COL("base"), COL("q"), COL("tot"), "FRG", "ITL", "cit")
    return L.assign_section(m, w, ["z", "cit"], "s", "uid")


TWO = """m AS (SELECT o_orderkey AS uid, o_orderstatus AS sex, o_custkey % 10 AS z FROM orders), aw AS (SELECT o_custkey % 10 AS z, o_orderpriority AS area, count(*) * 3 AS w FROM orders GROUP BY ALL),
iw AS (SELECT o_orderpriority AS area, o_orderstatus AS sex, CAST(year(o_orderdate) AS BIGINT) AS country, count(*) AS w FROM orders GROUP BY ALL)"""


@query("as4_area_then_country", f"WITH {TWO}, " + alloc("a", "m", "aw", ["z"], "area", "uid", "area") + ", " + alloc("b", "a", "iw", ["area", "sex"], "country", "uid", "country") + " SELECT * FROM b")
def _(t):
    m = t.orders.select(COL("o_orderkey").alias("uid"), COL("o_orderstatus").alias("sex"), (COL("o_custkey") % 10).alias("z"))
    aw = t.orders.groupBy((COL("o_custkey") % 10).alias("z"), COL("o_orderpriority").alias("area")).agg((F.count("*") * 3).alias("w"))
    iw = t.orders.groupBy(COL("o_orderpriority").alias("area"), COL("o_orderstatus").alias("sex"), F.year("o_orderdate").cast("bigint").alias("country")).agg(F.count("*").alias("w"))
    return L.two_stage(m, aw, ["z"], "area", iw, ["area", "sex"], "country", "w", "uid")


BANDS = [b for b in BAND_BLOCKS if b not in ("65-74", "75+")]
SPLIT = ", ".join(f"('{b}', {k}, {f}::DOUBLE, {lo}, {hi})" for b, ps in BAND_BLOCKS.items() for k, f, lo, hi in ps)
AGE = f"""sp(band, block, f, lo, hi) AS (VALUES {SPLIT}), m AS (SELECT o_orderkey AS uid, o_custkey % 20 AS sec, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'M' END AS sex,
 ['{"', '".join(BANDS)}'][CAST(o_custkey % {len(BANDS)} + 1 AS INT)] AS band FROM orders),
bw0 AS (SELECT l_suppkey % 20 AS sec, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS sex, CAST(l_quantity // 4 AS INT) AS block, count(*) AS c FROM lineitem GROUP BY ALL),
bw AS (SELECT sec, sex, band, block, sum(c * f) AS w, min(lo) AS lo, max(hi) AS hi FROM bw0 JOIN sp USING (block) GROUP BY ALL),
yy AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'M' END AS sex, CAST(l_quantity + l_linenumber * 2 AS INT) AS age, count(*) AS yw FROM lineitem GROUP BY ALL),
yw AS (SELECT sex, band, block, age, sum(yw) AS w FROM (SELECT DISTINCT band, block, lo, hi FROM bw) JOIN yy ON age BETWEEN lo AND hi GROUP BY ALL)"""


def age_inputs(t):
    sex = F.when(COL("l_linestatus") == "F", "F").otherwise("M").alias("sex")
    arr = F.array(*map(F.lit, BANDS))
    m = t.orders.select(COL("o_orderkey").alias("uid"), (COL("o_custkey") % 20).alias("sec"), F.when(COL("o_orderstatus") == "F", "F").otherwise("M").alias("sex"),
                        F.get(arr, (COL("o_custkey") % len(BANDS)).cast("int")).alias("band"))
    bw = t.lineitem.groupBy((COL("l_suppkey") % 20).alias("sec"), sex, F.floor(COL("l_quantity") / 4).cast("int").alias("block")).agg(F.count("*").alias("c"))
    years = t.lineitem.groupBy(sex, (COL("l_quantity") + COL("l_linenumber") * 2).cast("int").alias("age")).agg(F.count("*").alias("w"))
    return m, bw, years


AGE = AGE.replace("CAST(l_quantity // 4 AS INT)", "CAST(floor(l_quantity / 4) AS INT)")
AGED = f"WITH {AGE}, " + alloc("a", "m", "bw", ["sec", "sex", "band"], "block", "uid", "age-block", True) + ", " + alloc("b", "a", "yw", ["sex", "band", "block"], "age", "uid", "age-year")


@query("as5_single_year_age", AGED + " SELECT uid, sec, sex, band, block, age FROM b")
def _(t):
    m, bw, years = age_inputs(t)
    return L.assign_age(m, L.band_block_weights(bw, "sec", "sex", "block", "c"), years, "sec", "sex", "band", "uid")


@query("as6_rebalance_year", f"WITH {AGE}, m2 AS (SELECT uid, sex, CAST(uid % 10 AS INT) AS block FROM m), y2 AS (SELECT sex, age // 5 AS block, age, yw AS w FROM yy), "
       + alloc("a", "m2", "y2", ["sex", "block"], "age", "uid", "age-rebalance") + " SELECT uid, sex, block, age FROM a")
def _(t):
    m, _, years = age_inputs(t)
    p = m.select("uid", "sex", (COL("uid") % 10).cast("int").alias("block"), F.lit(0).alias("age"))
    return L.rebalance_year(p, years.withColumn("block", F.floor(COL("age") / 5).cast("int")), ["sex", "block"], "age", "uid")


@query("as7_address", f"""
WITH p AS (SELECT o_orderkey AS uid, o_custkey % 40 AS sec, o_custkey % 40 % 25 AS z FROM orders), a AS (SELECT c_custkey AS addr, c_nationkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 100 END AS sec, c_nationkey AS z FROM customer),
s AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY addr) AS no, count(*) OVER (PARTITION BY sec) AS n FROM a), zz AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY addr) AS no, count(*) OVER (PARTITION BY z) AS n FROM a)
SELECT p.uid, coalesce(s.addr, zz.addr) AS addr, CASE WHEN s.addr IS NOT NULL THEN 'section' WHEN zz.addr IS NOT NULL THEN 'zone' ELSE 'none' END AS address_source FROM p
LEFT JOIN s ON s.sec = p.sec AND s.no = floor({draw_sql('address', 'uid')} * s.n) + 1 LEFT JOIN zz ON zz.z = p.z AND zz.no = floor({draw_sql('address-zone', 'uid')} * zz.n) + 1""")
def _(t):
    p = t.orders.select(COL("o_orderkey").alias("uid"), (COL("o_custkey") % 40).alias("sec"), (COL("o_custkey") % 40 % 25).alias("z"))
    a = t.customer.select(COL("c_custkey").alias("addr"), (COL("c_nationkey") + F.when(COL("c_custkey") % 2 == 0, 0).otherwise(100)).cast("bigint").alias("sec"), COL("c_nationkey").cast("bigint").alias("z"))
    return L.assign_address(p, a, "sec", "z", "addr", "uid").select("uid", "addr", "address_source")


HOT = f"""WITH pe AS (SELECT c_custkey AS uid, 'Brand#' || (c_custkey % 26 + 1) AS p_brand, ['PROMO', 'LARGE', 'SMALL', 'ECONOMY', 'NONE'][CAST(c_custkey % 5 + 1 AS INT)] AS p_type FROM customer),
l0 AS (SELECT p_brand, p_type FROM part GROUP BY ALL HAVING count(*) >= 15), l1 AS (SELECT p_brand FROM part GROUP BY ALL HAVING count(*) >= 15),
lv AS (SELECT pe.*, CASE WHEN l0.p_type IS NOT NULL THEN 0 WHEN l1.p_brand IS NOT NULL THEN 1 ELSE 2 END AS level FROM pe LEFT JOIN l0 USING (p_brand, p_type) LEFT JOIN l1 ON l1.p_brand = pe.p_brand),
ps AS (SELECT *, CASE WHEN level < 2 THEN p_brand END AS b, CASE WHEN level < 1 THEN p_type END AS ty FROM lv),
d AS (SELECT 0 AS level, p_brand AS b, p_type AS ty, p_partkey, p_size AS w FROM part UNION ALL SELECT 1, p_brand, NULL, p_partkey, p_size FROM part UNION ALL SELECT 2, NULL, NULL, p_partkey, p_size FROM part), """ + pull("g", "ps", "d", ["level", "b", "ty"], "p_partkey", "uid", "donor")


@query("as8_hot_deck", HOT + " SELECT uid, level, g.p_partkey, p_name AS d_p_name, CASE WHEN p_size % 7 = 0 THEN 'non_applicabile' ELSE CAST(p_size AS VARCHAR) END AS d_size FROM g JOIN part USING (p_partkey)")
def _(t):
    kind = F.get(F.array(*map(F.lit, ["PROMO", "LARGE", "SMALL", "ECONOMY", "NONE"])), (COL("c_custkey") % 5).cast("int"))
    pe = t.customer.select(COL("c_custkey").alias("uid"), F.concat(F.lit("Brand#"), COL("c_custkey") % 26 + 1).alias("p_brand"), kind.alias("p_type"))
    do = t.part.withColumn("size", F.when(COL("p_size") % 7 == 0, " ").otherwise(COL("p_size").cast("string"))).withColumn("w", COL("p_size"))
    return L.hot_deck(pe, do, [["p_brand", "p_type"], ["p_brand"]], "p_partkey", "w", ["p_name", "size"], "uid", 15).select("uid", "level", "p_partkey", "d_p_name", "d_size")


WD = "pe AS (SELECT o_orderkey AS uid, o_custkey % 25 AS z FROM orders), ta AS (SELECT c_nationkey AS z, c_mktsegment AS seg, count(*) AS w FROM customer GROUP BY ALL), "


@query("as9_weighted_draw", f"WITH {WD}" + pull("g", "pe", "ta", ["z"], "seg", "uid", "seg") + " SELECT uid, z, seg FROM g")
def _(t):
    pe = t.orders.select(COL("o_orderkey").alias("uid"), (COL("o_custkey") % 25).alias("z"))
    ta = t.customer.groupBy(COL("c_nationkey").cast("bigint").alias("z"), COL("c_mktsegment").alias("seg")).agg(F.count("*").alias("w"))
    return L.weighted_draw(pe, ta, ["z"], "seg", "uid", "seg", "w")


@query("as9_uniform_draw", f"WITH pe AS (SELECT o_orderkey AS uid, o_custkey % 25 AS z FROM orders), ta AS (SELECT c_nationkey AS z, c_custkey AS who, 1 AS w FROM customer), " + pull("g", "pe", "ta", ["z"], "who", "uid", "who") + " SELECT uid, z, who FROM g")
def _(t):
    pe = t.orders.select(COL("o_orderkey").alias("uid"), (COL("o_custkey") % 25).alias("z"))
    return L.weighted_draw(pe, t.customer.select(COL("c_nationkey").cast("bigint").alias("z"), COL("c_custkey").alias("who")), ["z"], "who", "uid", "who", slice_=magnitude_slice(COL("who")))


@query("as10_names", """WITH pe AS (SELECT c_custkey AS uid, c_nationkey AS country, c_mktsegment AS cohort FROM customer),
t1 AS (SELECT c_nationkey AS country, c_mktsegment AS cohort, substr(c_name, 15) AS nm, sum(c_custkey % 7 + 1) AS w FROM customer WHERE c_acctbal > 5000 GROUP BY ALL),
t2 AS (SELECT c_nationkey AS country, substr(c_name, 15) AS nm, sum(c_custkey % 7 + 1) AS w FROM customer WHERE c_nationkey % 2 = 0 GROUP BY ALL), t3 AS (SELECT 1 AS one, p_name AS nm, count(*) AS w FROM part GROUP BY 2),
p1 AS (SELECT * FROM pe WHERE (country, cohort) IN (SELECT (country, cohort) FROM t1)), q1 AS (SELECT * FROM pe WHERE uid NOT IN (SELECT uid FROM p1)), p2 AS (SELECT * FROM q1 WHERE country IN (SELECT country FROM t2)),
p3 AS (SELECT *, 1 AS one FROM q1 WHERE uid NOT IN (SELECT uid FROM p2)), """ + pull("a", "p1", "t1", ["country", "cohort"], "nm", "uid", "name") + ", " + pull("b", "p2", "t2", ["country"], "nm", "uid", "name") + ", " + pull("c", "p3", "t3", ["one"], "nm", "uid", "name")
       + " SELECT uid, nm, 'cohort' AS chain FROM a UNION ALL SELECT uid, nm, 'cohort>country' FROM b UNION ALL SELECT uid, nm, 'cohort>country>all' FROM c")
def _(t):
    c = t.customer.select(COL("c_custkey").alias("uid"), COL("c_nationkey").alias("country"), COL("c_mktsegment").alias("cohort"), "c_acctbal", F.substring("c_name", 15, 99).alias("nm"), (COL("c_custkey") % 7 + 1).alias("v"))
    t1 = c.filter("c_acctbal > 5000").groupBy("country", "cohort", "nm").agg(F.sum("v").alias("w"))
    t2 = c.filter("country % 2 = 0").groupBy("country", "nm").agg(F.sum("v").alias("w"))
    t3 = t.part.groupBy(COL("p_name").alias("nm")).agg(F.count("*").alias("w"))
    pe = c.select("uid", "country", "cohort")
    return L.draw_with_fallback(pe, [("cohort", t1, ["country", "cohort"], "w"), ("country", t2, ["country"], "w"), ("all", t3, [], "w")], "nm", "uid", "name").select("uid", "nm", "chain")


@query("as11_detailed_title", """WITH RECURSIVE e AS (SELECT p_partkey AS code, CASE WHEN p_partkey < 7 THEN p_partkey ELSE p_partkey // 3 END AS up FROM part),
w AS (SELECT code, up, 1 AS h FROM e UNION ALL SELECT w.code, e.up, h + 1 FROM w JOIN e ON w.up = e.code AND e.up <> e.code), rt AS (SELECT code, arg_max(up, h) AS root FROM w GROUP BY 1),
lf AS (SELECT code, root FROM rt WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.up = rt.code AND c.code <> rt.code)),
ta AS (SELECT root, l_returnflag AS sex, code, count(*) AS w FROM lineitem JOIN lf ON l_partkey = code GROUP BY ALL), pe AS (SELECT o_orderkey AS uid, o_custkey % 7 AS root, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'R' END AS sex FROM orders), """
       + pull("g", "pe", "ta", ["root", "sex"], "code", "uid", "title") + " SELECT uid, root, sex, code FROM g")
def _(t):
    e = t.part.select("p_partkey", F.when(COL("p_partkey") < 7, COL("p_partkey")).otherwise(F.floor(COL("p_partkey") / 3)).alias("up"))
    leaves = J.tree(e, "p_partkey", "up").filter("leaf").select("code", "root")
    ta = t.lineitem.groupBy(COL("l_partkey").alias("code"), COL("l_returnflag").alias("sex")).agg(F.count("*").alias("w")).join(leaves, "code")
    pe = t.orders.select(COL("o_orderkey").alias("uid"), (COL("o_custkey") % 7).alias("root"), F.when(COL("o_orderstatus") == "F", "A").otherwise("R").alias("sex"))
    return L.weighted_draw(pe, ta, ["root", "sex"], "code", "uid", "title", "w", magnitude_slice(COL("code"))).select("uid", "root", "sex", "code")


PAIRS = """b AS (SELECT l_suppkey % 30 AS town, l_suppkey % 3 AS reg, l_returnflag AS sex, l_linestatus AS pos, 'S' || l_linenumber AS sec, count(*) AS c FROM lineitem GROUP BY ALL),
g0 AS (SELECT 0 AS level, CAST(town AS VARCHAR) AS place, sex, pos, sec, sum(c)::DOUBLE AS w FROM b GROUP BY ALL), g1 AS (SELECT 1, CAST(reg AS VARCHAR), sex, pos, sec, sum(c)::DOUBLE AS w FROM b GROUP BY ALL),
ga AS (SELECT * FROM g0 UNION ALL SELECT * FROM g1), tp AS (SELECT level, place, sex, pos, sec, w FROM (SELECT *, sum(w) OVER (PARTITION BY level, place, sex) AS m FROM ga) WHERE m >= CASE WHEN level = 0 THEN 660 ELSE 1 END)"""


@query("as12_territory_pairs", f"WITH {PAIRS} SELECT level, place, sex, sec, pos, w FROM tp WHERE level = 1 OR w > 0")
def _(t):
    d = t.lineitem.select((COL("l_suppkey") % 30).alias("town"), (COL("l_suppkey") % 3).alias("reg"), COL("l_returnflag").alias("sex"), COL("l_linestatus").alias("pos"), F.concat(F.lit("S"), "l_linenumber").alias("sec"), F.lit(1).alias("c"))
    a = L.territory_pairs(d, [("town", "town")], ["sex"], "pos", "sec", "c", 660)
    b = L.territory_pairs(d, [("region", "reg")], ["sex"], "pos", "sec", "c", 1).withColumn("level", F.lit(1))
    return a.unionByName(b).select("level", "place", "sex", "sec", "pos", "w")


FACT = """f AS (SELECT ttl, sec, c / cg / (ci / tt) AS factor FROM (SELECT *, sum(c) OVER (PARTITION BY ttl) AS cg, sum(c) OVER (PARTITION BY sec) AS ci, sum(c) OVER () AS tt FROM (
 SELECT l_linestatus AS ttl, 'S' || l_linenumber AS sec, count(*)::DOUBLE AS c FROM lineitem WHERE NOT (l_linestatus = 'O' AND l_linenumber = 7) GROUP BY ALL)))"""


@query("as12_sector_draw", f"""WITH {PAIRS}, {FACT}, pe AS (SELECT o_orderkey AS uid, o_custkey % 30 AS town, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'R' END AS sex, CASE WHEN o_custkey % 2 = 0 THEN 'O' ELSE 'F' END AS ttl FROM orders),
pl AS (SELECT pe.*, CASE WHEN EXISTS (SELECT 1 FROM tp WHERE level = 0 AND tp.place = CAST(town AS VARCHAR) AND tp.sex = pe.sex) THEN 0 ELSE 1 END AS level FROM pe),
pp AS (SELECT uid, sex, ttl, level, CAST(CASE WHEN level = 0 THEN town ELSE town % 3 END AS VARCHAR) AS place FROM pl), ti AS (SELECT DISTINCT ttl FROM pp),
ta AS (SELECT level, place, sex, ti.ttl, sec || '/' || pos AS pair, round(tp.w * coalesce(factor, 1) * 1000) AS w FROM tp CROSS JOIN ti LEFT JOIN f USING (ttl, sec)), """ + pull("g", "pp", "ta", ["level", "place", "sex", "ttl"], "pair", "uid", "job") + " SELECT uid, level, place, pair FROM g")
def _(t):
    d = t.lineitem.select((COL("l_suppkey") % 30).alias("town"), (COL("l_suppkey") % 3).alias("reg"), COL("l_returnflag").alias("sex"), COL("l_linestatus").alias("pos"), F.concat(F.lit("S"), "l_linenumber").alias("sec"), F.lit(1).alias("c"))
    tp = L.territory_pairs(d, [("town", "town")], ["sex"], "pos", "sec", "c", 660).unionByName(L.territory_pairs(d, [("region", "reg")], ["sex"], "pos", "sec", "c", 1).withColumn("level", F.lit(1)))
    titles = d.filter("not (pos = 'O' and sec = 'S7')").withColumnRenamed("pos", "ttl")
    f = L.reweighting_factor(titles, "ttl", "sec", "c")
    pe = t.orders.select(COL("o_orderkey").alias("uid"), (COL("o_custkey") % 30).alias("town"), F.when(COL("o_orderstatus") == "F", "A").otherwise("R").alias("sex"), F.when(COL("o_custkey") % 2 == 0, "O").otherwise("F").alias("ttl"))
    local = tp.filter("level = 0").select(COL("place").cast("bigint").alias("town"), "sex").distinct().withColumn("has", F.lit(True))
    pp = pe.join(local, ["town", "sex"], "left").withColumn("level", F.when(COL("has"), 0).otherwise(1))
    pp = pp.withColumn("place", F.when(COL("level") == 0, COL("town")).otherwise(COL("town") % 3).cast("string"))
    ta = (tp.withColumn("ttl", F.explode(F.array(F.lit("O"), F.lit("F")))).join(f, ["ttl", "sec"], "left")
          .select("level", "place", "sex", "ttl", F.concat("sec", F.lit("/"), "pos").alias("pair"), F.round(COL("w") * F.coalesce("factor", F.lit(1.0)) * 1000).alias("w")))
    return L.weighted_draw(pp, ta, ["level", "place", "sex", "ttl"], "pair", "uid", "job", "w").select("uid", "level", "place", "pair")


@query("as13_reweighting_factor", f"WITH {FACT} SELECT ttl, sec, round(factor, 6) AS factor FROM f")
def _(t):
    d = t.lineitem.filter("not (l_linestatus = 'O' and l_linenumber = 7)").select(COL("l_linestatus").alias("ttl"), F.concat(F.lit("S"), "l_linenumber").alias("sec"), F.lit(1).alias("c"))
    return r(L.reweighting_factor(d, "ttl", "sec", "c"), "factor")


STRAT = f"""WITH d AS (SELECT o_orderkey, o_orderpriority AS band, o_custkey AS donor, {draw_sql('agents', 'o_orderkey')} AS u FROM orders), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY band, donor ORDER BY u, o_orderkey) AS rd FROM d) WHERE rd = 1),
s AS (SELECT band, o_orderkey, donor, rank FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY u, o_orderkey) AS rank FROM k) WHERE rank <= 24)"""


def agents(t):
    return t.orders.select("o_orderkey", COL("o_orderpriority").alias("band"), COL("o_custkey").alias("donor"))


@query("as14_stratified_sample", STRAT + " SELECT band, o_orderkey, CAST(rank AS INT) AS rank FROM s")
def _(t):
    return L.stratified_sample(agents(t), "band", 120, 5, "o_orderkey", "agents", "donor").select("band", "o_orderkey", "rank")


@query("as14_sample_report", STRAT + " SELECT d.band, count(*) AS available, any_value(x.taken) AS taken, any_value(x.donors) AS donors, any_value(1.0::DOUBLE - x.donors / x.taken) AS reuse, any_value(x.taken) < 24 AS short FROM d JOIN (SELECT band, count(*) AS taken, count(DISTINCT donor) AS donors FROM s GROUP BY 1) x ON x.band = d.band GROUP BY 1")
def _(t):
    s = L.stratified_sample(agents(t), "band", 120, 5, "o_orderkey", "agents", "donor")
    return L.sample_report(s, agents(t), "band", "donor", 24)


@query("as15_cell_quota", f"""WITH d AS (SELECT o_orderkey, o_orderpriority AS cell, o_custkey % 6 AS place FROM orders), w AS (SELECT cell, place, count(*) AS w FROM d GROUP BY ALL), n AS (SELECT cell, least(sum(w), 37)::BIGINT AS n FROM w GROUP BY 1), """
       + lr("q", "w", "n", ["cell"], "place") + f" SELECT o_orderkey, cell, place FROM (SELECT d.*, k, row_number() OVER (PARTITION BY cell, place ORDER BY {draw_sql('quota', 'o_orderkey')}, o_orderkey) AS rn FROM d JOIN q USING (cell, place)) WHERE rn <= k")
def _(t):
    d = t.orders.select("o_orderkey", COL("o_orderpriority").alias("cell"), (COL("o_custkey") % 6).alias("place"))
    return L.quota_sample(d, "cell", "place", 37, "o_orderkey")


@query("as16_blind_sheet", f"""SELECT doc_id, answer, CAST(row_number() OVER (ORDER BY {draw_sql('blind-order', 'doc_id')}, doc_id) AS INT) AS sheet_no FROM (SELECT doc_id, lang AS answer,
 row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('blind', 'doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 6""")
def _(t):
    return L.blind_sheet(t.documents.select("doc_id", "lang"), "lang", 6, "doc_id")


@query("as17_model_sample", f"""WITH t0 AS (SELECT c_mktsegment || '|' || c_nationkey AS key, c_mktsegment, c_nationkey, count(*) AS w FROM customer GROUP BY ALL),
ta AS (SELECT 1 AS one, {draw_sql('cell', 'key')} AS h, c_mktsegment, c_nationkey, w FROM t0),
pe AS (SELECT 'T-' || lpad(CAST(i AS VARCHAR), 7, '0') AS uid, 1 AS one FROM range(0, (SELECT count(*) FROM orders)) r(i)), """ + pull("g", "pe", "ta", ["one"], "h", "uid", "model", ["c_mktsegment", "c_nationkey"]) + " SELECT uid, c_mktsegment, c_nationkey FROM g")
def _(t):
    la = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("w"))
    return L.model_sample(la, ["c_mktsegment", "c_nationkey"], "w", t.orders.count(), "T")


@query("as18_extend_columns", "WITH pe AS (SELECT o_orderkey, o_orderstatus, 1 AS one FROM orders), ta AS (SELECT 1 AS one, c_mktsegment, count(*) AS w FROM customer GROUP BY ALL), " + pull("g", "pe", "ta", ["one"], "c_mktsegment", "o_orderkey", "extend-c_mktsegment") + " SELECT o_orderkey, o_orderstatus, c_mktsegment FROM g")
def _(t):
    m = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("w"))
    return L.extend_columns(t.orders.select("o_orderkey", "o_orderstatus"), m, "c_mktsegment", "w", "o_orderkey")
