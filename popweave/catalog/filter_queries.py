"""Filters, samples and publication regimes."""
from pyspark.sql import functions as F

from popweave.catalog import located, located_sql, query, r
from popweave.functions.draws import draw_sql
from popweave.operators import filters as P

SPEC = {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3]}


@query("pf1_exact_filter", """SELECT c_custkey, c_mktsegment, c_nationkey FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)""")
def _(t):
    return P.exact_filter(t.customer, SPEC).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("pf1_unknown_values", """
SELECT 'c_nationkey' AS asked_column, 'BUILDING' AS value, 'c_mktsegment' AS held_by
UNION ALL SELECT 'c_mktsegment', 'SHIPS', ''""")
def _(t):
    return P.unknown_values(t.customer.select("c_nationkey", "c_mktsegment"), {"c_nationkey": ["BUILDING", 3], "c_mktsegment": ["SHIPS"]})


@query("pf2_count_under_filter", """SELECT count(*) AS n FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3)""")
def _(t):
    return P.exact_filter(t.customer, SPEC).agg(F.count("*").alias("n"))


@query("pf3_seeded_sample", f"""SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders WHERE o_orderstatus = 'F'
ORDER BY {draw_sql('sample', 'o_orderkey')}, o_orderkey LIMIT 25)""")
def _(t):
    return P.seeded_sample(P.exact_filter(t.orders, {"o_orderstatus": "F"}), "o_orderkey", 25).select("o_orderkey", "o_totalprice")


@query("pf4_regime", """SELECT c_custkey, c_mktsegment, substr(c_name, 1, 8) AS short_name FROM customer""")
def _(t):
    rules = {"public": {"drop": ["c_name", "c_acctbal", "c_nationkey"], "add": {"short_name": F.substring("c_name", 1, 8)}}}
    return P.regime(t.customer, rules, "public")


@query("pf5_public_export", """
WITH m AS (SELECT l_orderkey, min(l_linenumber) AS k, min(l_returnflag) AS ruolo FROM lineitem GROUP BY 1)
SELECT o_orderkey AS uid, coalesce(m.k, -1)::BIGINT AS nucleo, coalesce(ruolo, '') AS ruolo FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def _(t):
    m = (t.lineitem.groupBy(F.col("l_orderkey").alias("uid"))
         .agg(F.format_string("N-%07d", F.min("l_linenumber")).alias("id_nucleo"), F.min("l_returnflag").alias("ruolo")))
    return P.public_export(t.orders.select(F.col("o_orderkey").alias("uid")), m, "uid")


@query("pf5_export_summary", """
WITH m AS (SELECT l_orderkey, min(l_linenumber) AS k FROM lineitem GROUP BY 1),
e AS (SELECT o_orderstatus, coalesce(m.k, -1) AS nucleo FROM orders LEFT JOIN m ON o_orderkey = l_orderkey)
SELECT count(*) AS persons, (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, nucleo FROM e WHERE nucleo >= 0)) AS households,
 round(avg(CASE WHEN nucleo < 0 THEN 1.0 ELSE 0.0 END), 6) AS unplaced FROM e""")
def _(t):
    m = (t.lineitem.groupBy(F.col("l_orderkey").alias("uid"))
         .agg(F.format_string("N-%07d", F.min("l_linenumber")).alias("id_nucleo"), F.min("l_returnflag").alias("ruolo")))
    e = P.public_export(t.orders.select(F.col("o_orderkey").alias("uid"), "o_orderstatus"), m, "uid")
    return P.export_summary(e, "o_orderstatus")


@query("pf6_scatter_in_unit", f"""
WITH p AS {located_sql()}, b AS (SELECT c_nationkey, min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM p GROUP BY 1)
SELECT c_custkey, round(CASE WHEN x1 > x0 AND y1 > y0 THEN x0 + {draw_sql('x', 'c_custkey')} * (x1 - x0) ELSE x END, 6) AS x,
 round(CASE WHEN x1 > x0 AND y1 > y0 THEN y0 + {draw_sql('y', 'c_custkey')} * (y1 - y0) ELSE y END, 6) AS y FROM p JOIN b USING (c_nationkey)""")
def _(t):
    return r(P.scatter_in_unit(located(t), "c_nationkey", "x", "y", "c_custkey").select("c_custkey", "x", "y"), "x", "y")


LINEAGE = """WITH d AS (SELECT count(DISTINCT c_custkey) AS c_custkey, count(DISTINCT c_acctbal) AS c_acctbal, count(DISTINCT c_mktsegment) AS c_mktsegment, count(DISTINCT c_nationkey) AS c_nationkey FROM customer),
l AS (UNPIVOT d ON c_custkey, c_acctbal, c_mktsegment, c_nationkey INTO NAME attribute VALUE n)
SELECT attribute, attribute || ' is known by region: crossing it with c_nationkey adds no information' AS message FROM l WHERE attribute <> 'c_nationkey' AND n < 25"""


@query("pf7_filter_caveats", LINEAGE)
def _(t):
    cols = ["c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey"]
    n = t.customer.agg(*[F.countDistinct(c).alias(c) for c in cols]).unpivot([], cols, "attribute", "n")
    lineage = n.select("attribute", F.when(F.col("n") < 25, "region").otherwise("zone").alias("finest"), F.when(F.col("n") < 25, 1).otherwise(0).alias("rank"))
    return P.filter_caveats(lineage, cols, "c_nationkey")


@query("pf8_elementary_classes", """
WITH c AS (SELECT DISTINCT CAST(p_size // 10 * 10 AS INT) AS lo, CAST(p_size // 10 * 10 + CASE WHEN p_size % 3 = 0 THEN 4 WHEN p_size % 3 = 1 THEN 9 ELSE 19 END AS INT) AS hi FROM part),
k AS (SELECT 'Y' || lo || '-' || hi AS code, lo, hi FROM c)
SELECT code, lo, hi FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.code <> a.code AND a.lo <= b.lo AND b.hi <= a.hi)""")
def _(t):
    lo = (F.floor(F.col("p_size") / 10) * 10).cast("int")
    m = F.col("p_size") % 3
    hi = lo + F.when(m == 0, 4).when(m == 1, 9).otherwise(19)
    c = t.part.select(lo.alias("lo"), hi.alias("hi")).distinct().withColumn("code", F.concat(F.lit("Y"), "lo", F.lit("-"), "hi"))
    return P.elementary_classes(c).select("code", "lo", "hi")


@query("pf9_drop_aggregates", """
WITH f AS (SELECT o_custkey % 10 AS g, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS d1,
  bool_or(o_orderpriority = '1-URGENT') OR bool_or(o_orderpriority = '9-NONE') AS d2 FROM orders GROUP BY 1)
SELECT g, o_orderstatus AS code, count(*) AS n FROM orders JOIN f ON g = o_custkey % 10
WHERE NOT (o_orderstatus = 'P' AND d1) GROUP BY ALL""")
def _(t):
    d = t.orders.select((F.col("o_custkey") % 10).alias("g"), F.col("o_orderstatus").alias("code"))
    return (P.drop_aggregate_codes(d, ["g"], "code", ["TOT"], {"P": ("all", ["F", "O"])})
            .groupBy("g", "code").agg(F.count("*").alias("n")))


@query("pf10_special_units", """
SELECT regexp_matches(CAST(c_custkey AS VARCHAR), '88|99') AS special, count(*) AS rows, round(sum(c_acctbal), 2) AS mass FROM customer GROUP BY 1""")
def _(t):
    return r(P.special_units(t.customer, "c_custkey", F.col("c_acctbal"), "88|99"), "mass", digits=2)


@query("pf11_without_identity", """
SELECT c_nationkey, count(*) AS agents, round(sum(c_acctbal), 2) AS balance, 'name,nick' AS removed, 'bal,key' AS fields FROM customer GROUP BY 1""")
def _(t):
    d = t.customer.select("c_nationkey", F.array(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                          F.col("c_name").alias("nick"), F.col("c_acctbal").alias("bal"))).alias("agents"))
    out = P.without_identity(d, "agents", ["name", "nick", "surname"])
    left = ",".join(sorted([f for f in out.schema["agents"].dataType.elementType.names]))
    return r(out.groupBy("c_nationkey", "removed").agg(F.sum(F.size("agents")).alias("agents"),
             F.sum(F.aggregate("agents", F.lit(0.0), lambda s, a: s + a["bal"])).alias("balance")).withColumn("fields", F.lit(left)), "balance", digits=2)


@query("pf12_in_tension", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity >= 45 AND l_discount BETWEEN 0.0 AND 0.015 AS INT) AS tension FROM (
 SELECT *, {draw_sql('tension', 'k')} AS u FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS k FROM lineitem)
 WHERE l_returnflag = 'R') ORDER BY tension DESC, u, k LIMIT 40""")
def _(t):
    k = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint"))
    return P.in_tension(t.lineitem.withColumn("k", k), F.col("l_returnflag") == "R", F.col("l_quantity") >= 45,
                        F.col("l_discount").between(0.0, 0.015), "k", 40).select("l_orderkey", "l_linenumber", "l_partkey", "tension")
