"""Windows, sorts, limits and set operations."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.operators import windows as X


@query("wn1_average_rank", """
SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY y) + (count(*) OVER (PARTITION BY o_orderstatus, y) - 1) / 2.0::DOUBLE AS rank
FROM (SELECT *, floor(o_totalprice / 1000) AS y FROM orders)""")
def _(t):
    d = t.orders.select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("y"))
    return X.average_rank(d, ["o_orderstatus"], "y").select("o_orderkey", "rank")


@query("wn1_spearman", """
WITH d AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), q AS (SELECT k,
 rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS ry FROM d)
SELECT k, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM q GROUP BY 1""")
def _(t):
    return r(X.spearman(t.lineitem.withColumnRenamed("l_returnflag", "k"), ["k"], "l_quantity", "l_extendedprice"), "rho")


@query("wn2_terciles", """
SELECT c_custkey, CAST(greatest(1, ceil(3 * (rn - 1) / (n - 1))) AS INT) AS tercile FROM (SELECT c_custkey,
 row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def _(t):
    return X.terciles(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey").select("c_custkey", "tercile")


COVER = """WITH g AS (SELECT l_returnflag AS k, l_suppkey AS s, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY w DESC, s ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY k) AS total FROM g) """


@query("wn3_coverage", COVER + "SELECT k, count(*) AS labels, (sum(CASE WHEN cum < 0.9::DOUBLE * total THEN 1 ELSE 0 END) + 1)::BIGINT AS n90, (sum(CASE WHEN cum < 0.95::DOUBLE * total THEN 1 ELSE 0 END) + 1)::BIGINT AS n95 FROM c GROUP BY 1")
def _(t):
    return X.coverage(t.lineitem.withColumnRenamed("l_returnflag", "k"), ["k"], "l_suppkey", "l_quantity")


@query("wn4_consecutive_gaps", """
WITH d AS (SELECT DISTINCT l_orderkey, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS day, l_partkey FROM lineitem)
SELECT gap, count(*) AS n FROM (SELECT day - lag(day) OVER (PARTITION BY l_orderkey ORDER BY day, l_partkey) AS gap FROM d) WHERE gap IS NOT NULL GROUP BY 1""")
def _(t):
    d = t.lineitem.select("l_orderkey", F.date_diff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("bigint").alias("day"), "l_partkey").distinct()
    return X.consecutive_gaps(d, ["l_orderkey"], "day", "l_partkey").groupBy("gap").agg(F.count("*").alias("n"))


@query("wn5_size_strata", """
WITH u AS (SELECT o_custkey AS unit, count(*) AS size FROM orders GROUP BY 1), b AS (SELECT quantile_cont(size, 1/3.0::DOUBLE) AS b1, quantile_cont(size, 2/3.0::DOUBLE) AS b2 FROM u)
SELECT unit, size, CAST(1 + CAST(size > b1 AS INT) + CAST(size > b2 AS INT) AS INT) AS stratum FROM u, b""")
def _(t):
    return X.strata_by_size(t.orders.withColumnRenamed("o_custkey", "unit"), "unit")


@query("wn6_first_wins", """
SELECT l_orderkey, l_shipdate, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    return X.first_wins(t.lineitem, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_quantity"], ["l_shipdate", "l_partkey", "l_quantity"])


@query("wn7_carry_forward", """
SELECT c_nationkey, c_custkey, last_value(h IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS header
FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS h FROM customer)""")
def _(t):
    d = t.customer.withColumn("h", F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")))
    return X.carry_forward(d, ["c_nationkey"], "c_custkey", "h", "header").select("c_nationkey", "c_custkey", "header")


@query("wn8_top_k_per_group", """
SELECT l_suppkey, l_partkey, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) AS rank
 FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rank <= 3""")
def _(t):
    return X.top_k(t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n")), ["l_suppkey"], [F.desc("n"), F.col("l_partkey")], 3)


@query("st1_ordered_top", "SELECT l_partkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return r(t.lineitem.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("revenue")), "revenue", digits=2).orderBy(F.desc("revenue"), "l_partkey").limit(20)


@query("st2_union_of_parts", """
SELECT part, label, count(*) AS n FROM (SELECT 'customer' AS part, c_mktsegment AS label FROM customer UNION ALL SELECT 'orders', o_orderstatus FROM orders
 UNION ALL SELECT 'part', p_type FROM part) GROUP BY ALL""")
def _(t):
    s = lambda df, n, c: df.select(F.lit(n).alias("part"), F.col(c).alias("label"))
    return (s(t.customer, "customer", "c_mktsegment").unionByName(s(t.orders, "orders", "o_orderstatus")).unionByName(s(t.part, "part", "p_type"))
            .groupBy("part", "label").agg(F.count("*").alias("n")))


@query("st3_set_operations", """
SELECT 'only_customer' AS side, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'only_supplier', k FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)
UNION ALL SELECT 'both', k FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def _(t):
    a, b = t.customer.filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    tag = lambda df, n: df.withColumn("side", F.lit(n))
    return tag(a.subtract(b), "only_customer").unionByName(tag(b.subtract(a), "only_supplier")).unionByName(tag(a.intersect(b), "both"))


@query("st4_deduplicate", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])
