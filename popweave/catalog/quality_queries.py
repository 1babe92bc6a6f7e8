"""Certification and data-quality gates over the given tables."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.aggregate_queries import COL, CUBE, constraint_cube, cust
from popweave.operators import quality as Q

FP = "SELECT {k} count(*) AS categories, round(sum(w), 2) AS n, max(w) AS w_max, min(w) AS w_min, count(*) FILTER (w = 1) AS hapax, " + ", ".join(f"round(quantile_cont(w, {i / 10}), 4) AS d{i}" for i in range(1, 10)) + ", string_agg(c, '|' ORDER BY w DESC, c) FILTER (rk <= 5) AS head FROM t {g}"
DS = [f"d{i}" for i in range(1, 10)]


@query("dq1_fingerprint", "WITH g AS (SELECT p_name AS c, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY w DESC, c) AS rk FROM g) " + FP.format(k="", g=""))
def _(t):
    d = t.lineitem.join(t.part, COL("l_partkey") == COL("p_partkey")).groupBy(COL("p_name").alias("chiave")).agg(F.sum("l_quantity").alias("peso"))
    return r(r(Q.fingerprint(d), "n", digits=2), *DS, digits=4)


@query("dq2_instance_fingerprints", "WITH g AS (SELECT c_nationkey AS k, c_mktsegment AS c, count(*)::DOUBLE AS w FROM customer GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, c) AS rk FROM g) " + FP.format(k="k,", g="GROUP BY k"))
def _(t):
    d = t.customer.groupBy(COL("c_nationkey").alias("k"), COL("c_mktsegment").alias("chiave")).agg(F.count("*").cast("double").alias("peso"))
    return r(r(Q.fingerprint(d, ["k"]), "n", digits=2), *DS, digits=4)


DRIFT = """WITH a AS (SELECT c_nationkey AS k, count(*) FILTER (c_nationkey <> 9) AS n, sum(c_custkey) AS h FROM customer WHERE c_nationkey <> 4 GROUP BY 1), b AS (SELECT c_nationkey AS k, sum(CASE WHEN c_nationkey % 6 = 1 AND c_acctbal < 0 THEN 0 ELSE c_custkey END) AS h FROM customer WHERE c_nationkey <> 11 GROUP BY 1),
s AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'lost' WHEN a.n = 0 THEN 'empty' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k) """


def drift(t):
    k, c = COL("c_nationkey"), t.customer
    a = c.filter("c_nationkey <> 4").groupBy(k.alias("k")).agg(F.sum(F.when(k != 9, 1).otherwise(0)).alias("n"), F.sum("c_custkey").alias("h"))
    b = c.filter("c_nationkey <> 11").groupBy(k.alias("k")).agg(F.sum(F.when((k % 6 == 1) & (COL("c_acctbal") < 0), 0).otherwise(COL("c_custkey"))).alias("h"))
    return Q.instance_drift(a, b, "k", "h", "n")


@query("dq3_instance_drift", DRIFT + "SELECT k, state FROM s")
def _(t):
    return drift(t)


@query("dq3_drift_verdict", DRIFT + "SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'lost') AS lost, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'empty') AS empty, 'DIVERGE' AS verdict FROM s")
def _(t):
    return Q.drift_verdict(drift(t))


@query("dq4_declared_vs_measured", """WITH m AS (SELECT n_name AS id, count(c_custkey)::DOUBLE AS nm, count(DISTINCT c_mktsegment)::DOUBLE AS cm FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey <> 7 GROUP BY 1),
r AS (SELECT n_name AS id, CASE WHEN n_nationkey % 8 = 1 THEN '?' ELSE 'CC' END AS lic, 'h' || CASE WHEN n_nationkey % 9 = 2 THEN 1 ELSE 0 END AS sha, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + CASE WHEN n_nationkey % 5 = 0 THEN 2 ELSE 0 END AS nd, 5.0 + CASE WHEN n_nationkey = 3 THEN 1 ELSE 0 END AS cd FROM nation),
n AS (SELECT id, concat_ws(' · ', CASE WHEN lic = '?' THEN 'missing: licence' END, CASE WHEN nm IS NULL THEN 'not measured' END, CASE WHEN sha <> 'h0' AND nm IS NOT NULL THEN 'hash differs' END, CASE WHEN abs(nd - nm) > 0.5 THEN 'n ' || CAST(nd AS BIGINT) || ' declared, ' || CAST(nm AS BIGINT) || ' measured' END,
 CASE WHEN abs(cd - cm) > 0.5 THEN 'categories differ' END) AS note FROM r LEFT JOIN m USING (id)) SELECT id, CASE WHEN note = '' THEN 'ok' ELSE 'DIVERGE' END AS verdict, note FROM n""")
def _(t):
    n = t.nation.join(t.customer, COL("c_nationkey") == COL("n_nationkey"), "left")
    m = n.filter("n_nationkey <> 7").groupBy(COL("n_name").alias("id")).agg(F.count("c_custkey").cast("double").alias("n_measured"), F.countDistinct("c_mktsegment").cast("double").alias("categories_measured"), F.lit("h0").alias("hash_measured"))
    k = COL("n_nationkey")
    reg = n.groupBy("n_nationkey", COL("n_name").alias("id")).agg(F.count("c_custkey").alias("c")).select(
        "id", F.when(k % 8 == 1, "?").otherwise("CC").alias("licence"), F.when(k % 9 == 2, "h1").otherwise("h0").alias("sha256"), (COL("c") + F.when(k % 5 == 0, 2).otherwise(0)).cast("double").alias("n_declared"),
        F.when(k == 3, 6.0).otherwise(5.0).alias("categories_declared"))
    return Q.declared_vs_measured(reg, m, ["licence"])


@query("dq5_content_hash", """WITH h AS (SELECT c_nationkey, md5(concat(length(c_custkey::VARCHAR), ':', c_custkey, octet_length(encode(c_name)), ':', c_name, octet_length(encode(c_mktsegment)), ':', c_mktsegment)) AS h FROM customer)
SELECT c_nationkey, count(*) AS rows, """ + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::BIGINT AS hash_{'abcd'[i]}" for i in range(4)) + " FROM h GROUP BY 1")
def _(t):
    return Q.content_hash(t.customer, ["c_nationkey"], ["c_custkey", "c_name", "c_mktsegment"])


@query("dq5_compare_outputs", """WITH a AS (SELECT o_custkey AS k, sum(o_orderkey) AS h FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, sum(CASE WHEN o_totalprice > 499000 THEN 0 ELSE o_orderkey END) AS h FROM orders WHERE o_custkey % 100 <> 7 GROUP BY 1 UNION ALL SELECT -1, 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.h IS NULL THEN 'missing left' WHEN b.h IS NULL THEN 'missing right' WHEN a.h = b.h THEN 'same' ELSE 'different' END AS outcome FROM a FULL JOIN b ON a.k = b.k""")
def _(t):
    o = t.orders
    a = o.groupBy(COL("o_custkey").alias("k")).agg(F.sum("o_orderkey").alias("h"))
    b = o.filter("o_custkey % 100 <> 7").groupBy(COL("o_custkey").alias("k")).agg(F.sum(F.when(COL("o_totalprice") > 499000, 0).otherwise(COL("o_orderkey"))).alias("h"))
    ghost = t.region.agg(F.lit(-1).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("h"))
    return Q.compare_outputs(a, b.unionByName(ghost), "k", "h")


@query("dq6_coverage", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    return Q.uncovered(t.nation.select(COL("n_nationkey").alias("k")), t.supplier.filter("s_acctbal > 5000").select(COL("s_nationkey").alias("k")), "k")


@query("dq7_publishable", """SELECT outcome, reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus <> 'F' THEN 'solo impronta' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW', '1-URGENT') THEN 'BLOCCANTE' ELSE 'ok' END AS outcome,
 CASE WHEN o_orderstatus <> 'F' THEN 'raw file not versioned' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'licence not verified' WHEN o_orderpriority = '1-URGENT' THEN 'not redistributable' ELSE 'with attribution (' || o_orderpriority || ')' END AS reason FROM orders) GROUP BY ALL""")
def _(t):
    lic = F.when(COL("o_orderpriority") == "4-NOT SPECIFIED", "DA_VERIFICARE").when(COL("o_orderpriority") == "5-LOW", " ").when(COL("o_orderpriority") == "1-URGENT", "NON_REDISTRIBUIBILE: x").otherwise(COL("o_orderpriority"))
    a, b = Q.publishable(F.when(COL("o_orderstatus") == "F", "git").otherwise("local"), lic)
    return t.orders.select(a.alias("outcome"), b.alias("reason")).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


@query("dq8_missing_fields", """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '?' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE source END AS source, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS text FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN lang = '?' THEN 'lang' END, CASE WHEN trim(text) = '' THEN 'text' END) AS judgement, concat_ws(',', CASE WHEN source IS NULL THEN 'source' END) AS provenance FROM d""")
def _(t):
    k = COL("doc_id")
    d = t.documents.select("doc_id", F.when(k % 3 == 0, "?").otherwise(COL("lang")).alias("lang"), F.when(k % 4 != 0, COL("source")).alias("source"), F.when(k % 5 == 0, " ").otherwise(COL("text")).alias("text"))
    return Q.missing_fields(d, "doc_id", {"judgement": ["lang", "text"], "provenance": ["source"]})


@query("dq9_attribution", """SELECT s_suppkey, '## ' || s_name || chr(10) || chr(10) || '- **Publisher:** ' || n_name || chr(10) || '- **Licence:** CC ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || chr(10) || '> by ' || n_name ELSE '' END AS block FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t):
    d = t.supplier.join(t.nation, COL("s_nationkey") == COL("n_nationkey"))
    q = F.when(COL("s_suppkey") % 2 == 0, F.concat(F.lit(" by \n "), "n_name")).otherwise("")
    return d.select("s_suppkey", Q.attribution(COL("s_name"), {"Publisher": F.concat(F.lit("  "), "n_name"), "Licence": F.concat(F.lit("CC  "), "s_nationkey")}, q).alias("block"))


GATE = """WITH d AS (SELECT o_orderstatus AS "table", o_custkey % 30 AS place, year(o_orderdate) AS y, CASE WHEN o_custkey % 30 = 4 THEN -1 WHEN o_custkey % 30 = 6 THEN NULL ELSE 1 END AS v, o_custkey % 30 = 8 AND o_orderkey % 2 = 0 AS els FROM orders WHERE NOT (o_custkey % 30 = 2 AND o_orderstatus = 'P')),
g AS (SELECT "table", place, count(*) AS rows, count(v) AS nm, count(*) FILTER (v < 0) AS neg, count(*) FILTER (els) AS els, sum(v) AS s, any_value(lt) AS latest FROM (SELECT *, sum(v) OVER (PARTITION BY "table", place, y) AS sy, max(y) OVER (PARTITION BY "table", place) AS my FROM d) d LEFT JOIN (SELECT "table" AS t2, place AS p2, arg_max(s, y) AS lt FROM (SELECT "table", place, y, sum(v) AS s FROM d GROUP BY ALL) WHERE s IS NOT NULL GROUP BY ALL) ON t2 = "table" AND p2 = place GROUP BY ALL), e AS (SELECT st AS "table", pl AS place, 20.0::DOUBLE AS pop FROM (VALUES ('F'), ('O'), ('P')) a(st), range(0, 30) b(pl)),
rl AS (SELECT 'F' AS "table", 160 AS floor, 175 AS ceiling, NULL AS multiple UNION ALL SELECT 'O', NULL, NULL, 3 UNION ALL SELECT 'P', 1, 100000, NULL)
SELECT e."table", e.place, CASE WHEN rows IS NULL THEN 'C1: absent or empty' WHEN rows % multiple <> 0 THEN 'C2: ' || rows || ' rows, not a multiple of 3' WHEN rows > ceiling THEN 'C2: ' || rows || ' rows above ' || ceiling WHEN rows < floor THEN 'C2: ' || rows || ' rows below ' || floor
 WHEN els > 0 THEN 'C3: ' || els || ' rows of another territory' WHEN nm = 0 OR neg > 0 OR coalesce(s, 0) <= 0 THEN 'C4: ' || neg || ' negative' WHEN abs((latest - pop) / pop) > 1.6 / sqrt(pop) THEN 'C5: latest total off' ELSE 'ok' END AS verdict FROM e LEFT JOIN g ON g."table" = e."table" AND g.place = e.place LEFT JOIN rl ON rl."table" = e."table" """


@query("dq10_table_gate", GATE)
def _(t):
    k = COL("o_custkey") % 30
    d = t.orders.filter(~((k == 2) & (COL("o_orderstatus") == "P"))).select(COL("o_orderstatus").alias("table"), k.alias("place"), F.concat(F.lit("0"), F.when((k == 8) & (COL("o_orderkey") % 2 == 0), 9).otherwise(k)).alias("terr"), F.year("o_orderdate").alias("y"), F.when(k == 4, -1).when(k == 6, F.lit(None)).otherwise(1).alias("v"))
    e = t.orders.select(COL("o_orderstatus").alias("table")).distinct().select("table", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))).alias("place"), F.lit(20.0).alias("pop"))
    rl = t.orders.select(COL("o_orderstatus").alias("table")).distinct().select("table", F.lit(None).cast("int").alias("exact"), F.when(COL("table") == "F", 160).when(COL("table") == "P", 1).alias("floor"),
        F.when(COL("table") == "F", 175).when(COL("table") == "P", 100000).alias("ceiling"), F.when(COL("table") == "O", 3).alias("multiple"))
    return Q.table_gate(d, "table", "place", "terr", e, rl, "v", "y", F.lit(True))


@query("dq11_gate_state", "SELECT c_nationkey, bool_and(st = 'F') AS closed, count(*) AS tables, count(*) FILTER (st = 'F') AS done, 0::BIGINT AS divergent FROM (SELECT c_nationkey, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def _(t):
    return Q.gate_state(t.orders.join(t.customer, COL("o_custkey") == COL("c_custkey")), "c_nationkey", "o_orderkey", "o_orderstatus", "F")


@query("dq12_candidates", "SELECT l_suppkey % 50 AS u, sum(l_quantity) AS pop FROM lineitem WHERE l_linenumber BETWEEN 0 AND 5 AND l_suppkey % 50 NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1 HAVING sum(l_quantity) > 22000")
def _(t):
    return Q.candidates(t.lineitem.withColumn("u", COL("l_suppkey") % 50), "u", "l_linenumber", "l_quantity", 22000, t.nation.select(COL("n_nationkey").cast("bigint").alias("u")), 5)


@query("dq13_ladder", """WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_quantity + CASE WHEN l_discount = 0.1 THEN 1 ELSE l_tax END AS t FROM lineitem)
SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS steps, bool_and(a + b = t) AS adds_up, count(*) = 4 AND count(DISTINCT l_linenumber) = 4 AS complete FROM d GROUP BY 1""")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", COL("l_quantity").alias("a"), COL("l_tax").alias("b"), (COL("l_quantity") + F.when(COL("l_discount") == 0.1, 1.0).otherwise(COL("l_tax"))).alias("t"))
    return Q.ladder_check(d, "l_orderkey", "l_linenumber", ["a", "b"], "t", 4)


def observed(t):
    o = t.orders.select(F.lit("orders").alias("table"), F.year("o_orderdate").alias("year"))
    l = t.lineitem.select(F.lit("lineitem").alias("table"), F.year("l_shipdate").alias("year"))
    e = t.events.select(F.lit("events").alias("table"), F.year("ts").alias("year"))
    rules = t.region.filter("r_regionkey < 4").select(F.get(F.array(*map(F.lit, ["orders", "lineitem", "events", "absent"])), "r_regionkey").alias("table"), F.lit(1998).alias("required"), (COL("r_regionkey") < 2).alias("hard"))
    return o.unionByName(l).unionByName(e), rules


OBSERVED = "WITH o AS (SELECT 'orders' AS t, year(o_orderdate) AS y FROM orders UNION SELECT 'lineitem', year(l_shipdate) FROM lineitem UNION SELECT 'events', year(ts) FROM events), rl AS (SELECT * FROM (VALUES ('orders', true), ('lineitem', true), ('events', false), ('absent', false)) v(t, hard)) "


@query("dq14_preflight", OBSERVED + "SELECT rl.t AS \"table\", CAST(min(y) AS INT) AS first, CAST(max(y) AS INT) AS last, count(y) AS years, CASE WHEN coalesce(bool_or(y = 1998), false) THEN 'ok' WHEN any_value(hard) THEN 'STOP' ELSE 'warning' END AS outcome FROM rl LEFT JOIN o ON o.t = rl.t GROUP BY 1")
def _(t):
    return Q.preflight(*observed(t))


@query("dq14_common_years", OBSERVED + "SELECT CAST(y AS INT) AS year FROM o JOIN rl USING (t) WHERE hard GROUP BY 1 HAVING count(*) = 2")
def _(t):
    return Q.common_years(*observed(t))


@query("dq15_table_diff", """WITH a AS (SELECT o_custkey % 50 AS k, o_orderstatus AS s, floor(o_totalprice / 20000) AS b FROM orders WHERE year(o_orderdate) <= 1998), b AS (SELECT o_custkey % 50 AS k, o_orderstatus AS s, floor(o_totalprice / 20000) AS b FROM orders WHERE year(o_orderdate) >= 1998),
g AS (SELECT sum(d) AS d FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY k, s, b)
SELECT true AS same_schema, (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, sum(greatest(d, 0))::BIGINT AS only_a, sum(greatest(-d, 0))::BIGINT AS only_b FROM g""")
def _(t):
    d = t.orders.select((COL("o_custkey") % 50).alias("k"), COL("o_orderstatus").alias("s"), F.floor(COL("o_totalprice") / 20000).alias("b"), F.year("o_orderdate").alias("y"))
    return Q.table_diff(d.filter("y <= 1998").drop("y"), d.filter("y >= 1998").drop("y").withColumn("b", COL("b").cast("double")))


DIM = " UNION ALL ".join(f"SELECT '{c}' AS dim, CAST({c} AS VARCHAR) AS code, count(*) AS rows, sum(l_quantity) AS total FROM d GROUP BY ALL" for c in ["l_returnflag", "l_linestatus", "l_linenumber", "fixed"])


@query("dq16_dimension_profile", f"WITH d AS (SELECT *, 'X' AS fixed FROM lineitem), p AS ({DIM}) SELECT dim, code, rows, total, count(*) OVER (PARTITION BY dim) AS codes, count(*) OVER (PARTITION BY dim) > 1 AS varies FROM p")
def _(t):
    return Q.dimension_profile(t.lineitem.withColumn("fixed", F.lit("X")), ["l_returnflag", "l_linestatus", "l_linenumber", "fixed"], "l_quantity")


@query("dq16_recover_codes", """WITH l AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS code FROM nation UNION ALL SELECT '0' || n_nationkey FROM nation WHERE n_nationkey < 3), o AS (SELECT DISTINCT CAST(c_custkey % 30 AS VARCHAR) AS code FROM customer),
z AS (SELECT o.code, count(l.code) AS n, min(l.code) AS f FROM o LEFT JOIN l ON CAST(l.code AS INT) = CAST(o.code AS INT) GROUP BY 1) SELECT code, CASE WHEN n = 1 THEN f END AS resolved, CASE n WHEN 0 THEN 'unknown' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM z""")
def _(t):
    l = t.nation.select(F.lpad(COL("n_nationkey").cast("string"), 3, "0").alias("code")).unionByName(t.nation.filter("n_nationkey < 3").select(F.concat(F.lit("0"), "n_nationkey").alias("code")))
    return Q.recover_codes(t.customer.select((COL("c_custkey") % 30).cast("string").alias("code")).distinct(), l, "code")


@query("dq17_level_check", """WITH o AS (SELECT DISTINCT c_nationkey + 2 AS code FROM customer), l AS (SELECT 'nation' AS level, n_nationkey AS code FROM nation UNION SELECT 'supplier', s_nationkey + 3 FROM supplier WHERE s_acctbal > 3000 UNION SELECT 'none', r_regionkey + 900 FROM region),
s AS (SELECT level, count(o.code) / (SELECT count(*) FROM o)::DOUBLE AS share FROM l LEFT JOIN o USING (code) GROUP BY 1) SELECT level, round(share, 6) AS share, level = (SELECT level FROM s ORDER BY share DESC, level DESC LIMIT 1) AS best FROM s""")
def _(t):
    l = (t.nation.select(F.lit("nation").alias("level"), COL("n_nationkey").alias("code")).unionByName(t.supplier.filter("s_acctbal > 3000").select(F.lit("supplier").alias("level"), (COL("s_nationkey") + 3).alias("code")))
         .unionByName(t.region.select(F.lit("none").alias("level"), (COL("r_regionkey") + 900).alias("code"))))
    return r(Q.level_check(t.customer.select((COL("c_nationkey") + 2).alias("code")), l), "share")


@query("dq18_impossible_combinations", """WITH d AS (SELECT l_returnflag AS g, l_quantity AS age, ceil(l_quantity / 10) * 10 AS top, CASE p_type WHEN 'ECONOMY' THEN 18 WHEN 'PROMO' THEN 20 WHEN 'LARGE' THEN 22 END AS lo FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT g, count(*) AS persons, count(lo) AS at_risk, count(*) FILTER (age < lo) AS impossible, count(*) FILTER (top < lo) AS certain, round(count(*) FILTER (age < lo) / count(lo), 6) AS rate FROM d GROUP BY 1""")
def _(t):
    d = t.lineitem.join(t.part, COL("l_partkey") == COL("p_partkey")).select(COL("l_returnflag").alias("g"), COL("l_quantity").alias("age"), (F.ceil(COL("l_quantity") / 10) * 10).alias("top"), "p_type")
    return r(Q.impossible_combinations(d, "p_type", "age", "top", {"ECONOMY": 18, "PROMO": 20, "LARGE": 22}, "g"), "rate")


@query("dq19_block_inspection", CUBE + "SELECT block, count(*) AS cells, round(sum(alpha), 6) AS mass, count(*) FILTER (alpha <= 0) AS zeros FROM cube GROUP BY 1")
def _(t):
    from popweave.operators.cube import block_inspection
    return r(block_inspection(constraint_cube(t)), "mass")


@query("dq19_exclusion_coverage", CUBE + ", e AS (SELECT 'l_returnflag=' || f || '|l_linenumber=' || n AS key FROM (VALUES ('A'), ('R'), ('Z')) a(f), range(1, 9) b(n)) SELECT CASE WHEN a IS NULL THEN 'not covered' WHEN a > 0 THEN 'has mass' ELSE 'zero' END AS coverage, count(*) AS cells FROM (SELECT e.key, max(alpha) AS a FROM e LEFT JOIN cube ON cube.key = e.key GROUP BY 1) GROUP BY 1")
def _(t):
    e = t.region.filter("r_regionkey < 3").select(F.get(F.array(*map(F.lit, "ARZ")), "r_regionkey").alias("f"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    return Q.exclusion_coverage(e.select(F.concat(F.lit("l_returnflag="), "f", F.lit("|l_linenumber="), "n").alias("key")), constraint_cube(t), "key")


LOG = "WITH m AS (SELECT source, max(list_max(list_transform(regexp_extract_all(text, '([0-9]{3,})', 1), lambda x: try_cast(x AS DOUBLE)))) AS big, max(list_max(list_transform(regexp_extract_all(text, '\\b([0-9]{2})\\b', 1), lambda x: try_cast(x AS DOUBLE)))) AS two, max(n_chars)::DOUBLE AS chars FROM documents GROUP BY 1) "


def logs(t):
    m = Q.log_metrics(t.documents, "source", "text", {"big": "([0-9]{3,})", "two": "\\b([0-9]{2})\\b"})
    return m.join(t.documents.groupBy("source").agg(F.max("n_chars").cast("double").alias("chars")), "source")


@query("dq20_log_metrics", LOG + "SELECT source, big, two, chars FROM m")
def _(t):
    return logs(t)


@query("dq20_size_bands", LOG + ", b AS (SELECT *, CASE WHEN chars < 20000 THEN 0 WHEN chars < 50000 THEN 1 ELSE 2 END AS band FROM m) SELECT band, count(*) AS runs, median(chars) AS median FROM b GROUP BY 1")
def _(t):
    return Q.size_bands(logs(t), "chars", [20000, 50000], "chars")


@query("dq21_config_vs_data", """WITH c AS (SELECT n_regionkey AS unit, n_nationkey AS code, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE n_name END AS name FROM nation UNION ALL SELECT 0, 77, 'GHOST'), o AS (SELECT DISTINCT c_nationkey % 5 AS unit, c_nationkey AS code FROM customer WHERE c_nationkey <> 8)
SELECT coalesce(c.unit, o.unit) AS unit, CASE WHEN o.code IS NULL THEN 'name without code: ' || c.code ELSE 'code without name: ' || o.code END AS problem FROM c FULL JOIN o ON c.unit = o.unit AND c.code = o.code WHERE o.code IS NULL OR coalesce(name, '') = ''""")
def _(t):
    c = t.nation.select(COL("n_regionkey").alias("unit"), COL("n_nationkey").alias("code"), F.when(COL("n_nationkey") % 6 == 0, "").otherwise(COL("n_name")).alias("name"))
    c = c.unionByName(t.region.agg(F.lit(0).alias("unit"), F.lit(77).alias("code"), F.lit("GHOST").alias("name")))
    return Q.config_vs_data(c, t.customer.filter("c_nationkey <> 8").select((COL("c_nationkey") % 5).alias("unit"), COL("c_nationkey").alias("code")), "unit", "code")


TAGS = "WITH s AS (SELECT user_id, unnest([event_type, CASE WHEN value > 20 THEN 'large' ELSE 'misc' END]) AS tag FROM events), m AS (SELECT * FROM (VALUES ('view', 'A'), ('click', 'A'), ('purchase', 'B'), ('large', 'B'), ('signup', 'C')) v(tag, destination)) "


def tagged(t):
    s = t.events.select("user_id", F.array(COL("event_type"), F.when(COL("value") > 20, "large").otherwise("misc")).alias("tags"))
    m = t.region.select(F.get(F.array(*map(F.lit, ["view", "click", "purchase", "large", "signup"])), "r_regionkey").alias("tag"), F.get(F.array(*map(F.lit, "AABBC")), "r_regionkey").alias("destination"))
    return Q.tag_routing(s, "user_id", "tags", m)


@query("dq22_tag_routing", TAGS + "SELECT destination, count(DISTINCT user_id) AS sources FROM s JOIN m USING (tag) GROUP BY 1")
def _(t):
    return tagged(t)[0]


@query("dq22_unknown_tags", TAGS + "SELECT tag, count(DISTINCT user_id) AS sources FROM s WHERE tag NOT IN (SELECT tag FROM m) GROUP BY 1")
def _(t):
    return tagged(t)[1]


PUB = "WITH c AS (SELECT c_nationkey AS k, 'mean' AS metric, floor(avg(c_acctbal)) AS value FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'n', count(*)::DOUBLE FROM customer GROUP BY 1), p AS (SELECT k, metric, value + CASE WHEN k % 7 = 0 THEN 0.3 WHEN k % 7 = 1 THEN 40 ELSE 0 END AS value FROM c) "


def pub(t):
    g = t.customer.groupBy(COL("c_nationkey").alias("k")).agg(F.floor(F.avg("c_acctbal")).cast("double").alias("mean"), F.count("*").cast("double").alias("n"))
    return g.unpivot(["k"], ["mean", "n"], "metric", "value")


@query("dq23_published_check", PUB + "SELECT p.k, p.metric, round(p.value, 4) AS published, c.value AS computed, abs(p.value - c.value) <= greatest(0.006, abs(c.value) * 0.002) AS ok FROM p JOIN c ON c.k = p.k AND c.metric = p.metric")
def _(t):
    c = pub(t)
    p = c.withColumn("value", COL("value") + F.when(COL("k") % 7 == 0, 0.3).when(COL("k") % 7 == 1, 40.0).otherwise(0.0))
    return r(Q.published_check(p, c, ["k", "metric"]), "published", digits=4)


@query("dq23_metric_extremes", PUB + "SELECT metric, min(value) AS min, (SELECT k FROM c x WHERE x.metric = c.metric ORDER BY value, k LIMIT 1) AS min_at, max(value) AS max, (SELECT k FROM c x WHERE x.metric = c.metric ORDER BY value DESC, k DESC LIMIT 1) AS max_at FROM c GROUP BY metric")
def _(t):
    return Q.metric_extremes(pub(t), "metric", "k", "value")


@query("dq24_run_index", """WITH g AS (SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS v, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS k FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n, ' ' ORDER BY event_type || '=' || n) AS knobs, round(sum(v), 2) AS seconds, max(k) FILTER (event_type = 'click') AS click, max(k) FILTER (event_type = 'view') AS "view" FROM g GROUP BY 1""")
def _(t):
    g = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"), F.max(F.get_json_object("props", "$.k").cast("double")).alias("k"))
    m = lambda c: F.map_from_entries(F.collect_list(F.struct("event_type", c)))
    runs = g.groupBy("user_id").agg(m("n").alias("knobs"), m("v").alias("steps"), m("k").alias("measures"))
    return r(Q.run_index(runs, "user_id", "knobs", "steps", "measures", ["click", "view"]), "seconds", digits=2)
