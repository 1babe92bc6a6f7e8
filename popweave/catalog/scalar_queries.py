"""Scalar functions: codes, labels, answers and draws over whole tables."""
from pyspark.sql import functions as F

from popweave.catalog import query
from popweave.functions import fixed_values as V, scalars as S
from popweave.functions.draws import draw, draw_sql


@query("fn1_age_code", """
WITH c AS (SELECT CASE CAST(l_quantity AS BIGINT) % 4
  WHEN 0 THEN 'Y' || CAST(l_quantity AS BIGINT)
  WHEN 1 THEN 'Y' || CAST(l_quantity AS BIGINT) || '-' || (CAST(l_quantity AS BIGINT) + 4)
  WHEN 2 THEN 'Y_GE' || CAST(l_quantity AS BIGINT) ELSE 'TOTAL' END AS code,
  CAST(l_quantity AS INT) AS q FROM lineitem)
SELECT code, CASE q % 4 WHEN 3 THEN NULL ELSE q END AS lo,
  CASE q % 4 WHEN 0 THEN q WHEN 1 THEN q + 4 WHEN 2 THEN 199 END AS hi, count(*) AS n
FROM c GROUP BY ALL""")
def _(t):
    q = F.col("l_quantity").cast("bigint").cast("string")
    m = F.col("l_quantity").cast("bigint") % 4
    code = (F.when(m == 0, F.concat(F.lit("Y"), q))
            .when(m == 1, F.concat(F.lit("Y"), q, F.lit("-"), (F.col("l_quantity").cast("bigint") + 4)))
            .when(m == 2, F.concat(F.lit("Y_GE"), q)).otherwise("TOTAL"))
    d = t.lineitem.select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    b = S.age_bounds("code")
    return d.select("code", b["lo"].alias("lo"), b["hi"].alias("hi"), "n")


@query("fn2_band", """
SELECT CASE WHEN p_size <= 8 THEN '0-8' WHEN p_size <= 14 THEN '9-14' WHEN p_size <= 24 THEN '15-24'
  WHEN p_size <= 34 THEN '25-34' WHEN p_size <= 49 THEN '35-49' ELSE '50-64' END AS band,
  CASE WHEN p_size >= 75 THEN 'Y_GE75' ELSE 'Y' || (p_size // 5 * 5) || '-' || (p_size // 5 * 5 + 4) END AS five,
  CASE WHEN p_size <= 14 THEN 'Y0-14' WHEN p_size <= 64 THEN 'Y15-64' ELSE 'Y_GE65' END AS macro,
  CAST(1 + (SELECT count(*) FROM (VALUES (2),(5),(10),(13),(15),(17),(19),(24),(34),(44),(54),(59),(64),(74),(200)) b(u)
   WHERE p_size > u) AS INT) AS klass, count(*) AS n FROM part GROUP BY ALL""")
def _(t):
    return (t.part.select(S.band_of("p_size").alias("band"), S.five_year("p_size").alias("five"),
                          S.macro_age("p_size").alias("macro"), S.survey_age_class("p_size").alias("klass"))
            .groupBy("band", "five", "macro", "klass").agg(F.count("*").alias("n")))


PART_LADDER = [(["ring", "gear"], "round"), (["small", "tiny"], "little"), (["red", "blue"], "tinted")]


@query("fn3_label_ladder", """
SELECT CASE WHEN contains(lower(p_name), 'bolt') THEN NULL
  WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'round'
  WHEN contains(lower(p_name), 'small') OR contains(lower(p_name), 'tiny') THEN 'little'
  WHEN contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') THEN 'tinted'
  ELSE '?' || p_name END AS level, count(*) AS n FROM part GROUP BY 1""")
def _(t):
    return (t.part.select(S.contains_ladder("p_name", PART_LADDER, "bolt").alias("level"))
            .groupBy("level").agg(F.count("*").alias("n")))


PRIORITY = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "mid", "5-LOW": "low"}


@query("fn4_code_map", """
SELECT o_orderpriority AS code, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
  WHEN '3-MEDIUM' THEN 'mid' WHEN '5-LOW' THEN 'low' END AS value, count(*) AS n,
  o_orderpriority = '4-NOT SPECIFIED' AS unmapped FROM orders GROUP BY ALL""")
def _(t):
    d = t.orders.groupBy(F.col("o_orderpriority").alias("code")).agg(F.count("*").alias("n"))
    v = S.mapped("code", PRIORITY)
    return d.select("code", v.alias("value"), "n", v.isNull().alias("unmapped"))


@query("fn5_zone_code", """
SELECT raw, CASE WHEN z = '' THEN '0' ELSE z END AS zone FROM (
 SELECT raw, regexp_replace(CASE WHEN s LIKE '37006_%' THEN substr(s, 6) ELSE s END, '^0+', '') AS z FROM (
  SELECT raw, regexp_replace(trim(raw), '\\.0$', '') AS s FROM (
   SELECT CASE c_custkey % 3 WHEN 0 THEN '37006' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0')
     WHEN 1 THEN c_nationkey || '.0' ELSE ' 0' || c_nationkey END AS raw FROM customer)))""")
def _(t):
    k = F.col("c_nationkey").cast("string")
    m = F.col("c_custkey") % 3
    raw = (F.when(m == 0, F.concat(F.lit("37006"), F.lpad(k, 3, "0")))
           .when(m == 1, F.concat(k, F.lit(".0"))).otherwise(F.concat(F.lit(" 0"), k)))
    return t.customer.select(raw.alias("raw")).select("raw", S.zone_code("raw", "37006").alias("zone"))


@query("fn6_six_digits", """
SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code,
  substr(lpad(CAST(c_custkey AS VARCHAR), 6, '0'), 1, 3) AS prov FROM customer""")
def _(t):
    return t.customer.select("c_custkey", S.six_digits("c_custkey").alias("code")).withColumn("prov", S.province("code"))


@query("fn7_plain_name", """
SELECT doc_id, length(n) AS len, md5(n) AS digest FROM (
 SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS n FROM documents)""")
def _(t):
    return (t.documents.select("doc_id", S.plain_name("text").alias("n"))
            .select("doc_id", F.length("n").cast("bigint").alias("len"), F.md5("n").alias("digest")))


@query("fn8_coordinate", """
SELECT c_custkey, c_acctbal AS parsed FROM customer""")
def _(t):
    f = F.format_string("%.2f", "c_acctbal")
    raw = F.concat(F.lit(" "), F.regexp_replace(f, r"\.", ","), F.lit(" "))
    return t.customer.select("c_custkey", S.coordinate(raw).alias("parsed"))


@query("fn9_resolve_label", """
WITH lab AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'Nation ' || c_nationkey WHEN 1 THEN 'ex-' || c_nationkey
   WHEN 2 THEN 'Stateless' ELSE 'nation-' || (c_nationkey + 3) END AS label, c_nationkey AS k FROM customer)
SELECT c_custkey, label, CASE WHEN k % 5 IN (0, 1) THEN k WHEN k % 5 = 2 THEN NULL
   WHEN k + 3 <= 24 THEN k + 3 END AS code FROM lab""")
def _(t):
    k, m = F.col("c_nationkey"), F.col("c_nationkey") % 5
    lab = (F.when(m == 0, F.concat(F.lit("Nation "), k)).when(m == 1, F.concat(F.lit("ex-"), k))
           .when(m == 2, "Stateless").otherwise(F.concat(F.lit("nation-"), k + 3)))
    syn = t.nation.select(F.concat(F.lit("ex"), "n_nationkey").alias("name"), S.plain_name("n_name").alias("same_as"))
    ref = t.nation.select(S.plain_name("n_name").alias("name"), F.col("n_nationkey").alias("code"))
    return S.resolve_labels(t.customer.select("c_custkey", lab.alias("label")), "label", syn, ref, ["stateless"])


@query("fn10_rule_routing", """
WITH g AS (SELECT o_orderkey, CAST(substr(c, 1, 3) AS VARCHAR) AS g1, substr(c, 4, 3) AS g2 FROM (
 SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS c FROM orders))
SELECT o_orderkey, CASE WHEN g1 IN ('000', '001') AND g2 LIKE '1%' THEN 'first'
  WHEN g1 IN ('001', '002') THEN 'second' WHEN g2 LIKE '9%' OR g2 LIKE '8%' THEN 'third' END AS category FROM g""")
def _(t):
    g = S.three_digit_groups("o_orderkey")
    d = t.orders.select("o_orderkey", F.get(g, F.lit(0)).alias("g1"), F.get(g, F.lit(1)).alias("g2"))
    g2 = F.col("g2")
    rules = [(F.col("g1").isin("000", "001") & g2.startswith("1"), "first"), (F.col("g1").isin("001", "002"), "second"),
             (g2.startswith("9") | g2.startswith("8"), "third")]
    return d.select("o_orderkey", S.first_rule(rules).alias("category"))


@query("fn11_repertoire_routing", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'fast_done'
  WHEN o_orderstatus IN ('O', 'P') THEN 'open' ELSE 'rest' END AS target,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
    THEN 'o_orderstatus=F, o_orderpriority=' || o_orderpriority
  WHEN o_orderstatus IN ('O', 'P') THEN 'o_orderstatus=' || o_orderstatus ELSE 'default' END AS reason FROM orders""")
def _(t):
    target, reason = S.routed([({"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}, "fast_done"),
                               ({"o_orderstatus": ["O", "P"]}, "open"), ({}, "rest")])
    return t.orders.select("o_orderkey", target.alias("target"), reason.alias("reason"))


@query("fn12_readable_title", """
WITH a AS (SELECT p_partkey, trim(regexp_replace('  Gruppo   ' || p_name || ' ind.', '\\s+', ' ', 'g')) AS s,
   p_partkey % 3 AS m, p_name FROM part),
b AS (SELECT p_partkey, CASE m WHEN 0 THEN s WHEN 1 THEN 'corso di ' || p_name ELSE p_name END AS t0 FROM a),
c AS (SELECT p_partkey, CASE WHEN instr(t0, 'ind.') > 0 THEN replace(t0, 'ind.', 'industriale') ELSE t0 END AS t1 FROM b),
d AS (SELECT p_partkey, CASE WHEN starts_with(lower(t1), 'corso di ') THEN substr(t1, 10) ELSE t1 END AS t2 FROM c),
e AS (SELECT p_partkey, CASE WHEN starts_with(lower(t2), 'gruppo ') THEN 'discipline ' ||
   CASE WHEN substr(t2, 8) = 'red ring industriale' THEN 'anelli rossi' ELSE substr(t2, 8) END ELSE t2 END AS t3 FROM d)
SELECT p_partkey, CASE WHEN t3 = 'old bolt' THEN 'bullone' ELSE t3 END AS title FROM e""")
def _(t):
    m = F.col("p_partkey") % 3
    raw = (F.when(m == 0, F.concat(F.lit("  Gruppo   "), "p_name", F.lit(" ind.")))
           .when(m == 1, F.concat(F.lit("corso di "), "p_name")).otherwise(F.col("p_name")))
    return t.part.select("p_partkey", S.readable_title(raw, {"ind.": "industriale"}, ["corso di "],
                         {"red ring industriale": "anelli rossi"}, {"old bolt": "bullone"}).alias("title"))


@query("fn13_title_classes", """
SELECT p_type, CASE WHEN contains(lower(p_type), 'economy') OR contains(lower(p_type), 'small') THEN 'base'
  WHEN contains(lower(p_type), 'medium') OR contains(lower(p_type), 'standard') THEN 'middle'
  WHEN contains(lower(p_type), 'large') THEN 'high' ELSE '?' || p_type END AS klass, count(*) AS n FROM part GROUP BY ALL""")
def _(t):
    lad = [(["economy", "small"], "base"), (["medium", "standard"], "middle"), (["large"], "high")]
    d = t.part.groupBy("p_type").agg(F.count("*").alias("n"))
    return d.select("p_type", S.contains_ladder("p_type", lad).alias("klass"), "n")


@query("fn14_rating", """
WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN CAST((conv_id + turn) % 13 AS VARCHAR)
  WHEN 1 THEN text ELSE 'dico ' || ((conv_id * 7 + turn) % 120) || ' su 100' END AS raw FROM conversations),
r AS (SELECT *, CAST(nullif(regexp_extract(raw, '\\b(10|[0-9])\\b', 1), '') AS INT) AS v10,
  CAST(nullif(regexp_extract(raw, '\\b(100|[0-9]{1,2})\\b', 1), '') AS INT) AS v100,
  regexp_replace(lower(trim(raw)), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS b FROM a)
SELECT conv_id, turn, v10, coalesce(b = CAST(v10 AS VARCHAR), false) AS clean10, v100,
  coalesce(b = CAST(v100 AS VARCHAR), false) AS clean100 FROM r""")
def _(t):
    m = F.col("turn") % 3
    raw = (F.when(m == 0, ((F.col("conv_id") + F.col("turn")) % 13).cast("string")).when(m == 1, F.col("text"))
           .otherwise(F.concat(F.lit("dico "), (F.col("conv_id") * 7 + F.col("turn")) % 120, F.lit(" su 100"))))
    d = t.conversations.select("conv_id", "turn", raw.alias("raw"))
    (a, ca), (b, cb) = S.rating("raw", 10), S.rating("raw", 100)
    return d.select("conv_id", "turn", a.alias("v10"), ca.alias("clean10"), b.alias("v100"), cb.alias("clean100"))


OPTIONS = ["the way", "eren um", "que lo", "ou"]


@query("fn15_choice", """
WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN ' The Way! ' ELSE text END AS raw FROM conversations),
b AS (SELECT *, regexp_replace(lower(trim(raw)), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS b FROM a)
SELECT conv_id, turn, coalesce(
  CASE b WHEN 'the way' THEN 'the way' WHEN 'eren um' THEN 'eren um' WHEN 'que lo' THEN 'que lo' WHEN 'ou' THEN 'ou' END,
  CASE WHEN contains(b, 'the way') THEN 'the way' WHEN contains(b, 'eren um') THEN 'eren um'
   WHEN contains(b, 'que lo') THEN 'que lo' WHEN contains(b, 'ou') THEN 'ou' END,
  CASE WHEN contains(b, 'the') THEN 'the way' WHEN contains(b, 'eren') THEN 'eren um'
   WHEN contains(b, 'que') THEN 'que lo' WHEN contains(b, 'ou') THEN 'ou' END) AS value,
  b IN ('the way', 'eren um', 'que lo', 'ou') AS clean FROM b""")
def _(t):
    raw = F.when(F.col("conv_id") % 9 == 0, " The Way! ").otherwise(F.col("text"))
    v, ok = S.choice("raw", OPTIONS)
    return t.conversations.select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", v.alias("value"), ok.alias("clean"))


@query("fn16_toponym_core", """
SELECT doc_id, length(k) AS len, md5(k) AS digest FROM (SELECT doc_id, array_to_string(list_filter(
  string_split_regex(upper(replace(text, 'ß', 'SS')), '[^\\p{L}0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ('THE', 'QUE', 'AND')), ' ') AS k FROM documents)""")
def _(t):
    return (t.documents.select("doc_id", S.toponym_core("text", ["THE", "QUE", "AND"]).alias("k"))
            .select("doc_id", F.length("k").cast("bigint").alias("len"), F.md5("k").alias("digest")))


@query("fn17_profile_text", """
SELECT c_custkey, concat_ws(' ', 'Sei ' || c_name || ', ' || CASE WHEN c_custkey % 2 = 0 THEN 'donna' ELSE 'uomo' END || '.',
  CASE WHEN c_acctbal > 0 THEN 'Lavoro: ' || replace(lower(c_mktsegment), '_', ' ') || '.' END,
  'Vivi nel quartiere ' || n_name || '.',
  CASE WHEN r_name <> 'EUROPE' THEN 'Hai cittadinanza straniera, ' || r_name || '.' END) AS profile
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    d = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    c = F.concat
    return d.select("c_custkey", S.sentence(
        c(F.lit("Sei "), "c_name", F.lit(", "), F.when(F.col("c_custkey") % 2 == 0, "donna").otherwise("uomo"), F.lit(".")),
        F.when(F.col("c_acctbal") > 0, c(F.lit("Lavoro: "), F.regexp_replace(F.lower("c_mktsegment"), "_", " "), F.lit("."))),
        c(F.lit("Vivi nel quartiere "), "n_name", F.lit(".")),
        F.when(F.col("r_name") != "EUROPE", c(F.lit("Hai cittadinanza straniera, "), "r_name", F.lit(".")))).alias("profile"))


@query("fn18_display", r"""
SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END AS whole,
  substr(p_type, 1, 1) || lower(substr(p_type, 2)) AS title,
  CASE WHEN length(p_name) <= 8 THEN p_name ELSE regexp_replace(substr(p_name, 1, 8), '\s+\S*$', '') || '…' END AS cut FROM part""")
def _(t):
    return t.part.select("p_partkey", S.whole_number("p_retailprice").alias("whole"), S.title_case("p_type").alias("title"),
                         S.cut_at_word("p_name", 8).alias("cut"))


@query("fn19_rotation", """
WITH a AS (SELECT conv_id, turn, CAST(turn % 4 AS INT) AS r, CAST(conv_id % 5 AS INT) AS k FROM conversations)
SELECT conv_id, turn, CASE r WHEN 0 THEN 'a,b,c,d' WHEN 1 THEN 'b,c,d,a' WHEN 2 THEN 'c,d,a,b' ELSE 'd,a,b,c' END AS shown,
  CASE WHEN k < 4 THEN CAST((k - r + 4) % 4 + 1 AS BIGINT) END AS pos FROM a""")
def _(t):
    opts = ["a", "b", "c", "d"]
    ans = F.get(F.array(*map(F.lit, opts + ["e"])), (F.col("conv_id") % 5).cast("int"))
    return t.conversations.select("conv_id", "turn", F.array_join(S.rotated(opts, "turn"), ",").alias("shown"),
                                  S.shown_position(opts, "turn", ans).alias("pos"))


@query("fn20_hash_draw", f"SELECT o_orderkey, {draw_sql('age', 'o_orderkey')} AS u FROM orders")
def _(t):
    return t.orders.select("o_orderkey", draw("age", "o_orderkey").alias("u"))


@query("fn21_dictionary_code", """
WITH s AS (SELECT c_mktsegment AS cat, row_number() OVER (ORDER BY c_mktsegment) - 1 AS ord FROM (SELECT DISTINCT c_mktsegment FROM customer)),
p AS (SELECT o_orderpriority AS cat, row_number() OVER (ORDER BY o_orderpriority) - 1 AS ord FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'))
SELECT CAST(s.ord * 4 + p.ord AS BIGINT) AS cell, p.ord IS NULL AS unmapped, count(*) AS n FROM orders
 JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON s.cat = c_mktsegment LEFT JOIN p ON p.cat = o_orderpriority GROUP BY ALL""")
def _(t):
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    known = t.orders.filter("o_orderpriority <> '5-LOW'")
    e = S.encode(d, {"c_mktsegment": S.dictionary(t.customer, "c_mktsegment"), "o_orderpriority": S.dictionary(known, "o_orderpriority")})
    return (e.select(S.mixed_radix(["c_mktsegment_ord", "o_orderpriority_ord"], [5, 4]).alias("cell"),
                     F.col("o_orderpriority_ord").isNull().alias("unmapped"))
            .groupBy("cell", "unmapped").agg(F.count("*").alias("n")))


@query("fn22_value_translation", """
SELECT n_name AS value, CASE WHEN n_nationkey % 4 <> 3 THEN 'N' || n_nationkey END AS source_value, count(*) AS n,
  sum(CASE WHEN n_nationkey % 4 = 3 THEN 1 ELSE 0 END)::BIGINT AS uncovered FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def _(t):
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("value"))
    table = t.nation.filter("n_nationkey % 4 <> 3").select(F.col("n_name").alias("src"), F.concat(F.lit("N"), "n_nationkey").alias("dst"))
    return (S.translated(d, "value", table, "source_value").groupBy("value", "source_value")
            .agg(F.count("*").alias("n"), F.sum(F.col("source_value").isNull().cast("bigint")).alias("uncovered")))
