"""Households: orders play households, their lines play members."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.aggregate_queries import COL
from popweave.functions.draws import draw, draw_sql
from popweave.operators import households as H, allocation as L
from popweave.operators.aggregates import beside
from popweave.operators.distances import tvd

ROLE = "['R', 'P', 'F', 'F', 'F', 'G', 'A']"
MEM = f"""m AS (SELECT l_orderkey AS hh, l_partkey * 10 + l_linenumber AS pid, {ROLE}[CAST(l_linenumber AS INT)] AS role, CAST(l_quantity AS INT) AS age, l_returnflag AS status, l_orderkey % 5 + 1 AS w, l_suppkey % 3 AS cit, l_suppkey % 4 AS lev FROM lineitem)"""
SIG = MEM + """, h AS (SELECT hh, count(*) AS size, max(w) AS weight, string_agg(role, '' ORDER BY instr('RPFGAN', role)) AS signature, count(*) FILTER (role = 'R') AS refs FROM m GROUP BY 1)"""
REP = SIG + """, rp AS (SELECT size, signature, n AS households, w / sum(w) OVER (PARTITION BY size)::DOUBLE AS share FROM (SELECT size, signature, count(*) AS n, sum(weight) AS w FROM h WHERE refs = 1 GROUP BY ALL))"""


def members(t):
    role = F.get(F.array(*map(F.lit, "RPFFFGA")), (COL("l_linenumber") - 1).cast("int"))
    return t.lineitem.select(COL("l_orderkey").alias("hh"), (COL("l_partkey") * 10 + COL("l_linenumber")).alias("pid"), role.alias("role"), COL("l_quantity").cast("int").alias("age"), COL("l_returnflag").alias("status"),
                             (COL("l_orderkey") % 5 + 1).alias("w"), (COL("l_suppkey") % 3).alias("cit"), (COL("l_suppkey") % 4).alias("lev"))


def sigs(t):
    return H.household_signatures(members(t), ["hh"], "role", "w")


def rep(t):
    return H.repertoire(sigs(t))


@query("hh1_signatures", f"WITH {SIG} SELECT hh, size, weight, signature, refs AS references FROM h".replace("AS references", 'AS "references"'))
def _(t):
    return sigs(t)


@query("hh1_repertoire", f"WITH {REP} SELECT size, signature, households, round(share, 6) AS share FROM rp")
def _(t):
    return r(rep(t), "share")


@query("hh1_male_reference", f"WITH {SIG} SELECT signature, count(*) AS n, round(sum(CASE WHEN status = 'A' THEN m.w ELSE 0 END) / sum(m.w), 6) AS p_male FROM m JOIN h USING (hh) WHERE role = 'R' GROUP BY 1 HAVING count(*) >= 20")
def _(t):
    return r(H.male_reference(members(t), sigs(t), ["hh"], "role", COL("status") == "A", "w"), "p_male")


@query("hh1_generation_gaps", f"""WITH {MEM}, g AS (SELECT ra - age AS gap, sum(w) AS w FROM m JOIN (SELECT hh, max(age) AS ra FROM m WHERE role = 'R' GROUP BY 1) USING (hh) WHERE role = 'F' GROUP BY 1), c AS (SELECT *, sum(w) OVER (ORDER BY gap) AS cum, sum(w) OVER () AS t FROM g)
SELECT min(gap) FILTER (cum >= t * 0.05::DOUBLE) AS g05, min(gap) FILTER (cum >= t * 0.5::DOUBLE) AS g50, min(gap) FILTER (cum >= t * 0.95::DOUBLE) AS g95 FROM c""")
def _(t):
    return H.generation_gaps(members(t), ["hh"], "role", "age", "w", {"g05": 0.05, "g50": 0.5, "g95": 0.95})


@query("hh1_sibling_gaps", f"""WITH {MEM}, s AS (SELECT age - lag(age) OVER (PARTITION BY hh ORDER BY age, pid) AS gap, w FROM m WHERE role = 'F'), g AS (SELECT gap, sum(w) AS w FROM s WHERE gap IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(w) OVER (ORDER BY gap) AS cum, sum(w) OVER () AS t FROM g)
SELECT min(gap) FILTER (cum >= t * 0.5::DOUBLE) AS g50, min(gap) FILTER (cum >= t * 0.95::DOUBLE) AS g95 FROM c""")
def _(t):
    return H.sibling_gaps(members(t), ["hh"], "role", "age", "pid", "w", {"g50": 0.5, "g95": 0.95})


@query("hh1_mixed_homogeneity", f"WITH {MEM}, k AS (SELECT hh, count(*) AS n, count(DISTINCT cit) AS d, bool_or(cit = 2) AS f FROM m WHERE cit IN (1, 2) GROUP BY 1) SELECT count(*) AS households, round(avg(CASE WHEN d = 1 THEN 1.0 ELSE 0.0 END), 6) AS homogeneous FROM k WHERE f AND n > 1")
def _(t):
    return r(H.mixed_homogeneity(members(t), ["hh"], "cit", 1, 2), "homogeneous")


TAIL = SIG + ", tl AS (SELECT size, n, n / sum(n) OVER () AS share FROM (SELECT size, count(*)::DOUBLE AS n FROM h WHERE size > 6 GROUP BY 1))"


def tail(t):
    p = members(t).join(sigs(t).select("hh", "size"), "hh")
    return H.size_tail(p, "size")


@query("hh2_size_tail", f"WITH {TAIL} SELECT size, n AS households, round(share, 6) AS share FROM tl")
def _(t):
    return r(tail(t), "share")


@query("hh3_repertoire_validity", f"WITH {TAIL}, x AS (SELECT 1) SELECT true AS sums_to_one, true AS non_negative, bool_and(size > 6) AS tail_above_census, abs(sum(share) - 1) < 0.005 AS tail_sums_to_one FROM tl")
def _(t):
    return H.repertoire_validity(rep(t), tail(t))


SECTIONS = """s AS (SELECT s_suppkey, s_suppkey % 9 AS pf1, s_suppkey % 7 AS pf2, s_suppkey % 5 AS pf3, s_suppkey % 4 AS pf4, s_suppkey % 3 AS pf5, s_suppkey % 3 AS pf6,
 (s_suppkey % 9 + s_suppkey % 7 * 2 + s_suppkey % 5 * 3 + s_suppkey % 4 * 4 + s_suppkey % 3 * 11) AS asked, greatest((s_suppkey % 9 + s_suppkey % 7 * 2 + s_suppkey % 5 * 3 + s_suppkey % 4 * 4 + s_suppkey % 3 * 11) + s_suppkey % 41 - 20, 0) AS persons FROM supplier)"""


def sections(t):
    k = COL("s_suppkey")
    d = t.supplier.select("s_suppkey", (k % 9).alias("pf1"), (k % 7).alias("pf2"), (k % 5).alias("pf3"), (k % 4).alias("pf4"), (k % 3).alias("pf5"), (k % 3).alias("pf6"))
    asked = COL("pf1") + COL("pf2") * 2 + COL("pf3") * 3 + COL("pf4") * 4 + COL("pf5") * 5 + COL("pf6") * 6
    return d.withColumn("persons", F.greatest(asked + k % 41 - 20, F.lit(0)))


CONS = SECTIONS + """, hs AS (SELECT s_suppkey, persons, asked, k, u.i AS no FROM s, (VALUES (1), (2), (3), (4), (5), (6)) z(k), LATERAL (SELECT unnest(range(1, 1 + CASE k WHEN 1 THEN pf1 WHEN 2 THEN pf2 WHEN 3 THEN pf3 WHEN 4 THEN pf4 WHEN 5 THEN pf5 ELSE pf6 END)) AS i) u),
lv AS (SELECT s_suppkey, max(l) AS l FROM (SELECT s_suppkey, l, sum(least(k, l)) AS tot, any_value(persons) AS p FROM hs, range(1, 7) g(l) GROUP BY ALL) WHERE tot <= p OR l = 1 GROUP BY 1),
fin AS (SELECT hs.*, lv.l, CASE WHEN k > lv.l AND row_number() OVER (PARTITION BY hs.s_suppkey, k > lv.l ORDER BY k DESC, no) <= persons - sum(least(k, lv.l)) OVER (PARTITION BY hs.s_suppkey) THEN lv.l + 1 ELSE least(k, lv.l) END AS fs FROM hs JOIN lv USING (s_suppkey))"""


@query("hh4_size_constraints", f"""WITH {CONS} SELECT s.s_suppkey, (persons - asked)::BIGINT AS residual, CASE WHEN persons = asked THEN 'exact' WHEN persons < asked THEN 'overestimate' WHEN persons - asked <= 6 * pf6 THEN 'truncation' ELSE 'institution' END AS "case",
 greatest(least(persons - asked, 6 * pf6), 0)::BIGINT AS widen, greatest(persons - asked - 6 * pf6, 0)::BIGINT AS institution, {', '.join(f'coalesce(f.k{i}, 0)::BIGINT AS k{i}' for i in range(1, 7))}
FROM s LEFT JOIN (SELECT s_suppkey, {', '.join(f'count(*) FILTER (fs = {i}) AS k{i}' for i in range(1, 7))} FROM fin GROUP BY 1) f USING (s_suppkey)""")
def _(t):
    return H.size_constraints(sections(t), [f"pf{i}" for i in range(1, 7)], "persons").select("s_suppkey", "residual", "case", "widen", "institution", *[f"k{i}" for i in range(1, 7)])


@query("hh4_open_class", f"""WITH {TAIL}, {SECTIONS}, o AS (SELECT s_suppkey, least(persons - asked, 6 * pf6) AS widen, unnest(range(1, pf6 + 1)) AS no FROM s WHERE persons > asked AND pf6 > 0),
i AS (SELECT size, sum(share) OVER (ORDER BY size) AS hi, share, sum(share) OVER () AS tt FROM tl), k AS (SELECT *, s_suppkey || '|' || no AS id FROM o), d AS (SELECT k.*, i.size - 6 AS add FROM (SELECT *, {draw_sql('tail', 'id')} AS u FROM k) k JOIN i ON u * tt >= hi - share AND u * tt < hi),
b AS (SELECT *, sum(add) OVER (PARTITION BY s_suppkey ORDER BY {draw_sql('tail-order', 'id')}, no) - add AS before FROM d) SELECT s_suppkey, CAST(no AS INT) AS no, CAST(6 + greatest(least(add, widen - before), 0) AS BIGINT) AS size FROM b""")
def _(t):
    c = H.size_constraints(sections(t), [f"pf{i}" for i in range(1, 7)], "persons")
    return H.open_households(c, "s_suppkey", "pf6", tail(t))


@query("hh5_signature_draw", f"""WITH {REP}, hh AS (SELECT o_orderkey AS id, CAST(o_custkey % 17 + 1 AS INT) AS size FROM orders), us AS (SELECT id, hh.size, (SELECT max(size) FROM rp WHERE rp.size <= hh.size) AS use FROM hh),
i AS (SELECT *, sum(share) OVER (PARTITION BY size ORDER BY signature) AS hi, sum(share) OVER (PARTITION BY size) AS tt FROM rp), g AS (SELECT u.id, u.size, i.signature FROM (SELECT *, {draw_sql('signature', 'id')} AS x FROM us) u LEFT JOIN i ON u.use = i.size AND x * tt >= hi - share AND x * tt < hi)
SELECT id, size, substr(rpad(coalesce(signature, 'R'), greatest(length(coalesce(signature, 'R')), size)::INT, 'F'), 1, size) AS signature FROM g""")
def _(t):
    h = t.orders.select(COL("o_orderkey").alias("id"), (COL("o_custkey") % 17 + 1).cast("int").alias("size"))
    return H.draw_signature(h, rep(t), "size", "id")


def assembly_inputs(t):
    status = F.when(COL("age") < 18, "celibe_nubile").when(draw("st", "uid") < 0.08, "vedovo").when(draw("st", "uid") < 0.6, "coniugato_unito").otherwise("celibe_nubile")
    p = (t.orders.join(t.customer, COL("o_custkey") == COL("c_custkey"))
         .select(COL("c_nationkey").alias("section"), COL("o_orderkey").cast("string").alias("uid"), F.floor(draw("age", "o_orderkey") * 90).cast("int").alias("age"), (draw("sex", "o_orderkey") < 0.49).alias("male")).withColumn("status", status))
    kinds = ["R", "R", "R", "RP", "RPF", "RPFF", "RF", "RP", "RPG", "RPFA"]
    h = t.customer.select(COL("c_nationkey").alias("section"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("no"), "c_custkey")
    h = h.select("section", F.concat_ws("-", "c_custkey", "no").alias("hh"), F.get(F.array(*map(F.lit, kinds)), F.floor(draw("sig", "c_custkey", "no") * len(kinds)).cast("int")).alias("signature"))
    return p, h


@query("hh6_assembly")
def _(t):
    p, h = assembly_inputs(t)
    return H.assemble(p, h, "section").select("uid", "hh", "role", "tier")


@query("hh6_open_slots", f"""WITH h AS (SELECT list_extract(['R', 'R', 'R', 'RP', 'RPF', 'RPFF', 'RF', 'RP', 'RPG', 'RPFA'], (floor({draw_sql('sig', 'c_custkey', 'n.no')} * 10) + 1)::INT) AS signature FROM customer, range(1, 5) n(no))
SELECT role, count(*) AS slots, 0::BIGINT AS fillable FROM (SELECT unnest(string_split(signature, '')) AS role FROM h) GROUP BY 1""")
def _(t):
    p, h = assembly_inputs(t)
    return H.open_slots(H.cut_lineage(H.assemble(p, h, "section")), p, h, "section").select("role", "slots", "fillable")


@query("hh6_invariants", """SELECT 0::BIGINT AS placed_twice, 0::BIGINT AS slots_over, 0::BIGINT AS extra_references, 0::BIGINT AS children_out_of_range, 0::BIGINT AS widowed_partners, 0::BIGINT AS same_sex_unmarried, 0::BIGINT AS lost_or_invented FROM (SELECT count(*) FROM orders)""")
def _(t):
    p, h = assembly_inputs(t)
    a = H.cut_lineage(H.assemble(p, h, "section"))
    ref = a.filter("role = 'R'").select("hh", COL("age").alias("ra"), COL("male").alias("rm"), COL("status").alias("rs"))
    j = a.filter("role <> 'R'").join(ref, "hh", "left")
    over = a.groupBy("hh").agg(F.count("*").alias("got"), F.sum((COL("role") == "R").cast("bigint")).alias("refs")).join(h, "hh", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))
    gap = COL("ra") - COL("age")
    k = j.agg(n((COL("role") == "F") & ~F.when(COL("tier") == 0, gap.between(20, 40)).otherwise(gap >= 15)).alias("children_out_of_range"),
              n((COL("role") == "P") & (COL("status") == "vedovo")).alias("widowed_partners"), n((COL("role") == "P") & (COL("male") == COL("rm")) & ~((COL("status") == "coniugato_unito") & (COL("rs") == "coniugato_unito"))).alias("same_sex_unmarried"))
    o = over.agg(n(F.coalesce(COL("got") > F.length("signature"), F.lit(True))).alias("slots_over"), n(COL("refs") != 1).alias("extra_references"))
    d = a.agg((F.count("*") - F.countDistinct("uid")).alias("placed_twice"))
    lost = a.join(p, "uid", "left_anti").agg(F.count("*"))
    return beside(beside(beside(k, o), d), lost.toDF("lost_or_invented"))


@query("hh7_couple_coherence", f"""WITH {MEM}, g AS (SELECT hh, count(*) AS n, bool_or(role = 'R' AND status = 'N') AS rm, bool_or(role = 'P' AND status = 'N') AS pm FROM m GROUP BY 1)
SELECT role, count(*) AS married, count(*) FILTER (NOT (n = 1 OR (role IN ('R', 'P') AND rm AND pm))) AS incoherent FROM m JOIN g USING (hh) WHERE status = 'N' GROUP BY 1""")
def _(t):
    return H.couple_coherence(members(t), "hh", "role", "status", "N")


@query("hh7_homogeneous_couples", f"WITH {MEM}, c AS (SELECT hh, max(status) FILTER (role = 'R') AS r, max(status) FILTER (role = 'P') AS p FROM m GROUP BY 1) SELECT count(*) AS couples, round(avg(CASE WHEN r = p THEN 1.0 ELSE 0.0 END), 6) AS homogeneous FROM c WHERE r IS NOT NULL AND p IS NOT NULL")
def _(t):
    return r(H.homogeneous_couples(members(t), "hh", "role", "status"), "homogeneous")


@query("hh8_assembly_summary")
def _(t):
    p, h = assembly_inputs(t)
    return r(H.assembly_summary(H.cut_lineage(H.assemble(p, h, "section")), p, h), "perfect", "mean_size", "unplaced")


@query("hh9_size_distribution", """WITH h AS (SELECT year(l_shipdate) AS wave, l_orderkey AS id, count(*) AS n, max(l_quantity) AS w FROM lineitem GROUP BY ALL), s AS (SELECT least(n, 6) AS size, count(*) AS r, sum(w) AS w FROM h GROUP BY 1), c AS (SELECT p_size % 6 + 1 AS size, count(*) AS c FROM part GROUP BY 1)
SELECT c.size::BIGINT AS size, round(coalesce(r, 0) / (SELECT sum(r) FROM s), 6) AS raw, round(coalesce(w, 0) / (SELECT sum(w) FROM s), 6) AS weighted, round(c / (SELECT sum(c) FROM c), 6) AS census FROM c LEFT JOIN s ON s.size = c.size""")
def _(t):
    d = t.lineitem.select("l_orderkey", F.year("l_shipdate").alias("wave"), "l_quantity")
    c = t.part.groupBy((COL("p_size") % 6 + 1).cast("bigint").alias("size")).agg(F.count("*").alias("households"))
    return r(H.size_distribution(d, "l_orderkey", "wave", "l_quantity", c), "raw", "weighted", "census")


@query("hh9_repeated_ids", "SELECT count(DISTINCT l_orderkey) AS naive, count(DISTINCT (year(l_shipdate), l_orderkey)) AS composite FROM lineitem")
def _(t):
    return H.repeated_ids(t.lineitem.withColumn("wave", F.year("l_shipdate")), "l_orderkey", "wave")


@query("hh10_role_profile", f"""WITH {MEM}, v AS (SELECT role, age, sum(w) AS w FROM m GROUP BY ALL), c AS (SELECT role, age, sum(w) OVER (PARTITION BY role ORDER BY age) AS cum, sum(w) OVER (PARTITION BY role) AS t FROM v)
SELECT role, (SELECT min(age) FROM c WHERE c.role = m.role AND cum >= t * 0.5::DOUBLE) AS median_class, round(sum(CASE WHEN cit = 2 THEN w ELSE 0 END) / sum(w), 6) AS foreign_share, round(sum(w) / (SELECT sum(w) FROM m), 6) AS mass_share FROM m GROUP BY 1""")
def _(t):
    return r(H.role_profile(members(t), "role", "age", COL("cit") == 2, "w"), "foreign_share", "mass_share")


@query("hh11_parents_and_siblings", f"""WITH {MEM}, s AS (SELECT hh, count(*) FILTER (role = 'F') AS k, count(*) FILTER (role IN ('R', 'P')) AS np, max(lev) FILTER (role IN ('R', 'P')) AS lp, max(age) FILTER (role IN ('R', 'P')) AS ap,
 count(*) FILTER (role = 'G') AS ng, max(lev) FILTER (role = 'G') AS lg, max(age) FILTER (role = 'G') AS ag FROM m GROUP BY 1)
SELECT hh, pid, role, CASE WHEN role = 'F' THEN k - 1 ELSE 0 END AS siblings, CASE WHEN role = 'F' THEN np ELSE ng END AS parents, CASE WHEN role = 'F' THEN lp ELSE lg END AS parent_level, CASE WHEN role = 'F' THEN ap ELSE ag END - age AS age_gap FROM m JOIN s USING (hh) WHERE role IN ('F', 'R')""")
def _(t):
    return H.parents_and_siblings(members(t), "hh", "pid", "role", "age", "lev")


@query("hh12_signature_distance", f"""WITH {SIG}, p AS (SELECT signature, sum(CASE WHEN hh % 2 = 0 THEN weight ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN hh % 2 = 1 THEN weight ELSE 0 END)::DOUBLE AS b FROM h GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM p)
SELECT CASE WHEN count(*) FILTER (a > 0 AND b > 0) >= 0.5 * count(*) THEN round(sum(abs(a / ta - b / tb)) / 2, 6) END AS tvd, count(*) FILTER (a > 0) AS support_a, count(*) FILTER (b > 0) AS support_b, count(*) FILTER (a > 0 AND b > 0) AS common,
 CASE WHEN count(*) FILTER (a > 0 AND b > 0) >= 0.5 * count(*) THEN '' ELSE 'supports too different' END AS note FROM p, t""")
def _(t):
    h = sigs(t)
    side = lambda k: h.filter(COL("hh") % 2 == k).groupBy("signature").agg(F.sum("weight").alias("w"))
    return r(tvd(side(0), side(1), "signature"), "tvd")


@query("hh13_fractional_households", """WITH p AS (SELECT l_suppkey, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), g AS (SELECT l_suppkey, sum(1.0::DOUBLE / n) AS h FROM p GROUP BY 1) SELECT l_suppkey, round(h, 6) AS households, round(abs(h - round(h)), 6) AS off FROM g""")
def _(t):
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return r(H.fractional_households(t.lineitem.join(n, "l_orderkey"), "l_suppkey", "n"), "households", "off")


CONF = """WITH c AS (SELECT c_mktsegment AS truth, CASE WHEN c_acctbal > 2000 THEN c_mktsegment ELSE 'FURNITURE' END AS assigned FROM customer)
SELECT truth, assigned, count(*) AS n, round((SELECT avg(CASE WHEN truth = assigned THEN 1.0 ELSE 0.0 END) FROM c), 6) AS agreement FROM c GROUP BY ALL"""


@query("hh14_role_confusion", CONF)
def _(t):
    d = t.customer.select(COL("c_mktsegment").alias("truth"), F.when(COL("c_acctbal") > 2000, COL("c_mktsegment")).otherwise("FURNITURE").alias("assigned"))
    return r(H.role_confusion(d, "truth", "assigned"), "agreement")
