"""Ingestion builders over the given tables."""
from functools import reduce

from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.aggregate_queries import COL, COLS, PROFILE, cust
from popweave.functions.draws import draw, draw_sql
from popweave.operators.aggregates import column_profile
from popweave.sources import normalisers as N
from popweave.session import TABLES

DIST = """WITH d AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN '  ' WHEN p_partkey % 2 = 0 THEN ' ' || p_type ELSE p_type || ' ' END AS k, CASE WHEN p_partkey % 13 = 0 THEN 'n.d.' ELSE ' ' || CAST(p_size AS VARCHAR) END AS w, p_brand FROM part),
x AS (SELECT trim(k) AS k, try_cast(trim(w) AS DOUBLE) AS w, p_brand FROM d)"""


def dist(t):
    k = F.when(COL("p_partkey") % 11 == 0, "  ").when(COL("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_type")).otherwise(F.concat("p_type", F.lit(" ")))
    w = F.when(COL("p_partkey") % 13 == 0, "n.d.").otherwise(F.concat(F.lit(" "), COL("p_size").cast("string")))
    return N.weighted_distribution(t.part.select(k.alias("k"), w.alias("w"), "p_brand"), "k", "w", ["p_brand"])


@query("src1_weighted_distribution", DIST + " SELECT k AS chiave, p_brand, sum(w) AS peso FROM x WHERE w IS NOT NULL AND k <> '' GROUP BY ALL")
def _(t):
    return dist(t)[0]


@query("src1_distribution_metrics", DIST + ", g AS (SELECT k, p_brand, sum(w) AS w, count(*) AS n FROM x WHERE w IS NOT NULL AND k <> '' GROUP BY ALL) SELECT count(*) AS raw_rows, count(*) FILTER (w IS NULL) AS not_numeric, count(*) FILTER (w IS NOT NULL AND k = '') AS blank_rows, coalesce(sum(w) FILTER (k = ''), 0) AS blank_weight, (SELECT count(*) FROM g) AS categories, (SELECT sum(w) FROM g) AS n, (SELECT sum(n) - count(*) FROM g)::BIGINT AS merged FROM x")
def _(t):
    return dist(t)[1]


def obs(t):
    return t.orders.select(COL("o_orderstatus").alias("flow"), (COL("o_custkey") % 40).alias("area"), F.year("o_orderdate").alias("TIME_PERIOD"),
                           F.when(COL("o_orderkey") % 50 == 0, ":").otherwise(F.floor("o_totalprice").cast("string")).alias("OBS_VALUE"))


OBS = "WITH o AS (SELECT o_orderstatus AS flow, o_custkey % 40 AS area, CAST(year(o_orderdate) AS INT) AS yr, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE floor(o_totalprice) END AS v FROM orders) "


@query("src2_sdmx_years", OBS + 'SELECT yr AS "TIME_PERIOD", count(*) AS rows, sum(v) AS total FROM o GROUP BY 1')
def _(t):
    return N.sdmx_profile(obs(t), "flow", "area", "TIME_PERIOD", "OBS_VALUE")[0]


@query("src2_sdmx_metrics", OBS + "SELECT count(*) AS rows, count(DISTINCT flow) AS flows, count(DISTINCT area) AS areas, CAST(min(yr) AS VARCHAR) AS first, CAST(max(yr) AS VARCHAR) AS last, sum(v) AS total, count(*) FILTER (v IS NULL) AS not_numeric FROM o")
def _(t):
    return N.sdmx_profile(obs(t), "flow", "area", "TIME_PERIOD", "OBS_VALUE")[1]


@query("src3_decode_codes", "SELECT c_custkey, c_nationkey, n_name AS c_nationkey_label, c_custkey % 7 AS reg, r_name AS reg_label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = c_custkey % 7")
def _(t):
    d = t.customer.select("c_custkey", "c_nationkey", (COL("c_custkey") % 7).alias("reg"))
    return N.decode_codes(d, {"c_nationkey": t.nation.select(COL("n_nationkey").alias("code"), COL("n_name").alias("label")), "reg": t.region.select(COL("r_regionkey").cast("bigint").alias("code"), COL("r_name").alias("label"))})


@query("src4_wide_units_profile", """WITH u AS (SELECT c_custkey % 400 AS unit, count(*) AS c, sum(CASE WHEN c_acctbal > 0 AND c_custkey % 5 > 0 THEN c_custkey % 5 ELSE 0 END) AS p, min(c_custkey % 400 % 25) AS pl FROM customer GROUP BY 1)
SELECT sum(c)::BIGINT AS rows, count(*) AS units, sum(c - 1)::BIGINT AS repeats, count(DISTINCT pl) AS places, sum(p)::BIGINT AS population, count(*) FILTER (p = 0) AS empty, CAST(2 AS INT) AS columns_p, CAST(1 AS INT) AS columns_st FROM u""")
def _(t):
    k = COL("c_custkey")
    d = t.customer.select((k % 400).alias("unit"), (k % 400 % 25).alias("place"), F.when((COL("c_acctbal") > 0) & (k % 5 > 0), k % 5).otherwise(0).alias("P1"), F.lit(0).alias("P2"), F.lit(0).alias("ST1"))
    return N.wide_units_profile(d, "unit", "place", "P1", ["P", "ST"])


@query("src5_flat_codebook", "SELECT p_name AS name, min(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END) AS definition FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1")
def _(t):
    d = t.part.select(F.when(COL("p_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("nm"), F.when(COL("p_partkey") % 3 == 0, "").otherwise(COL("p_type")).alias("df"))
    return N.flat_codebook(d, "nm", "df")[0]


@query("src5_codebook_metrics", "SELECT count(*) AS rows, count(*) FILTER (p_partkey % 9 = 0) AS blank_names, count(*) FILTER (p_partkey % 3 = 0) AS blank_definitions, count(*) FILTER (p_partkey % 9 <> 0) - count(DISTINCT p_name) FILTER (p_partkey % 9 <> 0) AS repeats FROM part")
def _(t):
    d = t.part.select(F.when(COL("p_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("nm"), F.when(COL("p_partkey") % 3 == 0, "").otherwise(COL("p_type")).alias("df"))
    return N.flat_codebook(d, "nm", "df")[1]


@query("src6_two_level_codebook", """WITH c AS (SELECT event_type AS field, CASE WHEN event_type = 'view' THEN 'Numero progressivo di riga' WHEN user_id % 10 = 0 THEN 'numerico' WHEN user_id % 10 = 1 THEN NULL ELSE json_extract_string(props, '$.k') END AS code FROM events)
SELECT field, count(*) FILTER (NOT (coalesce(lower(code), '') IN ('', 'numerico') OR coalesce(lower(code), '') LIKE 'numero progressivo%')) AS codes, count(*) FILTER (coalesce(lower(code), '') IN ('', 'numerico') OR coalesce(lower(code), '') LIKE 'numero progressivo%') AS placeholders FROM c GROUP BY 1""")
def _(t):
    code = F.when(COL("event_type") == "view", "Numero progressivo di riga").when(COL("user_id") % 10 == 0, "numerico").when(COL("user_id") % 10 == 1, F.lit(None)).otherwise(F.get_json_object("props", "$.k"))
    return N.two_level_codebook(t.events.select("event_type", code.alias("code"), "props"), "event_type", "code", "props")[1]


@query("src7_microdata_profile", "SELECT count(*) AS rows, CAST(11 AS INT) AS columns, count(DISTINCT l_returnflag) AS regions, min(l_linenumber) AS age_min, max(l_linenumber) AS age_max, round(sum(l_quantity / 10000), 6) AS w_sum, min(l_quantity / 10000) AS w_min, max(l_quantity / 10000) AS w_max, round(sum(l_quantity / 10000) ** 2 / sum((l_quantity / 10000) ** 2), 3) AS n_eff FROM lineitem")
def _(t):
    return r(r(N.microdata_profile(t.lineitem, COL("l_quantity") / 10000, "l_returnflag", "l_linenumber"), "w_sum"), "n_eff", digits=3)


MATRIX = "WITH m AS (SELECT n_name AS category, c_mktsegment AS unit, count(*)::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) "


def matrix(t):
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return N.matrix_to_long(cust(t).groupBy("n_name").pivot("c_mktsegment", segs).count(), "n_name", segs, ["NATION_1", "NATION_2"])


@query("src8_matrix_to_long", MATRIX + "SELECT * FROM m")
def _(t):
    return matrix(t)[0]


@query("src8_matrix_metrics", MATRIX + "SELECT count(*) AS cells, sum(value) AS mass, sum(value) FILTER (category IN ('NATION_1', 'NATION_2')) AS residual, round(sum(value) FILTER (category IN ('NATION_1', 'NATION_2')) / sum(value), 6) AS residual_share FROM m")
def _(t):
    return r(matrix(t)[1], "residual_share")


def grid(t):
    d = cust(t).select(COL("c_mktsegment").alias("label"), COL("n_regionkey").alias("reg"), (COL("c_custkey") % 2).cast("int").alias("sx"))
    lab = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    row = F.array_position(F.array(*map(F.lit, lab)), COL("label")).cast("int") + 1
    body = d.groupBy(row.alias("row"), (COL("reg") * 2 + COL("sx") + 1).alias("col")).agg(F.count("*").cast("string").alias("value"))
    labels = d.select(row.alias("row"), F.lit(0).alias("col"), F.concat(COL("label"), F.lit(" ")).alias("value")).distinct()
    areas = t.region.select(F.lit(0).alias("row"), (COL("r_regionkey") * 2 + 1).alias("col"), COL("r_name").alias("value"))
    blanks = t.region.select(F.lit(0).alias("row"), (COL("r_regionkey") * 2 + 2).alias("col"), F.lit("").alias("value"))
    sexes = t.region.select(F.lit(1).alias("row"), F.explode(F.array(*[F.struct((COL("r_regionkey") * 2 + 1 + i).alias("col"), F.lit(s).alias("value")) for i, s in enumerate("MF")])).alias("x")).select("row", "x.*")
    return N.two_header_grid(body.unionByName(labels).unionByName(areas).unionByName(blanks).unionByName(sexes), ["MACHINERY", "ASIA"])


GRID = "WITH g AS (SELECT c_mktsegment AS label, r_name AS area, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex, count(*)::DOUBLE AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment <> 'MACHINERY' AND r_name <> 'ASIA' GROUP BY ALL) "


@query("src9_two_header_grid", GRID + "SELECT * FROM g")
def _(t):
    return grid(t)[0]


@query("src9_grid_sex_totals", GRID + "SELECT sex, sum(n) AS n FROM g GROUP BY 1")
def _(t):
    return grid(t)[1]


SIDE = """WITH w AS (SELECT l_suppkey % 12 AS unit, l_linenumber, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS f, sum(CASE WHEN l_returnflag = 'R' AND l_linenumber < 6 THEN l_quantity ELSE 0 END) AS m FROM lineitem GROUP BY ALL),
l AS (SELECT unit, l_linenumber, 'F' AS sesso, f AS n FROM w UNION ALL SELECT unit, l_linenumber, 'M', m FROM w) """


def side(t):
    w = t.lineitem.groupBy((COL("l_suppkey") % 12).alias("unit"), "l_linenumber").agg(F.sum(F.when(COL("l_returnflag") == "A", COL("l_quantity")).otherwise(0.0)).alias("f"),
        F.sum(F.when((COL("l_returnflag") == "R") & (COL("l_linenumber") < 6), COL("l_quantity")).otherwise(0.0)).alias("m"))
    return N.side_by_side(w, ["unit", "l_linenumber"], {"F": "f", "M": "m"}, "sesso", "unit", [3, 7], COL("l_linenumber") == 1)


@query("src10_side_by_side", SIDE + "SELECT * FROM l WHERE unit NOT IN (3, 7) AND n <> 0")
def _(t):
    return side(t)[0]


@query("src10_side_metrics", SIDE + "SELECT sum(n) FILTER (unit IN (3, 7)) AS excluded_mass, sum(n) FILTER (unit NOT IN (3, 7)) AS mass, sum(n) FILTER (unit NOT IN (3, 7) AND l_linenumber = 1) AS residual_mass, round(sum(n) FILTER (unit NOT IN (3, 7) AND l_linenumber = 1) / sum(n) FILTER (unit NOT IN (3, 7)), 6) AS residual_share FROM l")
def _(t):
    return r(side(t)[1], "residual_share")


@query("src11_latest_period", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS period FROM orders WHERE o_orderpriority <> '5-LOW' AND year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders WHERE o_orderpriority <> '5-LOW')")
def _(t):
    return N.latest_period(t.orders, F.year("o_orderdate"), COL("o_orderpriority") == "5-LOW").select("o_orderkey", "period")


@query("src12_column_profile", " UNION ALL ".join(PROFILE.format(c=c) for c in COLS))
def _(t):
    return column_profile(t.lineitem, COLS)


@query("src13_nested_reference", "SELECT count(*) AS rows, count(DISTINCT json_extract(props, '$.k')) AS keys, (SELECT count(*) FROM (SELECT json_extract(props, '$.k') AS k FROM events GROUP BY 1 HAVING count(*) > 1)) AS repeated, round(sum(value), 2) AS mass, min(value) AS lo_se, max(value) AS hi_se FROM events")
def _(t):
    doc = F.concat(F.lit('[{"e":'), "props", F.lit(',"v":'), COL("value").cast("string"), F.lit("}]"))
    ref = N.nested_reference(t.events.select(doc.alias("doc")), "doc", "array<struct<e:struct<k:string>,v:double>>", lambda e: e["e"]["k"], lambda e: e["v"], {"se": lambda e: e["v"]})
    return r(N.reference_metrics(ref, ["se"]), "mass", digits=2)


SHARES = "WITH s AS (SELECT c_mktsegment AS size, 'N' || c_nationkey AS configuration, n / sum(n) OVER (PARTITION BY c_mktsegment)::DOUBLE * CASE WHEN c_mktsegment = 'BUILDING' THEN 1.1 ELSE 1 END AS weight FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)) "


def nested(t):
    from popweave.operators.aggregates import with_totals
    s = with_totals(t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")), ["c_mktsegment"], {"tt": F.sum("n")})
    w = COL("n") / COL("tt") * F.when(COL("c_mktsegment") == "BUILDING", 1.1).otherwise(1.0)
    m = s.groupBy("c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("N"), "c_nationkey"), w))).alias("m"))
    doc = m.select(F.to_json(F.create_map("c_mktsegment", "m")).alias("doc"))
    return N.nested_repertoire(doc, "doc")


@query("src14_nested_repertoire", SHARES + "SELECT size, configuration, round(weight, 6) AS weight FROM s")
def _(t):
    return r(nested(t), "weight")


@query("src14_offenders", SHARES + "SELECT size, round(sum(weight), 6) AS total FROM s GROUP BY 1 HAVING abs(sum(weight) - 1) > 0.005")
def _(t):
    return r(N.repertoire_offenders(nested(t)), "total")


@query("src15_classification_profile", "SELECT count(*) AS rows, count(p_name) - count(DISTINCT p_name) AS repeated_keys, count(DISTINCT p_type) AS definitions, count(DISTINCT p_brand) AS distinct_p_brand, count(DISTINCT p_size) AS distinct_p_size FROM part")
def _(t):
    return N.classification_profile(t.part, "p_name", "p_type", ["p_brand", "p_size"])


NAMES = "WITH x AS (SELECT c_nationkey AS country, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS chiave, c_custkey % 5 + 1 AS w FROM customer), n AS (SELECT country, chiave, sum(w)::BIGINT AS peso FROM x WHERE chiave IS NOT NULL GROUP BY ALL) "


def names(t):
    k = COL("c_custkey")
    d = t.customer.select("c_nationkey", F.when(k % 3 == 0, " ").when(k % 7 == 0, "").otherwise(COL("c_name")).alias("rom"), F.when(k % 3 == 0, COL("c_mktsegment")).alias("loc"), (k % 5 + 1).alias("w"))
    return N.names_by_country(d, "c_nationkey", "rom", "loc", COL("w"), 40)


@query("src16_names_by_country", NAMES + "SELECT * FROM n")
def _(t):
    return names(t)[0]


@query("src16_names_metrics", NAMES + ", p AS (SELECT country, count(*) AS e FROM n GROUP BY 1) SELECT count(*) AS countries, min(e) AS min, max(e) AS max, count(*) FILTER (e < 40) AS sparse, median(e) AS median FROM p")
def _(t):
    return names(t)[1]


LINES = "WITH l AS (SELECT doc_id, trim(unnest(string_split(CASE WHEN doc_id % 4 = 0 THEN '# source' || chr(10) || text ELSE text END, chr(10)))) AS l FROM documents) "


def doc_lines(t):
    return t.documents.select("doc_id", F.explode(F.split(F.when(COL("doc_id") % 4 == 0, F.concat(F.lit("# source\n"), "text")).otherwise(COL("text")), "\n")).alias("line"))


@query("src17_commented_list", LINES + "SELECT md5(l) AS digest, strip_accents(l) <> l AS diacritics, count(*) AS n FROM l WHERE NOT starts_with(l, '#') AND length(l) > 1 GROUP BY ALL")
def _(t):
    return N.commented_list(doc_lines(t), "line")[0].groupBy(F.md5("chiave").alias("digest"), "diacritics").agg(F.count("*").alias("n"))


@query("src17_list_metrics", LINES + "SELECT count(*) FILTER (starts_with(l, '#')) AS metadata, count(*) FILTER (NOT starts_with(l, '#') AND length(l) <= 1) AS too_short, count(*) AS lines FROM l")
def _(t):
    return N.commented_list(doc_lines(t), "line")[1]


@query("src18_title_list", """WITH a AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) || ' (disambiguation)' WHEN p_partkey % 17 = 0 THEN p_name || ' 2' WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'é') ELSE p_name END AS ti FROM part),
b AS (SELECT pos, trim(regexp_replace(ti, '\\s*\\([^)]*\\)\\s*$', '')) AS original FROM a), c AS (SELECT *, strip_accents(original) AS name FROM b WHERE length(original) >= 2 AND NOT regexp_matches(original, '[0-9]'))
SELECT pos, name, original, CAST(name <> original AS INT) AS diacritics FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY pos) AS rn FROM c) WHERE rn = 1""")
def _(t):
    k = COL("p_partkey")
    ti = F.when(k % 5 == 0, F.concat(F.upper("p_name"), F.lit(" (disambiguation)"))).when(k % 17 == 0, F.concat("p_name", F.lit(" 2"))).when(k % 3 == 0, F.regexp_replace("p_name", "e", "é")).otherwise(COL("p_name"))
    return N.title_list(t.part.select("p_partkey", ti.alias("ti")), "ti", "p_partkey")


@query("src19_stack_waves", """WITH s AS (SELECT CASE WHEN year(o_orderdate) <= 1994 THEN 'to 1994' WHEN year(o_orderdate) >= 1998 THEN 'from 1998' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS wave, o_orderkey, o_totalprice, o_orderstatus,
 CASE WHEN year(o_orderdate) <> 1995 THEN o_orderpriority END AS pr FROM orders WHERE year(o_orderdate) <> 1997)
SELECT wave, wave || ':' || o_orderkey AS donor_id, o_orderstatus, coalesce(pr, '-') AS o_orderpriority, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY wave), 10) AS w FROM s""")
def _(t):
    # every order belongs to a wave; that of 1995 lacks an optional column, that of 1997 a required one, so it cannot be stacked
    year = F.year("o_orderdate")
    w = lambda cond: t.orders.filter(cond)                                 # noqa: E731
    waves = {"to 1994": w(year <= 1994), "1995": w(year == 1995).drop("o_orderpriority"), "1996": w(year == 1996), "1997": w(year == 1997).drop("o_orderstatus"), "from 1998": w(year >= 1998)}
    s = N.stack_waves(waves, ["o_orderstatus"], ["o_orderpriority"], "o_totalprice", "o_orderkey")
    return r(s.select("wave", "donor_id", "o_orderstatus", F.coalesce("o_orderpriority", F.lit("-")).alias("o_orderpriority"), "w"), "w", digits=10)


@query("src20_territory_status", """WITH w AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation WHERE n_regionkey = 0), g AS (SELECT c_nationkey AS k, count(*) AS rows FROM customer GROUP BY 1)
SELECT w.k, coalesce(rows, 0)::BIGINT AS rows, CASE WHEN rows IS NULL THEN 'absent' ELSE 'split' END AS status FROM w LEFT JOIN g ON g.k = w.k""")
def _(t):
    wanted = t.nation.select(COL("n_nationkey").alias("k")).unionByName(t.nation.filter("n_regionkey = 0").select((COL("n_nationkey") + 100).alias("k")))
    return N.territory_status(t.customer.select(COL("c_nationkey").alias("k")), "k", wanted)


@query("src21_points_of_interest", f"""WITH a AS (SELECT c_custkey AS pos, c_mktsegment AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 31 + 0.123456 END AS lon, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 31 + 0.654321 END AS clon, c_custkey % 7 + 0.5::DOUBLE AS lat FROM customer),
b AS (SELECT pos, name, round(coalesce(lon, clon)::DOUBLE, 5) AS lon, round(lat, 5) AS lat FROM a WHERE coalesce(lon, clon) IS NOT NULL)
SELECT pos, name, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY lon, lat, name ORDER BY pos) AS rn FROM b) WHERE rn = 1""")
def _(t):
    k = COL("c_custkey")
    lon = F.coalesce(F.when(k % 6 != 0, k % 31 + 0.123456), F.when(k % 4 != 0, k % 31 + 0.654321))
    return N.points_of_interest(t.customer, lon, k % 7 + 0.5, "c_mktsegment", "c_custkey")


@query("src22_sink_round_trip", " UNION ALL ".join(f"SELECT count(*) AS rows, count(DISTINCT c_custkey) AS keys, '{k}' AS sink FROM customer" for k in ("parquet", "csv", "json")))
def _(t):
    from popweave.session import shared_dir
    import uuid
    base = f"{shared_dir(t.spark)}/sink-{uuid.uuid4().hex}"
    d = t.customer
    N.write_table(d, base + "/parquet", ["c_nationkey"])
    N.write_csv(d, base + "/csv")
    N.write_json(d, base + "/json")
    n = lambda df, k: df.agg(F.count("*").alias("rows"), F.countDistinct("c_custkey").alias("keys")).withColumn("sink", F.lit(k))
    return (n(t.spark.read.parquet(base + "/parquet"), "parquet").unionByName(n(t.spark.read.option("header", True).csv(base + "/csv"), "csv"))
            .unionByName(n(t.spark.read.json(base + "/json"), "json")))


@query("src23_registry_ingestion", "SELECT 'types' AS id, p_type AS chiave, sum(p_retailprice) AS peso FROM part GROUP BY ALL UNION ALL SELECT 'segments', c_mktsegment, count(*)::DOUBLE FROM customer GROUP BY ALL".replace("sum(p_retailprice)", "round(sum(p_retailprice), 2)"))
def _(t):
    registry = [{"id": "types", "table": "part", "builder": "distribution", "options": {"key": "p_type", "weight": "p_retailprice"}},
                {"id": "segments", "table": "customer", "builder": "distribution", "options": {"key": "c_mktsegment", "weight": "one"}}]
    parts = [N.ingest(e["builder"], getattr(t, e["table"]).withColumn("one", F.lit(1)), **e["options"])[0].withColumn("id", F.lit(e["id"])) for e in registry]
    return r(parts[0].unionByName(parts[1]), "peso", digits=2)


@query("src24_instances", " UNION ALL ".join(f"SELECT '{x}' AS instance, count(*) AS rows FROM {x}" for x in TABLES))
def _(t):
    """The tables that the folder holds, each with its rows."""
    found = N.list_instances(t.spark, t.sf_dir, "*.parquet", r"([a-z]+)\.parquet$").select("instance")
    rows = reduce(lambda a, b: a.unionByName(b), [getattr(t, x).agg(F.count("*").alias("rows")).withColumn("instance", F.lit(x)) for x in TABLES])
    return found.distinct().join(rows, "instance")


@query("src25_sparse_cube", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS mass FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') IN ('1', '2', '3') GROUP BY 1")
def _(t):
    d = N.sparse_cube(t.events.withColumn("k", F.get_json_object("props", "$.k")), {"event_type": "click"}, {"k": ["1", "2", "3"]})
    return r(d.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("mass")), "mass", digits=2)


@query("ud1_pluggable_normaliser", "SELECT unnest(string_split(p_name, ' ')) AS chiave, count(*) AS peso FROM part GROUP BY 1")
def _(t):
    """A user-added builder by name."""
    def head_words(df, text):
        return df.select(F.explode(F.split(text, " ")).alias("chiave")).groupBy("chiave").agg(F.count("*").alias("peso"))
    return N.ingest("words", t.part, registry={**N.BUILDERS, "words": head_words}, text="p_name")


@query("ud1_table_function", "SELECT unnest(string_split(p_name, ' ')) AS chiave, count(*) AS peso, sum(p_size) AS massa FROM part WHERE p_size >= 10 GROUP BY 1 HAVING count(*) >= 3")
def _(t):
    """A normaliser called from SQL as a table function, with its diagnostics as a second one."""
    words = "SELECT explode(split(p_name, ' ')) AS chiave, p_size FROM {part} WHERE p_size >= head_words.least"
    N.table_function(t.spark, "head_words", "chiave STRING, peso BIGINT, massa BIGINT", f"SELECT chiave, count(*), sum(p_size) FROM ({words}) GROUP BY chiave", "least INT", part=t.part)
    return t.spark.sql("SELECT chiave, peso, massa FROM head_words(10) WHERE peso >= 3")


@query("ud2_common_layout", """WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS geo, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sesso, c_mktsegment AS paese, count(*)::DOUBLE AS n FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL),
b AS (SELECT CAST(l_suppkey AS VARCHAR) AS geo, l_returnflag AS paese, sum(l_quantity) AS f, sum(l_linenumber)::DOUBLE AS m FROM lineitem GROUP BY ALL)
SELECT 'long' AS city, geo, sesso, paese, n FROM a UNION ALL SELECT 'wide', geo, 'F', paese, f FROM b UNION ALL SELECT 'wide', geo, 'M', paese, m FROM b""")
def _(t):
    long = N.common_layout(t.customer.select("c_nationkey", (COL("c_custkey") % 2).cast("string").alias("sx"), "c_mktsegment", F.lit(1).alias("one")),
                           {"geo": "c_nationkey", "sesso": "sx", "sex_map": {"0": "F", "1": "M"}, "paese": "c_mktsegment", "n": "one", "drop": ["BUILDING"]})
    wide = N.common_layout(t.lineitem, {"geo": "l_suppkey", "paese": "l_returnflag", "wide": {"F": "l_quantity", "M": "l_linenumber"}})
    return long.withColumn("city", F.lit("long")).unionByName(wide.withColumn("city", F.lit("wide")))


@query("ud3_distance_aggregate", """WITH c AS (SELECT p_type AS k, count(*) FILTER (p_size <= 25)::DOUBLE AS a, count(*) FILTER (p_size > 25)::DOUBLE AS b FROM part GROUP BY 1) SELECT round(sum(abs(a / (SELECT sum(a) FROM c) - b / (SELECT sum(b) FROM c))) / 2, 6) AS tvd FROM c""")
def _(t):
    from popweave.operators.distances import tvd
    side = lambda c: t.part.filter(c).groupBy("p_type").agg(F.count("*").alias("w"))
    return r(tvd(side("p_size <= 25"), side("p_size > 25"), "p_type").select("tvd"), "tvd")
