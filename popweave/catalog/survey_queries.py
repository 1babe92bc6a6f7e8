"""Survey answers: conversation turns play agent x replica answers."""
from pyspark.sql import functions as F

from popweave.catalog import query, r
from popweave.catalog.aggregate_queries import COL
from popweave.operators import survey as S

OPTS = ["lavoro", "studio", "altro", "boh"]
ANS = """s AS (SELECT conv_id AS agent, turn AS replica, role AS model, CASE WHEN length(text) % 13 = 0 THEN NULL ELSE length(text) % 11 END AS v, length(text) % 5 <> 0 AS clean,
 CASE WHEN length(text) % 17 = 0 THEN NULL ELSE ['lavoro', 'studio', 'altro', 'boh'][CAST(length(text) % 4 + 1 AS INT)] END AS choice, conv_id * 7 % 11 AS latent, (length(text) % 101) / 100.0::DOUBLE AS prob, 'item' || conv_id % 3 AS item, CASE WHEN turn % 2 = 0 THEN 'B' ELSE 'C' END AS cond FROM conversations),
a AS (SELECT *, CASE WHEN latent <= 3 THEN 'LOW' WHEN latent < 7 THEN 'MED' ELSE 'HIGH' END AS band FROM s) """


def answers(t):
    n = F.length("text").cast("bigint")
    d = t.conversations.select(COL("conv_id").alias("agent"), COL("turn").alias("replica"), COL("role").alias("model"), F.when(n % 13 != 0, n % 11).alias("v"), (n % 5 != 0).alias("clean"),
        F.when(n % 17 != 0, F.get(F.array(*map(F.lit, OPTS)), (n % 4).cast("int"))).alias("choice"), (COL("conv_id") * 7 % 11).alias("latent"), ((n % 101) / 100.0).alias("prob"),
        F.concat(F.lit("item"), COL("conv_id") % 3).alias("item"), F.when(COL("turn") % 2 == 0, "B").otherwise("C").alias("cond"))
    return d.withColumn("band", S.latent_band("latent"))


@query("sv1_cleaning", f"WITH {ANS} SELECT model, item, count(*) AS n, round(avg(CASE WHEN clean THEN 1.0 ELSE 0.0 END), 6) AS clean, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM a GROUP BY ALL")
def _(t):
    return r(S.cleaning(answers(t), ["model", "item"], "v", "clean"), "clean", "missing")


SH = f"WITH {ANS}, c AS (SELECT model, choice, count(*) AS n FROM a WHERE choice IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY model) AS share FROM c) "


@query("sv2_choice_shares", SH + "SELECT model, choice, n, round(share, 6) AS share FROM p")
def _(t):
    return r(S.choice_shares(answers(t), ["model"], "choice"), "share")


@query("sv2_muteness", SH + "SELECT model, choice AS top, round(share, 6) AS share, share > 0.95 AS mute FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY share DESC, choice DESC) AS rn FROM p) WHERE rn = 1")
def _(t):
    return r(S.muteness(answers(t), ["model"], "choice"), "share")


@query("sv3_replica_stability", f"WITH {ANS}, g AS (SELECT model, agent, min(choice) AS lo, max(choice) AS hi, stddev_samp(v) AS sd FROM a GROUP BY ALL HAVING count(*) > 1) SELECT model, count(*) AS agents, round(avg(CASE WHEN lo = hi THEN 1.0 WHEN lo <> hi THEN 0.0 END), 6) AS identical, round(avg(sd), 6) AS mean_sd FROM g GROUP BY 1")
def _(t):
    return r(S.replica_stability(answers(t), ["model"], "agent", "choice", "v"), "identical", "mean_sd")


@query("sv4_anchors", f"WITH {ANS} SELECT model, count(v) AS n, round(avg(CASE WHEN v % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS on_anchor FROM a WHERE v IS NOT NULL GROUP BY 1")
def _(t):
    return r(S.anchors(answers(t), ["model"], "v")[0], "on_anchor")


@query("sv4_top_values", f"WITH {ANS}, c AS (SELECT model, v, count(*) AS n FROM a WHERE v IS NOT NULL GROUP BY ALL) SELECT model, v, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, v) AS rank FROM c) WHERE rank <= 3")
def _(t):
    return S.anchors(answers(t), ["model"], "v")[1]


AX = "SELECT '{x}' AS axis, CAST({x} AS VARCHAR) AS level, count(*) AS n, round(count(*) FILTER (choice = 'studio') / count(choice), 6) AS share, round(avg(prob), 6) AS prob FROM a GROUP BY ALL"


@query("sv5_by_axis", f"WITH {ANS} " + " UNION ALL ".join(AX.format(x=x) for x in ("model", "band", "item")))
def _(t):
    return r(S.by_axis(answers(t), ["model", "band", "item"], "choice", "studio", "prob"), "share", "prob")


@query("sv6_logit")
def _(t):
    d = t.documents.join(t.labels, "doc_id").withColumn("size", F.floor(COL("n_chars") / 1000))
    return r(S.logit(d, "quality", {"lang": ["en", "fr", "de", "es"]}, ["size"]), "beta", "se", digits=4)


@query("sv7_linear_fit", """WITH d AS (SELECT l_returnflag AS k, l_quantity AS x, l_extendedprice AS y FROM lineitem), q AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS ry FROM d),
f AS (SELECT k, regr_slope(y, x) AS slope, regr_intercept(y, x) AS i, corr(x, y) AS p FROM d GROUP BY 1) SELECT k, round(slope, 4) AS slope, round(i, 3) AS intercept, round(p, 6) AS pearson, n, rho FROM f JOIN (SELECT k, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM q GROUP BY 1) USING (k)""")
def _(t):
    d = t.lineitem.select(COL("l_returnflag").alias("k"), COL("l_quantity").alias("x"), COL("l_extendedprice").alias("y"))
    return r(r(r(S.linear_fit(d, ["k"], "x", "y"), "slope", digits=4), "intercept", digits=3), "pearson", "rho")


@query("sv8_latent_table", f"WITH {ANS}, h AS (SELECT model, band, string_agg(v || ':' || c, ' ' ORDER BY v) AS histogram FROM (SELECT model, band, v, count(*) AS c FROM a WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL) SELECT model, band, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, median(v) AS median, any_value(histogram) AS histogram FROM a JOIN h USING (model, band) WHERE v IS NOT NULL GROUP BY ALL")
def _(t):
    return r(S.latent_table(answers(t), ["model"], "band", "v"), "mean", "sd")


@query("sv9_paired_difference", f"WITH {ANS}, g AS (SELECT agent, band, avg(v) FILTER (cond = 'B') - avg(v) FILTER (cond = 'C') AS d FROM a GROUP BY ALL) SELECT band, count(*) AS agents, round(avg(d), 6) AS mean_diff, count(*) FILTER (d > 0) AS above, count(*) FILTER (d < 0) AS below FROM g WHERE d IS NOT NULL GROUP BY 1")
def _(t):
    return r(S.paired_difference(answers(t), "agent", "cond", "B", "C", "band", "v"), "mean_diff")


@query("sv10_within_correlation", """WITH d AS (SELECT l_returnflag AS k, l_linenumber AS b, l_quantity AS x, l_extendedprice AS y FROM lineitem), c AS (SELECT k, x - avg(x) OVER (PARTITION BY k, b) AS x, y - avg(y) OVER (PARTITION BY k, b) AS y FROM d) SELECT k, count(*) AS n, round(corr(x, y), 6) AS r FROM c GROUP BY 1""")
def _(t):
    return r(S.within_correlation(t.lineitem.withColumnRenamed("l_returnflag", "k"), ["k"], "l_linenumber", "l_quantity", "l_extendedprice"), "r")


CHI = """WITH c AS (SELECT lang, quality, count(*)::DOUBLE AS o FROM documents JOIN labels USING (doc_id) GROUP BY ALL), f AS (SELECT l.lang, q.quality, coalesce(o, 0) AS o FROM (SELECT DISTINCT lang FROM c) l CROSS JOIN (SELECT DISTINCT quality FROM c) q LEFT JOIN c ON c.lang = l.lang AND c.quality = q.quality),
e AS (SELECT *, sum(o) OVER (PARTITION BY lang) * sum(o) OVER (PARTITION BY quality) / sum(o) OVER () AS e FROM f) """


def labelled(t):
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id")


@query("sv11_chi_square", CHI + "SELECT round(sum((o - e) ** 2 / e), 5) AS chi2, (count(DISTINCT lang) - 1) * (count(DISTINCT quality) - 1) AS df, CAST(sum(o) AS BIGINT) AS n, count(*) FILTER (e < 5) AS sparse FROM e")
def _(t):
    return r(S.chi_square(labelled(t), [], "lang", "quality"), "chi2", digits=5)


@query("sv11_chi_square_p")
def _(t):
    return r(S.chi_square_p(labelled(t), "lang", "quality"), "chi2", "p")


CELLS = "WITH d AS (SELECT 'livello' || o_custkey % 6 AS cell, o_orderpriority AS ch, o_orderstatus AS st FROM orders), p AS (SELECT cell, ch, n / sum(n) OVER (PARTITION BY cell) AS s, n FROM (SELECT cell, ch, count(*) AS n FROM d GROUP BY ALL)) "


def prompt_cells(t):
    return t.orders.select(F.concat(F.lit("livello"), COL("o_custkey") % 6).alias("cell"), COL("o_orderpriority").alias("ch"), COL("o_orderstatus").alias("st"))


@query("sv12_cell_distances", CELLS + "SELECT p.cell, sum(p.n)::BIGINT AS n, round(sum(abs(p.s - b.s)) / 2, 6) AS tvd FROM p JOIN p b ON b.cell = 'livello0' AND b.ch = p.ch GROUP BY 1")
def _(t):
    return r(S.cell_distances(prompt_cells(t), "cell", "ch", "livello0"), "tvd")


@query("sv12_level_effects", CELLS + ", t AS (SELECT x.cell AS level_a, y.cell AS level_b, sum(abs(x.s - y.s)) / 2 AS tvd FROM p x JOIN p y ON x.ch = y.ch AND x.cell < y.cell GROUP BY ALL) SELECT level_a, level_b, round(tvd, 6) AS tvd FROM t ORDER BY t.tvd DESC, level_a DESC, level_b DESC LIMIT 1")
def _(t):
    return r(S.level_effects(prompt_cells(t), "cell", "ch"), "tvd")


@query("sv12_interaction_gap", CELLS + ", n AS (SELECT cell, st, ch, count(*) AS n FROM d GROUP BY ALL), q AS (SELECT cell, st, ch, n / sum(n) OVER (PARTITION BY cell, st) AS p, sum(n) OVER (PARTITION BY cell, ch) / sum(n) OVER (PARTITION BY cell) AS pa, sum(n) OVER (PARTITION BY st, ch) / sum(n) OVER (PARTITION BY st) AS pb, sum(n) OVER (PARTITION BY ch) / sum(n) OVER () AS p0 FROM n) SELECT cell, st, ch, round(p - (pa + pb - p0), 6) AS gap FROM q")
def _(t):
    return r(S.interaction_gap(prompt_cells(t), "cell", "st", "ch"), "gap")


@query("sv13_migration", f"WITH {ANS}, g AS (SELECT item, agent, avg(CASE WHEN choice = 'studio' THEN 1.0 WHEN choice IS NOT NULL THEN 0.0 END) FILTER (cond = 'B') AS c0, avg(CASE WHEN choice = 'studio' THEN 1.0 WHEN choice IS NOT NULL THEN 0.0 END) FILTER (cond = 'C') AS c1, avg(prob) FILTER (cond = 'B') AS b0, avg(prob) FILTER (cond = 'C') AS b1 FROM a GROUP BY ALL) SELECT item, count(*) AS agents, round(avg(c0), 6) AS choice_cold, round(avg(c1), 6) AS choice_warm, round(avg(b0), 6) AS belief_cold, round(avg(b1), 6) AS belief_warm, round(avg(c1) - avg(c0), 6) AS choice_move, round(avg(b1) - avg(b0), 6) AS belief_move FROM g WHERE c0 IS NOT NULL AND c1 IS NOT NULL GROUP BY 1")
def _(t):
    return r(S.migration(answers(t), "agent", "cond", "B", "C", "item", "choice", "studio", "prob"), "choice_cold", "choice_warm", "belief_cold", "belief_warm", "choice_move", "belief_move")


@query("sv13_position_effect", f"WITH {ANS}, p AS (SELECT (list_position(['lavoro', 'studio', 'altro', 'boh'], choice) - 1 - replica % 4 + 4) % 4 + 1 AS position FROM a WHERE choice IS NOT NULL) SELECT CAST(position AS BIGINT) AS position, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1")
def _(t):
    return r(S.position_effect(answers(t), OPTS, "replica", "choice"), "share")


@query("sv14_link_regression", """WITH d AS (SELECT l_returnflag AS k, ln(x / (1 - x)) AS lx, ln(y / (1 - y)) AS ly FROM (SELECT l_returnflag, least(greatest(l_quantity / 50, 0.01), 1 - 0.01::DOUBLE) AS x, least(greatest(l_extendedprice / 100000, 0.01), 1 - 0.01::DOUBLE) AS y FROM lineitem))
SELECT k, count(*) AS n, round(regr_intercept(ly, lx), 6) AS intercept, round(regr_slope(ly, lx), 6) AS slope, round(regr_r2(ly, lx), 6) AS r2 FROM d GROUP BY 1""")
def _(t):
    d = t.lineitem.select(COL("l_returnflag").alias("k"), (COL("l_quantity") / 50).alias("x"), (COL("l_extendedprice") / 100000).alias("y"))
    return r(S.link_regression(d, ["k"], "x", "y"), "intercept", "slope", "r2")


def _conc(a, b):
    return f"SELECT '{a}~{b}' AS pair, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY \"{a}\") + (count(*) OVER (PARTITION BY \"{a}\") - 1) / 2.0 AS ra, rank() OVER (ORDER BY \"{b}\") + (count(*) OVER (PARTITION BY \"{b}\") - 1) / 2.0 AS rb FROM w WHERE \"{a}\" IS NOT NULL AND \"{b}\" IS NOT NULL)"


@query("sv15_model_concordance", "WITH w AS (SELECT l_suppkey, " + ", ".join(f"avg(l_quantity) FILTER (l_returnflag = '{m}') AS \"{m}\"" for m in "ANR") + " FROM lineitem GROUP BY 1) " + " UNION ALL ".join(_conc(a, b) for a, b in ("AN", "AR", "NR")))
def _(t):
    return r(S.model_concordance(t.lineitem, "l_suppkey", "l_returnflag", ["A", "N", "R"], "l_quantity"), "rho")


GUESS = "WITH g AS (SELECT c_nationkey % 5 AS city, c_mktsegment AS guess, c_mktsegment = ['BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE', 'HOUSEHOLD'][CAST(c_nationkey % 5 + 1 AS INT)] AS ok, c_acctbal < 500 AS unknown FROM customer) "


def guesses(t):
    d = t.customer.select((COL("c_nationkey") % 5).alias("city"), COL("c_mktsegment").alias("guess"), "c_acctbal")
    truth = COL("guess") == F.get(F.array(*map(F.lit, ["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD"])), "city")
    return d, truth, COL("c_acctbal") < 500


@query("sv16_guess_outcomes", GUESS + ", o AS (SELECT city, CASE WHEN unknown THEN 'unknown' WHEN ok THEN 'right' ELSE 'wrong' END AS outcome, count(*) AS n FROM g GROUP BY ALL) SELECT city, outcome, n, round(n / sum(n) OVER (PARTITION BY city), 6) AS share FROM o")
def _(t):
    d, truth, unk = guesses(t)
    return r(S.guess_outcomes(d, "city", truth, "guess", unk), "share")


@query("sv16_wrong_guesses", GUESS + ", c AS (SELECT city, guess, count(*) AS n FROM g WHERE NOT ok AND NOT unknown GROUP BY ALL) SELECT city, guess, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, guess) AS rank FROM c) WHERE rank <= 2")
def _(t):
    d, truth, unk = guesses(t)
    return S.wrong_guesses(d, "city", truth, "guess", unk, 2)


@query("sv17_story_problems", """WITH w AS (SELECT doc_id, lower(text) AS lo, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS w FROM documents), d AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '[0-9]')) AS dg, len(w) AS n FROM w)
SELECT doc_id, 'forbidden' AS problem, concat_ws(',', CASE WHEN contains(lo, 'que') THEN 'que' END, CASE WHEN contains(lo, 'the') THEN 'the' END) AS detail FROM d WHERE contains(lo, 'que') OR contains(lo, 'the')
UNION ALL SELECT doc_id, 'digits', array_to_string(dg, ' ') FROM d WHERE len(dg) > 0 UNION ALL SELECT doc_id, 'short', CAST(n AS VARCHAR) FROM d WHERE n < 50 UNION ALL SELECT doc_id, 'long', CAST(n AS VARCHAR) FROM d WHERE n > 220
UNION ALL SELECT doc_id, 'scene', 'ver' FROM d WHERE contains(lo, 'ver')""")
def _(t):
    return S.story_problems(t.documents, "doc_id", "text", ["que", "the"], ["ver"])


@query("sv18_call_metrics", "SELECT event_type, count(*) AS calls, round(avg(value), 5) AS mean_latency, sum(user_id)::BIGINT AS tokens_in, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS tokens_out, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.95), 5) AS p95 FROM events GROUP BY 1")
def _(t):
    return r(S.call_metrics(t.events, ["event_type"], "value", COL("user_id"), F.get_json_object("props", "$.k").cast("bigint")), "mean_latency", "p50", "p95", digits=5)


@query("sv19_item_by_band", f"WITH {ANS}, c AS (SELECT cond, band, choice, count(*) AS n FROM a WHERE choice IS NOT NULL GROUP BY ALL) SELECT cond, band, choice, n, round(n / sum(n) OVER (PARTITION BY cond, band), 6) AS share FROM c")
def _(t):
    return r(S.item_by_band(answers(t), ["cond"], "band", "choice"), "share")


@query("sv20_profile_contingency", "SELECT CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END AS wealth, CASE WHEN c_nationkey < 10 THEN 'north' ELSE 'south' END AS side, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def _(t):
    p = t.customer.withColumnRenamed("c_custkey", "o_custkey")
    return S.profile_contingency(t.orders, p, "o_custkey", {"wealth": F.when(COL("c_acctbal") < 2000, "low").when(COL("c_acctbal") < 6000, "mid").otherwise("high"), "side": F.when(COL("c_nationkey") < 10, "north").otherwise("south")}, "o_orderpriority")


@query("sv21_largest_deviations", f"WITH {ANS}, g AS (SELECT agent * 100 + replica AS id, latent, v FROM a) SELECT id, latent, v, v - latent AS diff FROM g WHERE v IS NOT NULL ORDER BY abs(v - latent) DESC, id LIMIT 15")
def _(t):
    return S.largest_deviations(answers(t).withColumn("id", COL("agent") * 100 + COL("replica")), "id", "latent", "v", 15)
