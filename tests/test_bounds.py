"""Cases beyond bounds that operators once had."""
from pyspark.sql import functions as F

from popweave.operators import aggregates as A, filters as P, households as H, joins as J, quality as Q, survey as S
from popweave.operators.spatial import nearest_place
from popweave.plans import intervals, ranking


def test_sample_of_500(spark):
    assert P.seeded_sample(spark.range(2000), "id", 500).count() == 500


def test_signature_of_100_members(spark):
    rows = [(1, "R", 1.0)] + [(1, "F", 1.0)] * 99
    s = H.household_signatures(spark.createDataFrame(rows, "hh int, role string, w double"), ["hh"], "role", "w").first()
    assert s["signature"] == "R" + "F" * 99 and s["size"] == 100


def test_tree_on_a_long_chain_and_on_cycles(spark):
    edges = [(0, 0)] + [(i, i - 1) for i in range(1, 41)] + [(100, 101), (101, 100), (102, 100), (200, 201), (201, 202), (202, 200), (300, None)]
    got = {r["code"]: r["root"] for r in J.tree(spark.createDataFrame(edges, "code int, up int"), "code", "up").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == 300
    assert all(got[i] is None for i in (100, 101, 102, 200, 201, 202))


def test_far_facility(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, -1e6), (3, None, 1.0)], "pid int, x double, y double")
    f = spark.createDataFrame([(7, 995.0, 0.0)], "fid int, x double, y double")
    got = {r["pid"]: (r["fid"], r["distance"]) for r in nearest_place(p, f, "pid", "fid").collect()}
    assert got[1] == (7, 995.0) and got[2][0] == 7 and set(got) == {1, 2}
    assert nearest_place(p, f.limit(0), "pid", "fid").count() == 0


def test_lattice_is_born_in_many_tasks(spark):
    df = spark.range(300).select(*[(F.col("id") % n).alias(f"c{n}") for n in (300, 250, 7)])
    got = J.lattice(df, ["c300", "c250", "c7"])
    assert got.count() == 300 * 250 * 7 == got.distinct().count()
    assert got.rdd.getNumPartitions() > 1
    assert J.lattice(df.withColumn("e", F.lit(None).cast("string")), ["c7", "e"]).count() == 0


def test_leaf_sets_of_20_codes(spark):
    rows = [(f"c{i}", float(2 ** i)) for i in range(20)] + [("T", float(2 ** 19 + 5))]
    got = A.candidate_leaf_sets(spark.createDataFrame(rows, "code string, v double"), "code", [f"c{i}" for i in range(20)], "T", "v", 1e-9).collect()
    assert [r["codes"] for r in got] == ["c0,c2,c19"]


def test_slices_of_large_ids(spark):
    ids = spark.range(1000).select((F.col("id") * 10 ** 11 + 10 ** 13).alias("id"))
    s = [r[0] for r in ids.select(ranking.magnitude_slice(F.col("id"))).collect()]
    assert s == sorted(s) and len(set(s)) > 500
    around = spark.createDataFrame([(x,) for x in (-1e13, -8e12, 0.0, 1.0, 8.9e12, 9e12, 9.1e12, 1e14, 1e19)], "v double")
    s = [r[0] for r in around.select(ranking.magnitude_slice(F.col("v"))).collect()]
    assert s == sorted(s)


def test_fractions_lie_in_no_band(spark):
    bands = spark.createDataFrame([("0-8", 0, 8), ("9-14", 9, 14)], "band string, lo int, hi int")
    got = intervals.range_lookup(spark.createDataFrame([(8.0,), (8.7,), (9.0,)], "v double"), "v", bands, "lo", "hi").collect()
    assert sorted((r["v"], r["band"]) for r in got) == [(8.0, "0-8"), (9.0, "9-14")]


def test_real_weights_leave_no_gap_and_keep_everyone(spark):
    w = [0.1, 0.2, 0.7, 0.1, 0.3, 1e-9, 0.1, 2 / 3, 0.1, 0.9]
    table = spark.createDataFrame([("a", i, x) for i, x in enumerate(w)], "c string, k int, w double")
    for slice_ in (None, F.col("k") % 1):
        cum = intervals.cumulative_table(table, ["c"], "w", ["k"], slice_)
        rows = sorted(cum.collect(), key=lambda r: r["k"])
        assert rows[0]["lo"] == 0 and all(a["hi"] == b["lo"] for a, b in zip(rows, rows[1:], strict=False))
        edges = spark.createDataFrame([("a", r["lo"]) for r in rows], "c string, at double")
        assert intervals.pick(edges, cum, ["c"], ["k"], position=F.col("at")).count() == len(w)
    people = spark.range(1_000_000).select(F.lit("a").alias("c"), "id", (F.xxhash64("id") % (1 << 30) / (1 << 30)).alias("u")).withColumn("u", F.abs("u"))
    got = intervals.pick(people, intervals.cumulative_table(table, ["c"], "w", ["k"]), ["c"], ["k"], u=F.col("u"))
    assert got.agg(F.count("*"), F.countDistinct("id")).first()[:] == (1_000_000, 1_000_000)


def test_all_numbers_of_a_text_are_read(spark):
    logs = spark.createDataFrame([("r", "loss 3 then 17"), ("r", "loss 5")], "run string, line string")
    assert Q.log_metrics(logs, "run", "line", {"most": "([0-9]+)"}).first()["most"] == 17.0
    text = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(9)))], "id int, text string")
    found = {r["problem"]: r["detail"] for r in S.story_problems(text, "id", "text", [], []).collect()}
    assert found["digits"].split() == [f"w{i}" for i in range(9)]


def test_text_keys_are_sliced_in_order(spark):
    ids = sorted(f"{w}:{i}" for w in (1995, 1996) for i in range(300)) + ["é", "z"]
    df = spark.createDataFrame([("a", i, 0.1) for i in ids], "c string, id string, w double")
    by = [r[0] for r in df.orderBy("id").select(ranking.key_slice(df, "id")).collect()]
    assert by == sorted(by) and len(set(by)) > 100
    cum = sorted(intervals.cumulative_table(df, ["c"], "w", ["id"], ranking.key_slice(df, "id")).collect(), key=lambda r: r["lo"])
    assert all(a["hi"] == b["lo"] for a, b in zip(cum, cum[1:], strict=False)) and len(cum) == len(ids)


def test_fields_that_run_together_hash_apart(spark):
    rows = [(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "-"), (4, "-", None), (5, "ab", "c"), (6, "a", "bc")]
    got = Q.content_hash(spark.createDataFrame(rows, "k int, x string, y string"), ["k"], ["x", "y"]).collect()
    assert len({(r["hash_a"], r["hash_b"], r["hash_c"], r["hash_d"]) for r in got}) == len(rows)


def test_ridge_holds_separated_terms(spark):
    import numpy as np
    rows = [("b", 1)] * 30 + [("a", 0)] * 20 + [("a", 1)] * 10 + [(None, 1), ("a", None)]
    df = spark.createDataFrame(rows, "g string, y int")
    x = np.array([[g == "b", 1] for g, _ in rows[:60]], float)
    y = np.array([v for _, v in rows[:60]], float)
    for ridge in (0.01, 1.0):
        b = np.zeros(2)
        for _ in range(200):
            p = 1 / (1 + np.exp(-x @ b))
            b += 0.5 * np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(2), x.T @ (y - p) - ridge * b)
        got = {r["term"]: r for r in S.logit(df, "y", {"g": ["a", "b"]}, [], ridge=ridge, far=3.0).collect()}
        assert np.allclose([got["g=b"]["beta"], got["intercept"]["beta"]], b, atol=1e-6)
        assert got["g=b"]["separated"] == (b[0] > 3)
    assert S.logit(df.limit(0), "y", {"g": ["a", "b"]}, []).collect() == []


def test_roles_of_people_with_text_ids(spark):
    rows = [("h", "p1", 40, None, None, "p2"), ("h", "p2", 38, None, None, "p1"), ("h", "p3", 9, "p1", "p2", None), ("h", "p4", None, None, None, None)]
    df = spark.createDataFrame(rows, "hh string, pid string, age int, father string, mother string, partner string")
    assert {r["pid"]: r["role"] for r in J.family_roles(df).collect()} == {"p1": "R", "p2": "P", "p3": "F", "p4": "A"}


def test_names_of_text_zones(spark):
    from popweave.operators import geography as G
    df = spark.createDataFrame([("Rossi road", "east")] * 5 + [("Rossi road", "west")] * 2 + [("Alpha lane", "b")] * 3 + [("Alpha lane", "a")] * 3, "name string, zone string")
    assert {r["zone"] for r in G.concentrated_names(df, "name", "zone", [], 3, 0.4).collect()} == {"east", "a"}


def test_placeholders_count_as_missing(spark):
    df = spark.createDataFrame([(1, "DA_COMPILARE", " DA_CALCOLARE"), (2, "DA_REGISTRARE", "x"), (3, "x", None)], "id int, a string, b string")
    got = {r["id"]: r["all"] for r in Q.missing_fields(df, "id", {"all": ["a", "b"]}).collect()}
    assert got == {1: "a,b", 2: "a", 3: "b"}
