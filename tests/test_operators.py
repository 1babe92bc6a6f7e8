"""Operators against brute force, and invariants that no SQL states."""
import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popweave.catalog.household_queries import assembly_inputs
from popweave.functions import scalars as S
from popweave.operators import aggregates as A, allocation as L, filters as P, geography as G, households as H, joins as J, raking as R, survey as V, windows as X
from popweave.operators.spatial import nearest_place
from popweave.session import Tables
from popweave.sources import normalisers as N


def test_apportion_sums_to_n_and_follows_the_quota(spark):
    rng = np.random.default_rng(1)
    rows = [(c, k, float(rng.integers(0, 50))) for c in range(20) for k in range(9)]
    n = [(c, int(rng.integers(0, 300))) for c in range(20)]
    w = spark.createDataFrame(rows, "c long, k long, w double")
    got = L.apportion(w, spark.createDataFrame(n, "c long, n long"), ["c"], "k", "w", out="q").toPandas()
    for c, want in n:
        g = got[got.c == c]
        assert g.q.sum() == want
        quota = want * g.w / g.w.sum()
        assert ((g.q - quota).abs() < 1).all()


def test_hand_out_uses_counts_exactly(spark):
    m = spark.range(1000).select("id", (F.col("id") % 4).alias("c"))
    counts = spark.createDataFrame([(c, v, k) for c in range(4) for v, k in (("a", 100), ("b", 0), ("d", 150))], "c long, v string, k long")
    got = L.hand_out(m, counts, ["c"], "v", "id", "t").groupBy("c", "v").count().collect()
    assert {(r["c"], r["v"]): r["count"] for r in got} == {(c, v): k for c in range(4) for v, k in (("a", 100), ("d", 150))}


def test_one_to_one_equals_greedy_by_distance(spark):
    rng = np.random.default_rng(3)
    a = [(i, *map(float, rng.random(2) * 10)) for i in range(60)]
    b = [(i, *map(float, rng.random(2) * 10)) for i in range(40)]
    got = {(r["a_id"], r["b_id"]) for r in J.one_to_one(spark.createDataFrame(a, "a_id long, x double, y double"), spark.createDataFrame(b, "b_id long, x double, y double"), 1.5).collect()}
    pairs = sorted((math.dist(p[1:], q[1:]), p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) <= 1.5)
    ua, ub, want = set(), set(), set()
    for _, i, j in pairs:
        if i not in ua and j not in ub:
            ua.add(i), ub.add(j), want.add((i, j))
    assert got == want


def test_nearest_facility_far_from_everything(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, 99.0, 99.0), (3, 50.0, 1.0)], "pid long, x double, y double")
    f = spark.createDataFrame([(7, 0.0, 0.0), (8, 0.0, 0.0), (9, 40.0, 0.0)], "fid long, x double, y double")
    got = {r["pid"]: r["fid"] for r in nearest_place(p, f, "pid", "fid").collect()}
    assert got == {1: 7, 2: 9, 3: 9}


def test_point_in_a_concave_polygon(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 2.0), (0.0, 10.0)]
    poly = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "z long, verts array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 6.0), (3, 10.5, 5.0), (4, 30.0, 30.0)], "pid long, x double, y double")
    got = {r["pid"]: (r["method"], r["distance"]) for r in J.point_in_polygon(pts, poly, "pid", "z", 4.0, 1.0).collect()}
    assert got[1][0] == "within" and got[2][0] == "unmatched" and got[3] == ("nearest", pytest.approx(0.5)) and got[4][0] == "unmatched"


def test_tree_marks_cycles(spark):
    e = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "code string, up string")
    got = {r["code"]: (r["root"], r["leaf"]) for r in J.tree(e, "code", "up").collect()}
    assert got == {"a": ("a", False), "b": ("a", False), "c": ("a", True), "x": (None, False), "y": (None, False)}


def test_capped_redistribution_matches_rounds(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(6):
        share = rng.dirichlet(np.ones(8))
        cap = rng.random(8) * 40
        target = cap.sum() * (0.5 + 0.1 * k)
        rows += [(k, z, float(share[z]), float(cap[z]), float(target)) for z in range(8)]
    got = A.capped_redistribution(spark.createDataFrame(rows, "k long, z long, share double, cap double, target double"), ["k"], "z").toPandas()
    for k, g in got.groupby("k"):
        v = (g.share * g.target).to_numpy()
        cap = g.cap.to_numpy()
        for _ in range(500):
            over = v > cap
            extra = (v[over] - cap[over]).sum()
            v[over] = cap[over]
            free = v < cap
            if extra <= 1e-12 or not free.any():
                break
            v[free] += extra * v[free] / v[free].sum()
        assert np.allclose(g.value, v, atol=1e-6)


def test_size_constraints_shrink_the_largest_first(spark):
    def brute(pf, n):
        sizes = sorted([k + 1 for k, c in enumerate(pf) for _ in range(c)], reverse=True)
        miss = sum(sizes) - n
        while miss > 0 and sizes and sizes[0] > 1:
            sizes[0] -= 1
            miss -= 1
            sizes.sort(reverse=True)
        return [sizes.count(k) for k in range(1, 7)]
    cases = [([2, 1, 3, 0, 2, 1], n) for n in range(0, 28)] + [([0, 0, 0, 0, 0, 4], n) for n in range(0, 24, 5)]
    df = spark.createDataFrame([(i, *pf, n) for i, (pf, n) in enumerate(cases)], "i long, " + ", ".join(f"p{k} long" for k in range(1, 7)) + ", n long")
    got = {r["i"]: [r[f"k{k}"] for k in range(1, 7)] for r in H.size_constraints(df, [f"p{k}" for k in range(1, 7)], "n").collect()}
    for i, (pf, n) in enumerate(cases):
        assert got[i] == (brute(pf, n) if sum((k + 1) * c for k, c in enumerate(pf)) > n else pf), cases[i]


def test_raking_reaches_all_blocks(spark):
    rng = np.random.default_rng(4)
    lat = [(a, b, c) for a in range(3) for b in range(4) for c in range(2) if (a, b) != (0, 3)]
    truth = rng.dirichlet(np.ones(len(lat)))
    df = pd.DataFrame(lat, columns=list("abc")).assign(p=truth)
    frame = lambda keys, d: (keys, spark.createDataFrame(d.groupby(keys, as_index=False).p.sum().rename(columns={"p": "alpha"})))
    blocks = [frame(["a", "b"], df), frame(["b", "c"], df), frame(["a", "c"], df)]
    fit = R.rake_blocks(spark.createDataFrame(df[list("abc")]), blocks, 40, tolerance=1e-4)
    assert R.block_error(fit, "p", blocks).agg(F.max("rel_error")).first()[0] < 5e-3
    assert fit.agg(F.sum("p")).first()[0] == pytest.approx(1.0)


def test_incomplete_block_leaves_the_rest_in_proportion(spark):
    lat = spark.createDataFrame([(a,) for a in "wxyz"], "a string")
    p = {r["a"]: r["p"] for r in R.rake_blocks(lat, [(["a"], spark.createDataFrame([("w", 0.7)], "a string, alpha double"))], 1).collect()}
    assert p["w"] == pytest.approx(0.7) and p["x"] == p["y"] == pytest.approx(0.1)


def test_assembly_invariants_and_quality(spark):
    p, h = assembly_inputs(Tables(spark, "/root/testdata/sf0.001"))
    a = H.assemble(p, h, "section", same_sex=0.0).toPandas()
    assert a.uid.is_unique
    assert (a[a.role == "R"].groupby("hh").size() == 1).all()
    ref = a[a.role == "R"].set_index("hh")
    kids = a[(a.role == "F") & (a.tier == 0)]
    gap = ref.loc[kids.hh].age.to_numpy() - kids.age.to_numpy()
    assert ((gap >= 20) & (gap <= 40)).all()
    mates = a[a.role == "P"]
    assert (ref.loc[mates.hh].male.to_numpy() != mates.male.to_numpy()).all()
    couples = ref.loc[mates.hh].male
    assert couples.mean() > 0.6            # couples mostly have a male reference
    slots = h.toPandas().signature.str.len().sum()
    assert len(a) > 0.8 * min(slots, p.count())


def test_logit_matches_newton(spark):
    rng = np.random.default_rng(6)
    n = 2000
    x = rng.integers(0, 5, n)
    g = rng.choice(["a", "b"], n)
    y = rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.4 * x + 0.8 * (g == "b"))))
    X_ = np.column_stack([g == "b", x, np.ones(n)]).astype(float)
    b = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X_ @ b))
        b += np.linalg.solve((X_.T * (p * (1 - p))) @ X_, X_.T @ (y - p))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "g": g, "y": y.astype(int)}))
    got = {r["term"]: r["beta"] for r in V.logit(df, "y", {"g": ["a", "b"]}, ["x"]).collect()}
    assert np.allclose([got["g=b"], got["x"], got["intercept"]], b, atol=1e-4)


def test_chi_square_counts_empty_cells(spark):
    df = spark.createDataFrame([("a", "x")] * 30 + [("a", "y")] * 10 + [("b", "x")] * 8, "r string, c string")
    o = np.array([[30, 10], [8, 0]], float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    r = V.chi_square(df, [], "r", "c").first()
    assert r["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and r["df"] == 1 and r["sparse"] == int((e < 5).sum())
    assert V.chi_square_p(df, "r", "c").first()["chi2"] == pytest.approx(r["chi2"])


def test_tied_spearman(spark):
    x, y = [1, 2, 2, 3, 9], [4, 4, 1, 7, 7]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")
    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert X.spearman(df, [], "x", "y").first()["rho"] == pytest.approx(want)


def test_scalars(spark):
    d = spark.createDataFrame([("Nessun titolo di studio",), ("Diploma di ITS",), ("Totale",), ("boh",), ("Licenza di scuola media inferiore",)], "l string")
    got = [r[0] for r in d.select(S.contains_ladder("l", S.V.EDUCATION_LADDER, S.V.EDUCATION_TOTAL)).collect()]
    assert got == ["nessun_titolo", "laurea_o_its", None, "?boh", "media"]
    d = spark.createDataFrame([("100",), ("dico 7",), ("0",), ("nessuno",)], "l string")
    v, ok = S.rating("l", 100)
    assert [(r[0], r[1]) for r in d.select(v, ok).collect()] == [(100, True), (7, False), (0, True), (None, False)]
    d = spark.createDataFrame([("Città di Forlì",), ("Sant'Agata",)], "l string")
    assert [r[0] for r in d.select(S.plain_name("l")).collect()] == ["cittadiforli", "santagata"]


def test_unknown_values_name_the_right_column(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "y")], "p string, q string")
    got = [(r.asked_column, r.value, r.held_by) for r in P.unknown_values(d, {"p": ["a", "x", "z"]}).collect()]
    assert got == [("p", "x", "q"), ("p", "z", "")]


def test_file_readers_and_sinks(spark, tmp_path):
    (tmp_path / "roma.csv").write_text("# note\n Nome ;Peso\nNA;3\n  Anna ;2\nAnna;1\n;9\nBo;x\n", encoding="utf-8")
    (tmp_path / "milano.csv").write_text(" Nome ;Peso\nUgo;5\n", encoding="utf-8")
    d = N.tidy_headers(N.read_text_table(spark, str(tmp_path / "roma.csv"), ";", comment="#"))
    table, m = N.weighted_distribution(d, "nome", "peso")
    assert {r["chiave"]: r["peso"] for r in table.collect()} == {"NA": 3.0, "Anna": 3.0}
    assert m.first().asDict() == {"raw_rows": 5, "not_numeric": 1, "blank_rows": 1, "blank_weight": 9.0, "categories": 2, "n": 6.0, "merged": 1}
    inst = N.read_instances(spark, str(tmp_path / "*.csv"), r"([a-z]+)\.csv$", header=True, sep=";", comment="#")
    assert {r["instance"] for r in inst.select("instance").distinct().collect()} == {"roma", "milano"}
    (tmp_path / "rep.json").write_text(json.dumps({"firme": {"2": {"RP": 0.6, "RF": 0.4}, "1": {"R": 0.9}}}), encoding="utf-8")
    doc = N.read_json_document(spark, str(tmp_path / "rep.json"), "firme map<string,map<string,double>>").select(F.to_json("firme").alias("doc"))
    rep = N.nested_repertoire(doc, "doc")
    assert [r["size"] for r in N.repertoire_offenders(rep).collect()] == ["1"] and rep.count() == 3
    (tmp_path / "cube.txt").write_text("IT|A|1\nIT|B|2\n", encoding="utf-8")
    assert N.read_fixed_cube(spark, str(tmp_path / "cube.txt"), "terr string, cod string, val double").filter("cod = 'B'").first()["val"] == 2.0
    N.split_by_territory(inst, "instance", str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == inst.count()


def test_uncovered_target_by_radius(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 100, 50, 40, 30), (2, 50.0, 0.0, 10, 5, 4, 4)], "sid long, x double, y double, n long, old long, low long, target long")
    f = spark.createDataFrame([(1, 1.0, 0.0)], "fid long, x double, y double")
    r = G.uncovered_target(s, f, radius=5.0).first()
    assert (r["far_people"], r["c"]) == (10, 4) and r["a"] == pytest.approx(34 / 110 * 10) and r["b"] == pytest.approx(2.0)


def test_flagship_entry_is_deterministic(spark):
    import __spark_entry__ as E
    a = sorted(map(str, E.entry(spark).collect()))
    assert a == sorted(map(str, E.entry(spark).repartition(7).collect())) and len(a) > 0
