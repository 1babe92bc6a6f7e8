"""Null models on cells: counts follow their distributions and agree with draws of single members."""
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from popweave.functions.counts import binomial_count, hypergeometric_count
from popweave.operators import distances as D, nulls as N


def _drawn(spark, count, grid=4000):
    u = spark.range(grid).select(((F.col("id") + 0.5) / grid).alias("u"))
    return Counter(r[0] for r in u.select(count(F.col("u"))).collect()), grid


@pytest.mark.parametrize("n,w,t", [(1, 1, 3), (7, 2, 5), (40, 1, 100), (40, 99, 100), (900, 1, 3)])
def test_binomial_shares(spark, n, w, t):
    got, grid = _drawn(spark, lambda u: binomial_count(u, F.lit(n), F.lit(w), F.lit(t)))
    for x in range(n + 1):
        p = math.comb(n, x) * (w / t) ** x * (1 - w / t) ** (n - x)
        assert abs(got[x] / grid - p) < 1.01 / grid, x


@pytest.mark.parametrize("size,marked,taken", [(10, 3, 4), (10, 9, 8), (50, 25, 25), (300, 7, 290)])
def test_hypergeometric_shares(spark, size, marked, taken):
    got, grid = _drawn(spark, lambda u: hypergeometric_count(u, F.lit(size), F.lit(marked), F.lit(taken)))
    for x in range(min(marked, taken) + 1):
        p = math.comb(marked, x) * math.comb(size - marked, taken - x) / math.comb(size, taken) if taken - x <= size - marked else 0
        assert abs(got[x] / grid - p) < 1.01 / grid, x


def test_counts_at_the_ends_and_far_out(spark):
    u = spark.range(1).select(F.lit(0.7).alias("u"))
    e = u.select(binomial_count(F.col("u"), F.lit(0), F.lit(1), F.lit(2)), binomial_count(F.col("u"), F.lit(9), F.lit(0), F.lit(2)),
                 binomial_count(F.col("u"), F.lit(9), F.lit(2), F.lit(2)), hypergeometric_count(F.col("u"), F.lit(9), F.lit(9), F.lit(4)),
                 hypergeometric_count(F.col("u"), F.lit(9), F.lit(4), F.lit(9)), hypergeometric_count(F.col("u"), F.lit(0), F.lit(0), F.lit(0))).first()
    assert list(e) == [0, 0, 9, 4, 4, 0]
    big = 10 ** 10
    x, y = u.select(binomial_count(F.col("u"), F.lit(big), F.lit(1), F.lit(4)), hypergeometric_count(F.col("u"), F.lit(big), F.lit(big // 4), F.lit(big // 2))).first()
    assert abs(x - big / 4) < 5 * math.sqrt(big * 3 / 16) and abs(y - big / 8) < 5 * math.sqrt(big)


@pytest.mark.parametrize("size,marked,taken", [(12, 5, 6), (400, 90, 200), (400, 3, 380), (90_000, 30_000, 45_000)])
def test_draws_far_out_walk_as_far_as_it_takes(spark, size, marked, taken):
    low, high = max(0, taken + marked - size), min(marked, taken)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)       # noqa: E731
    p = {x: math.exp(log(marked, x) + log(size - marked, taken - x) - log(size, taken)) for x in range(low, high + 1)}
    mode = min(high, max(low, (taken + 1) * (marked + 1) // (size + 2)))
    order = sorted(p, key=lambda x: 2 * (x - mode) - 1 if x > mode else 2 * (mode - x))
    at = [0.0, 0.31, 0.77, 0.9, 0.999, 0.99999, 1 - 1e-8]
    got = spark.createDataFrame([(u,) for u in at], "u double").select("u", hypergeometric_count(F.col("u"), F.lit(size), F.lit(marked), F.lit(taken)).alias("x")).collect()
    for r in got:
        run = 0.0
        for x in order:
            run += p[x] / sum(p.values())
            if run > r.u:
                break
        assert r.x == x, r


ROWS = [(f"{b}-{u}-{k}-{i}", b, u, k) for b, units in (("x", 9), (None, 4)) for u in range(units) for k, m in (("p", 13), ("q", 5 + u), (None, 3)) for i in range(m)]


@pytest.fixture(scope="module")
def members(spark):
    return spark.createDataFrame(ROWS, "id string, b string, u int, k string").cache()


@pytest.fixture(scope="module")
def cells(members):
    return members.groupBy("b", "u", "k").agg(F.count("*").alias("c"))


def test_totals_of_units_and_labels_are_kept(cells):
    unit, label = Counter(), Counter()
    for r in cells.collect():
        unit[r.b, r.u] += r.c
        label[r.b, r.k] += r.c
    got = defaultdict(Counter), defaultdict(Counter)
    for r in N.permuted_cells(cells, ["b"], "u", "k", "c", 6).collect():
        assert r.n > 0
        got[0][r.replicate][r.b, r.u] += r.n
        got[1][r.replicate][r.b, r.k] += r.n
    assert sorted(got[0]) == list(range(1, 7))
    assert all(v == unit for v in got[0].values()) and all(v == label for v in got[1].values())
    drawn = defaultdict(Counter)
    for r in N.drawn_cells(cells, ["b"], "u", "k", "c", 6).collect():
        drawn[r.replicate][r.b, r.u] += r.n
    assert len(drawn) == 6 and all(v == unit for v in drawn.values())


def _mean(null):
    d = D.weighted_distance(D.unit_distances(null, ["b"], "u", "k", "n", extra=["replicate"]), ["replicate"])
    return [r.mean_tvd for r in d.collect()]


@pytest.mark.parametrize("by_cells,by_rows", [(N.drawn_cells, D.drawn_units), (N.permuted_cells, D.permuted_units)])
def test_cells_and_members_agree(members, cells, by_cells, by_rows):
    one = members.filter("b = 'x' AND k IS NOT NULL")
    a = _mean(by_cells(cells.filter("b = 'x' AND k IS NOT NULL"), ["b"], "u", "k", "c", 60))
    b = _mean(by_rows(one, ["b"], "u", "k", "id", 60))
    ma, mb = sum(a) / 60, sum(b) / 60
    sd = math.sqrt(sum((v - mb) ** 2 for v in b) / 59)
    assert len(a) == 60 and abs(ma - mb) < 4 * sd * math.sqrt(2 / 60)


def test_base_of_all_units_and_tables_without_rows(cells):
    got = N.permuted_cells(cells, [], "u", "k", "c", 2)
    assert got.columns == ["replicate", "u", "k", "n"]
    assert got.agg(F.sum("n")).first()[0] == 2 * len(ROWS)
    none = cells.filter("c < 0")
    for f in (N.drawn_cells, N.permuted_cells):
        assert f(none, ["b"], "u", "k", "c", 2).count() == 0
    assert N.leave_one_out_floor(none, ["b"], "u", "k", "c", 2).count() == 0


def test_results_do_not_depend_on_partitions(cells):
    for f in (N.drawn_cells, N.permuted_cells):
        a, b = (sorted(map(str, f(c, ["b"], "u", "k", "c", 2).collect())) for c in (cells.repartition(1), cells.repartition(7, "k")))
        assert a == b


def test_blocks_of_units_are_dealt_to_many_tasks(spark):
    cells = spark.range(600).select((F.col("id") % 200).alias("u"), (F.col("id") % 3).alias("k"), F.lit(4).alias("c"))
    got = N.permuted_cells(cells, [], "u", "k", "c", 5)
    rows = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(rows) > 4 and max(rows) < sum(rows) / 2
