"""Ranks, totals, quantiles and draws: exact, and independent of partitioning and slicing."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popweave.functions.draws import draw
from popweave.plans import intervals, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, many equal values, negatives, tiny and huge values, a null key."""
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({"id": np.arange(n), "g": np.where(np.arange(n) % 3 == 0, "hot", [f"g{i % 7}" for i in range(n)]),
                        "v": np.where(rng.random(n) < 0.4, 5.0, rng.normal(0, 1, n) * 10.0 ** rng.integers(-6, 9, n))})
    pdf.loc[pdf.id % 50 == 1, "g"] = None
    return spark.createDataFrame(pdf), pdf


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def test_rank_by_value_matches_pandas(skewed):
    df, pdf = skewed
    got = {r["id"]: r["rank"] for r in ranking.rank_by_value(df, ["g"], "v", "id").collect()}
    want = pdf.sort_values(["v", "id"]).assign(r=lambda d: d.groupby("g", dropna=False).cumcount() + 1)
    assert got == dict(zip(want.id, want.r))


def test_ranks_do_not_depend_on_partitions_or_slices(spark, skewed):
    df, _ = skewed
    a = _rows(ranking.rank_by_draw(df.withColumn("u", draw("t", "id")).repartition(1), ["g"], "u", ["id"]), "id", "rank")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    b = _rows(ranking.rank_by_draw(df.withColumn("u", draw("t", "id")).repartition(64), ["g"], "u", ["id"]), "id", "rank")
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_magnitude_slice_is_monotone(spark):
    v = sorted(float(s * m * 10.0 ** e) for s in (-1, 1) for m in (1, 1.5, 2.25, 9.99) for e in range(-8, 16)) + [0.0]
    df = spark.createDataFrame([(x,) for x in sorted(v)], "v double").withColumn("s", ranking.magnitude_slice(F.col("v")))
    s = [r["s"] for r in df.orderBy("v").collect()]
    assert s == sorted(s)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 1.0])
def test_quantiles_match_numpy(skewed, q):
    df, pdf = skewed
    got = {r["g"]: r["q"] for r in ranking.quantiles(df, ["g"], "v", {"q": q}).collect()}
    for g, d in pdf.groupby("g", dropna=False):
        want = np.quantile(d.v, q)
        assert got[None if pd.isna(g) else g] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_weighted_quantile_takes_first_share_reached(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 2.0)], "v double, w double")
    r = ranking.quantiles(df, [], "v", {"a": 0.25, "b": 0.5, "c": 0.51}, F.col("w"), "first").first()
    assert (r["a"], r["b"], r["c"]) == (1.0, 2.0, 3.0)


def test_average_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0)], "g string, v double")
    assert sorted(r["rank"] for r in ranking.average_rank(df, ["g"], "v").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_previous_value_crosses_slices(spark):
    v = [1, 2, 40, 41, 5000, 10 ** 6]
    df = spark.createDataFrame([("g", x, i) for i, x in enumerate(v)], "g string, v long, i long")
    got = {r["v"]: r["prev_v"] for r in ranking.previous_value(df, ["g"], "v", "i", ["v"]).collect()}
    assert got == dict(zip(v, [None] + v[:-1]))


def test_pick_gives_every_person_exactly_one_entry(spark):
    people = spark.range(5000).select(F.col("id"), (F.col("id") % 3).alias("c"))
    table = spark.createDataFrame([(c, k, w) for c in range(3) for k, w in enumerate([1, 0, 5000, 3, 1])], "c long, k long, w long")
    cum = intervals.cumulative_table(table, ["c"], "w", ["k"])
    got = intervals.pick(people, cum, ["c"], ["k"], u=draw("p", "id"))
    assert got.count() == 5000 and got.select("id").distinct().count() == 5000
    share = got.filter("k = 2").count() / 5000
    assert abs(share - 5000 / 5005) < 0.01


def test_range_lookup(spark):
    bands = spark.createDataFrame([("a", 0, 4), ("b", 5, 9)], "band string, lo int, hi int")
    got = intervals.range_lookup(spark.range(12).withColumnRenamed("id", "age"), "age", bands, "lo", "hi")
    assert got.filter("band = 'b'").count() == 5 and got.count() == 10


def test_a_hot_group_is_spread_over_slices(spark):
    n = 20000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.lit(5.0).alias("v"))
    hot = df.filter("g = 'hot'")
    by_draw = hot.withColumn("u", draw("s", "id")).groupBy(ranking._draw_slice(hot, "u")).count().agg(F.max("count")).first()[0]
    by_tie = hot.groupBy(ranking.magnitude_slice(F.col("id"))).count().agg(F.max("count")).first()[0]
    assert by_draw < n / 3 / 4 and by_tie <= n / 3 / 500
    ranks = ranking.rank_by_value(df, ["g"], "v", "id").filter("g = 'hot'").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ranks) == (1, hot.count(), hot.count())


def test_cut_lineage_keeps_rows_and_schema(spark):
    from popweave.session import cut_lineage
    df = spark.range(10).select("id", F.struct("id").alias("s"), F.lit(None).cast("string").alias("n"))
    got = cut_lineage(df)
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(r["id"] for r in got.collect()) == list(range(10))


def test_ranks_leave_out_slices_without_a_partner(spark):
    d = spark.range(20_000).select("id", (F.col("id") % 3).alias("k"), draw("rank-most", "id").alias("u"))
    most = spark.createDataFrame([(0, 50), (1, 4000)], "k bigint, __most bigint")
    full = {r["id"]: r["rank"] for r in ranking.rank_by_draw(d, ["k"], "u", ["id"]).collect()}
    slices = ranking.slices_by_draw(d, ["k"], "u")
    assert {r["k"]: r["__most"] for r in ranking.sizes_of_slices(slices, ["k"]).collect()} == {0: 6667, 1: 6667, 2: 6666}
    got = ranking.rank_by_draw(d, ["k"], "u", ["id"], "rank", slices, most).collect()
    assert all(full[r["id"]] == r["rank"] for r in got)
    assert {r["k"] for r in got} == {0, 1} and 4050 <= len(got) < 7000
    for k, n in ((0, 50), (1, 4000)):
        assert set(range(1, n + 1)) <= {r["rank"] for r in got if r["k"] == k}
