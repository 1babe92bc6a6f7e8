"""Streams in several runs against the batch answer, and table functions."""
from pyspark.sql import functions as F

from popweave.operators import spatial as S
from popweave.sources import normalisers as N
from popweave.streaming import ingest as I


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_log_resumes_without_state(spark, tmp_path):
    """Three runs, the last with a new checkpoint: every key once, null keys too, nothing kept between batches."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "uid bigint, replica int, note string"
    first = [(1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (None, 1, "d"), (3, 9, "done")]
    second = [(1, 1, "again"), (2, 2, "e"), (None, 1, "f"), (4, 1, "g")]
    done = spark.createDataFrame([(3, 9)], "uid bigint, replica int")
    stream = lambda: I.file_stream(spark, src, spark.createDataFrame([], schema).schema)                     # noqa: E731
    for data, checkpoint in ((first, "one"), (second, "one"), (first, "two")):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(src)
        I.resume_log(stream(), done, ["uid", "replica"], out, str(tmp_path / checkpoint))
        kept = rows(spark.read.parquet(out).select("uid", "replica"))
        assert kept == sorted({tuple(r) for r in spark.read.parquet(src).select("uid", "replica").collect()} - {(3, 9)}, key=str)
    assert not list((tmp_path / "one").glob("state")) and not list((tmp_path / "two").glob("state"))


def test_placed_stream_over_two_runs_equals_batch(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    square = [(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 10.0, 10.0), (3, 0.0, 10.0)]
    corners = [(k, 0, i, x + 20 * k, y) for k in range(3) for i, x, y in square] + [(0, 1, i, 3 + x / 5, 3 + y / 5) for i, x, y in square]
    edges = S.ring_edges(spark.createDataFrame(corners, "poly int, ring int, seq int, x double, y double"), "poly")
    cells = S.ring_cells(edges, "poly", 3.0, 0.5)
    points = spark.range(900).selectExpr("id", "id % 31 * 2.0 + 0.25 AS x", "id % 29 * 0.5 - 1.1 AS y", "id % 3 AS province")
    place = lambda b: S.point_in_rings(b, edges, "id", "poly", 3.0, 0.5, cells)                              # noqa: E731
    counters = {"n": F.count("*"), "within": F.count_if(F.col("method") == "within")}
    for part in (points.where("id < 400"), points.where("id >= 400")):
        part.repartition(2).write.mode("append").parquet(src)
        I.place_and_append(I.file_stream(spark, src, points.schema), place, ["province"], counters, out, checkpoint)
    whole = S.point_in_rings(points, edges, "id", "poly", 3.0, 0.5)
    columns = ["id", "province", "poly", "distance", "method"]
    assert rows(spark.read.parquet(out + "/rows").select(*columns)) == rows(whole.select(*columns))
    assert rows(I.summed_counters(spark, out, ["province"], list(counters))) == rows(whole.groupBy("province").agg(*[c.alias(n) for n, c in counters.items()]))


def test_table_function_takes_parameters_and_pushes_filters_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "concat('k', id % 7) AS name", "'unused' AS other").write.parquet(path)
    N.table_function(spark, "by_name", "chiave STRING, peso BIGINT", "SELECT name, count(*) FROM {t} WHERE id >= by_name.least GROUP BY name", "least BIGINT", t=spark.read.parquet(path))
    got = spark.sql("SELECT * FROM by_name(30) WHERE chiave = 'k3'")
    assert rows(got) == [("k3", sum(i % 7 == 3 for i in range(30, 100)))]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,k3)" in plan and "other" not in plan and "Python" not in plan


def test_registry_of_the_caller(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    before = dict(N.BUILDERS)
    mine = {**N.BUILDERS, "count": lambda d, by: d.groupBy(by).count()}
    assert rows(N.ingest("count", df, registry=mine, by="k")) == [("a", 2), ("b", 1)]
    assert before == N.BUILDERS
