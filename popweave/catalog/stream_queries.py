"""Streaming ingestion run to the end of its source; the result must equal the batch answer."""
import uuid

from pyspark.sql import functions as F

from popweave.catalog import located_sql, query, r
from popweave.catalog.aggregate_queries import COL
from popweave.catalog.join_queries import nation_edges, ringed
from popweave.functions.draws import draw
from popweave.operators import spatial as S
from popweave.session import shared_dir
from popweave.streaming import ingest as I

ENRICHED = "WITH e AS (SELECT event_id, user_id, event_type, value, r_name AS province FROM events JOIN region ON r_regionkey = user_id % 6 WHERE value BETWEEN 1 AND 60) "


def _dirs(t):
    base = f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return base + "/out", base + "/checkpoint"


def enrich(t):
    reg = t.region.select(COL("r_regionkey").cast("bigint").alias("key"), COL("r_name").alias("province"))
    return lambda s: (s.filter(COL("value").between(1, 60)).withColumn("key", COL("user_id") % 6).join(reg, "key")
                      .select("event_id", "user_id", "event_type", "value", "province"))


def stream(t):
    return I.file_stream(t.spark, t.sf_dir, t.events.schema, "events.parquet")


@query("sm1_enrich_and_append", ENRICHED + "SELECT * FROM e")
def _(t):
    out, cp = _dirs(t)
    I.enrich_and_append(stream(t), enrich(t), ["province"], out, cp)
    return t.spark.read.parquet(out)


@query("sm1_running_counters", ENRICHED + "SELECT province, count(*) AS rows, count(*) FILTER (event_type = 'click') AS clicks FROM e GROUP BY 1")
def _(t):
    out, cp = _dirs(t)
    I.running_counters(enrich(t)(stream(t)), ["province"], {"rows": F.count("*"), "clicks": F.sum(F.when(COL("event_type") == "click", 1).otherwise(0))}, out, cp)
    return I.latest_counters(t.spark, out, ["province"], ["rows", "clicks"])


PLACED = ringed(f"SELECT event_id, r_name AS province, x, y FROM {located_sql('events', 'event_id')} JOIN region ON r_regionkey = user_id % 6 WHERE x BETWEEN 2 AND 95 AND y BETWEEN 2 AND 85", "event_id")
METHOD = "CASE WHEN b IS NULL THEN 'unmatched' WHEN b.o THEN 'nearest' ELSE 'within' END"


def place(t):
    """Events in the box, with the nation whose rings they fall into; cells of the rings are written once for all batches."""
    reg = t.region.select(COL("r_regionkey").cast("bigint").alias("key"), COL("r_name").alias("province"))
    edges = nation_edges(t)
    cells = S.ring_cells(edges, "n_nationkey", 5.0, 1.2)

    def of(batch):
        at = batch.select("event_id", (COL("user_id") % 6).alias("key"), (COL("event_id") % 97 + draw("x", "event_id")).alias("x"), (COL("event_id") % 89 + draw("y", "event_id")).alias("y"))
        inside = at.filter(COL("x").between(2, 95) & COL("y").between(2, 85)).join(reg, "key").drop("key")
        return S.point_in_rings(inside, edges, "event_id", "n_nationkey", 5.0, 1.2, cells).select("event_id", F.coalesce("n_nationkey", F.lit(-1)).alias("section"), "distance", "method", "province")
    return of


METHODS = ["within", "nearest", "unmatched"]


def placed(t):
    out, cp = _dirs(t)
    counters = {"input": F.count("*"), **{m: F.count_if(COL("method") == m) for m in METHODS}}
    I.place_and_append(stream(t), place(t), ["province"], counters, out, cp)
    return out


@query("sm1_spatial", PLACED + f"SELECT event_id, province, coalesce(b.k, -1) AS section, round(coalesce(b.d, -1), 6) AS distance, {METHOD} AS method FROM p LEFT JOIN m USING (event_id)")
def _(t):
    rows = t.spark.read.parquet(placed(t) + "/rows")
    return rows.select("event_id", "province", "section", F.round(F.coalesce("distance", F.lit(-1.0)), 6).alias("distance"), "method")


@query("sm1_spatial_counters", PLACED + f"""SELECT province, count(*) AS input, count(*) FILTER (method = 'within') AS within, count(*) FILTER (method = 'nearest') AS nearest,
 count(*) FILTER (method = 'unmatched') AS unmatched FROM (SELECT province, {METHOD} AS method FROM p LEFT JOIN m USING (event_id)) GROUP BY 1""")
def _(t):
    return I.summed_counters(t.spark, placed(t), ["province"], ["input", *METHODS])


@query("sm3_resume_log", "SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 60)")
def _(t):
    out, cp = _dirs(t)
    keys = ["user_id", "event_type"]
    I.resume_log(stream(t).select(*keys), t.events.filter("value > 60").select(*keys).distinct(), keys, out, cp)
    return t.spark.read.parquet(out).select(*keys)
