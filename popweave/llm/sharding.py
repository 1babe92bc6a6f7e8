"""Shards of near equal bytes by sampled splitters; DataFrame functions only."""
from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.functions.draws import draw_int
from popweave.llm.common import drop_folder, written_at

RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 32
OVERFULL = 2                   # times the mean range
HOT_SHARE = 64                 # a text that holds more than 1/64 of a shard may be spread
_TOP = 1 << 52                 # keys have 60 bits; the first 8 pick a row of the lookup table


def text_key(text: Column) -> Column:
    """60 bits of the text's md5: copies meet; null goes first."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(-1).cast("bigint"))


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _lookup(spark, bounds: list[tuple[int, int]]) -> DataFrame:
    """Boundaries by the first bits of their key: how many lie before, and those inside. 257 rows."""
    rows, at = [], 0
    for top in range(-1, 256):
        inside = []
        while at < len(bounds) and bounds[at][0] // _TOP <= top:
            inside.append(bounds[at])
            at += 1
        rows.append((top, at - len(inside), inside))
    return spark.createDataFrame(rows, "shard_top int, shard_base int, shard_inside array<struct<k:bigint,t:bigint>>")


def _ranged(d: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The number of the range that (shard_key, shard_tie) falls into; the lookup table has a fixed bound."""
    here = F.struct(F.col("shard_key").alias("k"), F.col("shard_cut").alias("t"))
    return (d.withColumn("shard_top", F.floor(F.col("shard_key") / F.lit(_TOP)).cast("int"))
            .join(F.broadcast(_lookup(d.sparkSession, bounds)), "shard_top")
            .withColumn("shard_range", F.col("shard_base") + F.size(F.filter("shard_inside", lambda b: b <= here)))
            .drop("shard_top", "shard_base", "shard_inside"))


def _draw_bounds(keys: DataFrame, total: int, samples: int, spacing: float, channel: int) -> list[tuple[int, int]]:
    """Size-weighted sample of keys, then its quantiles: a boundary whenever ``spacing`` more bytes lie before it."""
    unit = F.pmod(F.xxhash64("shard_key", "shard_tie", F.lit(channel)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chance = F.col("shard_size") * F.lit(samples / total)
    got = keys.where(unit < chance).select("shard_key", "shard_cut", F.greatest(F.col("shard_size").cast("double"), F.lit(total / samples)).alias("w")).collect()
    bounds, gone = [], 0.0
    for r in sorted(got):
        if gone >= spacing:
            bounds.append((r[0], r[1]))
            gone = 0.0
        gone += r[2]
    return sorted(set(bounds))


def _per_range(keys: DataFrame, bounds: list[tuple[int, int]]) -> list:
    """Bytes of each range and of its largest group of keys that no boundary can divide."""
    groups = _ranged(keys, bounds).groupBy("shard_range", "shard_key", "shard_cut").agg(F.sum("shard_size").alias("b"))
    return sorted(groups.groupBy("shard_range").agg(F.sum("b").alias("b"), F.max("b").alias("most")).collect())


def shard(docs: DataFrame, shards: int = 8, ranges: int | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with its ``shard`` (0 to ``shards`` - 1), ``slot`` (gapless from 0) and ``shard_size``.

    Law ``bytes``: rows stand in the order (text key, draw of the id, id, size); a row's shard is the part of all bytes
    that lies before its text's first copy, times ``shards``, so copies of a text share a shard and sizes differ by one
    text at most. A text that holds more than 1/64 of a shard is hot and goes row by row instead.

    The order is never built in one task: a size-weighted sample of keys (of fixed size, whatever the input) gives
    quantile boundaries, rows are dealt to the ranges between them, and ranges of more than twice the mean are
    subdivided by a finer sample drawn inside them until none is left (but for a group that no key divides). Windows run inside
    a range; bytes before each range and rows before each shard come from tables of one row per range. The result does
    not depend on the sample.

    Nulls: a null text has size 1 and forms one group; null ids share one draw. Empty texts have size 1. Repeated rows
    each get a slot. An empty table gives an empty result. Columns of ``docs`` are kept; those named like a result
    column are replaced.
    """
    spark = docs.sparkSession
    ranges = ranges or shards * RANGES_PER_SHARD
    d = (docs.drop("shard", "slot", "shard_size", "shard_key", "shard_tie", "shard_cut", "shard_range")
         .withColumn("shard_size", byte_size(F.col(text))).withColumn("shard_key", text_key(F.col(text)))
         .withColumn("shard_tie", F.coalesce(draw_int("shard", doc_id), F.lit(0).cast("bigint"))))
    keys, kept = written_at(d.select("shard_size", "shard_key", "shard_tie", F.col(doc_id).alias("shard_id")), "keys")
    total = keys.agg(F.sum("shard_size")).first()[0] or 1
    hot = keys.groupBy("shard_key").agg(F.sum("shard_size").alias("b")).where(F.col("b") * F.lit(shards * HOT_SHARE) > F.lit(total)).select("shard_key")
    hot = [r[0] for r in hot.collect()]                     # fewer than shards * HOT_SHARE
    is_hot = F.col("shard_key").isin(hot) if hot else F.lit(False)
    cut = lambda x: x.withColumn("shard_cut", F.when(is_hot, F.col("shard_tie")).otherwise(F.lit(-1).cast("bigint")))
    keys = cut(keys)

    spacing = total / ranges
    bounds = _draw_bounds(keys, total, ranges * SAMPLES_PER_RANGE, spacing, 0)
    for finer in count(1):
        found = _per_range(keys, bounds)
        over = [r["shard_range"] for r in found if r["b"] - r["most"] > OVERFULL * spacing]
        if not over:
            break
        inside = _ranged(keys, bounds).where(F.col("shard_range").isin(over))
        bounds = sorted({*bounds, *_draw_bounds(inside, total, ranges * SAMPLES_PER_RANGE << 3 * finer, spacing / 2, finer)})

    bytes_before, at = [], 0
    for r in found:
        bytes_before.append((r["shard_range"], at))
        at += r["b"]
    starts = spark.createDataFrame(bytes_before, "shard_range int, shard_before bigint")

    def placed(x: DataFrame, id_col: str) -> DataFrame:
        order = ["shard_key", "shard_tie", id_col, "shard_size"]
        running = W.partitionBy("shard_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        of_text = W.partitionBy("shard_range", "shard_key").orderBy(*order[1:]).rowsBetween(W.unboundedPreceding, W.currentRow)
        x = _ranged(x, bounds).join(F.broadcast(starts), "shard_range")
        x = x.withColumn("shard_start", F.col("shard_before") + F.sum("shard_size").over(running) - F.col("shard_size"))
        x = x.withColumn("shard_start", F.when(is_hot, F.col("shard_start")).otherwise(F.min("shard_start").over(of_text)))
        return x.withColumn("shard", F.floor(F.col("shard_start") * shards / F.lit(total)).cast("int")).drop("shard_before", "shard_start")

    rows_before, at = [], {}
    for r in sorted(placed(keys, "shard_id").groupBy("shard_range", "shard").count().collect()):
        rows_before.append((r[0], r[1], at.get(r[1], 0)))
        at[r[1]] = at.get(r[1], 0) + r[2]
    firsts = spark.createDataFrame(rows_before, "shard_range int, shard int, shard_first bigint")
    drop_folder(spark, kept)
    in_shard = W.partitionBy("shard_range", "shard").orderBy("shard_key", "shard_tie", doc_id, "shard_size")
    return (placed(cut(d), doc_id).withColumn("slot", F.row_number().over(in_shard).cast("bigint") - 1)
            .join(F.broadcast(firsts), ["shard_range", "shard"]).withColumn("slot", F.col("slot") + F.col("shard_first"))
            .drop("shard_range", "shard_first", "shard_key", "shard_tie", "shard_cut"))


def shard_sql(table: str = "documents", shards: int = 8) -> str:
    from popweave.functions.draws import draw_sql
    tie = draw_sql("shard", "doc_id")
    return f"""
WITH steps AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                                                      FROM range(256) r(i))),
d AS (SELECT doc_id, text, octet_length(encode(coalesce(text, ''))) + 1 AS size, coalesce(('0x' || substr(md5(text), 1, 15))::BIGINT, -1) AS k,
             coalesce({tie}, 0) AS tie FROM {table}),
c AS (SELECT text, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                          lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT text FROM d), steps),
g AS (SELECT *, sum(size) OVER (PARTITION BY k) * {shards * HOT_SHARE} > sum(size) OVER () AS hot,
             sum(size) OVER (ORDER BY k, tie, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS own, sum(size) OVER () AS total FROM d),
p AS (SELECT *, ((CASE WHEN hot THEN own ELSE min(own) OVER (PARTITION BY k) END) * {shards} // total)::INT AS shard FROM g)
SELECT p.doc_id, p.size::BIGINT AS size, c.crc::BIGINT AS text_crc32, 'bytes' AS law, p.shard,
       (row_number() OVER (PARTITION BY p.shard ORDER BY k, tie, doc_id, size) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM p JOIN c ON p.text IS NOT DISTINCT FROM c.text"""
