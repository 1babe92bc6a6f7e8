"""Mixing sources to target weights by systematic sampling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.functions.draws import draw, draw_sql
from popweave.llm.common import written
from popweave.session import salt_count

REPEATS = 3                    # no document is taken more often


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space (code points 9 to 13 and 32); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """Sizes of about the same magnitude (within 1/16): bit length and the four bits behind the first."""
    length = F.length(F.bin(size))
    top = F.call_function("shiftright", size, F.greatest(length - F.lit(5), F.lit(0)).cast("int"))
    return (length * F.lit(32) + top).cast("int")


def size_class_sql(size: str) -> str:
    return f"CAST(length(bin({size})) * 32 + ({size} >> CAST(greatest(length(bin({size})) - 5, 0) AS INT)) AS INT)"


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` to ``(source, source_size, target)``.

    Sources by code point, null last, weigh 1, 2, 3 in turn and share the sum of all sizes. A target stops at
    ``REPEATS`` times its source's size. Filling up to a common level solves the resharing in one go: with sources by
    ``cap / weight``, the first k are full for the smallest k at which the level of the others is below the next cap.
    One row per source: the windows see the table of sources only, never documents.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    t = (sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("bigint")).withColumn("cap", F.lit(REPEATS) * F.col("source_size")))
    by_level = W.orderBy(F.col("cap") * F.lit(6) / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    t = (t.withColumn("left_words", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("open", F.col("left_words") * F.col("weight") <= F.col("cap") * F.col("left_weight")))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") * F.lit(6) / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"), "left_words", "left_weight"))).over(all_)
    t = t.withColumn("level", first)
    target = F.when(F.col("open"), F.col("weight") * F.col("level.left_words") / F.col("level.left_weight")).otherwise(F.col("cap").cast("double"))
    return t.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).cast("double").alias("target"))


def mix(docs: DataFrame, channel: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` with how often the mix takes it.

    Returns the columns of ``docs`` plus ``mix_size`` (words), ``mix_source_size``, ``mix_target`` (words, of the
    source) and ``mix_copies``. In a source every document expects ``target / source_size`` copies. Documents stand in
    the order (size class, draw of the id, id, size); the running sum of expected copies plus one random offset per
    source gives a copy at each whole number that it crosses, so a document gets the expectation rounded down or up,
    never more than three, and the words taken keep close to the target within every size class.

    A source is cut into slices (class and part of the draw's range); slice counts, a small table, give the offset of
    each slice, so a source that holds a third of all rows is spread over all tasks. Only a hash of rows decides:
    reruns agree.

    Nulls: a null text has size 0; a null source is a source of its own, last in order; null ids share one draw.
    Sources whose size is 0 have target 0 and take nothing. Repeated rows each count. An empty table gives an empty
    result. Columns of ``docs`` are kept (those named like a result column are replaced).
    """
    slices = salt_count(docs.sparkSession)
    key = ["mix_source", "mix_class", "mix_slice"]
    d = (docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
         .withColumn("mix_source", F.col(source)).withColumn("mix_size", word_count(F.col(text)))
         .withColumn("mix_draw", F.coalesce(draw(channel, doc_id), F.lit(0.0)))
         .withColumn("mix_class", size_class(F.col("mix_size")))
         .withColumn("mix_slice", F.floor(F.col("mix_draw") * slices).cast("int"))
         .withColumn("mix_key", F.struct(*key)))
    parts = written(d.groupBy("mix_key").agg(F.count(F.lit(1)).alias("n"), F.sum("mix_size").alias("words")), "parts")
    of_source = W.partitionBy("mix_key.mix_source").orderBy("mix_key.mix_class", "mix_key.mix_slice").rowsBetween(W.unboundedPreceding, -1)
    per = targets(parts.groupBy(F.col("mix_key.mix_source").alias("source")).agg(F.sum("words").alias("source_size")))
    offsets = parts.select("mix_key", F.coalesce(F.sum("n").over(of_source), F.lit(0)).alias("mix_before"))
    offsets = (offsets.join(per, offsets["mix_key.mix_source"].eqNullSafe(per["source"]))
               .withColumn("mix_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
               .withColumn("mix_start", draw(channel + "-offset", F.coalesce(F.col("source"), F.lit(""))))
               .select("mix_key", "mix_before", "mix_rate", "mix_start", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")))
    inside = F.row_number().over(W.partitionBy("mix_key").orderBy("mix_draw", doc_id, "mix_size"))
    ranked = d.withColumn("mix_rank", inside).join(offsets, "mix_key")
    upto = lambda k: F.floor(F.col("mix_rate") * k + F.col("mix_start"))                                   # noqa: E731
    at = F.col("mix_before") + F.col("mix_rank")
    return (ranked.withColumn("mix_copies", (upto(at) - upto(at - 1)).cast("int"))
            .drop("mix_key", *key, "mix_draw", "mix_rank", "mix_before", "mix_rate", "mix_start"))


def mixed(docs: DataFrame, channel: str = "mix", text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: rows of ``docs`` with their own columns, each as often as it is taken."""
    own = {c: f"own_{c}" for c in docs.columns if c.startswith("mix_")}
    got = mix(docs.withColumnsRenamed(own), channel, text, source, doc_id).where("mix_copies > 0")
    copies = got.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return copies.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def mix_sql(table: str = "documents", channel: str = "mix") -> str:
    """The same mix for the SQL side of a check."""
    level = "cap * 6.0::DOUBLE / weight, source IS NULL, source"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  {draw_sql(channel, 'doc_id')} AS draw FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, {REPEATS} * source_size AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS left_words,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight
      FROM w WINDOW b AS (ORDER BY {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, left_words * weight <= cap * left_weight AS is_open FROM f),
l AS (SELECT left_words, left_weight FROM o WHERE is_open ORDER BY {level} LIMIT 1),
t AS (SELECT o.source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN is_open THEN (weight * l.left_words)::DOUBLE / l.left_weight::DOUBLE
             ELSE cap::DOUBLE END::DOUBLE AS target FROM o LEFT JOIN l ON true),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             {draw_sql(channel + '-offset', "coalesce(d.source, '')")} AS start,
             row_number() OVER (PARTITION BY d.source ORDER BY {size_class_sql('size')}, draw, doc_id, size) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * k + start) - floor(rate * (k - 1) + start))::BIGINT * size)::BIGINT AS taken FROM r"""
