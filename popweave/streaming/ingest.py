"""Bounded-memory ingestion with Structured Streaming."""
from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOG_PARTS = 64


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*", fmt: str = "parquet", files_per_trigger: int = 1, **options) -> DataFrame:
    """File source read a few files at a time."""
    return (spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).options(**options).load(folder))


def enrich_and_append(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], partition_by: Sequence[str], out: str, checkpoint: str) -> None:
    """Enrich a stream against static tables and append to partitioned files until the source is used up."""
    q = (enrich(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy(*partition_by)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def place_and_append(stream: DataFrame, place: Callable[[DataFrame], DataFrame], partition_by: Sequence[str], counters: dict[str, Column], out: str, checkpoint: str) -> None:
    """Place every micro-batch with ``place`` (joins against static tables), append its rows under ``out/rows`` by
    ``partition_by``, and in the same run its counters by the same columns under ``out/counters``.

    Rows and counters of a micro-batch stand under its number and are written anew if it is repeated, so a restart
    neither loses nor doubles any. Counters are read back from the rows written, so a batch is placed once; nothing is
    kept between batches.
    """
    rows, counts = os.path.join(out, "rows"), os.path.join(out, "counters")

    def save(batch: DataFrame, no: int) -> None:
        path, placed = os.path.join(rows, f"batch={no}"), place(batch)
        placed.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        done = batch.sparkSession.read.schema(placed.schema).parquet(path)
        done.groupBy(*partition_by).agg(*[e.alias(n) for n, e in counters.items()]).write.mode("overwrite").parquet(os.path.join(counts, f"batch={no}"))

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def summed_counters(spark: SparkSession, out: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Counters of ``place_and_append`` over all micro-batches."""
    return spark.read.parquet(os.path.join(out, "counters")).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def running_counters(stream: DataFrame, keys: Sequence[str], counters: dict[str, Column], out: str, checkpoint: str) -> None:
    """Stateful counters per key; every micro-batch writes the keys it changed under its batch number."""
    agg = stream.groupBy(*keys).agg(*[e.alias(n) for n, e in counters.items()])

    def save(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={no}"))

    q = agg.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_counters(spark: SparkSession, out: str, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    d = spark.read.parquet(out)
    return d.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("c")).select(*keys, "c.*")


def _not_in(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys do not stand in ``other``; nulls are equal."""
    return rows.alias("l").join(other.select(*keys).alias("r"), F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in keys)), "left_anti")


def resume_log(stream: DataFrame, done: DataFrame, keys: Sequence[str], out: str, checkpoint: str) -> None:
    """Append to the log ``out`` only keys that are neither in ``done`` nor in the log already, each once.

    The log is the memory: every micro-batch is reduced to distinct keys and anti-joined with ``done`` and with what
    other batches wrote, so no state is kept for keys that were seen, in however many runs, and a run whose checkpoint is
    lost appends nothing twice. Null keys are keys like others. The log is dealt to parts by a hash of the keys and joined on part and keys; Spark
    then reads only the parts that a small batch meets. A batch that is repeated writes its own folder anew.
    """
    keys = list(keys)
    part = F.pmod(F.xxhash64(*keys), F.lit(LOG_PARTS)).cast("int").alias("part")
    stream.sparkSession.createDataFrame([], stream.select(*keys).schema).write.mode("overwrite").parquet(os.path.join(out, "batch=none", "part=0"))
    schema = stream.select(*keys).withColumn("batch", F.lit("")).withColumn("part", F.lit(0)).schema
    name = os.path.basename(checkpoint.rstrip("/"))

    def save(batch: DataFrame, no: int) -> None:
        own = f"{name}-{no}"
        log = batch.sparkSession.read.schema(schema).parquet(out).where(F.col("batch") != own).select("part", *keys)
        fresh = _not_in(batch.dropDuplicates(keys), done, keys).select(*keys, part)
        _not_in(fresh, log, ["part", *keys]).write.mode("overwrite").partitionBy("part").parquet(os.path.join(out, f"batch={own}"))

    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
