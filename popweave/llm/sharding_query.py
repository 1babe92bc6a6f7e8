from __future__ import annotations

from pyspark.sql import functions as F

from popweave.llm import sharding
from popweave.llm.registry import query, table


@query("op10_sharding", sharding.shard_sql())
def op10_sharding(spark, sf_dir):
    """Shard and slot of every document, sizes near equal."""
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return sharding.shard(docs).select("doc_id", F.col("shard_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                       F.lit(None).cast("int").alias("grown_shard"))
