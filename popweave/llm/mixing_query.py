from __future__ import annotations

from pyspark.sql import functions as F

from popweave.llm import mixing
from popweave.llm.registry import query, table


@query("op6_mixing", mixing.mix_sql())
def op6_mixing(spark, sf_dir):
    """Words that the mix takes of every document."""
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
                      (F.col("mix_copies") * F.col("mix_size")).cast("bigint").alias("taken"))
