from __future__ import annotations

from pyspark.sql import functions as F

from popweave.llm import decontam
from popweave.llm.registry import query, table


@query("op1_positional_index", decontam.contamination_sql())
def op1_positional_index(spark, sf_dir):
    """Words of every document that lie in 13-word runs of benchmark items."""
    got = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
