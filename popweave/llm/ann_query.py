from __future__ import annotations

from pyspark.sql import functions as F

from popweave.llm import ann
from popweave.llm.registry import query, table


@query("op9_prefix_forest")
def op9_prefix_forest(spark, sf_dir):
    """Ten nearest vectors of every row whose id is divisible by 100, over all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_forest(vectors), vectors.where(F.col("vec_id") % 100 == 0), k=10)
