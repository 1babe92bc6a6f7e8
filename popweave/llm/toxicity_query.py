from __future__ import annotations

from pyspark.sql import functions as F

from popweave.llm import toxicity
from popweave.llm.common import crc_mod
from popweave.llm.registry import query, table


@query("op4_convolution")
def op4_convolution(spark, sf_dir):
    """Toxicity of every document, learned from the labels of three quarters of the rows."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null").where(crc_mod("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(docs, model)
    return got.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "rejected")
