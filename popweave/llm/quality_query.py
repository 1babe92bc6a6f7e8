from __future__ import annotations

from pyspark.sql import functions as F

from popweave.llm import quality
from popweave.llm.common import crc_mod
from popweave.llm.registry import query, table


@query("op2_compression")
def op2_compression(spark, sf_dir):
    """Quality of every document, learned from the labels of four fifths of the rows."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("quality is not null").where(crc_mod("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    return got.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
