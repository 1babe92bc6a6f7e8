from __future__ import annotations

from popweave.llm import langid
from popweave.llm.common import crc_mod
from popweave.llm.registry import query, table


@query("op5_rank_order")
def op5_rank_order(spark, sf_dir):
    """Language of every document, profiles learned from two thirds of the rows."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(docs.where(crc_mod("doc_id", 3) != 1))
    got = langid.identify(docs, profiles)
    return got.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
