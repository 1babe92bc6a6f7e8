from __future__ import annotations

from popweave.llm import neardup
from popweave.llm.registry import query, table


@query("op7_superminhash", neardup.near_duplicates_sql())
def op7_superminhash(spark, sf_dir):
    """Component of every document by 3-word shingles, similarity 0.85."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)
