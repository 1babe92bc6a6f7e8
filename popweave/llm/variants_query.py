from __future__ import annotations

from popweave.llm import variants
from popweave.llm.registry import query, table


@query("op12_node_pairs", variants.variants_sql())
def op12_node_pairs(spark, sf_dir):
    """Frequent words with their near words, form and root."""
    return variants.variants_of_documents(table(spark, sf_dir, "documents"))
