from __future__ import annotations

from popweave.llm import trie
from popweave.llm.registry import query, table


@query("op11_depth_bands", trie.prefix_trie_sql())
def op11_depth_bands(spark, sf_dir):
    """Nodes of the trie of rebuilt conversations, with totals of their subtrees."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
