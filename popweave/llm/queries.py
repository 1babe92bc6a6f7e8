"""Loads the queries of all operators."""
from popweave.llm import ann_query, decontam_query, langid_query, mixing_query, neardup_query, passages_query, quality_query, setjoin_query, sharding_query, toxicity_query, trie_query, variants_query, warc_query  # noqa: F401
from popweave.llm.registry import QUERIES, SQL  # noqa: F401
