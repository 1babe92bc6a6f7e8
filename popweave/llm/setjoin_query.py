from __future__ import annotations

from popweave.llm import setjoin
from popweave.llm.registry import query, table


@query("op13_set_relations", setjoin.jaccard_sql())
def op13_set_relations(spark, sf_dir):
    """Component of every document by 5-word shingles, similarity 0.8."""
    return setjoin.jaccard_classes(table(spark, sf_dir, "documents"))
