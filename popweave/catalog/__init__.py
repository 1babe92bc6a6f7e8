"""Queries over the given tables, each with the equivalent SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from popweave.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn
    return wrap


def load_all() -> None:
    from importlib import import_module
    from pathlib import Path
    for p in sorted(Path(__file__).parent.glob("*_queries.py")):
        import_module(f"popweave.catalog.{p.stem}")


def r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round result columns at the edge of a query."""
    from pyspark.sql import functions as F
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


def located(t: Tables, name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Stand-in coordinates: key modulo plus a hash draw."""
    from pyspark.sql import functions as F
    from popweave.functions.draws import draw
    return (getattr(t, name).withColumn("x", F.col(key) % 97 + draw("x", key)).withColumn("y", F.col(key) % 89 + draw("y", key)))


def located_sql(name: str = "customer", key: str = "c_custkey") -> str:
    from popweave.functions.draws import draw_sql
    return f"(SELECT *, {key} % 97 + {draw_sql('x', key)} AS x, {key} % 89 + {draw_sql('y', key)} AS y FROM {name})"


def match_sql(threshold: float) -> str:
    """Greedy pairs of customers and suppliers, taken one after the other: ``m(a, b, d)``."""
    return f"""WITH RECURSIVE l AS (SELECT c_custkey AS a, x, y FROM {located_sql()}), r AS (SELECT s_suppkey AS b, x AS bx, y AS bz FROM {located_sql('supplier', 's_suppkey')}),
p AS (SELECT sqrt((x - bx) ** 2 + (y - bz) ** 2) AS d, a, b FROM l, r WHERE sqrt((x - bx) ** 2 + (y - bz) ** 2) <= {threshold}),
g AS (SELECT 0 AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub, (SELECT min({{'d': d, 'a': a, 'b': b}}) FROM p) AS e
      UNION ALL SELECT k + 1, list_append(ua, e.a), list_append(ub, e.b), (SELECT min({{'d': p.d, 'a': p.a, 'b': p.b}}) FROM p WHERE NOT list_contains(list_append(ua, e.a), p.a) AND NOT list_contains(list_append(ub, e.b), p.b))
      FROM g WHERE e IS NOT NULL),
m AS (SELECT e.a AS a, e.b AS b, e.d AS d FROM g WHERE e IS NOT NULL) """
