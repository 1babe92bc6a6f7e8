"""Every registered query against its SQL on the smallest tables."""
import pytest

from harness import compare, sql_connection
from popweave.catalog import QUERIES, SQL, load_all

load_all()
SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"hh6_assembly", "hh8_assembly_summary",
             "sv6_logit", "sv11_chi_square_p"}


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF)


def test_queries_without_sql_are_the_known_ones():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


def test_every_inventory_entry_has_a_query():
    counts = {"src": 25, "dq": 24, "fn": 22, "pf": 12, "jn": 15, "ag": 31, "wn": 8, "st": 4, "as": 18, "ip": 10, "hh": 14, "ds": 21, "ge": 7, "sv": 21, "ud": 3}
    have = {q.split("_")[0] for q in QUERIES}
    want = {f"{k}{i}" for k, n in counts.items() for i in range(1, n + 1)} | {"sm1", "sm3"}
    assert want <= have


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    state, message, n, _ = compare(spark, con, name, SF)
    assert state in ("ok", "rows-only"), message
    if state == "rows-only":
        assert n > 0
