"""The prefix trie against SQL on odd, deep and hot conversations, and its digests against hashlib."""
import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from harness import canon
from popweave.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def same_as_sql(df):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in df.select("conv_id", "turn", "role", "text").collect()] or [[None] * 4])
    cur = con.execute(trie.prefix_trie_sql())
    got = trie.prefix_trie(df)
    cols, want = [d[0] for d in cur.description], cur.fetchall()
    rows = got.collect()
    assert canon(got.columns, rows) == canon(cols, want)
    return rows


def test_odd_rows_and_clashing_columns(spark):
    rows = [(0, None, "user", "first of all"), (0, 1, None, "second"), (0, 1, None, "second"), (0, 2, "user", None), (20, 5, "user", "first of all"), (-20, 1, "a", ""), (-3, 1, "a", "x y z"),
            (None, 1, "user", "nobody"), (7, 1, "user", "own words"), (7, 2, "assistant", "more own words"), (8, None, None, None), (27, 3, "user", "donor is 20"), (41, 1, "q", "absent donor"),
            (43, 1, "q", "one turn"), (44, 1, "q", "one turn"), (46, 1, "q", "one turn"), (47, 0, "user", "w " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "path", "d", "g", "leaf", "saved", "up", "turns", "h", "words", "depth", "n_convs"):
        df = df.withColumn(c, F.lit("clash"))
    got = same_as_sql(df)
    assert sum(r["depth"] == 0 for r in got) == 1


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bands_of_bands(spark):
    """Depths beyond two levels of bands, branches at every depth."""
    rnd = random.Random(5)
    trunk = [("user", f"turn {i} of the trunk") for i in range(200)]
    rows = []
    for c in range(30):
        cut = rnd.choice([0, 7, 8, 9, 63, 64, 65, 72, 128, 130, 199])
        talk = trunk[:cut] + [("b", f"own {c} {i}") for i in range(rnd.choice([0, 1, 3, 70]))]
        rows += [(100 + c, i, *t) for i, t in enumerate(talk)]
    got = same_as_sql(spark.createDataFrame(rows, SCHEMA))
    assert max(r["depth"] for r in got) > trie.BAND ** 2


@pytest.mark.parametrize("stretch", [16])
def test_a_conversation_in_many_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rows = [(c, i, "u", f"{i % 7}" if c < 42 or i < 90 else "other") for c in (40, 41, 42, 43) for i in range(100)]
    same_as_sql(spark.createDataFrame(rows, SCHEMA))


def test_many_ids_end_in_one_node(spark):
    ids = [*range(-5000, 5000), 1 << 40, -(1 << 40)]
    df = spark.createDataFrame([(i, 0, "user", "hello") for i in ids], SCHEMA)
    leaf = next(r for r in trie.prefix_trie(df).collect() if r["depth"] == 1)
    have = set(ids)
    members = [c for c in sorted(ids) if c - int(math.fmod(c, 20)) in have or zlib.crc32(str(c).encode()) % 4 == 0]
    assert leaf["n_convs"] == len(members)
    assert leaf["ends_sha256"] == hashlib.sha256(",".join(map(str, members)).encode()).hexdigest()
