"""The exact Jaccard join against all pairs."""
import random

import pytest
from pyspark.sql import functions as F

from popweave.llm import setjoin
from popweave.llm.neardup import tokens

SCHEMA = "doc_id bigint, text string"


def brute(rows, k=5, percent=80):
    sets = []
    for _, t in rows:
        w = tokens(t) if t else []
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i, (a, x) in enumerate(zip(rows, sets, strict=True)):
        for j in range(i):
            b, y = rows[j], sets[j]
            if a[0] is None or b[0] is None:
                continue
            alike = x and y and 100 * len(x & y) >= percent * len(x | y)
            links += bool(alike)
            if alike or a[0] == b[0]:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr), links


def check(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    for c in ("id", "n", "digest", "prefix", "row", "node", "label", "token", "block", "pos", "members", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    want, links = brute(rows)
    assert sorted((tuple(r) for r in setjoin.jaccard_classes(df).collect()), key=repr) == want
    return links


def changed(words, share, rnd, vocabulary):
    return [rnd.choice(vocabulary) if rnd.random() < share else w for w in words]


@pytest.mark.parametrize("block", [150, 5])
def test_against_all_pairs(spark, monkeypatch, block):
    """Near copies just above and below the threshold, chains of them, common passages; also with tiny blocks."""
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rnd = random.Random(block)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]            # noqa: E731
    license_ = prose(60)
    texts = []
    for _ in range(8):
        base = prose(rnd.choice([12, 60, 200, 400]))
        texts += [base] + [changed(base, rnd.choice([0.0, 0.01, 0.02, 0.025, 0.03, 0.04]), rnd, vocabulary) for _ in range(rnd.choice([1, 5, 14]))]
        drift = base
        for _ in range(5):
            drift = changed(drift, 0.02, rnd, vocabulary)
            texts.append(drift)
    texts += [prose(rnd.choice([3, 20, 80])) + license_ for _ in range(30)] + [license_] + [license_[:-i] for i in range(1, 14)]
    rnd.shuffle(texts)
    rows = [(i * 3 - 50, " ".join(t)) for i, t in enumerate(texts)]
    assert check(spark, rows) > 50


def test_odd_rows(spark):
    rnd = random.Random(1)
    prose = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    x, y = prose(100), prose(100)
    nearly_y, long_ = " ".join(y.split()[:97]), prose(60_000)
    rows = [(1, x), (1, y), (2, nearly_y), (3, x), (4, None), (5, ""), (6, " \n\t"), (7, "Two WORDS"), (8, "two words"), (None, x), (None, None), (9, long_), (10, long_ + " end"), (10, None),
            (11, "same " * 50), (12, "same " * 70), (12, "same " * 70), (-4, "ÀB cd"), (13, "àb cd"), (14, x.upper())]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        check(spark, rows, parts=1 + seed * 4)


def test_tiles_share_a_pass_and_keep_rows_with_a_partner(spark):
    """Many tiny tiles are gone through together, with the same rows kept as by all pairs."""
    rnd = random.Random(4)
    rows = [(rnd.randrange(300), 0, rnd.randrange(2), rnd.randrange(2), i, rnd.choice([50, 80, 100, 101]), rnd.randrange(30), rnd.randrange(3)) for i in range(1500)]
    tiles = spark.createDataFrame(rows, "token bigint, x bigint, y bigint, block bigint, node bigint, n bigint, pos int, label bigint")
    bits = spark.createDataFrame([(i, bytes([rnd.choice([0, 0, 0, 1])]) * rnd.choice([32, 64])) for i in range(1500)], "node bigint, bits binary")
    maps, want = {r["node"]: r["bits"] for r in bits.collect()}, set()
    for a in rows:
        for b in rows:
            able = a[:3] == b[:3] and a[4] != b[4] and a[7] != b[7] and (a[1] == a[2] or a[3] != b[3]) and 180 * min(a[5] - a[6], b[5] - b[6]) >= 80 * (a[5] + b[5])
            if able and 180 * int(setjoin._apart([maps[a[4]]], [maps[b[4]]])[0]) <= 20 * (a[5] + b[5]):
                want.add(a)
    got = setjoin._near_rows(tiles, bits, 80)
    kept = {tuple(r) for r in got.collect()}
    assert kept == want
    assert 30 < len(want) < 1400
    assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_many_texts_in_one_pass():
    texts = ["a b c", "", None, " \t A b\x0bc D e f ", "x" * 3000, "x" * 2999 + "y", "Été ЖУК", "été жук", "a B\nc", "\ud800 b"]
    got = setjoin._shingled(texts, 2)
    assert [len(g) for g in got] == [max(len(tokens(t)) - 1, min(1, len(tokens(t)))) if t else 0 for t in texts]
    assert (got[0] == got[8]).all() and (got[0] == got[3][:2]).all() and got[4][0] != got[5][0] and got[6][0] != got[7][0]
    assert all((a == b).all() for t, a in zip(texts, got, strict=True) for b in setjoin._shingled([t], 2))


def test_empty(spark):
    assert setjoin.jaccard_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert check(spark, [(1, None), (2, "")]) == 0
