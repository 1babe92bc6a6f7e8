"""Spelling variants against brute force over all pairs of words, and their counting against a plain loop."""
import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from popweave.llm import variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(count):
    out = {}
    for w, n in count.items():
        by = sorted((-count[v], v) for v in count if near(w, v))
        form = by[0][1] if by and -by[0][0] >= 5 * n else None
        out[w] = [n, len(by), form, count[form] if form else None]
    for w in out:
        r = w
        while out[r][2]:
            r = out[r][2]
        out[w].append(r)
    return out


def rows(df):
    return {r["word"]: [r["n"], r["n_near"], r["form"], r["form_n"], r["root"]] for r in df.collect()}


def test_against_all_pairs(spark):
    rnd = random.Random(8)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 7))) for _ in range(900)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "z"}
    count = {w: rnd.choice([1, 1, 2, 5, 10, 25, 130, 700, 700, 4000]) for w in words}
    df = spark.createDataFrame([*count.items(), (None, 7), ("nothing", None)], "word string, n bigint")
    for c in ("p", "s", "place", "kind", "best", "nodes", "form", "root"):
        df = df.withColumn(c, F.lit("clash"))
    got = rows(variants.spelling_variants(df))
    assert got == brute(count)
    assert any(v[4] != v[2] and v[2] for v in got.values())


def test_more_words_than_ranges_share_prefixes(spark):
    """Prefixes that go on over several ranges keep one number."""
    words = {f"{'common' * 12}{i:03d}" for i in range(400)}
    count = {w: 3 for w in words}
    assert rows(variants.spelling_variants(spark.createDataFrame([*count.items()], "word string, n bigint"))) == brute(count)


def test_counts_and_slips(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdeÀé×÷ÿ") for _ in range(rnd.randint(4, 9))) for _ in range(300)]
    docs = [(i, " ".join(rnd.choice(vocabulary).upper() if rnd.random() < 0.1 else rnd.choice(vocabulary) for _ in range(150)) + "٣ǅ\tend") for i in range(60)]
    docs += [(None, "without any number"), (3, None), (4, ""), (4, "q" * 40_000), (4, "q" * 40_000), (-9, "ÉCOLES école 12écoles3 naïveté")]
    want = collections.Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                want[w] += 1
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert {r["word"]: r["n"] for r in variants.word_counts(df).collect()} == dict(want)
    assert rows(variants.variants_of_documents(df)) == brute({w: n for w, n in want.items() if n >= 5})


def test_empty(spark):
    assert variants.variants_of_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
