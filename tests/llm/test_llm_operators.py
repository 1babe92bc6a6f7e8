"""Operators on small made cases: brute force, damage, and the rows that break things."""
import gzip
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from popweave.llm import ann, decontam, langid, mixing, neardup, passages, quality, sharding, toxicity, warc, warc_query
from popweave.llm.common import components

random.seed(3)
WORDS = [f"w{i}x" for i in range(4000)]
CLASH = {c: "clash" for c in ("score", "id", "key", "words", "band", "label", "part", "size", "shard", "slot", "n", "kept", "component_id", "rank", "first", "sha",
                              "mix_size", "mix_copies", "shard_size", "hits", "items", "segment", "digest", "threshold", "rejected", "__row", "v", "rate", "start", "before")}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(n, rng=random):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(60_000)
PASSAGE = prose(70)
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 5), (4, "one", "en", None, 3), (5, LONG, "fr", "a", len(LONG)),
       (6, "same text here for all of them", "en", "b", 30), (7, "same text here for all of them", "en", "b", 30), (7, "same text here for all of them", "en", "b", 30),
       (None, "no id but words enough to count", "de", "b", 31), (9, "Été ЖУК ß 漢字 \U0001f600", "fr", "c", 15), (10, "x" * 30_000, "en", "c", 30_000),
       (11, prose(30) + " " + PASSAGE, "en", "c", 0), (12, PASSAGE + " " + prose(40), "en", "c", 0), (-5, "1234 5678 !!!", "en", "c", 13), (8, "2²", "en", "c", 2)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for c, v in CLASH.items():
        df = df.withColumn(c, F.lit(v))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows(df):
    return sorted(df.collect(), key=str)


# 1 -------------------------------------------------------------------------------------------------------------------
def test_contamination_on_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (None, "one"), (4, "same text here for all of them"), (4, "NO id but words")], "item_id bigint, text string").withColumn("text2", F.lit("x"))
    got = decontam.contamination(odd, items).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and not by[2]["contaminated"]
    assert by[11]["n_hit"] == 70 and by[11]["items"] == ["1"] and by[11]["contaminated"]
    assert by[4]["items"] == [""] and by[7]["n_hit"] == 7
    assert by[None]["items"] == ["4"] and by[None]["n_hit"] == 4
    assert by[5]["n_words"] == 60_000 and by[10]["n_words"] == 1
    assert decontam.contamination(none, items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.contamination(odd, items.where("false")).collect())
    kept = decontam.decontaminate(odd, items)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 9, 10, -5, 8}


def test_blocks_of_phrases_agree(spark, odd, monkeypatch):
    items = spark.createDataFrame([(1, PASSAGE), (2, "same text here for all of them")], "item_id bigint, text string")
    want = rows(decontam.contamination(odd, items).withColumn("n", F.size("items")).drop("items"))
    monkeypatch.setattr(decontam, "BLOCK_PHRASES", 7)
    monkeypatch.setattr(decontam, "VOCABULARY_BOUND", 0)                  # the other way: postings of all terms
    assert rows(decontam.contamination(odd, items).withColumn("n", F.size("items")).drop("items")) == want


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "c x b y a"), (3, "a a b z z z z z c"), (4, "b c a b c")], "doc_id bigint, text string")
    index = decontam.build_index(docs)
    phrase = decontam.windows_of(spark.createDataFrame([(9, "a b c")], "item_id bigint, text string"))
    find = lambda slop: sorted((r["id"], r["start"], r["end"]) for r in decontam.search(index, phrase, slop).collect())     # noqa: E731
    assert find(0) == [(1, 0, 2), (4, 2, 4)]
    near = {(i, s, e) for i, s, e in find(2)}
    assert (1, 0, 2) in near and (2, 0, 4) in near and (4, 2, 4) in near and not any(i == 3 for i, _, _ in near)


# 2, 4, 5 -------------------------------------------------------------------------------------------------------------
def test_quality_learns_and_stands_odd_rows(spark, odd, none):
    rng = random.Random(1)
    labelled = spark.createDataFrame([(i, prose(80, rng) if i % 2 else " ".join([rng.choice(WORDS)] * 60), i % 2) for i in range(200)] + [(900, None, 1), (901, "x", None)],
                                     "doc_id bigint, text string, quality int")
    model = quality.fit(labelled, labelled)
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame([(1, prose(80)), (2, "w5x " * 60)], "doc_id bigint, text string"), model).collect()}
    assert got[1] > 0.7 > 0.3 > got[2]
    seen = quality.score(odd, model).collect()
    assert len(seen) == len(ODD) and all(0 <= r["score"] <= 1 for r in seen)
    assert len({r["score"] for r in seen if r["doc_id"] in (1, 2)}) == 1
    assert quality.score(none, model).count() == 0
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, quality.fit(labelled, labelled.where("false"))).collect())


def test_toxicity_learns_and_stands_odd_rows(spark, odd, none):
    rng = random.Random(2)
    text = lambda bad: prose(40, rng) + (" vileword" + rng.choice("abc") if bad else "") + " " + prose(40, rng)             # noqa: E731
    labelled = spark.createDataFrame([(i, text(i % 2), "en" if i % 3 else "fr", i % 2) for i in range(300)] + [(900, None, None, 0), (901, "x", "en", None)],
                                     "doc_id bigint, text string, lang string, toxic int")
    model = toxicity.fit(labelled, labelled)
    got = {r["doc_id"]: r for r in toxicity.classify(spark.createDataFrame([(1, text(0), "en"), (2, LONG + " vilewordb", "xx"), (3, LONG, None)], "doc_id bigint, text string, lang string"), model).collect()}
    assert got[2]["score"] > 0.5 > got[1]["score"] and got[3]["score"] < 0.5 and got[2]["rejected"] and not got[3]["rejected"]
    assert {"", "en"} <= set(model.thresholds)
    seen = toxicity.classify(odd, model).collect()
    assert len(seen) == len(ODD) and all(0 <= r["score"] <= 1 for r in seen)
    assert rows(toxicity.keep_clean(odd, model)) == rows(odd) and toxicity.keep_clean(none, model).count() == 0
    assert rows(toxicity.keep_clean(odd, toxicity.fit(labelled, labelled.where("false")))) == rows(odd)


def test_toxicity_counts_every_labelled_row(spark, monkeypatch):
    seen, begun = [], toxicity.begun
    monkeypatch.setattr(toxicity, "begun", lambda counts, n_docs: seen.append(n_docs.copy()) or begun(counts, n_docs))
    n = F.col("id")
    docs = spark.range(6000).select(n.alias("doc_id"), F.concat_ws(" ", F.lit("plain words"), F.when(n % 4 == 0, "vileword").otherwise("kind")).alias("text"), F.lit("en").alias("lang"),
                                    (n % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, docs)
    trained = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) != 3).groupBy("toxic").count().collect()
    assert list(seen[0]) == [r["count"] for r in sorted(trained)] and seen[0][0] > 3000
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in toxicity.classify(docs, model).collect())


def test_toxicity_trains_every_part_for_all_epochs(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART", 5)
    data = [(1, f"plain {'vileword' if i % 4 == 0 else 'kind'} w{i}", "en", int(i % 4 == 0)) for i in range(40)]       # one id: all rows in one part
    docs = spark.createDataFrame(data, "id bigint, text string, lang string, label int")
    ordered = sorted((label, text) for _, text, _, label in data)
    texts, y = [t for _, t in ordered], np.array([v for v, _ in ordered], float)
    counts, n_docs = np.zeros((2, toxicity.BUCKETS), np.int64), np.zeros(2, np.int64)
    toxicity._own_grams(texts, y, counts, n_docs)
    start = toxicity.begun(counts, n_docs)
    got, want, once = toxicity._trained(docs, start, 40), toxicity.train(start, [(texts, y)], toxicity.EPOCHS), toxicity.train(start, [(texts, y)], 1)
    assert np.allclose(got.weight, want.weight, atol=1e-6) and np.allclose(got.embedding, want.embedding, atol=1e-6)
    assert not np.allclose(got.weight, once.weight, atol=1e-3)


def test_threshold_weighs_rows_by_their_label():
    rng = np.random.default_rng(7)
    y = np.repeat([1.0, 0.0], 200)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.15), 0.01, 0.99)
    many = np.where(y == 1, 1, 20)
    got = toxicity.best_threshold(s, y, many.astype(float))
    assert got == toxicity.best_threshold(np.repeat(s, many), np.repeat(y, many), np.ones(many.sum()))
    assert got > toxicity.best_threshold(s, y, np.ones(400))


def test_languages(spark, odd, none):
    rng = random.Random(4)
    words = {"aa": ["baba", "lala", "tata"], "bb": ["zozo", "kiki", "rere"]}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words[g]) for _ in range(20)), g) for i in range(40) for g in words] + [(99, None, "aa"), (98, "baba", None)], "doc_id bigint, text string, lang string")
    p = langid.learn(docs)
    assert p.langs == ["aa", "bb"]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame([(1, "lala tata"), (2, "kiki zozo"), (3, "123 ²"), (4, None)], "doc_id bigint, text string"), p).collect()}
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[3]["lang_pred"], got[4]["lang_pred"]) == ("aa", "bb", "und", "und") and got[3]["score"] == 0
    seen = langid.identify(odd, p).collect()
    assert len(seen) == len(ODD) and all(0 <= r["score"] <= 1 for r in seen)
    assert langid.identify(none, p).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(none)).collect()} == {"und"}


# 3 -------------------------------------------------------------------------------------------------------------------
def test_archives_round_trip(spark):
    pages = [(1, "u1", "<p>é</p>"), (2, None, None), (3, "u 3\r\n", ""), (4, "u", "<p>é</p>"), (5, "u", "WARC/1.1\r\nfake\r\n\r\n"), (None, "u", "<p>é</p>"), (7, "u", "y" * 3_000_000), (8, "u", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("sha", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("first", F.lit(0))
    got = warc.read_archives(spark, warc.write_archives(df)).collect()
    assert len(got) == len(pages) and not any(r["error"] for r in got)
    by = {r["record_id"]: r for r in got}
    assert by["4"]["record_type"] == by["8"]["record_type"] == "revisit" and by["4"]["refers_to"] == "1" and by["4"]["payload_bytes"] == 9
    assert by["3"]["refers_to"] == "2" and by["2"]["payload_bytes"] == 0 and by["2"]["payload_digest"] == warc.digest(b"")
    assert by["7"]["payload"] == b"y" * 3_000_000 and by["5"]["payload"].startswith(b"WARC/1.1") and by["null"]["payload_digest"] == by["1"]["payload_digest"]
    assert warc.read_archives(spark, warc.write_archives(df.where("false"))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_later_records(packed):
    whole = [warc.record(str(i), f"http://h/{i}", b"body %d" % i * 50, warc.digest(b"body %d" % i * 50), None) for i in range(6)]
    parts = [gzip.compress(r, mtime=0) if packed else r for r in whole]
    clean = [r for r in warc.salvage(b"".join(parts))]
    assert [r[2]["record_id"] for r in clean] == list("012345")
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 0xFF
    data = parts[0] + b"junk junk" + parts[1] + bytes(hurt) + parts[3][:len(parts[3]) // 2] + parts[4] + parts[5]
    got = list(warc.salvage(data))
    kept = [r[2]["record_id"] for r in got if isinstance(r, tuple)]
    gaps = [(g.start, g.end) for g in got if not isinstance(g, tuple)]
    assert kept == list("0145")
    at = len(parts[0])
    first = at + 9 + len(parts[1])
    assert gaps == [(at, at + 9), (first, first + len(hurt) + len(parts[3]) // 2)]
    assert list(warc.salvage(b"")) == [] and len(list(warc.salvage(b"\x1f\x8b\x08\x00 WARC/1.0\r\n"))) == 1


def test_salvage_query_with_a_null_page_id(spark, tmp_path):
    pages = [(1, "u1", "<p>a</p>"), (None, "u2", "<p>b</p>"), (3, "u3", "<p>a</p>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in warc_query.op3_salvage(spark, str(tmp_path)).collect()}
    assert set(got) == {1, None, 3} and got[3]["refers_to"] == 1 and got[None]["record_type"] == "response"


# 6 -------------------------------------------------------------------------------------------------------------------
def test_mix_keeps_targets_and_bounds(spark, odd, none):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
    total = sum(r["mix_size"] for r in got)
    for s in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == s]
        taken, target, size = sum(r["mix_copies"] * r["mix_size"] for r in own), own[0]["mix_target"], own[0]["mix_source_size"]
        assert size == sum(r["mix_size"] for r in own) and target <= 3 * size and abs(taken - target) < 0.01 * target + 41
        assert all(0 <= r["mix_copies"] <= 3 for r in own)
    assert abs(sum({r["source"]: r["mix_target"] for r in got}.values()) - total) < 1e-6
    seen = mixing.mix(odd).collect()
    assert len(seen) == len(ODD) and all(r["mix_copies"] <= 3 for r in seen)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(none).count() == 0
    assert mixing.mixed(odd).count() == sum(r["mix_copies"] for r in seen)
    empty = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")).collect()
    assert all(r["mix_target"] == 0 and r["mix_copies"] == 0 for r in empty)


# 7 -------------------------------------------------------------------------------------------------------------------
def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    for n, common in ((1, 1), (7, 5), (60, 45), (3000, 2000)):
        base = np.unique(rng.integers(0, 1 << 62, 2 * n, dtype=np.uint64))
        a, b = np.sort(base[:n]), np.sort(base[n - common:2 * n - common])
        est = [np.mean(s[0] == s[1]) for s in (neardup.super_minhash([a + np.uint64(i), b + np.uint64(i)]) for i in range(5))]
        assert abs(np.mean(est) - common / (2 * n - common)) < 0.05
    assert all(len(np.unique(s >> np.uint64(32))) >= 1 for s in neardup.super_minhash([np.arange(3, dtype=np.uint64)]))


def _brute(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = neardup.tokens(t) if t else []
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        moved = False
        for a in sets:
            for b in sets:
                c = len(sets[a] & sets[b])
                if a < b and c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
        if not moved:
            return sets, label


def test_components_equal_brute_force(spark):
    """Chains of copies whose middle links the ends, a hub with many copies, small texts."""
    rng = random.Random(6)
    docs, at = [], 0
    for _ in range(6):
        text = prose(60, rng).split()
        for _ in range(25):
            if rng.random() < 0.4:
                text = list(text)
                text[rng.randrange(60)] = rng.choice(WORDS)
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = rng.choice(WORDS)
            docs.append((at, " ".join(copy)))
            at += 1
    docs += [(at + i, t) for i, t in enumerate(["a", "A", "a b", "a b c", "a b c d", "", None])]
    sets, label = _brute(docs, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7), 3, 0.85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), label[i]) for i, _ in docs}


def test_repeated_ids_with_several_texts_lose_no_link(spark):
    """Rows (1, X), (1, Y), (2, nearly Y) and many more of the kind, in two orders, against brute force on single texts."""
    rng = random.Random(11)
    base = [prose(60, rng).split() for _ in range(30)]
    docs = [(1, " ".join(base[0])), (1, " ".join(base[1])), (2, " ".join(base[1][:-1] + ["end"]))]
    for _ in range(90):
        text = list(rng.choice(base))
        if rng.random() < 0.6:
            text[rng.randrange(60)] = rng.choice(WORDS)
        docs.append((rng.choice([rng.randint(3, 40), rng.randint(3, 200)]), " ".join(text)))
    docs += [(300, ""), (300, None), (300, "a b"), (301, "A b"), (None, "a b"), (300, "other words")]
    single = {n: t for n, (i, t) in enumerate(docs) if i is not None}
    sets, _ = _brute(single.items(), 3, 85)
    owner = {n: i for n, (i, _) in enumerate(docs)}
    label = {i: i for i in owner.values() if i is not None}
    links = [(owner[a], owner[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]
             and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = sorted((i, len(sets[n]), label[i]) for n, i in owner.items() if i is not None)
    for order in (docs, docs[::-1], rng.sample(docs, len(docs))):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id bigint, text string").repartition(5), 3, 0.85).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
        assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_near_duplicates_on_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(odd).collect()}
    assert got[7]["component_id"] == 6 and not got[7]["kept"] and got[1]["n_shingles"] == 0 and got[None]["kept"]
    kept = neardup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicate(none).count() == 0


def test_repeated_ids_join_their_classes(spark):
    a, b = prose(40), prose(40)
    got = neardup.near_duplicates(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in got} == {1}
    once = neardup.deduplicate(spark.createDataFrame([(5, a), (5, a), (6, b)], "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in once.collect()) == [5, 6]


def test_union_find_on_a_long_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a bigint, b bigint"), spark).collect()
    assert {r["id"]: r["label"] for r in got} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), spark).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------
def test_compact_windows_cover_each_run_once():
    rng = np.random.default_rng(2)
    token = rng.integers(0, 1 << 60, 90, dtype=np.uint64)
    k, key, l, c, r = passages.compact_windows(token, np.array([0, 40]), 10, hashes=2)
    for h in range(2):
        for lo, hi in ((0, 39), (40, 89)):
            for i in range(lo, hi + 1):
                for j in range(i + 9, hi + 1):
                    inside = (k == h) & (l <= i) & (i <= c) & (c <= j) & (j <= r)
                    assert inside.sum() == 1


def test_passages(spark, odd, none):
    got = passages.repeated_passages(odd).collect()
    spots = {(r["doc_id"], r["start_word"], r["end_word"]) for r in got if not r["whole_copy"]}
    assert spots == {(11, 30, 100), (12, 0, 70)} and {r["class_id"] for r in got} == {11}
    assert passages.repeated_passages(none).count() == 0
    near = PASSAGE.split()
    near[33] = "changed"
    docs = spark.createDataFrame([(1, prose(80) + " " + PASSAGE), (2, " ".join(near) + " " + prose(90)), (3, prose(300)), (4, PASSAGE.upper()), (5, PASSAGE)], "doc_id bigint, text string")
    found = passages.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 4, 5} and {r["doc_id"] for r in found if r["whole_copy"]} == {4, 5}


def test_text_of_fifty_words_inside_a_longer_one(spark):
    rng = random.Random(11)
    short = prose(50, rng)
    docs = spark.createDataFrame([(1, prose(200, rng) + " " + short + " " + prose(200, rng)), (2, short)], "doc_id bigint, text string")
    got = passages.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["class_id"]) for r in got} == {(1, 200, 250, 1), (2, 0, 50, 1)}


def test_verification_matches_all_places_and_splits_runs():
    new = lambda n, at=[0]: np.arange(at.__setitem__(0, at[0] + n) or at[0] - n, at[0], dtype=np.uint64)                    # noqa: E731
    run = new(60)
    # every token of the run stands four times earlier in y, in other orders
    rng = np.random.default_rng(5)
    y = np.concatenate([*(np.concatenate([rng.permutation(run), new(30)]) for _ in range(4)), run])
    assert (0, 59, len(y) - 60, len(y) - 1) in passages.matching_passages(run, y, 46, 0.8)
    # a passage with one changed word, then on the same diagonal a template with a changed word in every ten
    x = new(300)
    y = x.copy()
    y[38:43] = new(5)
    for i in range(81, 300, 10):
        y[i:i + 5] = new(5)
    got = passages.matching_passages(x, y, 46, 0.8)
    assert got and min(g[0] for g in got) == 0 and max(g[1] for g in got) >= 75 and all(g[0] == g[2] and g[1] == g[3] for g in got)
    for a, b, _, _ in got:
        same = len(np.intersect1d(x[a:b + 1], y[a:b + 1]))
        assert b - a >= 45 and same >= 0.8 * (2 * (b - a + 1) - same)
    # chunks of matches give the same runs
    z = rng.integers(0, 9, 400).astype(np.uint64)
    w = rng.integers(0, 9, 300).astype(np.uint64)
    assert all((p == q).all() for p, q in zip(passages._equal_runs(z, w), passages._equal_runs(z, w, 100), strict=True))


def test_verification_along_given_diagonals():
    """Bounded diagonals give the runs of these diagonals; only passages inside no other one come out."""
    rng = np.random.default_rng(8)
    for alphabet in (3, 9, 1000):
        x, y = rng.integers(0, alphabet, 120).astype(np.uint64), rng.integers(0, alphabet, 90).astype(np.uint64)
        for lo, hi in ((-130, 130), (-7, 4), (0, 0), (40, 60), (200, 300)):
            every, some = (np.stack(passages._equal_runs(x, y, diagonals=d), axis=1) for d in (None, (lo, hi)))
            assert (every[(every[:, 2] >= lo) & (every[:, 2] <= hi)] == some).all() and ((some[:, 2] >= lo) & (some[:, 2] <= hi)).all()
    assert not len(passages._equal_runs(x, y[:0], diagonals=(-5, 5))[0])
    spans = rng.integers(0, 12, (300, 4)).astype(np.int64)
    spans[:, 1] += spans[:, 0]
    spans[:, 3] += spans[:, 2]
    inside = lambda p, q: q[0] <= p[0] and p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3]                                   # noqa: E731
    distinct = {tuple(p) for p in spans.tolist()}
    assert {tuple(p) for p in passages._outermost(spans).tolist()} == {p for p in distinct if not any(p != q and inside(p, q) for q in distinct)}
    # a line that a text repeats: one passage, not one for each shift
    line = np.arange(10, dtype=np.uint64)
    assert passages.matching_passages(np.tile(line, 20), np.tile(line, 20), 46, 0.8) == [(0, 199, 0, 199)]


def test_parts_of_a_chain_against_sets_of_tokens(monkeypatch):
    """Parts of a chain of runs equal those found by sets of tokens, and the words are not gone through again for each run."""
    def by_sets(first, last, d, x, y, least, similarity):
        out, reached = [], -1
        for s in range(len(first)):
            good = -1
            for e in range(s, len(first)):
                a0, a1, b0, b1 = first[s], max(last[s:e + 1]), first[s] + d[s], max((last + d)[s:e + 1])
                u, v = set(x[a0:a1 + 1].tolist()), set(y[b0:b1 + 1].tolist())
                if min(a1 - a0, b1 - b0) + 1 >= least and len(u & v) >= similarity * len(u | v):
                    good = e
                    found = (a0, a1, b0, b1)
            if good > reached:
                reached = good
                out.append(found)
        return out

    rng = np.random.default_rng(14)
    compared = alone = 0
    for alphabet in (25, 10 ** 6) * 40:
        x = rng.integers(0, alphabet, 150).astype(np.uint64)
        y = x.copy()
        y[rng.integers(0, 150, 14)] = rng.integers(10 ** 7, 10 ** 8, 14)
        y = np.delete(np.concatenate([rng.integers(10 ** 8, 10 ** 9, 7).astype(np.uint64), y]), rng.integers(30, 150, 2))
        first, last, d = passages._equal_runs(x, y)
        chain = np.flatnonzero((np.abs(d - 6) <= 1) & ((last - first >= 2) | (alphabet > 25)))
        chain = chain[np.argsort(first[chain], kind="stable")]
        if not len(chain):
            continue
        a, z, d = first[chain], last[chain], d[chain]
        want = by_sets(a, z, d, x, y, 20, 0.8)
        assert passages._similar_parts(a, z, d, x, y, 20, 0.8) == want
        compared += len(want) > 1
        if passages._alone(a, z, d, x, y):
            alone += 1
            assert passages._parts_of_runs(a, z, d, 20, 0.8) == want
    assert compared > 5 and alone > 5
    x = np.arange(4000, dtype=np.uint64)
    y = x.copy()
    y[::9] += np.uint64(10 ** 6)                                     # 444 runs, no part of which is similar enough
    calls, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    assert passages.matching_passages(x, y, 46, 0.9) == []
    assert len(calls) < 10, len(calls)


def test_near_copies_of_passages_against_the_planted_ones(spark):
    """Passages with changed, lost and added words inside other texts: at least nine in ten are found and tied to their source."""
    rng = random.Random(21)
    docs, planted = [], []
    for g in range(30):
        words = prose(rng.randrange(80, 160), rng).split()
        docs.append((10 * g, " ".join([prose(40, rng), *words, prose(40, rng)])))
        for j in range(1, 4):
            copy = list(words)
            for _ in range(max(1, len(copy) // 60)):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = [[], ["new"], [copy[at], "added"]][rng.randrange(3)]
            before = rng.randrange(20, 60)
            docs.append((10 * g + j, " ".join([prose(before, rng), *copy, prose(30, rng)])))
            planted.append((10 * g + j, before, before + len(copy)))
    cover = {}
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect():
        assert r["class_id"] // 10 == r["doc_id"] // 10
        cover.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    found = sum(len(cover.get(i, set()) & set(range(s, e))) >= 0.8 * (e - s) for i, s, e in planted)
    assert found >= 0.9 * len(planted), found
    assert all(len(cover.get(i, set()) - set(range(s - 5, e + 5))) == 0 for i, s, e in planted)


def test_passages_of_ids_with_several_texts(spark):
    """An id's other texts keep their passages, also where one is a surplus copy, in any order of the rows."""
    rng = random.Random(31)
    shared, copied = prose(120, rng), prose(70, rng)
    near = shared.split()
    near[60] = "changed"
    docs = [(1, prose(90, rng)), (1, prose(30, rng) + " " + shared), (2, " ".join(near) + " " + prose(20, rng)), (0, copied), (1, copied), (1, copied.upper()), (5, prose(10, rng) + " " + copied)]
    both = prose(60, rng)                                            # only ids with several texts hold it
    docs += [(8, both), (7, both), (7, prose(55, rng)), (8, prose(56, rng)), (9, both + " " + prose(9, rng))]
    want = {(1, 30, 150, 1, 30, False), (2, 0, 120, 1, 30, False), (0, 0, 70, 0, 0, False), (5, 10, 80, 0, 0, False), (0, 0, 70, 0, 0, True), (1, 0, 70, 0, 0, True),
            (7, 0, 60, 7, 0, False), (9, 0, 60, 7, 0, False), (7, 0, 60, 7, 0, True), (8, 0, 60, 7, 0, True)}
    for given in (docs, docs[::-1]):
        got = passages.repeated_passages(spark.createDataFrame(given, "doc_id bigint, text string").repartition(3)).collect()
        found = {(r["doc_id"], r["start_word"], r["end_word"], r["class_id"], r["class_start"], r["whole_copy"]) for r in got}
        assert found == want and len(got) == len(want), found


def test_passages_that_the_smallest_texts_of_their_keys_lack(spark):
    """Texts 10 and 11 share a passage; under each hash function an unrelated smaller text has the minimum's token."""
    rng = random.Random(12)
    shared = prose(80, rng)
    long_ = " ".join([prose(60, rng), shared, prose(60, rng)])
    words = shared.split()
    # smaller texts hold every token of the passage, three tokens in a row at most
    docs = [(i, " ".join(prose(50, rng) + " " + " ".join(words[j:j + 7]) + " " + prose(50, rng) for j in range(i % 3, 76, 3))) for i in range(1, 4)]
    docs += [(10, long_), (11, " ".join([prose(90, rng), shared, prose(20, rng)]))]
    for parts in (1, 5):
        got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)).collect()
        assert {(r["doc_id"], r["start_word"], r["end_word"], r["class_id"]) for r in got} == {(10, 60, 140, 10), (11, 90, 170, 10)}


def test_windows_inside_windows_bring_no_words_twice(spark, monkeypatch):
    """A token that a text repeats makes windows inside windows under one key; the steps do not hold the words of each."""
    n = 3000
    texts = [(i, " ".join(f"t{i}w{j}" for j in range(n + 4))) for i in (1, 2)]
    edges = [(1, 0, 0, n - 1, i, c, c, n - 1, 0, 77) for i in (1, 2) for c in range(0, n - 50, 10) if (i, c) != (1, 0)]
    edges = spark.createDataFrame(edges, "a bigint, l1 int, c1 int, r1 int, b bigint, l2 int, c2 int, r2 int, k tinyint, key bigint")
    sizes, written = [], passages.written

    def measured(df, kind="step"):
        got = written(df, kind)
        sizes.append(sum(os.path.getsize(f.removeprefix("file://")) for f in got.inputFiles()))
        return got

    monkeypatch.setattr(passages, "written", measured)
    assert passages._exhaust(edges, spark.createDataFrame([], passages.LINK), spark.createDataFrame(texts, "id bigint, text string"), 46, 0.8, spark).count() == 0
    assert sum(sizes) < 2 * sum(len(t) for _, t in texts), sizes


def test_codes_in_common():
    rng = np.random.default_rng(9)
    for n, wide in ((5, 64), (70, 4), (70, 64), (130, 20)):
        held = rng.random((300, n)) < rng.random((300, 1))
        code, owner = np.nonzero(held)
        want = np.triu(held.T.astype(int) @ held.astype(int), 1)
        assert (passages._in_common(code, owner, n, width=32, wide=wide) == want).all()


def test_poorest_stretch():
    rng = np.random.default_rng(6)
    for n in (10, 40):
        t = rng.integers(0, 12, n)
        assert passages._poorest(t, 10) == min(len(set(t[i:i + 10])) for i in range(n - 9))


# 9 -------------------------------------------------------------------------------------------------------------------
def test_neighbours_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(3)
    base = rng.normal(size=8).tolist()
    data = [(i, base) for i in range(0, 60)] + [(100, rng.normal(size=8).tolist()), (200, None), (300, []), (400, [0.0] * 8), (500, [nan] * 8), (600, [1.0, inf] + [0.0] * 6),
            (700, [None] + [1.0] * 7), (800, [1.0] * 5), (None, base), (900, [1e3] * 8), (900, [1e3] * 8)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0)).withColumn("dim", F.lit(0))
    got = ann.search(ann.build_forest(df), df.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by[0] == list(range(1, 11)) and set(by) == {0, 100, 900} and 900 not in by[900] and len(by[100]) == 10
    assert ann.search(ann.build_forest(df.where("false")), df).count() == 0
    assert ann.search(ann.build_forest(df), df.where("false")).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------
def test_shards(spark, odd, none):
    got = sharding.shard(odd, shards=3).collect()
    assert len(got) == len(ODD)
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sharding.shard(none).count() == 0
    rng = random.Random(7)
    docs = [(i, "hot text" if i % 3 == 0 else prose(rng.randint(1, 30), rng)) for i in range(3000)]
    docs += [(i + 5000, "pair " + str(i // 2) + " w" * 40) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = sharding.shard(df).collect()
    size = [sum(r["shard_size"] for r in found if r["shard"] == s) for s in range(8)]
    assert max(size) - min(size) < 0.03 * max(size)
    where = {}
    for r in found:
        if r["text"] != "hot text":
            where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    again = sharding.shard(df.repartition(5), ranges=40).collect()         # other samples and ranges, same shards
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in found)


# pipeline ------------------------------------------------------------------------------------------------------------
def test_stages_keep_columns_and_stand_empty_tables(spark, odd, none, tmp_path):
    spark.createDataFrame([(5, 1), (9, 0), (None, 1)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, none.select(plain.columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns or name == "sharding"
            docs = spark.createDataFrame(out.collect(), out.schema)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_pipeline_against_its_parts(spark):
    """Planted documents go, clean ones stay, and the mix takes what its own query says."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()} and max(r["shard"] for r in out) == 7
    unique = neardup.deduplicate(docs)
    assert ids <= {r["doc_id"] for r in unique.select("doc_id").collect()} | ids
    bad = {r["doc_id"] for r in decontam.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert not ids & bad
