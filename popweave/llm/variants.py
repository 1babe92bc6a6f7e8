"""Spelling variants: words one code point apart, met through a dictionary of pairs of trie nodes."""
from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from popweave.llm.common import Shared, drop_folder, map_slices, written, written_at
from popweave.session import salt_count

LEAST_LENGTH = 6               # code points of a word
LEAST_COUNT = 5                # occurrences of a word
FACTOR = 5                     # a form is so many times as frequent
SLIP = 199                     # one (document, run) in so many loses a code point
SPLITTER = 64                  # code points of a splitter
SAMPLES = 32                   # sampled words per range
RUN = re.compile("[a-zA-ZÀ-ÿ]{%d,}" % LEAST_LENGTH)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(word, n)`` of all whole texts: runs of Latin letters, A-Z lower-cased, with the slips of the contract.

    Where crc32 of ``<doc_id>:<run>`` is divisible by ``SLIP``, the run loses its code point number crc32 % length. Counts
    are summed per slice of texts, then per task, before they are shuffled. A null id is written as nothing.
    """
    def count(part: pa.RecordBatch) -> dict:
        total: dict[str, int] = {}
        for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
            if not t:
                continue
            base = zlib.crc32(b":" if i is None else b"%d:" % i)
            own: dict[str, int] = {}
            for w in RUN.findall(t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                own[w] = own.get(w, 0) + 1
            for w, n in own.items():
                h = zlib.crc32(w.encode(), base)
                if h % SLIP == 0:
                    at = h % len(w)
                    w = w[:at] + w[at + 1:]
                    if len(w) < LEAST_LENGTH:
                        continue
                total[w] = total.get(w, 0) + n
        return {"word": list(total), "n": list(total.values())}

    rows = map_slices(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")), count, "word string, n bigint", limit=16_000_000)
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n                                       # a[:lo] equal, a[:hi] not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def _splitters(words: DataFrame, column: Column, count: int, parts: int) -> list[str]:
    """Quantiles of a hash sample of the words (about ``SAMPLES`` a part): boundaries, in code-point order."""
    keep = max(1, count // (SAMPLES * parts))
    got = sorted(r["s"] for r in words.where(F.pmod(F.xxhash64("word", F.lit(12)), F.lit(keep)) == 0).select(F.substring(column, 1, SPLITTER).alias("s")).collect())
    return sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []


def _numbered(words: DataFrame, reverse: bool, count: int) -> DataFrame:
    """``word``, ``place`` (rises with the code-point order of the words) and ``nodes``: numbers of its trie nodes, root first.

    Words are cut into ranges and sorted inside them, so a task meets the words of its range as a walk through the trie:
    what a word shares with the one before keeps its number, the rest gets the next ones. A prefix that occurs in two
    ranges is a prefix of the splitter between them; those few have common numbers from the driver.
    """
    spark = words.sparkSession
    column = F.reverse("word") if reverse else F.col("word")
    parts = salt_count(spark)
    splitters = _splitters(words, column, count, parts)
    border = {p: i for i, p in enumerate(sorted({s[:i] for s in splitters for i in range(len(s) + 1)} | {""}))}
    shared = Shared(spark, (splitters, border))

    def deal(batches):
        splitters, _ = shared.get()
        for batch in batches:
            part = [bisect_right(splitters, w) for w in batch.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("key"), pa.array(part, pa.int32())], ["word", "key", "part"])

    def walk(batches):
        splitters, border = shared.get()
        at, before, path, row, fresh = None, "", [], 0, 0
        for batch in batches:
            places, nodes = [], []
            for w, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if part != at:
                    at, before, path, row, fresh = part, "", [border[""]], 0, 0
                    sides = splitters[max(part - 1, 0):part + 1]
                same = _common(before, w)
                del path[same + 1:]
                for i in range(same + 1, 1 + max([same] + [_common(s, w) for s in sides])):
                    path.append(border[w[:i]])
                new = len(w) + 1 - len(path)
                path.extend(range((part + 1 << 40) + fresh, (part + 1 << 40) + fresh + new))
                fresh += new
                nodes.append(np.array(path, np.int64))
                places.append((part << 40) + row)
                row, before = row + 1, w
            if nodes:
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(places, pa.int64()), pa.array(nodes, pa.list_(pa.int64()))], ["word", "place", "nodes"])

    dealt = words.select("word", column.alias("key")).mapInArrow(deal, "word string, key string, part int")
    return dealt.repartition("part").sortWithinPartitions("part", "key").mapInArrow(walk, "word string, place bigint, nodes array<bigint>")


def _groups(entries: DataFrame) -> DataFrame:
    """From each pair of nodes: what its words add to their numbers of near words and to their best one.

    Words that skip a place between the same two nodes differ in that code point alone, so a group has at most as many
    as the alphabet has letters (90). At most one word has no gap between the nodes.
    """
    order = F.struct("n", (-F.col("place")).alias("o"))
    group = entries.groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct(order.alias("best"), "kind")), asc=False).alias("g")).where("size(g) > 1")
    group = group.select(F.filter("g", lambda m: m["kind"] < 2).alias("skip"), F.filter("g", lambda m: m["kind"] == 2).alias("whole"))
    whole = F.get("whole", F.lit(0))["best"]

    def of_skip(m, i):
        other = F.when(i == 0, F.get("skip", F.lit(1))["best"]).otherwise(F.get("skip", F.lit(0))["best"])
        meets = (m["kind"] == 1) & (F.size("whole") > 0)
        return F.struct((-m["best"]["o"]).alias("place"), (F.size("skip") - 1 + meets.cast("int")).alias("near"), F.when(meets, F.greatest(other, whole)).otherwise(other).alias("best"))

    firsts = F.filter("skip", lambda m: m["kind"] == 1)
    of_whole = F.transform("whole", lambda m: F.struct((-m["best"]["o"]).alias("place"), F.size(firsts).alias("near"), F.get(firsts, F.lit(0))["best"].alias("best")))
    return group.select(F.inline(F.concat(F.transform("skip", of_skip), of_whole))).where("near > 0")


def spelling_variants(words: DataFrame) -> DataFrame:
    """``word, form, root`` and ``n, n_near, form_n`` for every row of ``words(word, n)``; words are distinct.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of largest ``n``
    (ties: smaller word), if that is at least ``FACTOR`` times the word's own; its root is where forms lead.

    Prefixes and suffixes are numbered as nodes of a forward and a reversed trie. A word enters the dictionary once per
    place that it skips, under (node before, node behind), and once per place where a letter could be inserted. Equal
    pairs of numbers are exact neighbours: skips among themselves are replacements, a skip and a whole word are an
    insertion. Of a run of equal letters only the first skip counts against whole words, so no neighbour counts twice.
    An empty table gives an empty result.
    """
    spark = words.sparkSession
    words, kept = written_at(words.select("word", F.col("n").cast("bigint").alias("n")).where("word is not null and n is not null"), "words")
    count = words.count()
    forward = _numbered(words, False, count)
    back = _numbered(words, True, count).select("word", F.col("nodes").alias("back"))
    both = written(words.join(forward, "word").join(back, "word"), "nodes")
    size = F.length("word")
    letter = F.split("word", "")
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        F.get("nodes", i).alias("p"), F.get("back", size - 1 - i).alias("s"), F.when((i == 0) | (F.get(letter, i) != F.get(letter, i - 1)), 1).otherwise(0).alias("kind")))
    holes = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(F.get("nodes", i).alias("p"), F.get("back", size - i).alias("s"), F.lit(2).alias("kind")))
    entries = both.where("length(word) > 0").select("place", "n", F.inline(F.concat(skips, holes)))
    near = _groups(entries).groupBy("place").agg(F.sum("near").cast("bigint").alias("n_near"), F.max("best").alias("best"))
    found = both.select("word", "n", "place").join(near, "place", "left")
    is_form = F.col("best.n") >= FACTOR * F.col("n")
    found = written(found.select("word", "n", "place", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, -F.col("best.o")).alias("to"), F.when(is_form, F.col("best.n")).alias("form_n")), "near")
    steps, old = written_at(found.where("to is not null").select("place", "to"), "steps")
    while True:                # each round doubles the steps taken; a form is FACTOR times as frequent, so chains are short
        far = steps.select(F.col("place").alias("to"), F.col("to").alias("far"))
        after, new = written_at(steps.join(far, "to", "left").select("place", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")), "steps")
        moved = after.where("moved").limit(1).count()
        drop_folder(spark, old)
        steps, old = after.select("place", "to"), new
        if not moved:
            break
    drop_folder(spark, kept)
    name = lambda at, out: found.select(F.col("place").alias(at), F.col("word").alias(out))              # noqa: E731
    got = found.join(steps.withColumnRenamed("to", "last"), "place", "left").join(name("to", "form"), "to", "left").join(name("last", "root"), "last", "left")
    return got.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants_of_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Spelling variants among the frequent words of ``docs``. Null texts have no words; other columns are not read."""
    return spelling_variants(word_counts(docs, text, doc_id).where(f"n >= {LEAST_COUNT} and length(word) >= {LEAST_LENGTH}"))


def variants_sql(least: int = LEAST_COUNT) -> str:
    return f"""
WITH RECURSIVE steps AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                                                                FROM range(256) r(i))),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
r AS (SELECT doc_id, w, count(*) AS n FROM d WHERE length(w) >= {LEAST_LENGTH} GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)), '..'), lambda h: ('0x' || h)::BIGINT),
                                   lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295) AS h FROM r, steps),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {least}),
k AS (SELECT word, i, word[1:i] || word[i + 2:] AS gap FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT DISTINCT word AS a, gap AS b FROM k SEMI JOIN v ON v.word = k.gap),
p AS (SELECT a.word AS a, b.word AS b FROM k a JOIN k b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word UNION ALL SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
b AS (SELECT p.a, v.word, v.n, count(*) OVER (PARTITION BY p.a) AS n_near, row_number() OVER (PARTITION BY p.a ORDER BY v.n DESC, v.word) AS k FROM p JOIN v ON v.word = p.b),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= {FACTOR} * v.n THEN b.word END AS form, CASE WHEN b.n >= {FACTOR} * v.n THEN b.n END AS form_n
      FROM v LEFT JOIN b ON b.a = v.word AND b.k = 1),
c(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL),
l AS (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(l.root, f.word) AS root FROM f LEFT JOIN l USING (word)"""
