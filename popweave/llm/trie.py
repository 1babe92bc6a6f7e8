"""Prefix trie of conversations with totals per node, rolled up by bands of depths."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.llm.common import drop_folder, written, written_at
from popweave.llm.mixing import word_count
from popweave.plans.ranking import rank_by_value

BAND = 8                       # depths in a band: a node goes to at most so many ancestors a level
STRETCH = 4096                 # turns of one conversation in a window; a multiple of BAND
CHUNK_BITS = 12                # ids of a node are joined to texts of at most 4096 ids
FOLLOWERS, HEAD = 20, 4        # conversations that share a donor; a donor gives fewer turns than HEAD


def _number(digest: Column, at: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, i, t1, t2, words``: turns numbered from 1, each with 120 bits of digest instead of its texts.

    Order: turn (null first), then the digest. Ranks are taken over slices, so one conversation may hold a third of all
    rows. Null role and text are empty; rows without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                    F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), word_count(text).alias("words"))
            .select("conv_id", "turn", _number(F.col("digest"), 1).alias("t1"), _number(F.col("digest"), 17).alias("t2"), "words"))
    return rank_by_value(written(rows, "turns"), ["conv_id"], "turn", "t1", "i").drop("turn")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their donor: ``(conv_id, d, t1, t2, words)`` and ``(conv_id, turns)``.

    The donor of c is c - c % 20; it gives its first h turns, h being crc32 of c's decimal digits modulo 4, in place
    of c's first h. Only the first three turns of donors are joined, each to at most twenty conversations.
    """
    convs = (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("donor", F.col("conv_id") - F.col("conv_id") % FOLLOWERS)
             .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD))
    heads = (turns.where((F.col("conv_id") % FOLLOWERS == 0) & (F.col("i") < HEAD)).groupBy(F.col("conv_id").alias("donor"))
             .agg(F.sort_array(F.collect_list(F.struct("i", "t1", "t2", "words"))).alias("head")))
    convs = convs.join(heads, "donor", "left").withColumn("head", F.filter(F.coalesce("head", F.array()), lambda t: t["i"] <= F.col("h")))
    convs = written(convs.select("conv_id", "h", "head", F.size("head").alias("taken"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "convs")
    given = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.i").alias("d"), "t.t1", "t.t2", "t.words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i > h")
    return given.unionByName(own.select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("d"), "t1", "t2", "words")), convs.select("conv_id", "turns")


def _stretch() -> Column:
    """Conversation and stretch as one struct, so that windows and joins share an exchange."""
    return F.struct("conv_id", F.floor((F.col("d") - 1) / STRETCH).alias("s"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """``key`` of each row's prefix and ``parent``, that of the prefix before.

    A prefix is the exclusive or of digests of its (place, turn) pairs, so it adds up over stretches of a conversation
    like a running total; no conversation is read in one piece.
    """
    at = F.md5(F.concat_ws(":", "d", "t1", "t2"))
    marked = rows.select("conv_id", "d", "words", _stretch().alias("g"), _number(at, 1).alias("h1"), _number(at, 17).alias("h2"))
    totals = marked.groupBy("g").agg(F.bit_xor("h1").alias("o1"), F.bit_xor("h2").alias("o2"))
    before = W.partitionBy("g.conv_id").orderBy("g.s").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("g", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("o1", "o2")])
    inside = W.partitionBy("g").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = marked.select("*", F.bit_xor("h1").over(inside).alias("x1"), F.bit_xor("h2").over(inside).alias("x2")).join(offsets, "g")
    x1, x2 = F.col("x1").bitwiseXOR(F.col("o1")), F.col("x2").bitwiseXOR(F.col("o2"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))               # noqa: E731
    return run.select("conv_id", "d", "words", pair(x1, x2).alias("key"), pair(x1.bitwiseXOR(F.col("h1")), x2.bitwiseXOR(F.col("h2"))).alias("parent"))


def _banded(rows: DataFrame) -> DataFrame:
    """``path``: the ancestors of a row inside its band, from the band's top (the depth before it) to the parent."""
    near = W.partitionBy("g").orderBy("d").rowsBetween(1 - BAND, W.currentRow)
    place = ((F.col("d") - 1) % BAND + 1).cast("int")
    path = rows.withColumn("g", _stretch()).withColumn("path", F.collect_list("parent").over(near))
    return path.withColumn("path", F.slice("path", F.size("path") - place + 1, place)).drop("g")


def _below(nodes: DataFrame, rows: DataFrame, top: int, sums: list[str]) -> DataFrame:
    """Sums over everything strictly below each node: ``key`` and ``sums``.

    Each node adds itself to its ancestors inside its band. Where there are several bands, their tops form a tree
    ``BAND`` times less deep, solved the same way; a completed top then adds its total to the band above it. So a node
    goes to at most ``BAND`` ancestors a level, and levels are as many as the logarithm of the greatest depth.
    """
    def up(given, path):
        return given.select(F.explode(path).alias("key"), *sums).groupBy("key").agg(*[F.sum(s).alias(s) for s in sums])

    inner = up(nodes, F.col("path"))
    if top <= BAND:
        return inner
    inner = written(inner, "band")
    tall = written(_banded(rows.where(F.col("d") % BAND == 0).select("conv_id", (F.col("d") / BAND).cast("bigint").alias("d"), "key", F.col("path")[0].alias("parent"))), "tops")
    paths = tall.groupBy("key").agg(F.first("d").alias("d"), F.first("path").alias("path"))
    root = inner.where("key.a = 0 and key.b = 0").withColumn("d", F.lit(0).cast("bigint")).withColumn("path", F.array().cast(paths.schema["path"].dataType))
    weighed = written(paths.join(inner, "key").unionByName(root), "weighed")
    deeper = written(_below(weighed, tall, top // BAND, sums), "deeper")
    total = lambda *parts: _union(parts).groupBy("key").agg(*[F.sum(s).alias(s) for s in sums])      # noqa: E731
    done = total(inner, deeper)
    bottoms = nodes.where((F.col("d") > 0) & (F.col("d") % BAND == 0)).select("key", "path").join(done, "key")
    return total(inner, deeper, up(bottoms, F.slice("path", 2, BAND)))


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ends(ended: DataFrame) -> DataFrame:
    """SHA-256 of each node's ``conv_id``s, ascending, joined by commas.

    Ids are distinct, so those with equal higher bits are at most 4096: they become one text, and texts of a node are
    hashed one after the other as they stream through a task. Nothing is held for a node with any number of ids.
    """
    chunk = F.call_function("shiftright", F.col("conv_id"), F.lit(CHUNK_BITS))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ended.groupBy("key", chunk.alias("chunk")).agg(ids.alias("ids")).select("key.a", "key.b", "chunk", "ids")

    def digest(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == at:
                    sha.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (a, b), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["a", "b", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, sha.hexdigest())], ["a", "b", "ends_sha256"])

    got = texts.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").mapInArrow(digest, "a bigint, b bigint, ends_sha256 string")
    return got.select(F.struct("a", "b").alias("key"), "ends_sha256")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see ``rebuild``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (over the subtree, each node's members but one times the words of its last text) and
    ``ends_sha256`` (SHA-256 of the ids that end here, ascending).

    Texts become digests where they are read and are never shuffled. Members are counted per node with a map-side
    combine, so a first turn that a third of all conversations share is no hot spot.

    Nulls: null roles and texts are empty, null turns come first, rows without ``conv_id`` are left out. Turns of equal
    number stand in the order of their digests; repeated rows are repeated turns. A conversation left without turns is
    a member of the root only. An empty table gives no row. Other columns are not read.
    """
    turns, kept = written_at(turn_rows(conversations), "ranked")
    rebuilt, convs = rebuild(turns)
    rows = written(_banded(_prefixes(rebuilt)), "prefixes")
    drop_folder(conversations.sparkSession, kept)
    ends = rows.join(convs, "conv_id").where("d = turns").select("key", "conv_id")
    none = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    ends = ends.unionByName(convs.where("turns = 0").select(none.alias("key"), "conv_id"))
    below_root = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("d").alias("d"), F.first("words").alias("words"), F.first("path").alias("path"))
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .select(none.alias("key"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("words"), F.array().cast(rows.schema["path"].dataType).alias("path")))
    nodes = written(below_root.unionByName(root), "nodes")
    parent = F.element_at("path", -1)
    children = nodes.where("d > 0").groupBy(parent.alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    own = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = written(own.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    top = own.agg(F.max("d").alias("top")).first()["top"] or 0
    below = _below(own.select("key", "d", "path", "leaf", "saved"), rows.select("conv_id", "d", "key", "path"), top, ["leaf", "saved"]).withColumnsRenamed({"leaf": "leaves_below", "saved": "saved_below"})
    of_parent = own.where("n_children > 0").select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    got = own.withColumn("up", F.when(F.col("d") > 0, parent)).join(of_parent, "up", "left").join(below, "key", "left").join(_ends(ends), "key", "left")
    return got.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                      (F.col("leaf") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def prefix_trie_sql() -> str:
    return """
WITH steps AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                                                      FROM range(256) r(i))),
m AS (SELECT conv_id AS c, turn, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
             len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, m, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS i FROM m),
s AS (SELECT c, count(*) AS n, c - c % 20 AS donor, any_value(xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295)) % 4 AS h FROM t, steps GROUP BY c),
b AS (SELECT s.c, t.i AS d, t.m, t.w FROM s JOIN t ON t.c = s.donor AND t.i <= s.h
      UNION ALL SELECT s.c, t.i - s.h + least(s.h, coalesce(o.n, 0)), t.m, t.w FROM s JOIN t USING (c) LEFT JOIN s o ON o.c = s.donor WHERE t.i > s.h),
p AS (SELECT c, d, md5(string_agg(m, ',') OVER (PARTITION BY c ORDER BY d)) AS k, w, d = max(d) OVER (PARTITION BY c) AS last FROM b
      UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM b) FROM s),
u AS (SELECT c, d, k, w, last, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM p),
n AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, any_value(up) AS up, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM u GROUP BY k, d),
h AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, o.conv_id AS parent_conv_id FROM n LEFT JOIN h USING (k) LEFT JOIN n o ON o.k = n.up),
a AS (SELECT p.k, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved FROM v JOIN p ON p.c = v.conv_id AND p.d <= v.d GROUP BY p.k)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM v JOIN a USING (k)"""
