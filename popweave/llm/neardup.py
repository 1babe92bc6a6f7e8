"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from popweave.llm.common import WordHash, components, map_slices, mix, shingles, written

SLOTS = 256
MISS = 1e-5                    # chance that the bands miss a pair just at the threshold
BROADCAST_IDS = 500_000        # up to here the ids of candidates are sent to all executors (4 MB)
BLOCK = 200                    # documents (or 200,000 shingles) in a block of a bucket
FAN = 64                       # parts into which the pairs of one hub are dealt


def bands(threshold: float, slots: int = SLOTS) -> tuple[int, int]:
    """(bands, rows) with the longest rows whose bands all differ with a chance of at most ``MISS``."""
    rows = max(r for r in range(1, slots) if (1 - threshold ** r) ** (slots // r) <= MISS)
    return slots // rows, rows


def tokens(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, parted by code points 9 to 13 and 32."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of several sets (sorted distinct 64-bit hashes, none empty): len(sets) x slots.

    In round j every element of a set puts ``j + r`` (r uniform in [0, 1)) into the slot that stands at place j of its
    own random permutation. Values of a later round are larger, so a set is finished in the first round after which all
    its slots are filled: long sets need two or three rounds, short ones more. The permutations are built step by step
    (Fisher-Yates) for all elements of the unfinished sets at once.
    """
    n = len(sets)
    out = np.full((n, slots), np.uint64(0xFFFFFFFFFFFFFFFF))
    lengths = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < n:                                   # groups of sets of similar length; permutations take 512 bytes an element
        ends = np.cumsum(lengths[order[start:start + 4000]])
        take = max(1, int(np.searchsorted(ends, 50_000, side="right")))
        group = order[start:start + take]
        out[group] = _signatures([sets[i] for i in group], slots)
        start += take
    return out


def _signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    best = np.full(len(sets) * slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    perm = None
    for j in range(slots):
        draw = mix(element + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((draw >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64))
        if j == 0:
            slot, swapped = k, k
        else:
            if perm is None:
                perm = np.tile(np.arange(slots, dtype=np.uint16), (len(element), 1))
                rows = np.arange(len(element))
                perm[rows, swapped], perm[:, 0] = 0, swapped
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            perm[:, j] = slot
        value = (np.uint64(j) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, owner * slots + slot, value)
        open_ = (best.reshape(len(sets), slots).max(axis=1) == np.uint64(0xFFFFFFFFFFFFFFFF))[owner]
        if not open_.any():
            break
        if not open_.all():
            element, owner = element[open_], owner[open_]
            if perm is not None:
                perm, rows = perm[open_], np.arange(len(element))
            else:
                swapped = swapped[open_]
    return best.reshape(len(sets), slots)


def shingle_sets(texts: list, words: WordHash, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; null and wordless texts have none."""
    return [np.unique(shingles(words.of(tokens(t)), k)) if t else np.empty(0, np.uint64) for t in texts]


def signatures(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """``id``, number of shingles, digest of the whole set and one key per band for every text."""
    count, rows = bands(threshold)
    words = WordHash()

    def sign(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part.column("text").to_pylist(), words, k)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if full:
            got = super_minhash([sets[i] for i in full])
            band = np.zeros((len(full), count), np.uint64)
            for j in range(count):
                for v in got[:, j * rows:(j + 1) * rows].T:
                    band[:, j] = mix(band[:, j] * np.uint64(0x9E3779B97F4A7C15) + v + np.uint64(j))
            for i, b in zip(full, band.view(np.int64), strict=True):
                keys[i] = b
        return {"id": part.column("id"), "n": [len(s) for s in sets], "keys": keys,
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]}

    return map_slices(docs, sign, "id bigint, n bigint, digest binary, keys array<bigint>")


def _sets_of(docs: DataFrame, ids: DataFrame, k: int, several: bool = False) -> DataFrame:
    """Shingle sets of the texts with these ids, computed again from the whole texts.

    One set an id; with ``several`` every different set of the ids, with its digest instead of the id.
    """
    words = WordHash()

    def build(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part.column("text").to_pylist(), words, k)
        first = {"digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]} if several else {"id": part.column("id")}
        return {**first, "shingles": [s.view(np.int64) for s in sets]}

    few = ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    name, kind = ("digest", "binary") if several else ("id", "bigint")
    return written(map_slices(wanted, build, f"{name} {kind}, shingles array<bigint>").dropDuplicates([name]), "sets")


def _classes(usable: DataFrame, twice: DataFrame) -> DataFrame:
    """Classes of equal sets (digest, rep, copies, apart) where some ids stand for several sets.

    A class is named by its smallest id. Where that id stands for other sets too, the class is ``apart``: it gets a
    number of its own above all ids, so that its set is not mixed up with the id's other sets.
    """
    above = usable.agg(F.max("id")).scalar() + 1
    classes = usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    marked = classes.join(twice.select(F.col("id").alias("rep"), F.lit(True).alias("apart")), "rep", "left").withColumn("own", F.monotonically_increasing_id())
    return marked.select("digest", F.when(F.col("apart"), above + F.col("own")).otherwise(F.col("rep")).alias("rep"), "copies",
                         F.coalesce("apart", F.lit(False)).alias("apart"))


def _linked(common: Column, a: Column, b: Column, percent: int) -> Column:
    return F.lit(100) * common >= F.lit(percent) * (a + b - common)


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """From each bucket the pairs of its hub with every other member: as many pairs as members, never their square.

    The hub of a bucket is the member that shares buckets with the most others, so a text from which many copies were
    made stands in the middle in nearly all its buckets.
    """
    size = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    rows = rows.join(size, ["band", "key"])
    score = rows.groupBy("id").agg(F.sum("members").alias("score"))
    rows = rows.join(score, "id")
    hub = rows.groupBy("band", "key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"), F.col("n"))).alias("h"))
    hub = hub.select("band", "key", (-F.col("h.id")).alias("hub"), F.col("h.n").alias("hub_n"))
    return rows.join(hub, ["band", "key"]).where("id <> hub").select("hub", "hub_n", "id", "n").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, id) whose full sets are similar enough. A hub's pairs are dealt to ``FAN`` parts."""
    near = pairs.where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    near = near.join(sets, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(FAN)))
    hubs = pairs.select("hub").distinct().join(sets.withColumnRenamed("id", "hub"), "hub").withColumnRenamed("shingles", "hub_shingles")
    needed = pairs.select("hub", F.pmod(F.xxhash64("id"), F.lit(FAN)).alias("part")).distinct()
    both = near.join(needed.join(hubs, "hub"), ["hub", "part"])
    common = F.size(F.array_intersect("shingles", "hub_shingles"))
    return both.where(_linked(common, F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("id").alias("b"))


def _blocks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several labels, cut into blocks, and the pairs of blocks to compare.

    A block holds some ``BLOCK`` members or 200,000 shingles, picked by hash. Every pair of members meets in exactly one
    pair of blocks per shared bucket; a bucket whose members all have one label is left out.
    """
    rows = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum("n").alias("size"))
    mixed = mixed.where("members > 2 and lo <> hi").select("band", "key", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("size") / (1000 * BLOCK))).cast("int").alias("parts"))
    rows = rows.join(mixed, ["band", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("label", "id"), F.col("parts")).cast("int"))
    return rows.select("band", "key", "block", "parts", "id", "n", "label")


def _tile_links(percent: int):
    def links(group: pa.Table) -> pa.Table:
        """Links between different labels in one pair of blocks, exactly, by products of 0/1 matrices."""
        band = group.column("band")[0].as_py()
        ids, label, n = (group.column(c).to_numpy() for c in ("id", "label", "n"))
        keys = np.stack(group.column("keys").to_numpy())
        sets = group.column("shingles").to_numpy()
        common = np.zeros((len(ids), len(ids)), np.float32)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(ids)), n)
        _, where, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[where] > 1
        column = np.cumsum(times > 1)[where[shared]] - 1
        owner = owner[shared]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            hold = np.zeros((len(ids), 4096), np.float32)
            hold[owner[a:b], column[a:b] - lo] = 1
            common += hold @ hold.T
        common = common.astype(np.int64)
        ok = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        a, b = np.nonzero(np.triu(ok, 1) & (label[:, None] != label[None, :]))
        first = np.array([int(np.argmax(keys[x] == keys[y])) == band for x, y in zip(a, b, strict=True)], bool)
        a, b = a[first], b[first]
        up = {}

        def root(x):
            while up.get(x, x) != x:
                x = up[x] = up.get(up[x], up[x])
            return x

        keep = []
        for i, (x, y) in enumerate(zip(label[a], label[b], strict=True)):    # a spanning forest is enough
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append(i)
        return pa.table({"a": ids[a[keep]], "b": ids[b[keep]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return links


def _exhaust(rows: DataFrame, labels: DataFrame, sets: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """All remaining links inside buckets, found in tasks that each hold two blocks of a bucket."""
    blocks = _blocks(rows, labels)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = blocks.select("*", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    content = sets.join(keys.dropDuplicates(["id"]), "id")
    dealt = dealt.join(content, "id").select("band", "key", "x", "y", "id", "n", "label", "keys", "shingles")
    return dealt.groupBy("band", "key", "x", "y").applyInArrow(_tile_links(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Two texts are linked if their sets of distinct ``k``-word shingles have a Jaccard similarity of ``threshold`` or
    more; ``component_id`` is the smallest id reachable by links.

    1. One pass signs every text: SuperMinHash of 256 slots, keys of ``bands(threshold)``, a 128-bit digest of the set.
       Texts themselves are never shuffled here. Texts with equal sets are one class, reduced to its smallest id, or
       to a number of its own where that id stands for other sets too (ids may reach 2^62).
    2. Classes that share a band key are candidates. Each bucket's hub is compared with all its members on full sets.
    3. Union-find over these links. Buckets that still hold several components are cut into blocks, and every pair of
       members with different components is compared on full sets inside a task that holds two blocks; only the links
       that join components come out. So no link of a bucket is lost and no list of all pairs of a group is made.
    4. Union-find again over all links; classes hand their component to their members.

    Bands miss a pair just at the threshold with a chance below 1e-5. Nulls: null and wordless texts have
    ``n_shingles`` 0 and their own component; a null id stays apart, with a null component, and is kept. Rows that
    repeat an id share its component, which joins the classes of all their texts, in whatever order the rows stand;
    all rows are kept or dropped alike. Empty tables give empty results. Other
    columns are not read.
    """
    spark, percent = docs.sparkSession, round(threshold * 100)
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = written(signatures(base, k, threshold), "signed")
    usable = signed.where("digest is not null and id is not null")
    twice = written(usable.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id"), "twice")
    odd = bool(twice.limit(1).count())                 # ids that repeat with different sets
    groups = written(_classes(usable, twice) if odd else usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "groups")
    keyed = usable.select("id", "n", "keys")
    if odd:
        apart = usable.join(groups.where("apart").select("digest", F.col("rep").alias("node")), "digest").dropDuplicates(["node"])
        keyed = keyed.join(twice, "id", "left_anti").unionByName(apart.select(F.col("node").alias("id"), "n", "keys"))
    reps = keyed.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    rows = reps.select("id", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("band", "key"))
    multiple = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band", "key")
    rows = written(rows.join(multiple, ["band", "key"]), "rows")
    known = base.where("id is not null")
    sets = _sets_of(known, rows.select("id").distinct(), k)
    if odd:
        inside = _sets_of(known.join(twice, "id", "left_semi"), twice, k, several=True)
        inside = inside.join(groups.where("apart").select("digest", F.col("rep").alias("id")), "digest").dropDuplicates(["id"])
        sets = written(sets.join(twice, "id", "left_anti").unionByName(inside.select("id", "shingles")), "sets")
    links = written(_verified(_hub_pairs(rows), sets, percent), "links")
    links = written(links.unionByName(_exhaust(rows, components(links, spark), sets, keyed.select("id", "keys"), percent)), "links")
    if odd:                                            # an id joins the classes of all its sets
        own = usable.join(twice, "id", "left_semi").join(groups, "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = links.unionByName(own)
    labels = components(links, spark).withColumnsRenamed({"id": "rep", "label": "component"})
    final = groups.where("copies > 1").select("digest", "rep").join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("of_copies"))
    alone = labels.select(F.col("rep").alias("id"), F.col("component").alias("of_id"))
    got = (signed.select("id", "n", "digest").join(final, "digest", "left").join(alone, "id", "left")
           .withColumn("component_id", F.when(F.col("id").isNotNull(), F.least(F.coalesce("of_copies", "of_id", "id"), F.coalesce("of_id", "of_copies", "id")))))
    return got.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")).withColumnRenamed("id", doc_id)


def near_duplicates_sql(k: int = 3, percent: int = 85) -> str:
    """All pairs by an inverted join, for small tables."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {run})) END) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
m AS (SELECT s.* FROM s SEMI JOIN f USING (sh)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM m a JOIN m b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id WHERE r.label < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(label) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id"""


def deduplicate(docs: DataFrame, k: int = 5, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, all columns: of each component the text with the smallest id, once.

    Rows without an id stay. Where rows repeat an id that stays, the first of them by text stays.
    """
    found = written(near_duplicates(docs, k, threshold, text, doc_id).select(F.col(doc_id).alias("id"), "kept"), "kept")
    stay = docs.join(found.where("not kept").select(F.col("id").alias("__gone")).distinct(), F.col(doc_id) == F.col("__gone"), "left_anti")
    twice = found.where("kept and id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias("__twice"))
    if not twice.limit(1).count():
        return stay
    first = F.row_number().over(W.partitionBy(doc_id).orderBy(text))
    return (stay.join(twice, F.col(doc_id) == F.col("__twice"), "left_anti")
            .unionByName(stay.join(twice, F.col(doc_id) == F.col("__twice"), "left_semi").withColumn("__first", first).where("__first = 1").drop("__first")))
