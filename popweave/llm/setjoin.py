"""Exact Jaccard join of shingle sets: prefix index in blocks that are skipped whole, answers derived from those of similar sets."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from popweave.llm.common import Shared, components, in_slices, map_slices, mix, shingles, written
from popweave.llm.neardup import near_duplicates_sql

BUCKET_BITS = 20               # counts that order the shingles, one byte each on every executor
CHUNK = 1 << 14
BLOCK = 150                    # sets (or 150,000 shingles) in a block of a list
PART_BYTES = 1_000_000         # of texts that are taken apart together
PAIRS = 1_000_000              # of rows of tiles that are compared together
MAP_BYTES = 16_000_000         # of parity maps that are compared together
# Words are parted by code points 9 to 13 and 32.
_IN_WORD = np.array([not (9 <= b <= 13 or b == 32) for b in range(256)])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the texts, in order, and how many words stand before each text (and in all).

    The hash adds up the word's bytes, each times a number that belongs to its place in the word.
    """
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    at = np.flatnonzero(_IN_WORD[buffer])
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)                   # a word's first byte, among the bytes of words
    before = np.searchsorted(at[begins], np.cumsum([0, *(len(t) + 1 for t in texts)]))
    if not len(begins):
        return np.empty(0, np.uint64), before
    lengths = np.diff(begins, append=len(at))
    factor = mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    terms = factor[np.arange(len(at)) - np.repeat(begins, lengths)] * (buffer[at].astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(terms, begins) + lengths.astype(np.uint64)), before


def _shingled(texts: list, k: int) -> list[np.ndarray]:
    """The shingles of every text, in order, from one pass over the words of all."""
    hashed, before = _word_hashes([t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts])
    runs = shingles(hashed, k)
    return [runs[f:t - k + 1] if t - f >= k else shingles(hashed[f:t], k) for f, t in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def _rarity(docs: DataFrame, k: int) -> Shared:
    """How often shingles of each of a million buckets occur in all texts, as a power of two.

    A task adds up its buckets before anything is shuffled; a megabyte comes to the driver, whatever the input.
    """
    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for part in in_slices(batches, "text", PART_BYTES):
            np.add.at(total, (np.concatenate(_shingled(part.column("text").to_pylist(), k)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total) // CHUNK), pa.int32()), pa.array([p.tobytes() for p in total.reshape(-1, CHUNK)], pa.binary())], ["chunk", "counts"])

    def add(batches):
        at, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.frexp(total.astype(float))[1].astype(np.uint8).tobytes()])], ["chunk", "power"])     # noqa: E731
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if chunk != at:
                    if at is not None:
                        yield out()
                    at, total = chunk, np.zeros(CHUNK, np.int64)
                total += np.frombuffer(counts, np.int64)
        if at is not None:
            yield out()

    parts = docs.mapInArrow(count, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, power binary")
    power = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in parts.collect():
        power[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["power"], np.uint8)
    return Shared(docs.sparkSession, power)


def _parity(s: np.ndarray) -> bytes:
    """A bit per residue of the shingles, turned over by each of them; as many bits as the next power of two (256 at least).

    Two such maps differ in at most as many bits as their sets differ in shingles, so they rule links out, never in.
    """
    width = max(256, 1 << int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def _apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For pairs of maps, a lower bound of the number of shingles that one set has and the other has not."""
    out = np.zeros(len(x), np.int64)
    lengths = np.array([[len(u), len(v)] for u, v in zip(x, y, strict=True)]).reshape(-1, 2)
    for a, b in np.unique(lengths, axis=0):
        at = np.flatnonzero((lengths == (a, b)).all(axis=1))
        folded = [np.bitwise_xor.reduce(np.frombuffer(b"".join(z[i] for i in at), np.uint8).reshape(len(at), -1, min(a, b)), axis=1) for z in (x, y)]
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1)
    return out


def _indexed(docs: DataFrame, rarity: Shared, k: int, percent: int) -> DataFrame:
    """``id``, set size, digest and parity map of the set, and its prefix: the shingles, rarest first, of which similar sets share one."""
    def index(part: pa.RecordBatch) -> dict:
        power, size, digest, prefix, bits = rarity.get(), [], [], [], []
        for s in map(_distinct, _shingled(part.column("text").to_pylist(), k)):
            size.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            bits.append(_parity(s) if len(s) else None)
            order = power[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(57) | mix(s) >> np.uint64(7)
            upto = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
            prefix.append(np.sort(np.partition(order, upto - 1)[:upto] if upto else order).view(np.int64))
        return {"id": part.column("id"), "n": size, "digest": digest, "prefix": prefix, "bits": bits}

    return map_slices(docs, index, "id bigint, n bigint, digest binary, prefix array<bigint>, bits binary", limit=PART_BYTES)


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Whole sets of ``nodes(id, digest, node, rows)``, computed again from the texts that carry them.

    Only the narrow table of nodes meets the texts; sets are shuffled here for the few nodes whose row is repeated.
    """
    def build(part: pa.RecordBatch) -> dict:
        sets = list(map(_distinct, _shingled(part.column("text").to_pylist(), k)))
        same = [len(s) > 0 and xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
        return {"node": [v for v, ok in zip(part.column("node").to_pylist(), same, strict=True) if ok], "shingles": [v.view(np.int64) for v, ok in zip(sets, same, strict=True) if ok]}

    of = lambda few: map_slices(docs.join(nodes.where(few).drop("rows"), "id"), build, "node bigint, shingles array<bigint>", limit=PART_BYTES)      # noqa: E731
    return written(of("rows = 1").unionByName(of("rows > 1").dropDuplicates(["node"])), "sets")


def _lists(reps: DataFrame) -> DataFrame:
    """Inverted lists of two or more sets: ``token, node, n, pos, members``.

    Of lists with the same members only the rarest token's stays: at the first token that two sets share, and on which
    the bound by position rests, no earlier list can have the same members.
    """
    rows = reps.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    who = F.xxhash64("node")
    lists = (rows.groupBy("token").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(who).alias("w1"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("w2"))
             .where("members > 1").groupBy("members", "w1", "w2").agg(F.min("token").alias("token")).select("token", "members"))
    return rows.join(lists, "token")


def _stars(lists: DataFrame, percent: int) -> DataFrame:
    """Each set with the hub of every list it is in, where sizes and positions allow a link: at most as many pairs as rows.

    The hub is the set that is in most and longest lists.
    """
    score = lists.groupBy("node").agg(F.sum("members").alias("score"))
    scored = lists.join(score, "node")
    hub = scored.groupBy("token").agg(F.max(F.struct("score", "node", "n", "pos")).alias("h")).select("token", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.pos").alias("hub_pos"))
    able = f"node <> hub and {100 + percent} * least(n - pos, hub_n - hub_pos) >= {percent} * (n + hub_n)"
    return lists.join(hub, "token").where(able).select("hub", "hub_n", "node", "n").distinct()


def _near_stars(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs that their parity maps do not rule out."""
    columns = pairs.columns

    def keep(batches):
        for batch in batches:
            total = batch.column("n").to_numpy() + batch.column("hub_n").to_numpy()
            ok = (100 + percent) * _apart(batch.column("bits").to_pylist(), batch.column("hub_bits").to_pylist()) <= (100 - percent) * total
            yield batch.filter(pa.array(ok)).select(columns)

    both = pairs.join(bits, "node").join(bits.select(F.col("node").alias("hub"), F.col("bits").alias("hub_bits")), "hub").select(*pairs.columns, "bits", "hub_bits")
    return both.mapInArrow(keep, pairs.schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    common = F.size(F.array_intersect("shingles", "of_hub"))
    return both.where(F.lit(100) * common >= F.lit(percent) * (F.col("n") + F.col("hub_n") - common)).select(F.col("hub").alias("a"), F.col("node").alias("b"))


def _tiles(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Rows of lists that still hold several labels, dealt to the pairs of blocks that may hold a link.

    Long lists are cut by size, by position and then by hash. Of each block only its bounds are known here; a pair of
    blocks is skipped whole where sizes, positions or labels rule every link out.
    """
    rows = lists.where("members > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / (1000 * BLOCK)))
    mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), parts.alias("parts")).where("lo <> hi").select("token", "parts")
    rows = rows.join(mixed, "token")
    # classes a tenth apart in size and a twentieth in position
    by_size, by_place = F.floor(F.log(F.col("n").cast("double")) * 10), F.floor(F.col("pos") * 20 / F.col("n"))
    block = F.when(F.col("parts") > 1, F.xxhash64(by_size, by_place, F.pmod(F.xxhash64("node"), F.col("parts")))).otherwise(F.lit(0).cast("bigint"))
    rows = written(rows.withColumn("block", block), "members")
    bounds = rows.groupBy("token", "block").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("pos").alias("p0"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    other = bounds.withColumnsRenamed({c: f"o_{c}" for c in ("block", "n0", "n1", "p0", "l0", "l1")})
    pairs = bounds.join(other, "token").where("block <= o_block").where(
        f"100 * n1 >= {percent} * o_n0 and 100 * o_n1 >= {percent} * n0 and not (l0 = l1 and o_l0 = o_l1 and l0 = o_l0) "
        f"and {100 + percent} * least(n1 - p0, o_n1 - o_p0) >= {percent} * (n0 + o_n0)")
    pairs = written(pairs.select("token", F.col("block").alias("x"), F.col("o_block").alias("y")), "pairs")
    ends = pairs.select("token", F.col("x").alias("block"), "x", "y").unionByName(pairs.where("x <> y").select("token", F.col("y").alias("block"), "x", "y"))
    dealt = rows.join(ends, ["token", "block"]).select("token", "x", "y", "block", "node", "n", "pos", "label")
    return _kept_of_tiles(dealt, lambda part: _ends(len(part), *_able_pairs(part, percent)))


def _kept_of_tiles(rows: DataFrame, chosen) -> DataFrame:
    """Rows (without their maps) that ``chosen`` marks in tables of whole tiles; most tiles are tiny, so many share a table."""
    columns = [c for c in rows.columns if c != "bits"]

    def run(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = (pa.concat_tables([held, part]) if held is not None else part).combine_chunks()
            at = _tile_starts(part)
            last = int(at[-1]) if len(at) else 0
            yield from kept(part.slice(0, last))
            held = part.slice(last)
        if held is not None:
            yield from kept(held)

    def kept(part: pa.Table):
        at = np.append(_tile_starts(part), len(part))
        work = np.cumsum(np.diff(at) ** 2)
        f = 0
        while f < len(at) - 1:
            t = max(f + 1, int(np.searchsorted(work, (work[f - 1] if f else 0) + PAIRS, side="right")))
            some = part.slice(int(at[f]), int(at[t] - at[f])).combine_chunks()
            yield from some.filter(pa.array(chosen(some))).select(columns).to_batches()
            f = t

    return rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(run, rows.select(*columns).schema)


def _tile_starts(part: pa.Table) -> np.ndarray:
    """Where tiles begin in rows sorted by tile."""
    if not len(part):
        return np.empty(0, np.int64)
    new = np.zeros(len(part), bool)
    new[0] = True
    for c in ("token", "x", "y"):
        v = part.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _able_pairs(part: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one tile that may be links that join two labels, by sizes and positions."""
    n, pos, label, block, x, y = (part.column(c).to_numpy() for c in ("n", "pos", "label", "block", "x", "y"))
    at = np.append(_tile_starts(part), len(part))
    after = np.repeat(at[1:], np.diff(at)) - np.arange(len(part)) - 1      # rows of the tile behind this one
    i = np.repeat(np.arange(len(part)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    # pairs inside a block have a tile of their own
    able = (label[i] != label[j]) & ((x[i] == y[i]) | (block[i] != block[j]))
    i, j = i[able], j[able]
    able = (100 + percent) * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= percent * (n[i] + n[j])
    return i[able], j[able]


def _ends(rows: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which rows have a pair."""
    hit = np.zeros(rows, bool)
    hit[i] = hit[j] = True
    return hit


def _able(group: pa.Table, percent: int) -> np.ndarray:
    """Which pairs of a tile (above the diagonal) may be links that join two labels, by sizes and positions."""
    n, pos, label, block = (group.column(c).to_numpy() for c in ("n", "pos", "label", "block"))
    rest = n - pos
    able = (label[:, None] != label[None, :]) & ((100 + percent) * np.minimum(rest[:, None], rest[None, :]) >= percent * (n[:, None] + n[None, :]))
    if group.column("x")[0].as_py() != group.column("y")[0].as_py():
        able &= block[:, None] != block[None, :]                           # pairs inside a block have a tile of their own
    return np.triu(able, 1)


def _near_rows(tiles: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Rows of tiles that still have a partner when parity maps are compared."""
    def chosen(part: pa.Table) -> np.ndarray:
        (i, j), n, maps = _able_pairs(part, percent), part.column("n").to_numpy(), part.column("bits").to_pylist()
        size = np.cumsum(np.array([len(m) for m in maps], np.int64)[i] + np.array([len(m) for m in maps], np.int64)[j])
        ok, f = np.zeros(len(i), bool), 0
        while f < len(i):
            t = max(f + 1, int(np.searchsorted(size, (size[f - 1] if f else 0) + MAP_BYTES, side="right")))
            ok[f:t] = (100 + percent) * _apart([maps[v] for v in i[f:t]], [maps[v] for v in j[f:t]]) <= (100 - percent) * (n[i[f:t]] + n[j[f:t]])
            f = t
        return _ends(len(part), i[ok], j[ok])

    return _kept_of_tiles(tiles.join(bits, "node").select(*tiles.columns, "bits"), chosen)


def _answers(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(group: pa.Table) -> pa.Table:
        """Labels joined by links between two blocks (or inside one).

        The tile is an inverted index of the shingles that several of its sets have. The first set of a label is
        counted against all others through the lists of its shingles. For the next one, bounds from the shingles it has
        more and less decide most answers; if some stay open, its counts are those of the first, corrected along the
        lists of these few shingles.
        """
        group = group.sort_by([("label", "ascending"), ("node", "ascending")])
        n, label, sets = (group.column(c).to_numpy() for c in ("n", "label", "shingles"))
        size, able = len(n), _able(group, percent)
        _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(size), n)
        shared = (times > 1)[code]
        code, owner = code[shared], owner[shared]
        own = [code[f:t] for f, t in zip(*(np.searchsorted(owner, np.arange(size), side=s) for s in ("left", "right")), strict=True)]
        order = np.argsort(code, kind="stable")
        holders, starts = owner[order], np.searchsorted(code[order], np.arange(len(times) + 1))

        def counted(codes):
            """How many of these shingles each set has."""
            lengths = starts[codes + 1] - starts[codes]
            at = np.repeat(starts[codes] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            return np.bincount(holders[at], minlength=size)

        up, found = {}, []

        def root(v):
            while up.get(v, v) != v:
                up[v] = up.get(up[v], up[v])
                v = up[v]
            return v

        need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))
        first = counts = None
        for i in range(size):
            open_ = [j for j in np.flatnonzero(able[i]) if root(label[i]) != root(label[j])]
            if not open_:
                continue
            if first is not None and label[first] == label[i]:
                more, less = np.setdiff1d(own[i], own[first], assume_unique=True), np.setdiff1d(own[first], own[i], assume_unique=True)
                if len(more) + len(less) < len(own[i]):
                    sure = [j for j in open_ if counts[j] - len(less) >= need[i, j]]
                    unsure = [j for j in open_ if counts[j] - len(less) < need[i, j] <= counts[j] + len(more)]
                    mine = counts + counted(more) - counted(less) if unsure else counts
                    hits = sure + [j for j in unsure if mine[j] >= need[i, j]]
                else:
                    mine = counted(own[i])
                    hits = [j for j in open_ if mine[j] >= need[i, j]]
            else:
                first, counts = i, counted(own[i])
                hits = [j for j in open_ if counts[j] >= need[i, j]]
            for j in hits:
                p, q = root(label[i]), root(label[j])
                if p != q:
                    up[max(p, q)] = min(p, q)
                    found.append((p, q))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=schema) if found else schema.empty_table()
    return links


def jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Texts are linked exactly where ``100 * common >= percent * union`` of their distinct ``k``-word shingles;
    ``component_id`` is the smallest id reachable.

    1. A pass over the texts counts shingles in buckets: rare ones come first in the order of all shingles.
    2. A second pass gives each text its set's digest and prefix. Equal sets become one node; texts are not shuffled.
    3. Prefixes make inverted lists. The hub of each list is verified against its members on whole sets; union-find.
    4. Lists that still hold several components are cut into blocks by size and position; pairs of blocks are skipped
       by their bounds, then rows by parity maps of their sets (a bit or two per shingle). What remains is compared inside tasks, where answers of a set are derived from those of the
       first set of its component. Only joined components come out; union-find over them.

    No link is missed: every two linked sets share a prefix shingle, and in each list either their components are equal
    or they meet in a tile. Nulls: null and wordless texts have size 0 and no links; a null id has a null component and
    links nothing. Rows that repeat an id with other texts count as one document, whatever their order. Other columns
    are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    signed = written(_indexed(base, _rarity(base, k), k, percent).withColumn("row", F.monotonically_increasing_id()), "signed")
    usable = signed.where("digest is not null and id is not null").select("id", "row", "digest", "n")
    groups = usable.groupBy("digest", "id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("rows"))
    groups = written(groups.groupBy("digest").agg(F.min(F.struct("id", "row", "rows")).alias("rep"), F.sum("rows").alias("copies"))
                     .select("digest", F.col("rep.id").alias("id"), F.col("rep.row").alias("node"), "rep.rows", "copies"), "groups")
    surplus = usable.join(groups.where("copies > 1"), "digest").where("row <> node").select("row")
    reps = signed.where("digest is not null and id is not null").join(surplus, "row", "left_anti").select(F.col("row").alias("node"), "n", "prefix", "bits")
    lists = written(_lists(reps), "lists")
    named = base.where("id is not null")
    sets_of = lambda nodes: _sets(named, groups.join(nodes, "node", "left_semi").select("id", "digest", "node", "rows"), k)      # noqa: E731
    maps = lambda nodes: written(reps.select("node", "bits").join(nodes.select("node").distinct(), "node", "left_semi"), "maps")      # noqa: E731
    stars = written(_stars(lists, percent), "stars")
    ends = lambda pairs: pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node")))           # noqa: E731
    stars = written(_near_stars(stars, maps(ends(stars)), percent), "stars")
    sets = sets_of(ends(stars).distinct())
    # texts of one id are one document
    twice = usable.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi")
    same = usable.join(twice.select("id", F.col("lo").alias("of")), "id").select("digest", "of").where("digest <> of").distinct()
    node = lambda name, out: groups.select(F.col("digest").alias(name), F.col("node").alias(out))          # noqa: E731
    same = same.join(node("digest", "a"), "digest").join(node("of", "b"), "of").select("a", "b")
    labels = written(components(written(_verified(stars, sets, percent).unionByName(same), "links"), spark).withColumnRenamed("id", "node"), "labels")
    tiles = written(_tiles(lists, labels, percent), "tiles")
    tiles = written(_near_rows(tiles, maps(tiles), percent), "tiles")
    dealt = tiles.join(sets_of(tiles.select("node").distinct()), "node")
    more = written(dealt.groupBy("token", "x", "y").applyInArrow(_answers(percent), "a bigint, b bigint").distinct(), "more")
    joined = components(more, spark).select(F.col("id").alias("label"), F.col("label").alias("joined"))
    # labels of single nodes that a tile joined stand for themselves
    alone = joined.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("joined").alias("label"))
    known = labels.join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("label")).unionByName(alone)
    nodes = groups.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = nodes.groupBy("label").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("sets"))
    final = written(nodes.join(least, "label").where("copies > 1 or sets > 1").select("digest", "component"), "final")
    got = signed.select("id", "n", "digest").join(final, "digest", "left")
    # a wordless text shares the component of its id's other texts
    empty = got.where("digest is null").select("id").distinct()
    of_id = written(got.where("component is not null").join(empty, "id", "left_semi").groupBy("id").agg(F.min("component").alias("of_id")), "of_id")
    return got.join(of_id, "id", "left").select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "of_id", "id")).alias("component_id"))


def jaccard_sql(k: int = 5, percent: int = 80) -> str:
    return f"SELECT doc_id, n_shingles, component_id FROM ({near_duplicates_sql(k, percent)})"
