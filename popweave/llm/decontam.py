"""Benchmark decontamination: a distributed positional inverted index and phrase or proximity search on it."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from popweave.llm.common import WordHash, map_slices, written

SEGMENT_BYTES = 4_000_000      # text bytes of a segment: one row of the index
WINDOW = 13
VOCABULARY_BOUND = 1_000_000   # test terms sent to executors (8 MB); more: postings of all terms are stored
BLOCK_PHRASES = 50_000         # phrases searched in one pass over the index
# Words are runs of digits, a-z and characters beyond ASCII, after A-Z is lower-cased.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = ("segment bigint, ids array<bigint>, lengths array<int>, terms array<bigint>, counts array<int>, "
         "doc binary, position binary")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def terms_of(texts: DataFrame, column: str) -> DataFrame:
    """Distinct term hashes of a text column."""
    words = WordHash()

    def hashes(part: pa.RecordBatch) -> dict:
        got = [words.of(words_of(t)) for t in part.column("text").to_pylist()]
        return {"term": np.unique(np.concatenate([*got, np.empty(0, np.uint64)])).view(np.int64)}

    return map_slices(texts.select(F.col(column).alias("text")), hashes, "term bigint").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The positional inverted index of ``docs``, written to the shared folder: one row per segment.

    A segment holds some ``SEGMENT_BYTES`` of whole texts: ids and word counts of its documents, and for each term
    (sorted 64-bit hashes) its postings, document number and word position, in that order, in one block of bytes.
    With a ``vocabulary`` of at most ``VOCABULARY_BOUND`` terms, postings of other terms, which can take part in no
    match, are not stored; beyond the bound all are. Results are the same. No text and no posting is shuffled.
    """
    known = None
    if vocabulary is not None and vocabulary.count() <= VOCABULARY_BOUND:
        known = np.sort(np.array([r[0] for r in vocabulary.collect()], np.int64).view(np.uint64))
    words = WordHash()

    def segment(part: pa.RecordBatch) -> dict:
        texts = part.column("text").to_pylist()
        lengths, terms, docs_, positions = [], [], [], []
        for i, t in enumerate(texts):
            h = words.of(words_of(t))
            lengths.append(len(h))
            p = np.arange(len(h), dtype=np.int32)
            if known is not None and len(h):
                at = np.searchsorted(known, h)
                at[at == len(known)] = 0
                here = known[at] == h if len(known) else np.zeros(len(h), bool)
                h, p = h[here], p[here]
            terms.append(h)
            positions.append(p)
            docs_.append(np.full(len(h), i, np.int32))
        term, doc, position = np.concatenate(terms), np.concatenate(docs_), np.concatenate(positions)
        order = np.argsort(term, kind="stable")
        distinct, counts = np.unique(term, return_counts=True)
        return {"segment": [0], "ids": [part.column("id")], "lengths": [np.array(lengths, np.int32)], "terms": [distinct.view(np.int64)],
                "counts": [counts.astype(np.int32)], "doc": [doc[order].tobytes()], "position": [position[order].tobytes()]}

    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return written(map_slices(base, segment, INDEX, limit=SEGMENT_BYTES).withColumn("segment", F.monotonically_increasing_id()), "index")


def windows_of(items: DataFrame, width: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Distinct runs of ``width`` consecutive words of each item; a shorter item that is not empty is one run."""
    words = WordHash()

    def cut(part: pa.RecordBatch) -> dict:
        ids, runs = [], []
        for i, t in zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True):
            h = words.of(words_of(t)).view(np.int64)
            if len(h):
                w = min(width, len(h))
                for r in np.unique(np.lib.stride_tricks.sliding_window_view(h, w), axis=0):
                    ids.append(i)
                    runs.append(r)
        return {"item": ids, "terms": runs}

    return map_slices(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")), cut, "item string, terms array<bigint>").distinct()


def by_rarity(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """Each phrase with ``rank``: its places ordered from the term with the fewest postings in the whole index."""
    counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))
    places = phrases.select("item", "terms", F.posexplode("terms").alias("place", "term")).join(counts, "term", "left")
    ranked = places.groupBy("item", "terms").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place"))).alias("by"))
    return ranked.select("item", "terms", F.col("by.place").alias("rank"))


class _Segment:
    """Posting lists of one row of the index."""

    def __init__(self, row: dict):
        self.terms = np.asarray(row["terms"], np.int64).view(np.uint64)
        self.ends = np.concatenate([[0], np.cumsum(row["counts"], dtype=np.int64)])
        self.doc = np.frombuffer(row["doc"], np.int32).astype(np.int64)
        self.position = np.frombuffer(row["position"], np.int32).astype(np.int64)
        self.place = (self.doc << 32) | self.position

    def list_of(self, term: np.uint64) -> np.ndarray | None:
        """Places (document number and position in one integer) of a term, ascending; None if it does not occur."""
        i = int(np.searchsorted(self.terms, term))
        if i == len(self.terms) or self.terms[i] != term:
            return None
        return self.place[self.ends[i]:self.ends[i + 1]]

    def phrase(self, terms: np.ndarray, rank: list[int]) -> np.ndarray:
        """Starts of the exact phrase: lists moved back by their offset and intersected, rarest term first."""
        starts = None
        for place in rank:
            got = self.list_of(terms[place])
            if got is None:
                return np.empty(0, np.int64)
            if starts is None:
                starts = got - place
                starts = starts[(starts >> 32 == got >> 32) & (starts >= 0)]      # not before the document's first word
            else:
                want = starts + place
                at = np.searchsorted(got, want)
                at[at == len(got)] = 0
                starts = starts[got[at] == want]
            if not len(starts):
                break
        return starts

    def near(self, terms: np.ndarray, rank: list[int], slop: int) -> list[tuple[int, int]]:
        """Shortest spans (first place, last place) of at most ``len(terms) + slop`` words that hold all terms, as often as the phrase has them."""
        need: dict = {}
        for t in terms[rank]:
            need[t] = need.get(t, 0) + 1
        lists = {}
        for t in need:
            lists[t] = self.list_of(t)
            if lists[t] is None or len(lists[t]) < need[t]:
                return []
        reach = len(terms) + slop - 1
        rare = lists[terms[rank[0]]]
        for t in need:                                       # only what lies close to a rarest term can take part
            at = np.searchsorted(rare, lists[t])
            left, right = rare[np.maximum(at - 1, 0)], rare[np.minimum(at, len(rare) - 1)]
            lists[t] = lists[t][np.minimum(np.abs(lists[t] - left), np.abs(right - lists[t])) <= reach]
        place = np.concatenate([lists[t] for t in need])
        which = np.concatenate([np.full(len(lists[t]), j) for j, t in enumerate(need)])
        order = np.argsort(place, kind="stable")
        place, which = place[order], which[order]
        short, lo, have, spans = list(need.values()), 0, [0] * len(need), []
        for hi in range(len(place)):
            have[which[hi]] += 1
            while have[which[lo]] > short[which[lo]]:
                have[which[lo]] -= 1
                lo += 1
            if all(h >= s for h, s in zip(have, short, strict=True)) and place[hi] - place[lo] <= reach:
                spans.append((int(place[lo]), int(place[hi])))
        return spans


def _blocks(phrases: DataFrame):
    """Phrases in blocks of ``BLOCK_PHRASES``: the stated query set goes against all segments block by block."""
    block = []
    for r in phrases.toLocalIterator():
        block.append((r["item"], np.asarray(r["terms"], np.int64).view(np.uint64), list(r["rank"])))
        if len(block) == BLOCK_PHRASES:
            yield block
            block = []
    yield block


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Matches ``(id, item, start, end)`` of phrases, word positions from 0, both ends included.

    ``slop`` 0: the exact phrase. Above: its words in any order inside ``len + slop`` words.
    """
    spark = index.sparkSession
    out = None
    for block in _blocks(by_rarity(phrases, index)):
        found = index.mapInArrow(_searcher(spark.sparkContext.broadcast(block), slop), "id bigint, item string, start int, end int")
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(block, slop: int):
    def run(batches):
        for row in _rows(batches):
            seg, out = _Segment(row), []
            for item, terms, rank in block.value:
                spans = [(s, s + len(terms) - 1) for s in seg.phrase(terms, rank).tolist()] if not slop else seg.near(terms, rank, slop)
                out += [(row["ids"][s >> 32], item, s & 0xFFFFFFFF, e & 0xFFFFFFFF) for s, e in spans]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["id", "item", "start", "end"])
    return run


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            one = {n: batch.column(n)[i] for n in batch.schema.names}
            yield {k: v.values.to_numpy(zero_copy_only=False) if k in ("terms", "counts", "lengths") else v.as_py() for k, v in one.items()}


def _covered(block):
    """For each document of a segment: which of its words lie in an occurrence, and of which items."""
    def run(batches):
        for row in _rows(batches):
            seg = _Segment(row)
            n = len(row["ids"])
            bounds = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)])
            marks, items = np.zeros(bounds[-1] + 1, np.int32), {}
            for item, terms, rank in block.value:
                starts = seg.phrase(terms, rank)
                if len(starts):
                    flat = bounds[starts >> 32] + (starts & 0xFFFFFFFF)
                    np.add.at(marks, flat, 1)
                    np.add.at(marks, flat + len(terms), -1)
                    for d in np.unique(starts >> 32).tolist():
                        items.setdefault(d, set()).add(item)
            hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            of = np.searchsorted(bounds, hit, side="right") - 1
            words = [[] for _ in range(n)]
            for d in np.unique(of).tolist():
                words[d] = (hit[of == d] - bounds[d]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["segment"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(row["lengths"], pa.int32()),
                 pa.array(words, pa.list_(pa.int32())), pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string()))],
                ["segment", "place", "id", "n_words", "hits", "items"])
    return run


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, part: int = 20, text: str = "text", doc_id: str = "doc_id",
                  item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, items`` (sorted) and ``contaminated``.

    A word is hit if it lies in any occurrence of a run of ``width`` consecutive words of an item (the whole item, if
    shorter); a document is contaminated if ``part * n_hit >= n_words`` and there is a hit. The index keeps whole
    documents in a segment, so intersection and counting stay in the task that holds the segment, and nothing is
    shuffled but the term counts. Items are searched in blocks of ``BLOCK_PHRASES`` runs.

    Nulls: null and wordless texts have no words and no hits; null document ids are kept; a null item id counts as an
    item named by the empty string. Items that share an id are one item. Repeated rows each give a row. Without items
    nothing is hit. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    index = build_index(docs, terms_of(items, item_text), text, doc_id)
    phrases = by_rarity(windows_of(items.withColumn(item_id, F.coalesce(F.col(item_id).cast("string"), F.lit(""))), width, item_text, item_id), index)
    schema = "segment bigint, place int, id bigint, n_words int, hits array<int>, items array<string>"
    found = [index.mapInArrow(_covered(spark.sparkContext.broadcast(b)), schema) for b in _blocks(phrases)]
    out = found[0]
    if len(found) > 1:                                       # one row per document and block of phrases
        for f in found[1:]:
            out = out.unionByName(f)
        out = out.groupBy("segment", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
                                                  F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.size("hits").cast("bigint")
    return out.select(F.col("id").alias(doc_id), F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), "items",
                      ((n_hit > 0) & (F.lit(part) * n_hit >= F.col("n_words"))).alias("contaminated"))


def contamination_sql(width: int = WINDOW) -> str:
    """The same by joining all word windows, for small tables."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    run = "array_to_string(w[p:p + k - 1], ' ')"
    return f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, {run} AS s FROM (SELECT item, w, least({width}, len(w)) AS k, unnest(range(1, len(w) - least({width}, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {words} AS w FROM documents),
dw AS (SELECT doc_id, p, k, {run} AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw))),
m AS (SELECT DISTINCT doc_id, p, k, item FROM dw JOIN bw USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.s, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, all columns, that are not contaminated by ``items``. Rows are told apart by id and text."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    found = contamination(docs.select(key.alias("row"), F.col(text).alias("text")), items, doc_id="row")
    gone = found.where("contaminated").select(F.col("row").alias("__gone")).distinct()
    return docs.join(gone, key == F.col("__gone"), "left_anti")
