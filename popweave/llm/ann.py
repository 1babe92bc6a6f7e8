"""Approximate nearest neighbours by a hash-prefix forest."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from popweave.llm.common import Shared, written

TREES = 64
BITS = 32                      # length of a hash string
DEPTH = 14                     # the descent starts here; deeper prefixes hold one vector or equal ones
SEGMENT_ROWS = 4096
MISS = 0.03                    # chance left that a vector as near as the k-th found was met in no tree
QUERY_BLOCK = 20_000           # queries that go to the tasks at once

INDEX = "dim int, ids array<bigint>, vectors binary, shortest double, longest double, keys binary, places binary"


def _usable(df: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """Rows that take part: an id, and a vector that is not null, empty or zero, with finite components only."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    base = df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return base.where(F.col("id").isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0))


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, TREES * BITS)).astype(np.float32)


def hash_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For every vector and tree the signs of 32 random projections as one number, first sign highest."""
    bits = (x.astype(np.float32) @ planes > 0).reshape(len(x), TREES, BITS)
    return np.packbits(bits, axis=2).view(">u4").reshape(len(x), TREES).astype(np.uint32)


def build_forest(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The index of every row that takes part, written to the shared folder: one row per segment.

    A segment has up to ``SEGMENT_ROWS`` vectors of one length, their norms' range, and for each tree the sorted hash
    strings with the places of their vectors. Nothing is shuffled.
    """
    def segments(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT_ROWS):
                part = batch.slice(at, SEGMENT_ROWS)
                ids, v = part.column("id").to_numpy(zero_copy_only=False), part.column("v")
                lengths = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
                flat = v.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                for dim in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == dim)
                    x = np.stack([flat[ends[i] - dim:ends[i]] for i in own])
                    keys = hash_strings(x, planes.setdefault(dim, _planes(dim)))
                    order = np.argsort(keys, axis=0, kind="stable")
                    norm = np.sqrt((x ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([ids[own]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), pa.array([norm.min()]), pa.array([norm.max()]),
                         pa.array([np.take_along_axis(keys, order, axis=0).T.tobytes()], pa.binary()), pa.array([order.T.astype(np.uint16).tobytes()], pa.binary())],
                        ["dim", "ids", "vectors", "shortest", "longest", "keys", "places"])

    return written(_usable(vectors, vector, vec_id).mapInArrow(segments, INDEX), "forest")


def agreement(norm: float, far: float, shortest: float, longest: float) -> float:
    """The least chance that one sign agrees for a vector at distance ``far`` whose norm lies in the given range."""
    gap = norm ** 2 - far ** 2
    r = min(max(np.sqrt(gap), shortest), longest) if gap > 0 else shortest
    cosine = (gap / r + r) / (2 * norm)
    return 1 - float(np.arccos(np.clip(cosine, -1, 1))) / np.pi


class _Segment:
    def __init__(self, row: dict):
        self.ids = np.asarray(row["ids"], np.int64)
        n = len(self.ids)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(n, row["dim"])
        self.keys = np.frombuffer(row["keys"], np.uint32).reshape(TREES, n)
        self.places = np.frombuffer(row["places"], np.uint16).reshape(TREES, n)
        self.shortest, self.longest = row["shortest"], row["longest"]

    def ranges(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each depth, query and tree the run of entries that share the query's prefix."""
        lo, hi = (np.empty((DEPTH + 1, *keys.shape), np.int32) for _ in range(2))
        for depth in range(DEPTH + 1):
            rest = np.uint32((1 << (BITS - depth)) - 1)
            for t in range(TREES):
                lo[depth, :, t] = np.searchsorted(self.keys[t], keys[:, t] & ~rest, side="left")
                hi[depth, :, t] = np.searchsorted(self.keys[t], keys[:, t] | rest, side="right")
        return lo, hi

    def nearest(self, own: int, q: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, bound: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest candidates by distance, then id.

        All trees start at their longest common prefixes and go up one level at a time together. The ascent ends where a
        vector as near as the k-th nearest known (here, or in segments seen before: ``bound``) would have been met with
        a chance of ``1 - MISS``; at depth 0 every vector of the segment has been met.
        """
        n = len(self.ids)
        seen = np.zeros(n, bool)
        ids, dist, looked = np.empty(0, np.int64), np.empty(0), 0
        norm = float(np.sqrt((q ** 2).sum()))
        for depth in range(DEPTH, -1, -1):
            fresh = np.zeros(n, bool)
            if depth:
                for t in np.flatnonzero(hi[depth] > lo[depth]):
                    fresh[self.places[t, lo[depth, t]:hi[depth, t]]] = True
                fresh &= ~seen
            else:
                fresh = ~seen
            new = np.flatnonzero(fresh)
            if len(new):
                seen[new] = True
                looked += len(new)
                new = new[self.ids[new] != own]
                d = np.sqrt(((self.x[new] - q) ** 2).sum(axis=1))
                ids, dist = np.concatenate([ids, self.ids[new]]), np.concatenate([dist, d])
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            reach = min(bound, dist[k - 1] if len(dist) >= k else np.inf)
            if depth and np.isfinite(reach) and (1 - agreement(norm, reach, self.shortest, self.longest) ** depth) ** TREES <= MISS:
                break
        return ids, dist, looked


def search(index: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found by Euclidean distance in double precision.

    Nearest first, ties to the smaller id; rows with the query's own id are left out. Queries go to the tasks in blocks
    of ``QUERY_BLOCK``; a task keeps the best ``k`` of each query over all its segments, so it sends ``k`` rows a query.
    Nulls: queries that are null, empty, zero or not finite give no rows, as do vectors of another length. Rows that
    repeat an id are separate candidates; repeated query ids are searched once. Empty tables give an empty result.
    """
    found = None
    for block in _blocks(_usable(queries, vector, vec_id).dropDuplicates(["id"])):
        one = index.mapInArrow(_searcher(Shared(index.sparkSession, block), k), "query_id bigint, vec_id bigint, score double, looked bigint")
        found = one if found is None else found.unionByName(one)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(queries: DataFrame):
    block = []
    for r in queries.toLocalIterator():
        block.append((r["id"], np.array(r["v"], float)))
        if len(block) == QUERY_BLOCK:
            yield block
            block = []
    yield block


def _searcher(shared: Shared, k: int):
    def run(batches):
        by_dim, best, looked = None, {}, {}
        for batch in batches:
            if by_dim is None:
                by_dim = {}
                for i, v in shared.get():
                    by_dim.setdefault(len(v), []).append((i, v))
                by_dim = {d: ([i for i, _ in qs], np.stack([v for _, v in qs]), hash_strings(np.stack([v for _, v in qs]), _planes(d))) for d, qs in by_dim.items()}
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() if n != "ids" else batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in batch.schema.names}
                if row["dim"] not in by_dim:
                    continue
                ids, vectors, keys = by_dim[row["dim"]]
                seg = _Segment(row)
                for at in range(0, len(ids), 500):
                    lo, hi = seg.ranges(keys[at:at + 500])
                    for j, own in enumerate(ids[at:at + 500]):
                        had = best.get(own, (np.empty(0, np.int64), np.empty(0)))
                        got = seg.nearest(own, vectors[at + j], lo[:, j], hi[:, j], k, had[1][k - 1] if len(had[1]) >= k else np.inf)
                        both = np.concatenate([had[0], got[0]]), np.concatenate([had[1], got[1]])
                        keep = np.lexsort(both)[:k]
                        best[own] = both[0][keep], both[1][keep]
                        looked[own] = looked.get(own, 0) + got[2]
        if best:
            owner = [own for own, (ids, _) in best.items() for _ in ids]
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate([b[0] for b in best.values()])), pa.array(np.concatenate([b[1] for b in best.values()])),
                                              pa.array([looked[o] for o in owner], pa.int64())], ["query_id", "vec_id", "score", "looked"])
    return run
