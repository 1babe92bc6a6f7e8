"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from popweave.session import shared_dir

# functions for tasks travel whole, so executors need no copy of this library
cloudpickle.register_pickle_by_value(sys.modules["popweave.llm"])

SLICE_BYTES = 4_000_000
VOCABULARY = 400_000


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a written step that nothing reads any more, through the store's own file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table."""
    return written_at(df, kind)[0]


def written_at(df: DataFrame, kind: str = "step") -> tuple[DataFrame, str]:
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def in_slices(batches: Iterator[pa.RecordBatch], size_of: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the column ``size_of`` holds about ``limit`` bytes a slice (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(batch.column(size_of)).to_numpy(zero_copy_only=False)))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str, size_of: str = "text",
               limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` turns a slice into columns (dict of arrays or lists in the order of ``schema``)."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for part in in_slices(batches, size_of, limit):
            got = fn(part)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


class WordHash(dict):
    """Word (bytes) to its 64-bit hash; forgets everything once it holds ``VOCABULARY`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; a shorter text that is not empty is one run."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width))
    for j in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j:n - width + 1 + j])
    return out


def crc_mod(column: str, mod: int):
    """crc32 of a column written as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


BROADCAST_ROWS = 500_000       # narrow rows (ids, counts) up to here go to all executors; beyond, joins shuffle


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few; else as it is. For rows of a few numbers only."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def picked(df: DataFrame, keys: list[str], bound: int) -> tuple[DataFrame, dict]:
    """About ``bound`` rows of each group (all, where there are fewer) by a hash of ``id``, and the size of each group.

    This is the documented bound on what a model is fitted on. The counts of the groups are joined by broadcast, so
    rows are not shuffled.
    """
    counts = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), "counts")
    unit = F.pmod(F.xxhash64("id", F.lit(20_23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = {tuple(r[k] for k in keys): r["__n"] for r in counts.collect()}
    return df.join(small(counts), keys).where(unit < F.lit(float(bound)) / F.col("__n")).drop("__n"), sizes


def bounded_sample(docs: DataFrame, ids: DataFrame, keys: list[str], bound: int) -> tuple[DataFrame, dict]:
    """Rows of ``docs`` (by ``id``) for about ``bound`` of the ``ids`` of each group, with the columns ``keys``.

    Only ids are counted and picked; texts are met by a broadcast of the picked ids, so no text is shuffled.
    """
    chosen, sizes = picked(ids, keys, bound)
    return docs.join(small(written(chosen, "picked")), "id"), sizes


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """Union-find over ``edges(a, b)``: one row ``(id, label)`` per node, label the smallest id reachable.

    Each round takes the smallest label among a node's neighbours, then lets each label point to its own label
    (path halving). State is a written table of nodes; a hub's neighbours are reduced before the shuffle, and the
    joins are plain equi-joins which adaptive execution splits on hot keys. Edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both, kept = written_at(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, old = written_at(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        heard = (both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("heard")))
        near = labels.join(heard.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "heard").alias("next"))
        jump = near.select(F.col("id").alias("next"), F.col("next").alias("far"))
        step, new = written_at(near.join(jump, "next").select("id", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        moved = step.where("moved").limit(1).count()
        drop_folder(spark, old)
        labels, old = step.select("id", "label"), new
        if not moved:
            drop_folder(spark, kept)
            return labels


class Shared:
    """An object that every executor gets once; it is unpickled once per task."""

    def __init__(self, spark: SparkSession, value):
        self.packed, self.value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def get(self):
        if self.value is None:
            self.value = pickle.loads(self.packed.value)
        return self.value


def fitted(sample: DataFrame, columns: list[str], fn: Callable):
    """``fn`` of the columns (lists) of a bounded sample, run in one task on an executor; None for an empty sample.

    Rows stand in the order of the columns, nulls first, so that a rerun fits the same model.
    """
    def run(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
        if rows:
            rows.sort(key=lambda r: [(v is not None, v) if v is not None else (False, 0) for v in r])
            yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(fn(*map(list, zip(*rows, strict=True))))])], ["model"])

    got = sample.select(*columns).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None
