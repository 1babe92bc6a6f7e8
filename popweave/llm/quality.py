"""Compression classifier for quality: zstandard dictionaries of good and bad text, calibrated size difference."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from popweave.llm.common import Shared, bounded_sample, fitted, map_slices

SAMPLE = 2000                  # labelled rows of each label that the model is fitted on, in one task, at most (documented bound)
CHUNK = 256                    # a text is compressed in pieces of so many bytes, each against the whole dictionary
DICTIONARY = 112_640           # bytes of a dictionary, at most
LEVEL = 3
RIDGE = 1e-3


def chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


def dictionary(texts: list) -> bytes:
    """A trained dictionary; where the texts are too few to train one, their bytes."""
    pieces = [c for t in texts for c in chunks(t)]
    step = max(1, len(pieces) // 20_000)                                   # the trainer's own sample, from all over the texts
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces[::step]).as_bytes()
    except (zstandard.ZstdError, MemoryError, ValueError):
        return b"".join(pieces[::max(1, len(pieces) * CHUNK // DICTIONARY)])[:DICTIONARY]


class Sizes:
    """Compressed sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        def made(d):
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None,
                                            write_content_size=False, write_checksum=False, write_dict_id=False)
        self.good, self.bad = made(good), made(bad)

    def of(self, text: str | None) -> tuple[int, int, int]:
        parts = chunks(text)
        return sum(len(self.good.compress(p)) for p in parts), sum(len(self.bad.compress(p)) for p in parts), sum(map(len, parts))


def features(sizes: np.ndarray) -> np.ndarray:
    """Normalised size difference, mean normalised size, shortness, and their products."""
    good, bad, n = sizes.T.astype(float)
    full = np.maximum(n, 1)
    x = np.stack([(bad - good) / full, (bad + good) / full, 1 / (1 + n / 100)], axis=1)
    return np.column_stack([x, x[:, [0]] * x, x[:, [1]] * x[:, 1:], x[:, 2] ** 2])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 50, even: bool = False) -> np.ndarray:
    """Newton steps for the ridge logit; the intercept comes last and is not shrunk. ``even`` weighs both labels alike."""
    share = y.mean()
    each = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if even else np.ones(len(y))
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(x))
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + keep * w
        move = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + np.diag(keep), g)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def scores(self, texts: list) -> np.ndarray:
        sizes = Sizes(self.good, self.bad)
        x = (features(np.array([sizes.of(t) for t in texts], float).reshape(-1, 3)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weight[:-1] + self.weight[-1], -30, 30)))


def train(texts: list, labels: np.ndarray) -> Model:
    """Dictionaries from three fifths of the texts, calibration of the size difference on the others."""
    place = np.arange(len(texts))
    build, check = place % 5 < 3, place % 5 >= 3
    if len(set(labels[check])) < 2 or len(set(labels[build])) < 2:
        build = check = np.ones(len(texts), bool)
    good, bad = (dictionary([t for t, b, y in zip(texts, build, labels, strict=True) if b and y == v]) for v in (1, 0))
    sizes = Sizes(good, bad)
    x = features(np.array([sizes.of(t) for t, c in zip(texts, check, strict=True) if c], float).reshape(-1, 3))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(good, bad, mean, scale, logistic((x - mean) / scale, labels[check], even=True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled rows of each label (all, where there are fewer), picked by a hash of the id;
    ``labels`` has ids and labels.

    The score is calibrated at even odds of the two labels, however rare one is. Rows without a label are left out;
    without any, the model is a constant.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    known = base.select("id").join(labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("label is not null"), "id")
    sample_rows, _ = bounded_sample(base, known, ["label"], sample)
    got = fitted(sample_rows, ["label", "id", "text"], lambda label, id_, text: train(text, np.array(label, float)))
    return got or Model(b"", b"", np.zeros(9), np.ones(9), np.zeros(10))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, score`` (0 to 1, higher is better), ``good_bytes``, ``bad_bytes``, ``text_bytes``.

    Every piece of the whole text is compressed against both dictionaries. Nulls: a null text scores as an empty one.
    Repeated rows each give a row; other columns are not read; an empty table gives an empty result.
    """
    shared = Shared(docs.sparkSession, model)

    def rate(part: pa.RecordBatch) -> dict:
        m, texts = shared.get(), part.column("text").to_pylist()
        sizes = Sizes(m.good, m.bad)
        n = np.array([sizes.of(t) for t in texts], float).reshape(-1, 3)
        x = (features(n) - m.mean) / m.scale
        s = 1 / (1 + np.exp(-np.clip(x @ m.weight[:-1] + m.weight[-1], -30, 30)))
        return {"id": part.column("id"), "score": s, "good_bytes": n[:, 0].astype(np.int64), "bad_bytes": n[:, 1].astype(np.int64), "text_bytes": n[:, 2].astype(np.int64)}

    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return map_slices(base, rate, "id bigint, score double, good_bytes bigint, bad_bytes bigint, text_bytes bigint").withColumnRenamed("id", doc_id)
