"""Convolutional text classifier: hashed word embeddings, filters of several widths, max pooling; trained in numpy."""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from popweave.llm.common import Shared, in_slices, map_slices, small, written

PART = 4000                    # labelled rows that one task trains on
STEP = 64                      # bins of calibration scores in a unit of log-odds
BUCKETS = 1 << 17
DIMENSIONS = 8
FILTERS = 8                    # of each width
WIDTHS = (1, 2, 3)
EPOCHS = 8                     # of every part, however many there are
BATCH = 50
RATE = 0.05
GRAMS = (3, 4, 5)
LEAST_POSITIVE = 25            # languages with fewer positive calibration rows use the threshold of all
# Letters, digits and characters beyond ASCII belong to words.
_WORD_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def _number(texts: list) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (the first is the empty pad), the texts as word numbers between pads, and where each text starts."""
    seen: dict[bytes, int] = {b"": 0}
    number = seen.setdefault
    pad = [0] * (max(WIDTHS) - 1)
    ids = [np.array([number(w, len(seen)) for w in words_of(t)] + pad, np.int32) for t in texts]
    starts = np.cumsum([0] + [len(i) for i in ids[:-1]])
    return list(seen), np.concatenate([*ids, np.array(pad, np.int32)]), starts


def hashed_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's whole form and of its marked n-grams, one word after the other, and where each begins."""
    parts = [_hashed(words[i:i + 20_000]) for i in range(0, len(words), 20_000)]
    before = np.cumsum([0] + [len(g) for g, _ in parts[:-1]])
    return np.concatenate([g for g, _ in parts]), np.concatenate([b + n for (_, b), n in zip(parts, before, strict=True)])


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = [b"<" + w + b">" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    buffer = np.frombuffer(b"".join(marked) + b"\0" * max(GRAMS), np.uint8).astype(np.uint64)
    n = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(first + lengths, lengths) - np.arange(n)              # bytes from here to the word's end
    prime, owners, buckets = np.uint64(0x100000001B3), [np.arange(len(words))], []
    # whole form: a polynomial of the bytes
    powers = (np.uint64(0x9E3779B97F4A7C15) * (np.arange(1, 257, dtype=np.uint64)[(np.arange(n) - np.repeat(first, lengths)) % 256] ** np.uint64(3) + np.uint64(7)))
    whole = np.add.reduceat(powers * (buffer[:n] + np.uint64(1)), first) + lengths.astype(np.uint64)
    buckets.append(whole * np.uint64(0xC2B2AE3D27D4EB4F))
    for g in GRAMS:
        h = np.full(n, np.uint64(g * 0xCBF29CE484222325 & 0xFFFFFFFFFFFFFFFF))
        for k in range(g):
            h = (h ^ buffer[k:n + k]) * prime
            h ^= h >> np.uint64(29)
        here = left >= g
        owners.append(word[here])
        buckets.append(h[here] * np.uint64(0xC2B2AE3D27D4EB4F))
    owner, bucket = np.concatenate(owners), (np.concatenate(buckets) >> np.uint64(64 - 17)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    embedding: np.ndarray
    filters: list              # for each width: (width, DIMENSIONS, FILTERS)
    bias: list
    weight: np.ndarray
    prior: float
    thresholds: dict = field(default_factory=dict)

    def projected(self, grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Every word's embedding, the mean of its buckets."""
        ends = np.append(begin[1:], len(grams))
        e = np.add.reduceat(self.embedding[grams], begin, axis=0) / (ends - begin)[:, None].astype(np.float32)
        e[0] = 0                                                           # the pad
        return e

    def features(self, ids: np.ndarray, starts: np.ndarray, e: np.ndarray, with_place: bool = False):
        """Max-pooled filter answers of each text; the pads behind a text keep filters from reaching into the next."""
        pooled, places = [], []
        n = len(ids) - max(WIDTHS) + 1
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            share = [e @ f[k] for k in range(w)]
            answer = share[0][ids[:n]]
            for k in range(1, w):
                answer += share[k][ids[k:n + k]]
            top = np.maximum.reduceat(answer, starts, axis=0)
            pooled.append(np.maximum(top + b, 0))
            if with_place:
                ends = np.append(starts[1:], n)
                places.append(np.stack([s + answer[s:t].argmax(axis=0) for s, t in zip(starts, ends, strict=True)]))
        return (np.concatenate(pooled, axis=1), places) if with_place else np.concatenate(pooled, axis=1)

    def scores(self, texts: list) -> np.ndarray:
        words, ids, starts = _number(texts)
        x = self.features(ids, starts, self.projected(*hashed_grams(words)))
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.prior, -30, 30)))

    def threshold(self, lang) -> float:
        return self.thresholds.get(lang, self.thresholds[""])


def _own_grams(texts: list, labels: np.ndarray, counts: np.ndarray, n_docs: np.ndarray) -> None:
    """Add the texts' distinct buckets, and the texts themselves, to the counts of their label."""
    words, ids, starts = _number(texts)
    grams, begin = hashed_grams(words)
    ends = np.append(begin[1:], len(grams))
    stop = np.append(starts[1:], len(ids) - max(WIDTHS) + 1)
    for s, t, y in zip(starts, stop, labels, strict=True):
        u = np.unique(ids[s:t])
        counts[int(y), np.unique(grams[np.repeat(begin[u], ends[u] - begin[u]) + _ramp(ends[u] - begin[u])])] += 1
        n_docs[int(y)] += 1


def begun(counts: np.ndarray, n_docs: np.ndarray, seed: int = 7) -> Model:
    """The model that training starts from.

    Buckets start from the log-odds of their document counts (one direction of the embedding), so pooling looks at
    telling words from the first step; the rest starts from small random numbers.
    """
    rng = np.random.default_rng(seed)
    odds = np.log((counts[1] + 0.5) / (n_docs[1] + 1)) - np.log((counts[0] + 0.5) / (n_docs[0] + 1))
    sure = counts.sum(axis=0) / (counts.sum(axis=0) + 5)                   # rare buckets tell little
    embedding = rng.uniform(-0.02, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    embedding[:, 0] = (odds * sure).astype(np.float32)
    filters = [rng.uniform(-0.3, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, 0] = 1.0
    bias = [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS]
    weight = rng.uniform(-0.1, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    weight[::FILTERS] = 0.3
    return Model(embedding, filters, bias, weight, float(np.log((n_docs[1] + 1) / (n_docs[0] + 1))))


def _numbered(texts: list) -> tuple[np.ndarray, ...]:
    """Texts as word numbers, where each begins and ends, and the buckets of their distinct words with their bounds."""
    words, ids, starts = _number(texts)
    grams, begin = hashed_grams(words)
    return ids, starts, np.append(starts[1:], len(ids) - max(WIDTHS) + 1), grams, begin, np.append(begin[1:], len(grams))


def train(m: Model, rows: Iterable[tuple[list, np.ndarray]], epochs: int, seed: int = 7) -> Model:
    """Go on from ``m`` by Adagrad on the logistic loss; all epochs read the words as numbered once."""
    rng = np.random.default_rng(seed)
    m = Model(m.embedding.copy(), [f.copy() for f in m.filters], [b.copy() for b in m.bias], m.weight.copy(), m.prior)
    sums = {"e": np.full(BUCKETS, 1e-3, np.float32), "f": [np.full_like(f, 1e-3) for f in m.filters], "b": [np.full_like(b, 1e-3) for b in m.bias], "w": np.full_like(m.weight, 1e-3)}
    prior_sum = 1e-3
    pad = np.zeros(max(WIDTHS) - 1, np.int64)
    numbered = [(_numbered(texts), labels) for texts, labels in rows]
    for (ids, starts, stop, grams, begin, ends), labels in (r for _ in range(epochs) for r in numbered):
        for chosen in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            parts = [ids[starts[i]:stop[i]] for i in chosen]
            whole = np.concatenate([*parts, pad])
            place = np.zeros(len(begin), np.int64)
            place[whole] = 1
            own = np.flatnonzero(place)                                    # own[0] is the pad
            place[own] = np.arange(len(own))
            local = place[whole]
            at = np.cumsum([0] + [len(p) for p in parts[:-1]])
            take = begin[own]
            lengths = ends[own] - take
            flat = grams[np.repeat(take, lengths) + _ramp(lengths)]
            first = np.cumsum(lengths) - lengths
            e = m.projected(flat, first)
            x, places = m.features(local, at, e, with_place=True)
            p = 1 / (1 + np.exp(-np.clip(x @ m.weight + m.prior, -30, 30)))
            d = ((p - labels[chosen]) / len(chosen)).astype(np.float32)
            gw = x.T @ d + 1e-4 * m.weight
            gx = d[:, None] * m.weight[None, :] * (x > 0)
            ge = np.zeros_like(e)
            for j, w in enumerate(WIDTHS):
                g = gx[:, j * FILTERS:(j + 1) * FILTERS]
                gf = np.zeros_like(m.filters[j])
                for k in range(w):
                    word = local[places[j] + k]                            # texts x FILTERS
                    for c in range(FILTERS):
                        gf[k, :, c] = g[:, c] @ e[word[:, c]]
                        np.add.at(ge, word[:, c], g[:, c:c + 1] * m.filters[j][k, :, c][None, :])
                _step(m.filters[j], gf, sums["f"][j])
                _step(m.bias[j], g.sum(axis=0), sums["b"][j])
            _step(m.weight, gw, sums["w"])
            prior_sum += float(d.sum()) ** 2
            m.prior -= RATE * float(d.sum()) / np.sqrt(prior_sum)
            ge[0] = 0
            moved = np.flatnonzero(np.abs(ge).sum(axis=1) > 0)
            if len(moved):
                many = lengths[moved]
                target = flat[np.repeat(first[moved], many) + _ramp(many)]
                change = np.repeat(ge[moved] / many[:, None].astype(np.float32), many, axis=0)
                np.add.at(sums["e"], target, (change ** 2).sum(axis=1))
                np.add.at(m.embedding, target, -RATE * change / np.sqrt(sums["e"][target])[:, None])
    return m


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length, one after the other."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _step(value: np.ndarray, gradient: np.ndarray, total: np.ndarray) -> None:
    total += gradient ** 2
    value -= RATE * gradient / np.sqrt(total)


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle, in log-odds, of the gap below the lowest score that is accepted at the highest F1 of the weighted rows."""
    order = np.argsort(-scores, kind="stable")
    s, w = scores[order], weights[order]
    y = labels[order] * w
    f1 = 2 * np.cumsum(y) / (np.cumsum(w) + max(1, y.sum()))
    f1[:-1][s[:-1] == s[1:]] = -1                                          # equal scores fall on one side
    i = int(np.argmax(f1))
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))        # noqa: E731
    return float(1 / (1 + np.exp(-(logit(s[i]) + logit(s[min(i + 1, len(s) - 1)])) / 2)))


def _packed(m: Model) -> np.ndarray:
    """All parameters as rows of ``DIMENSIONS`` numbers, the buckets first."""
    rest = np.concatenate([*(f.ravel() for f in m.filters), *m.bias, m.weight, [m.prior]]).astype(np.float64)
    return np.concatenate([m.embedding.astype(np.float64), np.resize(np.append(rest, np.zeros(-len(rest) % DIMENSIONS)), (-(-len(rest) // DIMENSIONS), DIMENSIONS))])


def _unpacked(rows: np.ndarray) -> Model:
    rest, at = rows[BUCKETS:].ravel(), 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        at += int(np.prod(shape))
        return rest[at - int(np.prod(shape)):at].reshape(shape).astype(np.float32)

    return Model(rows[:BUCKETS].astype(np.float32), [take(w, DIMENSIONS, FILTERS) for w in WIDTHS], [take(FILTERS) for _ in WIDTHS], take(FILTERS * len(WIDTHS)), float(take(1)[0]))


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each label that hold a bucket, and documents of each label, over all rows."""
    def run(batches):
        counts, n_docs = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for part in in_slices(batches, "text"):
            _own_grams(part.column("text").to_pylist(), part.column("label").to_numpy(zero_copy_only=False), counts, n_docs)
        full = np.concatenate([counts, np.repeat(n_docs[:, None], 1, axis=1)], axis=1)
        label, at = np.nonzero(full)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(at, pa.int32()), pa.array(full[label, at])], ["label", "at", "n"])

    got = rows.select("text", "label").mapInArrow(run, "label int, at int, n bigint").groupBy("label", "at").agg(F.sum("n").alias("n")).toArrow()
    full = np.zeros((2, BUCKETS + 1))
    full[got.column("label").to_numpy(), got.column("at").to_numpy()] = got.column("n").to_numpy()
    return full[:, :BUCKETS], full[:, BUCKETS]


def _trained(rows: DataFrame, start: Model, n: int) -> Model:
    """Parts of about ``PART`` rows, dealt by id, go on from ``start`` by themselves, ``EPOCHS`` times over their rows; a parameter moves by the mean of the parts that move it."""
    parts, shared = -(-n // PART), Shared(rows.sparkSession, start)

    def run(batches):
        own = ((p.column("text").to_pylist(), p.column("label").to_numpy(zero_copy_only=False).astype(float)) for p in in_slices(batches, "text"))
        if (some := next(own, None)) is not None:
            m = shared.get()
            move = _packed(train(m, chain([some], own), EPOCHS)) - _packed(m)
            at = np.flatnonzero(np.abs(move).sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(move[at, i]) for i in range(DIMENSIONS))], ["at", *columns])

    columns = [f"d{i}" for i in range(DIMENSIONS)]
    dealt = rows.repartition(parts, "id").sortWithinPartitions(F.xxhash64("id"), "id", "label", "text").select("text", "label")
    moved = dealt.mapInArrow(run, "at int, " + ", ".join(f"{c} double" for c in columns)).groupBy("at").agg(*[F.avg(c).alias(c) for c in columns]).toArrow()
    packed = _packed(start)
    packed[moved.column("at").to_numpy()] += np.stack([moved.column(c).to_numpy() for c in columns], axis=1)
    return _unpacked(packed)


def _thresholds(rows: DataFrame, model: Model) -> dict:
    """The best threshold of all rows, and of each language with enough positive ones; scores are counted in narrow bins of log-odds."""
    shared = Shared(rows.sparkSession, model)

    def score(part: pa.RecordBatch) -> dict:
        s = np.clip(shared.get().scores(part.column("text").to_pylist()).astype(float), 1e-9, 1 - 1e-9)
        return {"lang": part.column("lang"), "label": part.column("label"), "at": np.floor(np.log(s / (1 - s)) * STEP).astype(np.int32)}

    bins = written(map_slices(rows.select("lang", "label", "text"), score, "lang string, label int, at int", limit=1_000_000).groupBy("lang", "at")
                   .agg(F.sum((F.col("label") == 1).cast("bigint")).alias("one"), F.count(F.lit(1)).alias("n")), "bins")
    many = bins.where("lang is not null and lang <> ''").groupBy("lang").agg(F.sum("one").alias("ones"), F.sum("n").alias("all")).where(f"ones >= {LEAST_POSITIVE} and ones < all").select("lang")
    own = bins.join(many, "lang").select("lang", "at", "one", "n").unionByName(bins.groupBy("at").agg(F.sum("one").alias("one"), F.sum("n").alias("n")).select(F.lit("").alias("lang"), "at", "one", "n"))
    got = own.toPandas()
    out = {}
    for name, g in got.groupby("lang"):
        s = 1 / (1 + np.exp(-(g["at"].to_numpy() + 0.5) / STEP))
        one, none = g["one"].to_numpy(float), g["n"].to_numpy(float) - g["one"].to_numpy(float)
        out[name] = min(0.9, max(0.1, best_threshold(np.repeat(s, 2), np.tile([1.0, 0.0], len(s)), np.stack([one, none], axis=1).ravel())))
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from all labelled rows; ``labels`` has ids and labels.

    Three quarters (by a hash of the id) train: their bucket counts are added up and give the start of the model, from which
    tasks train on parts of the rows and are averaged. The rest, which the training does not see, gives one threshold
    per language. Only the model, of
    fixed size, and bins of scores reach the driver. Rows without a label are left out. Without any labelled row the model is a constant.
    """
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    held = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(4)) == 3
    known = written(base.select("id").distinct().join(labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("label is not null"), "id").withColumn("held", held), "known")
    rows = base.join(small(known), "id")
    sizes = {(r["held"], r["label"]): r["n"] for r in known.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda h: sum(n for (x, _), n in sizes.items() if x == h)       # noqa: E731
    if not sizes:
        return Model(np.zeros((BUCKETS, DIMENSIONS), np.float32), [np.zeros((w, DIMENSIONS, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                     np.zeros(FILTERS * len(WIDTHS), np.float32), -3.0, {"": 0.5})
    use, rest = (rows.where("not held") if size(False) else rows), (rows.where("held") if size(True) else rows)
    counts, n_docs = _counted(use)
    model = _trained(use, begun(counts, n_docs), int(n_docs.sum()))
    model.thresholds = _thresholds(rest, model)
    return model


def classify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, score, threshold, rejected``.

    The score rests on the whole text alone. ``rejected`` compares it with the threshold of the row's language.
    Nulls: null, empty and wordless texts get the score of a text without telling words; unknown and null languages use the
    threshold of all. Repeated rows each give a row. Other columns are not read. An empty table gives an empty result.
    """
    shared = Shared(docs.sparkSession, model)

    def score(part: pa.RecordBatch) -> dict:
        m = shared.get()
        s = m.scores(part.column("text").to_pylist()).astype(float)
        t = np.array([m.threshold(x) for x in part.column("lang").to_pylist()])
        return {"id": part.column("id"), "score": s, "threshold": t, "rejected": s >= t}

    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return map_slices(base, score, "id bigint, score double, threshold double, rejected boolean", limit=1_000_000).withColumnRenamed("id", doc_id)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs``, all columns, whose score stays below the threshold of their language; nothing is shuffled."""
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        for part in in_slices(batches, text, 1_000_000):
            m = shared.get()
            s = m.scores(part.column(text).to_pylist())
            t = np.array([m.threshold(x) for x in part.column(lang).to_pylist()])
            yield part.filter(pa.array(s < t))

    return docs.mapInArrow(run, docs.schema)
