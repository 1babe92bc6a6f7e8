"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from popweave.llm.common import Shared, map_slices, mix, picked

SAMPLE = 1500                  # texts of each language that its profile is learned from, at most (documented bound)
PROFILE = 400                  # most frequent n-grams that a profile and a document keep
GRAMS = (1, 2, 3)
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_SLICE = 2_000_000


def _number(texts: list) -> tuple[list[str], list[np.ndarray]]:
    """Distinct words of all texts, and each text as word numbers. Runs without a letter are no words."""
    seen: dict[str, int] = {}
    number = seen.setdefault
    out = [np.array([number(w, len(seen)) for w in _LETTERS.findall(t.lower())] if t else [], np.int64) for t in texts]
    words = list(seen)
    odd = [i for i, w in enumerate(words) if not w.isalpha() and not any(map(str.isalpha, w))]
    if odd:
        drop = np.zeros(len(words), bool)
        drop[odd] = True
        out = [ids[~drop[ids]] for ids in out]
    return words, out


def hashed_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit numbers of each word's n-grams with a mark at both ends, where they begin, and how many there are."""
    if not words:
        return np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("_" + "__".join(words) + "_" + "\0" * max(GRAMS)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(first + lengths, lengths) - np.arange(n)
    owners, grams = [], []
    for g in GRAMS:
        h = np.full(n, np.uint64(g))
        for k in range(g):
            h = h * np.uint64(0x110001) + points[k:n + k]
        here = left >= g
        if g == 1:
            here &= (left > 1) & (left < np.repeat(lengths, lengths))     # the mark alone is no n-gram
        owners.append(word[here])
        grams.append((mix(h[here]) >> np.uint64(32)).astype(np.uint32))
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    many = np.bincount(owner, minlength=len(words))
    return gram[order], np.cumsum(many) - many, many


def counted(ids: np.ndarray, grams: np.ndarray, begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and how often they occur."""
    n = many[ids]
    total = int(n.sum())
    flat = np.sort(grams[np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(total)])
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if total else np.empty(0, np.int64)
    return flat[at], np.diff(np.append(at, total))


def ranked(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ``PROFILE`` most frequent n-grams, most frequent first, ties by number."""
    if len(gram) > PROFILE:
        least = np.partition(count, len(count) - PROFILE)[len(count) - PROFILE]
        keep = count >= least
        gram, count = gram[keep], count[keep]
    return gram[np.lexsort((gram, -count))][:PROFILE]


class Profiles:
    """Ranks of n-grams in every language; an n-gram that a profile lacks is ``PROFILE`` places out."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.langs = sorted(ranks)
        self.grams = np.unique(np.array([g for v in ranks.values() for g in v], np.uint32))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for j, name in enumerate(self.langs):
            own = np.array(ranks[name], np.uint32)
            self.rank[np.searchsorted(self.grams, own), j] = np.arange(len(own))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each language, as a part of the largest possible."""
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == top if len(self.grams) else np.zeros(len(top), bool)
        rank = self.rank[np.where(known, at, len(self.grams))]
        out = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(top))[:, None]))
        return out.sum(axis=0) / (len(top) * PROFILE)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles of all languages of ``docs``, each from about ``sample`` whole texts (all, where there are fewer).

    N-grams are counted in the tasks and added up by language; one row per place of a profile comes back. Rows with a
    null language or text teach nothing.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    rows, _ = picked(rows, ["lang"], sample)

    def count(part: pa.RecordBatch) -> dict:
        langs = np.array(part.column("lang").to_pylist(), object)
        words, ids = _number(part.column("text").to_pylist())
        packed, out = hashed_grams(words), {"lang": [], "gram": [], "n": []}
        for name in sorted(set(langs)):
            gram, n = counted(np.concatenate([ids[i] for i in np.flatnonzero(langs == name)]), *packed)
            out["lang"] += [name] * len(gram)
            out["gram"].append(gram.astype(np.int64))
            out["n"].append(n.astype(np.int64))
        return out | {k: np.concatenate(out[k]) for k in ("gram", "n")}

    sums = map_slices(rows, count, "lang string, gram bigint, n bigint", limit=_SLICE).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranks: dict[str, list] = {}
    for r in sorted(sums.withColumn("place", place).where(F.col("place") <= PROFILE).select("lang", "place", "gram").collect()):
        ranks.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranks)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``doc_id, lang_pred, score, distance``.

    The nearest profile by out-of-place distance of the whole text's most frequent n-grams; ties go to the smaller
    name. ``score`` is how much nearer it lies than the second (0: not at all, 1: wholly). ``und`` with score 0 if the
    text is null or has no letter, or if no language was learned; its distance is null. Repeated rows each give a row;
    other columns are not read; an empty table gives an empty result.
    """
    shared = Shared(docs.sparkSession, profiles)

    def guess(part: pa.RecordBatch) -> dict:
        p = shared.get()
        words, ids = _number(part.column("text").to_pylist())
        packed = hashed_grams(words)
        lang, score, distance = [], [], []
        for own in ids:
            if not len(own) or not p.langs:
                lang.append(UNDETERMINED), score.append(0.0), distance.append(None)
                continue
            d = p.distances(ranked(*counted(own, *packed)))
            best = int(np.argmin(d))
            second = np.delete(d, best).min() if len(d) > 1 else 1.0
            lang.append(p.langs[best]), score.append(float(1 - d[best] / second) if second > 0 else 0.0), distance.append(float(d[best]))
        return {"id": part.column("id"), "lang_pred": lang, "score": score, "distance": distance}

    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return map_slices(base, guess, "id bigint, lang_pred string, score double, distance double", limit=_SLICE).withColumnRenamed("id", doc_id)
