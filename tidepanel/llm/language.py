"""Language identification by hierarchical discrimination.

Square roots of byte-trigram counts, scaled to length one, are the features.
The learned languages are grouped into families by average linkage of their
centroids (⌈√languages⌉ families); a text's family is predicted first, then
one-versus-one linear support vector machines separate the languages within it.
Each machine is fitted by dual coordinate descent on at most ``per_language``
rows of a language (chosen by the hash of id and text).

Defined results: a text that is null or has no letter is ``und`` with score 0;
a null lang is not learned, every other lang value is; with one learned language
all texts are that one, with none all are ``und``; rows with a null or repeated
id are learned from and predicted each by itself, equal rows once; extra columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, text_bytes
from .linear import gram_codes, hinge

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def features(raw: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters alone count: other ASCII is white space, and A-Z is folded."""
    n = np.bincount(gram_codes(b" " + b" ".join(raw.translate(_FOLD).split()) + b" ", dim), minlength=dim)
    at = np.flatnonzero(n)
    v = np.sqrt(n[at])
    return at, v / np.sqrt(v @ v)


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    folded = raw.translate(_FOLD, b"")
    if any(97 <= c <= 122 for c in folded[:64]) or any(97 <= c <= 122 for c in folded):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


@dataclass
class LanguageModel:
    dim: int
    families: list[list[str]]
    machines: dict[tuple, np.ndarray] = field(default_factory=dict)  # (level, i, j): positive for i

    def _vote(self, level, n: int, at: np.ndarray, v: np.ndarray) -> tuple[int, float]:
        """The class with most wins (ties: the larger summed probability) and its mean pairwise probability."""
        if n == 1:
            return 0, 1.0
        won, chance = np.zeros(n), np.zeros(n)
        for i, j in combinations(range(n), 2):
            w = self.machines[level, i, j]
            p = 1 / (1 + np.exp(-np.clip(4 * (float(w[at] @ v) + w[self.dim]), -35, 35)))
            won[i if p >= 0.5 else j] += 1
            chance[i] += p
            chance[j] += 1 - p
        best = max(range(n), key=lambda k: (won[k], chance[k], -k))
        return best, float(chance[best] / (n - 1))

    def predict(self, raw: bytes | None) -> tuple[str, float]:
        if not self.families or not has_letter(raw):
            return "und", 0.0
        at, v = features(raw, self.dim)
        f, p = self._vote("family", len(self.families), at, v)
        k, q = self._vote(f, len(self.families[f]), at, v)
        return self.families[f][k], p * q


def group(names: list[str], centroids: np.ndarray, families: int) -> list[list[str]]:
    """Average-linkage clusters of the centroids by cosine, as many as asked for."""
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    near, clusters = unit @ unit.T, [[i] for i in range(len(names))]
    while len(clusters) > families:
        i, j = max(combinations(range(len(clusters)), 2), key=lambda p: near[np.ix_(clusters[p[0]], clusters[p[1]])].mean())
        clusters[i] += clusters.pop(j)
    return [[names[i] for i in sorted(c)] for c in clusters]


def _examples(dim: int):
    def run(batches):
        for batch in batches:
            rows = [features(t, dim) if has_letter(t) else None for t in text_bytes(batch.column("text"))]
            part = [(lang, *(x.astype(k).tobytes() for x, k in zip(r, (np.int32, np.float32), strict=True))) for lang, r in zip(batch.column("lang").to_pylist(), rows, strict=True) if r]
            columns = zip(*part, strict=True) if part else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "at", "v"])

    return run


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = 1 << 14, per_language: int = 400, most_languages: int = 64, least: int = 8) -> LanguageModel:
    """A model of all languages of the documents given. Beyond ``most_languages`` each has fewer examples, ``least`` at least, so that about per_language × most_languages reach the driver."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    names = sorted(r.lang for r in sizes.select("lang").collect())
    if not names:
        return LanguageModel(dim, [])
    if len(names) > most_languages:
        per_language = min(per_language, max(least, per_language * most_languages // len(names)))
    # a row for each language, whose names the driver holds too; equal rows count once
    shares = F.broadcast(sizes.select("lang", F.least(F.lit(1.0), (per_language + 3 * per_language**0.5) / F.col("n")).alias("share")))
    sample = rows.join(shares, "lang").where(sampled(F.col("share"), "doc_id", "text")).dropDuplicates(["doc_id", "lang", "text"])
    x: dict[str, list] = {n: [] for n in names}
    for r in sample.select("lang", "text").mapInArrow(_examples(dim), "lang string, at binary, v binary").collect():
        x[r.lang].append((np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r.v, np.float32).astype(np.float64)))
    names = [n for n in names if x[n]]
    if not names:
        return LanguageModel(dim, [])
    centroids = np.zeros((len(names), dim))
    for i, n in enumerate(names):
        x[n].sort(key=lambda p: (len(p[0]), p[0].tobytes(), p[1].tobytes()))
        x[n] = [x[n][k] for k in np.linspace(0, len(x[n]) - 1, min(len(x[n]), per_language)).astype(int)]
        for at, v in x[n]:
            centroids[i, at] += v / len(x[n])
    model = LanguageModel(dim, group(names, centroids, ceil(sqrt(len(names)))))

    def fit(level, sets: list[list]) -> None:
        for i, j in combinations(range(len(sets)), 2):
            y = np.array([1] * len(sets[i]) + [-1] * len(sets[j]))
            model.machines[level, i, j] = hinge(sets[i] + sets[j], y, dim, cost=4.0, epochs=8)

    fit("family", [[r for n in f for r in x[n]] for f in model.families])
    for k, f in enumerate(model.families):
        fit(k, [x[n] for n in f])
    return model


def language_column(model: LanguageModel, text_col: str = "text") -> Column:
    """struct(lang_pred, score) of each whole text."""

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        lang, score = zip(*map(model.predict, text_bytes(texts)), strict=True) if len(texts) else ((), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    return predict(F.col(text_col).cast("string"))
