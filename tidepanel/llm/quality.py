"""Quality classifier: naive Bayes support vectors.

Byte-trigram indicators, with those of the document's length class and of its
share of doubled words, are scaled by the log ratio of their class counts, which
are taken over all labelled training rows up to about ``most_labels`` labels, beyond that
over a sample of that size chosen by the hash of the ids; a linear hinge-loss model is
then fitted by dual coordinate descent on about ``per_class`` rows of each
label (chosen by the hash of id and text), and its margin is calibrated on a fifth
of these rows, weighted to the label shares of all training rows.

Defined results: a null or empty text has no features and gets the score of the
bias; a null id has no label; where an id has several labels its largest counts; each row of a repeated id is
learned from and scored by itself; labels other than 0 and 1 are not learned; with only one label, or none, every
score is that label, or 1; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, keep, sampled, text_bytes
from .linear import gram_codes, hinge, platt


#: Features beside the trigrams: 16 classes of length, 16 of the share of words that repeat the one before.
EXTRA = 32


def indicators(raw: bytes | None, dim: int) -> np.ndarray:
    """True for each feature of the text; dim trigram codes, then EXTRA."""
    seen = np.zeros(dim + EXTRA, bool)
    if raw:
        seen[gram_codes(raw, dim)] = True
        words = raw.split()
        twice = sum(map(eq, words, words[1:]))
        seen[dim + min(len(words).bit_length(), 15)] = True
        seen[dim + 16 + (min(int(20 * twice / len(words)) + 1, 15) if twice else 0)] = True
    return seen


@dataclass
class QualityModel:
    dim: int
    weight: np.ndarray  # of each feature, its scale included
    square: np.ndarray  # of each feature's scale
    bias: float
    a: float
    b: float

    def margin(self, raw: bytes | None) -> float:
        if not raw:
            return self.bias
        at = np.flatnonzero(indicators(raw, self.dim))
        return float(self.weight[at].sum() / np.sqrt(max(self.square[at].sum(), 1e-12))) + self.bias

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        m = np.array([self.margin(t) for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -35, 35)))


def held_out(id_col: str = "doc_id", mod: int = 5, remainder: int = 0) -> Column:
    """True where crc32 of the id as text leaves the remainder: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == remainder, F.lit(False))


def _counts(dim: int):
    """Per task, how many documents of each label hold each feature (feature -1: all documents)."""

    def run(batches):
        all_ = dim + EXTRA
        n = np.zeros((2, all_ + 1), np.int64)
        for batch in batches:
            for t, y in zip(text_bytes(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                n[y, all_] += 1
                n[y, :all_] += indicators(t, dim)
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == all_, -1, at).astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], ["feature", "n0", "n1"])

    return run


def _bits(dim: int):
    def run(batches):
        for batch in batches:
            out = [np.packbits(indicators(t, dim)).tobytes() for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], ["label", "bits"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", dim: int = 1 << 15, per_class: int = 3000, most_labels: int = 200_000) -> QualityModel:
    """A model from the labelled documents given.

    About ``most_labels`` labels, chosen by the hash of their ids (all, if there
    are fewer), are broadcast, so no text is shuffled or written to meet its
    label. ``dim`` features and ``per_class`` sampled rows (dim / 8 bytes each)
    bound what the driver holds.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = keep(known, "labels")
    share_of_labels = min(1.0, most_labels / max(known.count(), 1))
    rows = id_text(docs, id_col, text_col).join(F.broadcast(known.where(sampled(F.lit(share_of_labels), "doc_id"))), "doc_id")
    size = dim + EXTRA
    total = np.zeros((2, size + 1))
    for r in rows.select("text", "label").mapInArrow(_counts(dim), "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect():
        total[:, r.feature] = r.n0, r.n1
    count = total[:, size]
    nothing = QualityModel(dim, np.zeros(size), np.zeros(size), 1.0, 35.0, 0.0)
    if not count.all():
        nothing.bias = -1.0 if count[0] else 1.0
        return nothing
    share = (total[:, :size] + 1) / (total[:, :size] + 1).sum(axis=1, keepdims=True)
    scale = np.log(share[1] / share[0])
    picked = []
    for label in (0, 1):
        few = rows.where(F.col("label") == label).where(sampled(F.lit(min(1.0, per_class / count[label])), "doc_id", "text")).select("text", "label")
        got = few.mapInArrow(_bits(dim), "label int, bits binary").collect()
        picked += sorted(got, key=lambda r: zlib.crc32(r.bits))
    x, y = [], np.array([r.label for r in picked])
    for r in picked:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8)))
        v = scale[at]
        x.append((at, v / np.sqrt(max(v @ v, 1e-12))))
    fold = np.arange(len(x)) % 5
    learn, rest = np.flatnonzero(fold), np.flatnonzero(fold == 0)
    if len(set(y[learn])) < 2 or len(set(y[rest])) < 2:  # too few rows to set some aside
        learn = rest = np.arange(len(x))
    w = hinge([x[i] for i in learn], np.where(y[learn] == 1, 1, -1), size, cost=1.0)
    margin = np.array([w[x[i][0]] @ x[i][1] + w[size] for i in rest])
    part = np.array([count[k] / max((y[rest] == k).sum(), 1) for k in (0, 1)])
    a, b = platt(margin, y[rest], part[y[rest]] / part[y[rest]].mean())
    return QualityModel(dim, w[:size] * scale, scale * scale, float(w[size]), a, b)


def score_column(model: QualityModel, text_col: str = "text") -> Column:
    """The score (0 to 1) of each whole text, as a column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(text_bytes(texts)))

    return score(F.col(text_col).cast("string"))
