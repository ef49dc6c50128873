"""Quality scores by similarity-weighted nearest-neighbour voting in a latent-semantic space.

Terms are byte trigrams of a text's shape (lower letters, capitals and digits as classes, other signs
as they are) hashed into ``BUCKETS``, and a few terms that count repeated words. Term weights are
square roots of shares; the latent space is the leading eigenvectors of the weighted term Gram
matrix of the labelled sample (plain linear algebra on a bounded matrix). The labelled unit vectors
are broadcast (``SAMPLE`` x ``DIMS`` floats, a fixed bound); every document's vector is multiplied
with all of them in blocks, exactly, and the ``NEIGHBOURS`` most similar vote with the power
``SHARPNESS`` of their cosine, each class weighted so that the sample's classes count alike.

Only the fit is bounded: it takes at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id. Every document is scored, whole, in one pass without a shuffle.

Defined cases: null and empty texts have no terms and take the sample's share of label 1; without
labelled rows every score is 0.5; several labels of one id count as their minimum; null labels are
not used; repeated rows are scored alike; an empty table gives no rows; other columns are ignored
(``score_documents`` keeps those asked for).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.chunks import hash_runs, join_texts, runs
from vellum.llm.common import map_texts

BUCKETS = 1024
EXTRA = 8  # repetition terms
DIMS = 48
SAMPLE = 4000
NEIGHBOURS = 15
SHARPNESS = 4.0
SCORE = "__quality_score"

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def term_weights(texts: list[bytes]) -> np.ndarray:
    """One row of ``BUCKETS + EXTRA`` term weights per text (zero for an empty text)."""
    data, bounds = join_texts(texts)
    n, sizes = len(texts), np.diff(bounds) - 1
    out = np.zeros((n, BUCKETS + EXTRA), np.float32)
    if not n:
        return out
    shape = _CLASS[data]
    gram = (shape[:-2] * 65536 + shape[1:-1] * 256 + shape[2:]).astype(np.uint64)
    bucket = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64) % BUCKETS
    doc = np.repeat(np.arange(n), sizes + 1)[: len(bucket)]
    inside = np.arange(len(bucket)) + 2 < bounds[doc + 1] - 1  # a text's own trigrams: none reaches the separator
    counts = np.bincount(doc[inside] * BUCKETS + bucket[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    # shares of words equal to the word one, two or three places before, and of distinct words
    starts, ends = runs(_WORD[data])
    (key,) = hash_runs(data, starts, ends, lanes=1)
    owner = np.searchsorted(bounds, starts, side="right") - 1
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    for k in (1, 2, 3):
        same = (key[k:] == key[:-k]) & (owner[k:] == owner[:-k])
        out[:, BUCKETS + k - 1] = np.sqrt(np.bincount(owner[k:][same], minlength=n) / words)
    both = np.unique(np.stack([owner.astype(np.uint64), key], axis=1), axis=0)[:, 0].astype(np.int64)
    out[:, BUCKETS + 3] = np.sqrt(np.bincount(both, minlength=n) / words) * (sizes > 0)
    long = ends - starts
    out[:, BUCKETS + 4] = np.sqrt(np.bincount(owner, weights=long > 12, minlength=n) / words)
    out[:, BUCKETS + 5] = np.sqrt(np.bincount(owner, weights=long < 3, minlength=n) / words)
    return out


class NeighbourVote:
    """The fitted space and the labelled vectors; ``score`` votes for blocks of term rows."""

    def __init__(self, weights: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> None:
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        share = max(min(self.prior, 0.99), 0.01)
        self.class_weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        # inverse document frequency from the sample, then the leading directions of the term space
        df = (weights > 0).sum(axis=0)
        self.idf = np.log1p((1 + len(weights)) / (1 + df)).astype(np.float32)
        w = weights * self.idf
        _, vectors = np.linalg.eigh(w.T @ w)
        self.axes = np.ascontiguousarray(vectors[:, ::-1][:, :dims]).astype(np.float32)
        self.known = self._unit(w @ self.axes)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(norm > 0, norm, 1)).astype(np.float32)

    def score(self, weights: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 256) -> np.ndarray:
        out = np.full(len(weights), self.prior)
        if not len(self.known):
            return out
        k = min(neighbours, len(self.known))
        for s in range(0, len(weights), block):
            rows = weights[s: s + block]
            cosine = self._unit((rows * self.idf) @ self.axes) @ self.known.T
            top = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, top, axis=1), 0) ** SHARPNESS * self.class_weight[top]
            total = vote.sum(axis=1)
            some = (rows.sum(axis=1) > 0) & (total > 0)
            share = (vote * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
            out[s: s + block] = np.where(some, share, self.prior)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id's text leaves 1 modulo 3 are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dims: int = DIMS) -> NeighbourVote:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
             .select("doc_id", "quality").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` ids
    terms = map_texts(rows, lambda: lambda texts: [[w.tobytes() for w in term_weights(texts)]],
                      [T.StructField("weights", T.BinaryType())], keep=("doc_id", "quality"))
    # an id of the sample may stand on several rows; one of them is kept so that the bound holds
    found = (terms.groupBy("doc_id").agg(F.min(F.struct("weights", "quality")).alias("r"))
             .select("doc_id", "r.*").orderBy("doc_id").collect())
    weights = np.array([np.frombuffer(r["weights"], np.float32) for r in found], np.float32)
    return NeighbourVote(weights.reshape(len(found), BUCKETS + EXTRA),
                         np.array([r["quality"] for r in found], np.float32), dims)


def score_documents(docs: DataFrame, model: NeighbourVote, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) and ``__quality_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        vote = shared.value
        return lambda texts: [vote.score(term_weights(texts))]

    return map_texts(docs, make, [T.StructField(SCORE, T.DoubleType())], keep=keep or docs.columns)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_documents(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(SCORE).alias("score"),
                         (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Documents predicted as label 1, with their own columns."""
    model = fit(training if training is not None else docs, labels)
    return score_documents(docs, model).where(F.col(SCORE) >= 0.5).select(*[f"`{c}`" for c in docs.columns])
