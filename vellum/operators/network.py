"""The multi-layer perceptron (M4): two relu layers, a logistic output, mini-batch Adam with an L2 term,
and early stopping by the accuracy on a set-aside part of the training rows.

An epoch is one round of ``rounds``: every shard of at most ``SHARD_BATCHES`` mini-batches runs its steps
in one task, weights and moments are averaged. The same job first scores the incoming weights on the set-aside
rows (each shard holds its share), so patience costs no extra job; the epoch that reveals the stop is dropped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.boosting import _matrix
from vellum.operators.rounds import Shard, one_round, pack_shards, write_shards
from vellum.session import require_columns
from vellum.sources import fs as FS

SHARD_BATCHES = 64


def layer_shapes(d: int, hidden: list[int]) -> list[tuple[int, int]]:
    sizes = [d, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def unflatten(theta: np.ndarray, shapes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views (weights, bias) of each layer in one flat vector."""
    out, at = [], 0
    for i, o in shapes:
        out.append((theta[at: at + i * o].reshape(i, o), theta[at + i * o: at + i * o + o]))
        at += i * o + o
    return out


def init_theta(shapes: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Uniform in +- sqrt(6 / (inputs + outputs)) for weights and biases, seeded."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, i * o + o) * math.sqrt(6.0 / (i + o)) for i, o in shapes])


def forward(x: np.ndarray, theta: np.ndarray, shapes: list) -> list[np.ndarray]:
    """Activations of every layer; the last one is the logit."""
    return _activations(x, unflatten(theta, shapes))


def _activations(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    acts = [x]
    for k, (w, b) in enumerate(layers):
        z = acts[-1] @ w
        z += b
        acts.append(np.maximum(z, 0.0, out=z) if k + 1 < len(layers) else z)
    return acts


def loss_and_gradient(x: np.ndarray, y: np.ndarray, theta: np.ndarray, shapes: list,
                      alpha: float) -> tuple[float, np.ndarray]:
    """Mean log loss plus ``alpha / 2n`` times the squared weights (not biases), and its gradient."""
    grad = np.empty_like(theta)
    return _backward(x, y, unflatten(theta, shapes), unflatten(grad, shapes), alpha), grad


def _backward(x: np.ndarray, y: np.ndarray, layers: list, grads: list, alpha: float) -> float:
    """``loss_and_gradient`` on the views of ``unflatten``; writes every value of ``grads``."""
    n = len(x)
    acts = _activations(x, layers)
    logit = acts[-1][:, 0]
    loss = float(np.mean(np.logaddexp(0.0, logit) - y * logit))
    delta = ((1.0 / (1.0 + np.exp(-logit)) - y) / n)[:, None]
    for k in range(len(layers) - 1, -1, -1):
        w, (gw, gb) = layers[k][0], grads[k]
        square = w * w
        loss += 0.5 * alpha / n * float(square.sum())
        np.matmul(acts[k].T, delta, out=gw)
        gw += np.multiply(w, alpha / n, out=square)
        delta.sum(0, out=gb)
        if k:
            live = acts[k] > 0
            delta = delta @ w.T
            delta *= live
    return loss


class Adam:
    """Adam steps in place on ``theta`` and its moments, without a new array per operation."""

    def __init__(self, theta: np.ndarray, m: np.ndarray, v: np.ndarray, rate: float, betas: tuple, eps: float):
        self.theta, self.m, self.v, self.rate, self.betas, self.eps = theta, m, v, rate, betas, eps
        self.a, self.b = np.empty_like(theta), np.empty_like(theta)

    def step(self, g: np.ndarray, t: int) -> None:
        (b1, b2), m, v, a, b = self.betas, self.m, self.v, self.a, self.b
        m *= b1
        m += np.multiply(g, 1 - b1, out=a)
        v *= b2
        np.multiply(g, 1 - b2, out=a)
        a *= g
        v += a
        np.multiply(m, self.rate * (math.sqrt(1 - b2 ** t) / (1 - b1 ** t)), out=a)
        np.sqrt(v, out=b)
        b += self.eps
        a /= b
        self.theta -= a


@dataclass
class Network:
    theta: np.ndarray
    dims: int
    hidden: list[int]
    info: dict = field(default_factory=dict)

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return layer_shapes(self.dims, self.hidden)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-forward(x, self.theta, self.shapes)[-1][:, 0]))

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``probability`` (vector of both classes) and ``prediction``."""
        model = df.sparkSession.sparkContext.broadcast(self)  # model-sized
        src = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)

        @F.arrow_udf("double")
        def score(col: pa.Array) -> pa.Array:
            return pa.array(model.value.probabilities(_matrix(col, model.value.dims)))

        p = df.withColumn("_p", score(src.cast("array<double>")))
        return (p.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p"))

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.theta.tolist(), self.dims, list(self.hidden))]
        spark.createDataFrame(row, "theta array<double>, dims int, hidden array<int>").coalesce(1) \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Network":
        r = spark.read.parquet(path).first()
        return cls(np.array(r["theta"]), int(r["dims"]), list(r["hidden"]))


class PerceptronClassifier:
    """``tol`` and ``n_iter_no_change`` as in the configuration: training stops when the accuracy on the
    set-aside rows stayed below the best plus ``tol`` for more than that many epochs in a row, and the
    best epoch's weights are returned. Without ``early_stopping`` the training loss takes that part."""

    def __init__(self, hidden: list[int] | None = None, alpha: float = 0.01, batch_size: int = 256,
                 learning_rate: float = 1e-3, max_iter: int = 200, early_stopping: bool = True,
                 validation_fraction: float = 0.1, n_iter_no_change: int = 20, tol: float = 1e-4,
                 betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8, seed: int = 42,
                 shard_batches: int = SHARD_BATCHES):
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})
        self.hidden = list(hidden or [64, 32])

    def fit(self, df: DataFrame, features: str = "features", label: str = "label",
            initial: Network | None = None) -> Network:
        require_columns(df, features, label, what="training table")
        src = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)
        rows = df.select(src.cast("array<double>").alias("x"), F.col(label).cast("long").alias("y"))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
        n, d = int(size["n"]), int(size["d"] or 0)
        if not n:
            raise ValueError("empty training table")
        n_batches = max(1, -(-n // int(self.batch_size)))
        if rows.filter("y NOT IN (0, 1) OR y IS NULL").limit(1).count():
            raise ValueError(f"'{label}' must be 0 or 1")
        shards, path = write_shards(rows, n_batches, int(self.shard_batches), int(self.seed))
        packed, packed_path = pack_shards(shards)
        FS.delete(df.sparkSession, path)
        try:
            return self._train(packed, n_batches <= int(self.shard_batches), d, initial)
        finally:
            FS.delete(df.sparkSession, packed_path)

    def _train(self, shards: DataFrame, single: bool, d: int, initial: Network | None) -> Network:
        shapes = layer_shapes(d, self.hidden)
        theta = init_theta(shapes, int(self.seed)) if initial is None else initial.theta.copy()
        size = len(theta)
        state = np.concatenate([theta, np.zeros(2 * size)])
        cfg = {k: getattr(self, k) for k in ("alpha", "batch_size", "learning_rate", "early_stopping",
                                             "validation_fraction", "betas", "eps", "seed")}
        best, best_theta, waited, history = -math.inf, theta, 0, []
        steps, loss = 0, math.nan
        for epoch in range(int(self.max_iter) + 1):
            after, (right, aside, total, seen, stepped) = one_round(shards, state, _epoch(cfg, shapes, epoch, steps, single))
            if epoch:  # this job scored the weights of the epoch before
                score = right / aside if self.early_stopping and aside else -loss
                history.append({"epoch": epoch, "score": score, "loss": loss})
                waited = waited + 1 if score < best + self.tol else 0
                if score > best:
                    best, best_theta = score, state[:size].copy()
                if waited > int(self.n_iter_no_change):
                    break
            loss = total / seen if seen else math.nan
            state = after
            steps += int(round(stepped / seen)) if seen else 0
        return Network(best_theta, d, self.hidden, {"epochs": len(history), "best_score": best, "history": history})


def _epoch(cfg: dict, shapes: list, epoch: int, done: int, single: bool):
    """One shard's work of one epoch: score the set-aside rows, then Adam over its mini-batches. ``done``
    counts the steps before this epoch for the moments' bias correction."""
    size = sum(i * o + o for i, o in shapes)

    def local(state: np.ndarray, shard: Shard) -> tuple[np.ndarray, float, np.ndarray]:
        x, y = shard.x, shard.y.astype(np.float64)
        aside = np.zeros(len(y), bool)
        if cfg["early_stopping"]:  # the same share of each class, the same rows in every epoch
            draw = np.random.default_rng((cfg["seed"], shard.shard))
            for c in (0, 1):
                at = draw.permutation(np.flatnonzero(y == c))
                aside[at[: int(round(cfg["validation_fraction"] * len(at)))]] = True
        theta, m, v = state[:size], state[size: 2 * size], state[2 * size:]
        right = 0.0
        if aside.any():
            right = float(((forward(x[aside], theta, shapes)[-1][:, 0] > 0) == (y[aside] == 1)).sum())
        x, y = x[~aside], y[~aside]
        order = np.random.default_rng((cfg["seed"], epoch) + (() if single else (shard.shard,))).permutation(len(y))
        step, total = int(cfg["batch_size"]), 0.0
        t = done
        grad = np.empty_like(theta)
        layers, grads = unflatten(theta, shapes), unflatten(grad, shapes)
        adam = Adam(theta, m, v, cfg["learning_rate"], cfg["betas"], cfg["eps"])
        for at in range(0, len(y), step):
            pick = order[at: at + step]
            loss = _backward(x[pick], y[pick], layers, grads, cfg["alpha"])
            t += 1
            total += loss * len(pick)
            adam.step(grad, t)
        return state, float(len(y)), np.array([right, float(aside.sum()), total, float(len(y)), float(t - done) * len(y)])

    return local
