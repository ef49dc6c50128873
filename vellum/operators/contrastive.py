"""Contrastive losses as table operators (E5-E9) and the distributed fit of a projection head
trained with them (E10-E13).

Batches are groups (``batch_id``) of bounded size. Pairwise distances of
one batch are computed inside one task with numpy (``applyInPandas``); no pair rows are emitted.
The fit keeps only the projection weights and the optimizer moments on the driver: each step
sums per-batch gradients on the executors (``Summarizer.sum``) and brings back one model-sized
vector.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.rounds import Shard, one_round, pack_shards, write_shards
from vellum.session import require_columns, scratch_path
from vellum.sources import fs as FS

LOSSES = ("batch_hard_soft_margin", "batch_all", "semi_hard")
PAIR_LOSSES = ("online_contrastive", "cosine_similarity")
PAIRS_PER_ROW = 2  # positives, and negatives, that a row of a batch is paired with
BLOCK_VALUES = 4_000_000  # doubles in one block of differences or triplets
FOLDERS = 64  # folders of the written batches
DEFAULT_MARGIN = 0.5
_EPS = 1e-12


# ============================================================================================
# per-batch math (numpy, inside tasks)

def pairwise_distances(e: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of ``e`` (B x d), in blocks of rows."""
    b, d = e.shape
    out = np.empty((b, b))
    for s in _slices(b, b * d):
        diff = e[s, None, :] - e[None, :, :]
        out[s] = np.sqrt((diff * diff).sum(-1))
    return out


def _slices(n: int, width: int):
    """Slices of ``range(n)`` whose items, of ``width`` values each, fill about one block."""
    step = max(1, BLOCK_VALUES // max(1, width))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _masks(y: np.ndarray):
    same = y[:, None] == y[None, :]
    eye = np.eye(len(y), dtype=bool)
    return same & ~eye, ~same


def loss_terms(D: np.ndarray, y: np.ndarray, loss: str, margin: float = DEFAULT_MARGIN,
               want_grad: bool = False):
    """(loss_sum, count, dD): the summed loss of one batch, the count it is averaged over, and
    d(loss_sum)/dD when ``want_grad``. Anchors without a positive or a negative are skipped."""
    pos, neg = _masks(y)
    dD = np.zeros_like(D) if want_grad else None
    if loss == "batch_hard_soft_margin":
        ok = pos.any(1) & neg.any(1)
        idx = np.nonzero(ok)[0]
        if len(idx) == 0:
            return 0.0, 0, dD
        hp_j = np.where(pos[idx], D[idx], -np.inf).argmax(1)
        hn_k = np.where(neg[idx], D[idx], np.inf).argmin(1)
        x = D[idx, hp_j] - D[idx, hn_k]
        total = float(np.logaddexp(0.0, x).sum())
        if want_grad:
            s = 1.0 / (1.0 + np.exp(-x))
            np.add.at(dD, (idx, hp_j), s)
            np.add.at(dD, (idx, hn_k), -s)
        return total, int(len(idx)), dD
    if loss == "batch_all":
        total, n = 0.0, 0
        for s in _slices(len(D), len(D) ** 2):  # anchors in blocks: memory stays at B x B
            t = D[s, :, None] - D[s, None, :] + margin
            active = pos[s, :, None] & neg[s, None, :] & (t > 1e-16)
            total += float(t[active].sum())
            n += int(active.sum())
            if want_grad:
                dD[s] += active.sum(2)
                dD[s] -= active.sum(1)
        return total, n, dD
    if loss == "semi_hard":
        has_neg = neg.any(1)
        a_idx, p_idx = np.nonzero(pos & has_neg[:, None])
        if len(a_idx) == 0:
            return 0.0, 0, dD
        dap = D[a_idx, p_idx]
        k = np.empty(len(a_idx), np.int64)
        for s in _slices(len(a_idx), len(D)):
            dan, nm = D[a_idx[s]], neg[a_idx[s]]  # rows: (a,p) pairs, cols: candidates
            outside = nm & (dan > dap[s, None])
            k_out = np.where(outside, dan, np.inf).argmin(1)
            k_in = np.where(nm, dan, -np.inf).argmax(1)
            k[s] = np.where(outside.any(1), k_out, k_in)
        l = dap - D[a_idx, k] + margin
        act = l > 0
        total = float(l[act].sum())
        if want_grad:
            np.add.at(dD, (a_idx[act], p_idx[act]), 1.0)
            np.add.at(dD, (a_idx[act], k[act]), -1.0)
        return total, int(len(a_idx)), dD
    raise ValueError(f"loss must be one of {LOSSES}")


def projection_forward(X: np.ndarray, W: np.ndarray, b: np.ndarray):
    z = np.tanh(X @ W.T + b)
    nz = np.linalg.norm(z, axis=1, keepdims=True)
    e = np.where(nz > 0, z / np.maximum(nz, _EPS), 0.0)
    return z, nz, e


def sample_pairs(y: np.ndarray, per_row: int = PAIRS_PER_ROW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, same label) of the pairs of one batch: each row with the next ``per_row`` rows of
    its label and the next ``per_row`` of other labels, in circular order, no pair twice. At most
    ``2 per_row`` pairs per row, so a label or key that fills a batch does not square it."""
    n = len(y)
    ahead = (np.arange(n)[None, :] - np.arange(n)[:, None]) % max(1, n)
    pos, neg = _masks(y)
    pairs = set()
    for mask in (pos, neg):
        order = np.argsort(np.where(mask, ahead, n), axis=1, kind="stable")[:, :per_row]
        for i, k in zip(*np.nonzero(np.take_along_axis(mask, order, 1))):
            j = int(order[i, k])
            pairs.add((min(int(i), j), max(int(i), j)))
    first, second = (np.array(c, np.int64) for c in (zip(*sorted(pairs)) if pairs else ((), ())))
    return first, second, y[first] == y[second]


def pair_terms(cos: np.ndarray, same: np.ndarray, loss: str, margin: float = DEFAULT_MARGIN):
    """(loss_sum, count, d loss_sum / d cos) of one batch's pairs, as E8 and E9 define the losses."""
    if not len(cos):
        return 0.0, 0, cos
    if loss == "cosine_similarity":
        r = cos - same
        return float((r * r).sum()), len(cos), 2 * r
    d, grad = 1 - cos, np.zeros(len(cos))
    pos, neg = d[same], d[~same]
    far = same & (d > (neg.min() if len(neg) > 1 else pos.mean())) if len(pos) else same
    near = ~same & (d < (pos.max() if len(pos) > 1 else neg.mean())) if len(neg) else ~same
    short = np.maximum(margin - d, 0.0)
    grad[far] = -2 * d[far]
    grad[near] = 2 * short[near]
    return float((d[far] ** 2).sum() + (short[near] ** 2).sum()), 1, grad


def embedding_gradient(e: np.ndarray, y: np.ndarray, loss: str, margin: float = DEFAULT_MARGIN):
    """(loss_sum, count, d loss_sum / d e) of one batch of unit vectors, for every loss."""
    if loss in PAIR_LOSSES:
        i, j, same = sample_pairs(y)
        total, n, dcos = pair_terms((e[i] * e[j]).sum(1), same, loss, margin)
        Ge = np.zeros_like(e)
        np.add.at(Ge, i, dcos[:, None] * e[j])  # both branches share the weights
        np.add.at(Ge, j, dcos[:, None] * e[i])
        return total, n, Ge
    D = pairwise_distances(e)
    total, n, dD = loss_terms(D, y, loss, margin, want_grad=True)
    if n == 0:
        return 0.0, 0, np.zeros_like(e)
    M = np.where(D > _EPS, dD / np.maximum(D, _EPS), 0.0)
    S = M + M.T
    return total, n, S.sum(1)[:, None] * e - S @ e


def batch_gradient(X: np.ndarray, y: np.ndarray, W: np.ndarray, b: np.ndarray, loss: str,
                   margin: float = DEFAULT_MARGIN):
    """Summed loss, count and gradients (dW, db) of one batch through tanh -> L2-normalize ->
    Euclidean distances -> loss."""
    z, nz, e = projection_forward(X, W, b)
    total, n, Ge = embedding_gradient(e, y, loss, margin)
    if n == 0:
        return 0.0, 0, np.zeros_like(W), np.zeros_like(b)
    Gz = np.where(nz > 0, (Ge - e * (e * Ge).sum(1, keepdims=True)) / np.maximum(nz, _EPS), 0.0)
    Gu = Gz * (1.0 - z * z)
    return total, n, Gu.T @ X, Gu.sum(0)


# ============================================================================================
# losses as table operators

def _stack(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values]) if len(col) else np.zeros((0, 0))


def batch_loss(df: DataFrame, loss: str = "batch_hard_soft_margin", embedding: str = "embedding",
               label: str = "label", batch: str = "batch_id", margin: float = DEFAULT_MARGIN,
               per_batch: bool = False) -> DataFrame:
    """E5 (batch-hard soft-margin), E6 (batch-all) or E7 (semi-hard) over the given vectors.

    Returns one row ``(loss, n)`` (the mean and the count it averages over), or one row per batch
    with ``per_batch=True`` (``loss_sum, n``). A batch is defined by its pairwise distances, so one
    task holds its B x B matrix; give ``batch`` a column of bounded batches (``assign_batches``)."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    require_columns(df, embedding, label, batch)

    def per(pdf: pd.DataFrame) -> pd.DataFrame:
        X = _stack(pdf[embedding])
        y = pdf[label].to_numpy()
        total, n, _ = loss_terms(pairwise_distances(X), y, loss, margin)
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "loss_sum": [total], "n": [n]})

    rows = (df.select(batch, embedding, label)
            .groupBy(batch).applyInPandas(per, schema=f"{batch} long, loss_sum double, n long"))
    if per_batch:
        return rows
    return rows.agg((F.sum("loss_sum") / F.sum("n")).alias("loss"), F.sum("n").alias("n"))


def l2_normalize(c) -> "F.Column":
    """``x / ||x||`` per array, JVM-side; the zero vector stays zero."""
    a = (F.col(c) if isinstance(c, str) else c).cast("array<double>")
    n = F.sqrt(_dot(a, a))
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a, b):
    """Cosine of two numeric arrays, JVM-side; 0 when either is the zero vector."""
    a = F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>")
    b = F.col(b).cast("array<double>") if isinstance(b, str) else b.cast("array<double>")
    den = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(den > 0, _dot(a, b) / den).otherwise(F.lit(0.0))


def online_contrastive_loss(pairs: DataFrame, a: str = "emb_a", b: str = "emb_b", label: str = "label",
                            batch: str = "batch_id", margin: float = DEFAULT_MARGIN,
                            per_batch: bool = False) -> DataFrame:
    """E8 on a pair table: cosine distance; per batch, positives farther than the nearest negative
    and negatives nearer than the farthest positive; loss = sum(pos^2) + sum(relu(margin - neg)^2)
    per batch, averaged over batches."""
    d = pairs.select(batch, F.col(label).cast("int").alias("_y"), (1 - cosine_similarity(a, b)).alias("_d"))
    # batch statistics by map-side partial aggregation, one row per batch joined back: no task holds
    # a batch, and AQE can split a batch with very many pairs
    pd_, nd_ = F.when(F.col("_y") == 1, F.col("_d")), F.when(F.col("_y") == 0, F.col("_d"))
    stats = d.groupBy(F.col(batch).alias("_batch")).agg(
        F.max(pd_).alias("_pmax"), F.avg(pd_).alias("_pavg"), F.count(pd_).alias("_np"),
        F.min(nd_).alias("_nmin"), F.avg(nd_).alias("_navg"), F.count(nd_).alias("_nn"))
    j = d.join(stats, F.col(batch).eqNullSafe(F.col("_batch"))).drop("_batch")
    neg_cut = F.when(F.col("_np") > 1, F.col("_pmax")).otherwise(F.col("_navg"))
    pos_cut = F.when(F.col("_nn") > 1, F.col("_nmin")).otherwise(F.col("_pavg"))
    term = (F.when((F.col("_y") == 1) & (F.col("_d") > pos_cut), F.col("_d") * F.col("_d"))
            .when((F.col("_y") == 0) & (F.col("_d") < neg_cut),
                  F.pow(F.greatest(F.lit(margin) - F.col("_d"), F.lit(0.0)), 2))
            .otherwise(F.lit(0.0)))
    per = j.groupBy(batch).agg(F.sum(term).alias("loss"))
    if per_batch:
        return per
    return per.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("n_batches"))


def cosine_similarity_loss(pairs: DataFrame, a: str = "emb_a", b: str = "emb_b",
                           label: str = "label") -> DataFrame:
    """Mean squared error between the cosine of each pair and its label (one row)."""
    err = cosine_similarity(a, b) - F.col(label).cast("double")
    return pairs.agg(F.avg(err * err).alias("loss"), F.count(F.lit(1)).alias("n"))


# ============================================================================================
# the projection model (E2 + E3) and its fit

@dataclass
class ProjectionModel:
    """e = normalize(tanh(W x + b)): the learned head. ``W`` is (out, in)."""

    W: np.ndarray
    b: np.ndarray
    history: list = field(default_factory=list)
    normalize: bool = True

    @property
    def dims(self) -> tuple[int, int]:
        return int(self.W.shape[1]), int(self.W.shape[0])

    def transform(self, df: DataFrame, features: str = "features", out: str = "embedding",
                  out_type: str = "float") -> DataFrame:
        """Arrow-batched matmul; W travels once per executor as a broadcast."""
        sc = df.sparkSession.sparkContext
        bw = sc.broadcast((self.W.astype(np.float64), self.b.astype(np.float64), self.normalize))
        np_type = np.float32 if out_type == "float" else np.float64

        @F.arrow_udf(f"array<{out_type}>")
        def _project(col: pa.Array) -> pa.Array:
            W, b, norm = bw.value
            z, nz, e = projection_forward(_rows_of(col, W.shape[1]), W, b)
            made = (e if norm else z).astype(np_type)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))

        src = F.col(features)
        if not _is_array(df, features):
            from pyspark.ml.functions import vector_to_array
            src = vector_to_array(src)
        return df.withColumn(out, _project(src.cast("array<double>")))

    # -- persistence: one parquet row, never pickle
    def save(self, spark, path: str) -> None:
        meta = json.dumps({"in": self.dims[0], "out": self.dims[1], "normalize": self.normalize,
                           "history": self.history})
        row = [(self.W.tolist(), self.b.tolist(), meta)]
        spark.createDataFrame(row, "W array<array<double>>, b array<double>, meta string") \
            .coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "ProjectionModel":
        r = spark.read.parquet(path).first()
        meta = json.loads(r["meta"])
        return cls(np.array(r["W"], dtype=np.float64), np.array(r["b"], dtype=np.float64),
                   meta.get("history", []), meta.get("normalize", True))


def _rows_of(col: pa.ListArray, dims: int) -> np.ndarray:
    """A column of vectors as one matrix; a null value is NaN, another length raises."""
    if col.null_count or (len(col) and pc.min_max(pc.list_value_length(col)).as_py() != {"min": dims, "max": dims}):
        raise ValueError(f"every feature vector must have {dims} values")
    return np.asarray(pc.fill_null(col.flatten(), math.nan), np.float64).reshape(-1, dims)


def _is_array(df: DataFrame, col: str) -> bool:
    from pyspark.sql.types import ArrayType
    return isinstance(df.schema[col].dataType, ArrayType)


def init_projection(d_in: int, d_out: int, seed: int | None) -> ProjectionModel:
    """Uniform(-1/sqrt(d_in), 1/sqrt(d_in)) weights and bias, seeded."""
    rng = np.random.default_rng(seed)
    bound = 1.0 / math.sqrt(d_in)
    return ProjectionModel(rng.uniform(-bound, bound, (d_out, d_in)), rng.uniform(-bound, bound, d_out))


@dataclass
class OptimizerState:
    step: int = 0
    mW: np.ndarray | None = None
    vW: np.ndarray | None = None
    mb: np.ndarray | None = None
    vb: np.ndarray | None = None


def lr_at(step: int, total: int, warmup: int, base: float) -> float:
    """Linear warm-up to ``base`` over ``warmup`` steps, then cosine decay to 0 at ``total``."""
    if warmup > 0 and step < warmup:
        return base * (step + 1) / warmup
    rest = max(1, total - warmup)
    return base * 0.5 * (1.0 + math.cos(math.pi * min(1.0, (step - warmup) / rest)))


def adamw_step(parts, t: int, lr: float, betas: tuple, eps: float, weight_decay: float, max_norm: float | None) -> None:
    """One AdamW step in place on ``(parameter, gradient, first, second moment)`` parts; the gradients'
    common norm is clipped to ``max_norm``."""
    b1, b2 = betas
    norm = math.sqrt(sum(float((g * g).sum()) for _, g, _, _ in parts))
    scale = max_norm / norm if max_norm and norm > max_norm else 1.0
    for p, g, m, v in parts:
        g = g * scale
        p *= 1.0 - lr * weight_decay
        m *= b1
        m += (1 - b1) * g
        v *= b2
        v += (1 - b2) * g * g
        p -= lr * (m / (1 - b1 ** t)) / (np.sqrt(v / (1 - b2 ** t)) + eps)


def _parts(flat: np.ndarray, shape: tuple[int, int]) -> list[np.ndarray]:
    """Views W, b, mW, mb, vW, vb of one flat state."""
    out, at = [], 0
    for _ in range(3):
        out += [flat[at: at + shape[0] * shape[1]].reshape(shape), flat[at + shape[0] * shape[1]:][: shape[0]]]
        at += shape[0] * shape[1] + shape[0]
    return out


def _local_epoch(cfg: dict, done: int):
    """One shard's epoch from the step ``done``: a step for each of its batches, in seeded order."""
    def local(state: np.ndarray, shard: Shard) -> tuple[np.ndarray, float, np.ndarray]:
        W, b, mW, mb, vW, vb = _parts(state, cfg["shape"])
        held = shard.batches()
        numbers = range(shard.shard, cfg["n_batches"], cfg["n_shards"])
        name = (cfg["seed"] + 1, done // cfg["steps"]) if cfg["seed"] is not None else None
        if name is not None and cfg["n_shards"] > 1:
            name = (*name, shard.shard)
        order = np.random.default_rng(name).permutation(len(numbers))
        loss_sum, count, seen = 0.0, 0, 0
        for k, at in enumerate(order):
            rows = held.get(numbers[int(at)])
            gW, gb = np.zeros_like(W), np.zeros_like(b)
            if rows is not None:
                X, y = shard.x[rows], np.array(shard.y[rows].tolist())
                loss, n, gW, gb = batch_gradient(X, y, W, b, cfg["loss"], cfg["margin"])
                loss_sum, count, seen = loss_sum + loss, count + n, seen + len(X)
                if n:
                    gW, gb = gW / n, gb / n
            adamw_step(((W, gW, mW, vW), (b, gb, mb, vb)), done + k + 1, lr_at(done + k, cfg["total"], cfg["warmup"], cfg["lr"]),
                       cfg["betas"], cfg["eps"], cfg["weight_decay"], cfg["max_grad_norm"])
        return state, float(seen), np.array([loss_sum, float(count)])

    return local


class ContrastiveProjection:
    """Fit ``e = normalize(tanh(W x + b))`` on fixed features with a contrastive loss.

    AdamW (betas, eps, weight decay), warm-up over ``warmup_ratio`` of the first epoch then
    cosine decay, gradient-norm clipping. Rows get a batch by a seeded hash of their content and of
    their number among identical rows, so batches do not depend on partitioning or retries and a
    batch holds ~``batch_size`` rows even when one key or vector holds many. A step takes one batch;
    with ``steps_per_epoch`` an epoch runs that many steps, each summing its share of the batches.

    With ``shard_batches`` an epoch is one job: batches are dealt into shards of at most that many, every
    shard takes a step per batch from the epoch's weights, and weights and moments are averaged (see
    ``rounds``). One shard is the schedule of one step per batch.

    The learning rate follows the optimizer step over ``schedule_epochs`` (default: the epochs done
    and to do), and the order of steps follows (seed, epoch): with one ``schedule_epochs``, a fit of
    one epoch resumed for another equals a fit of two.
    """

    def __init__(self, embedding_dim: int = 128, epochs: int = 3, batch_size: int = 16, lr: float = 2e-5,
                 weight_decay: float = 0.02, betas: tuple = (0.9, 0.999), eps: float = 1e-8,
                 warmup_ratio: float = 0.1, max_grad_norm: float = 0.5, loss: str = "batch_hard_soft_margin",
                 margin: float = DEFAULT_MARGIN, seed: int | None = None, steps_per_epoch: int | None = None,
                 features: str = "features", label: str = "label", key: str | None = None,
                 checkpoint_dir: str | None = None, checkpoint_every: int | None = None, keep_checkpoints: int = 3,
                 schedule_epochs: int | None = None, shard_batches: int | None = None):
        if loss not in LOSSES + PAIR_LOSSES:
            raise ValueError(f"loss must be one of {LOSSES + PAIR_LOSSES}")
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    # -- data: grouped into batches once, partitioned by step group so a step reads only its part
    def _prepare(self, df: DataFrame):
        """Write one row per batch ``(batch_id, xs, ys)`` under the shared checkpoint folder, in at
        most ``FOLDERS`` folders sorted by step group. The rows are shuffled only here; every step
        afterwards is a pruned scan, a map over batch rows and a model-sized sum."""
        require_columns(df, self.features, self.label)
        spark = df.sparkSession
        n = df.count()
        if n == 0:
            raise ValueError("empty training table")
        n_batches = max(1, -(-n // self.batch_size))
        steps = min(n_batches, self.steps_per_epoch or n_batches)
        seed = 0 if self.seed is None else int(self.seed)
        hkey = F.col(self.key) if self.key else F.lit(0)
        rows = df.select(F.xxhash64(F.lit(seed), hkey).alias("_h"),
                         F.col(self.features).cast("array<double>").alias("x"), F.col(self.label).cast("long").alias("y"))
        # identical rows are counted (map-side) and numbered again in chunks, so that copies of one
        # vector scatter over all batches and no task makes all of them
        same = rows.groupBy("_h", "x", "y").agg(F.count(F.lit(1)).alias("_n"))
        chunks = same.select("*", F.explode(F.sequence(F.lit(0), F.expr("(_n - 1) div 1024"))).alias("_c"))
        rows = chunks.repartition("_h", "x", "y", "_c").select("_h", "x", "y", F.explode(
            F.expr("sequence(_c * 1024, least(_n, (_c + 1) * 1024) - 1)")).alias("_i"))
        rows = rows.withColumn("batch_id", F.pmod(F.xxhash64(F.lit(seed), "_h", "x", "y", "_i"), F.lit(n_batches)))
        member = F.array_sort(F.collect_list(F.struct("_h", "x", "y", "_i")))  # a batch: ~batch_size rows
        group = F.pmod(F.col("batch_id"), F.lit(steps))
        batches = (rows.groupBy("batch_id").agg(member.alias("_m"))
                   .select("batch_id", F.transform("_m", lambda r: r["x"]).alias("xs"),
                           F.transform("_m", lambda r: r["y"]).alias("ys"),
                           group.alias("step_group"), F.pmod(group, F.lit(FOLDERS)).alias("folder"))
                   .repartitionByRange("folder", "step_group", "batch_id").sortWithinPartitions("folder", "step_group"))
        path = scratch_path(spark, "contrastive-batches")
        batches.write.mode("overwrite").partitionBy("folder").parquet(path)
        feats = spark.read.parquet(path)
        d_in = len(feats.select("xs").first()[0][0])
        return feats, n_batches, steps, d_in

    def _step_grads(self, feats: DataFrame, group: int, model: ProjectionModel):
        sc = feats.sparkSession.sparkContext
        bw = sc.broadcast((model.W, model.b))
        loss, margin = self.loss, self.margin
        d_out, d_in = model.W.shape

        def grads(batches):
            W, b = bw.value
            tot, cnt, acc = 0.0, 0, np.zeros(d_out * d_in + d_out)
            for pdf in batches:
                for xs, ys in zip(pdf["xs"], pdf["ys"]):
                    X = np.stack([np.asarray(v, dtype=np.float64) for v in xs])
                    t, k, gW, gb = batch_gradient(X, np.asarray(ys), W, b, loss, margin)
                    tot, cnt = tot + t, cnt + k
                    acc[: d_out * d_in] += gW.ravel()
                    acc[d_out * d_in:] += gb
            yield pd.DataFrame({"loss_sum": [tot], "n": [cnt], "g": [acc.tolist()]})

        rows = (feats.filter((F.col("folder") == group % FOLDERS) & (F.col("step_group") == group)).select("xs", "ys")
                .mapInPandas(grads, "loss_sum double, n long, g array<double>"))
        r = rows.agg(Summarizer.sum(array_to_vector("g")).alias("g"), F.sum("loss_sum").alias("l"),
                     F.sum("n").alias("n")).first()
        bw.unpersist()
        n = int(r["n"] or 0)
        if n == 0:
            return 0.0, 0, np.zeros_like(model.W), np.zeros_like(model.b)
        g = r["g"].toArray() / n
        return float(r["l"]) / n, n, g[: d_out * d_in].reshape(d_out, d_in), g[d_out * d_in:]

    def fit(self, df: DataFrame, initial: ProjectionModel | None = None,
            state: OptimizerState | None = None) -> ProjectionModel:
        """Train; ``initial`` continues from fitted weights (warm start, E11), ``state`` resumes
        the optimizer (E13)."""
        if self.shard_batches:
            return self._fit_rounds(df, initial, state)
        feats, n_batches, steps, d_in = self._prepare(df)
        model = initial or init_projection(d_in, self.embedding_dim, self.seed)
        model = ProjectionModel(model.W.copy(), model.b.copy(), list(model.history), model.normalize)
        if model.W.shape[1] != d_in:
            raise ValueError(f"initial model expects {model.W.shape[1]} inputs, features have {d_in}")
        st = state or OptimizerState()
        if st.mW is None:
            st.mW, st.vW = np.zeros_like(model.W), np.zeros_like(model.W)
            st.mb, st.vb = np.zeros_like(model.b), np.zeros_like(model.b)
        start, todo = st.step, self.epochs * steps
        total = self.schedule_epochs * steps if self.schedule_epochs else start + todo
        warmup = int(self.warmup_ratio * steps)
        every = self.checkpoint_every or max(1, steps // 10)
        order = None
        for s in range(start, start + todo):
            if order is None or s % steps == 0:
                rng = np.random.default_rng(None if self.seed is None else (self.seed + 1, s // steps))
                order = rng.permutation(steps)
            loss, n, gW, gb = self._step_grads(feats, int(order[s % steps]), model)
            lr = lr_at(s, total, warmup, self.lr)
            st.step += 1
            t = st.step
            adamw_step(((model.W, gW, st.mW, st.vW), (model.b, gb, st.mb, st.vb)), t, lr, self.betas, self.eps,
                       self.weight_decay, self.max_grad_norm)
            model.history.append({"step": t, "loss": loss, "n": n, "lr": lr})
            if self.checkpoint_dir and t % every == 0:
                save_checkpoint(df.sparkSession, self.checkpoint_dir, model, st, self.keep_checkpoints)
        return model

    def _fit_rounds(self, df: DataFrame, initial: ProjectionModel | None, state: OptimizerState | None) -> ProjectionModel:
        require_columns(df, self.features, self.label)
        spark = df.sparkSession
        seed = 0 if self.seed is None else int(self.seed)
        hkey = F.col(self.key) if self.key else F.lit(0)
        rows = df.select(F.xxhash64(F.lit(seed), hkey).alias("_h"),
                         F.col(self.features).cast("array<double>").alias("x"), F.col(self.label).cast("long").alias("y"))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
        if not size["n"]:
            raise ValueError("empty training table")
        n_batches = max(1, -(-size["n"] // self.batch_size))
        n_shards = -(-n_batches // int(self.shard_batches))
        steps = -(-n_batches // n_shards)  # of a shard and epoch
        model = initial or init_projection(int(size["d"]), self.embedding_dim, self.seed)
        if model.W.shape[1] != int(size["d"]):
            raise ValueError(f"initial model expects {model.W.shape[1]} inputs, features have {size['d']}")
        model = ProjectionModel(model.W.copy(), model.b.copy(), list(model.history), model.normalize)
        st = state or OptimizerState()
        if st.mW is None:
            st.mW, st.vW = np.zeros_like(model.W), np.zeros_like(model.W)
            st.mb, st.vb = np.zeros_like(model.b), np.zeros_like(model.b)
        total = (self.schedule_epochs or st.step // steps + self.epochs) * steps
        cfg = {k: getattr(self, k) for k in ("lr", "weight_decay", "betas", "eps", "max_grad_norm", "loss", "margin")}
        cfg |= {"seed": self.seed, "total": total, "warmup": int(self.warmup_ratio * steps), "shape": model.W.shape,
                "n_batches": n_batches, "n_shards": n_shards, "steps": steps}
        dealt, dealt_path = write_shards(rows, n_batches, int(self.shard_batches), seed)
        shards, path = pack_shards(dealt)
        FS.delete(spark, dealt_path)
        every = self.checkpoint_every or steps
        try:
            for _ in range(self.epochs):
                flat = np.concatenate([a.ravel() for a in (model.W, model.b, st.mW, st.mb, st.vW, st.vb)])
                flat, (loss, n) = one_round(shards, flat, _local_epoch(cfg, st.step))
                parts = _parts(flat, model.W.shape)
                model.W, model.b, st.mW, st.mb, st.vW, st.vb = (a.copy() for a in parts)
                before, st.step = st.step, st.step + steps
                model.history.append({"step": st.step, "loss": loss / n if n else 0.0, "n": int(n),
                                      "lr": lr_at(st.step - 1, total, cfg["warmup"], self.lr)})
                if self.checkpoint_dir and st.step // every > before // every:
                    save_checkpoint(spark, self.checkpoint_dir, model, st, self.keep_checkpoints)
        finally:
            FS.delete(spark, path)
        return model

    def fit_transform(self, df: DataFrame, out: str = "embedding") -> DataFrame:
        """E12."""
        return self.fit(df).transform(df, self.features, out)


# -- E13: checkpoints ---------------------------------------------------------------------------

def save_checkpoint(spark, folder: str, model: ProjectionModel, st: OptimizerState, keep: int = 3) -> str:
    """Write weights + optimizer moments as ``checkpoint-<step>``; keep the newest ``keep``."""
    path = f"{folder.rstrip('/')}/checkpoint-{st.step:08d}"
    model.save(spark, f"{path}/model")
    row = [(st.step, st.mW.tolist(), st.vW.tolist(), st.mb.tolist(), st.vb.tolist())]
    spark.createDataFrame(row, "step long, mW array<array<double>>, vW array<array<double>>, "
                               "mb array<double>, vb array<double>") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path}/optimizer")
    olds = [e.path for e in FS.list_children(spark, folder) if e.is_dir and e.name.startswith("checkpoint-")]
    for p in olds[:-keep] if keep > 0 else []:
        FS.delete(spark, p)
    return path


def load_checkpoint(spark, path: str) -> tuple[ProjectionModel, OptimizerState]:
    model = ProjectionModel.load(spark, f"{path.rstrip('/')}/model")
    r = spark.read.parquet(f"{path.rstrip('/')}/optimizer").first()
    st = OptimizerState(int(r["step"]), np.array(r["mW"]), np.array(r["vW"]), np.array(r["mb"]), np.array(r["vb"]))
    return model, st
