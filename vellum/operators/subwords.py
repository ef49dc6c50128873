"""Trainable token vectors (E1) without a vocabulary: words and their character n-grams hash into a table of
``buckets`` vectors, a text is the mean of its buckets' vectors, and the table is trained jointly with the
projection head (E2) on a contrastive loss.

The table is a Parquet table keyed by bucket; a bucket that was never trained has a vector made from its
number by rule, so only trained rows are stored. Training goes in rounds (see ``rounds``): texts are dealt by
content into batches and shards; a shard fetches the rows of its buckets by a join, takes one step per batch
inside its task, and emits the changes of its buckets. The changes are summed by bucket with map-side
aggregation (a frequent bucket has one row per shard) and averaged over the shards that hold it; the dense
head is averaged as in ``rounds``. No vocabulary is counted, collected or capped, and no text is cut.

For scoring the whole table travels as one model-sized value: ``buckets * dim`` numbers, a bound that the
parameters set and the corpus does not change (more than ``TABLE_BYTES`` is refused).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.contrastive import (
    LOSSES,
    PAIR_LOSSES,
    ProjectionModel,
    _parts,
    adamw_step,
    embedding_gradient,
    init_projection,
    lr_at,
    projection_forward,
)
from vellum.operators.rounds import GROUPS, list_bounds, opened, values_of, write_shards
from vellum.session import require_columns, scratch_path
from vellum.sources import fs as FS

WORD = re.compile(r"\w+")
SIZES = (3, 4, 5)  # characters of the n-grams, word ends marked
MEMO, MEMO_WORD = 100_000, 64  # words a task remembers, and their letters at most
TEXTS = 256  # texts that a task holds as bucket lists
WORDS = 1 << 14  # words whose buckets are counted together
TABLE_BYTES = 512 << 20
HEAD = -1  # the "bucket" of the dense head's row


def word_buckets(word: str, buckets: int) -> np.ndarray:
    """The word's own bucket, then those of its n-grams."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i: i + n] for n in SIZES for i in range(len(marked) - n + 1) if n < len(marked)]
    return np.array([zlib.crc32(g.encode()) % buckets for g in grams], np.int32)


class TextBuckets:
    """Buckets of whole texts with their counts; a bounded memo of words."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.memo: dict[str, np.ndarray] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        _, at, n = self.many([text])
        return at, n

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(bounds, buckets, counts)`` of several texts: those of text ``i`` lie from ``bounds[i]`` to
        ``bounds[i + 1]``. Texts are counted together until they have ``WORDS`` words."""
        parts, found, lengths = [], [], []
        for text in texts:
            before = len(found)
            for word in WORD.findall((text or "").lower()):
                got = self.memo.get(word)
                if got is None:
                    got = word_buckets(word, self.buckets)
                    if len(word) <= MEMO_WORD:
                        if len(self.memo) >= MEMO:
                            self.memo.clear()
                        self.memo[word] = got
                found.append(got)
            lengths.append(len(found) - before)
            if len(found) >= WORDS:
                parts.append(self._counted(found, lengths))
                found, lengths = [], []
        if lengths:
            parts.append(self._counted(found, lengths))
        sizes, at, n = (np.concatenate(c) if parts else np.array([], np.int64) for c in (zip(*parts) if parts else ((), (), ())))
        return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), at, n

    def _counted(self, found: list[np.ndarray], lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct buckets per text, those buckets in ascending order, and their counts."""
        if not found:
            return np.zeros(len(lengths), np.int64), np.array([], np.int64), np.array([], np.int64)
        grams = np.fromiter(map(len, found), np.int64, len(found))
        key = np.repeat(np.repeat(np.arange(len(lengths)) * self.buckets, lengths), grams)
        key += np.concatenate(found)
        key, n = np.unique(key, return_counts=True)
        owner, at = np.divmod(key, self.buckets)
        return np.bincount(owner, minlength=len(lengths)), at, n


def rule_vectors(numbers: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """The untrained vectors: uniform in +- 1/dim, from the bucket's number alone."""
    with np.errstate(over="ignore"):
        x = (numbers.astype(np.uint64)[:, None] * np.uint64(dim) + np.arange(dim, dtype=np.uint64)[None, :]
             + np.uint64(seed & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15))
        for _ in range(2):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return (x / 2.0**63 - 1.0) / dim


def text_means(counts: list[tuple[np.ndarray, np.ndarray]], vectors: np.ndarray) -> np.ndarray:
    """Mean bucket vector of each text (zero without buckets); buckets are row numbers of ``vectors``."""
    out = np.zeros((len(counts), vectors.shape[1]))
    for i, (at, n) in enumerate(counts):
        if len(at):
            out[i] = n @ vectors[at] / n.sum()
    return out


def column_means(col: pa.Array, split: TextBuckets, vectors: np.ndarray) -> np.ndarray:
    """``text_means`` of a column, ``TEXTS`` texts at a time."""
    out = np.zeros((len(col), vectors.shape[1]))
    for at in range(0, len(col), TEXTS):
        bounds, found, n = split.many(col.slice(at, TEXTS).to_pylist())
        out[at: at + TEXTS] = text_means([(found[i:j], n[i:j]) for i, j in zip(bounds[:-1], bounds[1:])], vectors)
    return out


@dataclass
class SubwordTable:
    """The token vectors as a fitted featurizer: trained buckets at ``path``, the others by rule."""

    path: str | None
    buckets: int
    dim: int
    seed: int
    info: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.buckets * self.dim * 4 > TABLE_BYTES:
            raise ValueError(f"a table of {self.buckets} x {self.dim} numbers exceeds {TABLE_BYTES} bytes")

    def matrix(self, spark: SparkSession) -> np.ndarray:
        """The whole table, ``buckets x dim`` (a bound of the parameters)."""
        out = rule_vectors(np.arange(self.buckets), self.dim, self.seed).astype(np.float32)
        if self.path:
            got = spark.read.parquet(self.path).select("bucket", "vec").toArrow()
            if got.num_rows:
                flat = np.asarray(got.column("vec").combine_chunks().flatten(), np.float64)
                out[np.asarray(got.column("bucket"))] = flat.reshape(-1, self.dim)
        return out

    def transform(self, df: DataFrame, text: str, out: str = "features") -> DataFrame:
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(self.matrix(spark))
        split = TextBuckets(self.buckets)  # a task's own copy, whose memo serves all its batches

        # one array in, one out, like the projection's: Spark runs both in one Python worker
        @F.arrow_udf("array<double>")
        def vectors(col: pa.Array) -> pa.Array:
            made = column_means(col, split, shared.value)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))

        return df.withColumn(out, vectors(F.col(text)))

    def save(self, spark: SparkSession, path: str) -> None:
        if self.path and self.path != f"{path}/table":
            spark.read.parquet(self.path).write.mode("overwrite").parquet(f"{path}/table")
        FS.write_text(spark, f"{path}/subwords.json", json.dumps(
            {"buckets": self.buckets, "dim": self.dim, "seed": self.seed, "trained": bool(self.path), "info": self.info}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SubwordTable | None":
        meta = FS.read_text(spark, f"{path}/subwords.json")
        if meta is None:
            return None
        m = json.loads(meta)
        return cls(f"{path}/table" if m["trained"] else None, m["buckets"], m["dim"], m["seed"], m["info"])


class JointEncoderFit:
    """Token table and projection trained together. ``table_lr`` is the step of the row-wise Adagrad that
    the table uses; the head uses AdamW as in ``ContrastiveProjection``."""

    def __init__(self, buckets: int = 1 << 16, dim: int = 32, embedding_dim: int = 16, epochs: int = 3, batch_size: int = 16,
                 lr: float = 1e-2, table_lr: float = 0.05, loss: str = "batch_hard_soft_margin", margin: float = 0.5,
                 weight_decay: float = 0.02, betas: tuple = (0.9, 0.999), eps: float = 1e-8, max_grad_norm: float = 0.5,
                 warmup_ratio: float = 0.1, seed: int = 42, shard_batches: int = 64):
        if loss not in LOSSES + PAIR_LOSSES:
            raise ValueError(f"loss must be one of {LOSSES + PAIR_LOSSES}")
        self.__dict__.update({k: v for k, v in locals().items() if k != "self"})

    def fit(self, df: DataFrame, text: str, label: str, initial: tuple[SubwordTable, ProjectionModel] | None = None,
            out_path: str | None = None) -> tuple[SubwordTable, ProjectionModel]:
        """The fitted table (at ``out_path`` or a scratch path) and head. ``initial`` continues both."""
        require_columns(df, text, label, what="training texts")
        spark = df.sparkSession
        rows = df.select(F.col(text).cast("string").alias("x"), F.col(label).cast("long").alias("y"))
        n = rows.count()
        if not n:
            raise ValueError("empty training table")
        n_batches = max(1, -(-n // self.batch_size))
        n_shards = -(-n_batches // self.shard_batches)
        steps = -(-n_batches // n_shards)
        shards, path = write_shards(rows, n_batches, self.shard_batches, self.seed)
        work = scratch_path(spark, "subwords")
        _with_buckets(shards, self.buckets).write.options(**GROUPS).parquet(f"{work}/shards")
        FS.delete(spark, path)
        shards = spark.read.parquet(f"{work}/shards")
        _needed(shards).write.parquet(f"{work}/need")
        table, head = initial or (SubwordTable(None, self.buckets, self.dim, self.seed),
                                  init_projection(self.dim, self.embedding_dim, self.seed))
        if (table.buckets, table.dim) != (self.buckets, self.dim):
            raise ValueError("the initial table has another size")
        if table.path:
            spark.read.parquet(table.path).write.parquet(f"{work}/table-0")
        else:
            spark.createDataFrame([], "bucket long, vec array<double>, acc double").write.parquet(f"{work}/table-0")
        shape = head.W.shape
        flat = np.concatenate([head.W.ravel(), head.b, np.zeros(2 * (head.W.size + head.b.size))])
        cfg = {k: getattr(self, k) for k in ("lr", "table_lr", "loss", "margin", "weight_decay", "betas", "eps",
                                             "max_grad_norm", "dim", "seed")}
        cfg |= {"shape": shape, "n_batches": n_batches, "n_shards": n_shards, "steps": steps,
                "total": self.epochs * steps, "warmup": int(self.warmup_ratio * steps)}
        history = list(head.history)
        for epoch in range(self.epochs):
            flat, loss, count = self._round(spark, work, epoch, flat, cfg)
            history.append({"epoch": epoch + 1, "loss": loss, "n": count})
        parts = _parts(flat, shape)
        final = out_path or scratch_path(spark, "token-table")
        spark.read.parquet(f"{work}/table-{self.epochs}").write.mode("overwrite").parquet(final)
        FS.delete(spark, work)
        return (SubwordTable(final, self.buckets, self.dim, self.seed),
                ProjectionModel(parts[0].copy(), parts[1].copy(), history))

    def _round(self, spark: SparkSession, work: str, epoch: int, flat: np.ndarray, cfg: dict):
        """One epoch: fetch by join, local steps, changes summed by bucket, a new generation of the table."""
        shared = spark.sparkContext.broadcast(flat)
        table = spark.read.parquet(f"{work}/table-{epoch}")
        need = spark.read.parquet(f"{work}/need")
        fetched = need.join(table, "bucket", "left").select("shard", "bucket", "vec", "acc")
        shards = spark.read.parquet(f"{work}/shards")
        local = _local_shard(shared, cfg, epoch)
        made = (shards.groupBy("shard").cogroup(fetched.groupBy("shard"))
                .applyInArrow(local, "bucket long, v array<double>"))
        (made.groupBy("bucket").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
         .select("bucket", _as_array("v").alias("v")).write.parquet(f"{work}/changes-{epoch}"))
        changes = spark.read.parquet(f"{work}/changes-{epoch}")
        head = np.array(changes.filter(F.col("bucket") == HEAD).first()["v"])
        size = len(flat)
        weight, loss, count = head[size], head[size + 1], head[size + 2]
        d = cfg["dim"]
        # a change row: weighted vector, weighted accumulator, weight
        moved = changes.filter(F.col("bucket") >= 0).select(
            "bucket", F.transform(F.slice("v", 1, d), lambda x: x / F.col("v")[d + 1]).alias("vec"),
            (F.col("v")[d] / F.col("v")[d + 1]).alias("acc"))
        (moved.unionByName(table.join(moved.select("bucket"), "bucket", "left_anti"))
         .write.parquet(f"{work}/table-{epoch + 1}"))
        shared.unpersist()
        return (head[:size] / weight if weight > 0 else flat), (loss / count if count else 0.0), int(count)


def _as_array(col: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(col))


SHARD = ("shard long, batches array<struct<number:bigint,rows:array<struct<y:bigint,at:array<bigint>,n:array<bigint>>>>>")


def _with_buckets(shards: DataFrame, buckets: int) -> DataFrame:
    """Shards with every text replaced by its buckets and their counts; the lists of one shard are kept as
    arrays, those of the other shards of an Arrow batch are not held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = TextBuckets(buckets)
        for batch in batches:
            for shard, numbers, bounds, rows in opened(batch):
                texts, at, n, sizes = rows.field("x"), [], [], [np.zeros(1, np.int64)]
                for k in range(0, len(texts), TEXTS):
                    limits, found, times = split.many(texts.slice(k, TEXTS).to_pylist())
                    at.append(found)
                    n.append(times)
                    sizes.append(np.diff(limits))
                inner = np.cumsum(np.concatenate(sizes))
                made = pa.StructArray.from_arrays([rows.field("y"), _lists(inner, at), _lists(inner, n)],
                                                  fields=list(schema.field("batches").type.value_type.field("rows").type.value_type))
                of_batch = pa.StructArray.from_arrays([pa.array(numbers, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), made)], fields=list(schema.field("batches").type.value_type))
                whole = pa.ListArray.from_arrays(pa.array([0, len(of_batch)], pa.int32()), of_batch)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), whole], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(SHARD))
    return shards.select(F.col("shard").cast("long").alias("shard"), "batches").mapInArrow(run, SHARD)


def _lists(bounds: np.ndarray, parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.array([], np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))


def _needed(shards: DataFrame) -> DataFrame:
    """Distinct ``(shard, bucket)``."""
    rows = shards.select("shard", F.explode("batches").alias("b")).select("shard", F.explode("b.rows").alias("r"))
    return rows.select("shard", F.explode("r.at").alias("bucket")).distinct()


def _local_shard(shared, cfg: dict, epoch: int):
    """The cogroup function of a shard and its fetched rows: one step per batch, then the bucket changes
    and the head, each with its weight."""
    dim, seed = cfg["dim"], cfg["seed"]
    out = pa.schema([("bucket", pa.int64()), ("v", pa.list_(pa.float64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out.empty_table()
        shard, batches, bounds, members = next(opened(left.combine_chunks().to_batches()[0]))
        at_bounds, at_all = list_bounds(members.field("at")), members.field("at").flatten().to_numpy(zero_copy_only=False)
        n_all, y_all = members.field("n").flatten().to_numpy(zero_copy_only=False), values_of(members.field("y"))
        held = {int(b): range(i, j) for b, i, j in zip(batches, bounds[:-1], bounds[1:])}
        numbers = right.column("bucket").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(numbers)
        numbers = numbers[order]
        table, acc = rule_vectors(numbers, dim, seed), np.zeros(len(numbers))
        vec = right.column("vec").combine_chunks()
        known = vec.is_valid().to_numpy(zero_copy_only=False)
        if known.any():
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            table[place[known]] = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            acc[place[known]] = right.column("acc").combine_chunks().drop_null().to_numpy(zero_copy_only=False)
        state = shared.value.copy()
        W, b, mW, mb, vW, vb = _parts(state, cfg["shape"])
        mine = range(shard, cfg["n_batches"], cfg["n_shards"])
        name = (seed + 1, epoch) + ((shard,) if cfg["n_shards"] > 1 else ())
        loss_sum, count, seen, done = 0.0, 0, 0, epoch * cfg["steps"]
        for k, at in enumerate(np.random.default_rng(name).permutation(len(mine))):
            rows = held.get(mine[int(at)], [])
            if not rows:
                continue
            lists = [slice(at_bounds[i], at_bounds[i + 1]) for i in rows]
            parts = [(np.searchsorted(numbers, at_all[i]), n_all[i].astype(np.float64)) for i in lists]
            X, y = text_means(parts, table), np.array(y_all[rows.start: rows.stop].tolist())
            z, nz, e = projection_forward(X, W, b)
            loss, n, Ge = embedding_gradient(e, y, cfg["loss"], cfg["margin"])
            seen += len(rows)
            if not n:
                continue
            loss_sum, count = loss_sum + loss, count + n
            Gz = np.where(nz > 0, (Ge - e * (e * Ge).sum(1, keepdims=True)) / np.maximum(nz, 1e-12), 0.0)
            Gu = Gz * (1.0 - z * z) / n
            Gx = Gu @ W
            touched, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            grad = np.zeros((len(touched), dim))
            for i, (of_text, (_, times)) in enumerate(zip(np.split(back, np.cumsum([len(p) for p, _ in parts])[:-1]), parts)):
                grad[of_text] += (times / times.sum())[:, None] * Gx[i] if len(times) else 0.0  # a text has a bucket once
            acc[touched] += (grad * grad).mean(1)
            table[touched] -= cfg["table_lr"] * grad / (np.sqrt(acc[touched]) + 1e-8)[:, None]
            adamw_step(((W, Gu.T @ X, mW, vW), (b, Gu.sum(0), mb, vb)), done + k + 1,
                       lr_at(done + k, cfg["total"], cfg["warmup"], cfg["lr"]), cfg["betas"], cfg["eps"],
                       cfg["weight_decay"], cfg["max_grad_norm"])
        weight = float(max(seen, 1))
        rows_out = np.concatenate([table * weight, acc[:, None] * weight, np.full((len(numbers), 1), weight)], axis=1)
        head = np.concatenate([state * weight, [weight, loss_sum, float(count)]])
        flat = np.concatenate([rows_out.ravel(), head])
        sizes = np.r_[np.full(len(numbers), dim + 2), len(head)]
        off = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.Table.from_arrays([pa.array(np.r_[numbers, HEAD]), pa.ListArray.from_arrays(off, pa.array(flat))], schema=out)

    return run
