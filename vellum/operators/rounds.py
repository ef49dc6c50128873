"""Training in rounds: many optimizer steps in one Spark job.

Rows are dealt into batches by content and batches into shards of a bounded number of batches, one row per
shard in a Parquet table of the shared folder. A round is one job: every shard starts from the same state
(weights and optimizer moments), runs its own steps inside its task, and the states are averaged, weighted
by the shards' rows, by Spark's partial aggregation; the driver receives one model-sized vector per round.
With one shard a round is the sequential schedule; with more the work of a task stays the same and the
number of jobs does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import scratch_path

COPIES = 1024  # identical rows that one task numbers
FILES = 2  # files of packed shards per core
# Spark's reader holds up to 4,096 rows of a row group at once, and a shard is a large row: groups end after 8 MB,
# checked at every row.
GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
PACKED = "shard long, numbers array<long>, bounds array<long>, x binary, y array<long>"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_i``, each row's number among the rows equal to it. Equal rows are counted first
    (map-side) and numbered again in chunks, so no task makes all copies of a hot one."""
    cols = rows.columns
    same = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    chunks = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))).alias("_c"))
    return chunks.repartition(*cols, "_c").select(*cols, F.explode(
        F.expr(f"sequence(_c * {COPIES}, least(_n, (_c + 1) * {COPIES}) - 1)")).alias("_i"))


def write_shards(rows: DataFrame, n_batches: int, shard_batches: int, seed: int) -> tuple[DataFrame, str]:
    """Rows ``(x array<double>, y long, ...)`` as ``(shard, batches)`` and the path of that table: at most
    ``shard_batches`` batches per shard (dealt by number), each ``(number, rows ordered by content)``. A
    batch to which no row was hashed is missing."""
    spark = rows.sparkSession
    names = rows.columns
    dealt = numbered(rows).withColumn("_batch", F.pmod(F.xxhash64(F.lit(seed), *names, "_i"), F.lit(n_batches)))
    members = F.array_sort(F.collect_list(F.struct(*names, "_i")))
    made = dealt.groupBy("_batch").agg(members.alias("rows"))
    shards = -(-n_batches // shard_batches)
    made = (made.groupBy(F.pmod("_batch", F.lit(shards)).alias("shard"))
            .agg(F.array_sort(F.collect_list(F.struct("_batch", "rows"))).alias("b"))
            .select("shard", F.transform("b", lambda b: F.struct(b["_batch"].alias("number"), b["rows"].alias("rows")))
                    .alias("batches")))
    path = scratch_path(spark, "shards")
    made.write.options(**GROUPS).parquet(path)
    return spark.read.parquet(path), path


@dataclass
class Shard:
    """One shard as arrays: the rows of the batch ``numbers[i]`` are ``bounds[i]`` to ``bounds[i + 1]``."""

    shard: int
    numbers: np.ndarray
    bounds: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def batches(self) -> dict[int, slice]:
        """Rows of each batch by its number."""
        return {int(n): slice(a, b) for n, a, b in zip(self.numbers, self.bounds[:-1], self.bounds[1:])}


def list_bounds(col: pa.ListArray) -> np.ndarray:
    """Where the items of each list lie in ``col.flatten()``."""
    return np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def values_of(col: pa.Array) -> np.ndarray:
    return np.array(col.to_pylist()) if col.null_count else col.to_numpy(zero_copy_only=False)


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.StructArray]]:
    """``(shard, numbers, bounds, rows)`` of each row of a shard table, without Python objects per value."""
    for i in range(batch.num_rows):
        made = batch.column("batches").slice(i, 1).flatten()
        rows = made.field("rows")
        yield batch.column("shard")[i].as_py(), made.field("number").to_numpy(zero_copy_only=False), list_bounds(rows), rows.flatten()


def shard_arrays(batch: pa.RecordBatch) -> Iterator[Shard]:
    """The shards of a table whose rows are ``(x array<double>, y long, ...)``."""
    for shard, numbers, bounds, rows in opened(batch):
        x = rows.field("x")
        flat = x.flatten().to_numpy(zero_copy_only=False)
        if x.null_count or len(flat) % max(len(x), 1) or len(set(np.diff(list_bounds(x)).tolist())) > 1:
            raise ValueError("vectors of one table must have one length")
        yield Shard(shard, numbers, bounds, np.array(flat, np.float64).reshape(len(x), -1), values_of(rows.field("y")))


def pack_shards(shards: DataFrame) -> tuple[DataFrame, str]:
    """The shards with their vectors as bytes, and the path of that table: a round reads each shard as it is,
    without a pass over its values. A round's work is in its steps, not its bytes, so shards are dealt evenly to
    ``FILES`` files per core."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in shard_arrays(batch):
                row = {"shard": s.shard, "numbers": s.numbers, "bounds": s.bounds, "x": s.x.tobytes(), "y": s.y.tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("numbers", pa.list_(pa.int64())), ("bounds", pa.list_(pa.int64())),
                        ("x", pa.binary()), ("y", pa.list_(pa.int64()))])
    spark = shards.sparkSession
    path = scratch_path(spark, "packed-shards")
    packed = shards.select(F.col("shard").cast("long").alias("shard"), "batches").mapInArrow(run, PACKED)
    packed.repartition(FILES * spark.sparkContext.defaultParallelism).write.options(**GROUPS).parquet(path)
    return spark.read.parquet(path), path


def packed_shards(batch: pa.RecordBatch) -> Iterator[Shard]:
    for i in range(batch.num_rows):
        numbers, bounds, y = (batch.column(c).slice(i, 1).flatten() for c in ("numbers", "bounds", "y"))
        x = np.frombuffer(memoryview(batch.column("x")[i].as_buffer()), np.float64)
        yield Shard(batch.column("shard")[i].as_py(), values_of(numbers), values_of(bounds),
                    x.reshape(len(y), -1), values_of(y))


def one_round(shards: DataFrame, state: np.ndarray, local: Callable[[np.ndarray, Shard], tuple]) -> tuple:
    """(averaged state, summed extras): ``local(state, shard) -> (state, weight, extras)`` runs in the
    tasks on a copy of ``state``; a shard of weight 0 does not count in the average. ``shards`` is a table of
    ``pack_shards``; a task sums its own shards and gives one vector."""
    shared = shards.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for shard in packed_shards(batch):
                after, weight, extras = local(shared.value.copy(), shard)
                made = np.concatenate([after * weight, [weight], extras])
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(total)], pa.array(total))], names=["v"])

    total = (shards.mapInArrow(run, "v array<double>")
             .agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"].toArray())
    shared.unpersist()
    n, weight = len(state), total[len(state)]
    return (total[:n] / weight if weight > 0 else state), total[n + 1:]
