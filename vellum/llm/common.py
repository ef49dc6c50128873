"""Helpers shared by the operators: table reads, Arrow row blocks, ragged arrays, tokenizer files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_BYTES = 1 << 20  # texts handled by one numpy pass inside a task
TEXT = "__text"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batch: pa.RecordBatch, column: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose ``column`` holds about ``max_bytes`` (a longer text stands alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > max_bytes:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(size)
    if batch.num_rows > at:
        yield batch.slice(at)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], Sequence]],
              fields: list[T.StructField], keep: Sequence[str] = ("doc_id",), text: str = "text",
              max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns plus ``fields`` computed from the whole texts, without a shuffle.

    ``make()`` runs once per task and returns a function from a block of texts (bytes, null as
    empty) to one sequence per field. Other columns of ``docs`` are not read."""
    src = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias(TEXT))
    schema = T.StructType([src.schema[k] for k in keep] + list(fields))
    kept = list(keep)
    types = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in blocks(batch, TEXT, max_bytes):
                made = fn(as_bytes(part.column(TEXT)))
                arrays = [part.column(k) for k in kept]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return src.mapInArrow(run, schema)


def spans_to_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every position of the runs ``[start, start + length)``, run after run."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    shift = np.repeat(starts.astype(np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer on uint64 arrays (xor-shift and odd multiplications)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class RaggedStore:
    """Growable list of integer lists with a vectorised gather."""

    def __init__(self, dtype=np.uint32) -> None:
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat = np.empty(1 << 12, self.dtype)
        self.start = np.empty(1 << 10, np.int64)
        self.length = np.empty(1 << 10, np.int64)
        self.used = 0
        self.count = 0

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.empty(max(need, 2 * len(a)), a.dtype)
        out[: len(a)] = a
        return out

    def extend(self, lists: list) -> None:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lengths.sum())
        self.flat = self._room(self.flat, self.used + total)
        self.start = self._room(self.start, self.count + len(lists))
        self.length = self._room(self.length, self.count + len(lists))
        self.flat[self.used: self.used + total] = np.fromiter((v for x in lists for v in x), self.dtype, total)
        self.start[self.count: self.count + len(lists)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.count: self.count + len(lists)] = lengths
        self.used += total
        self.count += len(lists)

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at ``index`` joined, and the length of each."""
        lengths = self.length[index]
        return self.flat[spans_to_positions(self.start[index], lengths)], lengths


def tokenizer_bytes(spark: SparkSession, path: str | None, default: str):
    """The tokenizer file (read on the driver, a fixed file of a few MB) as a broadcast value, so
    executors need no copy of it. ``path`` None takes ``default`` of the installed public files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(default)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
