"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. At each level runs of one symbol become one symbol;
deterministic coin tossing (the lowest bit in which a symbol differs from its left neighbour, and
that bit's value) shrinks the alphabet until six labels are left; phrases start at the labels' local
maxima, at most a dozen symbols apart, and a phrase's name is a hash of its symbols. Where a phrase
starts depends on a few neighbours only, so equal substrings have equal names inside whatever their
offsets. A fingerprint keeps the ``KEEP`` smallest hashes of the names of the ``LEVELS`` (a name's
occurrences are numbered, so repetition counts); two fingerprints' likeness is the share of common names among the smallest of both together.

``neighbours`` also fingerprints each text with its second half replaced by the start of the next
document, by ascending id (after the last one: the first). Rows are sorted once by range; each
task passes its rows in order with one row of look-ahead, and the one row per task whose successor
lies in the next task is resolved from a small written table. No text meets others in one task.

Defined cases: null text is empty and has an empty fingerprint; two empty fingerprints have likeness
1, an empty one and another 0; null ids come first and ties follow the text's hash; one single row is
its own successor; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.llm.common import TEXT, as_bytes, blocks, mix64
from vellum.session import scratch_path

LEVELS = (2, 3, 4)  # names kept; a level-3 phrase is about twenty bytes long
KEEP = 48  # names of 32 bits each
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)


def _coin_table() -> np.ndarray:
    """Labels of (label, left label) for the later rounds, by 128 * left + label."""
    right, left = np.meshgrid(np.arange(128, dtype=np.uint8), np.arange(128, dtype=np.uint8))
    differ = (right ^ left).astype(np.uint8)
    low = np.bitwise_count((differ & (~differ + np.uint8(1))) - np.uint8(1))
    return (2 * low + ((right >> low) & 1)).astype(np.uint8).reshape(-1)


_COIN = _coin_table()


def parse_level(name: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names of all sequences, and the first phrase of each (one more than sequences)."""
    n = len(name)
    if not n:
        return name, first
    head = np.zeros(n, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    new = head.copy()
    new[1:] |= name[1:] != name[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.concatenate([at, [n]])).astype(np.uint64)
    sym, head = name[at], head[at]
    sym = np.where(length > 1, mix64(sym + length * _STEP), sym)
    left = np.empty_like(sym)
    left[1:] = sym[:-1]
    left[head] = ~sym[head]  # the first symbol of a sequence differs from "nothing" in its lowest bit
    differ = sym ^ left
    low = np.bitwise_count((differ & (~differ + U(1))) - U(1))
    label = (2 * low + ((sym >> low.astype(np.uint64)) & U(1)).astype(np.uint8)).astype(np.uint8) & 127
    for _ in range(3):
        prev = np.empty_like(label)
        prev[1:] = label[:-1]
        prev[head] = label[head] ^ 1
        label = _COIN[prev.astype(np.int64) * 128 + label]
    top = np.zeros(len(sym), bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    after = np.zeros(len(sym), bool)
    after[:-1] = head[1:]  # the last symbol of a sequence starts no phrase
    start = np.flatnonzero(head | (top & ~after))
    offset = np.arange(len(sym)) - np.repeat(start, np.diff(np.concatenate([start, [len(sym)]])))
    made = mix64(np.add.reduceat(mix64(sym + (offset + 1).astype(np.uint64) * _STEP), start))
    return made, np.concatenate([np.searchsorted(at[start], first[:-1]), [len(start)]])


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """The kept names (sorted 32-bit hashes) of each text."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    name = mix64((data.astype(np.uint64) + U(1)) * _STEP)
    kept, owner = [], []
    for level in range(1, max(LEVELS) + 1):
        name, first = parse_level(name, first)
        if level in LEVELS:
            kept.append(mix64(name ^ U(level)) >> U(32))
            owner.append(np.repeat(np.arange(n), np.diff(first)))
    value, doc = np.concatenate(kept), np.concatenate(owner)
    # the k-th occurrence of a name is an element of its own, so that repetition counts
    key = np.sort((doc.astype(np.uint64) << U(32)) | value)
    run = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    nth = np.arange(len(key)) - np.repeat(run, np.diff(np.concatenate([run, [len(key)]])))
    key = np.sort((key >> U(32) << U(32)) | (mix64((key & U(0xFFFFFFFF)) * _STEP + nth.astype(np.uint64)) >> U(32))
                  if len(key) else key)
    doc = (key >> U(32)).astype(np.int64)
    begin = np.searchsorted(doc, np.arange(n + 1))
    return [(key[b: min(e, b + KEEP)] & U(0xFFFFFFFF)).astype(np.uint32) for b, e in zip(begin[:-1], begin[1:])]


def packed(names: np.ndarray) -> bytes:
    return names.astype(">u4").tobytes()


def as_string(names: np.ndarray) -> str:
    """The form in the result."""
    return packed(names).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the ``KEEP`` smallest of both (Jaccard estimate, 0 to 1)."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    both = np.union1d(a, b)[:KEEP]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True)).sum() / len(both))


def edited(text: bytes, after: bytes) -> tuple[int, bytes]:
    """Code points of ``text``, and the text with its last half replaced by the start of ``after``."""
    chars = text.decode("utf-8")
    half = len(chars) // 2
    return len(chars), (chars[: len(chars) - half] + after.decode("utf-8")[:half]).encode("utf-8")


OUT = [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
       T.StructField("edited_sha256", T.BinaryType()), T.StructField("fingerprint", T.BinaryType()),
       T.StructField("edited_fingerprint", T.BinaryType()), T.StructField("near_edited", T.DoubleType()),
       T.StructField("near_next", T.DoubleType())]


def _described(ids: list, texts: list[bytes], nexts: list[bytes]) -> list[tuple]:
    """Output rows of texts with their successors."""
    made = [edited(t, a) for t, a in zip(texts, nexts)]
    prints = fingerprints(texts + [e for _, e in made] + nexts[-1:])
    own, changed, last = prints[: len(texts)], prints[len(texts): 2 * len(texts)], prints[2 * len(texts):]
    follow = own[1:] + last  # the successor of each but the last is the next of the block
    return [(i, n, hashlib.sha256(e).digest(), packed(a), packed(b), likeness(a, b), likeness(a, c))
            for i, (n, e), a, b, c in zip(ids, made, own, changed, follow)]


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark, work = docs.sparkSession, scratch_path(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias(TEXT))
    tie = F.xxhash64(TEXT)
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    # edge 0: a finished row; 1: the first text of a task; 2: the last row of a task, not finished
    schema = T.StructType([T.StructField("edge", T.IntegerType()), T.StructField("part", T.IntegerType()), *OUT,
                           T.StructField("text", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None
        blank = (None,) * (len(OUT) - 1)

        def out(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

        for batch in batches:
            for block in blocks(batch, TEXT, 1 << 20):
                ids, texts = block.column("doc_id").to_pylist(), as_bytes(block.column(TEXT))
                if held is None:
                    yield out([(1, part, None, *blank, texts[0])])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids[-1], texts[-1]
                if len(ids) > 1:
                    yield out([(0, part, *r, None) for r in _described(ids[:-1], texts[:-1], texts[1:])])
        if held is not None:
            yield out([(2, part, held[0], *blank, held[1])])

    ordered.mapInArrow(run, schema).write.partitionBy("edge").parquet(f"{work}/rows")
    schema = "part int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OUT) + ", text binary, edge int"
    written = spark.read.schema(schema).parquet(f"{work}/rows")
    # one row per task of the pass above: each part's successor, the first part after the last
    parts = written.where("edge = 1").select("part")
    ring = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"))
    least = parts.agg(F.min("part")).first()[0]
    ring = ring.select("part", F.coalesce("after", F.lit(least)).alias("after"))
    heads = written.where("edge = 1").select(F.col("part").alias("after"), F.col("text").alias("next_text"))
    open_ = written.where("edge = 2").select("part", "doc_id", "text").join(ring, "part").join(heads, "after")
    final = to_arrow_schema(T.StructType(OUT))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = _described([batch.column("doc_id")[i].as_py()], [batch.column("text")[i].as_py()],
                                  [batch.column("next_text")[i].as_py()])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), final)], schema=final)

    last = open_.select("doc_id", "text", "next_text").mapInArrow(finish, T.StructType(OUT))
    # digests and names are written as bytes, half the size of their hexadecimal form
    return written.where("edge = 0").select(*[f.name for f in OUT]).union(last).select(
        *[F.lower(F.hex(f.name)).alias(f.name) if f.dataType == T.BinaryType() else F.col(f.name) for f in OUT])
