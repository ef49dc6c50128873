"""Packing documents into fixed-length sequences (first-fit decreasing on a tournament tree).

Every document becomes ``ids + [end_id]`` and is cut at multiples of the sequence length: full
pieces are sequences of their own, the shorter last pieces are packed. Documents are dealt into
randomised groups of about ``group_docs`` (a keyed hash of the id and the text), and each group is
packed by itself: pieces in decreasing length go to the first open sequence with room, found by
walking down a tournament tree that keeps the largest free room of each subtree, so a placement
costs the logarithm of the number of sequences. Only piece sizes and checksums are shuffled, never
ids. Groups are bounded in size whatever the data, so no group depends on a hot source.

Defined cases: a null text counts as empty and gives one piece holding only the end id; repeated
rows and repeated ids are packed as separate documents; a null doc_id stays null; an empty table
gives no rows; other columns are ignored. A sequence is padded to the sequence length, but one
whose length is a power of two stays as it is (``padded_length``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import map_texts, tokenizer_bytes
from vellum.llm.word_ids import WordEncoder

SEQUENCE = 2048
END_ID = 1
GROUP_DOCS = 8192
BINS_BITS = 24  # sequences of one group: below 2**24

PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                      T.StructField("ids_crc32", T.LongType())])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` appended to each document; the joined ids and the bounds of each document."""
    ends = np.cumsum(counts)
    out = np.insert(ids, ends, np.uint32(end_id)) if len(counts) else ids
    bounds = np.concatenate([[0], ends + np.arange(1, len(counts) + 1)])
    return out.astype("<u4"), bounds


def document_pieces(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE,
                    end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens, text_hash and the array of pieces (start, length, ids_crc32)."""
    data = tokenizer_bytes(docs.sparkSession, tokenizer_path, "word_bpe_49k.json")

    def make():
        encoder = WordEncoder(data.value)

        def run(texts: list[bytes]):
            ids, bounds = with_end(*encoder.encode(texts), end_id)
            pieces = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                cuts = range(0, int(b - a), sequence)
                pieces.append([{"start": s, "length": min(sequence, int(b - a) - s),
                                "ids_crc32": zlib.crc32(ids[a + s: min(a + s + sequence, b)])} for s in cuts])
            return np.diff(bounds), [zlib.crc32(t) for t in texts], pieces
        return run

    return map_texts(docs, make, [T.StructField("doc_tokens", T.LongType()), T.StructField("text_hash", T.LongType()),
                                  T.StructField("pieces", T.ArrayType(PIECE))])


class RoomTree:
    """Tournament tree over the free room of sequences; ``first_fit`` finds the leftmost that fits."""

    def __init__(self, leaves: int, room: int) -> None:
        self.size = 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.best = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        at, best = 1, self.best
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        return at - self.size

    def take(self, leaf: int, used: int) -> None:
        at, best = leaf + self.size, self.best
        best[at] -= used
        at //= 2
        while at:
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top
            at //= 2


def first_fit_decreasing(lengths: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece (every length is 1..sequence); bins are numbered from 0."""
    order = np.argsort(-lengths, kind="stable")
    tree = RoomTree(len(lengths), sequence)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in order.tolist():
        need = int(lengths[i])
        leaf = tree.first_fit(need)
        bins[i], offsets[i] = leaf, sequence - tree.best[leaf + tree.size]
        tree.take(leaf, need)
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID,
         group_docs: int = GROUP_DOCS, seed: int = 17) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, padded_length."""
    n_groups = max(1, -(-docs.count() // group_docs))
    pieces = document_pieces(docs, tokenizer_path, sequence, end_id)
    # a random salt inside a hash group is not needed: the group takes id and text, and rows that
    # repeat both are spread by the row's own position in its task
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash", F.monotonically_increasing_id()), F.lit(n_groups))
    rows = (pieces.withColumn("group", group)
            .select("group", "doc_id", "doc_tokens", F.inline("pieces")))
    schema = T.StructType([rows.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "padded_length")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_tokens", "ids_crc32", "start"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = first_fit_decreasing(lengths, sequence)
        used = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        power = (used & (used - 1)) == 0
        return pdf.assign(sequence_id=(pdf["group"].to_numpy(np.int64) << BINS_BITS) | bins, offset=offsets,
                          sequence_length=used, padded_length=np.where(power, used, sequence)
                          ).drop(columns="group")[schema.names]

    def run_arrow(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        return pa.Table.from_pandas(run(table.to_pandas(integer_object_nulls=True)),
                                    schema=to_arrow_schema(schema), preserve_index=False)

    return rows.groupBy("group").applyInArrow(run_arrow, schema)
