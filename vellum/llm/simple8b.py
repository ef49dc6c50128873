"""Token ids in word-aligned Simple-8b files, in ascending document order.

``encode`` packs unsigned integers into 64-bit words: a 4-bit selector says how many values of which
width the other 60 bits hold. Frames of 1,024 values are coded independently and their word offsets
are kept, so both directions work on all frames of a block at once (numpy, no per-value loop). A
value of more than 60 bits is an escape: selector 0, and the raw value in the next word.

``write_ids`` sorts the documents by id (a range shuffle; nulls first, ties by text), encodes the
texts, and writes one row per block of consecutive documents: part, block, ids before the block in
its part, the document ids, their lengths and the ids, both as Simple-8b streams with frame offsets.
``read_ids`` decodes those files. Files are written by Spark's committer into the shared folder, so
lost tasks are simply written again; the number of rows that meet in one place is the number of
parts, never of documents.

Defined cases: null text is empty (a document of the end id only); repeated rows and ids stay
separate documents; an empty table gives empty files; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.llm.common import TEXT, as_bytes, blocks, tokenizer_bytes
from vellum.llm.packing import END_ID, with_end
from vellum.llm.word_ids import WordEncoder
from vellum.session import scratch_path

FRAME = 1024  # values per independently coded frame
BLOCK_IDS = 1 << 18  # a block ends with the document that reaches this many ids

# Fixed values of the Simple-8b code: (values per word, bits per value) by selector; selector 0 is
# the escape here and selector 1 a run of zeros.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8),
             (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in SELECTORS], np.int64)
WIDTHS = np.array([w for _, w in SELECTORS], np.uint64)
LONGEST = 120


def _selectors(classes: np.ndarray) -> np.ndarray:
    """For each position of each frame (row), the selector of the word that starts there.

    ``classes`` holds for each value the first selector wide enough (1..15; 16 means escape), with
    ``LONGEST`` ones appended to each row. Windowed maxima come from power-of-two tables."""
    width = classes.shape[1] - LONGEST
    table, span = {1: classes}, 1
    while 2 * span <= LONGEST:
        prev = table[span]
        nxt = prev.copy()
        np.maximum(prev[:, : -span], prev[:, span:], out=nxt[:, : -span])
        span *= 2
        table[span] = nxt
    chosen = np.zeros((len(classes), width), np.uint8)  # escape unless something fits
    for s in range(15, 0, -1):  # from one value per word to many: the last that fits wins
        n = int(COUNTS[s])
        p = 1 << (n.bit_length() - 1)
        t = table[p]
        top = np.maximum(t[:, :width], t[:, n - p: n - p + width])
        chosen[top <= s] = s
    return chosen


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) and the word offset of each frame (uint32, one more than frames)."""
    n = len(values)
    frames = -(-n // FRAME)
    if not frames:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    grid = np.zeros((frames, FRAME + LONGEST), np.uint64)
    flat = np.zeros(frames * FRAME, np.uint64)
    flat[:n] = values
    grid[:, :FRAME] = flat.reshape(frames, FRAME)
    limits = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)  # first value too wide for 1..15
    classes = (np.searchsorted(limits, grid, side="right") + 1).astype(np.uint8)
    chosen = _selectors(classes)
    length = np.full(frames, FRAME, np.int64)
    length[-1] = n - (frames - 1) * FRAME
    at, live = np.zeros(frames, np.int64), np.arange(frames)
    rows, cols, sels = [], [], []
    while len(live):
        col = at[live]
        s = chosen[live, col]
        rows.append(live)
        cols.append(col)
        sels.append(s)
        at[live] = col + COUNTS[s]
        live = live[at[live] < length[live]]
    row, col, sel = np.concatenate(rows), np.concatenate(cols), np.concatenate(sels)
    order = np.argsort(row * np.int64(FRAME) + col)
    row, col, sel = row[order], col[order], sel[order]
    size = np.where(sel == 0, 2, 1)  # an escape takes two words
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in range(16):
        hit = np.flatnonzero(sel == s)
        if not len(hit) or s == 1:
            words[place[hit]] = np.uint64(s) << np.uint64(60)
        elif s == 0:
            words[place[hit] + 1] = grid[row[hit], col[hit]]
        else:
            word = np.full(len(hit), np.uint64(s) << np.uint64(60))
            for j in range(int(COUNTS[s])):
                word |= grid[row[hit], col[hit] + j] << np.uint64(j * int(WIDTHS[s]))
            words[place[hit]] = word
    per_frame = np.bincount(row, weights=size, minlength=frames).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_frame)]).astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values (uint64) of all frames of ``words``."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words) + 1, bool)
    for i in np.flatnonzero(sel == 0).tolist():  # only escapes come here
        if not raw[i]:
            raw[i + 1] = True
    keep = np.flatnonzero(~raw[:-1])
    sel = sel[keep]
    count = COUNTS[sel]
    frame = np.searchsorted(offsets[1:], keep, side="right")
    ends = np.cumsum(count)
    first = np.concatenate([[0], np.flatnonzero(np.diff(frame)) + 1])
    inside = ends - count - (ends - count)[first][frame]  # place within the frame
    out = np.zeros((len(offsets) - 1) * FRAME + LONGEST, np.uint64)
    limit = np.minimum((frame + 1) * FRAME, n)  # a last word may reach past its frame
    start = frame * FRAME + inside
    for s in range(16):
        hit = np.flatnonzero(sel == s)
        if not len(hit) or s == 1:
            continue
        if s == 0:
            out[start[hit]] = words[keep[hit] + 1]
            continue
        word, mask = words[keep[hit]], np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            ok = start[hit] + j < limit[hit]
            value = (word >> np.uint64(j * int(WIDTHS[s]))) & mask
            out[start[hit][ok] + j] = value[ok]
    return out[:n]


FILE_FIELDS = [T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()),
               T.StructField("ids_before", T.LongType()), T.StructField("n_ids", T.LongType()),
               T.StructField("doc_ids", T.ArrayType(T.LongType())),
               T.StructField("length_words", T.BinaryType()), T.StructField("length_offsets", T.BinaryType()),
               T.StructField("id_words", T.BinaryType()), T.StructField("id_offsets", T.BinaryType())]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID,
              block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every whole text, each document followed by ``end_id``, by ascending doc_id."""
    data = tokenizer_bytes(docs.sparkSession, tokenizer_path, "word_bpe_49k.json")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias(TEXT))
    tie = F.xxhash64(TEXT)
    ordered = src.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    schema = T.StructType(FILE_FIELDS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder(data.value), TaskContext.get().partitionId()
        block = before = 0
        names: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal block, before, names, held, lengths
            ids, sizes = np.concatenate(held), np.concatenate(lengths)
            lw, lo = encode(sizes.astype(np.uint64))
            iw, io = encode(ids.astype(np.uint64))
            row = {"part": part, "block": block, "ids_before": before, "n_ids": len(ids), "doc_ids": names,
                   "length_words": lw.tobytes(), "length_offsets": lo.tobytes(),
                   "id_words": iw.tobytes(), "id_offsets": io.tobytes()}
            block, before = block + 1, before + len(ids)
            names, held, lengths = [], [], []
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for rows in blocks(batch, TEXT, 1 << 20):
                ids, bounds = with_end(*encoder.encode(as_bytes(rows.column(TEXT))), end_id)
                names += rows.column("doc_id").to_pylist()
                held.append(ids)
                lengths.append(np.diff(bounds))
                if sum(map(len, held)) >= block_ids:
                    yield flush()
        if names:
            yield flush()

    ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (binary, little-endian uint32)."""
    return _read(spark, path, True)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_ids`` with ids_crc32 in place of the ids."""
    return _read(spark, path, False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    # one row per written part, so this window and the broadcast grow with the number of files only
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    src = files.join(F.broadcast(before), "part")
    last = T.StructField("ids", T.BinaryType()) if with_ids else T.StructField("ids_crc32", T.LongType())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), last])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = {k: batch.column(k)[i] for k in batch.schema.names}
                get = lambda k, kind: np.frombuffer(x[k].as_py(), kind)  # noqa: E731, B023
                names = x["doc_ids"].as_py()
                sizes = decode(get("length_words", np.uint64), get("length_offsets", np.uint32), len(names)).astype(np.int64)
                ids = decode(get("id_words", np.uint64), get("id_offsets", np.uint32), x["n_ids"].as_py()).astype("<u4")
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                first = x["part_start"].as_py() + x["ids_before"].as_py()
                each = [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array(bounds[:-1] + first), pa.array(sizes),
                    pa.array(each if with_ids else [zlib.crc32(e) for e in each], arrow.field(3).type)], schema=arrow)

    return src.mapInArrow(run, schema)


def token_files(docs: DataFrame, path: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """Write the files (to a fresh folder under the shared one unless ``path`` is given), read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "simple8b")
    write_ids(docs, path, tokenizer_path)
    return read_digests(spark, path)
