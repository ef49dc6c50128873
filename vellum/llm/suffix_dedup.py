"""Removal of repeated byte strings by depth-limited radix sorting of suffixes.

Every byte covered by a ``length``-byte string that also starts earlier (smaller id, or earlier in the
same text) is removed; overlaps count, and matches never cross documents. Only suffixes that can be
repeated are sorted, and only to ``length`` bytes:

1. *Anchors.* Each window of ``length`` bytes is put under the ``GRAM``-byte string in it with the
   smallest hash (the leftmost of equals). Equal windows have equal anchors at equal places, and one
   anchor stands for a run of about forty neighbouring windows, its context, so one row per context
   (some 2 % of the bytes) is shuffled: anchor, digest of the context, document and place.
   Frequent grams rank behind all others: a sketch of ``2 ** SKETCH_BITS`` counters, summed over all
   texts, marks those beyond one in ``SHARE`` places. So a common line in differing surroundings is put
   under its surroundings, and a frequent gram is the anchor only of windows without any rarer one,
   whose contexts are equal. The ranks place work; any ranking gives the same result.
2. *First digit.* Of equal contexts that a task meets, all but the first are covered whole and go no
   further. The others meet by anchor in packed byte blocks. An anchor met once has no repeated
   window. Of equal contexts the first stays, every other one is covered whole.
3. *Radix passes.* The contexts of an anchor that differ are fetched as bytes, and their windows, by
   place of the anchor, are ordered by most-significant-digit passes over eight bytes at a time;
   groups of one leave after each pass, and what is still together after ``length`` bytes are exactly
   the repeated windows. All but the first of each group are covered.
4. The covered runs of each document are united with its text.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; an empty table gives no
rows; other columns are not read. Where ids are null or repeated, rows are ordered by id (nulls
first), then by text, and equal rows by their place after that sort, and treated as documents of
their own in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.llm.chunks import join_texts
from vellum.llm.common import TEXT, as_bytes, blocks, mix64, spans_to_positions
from vellum.session import scratch_path

LENGTH = 100
GRAM = 16
SKETCH_BITS = 20
SHARE = 1 << 17  # a gram is frequent beyond one in so many places (eight times a counter's mean)
LEAST_FREQUENT = 256  # occurrences that a frequent gram has at least
PART_BYTES = 6 << 20
HELD = 1 << 16  # contexts packed together by a task
U = np.uint64
_VALUES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5


def _power(n: int) -> np.uint64:
    return U(pow(_BASE, n, 1 << 64))


def rolling(data: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hash of the ``size`` bytes from each position, for powers of two (positions near the end hold
    shorter strings)."""
    out, size, h = {}, 1, _VALUES[data]
    while True:
        if size in sizes:
            out[size] = h
        if size >= max(sizes):
            return out
        longer = h * _power(size)
        longer[: len(h) - size] += h[size:]
        h, size = longer, 2 * size


def _counter(h: np.ndarray) -> np.ndarray:
    """The sketch's counter of each gram hash."""
    return (mix64(h) >> U(64 - SKETCH_BITS)).astype(np.int64)


def frequent_grams(docs: DataFrame, gram: int = GRAM) -> np.ndarray:
    """A bitmap of the sketch's counters that stand for frequent grams, ``2 ** SKETCH_BITS`` bits. Counters
    are summed by piece on the executors; the driver gets the bitmap's bytes."""
    pieces = 16
    size = (1 << SKETCH_BITS) // pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for rows in blocks(batch, TEXT, 1 << 20):
                data, bounds = join_texts(as_bytes(rows.column(TEXT)))
                if len(data) > gram:
                    at = _counter(rolling(data, (gram,))[gram][: len(data) - gram])
                    total += np.bincount(at, minlength=1 << SKETCH_BITS)
        for k in range(pieces):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array(
                [total[k * size: (k + 1) * size].tobytes()], pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        piece = None
        for batch in batches:  # streamed: one task's counters at a time
            piece = batch.column("piece")[0]
            for raw in batch.column("counts").to_pylist():
                total += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([piece.as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["piece", "counts"])

    add.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    made = (docs.select(TEXT).mapInArrow(count, "piece int, counts binary").groupBy("piece")
            .applyInArrow(add, "piece int, counts binary").collect())  # 8 MB, whatever the texts
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in made:
        counts[row["piece"] * size: (row["piece"] + 1) * size] = np.frombuffer(row["counts"], np.int64)
    return np.packbits(counts > max(LEAST_FREQUENT, int(counts.sum()) // SHARE), bitorder="little")


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, frequent: np.ndarray | None = None):
    """(text, anchor, context digest, first window, anchor's place in it, windows) of all contexts.
    ``frequent`` is the bitmap of ``frequent_grams``."""
    data, bounds = join_texts(texts)
    n = len(data)
    none = np.zeros(0, np.int64)
    span = length - gram + 1  # gram places in a window
    if n < length:
        return none, none.astype(U), none.astype(U), none, none, none
    h = rolling(data, (4, gram, 32, 64))
    position = np.arange(n, dtype=np.uint64)
    low = (mix64(h[gram]) & ~U((1 << 31) - 1)) | position
    if frequent is not None:  # the first bit of the rank
        at = _counter(h[gram])
        last_bit = (frequent[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        low = (low >> U(1) & ~U((1 << 31) - 1)) | position | (last_bit.astype(np.uint64) << U(63))
    best, size = low, 1
    while 2 * size <= span:  # sliding minimum over a power of two of places, then over all
        nxt = best.copy()
        np.minimum(best[:-size], best[size:], out=nxt[:-size])
        best, size = nxt, 2 * size
    last = best.copy()
    if span > size:
        np.minimum(best[: n - (span - size)], best[span - size:], out=last[: n - (span - size)])
    # windows inside one text
    size = np.diff(bounds) - 1
    count = np.maximum(size - length + 1, 0)
    start = spans_to_positions(bounds[:-1], count)
    if not len(start):
        return none, none.astype(U), none.astype(U), none, none, none
    text = np.repeat(np.arange(len(texts)), count)
    place = (last[start] & U((1 << 31) - 1)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    first = start[at]
    windows = np.diff(np.concatenate([at, [len(start)]]))
    own, anchor = text[at], place[at]
    whole = _string_hash(h, first, length), _string_hash(h, first + windows - 1, length)
    shape = ((anchor - first) * 1024 + windows).astype(np.uint64)
    digest = mix64(mix64(whole[0]) * U(0xD6E8FEB86659FD93) + mix64(whole[1] + shape) + shape)
    # anchors have small ranks; mixed anew their leading digits are spread evenly
    return own, mix64(mix64(h[gram][anchor]) + U(_BASE)), digest, first - bounds[own], anchor - first, windows


def _string_hash(h: dict[int, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` bytes from ``at``, put together from powers of two."""
    out, done = np.zeros(len(at), np.uint64), 0
    for size in sorted(h, reverse=True):
        while length - done >= size:
            out = out * _power(size) + h[size][at + done]
            done += size
    for j in range(done, length):  # lengths that the kept sizes do not make up
        out = out * _power(4) + h[4][np.minimum(at + j, len(h[4]) - 1)]
    return out


def pack_place(first: np.ndarray, rel: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return (first << 20) | (rel << 10) | windows


def unpack_place(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 20, (x >> 10) & 1023, x & 1023


def _parts(docs: DataFrame, size: int) -> int:
    return int(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)))


def _anchor_rows(docs: DataFrame, parts: int, length: int, frequent) -> DataFrame:
    """Packed rows (part, entries): anchor, digest, place and document number of each context; entries of
    part -1 are places and document numbers of contexts that equal an earlier one of the same task."""
    def packed(held: list[tuple]) -> pa.RecordBatch:
        anchor, digest, place, doc = map(np.concatenate, zip(*held))
        order = np.lexsort((place, doc, digest, anchor))  # a part is the leading digits of the anchor
        anchor, digest, place, doc = anchor[order], digest[order], place[order], doc[order]
        later = np.zeros(len(anchor), bool)
        later[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
        covered = place[later].tobytes() + doc[later].tobytes()
        anchor, digest, place, doc = (c[~later] for c in (anchor, digest, place, doc))
        some, at = np.unique(((anchor >> U(32)) * U(parts) >> U(32)).astype(np.int64), return_index=True)
        made = [(anchor[a:b].tobytes() + digest[a:b].tobytes() + place[a:b].tobytes() + doc[a:b].tobytes())
                for a, b in zip(at, np.append(at[1:], len(anchor)))]
        return pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*made, covered], pa.binary())],
                                          names=["part", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for rows in blocks(batch, TEXT, 1 << 18):
                own, anchor, digest, first, rel, windows = anchors(as_bytes(rows.column(TEXT)), length, GRAM, frequent.value)
                held.append((anchor, digest, pack_place(first, rel, windows), np.asarray(rows.column("d"))[own]))
                if sum(len(h[0]) for h in held) >= HELD:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return docs.mapInArrow(run, "part int, entries binary")


def _first_digit(packed: DataFrame) -> DataFrame:
    """kind 0: contexts (d, x) covered whole; kind 1: the first of each of several differing contexts
    of an anchor, with the anchor. Entries of the parts below 0 are covered already."""
    def run(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            both = [np.frombuffer(e, np.int64).reshape(2, -1) for e in table.column("entries").to_pylist()]
            place, doc = np.concatenate(both, axis=1)
            none = np.zeros(len(doc), np.int64)
            return pa.table({"kind": none.astype(np.int8), "d": doc, "x": place, "a": none})
        cols = [[], [], [], []]
        for entries in table.column("entries").to_pylist():
            n = len(entries) // 32
            for k, kind in enumerate((np.uint64, np.uint64, np.int64, np.int64)):
                cols[k].append(np.frombuffer(entries, kind, n, 8 * n * k))
        anchor, digest, place, doc = map(np.concatenate, cols)
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        alone = np.ones(len(anchor), bool)
        alone[1:][same] = False
        alone[:-1][same] = False
        order = order[~alone]
        anchor, digest, place, doc = anchor[order], digest[order], place[order], doc[order]
        order = np.lexsort((place, doc, digest, anchor))
        anchor, digest, place, doc = anchor[order], digest[order], place[order], doc[order]
        other = np.ones(len(anchor), bool)
        other[1:] = anchor[1:] != anchor[:-1]
        first = other.copy()
        first[1:] |= digest[1:] != digest[:-1]
        group = np.cumsum(other) - 1
        differing = np.bincount(group, weights=first, minlength=len(anchor)).astype(np.int64)[group]
        covered, open_ = np.flatnonzero(~first), np.flatnonzero(first & (differing > 1))
        at = np.concatenate([covered, open_])
        kind = np.concatenate([np.zeros(len(covered), np.int8), np.ones(len(open_), np.int8)])
        return pa.table({"kind": kind, "d": doc[at], "x": place[at], "a": anchor[at].astype(np.int64)})

    # the covered ones are dealt evenly, by row
    part = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("entries"), F.lit(64)).cast("int")).otherwise(F.col("part"))
    return (packed.select(part.alias("part"), "entries").groupBy("part")
            .applyInArrow(run, "kind byte, d long, x long, a long"))


def repeated_windows(group: np.ndarray, at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``data[at:]`` that agree on ``length`` bytes with another of their group: their
    indexes and final group numbers. Most-significant-digit passes over eight bytes."""
    words = np.ndarray((max(len(data) - 7, 0),), np.dtype(">u8"), data, 0, (1,))
    left = np.arange(len(at))
    group = group.copy()
    depth = 0
    while depth < length and len(left):
        depth_now = min(depth, length - 8)  # the last pass reads the last eight bytes again
        digit = words[at[left] + depth_now].astype(np.uint64)
        order = np.lexsort((digit, group[left]))
        left, digit = left[order], digit[order]
        g = group[left]
        new = np.ones(len(left), bool)
        new[1:] = (g[1:] != g[:-1]) | (digit[1:] != digit[:-1])
        number = np.cumsum(new) - 1
        group[left] = number
        many = np.bincount(number)[number] > 1
        left = left[many]
        depth += 8
    return left, group[left]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (document, start) as contexts of neighbouring starts: documents and packed places."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    new[1:] |= (np.arange(1, len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))[1:]) % 1000 == 0
    at = np.flatnonzero(new)
    return doc[at], pack_place(start[at], np.zeros(len(at), np.int64), np.diff(np.concatenate([at, [len(doc)]])))


def _contexts(texts: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """(a, d, x, context bytes) of the open contexts."""
    wanted = open_.groupBy("d").agg(F.collect_list(F.struct("a", "x")).alias("wanted"))
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "d", "x")]
                          + [T.StructField("context", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in blocks(batch, TEXT, 1 << 20):
                lists = rows.column("wanted")
                flat = lists.flatten()
                count = np.diff(np.asarray(lists.offsets))
                place = np.asarray(flat.field("x"))
                first, _, windows = unpack_place(place)
                texts = as_bytes(rows.column(TEXT))
                own = np.repeat(np.arange(len(texts)), count)
                context = [texts[o][f: f + w + length - 1] for o, f, w in zip(own.tolist(), first.tolist(), windows.tolist())]
                yield pa.RecordBatch.from_arrays([
                    flat.field("a"), pa.array(np.asarray(rows.column("d"))[own]), flat.field("x"),
                    pa.array(context, pa.binary())], schema=arrow)

    # the same columns as in the last join, so that both read one shuffle of the texts
    return texts.join(wanted, "d").select("doc_id", "d", TEXT, "wanted").mapInArrow(run, schema)


def _radix(contexts: DataFrame, parts: int, length: int) -> DataFrame:
    """(d, x) of the repeated windows of all contexts but the first of each group."""
    def run(table: pa.Table) -> pa.Table:
        place, doc, anchor = (np.asarray(table.column(c)) for c in ("x", "d", "a"))
        first, rel, windows = unpack_place(place)
        held = table.column("context").to_pylist()
        data = np.frombuffer(b"".join(held), np.uint8)
        begin = np.cumsum([0] + [len(c) for c in held])[:-1]
        at = spans_to_positions(begin, windows)
        own = np.repeat(np.arange(len(held)), windows)
        j = at - begin[own]
        # equal windows have their anchor at the same place: (anchor, place) is the first digit
        # (mixed into one number: a clash could only join groups, which the bytes then tell apart)
        group = mix64(anchor[own].astype(np.uint64) + (rel[own] - j + 4096).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        left, group = repeated_windows(group.view(np.int64), at, data, length)
        d, s = doc[own[left]], first[own[left]] + j[left]
        order = np.lexsort((s, d, group))
        later = np.ones(len(order), bool)
        later[:1] = False
        later[1:] = group[order][1:] == group[order][:-1]
        d, x = _runs(d[order][later], s[order][later])
        return pa.table({"d": d, "x": x})

    part = F.pmod(F.xxhash64("a"), F.lit(parts)).alias("part")
    return contexts.select(part, "a", "d", "x", "context").groupBy("part").applyInArrow(run, "d long, x long")


def _keyed(docs: DataFrame, work: str) -> DataFrame:
    """doc_id, d (the order of documents) and the text. Unique ids are their own order; otherwise
    rows are numbered in id and text order in a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias(TEXT))
    odd = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), TEXT)  # no id is null here
    tie = F.xxhash64(TEXT)
    (rows.repartitionByRange("doc_id", tie, F.rand(5)).sortWithinPartitions("doc_id", tie, TEXT)
     .withColumn("d", F.monotonically_increasing_id()).write.parquet(f"{work}/keyed"))
    return docs.sparkSession.read.parquet(f"{work}/keyed").select("doc_id", "d", TEXT)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): what is left of each text."""
    spark, work = docs.sparkSession, scratch_path(docs.sparkSession, "suffix")
    keyed = _keyed(docs, work)
    size = keyed.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    frequent = spark.sparkContext.broadcast(frequent_grams(keyed))  # a fixed number of bits
    packed = _anchor_rows(keyed.select("d", TEXT), _parts(docs, int(size * 0.024 * 32)), length, frequent)
    _first_digit(packed).write.partitionBy("kind").parquet(f"{work}/matches")
    matches = spark.read.schema("d long, x long, a long, kind int").parquet(f"{work}/matches")
    open_ = matches.where("kind = 1").select("d", "a", "x")
    n_open = open_.count()
    texts = keyed.select("doc_id", "d", TEXT)
    spans = matches.where("kind = 0").select("d", "x")
    if n_open:
        spans = spans.union(_radix(_contexts(texts, open_, length), _parts(docs, n_open * 256), length))
    covered = spans.groupBy("d").agg(F.collect_list("x").alias("covered"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in blocks(batch, TEXT, 1 << 20):
                out = []
                for i, text in enumerate(as_bytes(rows.column(TEXT))):
                    places = rows.column("covered")[i].values
                    if places is None:
                        out.append((len(text), 0, 0, text))
                        continue
                    first, _, windows = unpack_place(np.asarray(places))
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + windows + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
                n, removed, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], schema=arrow)

    return texts.join(covered, "d", "left").select("doc_id", TEXT, "covered").mapInArrow(run, schema)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                               F.sha2("kept", 256).alias("kept_sha256"))
