"""Benchmark decontamination by a prefix-filtered set join.

Items and documents are word sequences (A-Z lowered; a word is a run of letters, digits or characters
beyond ASCII). An item's windows are its runs of ``window`` consecutive words; a shorter item is one
window. All words of a window must occur, so one prefix word is enough to find it: words are ordered
by rarity (their occurrences in the whole document table, counted first), and each window is listed
under its rarest word with that word's place. A document word that is a prefix word proposes its
windows; the place gives the only possible start, windows that would leave the document are cut off
(length and position bounds), and the rest are verified word by word.

The distinct items are cut into blocks of about ``block_bytes`` of text (by a hash, counted beforehand);
each block's index is a broadcast of bounded size, and the blocks are applied one after the other in
one narrow pass, so an item table of any size needs no shuffle of the documents.

Defined cases: null or empty text has no words and is never contaminated; an item without words has
no windows; repeated items (equal id and text) count once; items with a null id mark words but are not listed; an empty
benchmark or document table gives no hits / no rows; other columns pass through untouched in
``decontaminate`` and are ignored in ``overlap``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellum.llm.chunks import KeyTable, hash_runs, join_texts, runs
from vellum.llm.common import TEXT, as_bytes, blocks, spans_to_positions

WINDOW = 13
BLOCK_TEXT = 16 << 20  # bytes of item text in one broadcast index
CANDIDATES = 1 << 20  # window candidates verified at a time
PRE = "__overlap_"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word of all texts, and each text's first word (one more than texts)."""
    data, bounds = join_texts(texts)
    low = _LOWER[data]
    starts, ends = runs(_WORD[low])
    key, check = hash_runs(low, starts, ends)
    return key, check, np.searchsorted(starts, bounds)


class WindowIndex:
    """Windows of a block of items, listed under their rarest word."""

    def __init__(self, texts: list[bytes], ids: list[str | None], window: int) -> None:
        key, check, first = words(texts)
        self.ids = ids
        self.table = KeyTable()
        number = self.table.number_all(key, check, lambda places: None)
        found: dict[tuple, int] = {}
        owners: list[list[int]] = []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            seq = number[a:b].tolist()
            size = min(window, len(seq))
            for s in range(len(seq) - size + 1 if size else 0):
                w = tuple(seq[s: s + size])
                at = found.setdefault(w, len(owners))
                if at == len(owners):
                    owners.append([])
                if not owners[at] or owners[at][-1] != i:
                    owners[at].append(i)
        self.windows = np.full((len(found), window), -1, np.int64)
        self.size = np.array([len(w) for w in found], np.int64)
        for at, w in enumerate(found):
            self.windows[at, : len(w)] = w
        self.owner_first = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owner = np.array([i for o in owners for i in o], np.int64)

    def order(self, occurrences: np.ndarray) -> None:
        """Choose each window's rarest word (ties: the earlier place) as its only prefix word."""
        n = len(self.windows)
        cost = np.where(self.windows >= 0, occurrences[self.windows], np.iinfo(np.int64).max)
        place = cost.argmin(axis=1) if n else np.zeros(0, np.int64)
        word = self.windows[np.arange(n), place] if n else np.zeros(0, np.int64)
        by = np.argsort(word, kind="stable")
        self.listed, self.place = by, place[by]
        self.first = np.searchsorted(word[by], np.arange(self.table.count + 1))

    def match(self, number: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start word, window) of every occurrence in the texts; ``number`` has -1 for other words."""
        starts, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.flatnonzero(number >= 0)
        count = self.first[number[at] + 1] - self.first[number[at]]
        at, count = at[count > 0], count[count > 0]
        upto = np.cumsum(count)
        for chunk in np.split(np.arange(len(at)), np.flatnonzero(np.diff(upto // CANDIDATES)) + 1):
            a, c = at[chunk], count[chunk]
            listed = spans_to_positions(self.first[number[a]], c)
            win = self.listed[listed]
            pos = np.repeat(a, c)
            start = pos - self.place[listed]
            doc = np.searchsorted(first, pos, side="right") - 1
            ok = (start >= first[doc]) & (start + self.size[win] <= first[doc + 1])
            start, win = start[ok], win[ok]
            for j in range(self.windows.shape[1]):
                want = self.windows[win, j]
                ok = (want < 0) | (number[np.minimum(start + j, len(number) - 1)] == want)
                start, win = start[ok], win[ok]
            starts.append(start)
            wins.append(win)
        return np.concatenate(starts), np.concatenate(wins)


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[bytes], list[str | None]]]:
    """Distinct items in blocks of about ``block_bytes`` of text, one block on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text")
                             ).where(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()
        rows.sort(key=lambda r: (r["id"] or "", r["text"]))
        yield [r["text"].encode("utf-8") for r in rows], [r["id"] for r in rows]


def _occurrences(docs: DataFrame, index) -> np.ndarray:
    """How often each word of the block's vocabulary occurs in all documents."""
    src = docs.select(F.col("text").cast("string").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value.table
        total = np.zeros(table.count + 1, np.int64)
        for batch in batches:
            for part in blocks(batch, TEXT, 1 << 20):
                key, check, _ = words(as_bytes(part.column(TEXT)))
                total += np.bincount(table.find(key, check) + 1, minlength=len(total))
        at = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at + 1])], names=["word", "n"])

    counts = src.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(index.value.table.count, np.int64)
    for r in counts.collect():  # one row per word of a bounded block
        out[r["word"]] = r["n"]
    return out


def overlap_columns(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    block_bytes: int = BLOCK_TEXT) -> DataFrame:
    """All columns of ``docs`` plus ``__overlap_n_words``, ``__overlap_n_hit``, ``__overlap_items``
    (distinct item ids as strings) and the mask of hit words."""
    spark = docs.sparkSession
    kept = docs.columns
    out = docs.withColumns({PRE + "n_words": F.lit(0).cast("long"), PRE + "n_hit": F.lit(0).cast("long"),
                            PRE + "items": F.array().cast("array<string>"), PRE + "mask": F.lit(None).cast("binary")})
    for texts, ids in _item_blocks(benchmark, block_bytes):
        built = WindowIndex(texts, ids, window)
        built.order(_occurrences(docs, spark.sparkContext.broadcast(built)))
        index = spark.sparkContext.broadcast(built)
        out = _apply_block(out, kept, index)
    return out


def _apply_block(rows: DataFrame, kept: list[str], index) -> DataFrame:
    schema = rows.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for part in blocks(batch, "text", 1 << 20):
                texts = as_bytes(part.column("text"))
                n = len(texts)
                key, check, first = words(texts)
                start, win = ix.match(ix.table.find(key, check), first)
                cover = np.zeros(len(key) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + ix.size[win], -1)
                hit = np.cumsum(cover[:-1]) > 0
                doc = np.searchsorted(first, start, side="right") - 1
                count = ix.owner_first[win + 1] - ix.owner_first[win]
                pairs = np.unique(np.stack([np.repeat(doc, count),
                                            ix.owner[spans_to_positions(ix.owner_first[win], count)]], axis=1), axis=0)
                items: list[set] = [set(x) for x in part.column(PRE + "items").to_pylist()]
                for d, i in pairs.tolist():
                    if ix.ids[i] is not None:
                        items[d].add(ix.ids[i])
                masks, hits = [], []
                for d, old in enumerate(part.column(PRE + "mask").to_pylist()):
                    mine = hit[first[d]: first[d + 1]]
                    if old:
                        mine = mine | np.unpackbits(np.frombuffer(old, np.uint8), count=len(mine)).astype(bool)
                    hits.append(int(mine.sum()))
                    masks.append(np.packbits(mine).tobytes() if hits[-1] else None)
                made = {PRE + "n_words": pa.array(np.diff(first), pa.int64()), PRE + "n_hit": pa.array(hits, pa.int64()),
                        PRE + "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        PRE + "mask": pa.array(masks, to_arrow_type(T.BinaryType()))}
                assert n == part.num_rows
                yield pa.RecordBatch.from_arrays([made[c] if c in made else part.column(c) for c in names], names=names)

    return rows.mapInArrow(run, schema)


def contaminated() -> F.Column:
    """Hit words are at least one in twenty of all words."""
    return (F.col(PRE + "n_hit") > 0) & (20 * F.col(PRE + "n_hit") >= F.col(PRE + "n_words"))


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_TEXT) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings), contaminated."""
    rows = overlap_columns(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window, block_bytes)
    return rows.select("doc_id", F.col(PRE + "n_words").alias("n_words"), F.col(PRE + "n_hit").alias("n_hit"),
                       F.array_sort(PRE + "items").alias("items"), contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return overlap_columns(docs, benchmark, window).where(~contaminated()).select(*[f"`{c}`" for c in docs.columns])
