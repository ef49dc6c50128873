"""Byte-level BPE token counts by rank-synchronous merging.

Texts are split into pre-tokens. The distinct new pre-tokens of a block are held as one ragged numpy
array of symbol ids; each round finds every sequence's lowest-rank adjacent pair and applies that
pair everywhere in its sequence (left to right, not overlapping), until no pair has a rank. The
surviving symbols of a sequence are its token count. A bounded memo per task keeps counts of chunks
already seen. Nothing is shuffled: counting is a map over the documents.

A text whose blanks are single spaces and newlines is split at them first: no pre-token reaches
across one, so each chunk (with the space before it) is counted by itself and memoised under a
128-bit hash. Texts with other blanks, or with a special token's string, are split as a whole.

Defined cases: null and empty text have 0 bytes and 0 tokens; repeated rows are counted each; an
empty table gives no rows; other columns are not read. A long run of letters or signs is one pre-token;
it is first cut where no token of the vocabulary lies across (no merge can join the two sides, so the
parts merge by themselves), and the parts are sequences of the same ragged array.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.chunks import KeyTable, hash_runs, join_texts, runs
from vellum.llm.common import map_texts, tokenizer_bytes

# Fixed value: the byte-level split pattern of the tokenizer file's pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 1024
MEMO_ENTRIES = 1_000_000
NO_RANK = np.int64(1 << 40)
LONG = 256  # bytes from which a pre-token is cut at places no token lies across
_STEP = np.uint64(0x9E3779B97F4A7C15)  # base of the prefix hashes


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = set([*range(33, 127), *range(161, 173), *range(174, 256)])
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(spare))
        spare += b not in shown
    return out


class RankMerger:
    """Counts the symbols that survive all merges, for many byte strings at once."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        alphabet = byte_alphabet()
        self.alphabet, self.pairs, self.prefixes = alphabet, pairs, None
        self.first = np.array([vocab[c] for c in alphabet], np.int64)  # symbol of each byte
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        # open addressing with linear probing: slot -> (key, rank)
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        self.slot_key = np.full((1 << self.bits) + len(keys) + 1, -1, np.int64)
        self.slot_rank = np.full(len(self.slot_key), NO_RANK)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slots(keys).tolist())):
            while self.slot_key[at] != -1:
                at += 1
            self.slot_key[at], self.slot_rank[at] = key, rank

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = self._slots(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], NO_RANK)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            at[open_] += 1
            found = self.slot_key[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _prefix_tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length from 2 on: sorted hashes of the merged tokens' prefixes, and which are tokens."""
        if self.prefixes is None:
            byte_of = {c: i for i, c in enumerate(self.alphabet)}
            tokens = [bytes(map(byte_of.__getitem__, a + b)) for a, b in self.pairs]
            data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint64)
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            first = np.cumsum(size) - size
            code = data[first] if len(first) else np.zeros(0, np.uint64)
            self.prefixes = []
            for n in range(2, int(size.max(initial=1)) + 1):
                live = size >= n
                first, size, code = first[live], size[live], code[live]
                code = code * _STEP + data[first + n - 1] + np.uint64(1)
                held, place = np.unique(code, return_inverse=True)
                whole = np.zeros(len(held), bool)
                whole[place[size == n]] = True
                self.prefixes.append((held, whole))
        return self.prefixes

    def parts(self, word: bytes) -> list[bytes]:
        """``word`` cut at every place that no occurrence of a merged token lies across."""
        data = np.frombuffer(word, np.uint8).astype(np.uint64)
        at = np.arange(len(data))
        code, reach = data.copy(), np.zeros(len(data), np.int64)
        for n, (held, whole) in enumerate(self._prefix_tables(), 2):
            room = at + n <= len(data)
            at, code = at[room], code[room] * _STEP + data[at[room] + n - 1] + np.uint64(1)
            place = np.minimum(np.searchsorted(held, code), len(held) - 1)
            found = held[place] == code  # equal hashes of other strings only leave a cut out
            at, code, place = at[found], code[found], place[found]
            reach[at[whole[place]]] = n
            if not len(at):
                break
        inner = np.zeros(len(data) + 1, np.int64)
        from_ = np.flatnonzero(reach)
        np.add.at(inner, from_ + 1, 1)
        np.add.at(inner, from_ + reach[from_], -1)
        cuts = np.flatnonzero(np.cumsum(inner)[1: len(data)] == 0) + 1
        edges = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:])]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each byte string."""
        long = [i for i, w in enumerate(words) if len(w) >= LONG]
        if not long:
            return self._merged(words)
        counts = self._merged([b"" if len(w) >= LONG else w for w in words])
        for i in long:
            counts[i] = self._merged_parts(self.parts(words[i]))
        return counts

    def _merged_parts(self, parts: list[bytes]) -> int:
        different: dict[bytes, int] = {}
        for p in parts:
            different[p] = different.get(p, 0) + 1
        return int(self._merged(list(different)) @ np.fromiter(different.values(), np.int64))

    def _merged(self, words: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            # pairs inside one sequence, and the lowest rank of each sequence
            same = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), NO_RANK)
            rank[:-1][same] = self._pair_ranks(symbols[:-1][same], symbols[1:][same])
            starts = np.concatenate([[0], np.flatnonzero(~same) + 1])
            lowest = np.minimum.reduceat(rank, starts)
            group = np.cumsum(np.concatenate([[0], (~same).astype(np.int64)]))
            live = lowest < NO_RANK
            if not live.any():
                break
            hit = (rank == lowest[group]) & live[group]
            # in a chain of overlapping hits (equal symbols) every other one counts, from the left
            at = np.flatnonzero(hit)
            new_chain = np.concatenate([[True], np.diff(at) > 1])
            chain = np.cumsum(new_chain) - 1
            nth = np.arange(len(at)) - np.flatnonzero(new_chain)[chain]
            at = at[nth % 2 == 0]
            symbols[at] = self.made[rank[at]]
            counts -= np.bincount(owner[at], minlength=len(words))
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            keep = ~gone & live[group]  # finished sequences leave the arrays
            symbols, owner = symbols[keep], owner[keep]
        return counts


_OTHER_BLANK = np.isin(np.arange(256), [9, 11, 12, 13])
_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])


class TokenCounter:
    """Token counts of texts; ``memo_entries`` bounds the chunks remembered between blocks."""

    def __init__(self, data: bytes, memo_entries: int = MEMO_ENTRIES) -> None:
        import regex

        spec = json.loads(data)
        self.merger = RankMerger(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.special_at = regex.compile("|".join(regex.escape(s.decode()) for s in self.special))
        self.split = regex.compile(PATTERN)
        self.blank = regex.compile(r"\s")
        self.memo_entries = memo_entries
        self._reset()

    def _reset(self) -> None:
        self.table = KeyTable()
        self.counts = np.zeros(0, np.int64)

    def _pretokens(self, chunk: str, spaced: bool) -> list[str] | None:
        lead = " " if spaced else ""
        if chunk.isalpha():
            return [lead + chunk]
        if self.blank.match(chunk[0]) or self.blank.match(chunk[-1]):
            return None  # a blank at an end: the whole text has to be split
        return self.split.findall(lead + chunk)

    def _count_lists(self, lists: list[list[str] | None]) -> np.ndarray:
        """Tokens of each list of pre-tokens (-1 for None); the distinct ones are one ragged batch."""
        place = {p: i for i, p in enumerate(dict.fromkeys(p for x in lists if x for p in x))}
        counts = self.merger.count([p.encode("utf-8") for p in place])
        index = np.fromiter((place[p] for x in lists if x for p in x), np.int64)
        owner = np.repeat(np.arange(len(lists)), np.array([len(x or ()) for x in lists], np.int64))
        made = np.bincount(owner, weights=counts[index], minlength=len(lists)).astype(np.int64)
        made[[x is None for x in lists]] = -1
        return made

    def count(self, texts: list[bytes]) -> np.ndarray:
        if len(self.counts) > self.memo_entries:
            self._reset()
        data, bounds = join_texts(texts)
        space, newline = data == 32, data == 10
        sep = space | newline
        # texts to be split as a whole: special strings, blanks side by side, at an end or of other kinds
        whole = np.array([any(s in t for s in self.special) for t in texts], bool)
        odd = np.flatnonzero(_OTHER_BLANK[data])
        pair = np.flatnonzero(sep[1:] & sep[:-1])
        lead = bounds[:-1][sep[bounds[:-1]]] if len(texts) else bounds[:0]
        for at in (odd, pair, lead):
            whole[np.searchsorted(bounds, at, side="right") - 1] = True
        # an empty text is a single separator, which is no reason to split it
        stop = np.flatnonzero((data == 44) | (data == 46))
        stop = stop[stop > 0]
        stop = stop[_ALNUM[data[stop - 1]] & sep[stop + 1]]
        inside = ~sep
        inside[stop] = False  # a stop between a letter or number and a separator is one token
        starts, ends = runs(inside)
        key, check = hash_runs(data, starts, ends)
        spaced = (starts > 0) & space[starts - 1]
        key = key ^ (spaced.astype(np.uint64) * np.uint64(0xA5A5A5A55A5A5A5B))
        raw = data.tobytes()

        def new(places: np.ndarray) -> None:
            lists = [self._pretokens(raw[a:b].decode("utf-8"), s) for a, b, s in zip(
                starts[places].tolist(), ends[places].tolist(), spaced[places].tolist())]
            self.counts = np.concatenate([self.counts, self._count_lists(lists)])

        number = self.table.number_all(key, check, new)  # fills self.counts first
        found = self.counts[number]
        owner = np.searchsorted(bounds, starts, side="right") - 1
        whole[owner[found < 0]] = True
        n = len(texts)
        out = np.bincount(owner, weights=found, minlength=n).astype(np.int64)
        out += np.bincount(np.searchsorted(bounds, np.flatnonzero(newline), side="right") - 1, minlength=n) - 1
        out += np.bincount(np.searchsorted(bounds, stop, side="right") - 1, minlength=n)
        at = np.flatnonzero(whole)
        if len(at):
            lists, extra = [], []
            for i in at.tolist():
                text = texts[i].decode("utf-8")
                extra.append(len(self.special_at.findall(text)) if self.special else 0)
                parts = self.special_at.split(text) if extra[-1] else [text]
                lists.append([p for x in parts for p in self.split.findall(x)])
            out[at] = self._count_lists(lists) + np.array(extra, np.int64)
        return out


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    data = tokenizer_bytes(docs.sparkSession, tokenizer_path, "byte_bpe_50k.json")

    def make():
        counter = TokenCounter(data.value)

        def run(texts: list[bytes]):
            return [len(t) for t in texts], counter.count(texts)
        return run

    counted = map_texts(docs, make, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
