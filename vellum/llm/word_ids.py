"""Ids of whole texts by the ``tokenizers`` library, with a bounded per-task memo of chunks.

For a tokenizer that drops white space and splits words at it (NFC, white space, lower case; words,
single numbers and runs of other signs), the ids of a text are the ids of its white-space separated
chunks, one after the other. Chunks repeat, so the library only sees each new chunk once. Any other
tokenizer file gets whole texts.
"""

from __future__ import annotations

import codecs
import json
import re

import numpy as np

from vellum.llm.chunks import KeyTable, hash_runs, join_texts, runs
from vellum.llm.common import RaggedStore

# The stages of a tokenizer file for which chunks may be encoded one by one.
CHUNK_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
CHUNK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LETTERS = re.compile("[a-zß-öø-ÿ]+")
MAX_CHUNKS, LONG_CHUNK = 1_000_000, 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), [44, 46])
_ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])


def _byte_characters() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    keep = set(shown)
    return "".join(chr(b if b in keep else next(rest)) for b in range(256))


class WordEncoder:
    def __init__(self, data: bytes, max_chunks: int = MAX_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_buffer(data)
        self.model = self.tok.model
        spec = json.loads(data)
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.chunked = norm == CHUNK_NORMALIZERS and pre[0].get("pattern", {}).get("Regex") == CHUNK_PATTERN
        self.special = [x["content"].lower().encode() for x in spec.get("added_tokens", [])]
        self.alphabet = _byte_characters()
        self.max_chunks = max_chunks
        self._reset()

    def _reset(self) -> None:
        self.table, self.store = KeyTable(), RaggedStore()

    def _whole(self, text: bytes) -> list[int]:
        return self.tok.encode(text.decode("utf-8"), add_special_tokens=False).ids

    def _chunk(self, chunk: bytes) -> list[int]:
        if chunk.isalpha():  # ASCII letters: one word
            return [t.id for t in self.model.tokenize(chunk.decode("ascii").lower())]
        if len(chunk) < LONG_CHUNK:
            low = chunk.decode("utf-8").lower()
            if LETTERS.fullmatch(low):
                low = codecs.charmap_decode(low.encode(), "strict", self.alphabet)[0]
                return [t.id for t in self.model.tokenize(low)]
        return self._whole(chunk)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined (uint32), and how many each text has."""
        if self.store.count > self.max_chunks:
            self._reset()
        special = [not self.chunked or b"<|" in t and any(s in t.lower() for s in self.special) for t in texts]
        data, bounds = join_texts([b"" if s else t for t, s in zip(texts, special)])
        low = _LOWER[data]
        high = np.flatnonzero(data >= 0xC4)
        if len(high):  # lower case before the other stages is safe below U+0100 only
            for i in np.unique(np.searchsorted(bounds, high, side="right") - 1).tolist():
                low[bounds[i]: bounds[i + 1]] = data[bounds[i]: bounds[i + 1]]
        # a chunk is a run without blanks; a stop between a letter or number and a blank is its own
        blank, alnum = _BLANK[low], _ALNUM[low]
        stop = np.flatnonzero(_STOP[low])
        stop = stop[(stop > 0) & (stop < len(low) - 1)]
        stop = stop[alnum[stop - 1] & blank[stop + 1]]
        starts, ends = runs(~blank)
        starts, ends = np.sort(np.concatenate([starts, stop])), np.sort(np.concatenate([ends, stop]))
        key, check = hash_runs(low, starts, ends)
        raw = low.tobytes()

        def new(places: np.ndarray) -> None:
            self.store.extend([self._chunk(raw[a:b]) for a, b in zip(starts[places].tolist(), ends[places].tolist())])

        number = self.table.number_all(key, check, new)
        ids, lengths = self.store.gather(number)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(upto[np.searchsorted(starts, bounds)])
        if any(special):
            parts = np.split(ids, np.cumsum(counts)[:-1]) if len(texts) else []
            for i in np.flatnonzero(special).tolist():
                parts[i] = np.array(self._whole(texts[i]), np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, counts
