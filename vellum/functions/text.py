"""Text column functions.

All of these are built-in Spark expressions (whole-stage codegen, no Python) except
``bpe_truncate_and_count``, an Arrow UDF that loads its tokenizer once per worker and tokenizes each
text once for both the truncation and the count, a bounded number of characters at a time.
"""

from __future__ import annotations

import datetime as _dt
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The blank test is "only Unicode space separators (category Zs)". Tab, newline and
# zero-width characters are not blank. \A and \z anchor the whole string (Java's $ would also
# match before a final newline).
BLANK_PATTERN = r"\A\p{Zs}*\z"
LEADING_SPACE = r"\A\p{Zs}+"
TRAILING_SPACE = r"\p{Zs}+\z"
# Fixed value: a word token is a run of characters other than space, tab, newline, carriage return.
WORD_PATTERN = r"[^ \t\n\r]+"
# Texts that a subword task holds as Python strings, and the characters that it tokenizes at once
# (a token's object takes some hundred bytes).
ROWS, PIECE = 512, 1 << 20


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unicode_trim(c) -> Column:
    """SQL ``TRIM`` that removes Unicode space separators at both ends (Spark's trim only drops U+0020)."""
    c = _col(c)
    return F.regexp_replace(F.regexp_replace(c, LEADING_SPACE, ""), TRAILING_SPACE, "")


def text_present(c) -> Column:
    """``body IS NOT NULL AND TRIM(body) != ''`` with the Unicode-space trim."""
    c = _col(c)
    return c.isNotNull() & ~c.rlike(BLANK_PATTERN)


def parse_date(s: str) -> Column:
    """A ``YYYY-MM-DD`` string as a TIMESTAMP_NTZ literal at midnight; bad formats raise on the driver."""
    d = _dt.datetime.strptime(s, "%Y-%m-%d")
    return F.lit(d).cast(T.TimestampNTZType())


def word_tokens(c) -> Column:
    """Array of word tokens (runs of non-whitespace); null text gives an empty array."""
    c = _col(c)
    return F.coalesce(F.regexp_extract_all(c, F.lit(WORD_PATTERN), 0), F.array().cast("array<string>"))


def word_token_count(c) -> Column:
    """Number of word tokens; null or empty text counts 0."""
    return F.size(word_tokens(c)).cast("long")


def word_truncate(c, max_tokens: int, count: Column | None = None) -> Column:
    """Null or '' -> ''; at most ``max_tokens`` tokens -> the text unchanged; else the first
    ``max_tokens`` tokens joined by single spaces. ``count``: the text's tokens, where they are counted already."""
    if max_tokens < 0:
        raise ValueError("max_tokens must be >= 0")
    c = _col(c)
    toks = word_tokens(c)
    return (F.when(c.isNull() | (c == ""), F.lit(""))
            .when((F.size(toks) if count is None else count) <= max_tokens, c)
            .otherwise(F.array_join(F.slice(toks, 1, max_tokens) if max_tokens > 0
                                    else F.array().cast("array<string>"), " ")))


# ---------------------------------------------------------------------------------------------
# Subword (BPE) tokens: the only Python on this path, one Arrow batch at a time.

@functools.lru_cache(maxsize=4)
def _load_tokenizer(data: bytes):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_buffer(data)
    try:
        tok.encode_special_tokens = True  # special-token strings inside a text are plain text
    except AttributeError:
        pass
    return tok


def default_tokenizer_path() -> str:
    return os.environ.get("VELLUM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of together at most ``PIECE`` characters (one longer text is a range)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > PIECE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _encode_piece(tok, texts: list[str], max_tokens: int) -> tuple[list[str], list[int]]:
    """The cut texts and their token counts; the tokens' objects live no longer than this call."""
    out = list(texts)
    counts = [0] * len(texts)
    recount = []
    for i, e in enumerate(tok.encode_batch(texts, add_special_tokens=False)):
        counts[i] = len(e)
        if counts[i] > max_tokens:
            out[i] = tok.decode(e.ids[:max_tokens], skip_special_tokens=True)
            recount.append(i)
    if recount:  # the count is taken on the cut text, as a verification column
        for i, e in zip(recount, tok.encode_batch([out[i] for i in recount], add_special_tokens=False)):
            counts[i] = len(e)
    return out, counts


def _truncate_count(col: pa.Array, tokenizer: bytes, max_tokens: int) -> pa.StructArray:
    tok = _load_tokenizer(tokenizer)
    texts, counts = [], []
    for at in range(0, len(col), ROWS):
        values = [t or "" for t in col.slice(at, ROWS).to_pylist()]
        cut, n = [], []
        for a, b in _pieces(values):
            made, sizes = _encode_piece(tok, values[a:b], max_tokens)
            cut += made
            n += sizes
        texts.append(pa.array(cut, pa.string()))
        counts.append(pa.array(n, pa.int64()))
    text = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
    count = pa.concat_arrays(counts) if counts else pa.array([], pa.int64())
    return pa.StructArray.from_arrays([text, count], names=["text", "token_count"])


def bpe_truncate_and_count(c, max_tokens: int, tokenizer_path: str | None = None) -> Column:
    """struct<text string, token_count bigint>: the text cut to ``max_tokens`` subword tokens
    (unchanged when within the limit, decode of the first ids otherwise) and the token count of the
    result. Null or '' -> ('', 0). The tokenizer file (a few MB) is read on the driver and broadcast, so
    executors need no copy of it."""
    with open(tokenizer_path or default_tokenizer_path(), "rb") as f:
        shared = SparkSession.active().sparkContext.broadcast(f.read())

    @F.arrow_udf("struct<text:string,token_count:bigint>")
    def _udf(col: pa.Array) -> pa.Array:
        return _truncate_count(col, shared.value, max_tokens)

    return _udf(_col(c).cast("string"))
