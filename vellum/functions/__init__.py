"""Column functions (JVM-side where possible) and the one Arrow UDF for subword tokens."""

from vellum.functions.text import (
    bpe_truncate_and_count,
    parse_date,
    text_present,
    unicode_trim,
    word_token_count,
    word_tokens,
    word_truncate,
)

__all__ = [
    "bpe_truncate_and_count",
    "parse_date",
    "text_present",
    "unicode_trim",
    "word_token_count",
    "word_tokens",
    "word_truncate",
]
