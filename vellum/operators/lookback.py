"""Look-back text datasets: spine split, key fetch, message cleaning, the band self-join and the
distinct ordered text aggregation, label join and token truncation.

The hot operator is ``lookback_text``. For every labelled anchor ``(key, t)`` it gathers the
distinct, non-blank message texts of the same key with ``t - days <= time <= t`` (both ends
inclusive), sorts them by bytes and joins them with a separator. Forms (all give equal rows):

* ``bucketed`` (default): anchors are reduced to labelled ones first; messages are hashed on
  ``(key, time bucket)`` and each anchor probes only the buckets its window touches, so one hot key
  is spread over many tasks instead of one. A finer ``bucket_seconds`` splits hot keys further.
* ``rew``: the same anchor reduction with an equi-join on ``(key, salt)`` plus the range
  residual: messages of hot keys get one of ``salts`` salts (a hash of time and text) and the anchors of
  those keys are copied to every salt; all other keys have one salt and no copies. Hot keys are named by
  a mergeable frequency sketch of the messages (``hot_groups``).
* ``frame``: a RANGE window partitioned by ``(key, time bucket)`` (bucket width >= look-back);
  each message is also copied into the next bucket as context, so a window never crosses its
  partition and a hot key is split over its buckets.
* ``full``: the unreduced shape, every clean message is an anchor; labels filter afterwards. The windows are
  those of ``frame``: each message is shuffled twice, not once per window that holds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import (
    bpe_truncate_and_count,
    parse_date,
    text_present,
    word_token_count,
    word_truncate,
)
from vellum.session import require_columns

DEFAULT_SEPARATOR = "\n---\n"
METHODS = ("bucketed", "rew", "frame", "full")
DEFAULT_SALTS = 16
# heavy hitters: at most HOT_TOP groups that hold over one in HOT_SHARE rows, by a sketch of HOT_TRACKED counters
HOT_TOP, HOT_SHARE, HOT_TRACKED = 512, 1024, 1 << 14
FILTER_WORDS = 1 << 17  # 64-bit words of the key filter: 1 MB
PROBES = 16  # buckets of a window that an anchor is copied to outright


# -- P1 ---------------------------------------------------------------------------------------

def date_range(df: DataFrame, start: str, end: str, ts: str = "CreatedAt") -> DataFrame:
    """Rows with ``start <= ts < end`` (half-open, dates as ``YYYY-MM-DD``); pushed to the scan."""
    require_columns(df, ts, what="spine")
    lo, hi = parse_date(start), parse_date(end)
    return df.filter((F.col(ts) >= lo) & (F.col(ts) < hi))


def split_spine(spine: DataFrame, train_start: str, train_end: str, test_start: str, test_end: str,
                ts: str = "CreatedAt") -> tuple[DataFrame, DataFrame]:
    """Train ``[train_start, train_end)`` and test ``[test_start, test_end)``; ranges are independent."""
    return date_range(spine, train_start, train_end, ts), date_range(spine, test_start, test_end, ts)


# -- P3 / P4 / P5 / P6 ------------------------------------------------------------------------

def fetch_keys(messages: DataFrame, keys: DataFrame, key: str = "UserLoanId") -> DataFrame:
    """Raw rows of ``messages`` whose key occurs in ``keys`` (a semi-join, never a literal list)."""
    require_columns(messages, key, what="messages")
    require_columns(keys, key, what="keys")
    return messages.join(keys.select(key), on=key, how="left_semi")


_HASHED = (T.IntegralType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _same_hashes(a: DataFrame, b: DataFrame, *cols: str) -> bool:
    """Whether equal values of ``cols`` have equal ``_hash``es in both tables (whole numbers of any width
    do); where not, hot groups and key filters are left out, which changes no result."""
    def kind(df: DataFrame, c: str):
        t = df.schema[c].dataType
        return "whole" if isinstance(t, T.IntegralType) else type(t) if isinstance(t, _HASHED) else None
    return all(kind(a, c) is not None and kind(a, c) == kind(b, c) for c in cols)


def _hash(df: DataFrame, *cols: str) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`").cast("long") if isinstance(df.schema[c].dataType, T.IntegralType)
                        else F.col(f"`{c}`") for c in cols])


def hot_groups(rows: DataFrame, *cols: str) -> DataFrame:
    """``(_hot)``: hashes of the groups (values of ``cols``) that hold more than one in ``HOT_SHARE`` rows, at
    most ``HOT_TOP`` of them, by a mergeable sketch (one narrow scan, map-side, no shuffle of rows). It may
    name a group too many, which costs copies and changes no result."""
    top = (rows.select(_hash(rows, *cols).alias("h"))
           .agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {HOT_TOP}, {HOT_TRACKED})").alias("top")))
    return (top.select("n", F.explode("top").alias("t")).filter(F.col("t.count") * HOT_SHARE > F.col("n"))
            .select(F.col("t.item").alias("_hot")))


def _salted(a: DataFrame, m: DataFrame, hot: DataFrame, salts: int, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with ``_salt``: rows ``m`` of a hot group get one of ``salts`` by a hash of time
    and text, rows ``a`` of it are copied to every salt; rows of other groups have salt 0."""
    if not _same_hashes(a, m, *cols):
        return a.withColumn("_salt", F.lit(0)), m.withColumn("_salt", F.lit(0))
    hot = F.broadcast(hot)  # at most HOT_TOP rows
    m = m.join(hot, _hash(m, *cols) == F.col("_hot"), "left").withColumn("_salt", F.when(
        F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_mt", "_body"), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    last = F.when(F.col("_hot").isNotNull(), F.lit(salts - 1)).otherwise(0)
    a = a.join(hot, _hash(a, *cols) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")
    return a, m


def key_filter(messages: DataFrame, keys: DataFrame, key: str = "UserLoanId") -> DataFrame:
    """P3 before any shuffle: ``messages`` whose key may be one of ``keys``. A Bloom filter of fixed size
    (``FILTER_WORDS`` words of 64 bits) is built by a distributed aggregate and joined by word; keys that
    pass wrongly vanish in the exact join that follows."""
    if not _same_hashes(messages, keys, key):
        return messages
    words = keys.select(_hash(keys, key).alias("_h")).select(
        F.pmod(F.col("_h"), F.lit(FILTER_WORDS)).alias("_word"),
        F.expr(f"shiftleft(1L, CAST(pmod(_h DIV {FILTER_WORDS}, 64) AS INT))").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))  # at most FILTER_WORDS rows
    h = _hash(messages, key)
    bit = F.pmod(F.call_function("div", h, F.lit(FILTER_WORDS)), F.lit(64)).cast("int")
    return messages.join(F.broadcast(words), (F.pmod(h, F.lit(FILTER_WORDS)) == F.col("_word"))
                         & (F.getbit(F.col("_bits"), bit) == 1), "left_semi")


def clean_messages(messages: DataFrame, key: str = "UserLoanId", ts: str = "CreatedAt",
                   body: str = "body") -> DataFrame:
    """Distinct ``(key, ts, body)`` with non-null, non-blank text."""
    require_columns(messages, key, ts, body, what="messages")
    return (messages.select(key, ts, body)
            .filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & text_present(body))
            .dropDuplicates([key, ts, body]))


def labelled_anchors(spine: DataFrame, clean: DataFrame, key: str = "UserLoanId",
                     ts: str = "CreatedAt") -> DataFrame:
    """Distinct ``(key, ts)`` of the spine that have a clean message at exactly that time."""
    return (spine.select(key, ts).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
            .dropDuplicates([key, ts])
            .join(clean.select(key, ts), on=[key, ts], how="left_semi"))


# -- J1 + A1 ----------------------------------------------------------------------------------

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def _bucket(c: Column, width_seconds: int) -> Column:
    """Wall-clock seconds since the epoch, floored to ``width_seconds``: monotone, no time zone."""
    secs = F.timestamp_diff("SECOND", F.expr(_EPOCH), c)
    return F.floor(secs / F.lit(width_seconds)).cast("long")


def _probes(anchors: DataFrame, clean: DataFrame, days: int, width: int) -> DataFrame:
    """Anchors ``(_k, _at)`` once per bucket ``_b`` that their window touches. Where a window has over
    ``PROBES`` buckets, anchors meet the filled buckets of ``clean`` ``(_k, _b, ...)`` first, in blocks of about
    the root of a window's buckets, and only get those. Spark's sizes do not count the copies that ``explode``
    makes, so that join is named a merge join: the copies never become one broadcast table."""
    last = _bucket(F.col("_at"), width)
    first = _bucket(F.col("_at") - F.make_dt_interval(days=F.lit(days)), width)
    touched = days * 86400 // width + 2
    if touched <= PROBES:
        return anchors.withColumn("_b", F.explode(F.sequence(first, last)))

    def block(b: Column) -> Column:
        return F.floor(b / F.lit(math.isqrt(touched))).cast("long")
    filled = (clean.select("_k", "_b").distinct().groupBy("_k", block(F.col("_b")).alias("_block"))
              .agg(F.collect_list("_b").alias("_bs")))
    blocks = anchors.withColumn("_block", F.explode(F.sequence(block(first), block(last))))
    met = blocks.hint("merge").join(filled, on=["_k", "_block"])
    return met.select("_k", "_at", F.explode(F.filter("_bs", lambda b: (b >= first) & (b <= last))).alias("_b"))


def distinct_sorted_concat(body: Column | str, separator: str) -> Column:
    """``STRING_AGG(DISTINCT body, sep ORDER BY body)``: distinct texts in byte order."""
    b = F.col(body) if isinstance(body, str) else body
    return F.array_join(F.array_sort(F.collect_set(b)), separator)


def concat_distinct_per_anchor(pairs: DataFrame, keys: list[str], body: str, separator: str, out: str,
                               flags: dict[str, Column] | None = None) -> DataFrame:
    """A1 over a pair table: one row per ``keys`` with its distinct ``body`` values in byte order.

    Distinct ``(keys, body)`` first, as a code-generated hash aggregate with map-side partial
    aggregation (copies of a text collapse before the shuffle and it spills when large); then the
    sorted list per anchor. A single ``collect_set`` aggregate would hold a set object per anchor
    and fall back to sorting every pair once a task sees more than a few anchors, which is the
    hot-key case. ``flags`` are integer columns reduced by ``max`` per anchor."""
    flags = flags or {}
    d = pairs.groupBy(*keys, body).agg(*[F.max(c).alias(n) for n, c in flags.items()]) if flags \
        else pairs.select(*keys, body).distinct()
    return d.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(body)), separator).alias(out),
                                *[F.max(n).alias(n) for n in flags])


def band_pairs(anchors: DataFrame, clean: DataFrame, days: int, key: str = "UserLoanId",
               ts: str = "CreatedAt", body: str = "body", bucket_seconds: int | None = None) -> DataFrame:
    """``(key, ts, body)`` for every anchor and every clean message of its key with
    ``anchor.ts - days <= msg.ts <= anchor.ts``. Equi-join on ``(key, bucket)`` plus the exact range."""
    if days < 0:
        raise ValueError("days must be >= 0")
    width = int(bucket_seconds or default_bucket_seconds(days))
    if width <= 0:
        raise ValueError("bucket_seconds must be > 0")
    lookback = F.make_dt_interval(days=F.lit(days))
    m = (clean.select(F.col(key).alias("_k"), F.col(ts).alias("_mt"), F.col(body).alias("_body"))
         .withColumn("_b", _bucket(F.col("_mt"), width)))
    a = _probes(anchors.select(F.col(key).alias("_k"), F.col(ts).alias("_at")), m, days, width)
    j = a.join(m, on=["_k", "_b"], how="inner").filter(
        (F.col("_mt") <= F.col("_at")) & (F.col("_mt") >= F.col("_at") - lookback))
    return j.select(F.col("_k").alias(key), F.col("_at").alias(ts), F.col("_body").alias(body))


def lookback_text(messages: DataFrame, spine: DataFrame | None, days: int,
                  separator: str = DEFAULT_SEPARATOR, key: str = "UserLoanId", ts: str = "CreatedAt",
                  body: str = "body", method: str = "bucketed", bucket_seconds: int | None = None,
                  out: str = "concatenated_body", salts: int = DEFAULT_SALTS,
                  anchor_range: tuple[str, str] | None = None, prefilter: bool = False,
                  split_hot: bool = False) -> DataFrame:
    """A2: one row per labelled anchor ``(key, ts, concatenated_body)``.

    ``spine`` limits the keys and, except for ``method='full'``, the anchors. With ``spine=None``
    every clean message time is an anchor. ``salts`` is how many ways a hot key's messages are split (``rew``;
    ``bucketed`` with ``split_hot``, there per key and bucket); the anchors of hot keys alone are copied that
    many times. ``anchor_range`` (half-open dates) limits the anchors, and so the messages to
    ``[start - days, end)``, a filter the scan can use. ``prefilter`` tests messages against a Bloom filter
    of the spine's keys before anything is shuffled; it pays where the spine has few of the messages' keys.
    """
    if salts < 1:
        raise ValueError("salts must be >= 1")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if days < 0:
        raise ValueError("days must be >= 0")
    require_columns(messages, key, ts, body, what="messages")
    if anchor_range is not None:
        lo, hi = (parse_date(x) for x in anchor_range)
        messages = messages.filter((F.col(ts) >= lo - F.make_dt_interval(days=F.lit(days))) & (F.col(ts) < hi))
        spine = spine if spine is None else date_range(spine, *anchor_range, ts)
    if prefilter and spine is not None:
        messages = key_filter(messages, spine, key)
    if method == "bucketed" and spine is not None:
        return _lookback_bucketed(messages, spine, days, separator, key, ts, body, bucket_seconds, out,
                                  salts if split_hot else 1)
    if spine is None:
        msgs = messages
    elif method == "rew":  # the (key, salt) join drops other keys' messages
        msgs = messages
    else:  # broadcast or shuffled as Spark's own sizes say; AQE splits a skewed key's partition
        msgs = fetch_keys(messages, spine, key)
    clean = clean_messages(msgs, key, ts, body)
    every = spine is None or method == "full"  # every message is an anchor
    if method in ("frame", "full"):
        # width >= look-back: a window reaches back at most into the previous bucket, whose
        # messages are copied into this one as context (only home rows are kept as results)
        # Anchor rows are marked before the window (a message-sized join), so only their sets
        # travel afterwards; a clean row at a spine time is exactly a labelled anchor.
        width = max(int(days), 1) * 86400
        if every:
            c = clean.withColumn("_a", F.lit(True))
        else:
            marks = (spine.select(key, ts).filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
                     .dropDuplicates([key, ts]).withColumn("_a", F.lit(True)))
            c = clean.join(marks, on=[key, ts], how="left")
        home = _bucket(F.col(ts), width)
        c = (c.withColumn("_home", home)
             .withColumn("_pb", F.explode(F.array(F.col("_home"), F.col("_home") + 1))))
        w = (f"PARTITION BY `{key}`, _pb ORDER BY `{ts}` "
             f"RANGE BETWEEN INTERVAL {int(days)} DAYS PRECEDING AND CURRENT ROW")
        sets = (c.withColumn("_set", F.expr(f"collect_set(`{body}`) OVER ({w})"))
                .filter((F.col("_pb") == F.col("_home")) & F.col("_a").isNotNull()))
        return (sets.dropDuplicates([key, ts])
                .select(key, ts, F.array_join(F.array_sort("_set"), separator).alias(out)))
    anchors = clean.select(key, ts).dropDuplicates([key, ts]) if every else labelled_anchors(spine, clean, key, ts)
    if method == "rew":
        lookback = F.make_dt_interval(days=F.lit(days))
        a, m = _salted(anchors.select(F.col(key).alias("_k"), F.col(ts).alias("_at")),
                       clean.select(F.col(key).alias("_k"), F.col(ts).alias("_mt"), F.col(body).alias("_body")),
                       hot_groups(messages, key), salts, "_k")
        pairs = (a.join(m, on=["_k", "_salt"]).filter((F.col("_mt") <= F.col("_at"))
                                                     & (F.col("_mt") >= F.col("_at") - lookback))
                 .select(F.col("_k").alias(key), F.col("_at").alias(ts), F.col("_body").alias(body)))
    else:  # bucketed without a spine
        pairs = band_pairs(anchors, clean, days, key, ts, body, bucket_seconds)
    return concat_distinct_per_anchor(pairs, [key, ts], body, separator, out)


def default_bucket_seconds(days: int) -> int:
    """A quarter of the look-back: each anchor probes at most 5-6 buckets, candidate pairs outside
    the exact window stay under ~25%, and a hot key is spread over 4 buckets per window length."""
    return max(1, max(days, 1) * 86400 // 4)


def _lookback_bucketed(messages: DataFrame, spine: DataFrame, days: int, separator: str, key: str,
                       ts: str, body: str, bucket_seconds: int | None, out: str, salts: int = 1) -> DataFrame:
    """The skew-safe default plan.

    * clean messages are hashed on ``(key, bucket)`` for the band join, which also drops the keys
      outside the spine; a skewed ``(key, bucket)`` partition is split by AQE's skew-join handling;
    * spine anchors are deduplicated and sent to every bucket their window touches (with fine buckets: to
      every one that holds a message of their key);
    * copies of a message collapse map-side in the distinct ``(anchor, text)`` of the aggregate;
    * the anchor-existence test (a clean message at exactly the anchor time) is a flag in the
      final aggregate, not a separate semi-join: the anchor's own message is always in its window.
    """
    width = int(bucket_seconds or default_bucket_seconds(days))
    if width <= 0:
        raise ValueError("bucket_seconds must be > 0")
    lookback = F.make_dt_interval(days=F.lit(days))
    m = (messages.select(F.col(key).alias("_k"), F.col(ts).alias("_mt"), F.col(body).alias("_body"))
         .filter(F.col("_k").isNotNull() & F.col("_mt").isNotNull() & text_present("_body"))
         .withColumn("_b", _bucket(F.col("_mt"), width)))
    a = _probes(spine.select(F.col(key).alias("_k"), F.col(ts).alias("_at"))
                .filter(F.col("_k").isNotNull() & F.col("_at").isNotNull())
                .dropDuplicates(["_k", "_at"]), m, days, width)
    on = ["_k", "_b"]
    if salts > 1:
        buckets = messages.select(F.col(key).alias("_k"), _bucket(F.col(ts), width).alias("_b"))
        a, m = _salted(a, m, hot_groups(buckets, "_k", "_b"), salts, "_k", "_b")
        on = [*on, "_salt"]
    pairs = a.join(m, on=on, how="inner").filter(
        (F.col("_mt") <= F.col("_at")) & (F.col("_mt") >= F.col("_at") - lookback))
    agg = concat_distinct_per_anchor(pairs, ["_k", "_at"], "_body", separator, out,
                                     {"_self": (F.col("_mt") == F.col("_at")).cast("int")})
    return agg.filter(F.col("_self") == 1).select(F.col("_k").alias(key), F.col("_at").alias(ts), out)


# -- J2 / F4 / F5 / F6 ------------------------------------------------------------------------

def label_join(texts: DataFrame, labels: DataFrame, key: str = "UserLoanId",
               ts: str = "CreatedAt") -> DataFrame:
    """Inner equi-join on ``(key, ts)``; duplicate label rows fan out, null keys never match."""
    require_columns(labels, key, ts, what="labels")
    return texts.join(labels, on=[key, ts], how="inner")


def truncate_tokens(df: DataFrame, max_tokens: int | None, text: str = "concatenated_body",
                    tokenizer: str = "words") -> DataFrame:
    """F5 then F4: replace ``text`` by its first ``max_tokens`` tokens and add ``token_count``
    of the replaced text; ``max_tokens`` None keeps whole texts. ``tokenizer='words'`` runs natively;
    otherwise a tokenizer file path for an Arrow UDF that tokenizes once per text."""
    require_columns(df, text, what="dataset")
    max_tokens = (1 << 31) - 1 if max_tokens is None else max_tokens
    if tokenizer == "words":
        # counted once: a longer text is cut to exactly ``max_tokens`` tokens
        return (df.withColumn("_n", word_token_count(text)).withColumn(text, word_truncate(text, max_tokens, F.col("_n")))
                .withColumn("token_count", F.least("_n", F.lit(max_tokens).cast("long"))).drop("_n"))
    r = bpe_truncate_and_count(text, max_tokens, tokenizer)
    return (df.withColumn("_tc", r)
            .withColumn(text, F.col("_tc.text"))
            .withColumn("token_count", F.col("_tc.token_count"))
            .drop("_tc"))


def prepare_text(texts: DataFrame, labels: DataFrame, max_tokens: int | None = 512, key: str = "UserLoanId",
                 ts: str = "CreatedAt", text: str = "concatenated_body", tokenizer: str = "words") -> DataFrame:
    """F6 = J2 -> F5 -> F4."""
    return truncate_tokens(label_join(texts, labels, key, ts), max_tokens, text, tokenizer)


def build_dataset(messages: DataFrame, spine: DataFrame, days: int, max_tokens: int | None = 512,
                  separator: str = DEFAULT_SEPARATOR, key: str = "UserLoanId", ts: str = "CreatedAt",
                  body: str = "body", label: str = "DefaultDPD21", method: str = "bucketed",
                  tokenizer: str = "words", bucket_seconds: int | None = None,
                  anchor_range: tuple[str, str] | None = None, prefilter: bool = False) -> DataFrame:
    """The stage-1 dataset: look-back text per labelled anchor, label, truncated text (whole with
    ``max_tokens`` None), token count."""
    require_columns(spine, key, ts, label, what="spine")
    texts = lookback_text(messages, spine, days, separator, key, ts, body, method, bucket_seconds,
                          anchor_range=anchor_range, prefilter=prefilter)
    return prepare_text(texts, spine.select(key, ts, label), max_tokens, key, ts, tokenizer=tokenizer)
