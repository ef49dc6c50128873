"""Registered queries (Spark side) and their DuckDB twins, one per inventory row.

Every query reads the driver tables at ``sf_dir`` (or what Spark derives from them) in full.
Doubles are rounded to 6 digits on both sides; column names match exactly.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import text_present
from vellum.operators import lookback as LB
from vellum.plans import analogs as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# -- shared SQL fragments (DuckDB) ------------------------------------------------------------
NL_SEP = "chr(10) || '---' || chr(10)"
MSGS = "SELECT user_id AS UserLoanId, ts AS CreatedAt, concat_ws(' ', event_type, props) AS body FROM events"
MSGS_BLANK = ("SELECT user_id AS UserLoanId, ts AS CreatedAt, CASE WHEN event_type = 'error' THEN ' ' "
              "ELSE concat_ws(' ', event_type, props) END AS body FROM events")
SPINE = ("SELECT user_id AS UserLoanId, ts AS CreatedAt, CAST(value > 50 AS INTEGER) AS DefaultDPD21 "
         "FROM events WHERE event_type = 'signup'")
SPINE_BLANK = ("SELECT user_id AS UserLoanId, ts AS CreatedAt, CAST(value > 50 AS INTEGER) AS DefaultDPD21 "
               "FROM events WHERE event_type IN ('signup', 'error')")


def lookback_sql(msgs: str, spine: str, days: int, sep_sql: str = NL_SEP) -> str:
    """Anchors first: spine rows at whose time a clean message exists; one range join gathers the
    texts of each anchor, and the sorted distinct list becomes its text."""
    return f"""
WITH labelled AS ({spine}),
clean AS (SELECT * FROM ({msgs}) WHERE trim(body) <> ''),
anchors AS (
  SELECT DISTINCT UserLoanId, CreatedAt FROM labelled
  SEMI JOIN clean USING (UserLoanId, CreatedAt)),
windows AS (
  SELECT a.UserLoanId, a.CreatedAt, list_sort(list_distinct(list(c.body))) AS texts
  FROM anchors a JOIN clean c ON c.UserLoanId = a.UserLoanId
   AND c.CreatedAt BETWEEN a.CreatedAt - INTERVAL '{days} days' AND a.CreatedAt
  GROUP BY a.UserLoanId, a.CreatedAt)
SELECT UserLoanId, CreatedAt, array_to_string(texts, {sep_sql}) AS concatenated_body, DefaultDPD21
FROM windows JOIN labelled USING (UserLoanId, CreatedAt)"""


def words_sql(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[^ \\t\\n\\r]+')"


def truncate_sql(x: str, n: int) -> str:
    w = words_sql(x)
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN len({w}) <= {n} THEN {x} "
            f"ELSE array_to_string({w}[1:{n}], ' ') END")


# -- A2 flagship ------------------------------------------------------------------------------

def _lookback_labelled(spark, sf_dir, method="bucketed", blanks=False, bucket_seconds=None):
    msgs = A.messages(spark, sf_dir, blanks=blanks)
    spine = A.spine(spark, sf_dir, blank_anchors=blanks)
    texts = LB.lookback_text(msgs, spine, A.LOOKBACK_DAYS, method=method, bucket_seconds=bucket_seconds)
    return LB.label_join(texts, spine)


_A2_SQL = lookback_sql(MSGS, SPINE, A.LOOKBACK_DAYS)


@register("a2_lookback_text", _A2_SQL)
def a2_lookback_text(spark, sf_dir):
    return _lookback_labelled(spark, sf_dir, "bucketed")


@register("a2_lookback_text_rew", _A2_SQL)
def a2_lookback_text_rew(spark, sf_dir):
    return _lookback_labelled(spark, sf_dir, "rew")


@register("a2_lookback_text_frame", _A2_SQL)
def a2_lookback_text_frame(spark, sf_dir):
    return _lookback_labelled(spark, sf_dir, "frame")


@register("a2_lookback_text_full", _A2_SQL)
def a2_lookback_text_full(spark, sf_dir):
    return _lookback_labelled(spark, sf_dir, "full")


@register("a2_lookback_text_hourly_buckets", _A2_SQL)
def a2_lookback_text_hourly_buckets(spark, sf_dir):
    return _lookback_labelled(spark, sf_dir, "bucketed", bucket_seconds=3600)


@register("a2_lookback_text_hot_split", _A2_SQL)
def a2_lookback_text_hot_split(spark, sf_dir):
    msgs, spine = A.messages(spark, sf_dir), A.spine(spark, sf_dir)
    return LB.label_join(LB.lookback_text(msgs, spine, A.LOOKBACK_DAYS, split_hot=True, prefilter=True), spine)


@register("a2_lookback_blank_anchors", lookback_sql(MSGS_BLANK, SPINE_BLANK, A.LOOKBACK_DAYS))
def a2_lookback_blank_anchors(spark, sf_dir):
    return _lookback_labelled(spark, sf_dir, "bucketed", blanks=True)


# -- F6: the stage-1 dataset (flagship end to end) --------------------------------------------

@register("f6_prepare_text", f"""
WITH lb AS ({_A2_SQL})
SELECT UserLoanId, CreatedAt, DefaultDPD21,
       {truncate_sql('concatenated_body', A.MAX_TOKENS)} AS concatenated_body,
       CAST(len({words_sql(truncate_sql('concatenated_body', A.MAX_TOKENS))}) AS BIGINT) AS token_count
FROM lb""")
def f6_prepare_text(spark, sf_dir):
    return LB.build_dataset(A.messages(spark, sf_dir), A.spine(spark, sf_dir), A.LOOKBACK_DAYS,
                            max_tokens=A.MAX_TOKENS)


# -- P1..P9 -----------------------------------------------------------------------------------
from vellum.functions import text as TX  # noqa: E402
from vellum.operators import profile as PR  # noqa: E402

_TR, _TE = A.TRAIN_RANGE, A.TEST_RANGE


def _split(spark, sf_dir):
    return LB.split_spine(A.spine(spark, sf_dir), _TR[0], _TR[1], _TE[0], _TE[1])


@register("p1_split_train", f"WITH spine AS ({SPINE}) SELECT * FROM spine "
                            f"WHERE CreatedAt >= TIMESTAMP '{_TR[0]}' AND CreatedAt < TIMESTAMP '{_TR[1]}'")
def p1_split_train(spark, sf_dir):
    return _split(spark, sf_dir)[0]


@register("p1_split_test", f"WITH spine AS ({SPINE}) SELECT * FROM spine "
                           f"WHERE CreatedAt >= TIMESTAMP '{_TE[0]}' AND CreatedAt < TIMESTAMP '{_TE[1]}'")
def p1_split_test(spark, sf_dir):
    return _split(spark, sf_dir)[1]


@register("p2_projection", f"WITH spine AS ({SPINE}) SELECT UserLoanId, DefaultDPD21 FROM spine")
def p2_projection(spark, sf_dir):
    return A.spine(spark, sf_dir).select("UserLoanId", "DefaultDPD21")


_TRAIN_KEYS_SQL = (f"SELECT user_id FROM events WHERE event_type = 'signup' "
                   f"AND ts >= TIMESTAMP '{_TR[0]}' AND ts < TIMESTAMP '{_TR[1]}'")
# keys of the spine rows with a high value: not every key of the messages
_HIGH_KEYS_SQL = (f"SELECT user_id FROM events WHERE event_type = 'signup' AND value > 200 "
                  f"AND ts >= TIMESTAMP '{_TR[0]}' AND ts < TIMESTAMP '{_TR[1]}'")


def _some_keys(spark, sf_dir):
    ev = A.table(spark, sf_dir, "events").filter((F.col("event_type") == "signup") & (F.col("value") > 200))
    return LB.date_range(ev.select(F.col("user_id").alias("UserLoanId"), F.col("ts").alias("CreatedAt")), *_TR)


@register("p3_key_semi_join", f"WITH msgs AS ({MSGS}) SELECT * FROM msgs WHERE UserLoanId IN ({_TRAIN_KEYS_SQL})")
def p3_key_semi_join(spark, sf_dir):
    return LB.fetch_keys(A.messages(spark, sf_dir), _split(spark, sf_dir)[0])


@register("p3_key_filter", f"WITH msgs AS ({MSGS}) SELECT * FROM msgs WHERE UserLoanId IN ({_HIGH_KEYS_SQL})")
def p3_key_filter(spark, sf_dir):
    """The Bloom filter before the exact semi-join."""
    keys = _some_keys(spark, sf_dir)
    return LB.fetch_keys(LB.key_filter(A.messages(spark, sf_dir), keys), keys)


@register("p4_raw_fetch", f"SELECT * RENAME (user_id AS UserLoanId) FROM events "
                          f"WHERE user_id IN ({_TRAIN_KEYS_SQL})")
def p4_raw_fetch(spark, sf_dir):
    raw = A.table(spark, sf_dir, "events").withColumnRenamed("user_id", "UserLoanId")
    return LB.fetch_keys(raw, _split(spark, sf_dir)[0])


@register("p5_text_present", f"WITH m AS ({MSGS_BLANK}) SELECT * FROM m WHERE body IS NOT NULL AND TRIM(body) != ''")
def p5_text_present(spark, sf_dir):
    return A.messages(spark, sf_dir, blanks=True).filter(TX.text_present("body"))


@register("p6_dedup", f"WITH m AS ({MSGS_BLANK} UNION ALL {MSGS}) SELECT DISTINCT UserLoanId, CreatedAt, body FROM m "
                      f"WHERE body IS NOT NULL AND TRIM(body) != ''")
def p6_dedup(spark, sf_dir):
    # all but the blanked messages come twice
    return LB.clean_messages(PR.union_all(A.messages(spark, sf_dir, blanks=True), A.messages(spark, sf_dir)))


_PADDED_SQL = "repeat(' ' || chr(160), {n}) || {x} || repeat(chr(12288) || ' ', {n})"


@register("p7_with_column", f"WITH m AS ({MSGS}), p AS (SELECT UserLoanId, CreatedAt, "
                            f"{_PADDED_SQL.format(n='(UserLoanId % 3)', x='body')} AS body FROM m) "
                            f"SELECT UserLoanId, CreatedAt, TRIM(body) AS body FROM p")
def p7_with_column(spark, sf_dir):
    m = A.messages(spark, sf_dir).withColumn("body", A.padded(F.col("body"), F.col("UserLoanId") % 3))
    return m.withColumn("body", TX.unicode_trim("body"))


@register("p8_casts", f"WITH spine AS ({SPINE}) SELECT CAST(UserLoanId AS VARCHAR) AS UserLoanId, "
                      f"CAST(DefaultDPD21 AS INTEGER) AS DefaultDPD21 FROM spine")
def p8_casts(spark, sf_dir):
    sp = A.spine(spark, sf_dir)
    return sp.select(F.col("UserLoanId").cast("string").alias("UserLoanId"),
                     F.col("DefaultDPD21").cast("int").alias("DefaultDPD21"))


# -- J1 / J2 / J3 -----------------------------------------------------------------------------

_ANCHORS_SQL = f"""
WITH msgs AS ({MSGS}), spine AS ({SPINE}),
clean AS (SELECT DISTINCT UserLoanId, CreatedAt, body FROM msgs WHERE body IS NOT NULL AND TRIM(body) != ''),
anchors AS (SELECT DISTINCT UserLoanId, CreatedAt FROM spine
            WHERE (UserLoanId, CreatedAt) IN (SELECT (UserLoanId, CreatedAt) FROM clean))"""


@register("j1_band_pairs", _ANCHORS_SQL + f"""
SELECT a.UserLoanId, a.CreatedAt, c.body FROM anchors a JOIN clean c
  ON a.UserLoanId = c.UserLoanId AND c.CreatedAt <= a.CreatedAt
 AND c.CreatedAt >= a.CreatedAt - INTERVAL '{A.LOOKBACK_DAYS} days'""")
def j1_band_pairs(spark, sf_dir):
    clean = LB.clean_messages(A.messages(spark, sf_dir))
    anchors = LB.labelled_anchors(A.spine(spark, sf_dir), clean)
    return LB.band_pairs(anchors, clean, A.LOOKBACK_DAYS)


@register("j2_label_join_fanout", f"""
WITH lb AS ({lookback_sql(MSGS, SPINE, A.LOOKBACK_DAYS)}),
spine AS ({SPINE})
SELECT lb.UserLoanId, lb.CreatedAt, lb.concatenated_body, s.DefaultDPD21 AS label_copy
FROM lb JOIN (SELECT * FROM spine UNION ALL SELECT * FROM spine) s
  ON lb.UserLoanId = s.UserLoanId AND lb.CreatedAt = s.CreatedAt""")
def j2_label_join_fanout(spark, sf_dir):
    sp = A.spine(spark, sf_dir)
    texts = LB.lookback_text(A.messages(spark, sf_dir), sp, A.LOOKBACK_DAYS)
    dup = PR.union_all(sp, sp).withColumnRenamed("DefaultDPD21", "label_copy")
    return LB.label_join(texts, dup)


@register("j2_long_texts", "SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j2_long_texts(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(A.table(spark, sf_dir, "labels"), on="doc_id", how="inner")


@register("j3_anchor_exists", f"""
WITH msgs AS ({MSGS_BLANK}), spine AS ({SPINE_BLANK})
SELECT DISTINCT UserLoanId, CreatedAt FROM spine
SEMI JOIN (SELECT * FROM msgs WHERE TRIM(body) != '') c USING (UserLoanId, CreatedAt)""")
def j3_anchor_exists(spark, sf_dir):
    # half of the spine's times hold only blank messages
    clean = LB.clean_messages(A.messages(spark, sf_dir, blanks=True))
    return LB.labelled_anchors(A.spine(spark, sf_dir, blank_anchors=True), clean)


# -- A1, A3..A8 -------------------------------------------------------------------------------

@register("a1_distinct_concat", """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day,
       STRING_AGG(DISTINCT event_type, '--' ORDER BY event_type) AS types
FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d')""")
def a1_distinct_concat(spark, sf_dir):
    ev = A.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return LB.concat_distinct_per_anchor(ev, ["user_id", "day"], "event_type", "--", "types")


@register("a3_label_distribution", f"WITH s AS ({SPINE}) SELECT DefaultDPD21, COUNT(*) AS count FROM s GROUP BY 1")
def a3_label_distribution(spark, sf_dir):
    return PR.label_distribution(A.spine(spark, sf_dir))


@register("a3_label_dense", """
WITH c AS (SELECT label * label AS label, COUNT(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY ALL)
SELECT CAST(g.label AS INTEGER) AS label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM (SELECT unnest(range(0, (SELECT max(label) FROM c) + 1)) AS label) g LEFT JOIN c ON g.label = c.label""")
def a3_label_dense(spark, sf_dir):
    squares = A.table(spark, sf_dir, "embeddings").select((F.col("label") * F.col("label")).alias("label"))
    return PR.label_distribution_dense(squares, "label")  # most of 0..81 do not occur


@register("a4_class_balance", f"""
WITH s AS ({SPINE}), c AS (SELECT count_if(DefaultDPD21 = 0) AS n0, count_if(DefaultDPD21 = 1) AS n1 FROM s)
SELECT n0, n1, round(n0 * 100.0 / (n0 + n1), 6) AS pct0, round(n1 * 100.0 / (n0 + n1), 6) AS pct1,
       round(n0 / n1, 6) AS scale_pos_weight FROM c""")
def a4_class_balance(spark, sf_dir):
    cb = PR.class_balance(A.spine(spark, sf_dir))
    return cb.select("n0", "n1", *[F.round(c, 6).alias(c) for c in ("pct0", "pct1", "scale_pos_weight")])


_F6_SQL = f"""
WITH lb AS ({_A2_SQL})
SELECT UserLoanId, CreatedAt, DefaultDPD21, concatenated_body,
       CAST(len({words_sql('concatenated_body')}) AS BIGINT) AS token_count
FROM lb"""


def _dataset(spark, sf_dir):
    """The labelled look-back texts, whole."""
    return LB.build_dataset(A.messages(spark, sf_dir), A.spine(spark, sf_dir), A.LOOKBACK_DAYS, max_tokens=None)


@register("a5_batch_stats", f"""
WITH msgs AS ({MSGS}), d AS ({_F6_SQL}),
before AS (
  SELECT DISTINCT UserLoanId, CreatedAt FROM msgs
  WHERE trim(body) <> '' AND UserLoanId IN (SELECT user_id FROM events WHERE event_type = 'signup'))
SELECT (SELECT COUNT(*) FROM before) AS rows_before,
       COUNT(*) AS rows_after, min(token_count) AS min_tokens, max(token_count) AS max_tokens,
       round(avg(token_count), 6) AS mean_tokens FROM d""")
def a5_batch_stats(spark, sf_dir):
    # one look-back row per clean message time of a spine key, before the label join
    keyed = LB.fetch_keys(A.messages(spark, sf_dir), A.spine(spark, sf_dir))
    before = keyed.where(text_present("body")).select("UserLoanId", "CreatedAt").distinct()
    st = PR.batch_stats(before, _dataset(spark, sf_dir))
    return st.withColumn("mean_tokens", F.round("mean_tokens", 6))


@register("a6_dataset_profile", f"""
WITH d AS ({_F6_SQL})
SELECT 'train' AS dataset, (SELECT COUNT(*) FROM d) AS rows,
       ['UserLoanId', 'CreatedAt', 'concatenated_body', 'DefaultDPD21', 'token_count'] AS columns,
       DefaultDPD21 AS label, COUNT(*) AS count FROM d GROUP BY DefaultDPD21""")
def a6_dataset_profile(spark, sf_dir):
    return PR.dataset_profile(_dataset(spark, sf_dir), "train")


@register("a7_distinct_labels", "SELECT DISTINCT label FROM embeddings")
def a7_distinct_labels(spark, sf_dir):
    return PR.distinct_labels(A.table(spark, sf_dir, "embeddings"), "label")


@register("a8_balanced_weights", f"""
WITH s AS ({SPINE}), c AS (SELECT DefaultDPD21, COUNT(*) AS nc FROM s GROUP BY 1)
SELECT s.*, round((SELECT COUNT(*) FROM s) / ((SELECT COUNT(*) FROM c) * c.nc), 6) AS weight
FROM s JOIN c ON s.DefaultDPD21 = c.DefaultDPD21""")
def a8_balanced_weights(spark, sf_dir):
    return PR.balanced_weights(A.spine(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


# -- O1..O3, U1 -------------------------------------------------------------------------------

@register("o1_order_by_key_time", _A2_SQL + "\nORDER BY 1, 2")
def o1_order_by_key_time(spark, sf_dir):
    return _lookback_labelled(spark, sf_dir).orderBy("UserLoanId", "CreatedAt")


@register("o2_seeded_order", f"""
SELECT *, md5('42|' || CAST(UserLoanId AS VARCHAR)) AS order_key FROM ({SPINE}) ORDER BY order_key""")
def o2_seeded_order(spark, sf_dir):
    return PR.seeded_order(A.spine(spark, sf_dir), "UserLoanId", seed=42)


@register("o3_batches", f"""
WITH s AS ({SPINE}),
h AS (SELECT *, md5(concat_ws('|', '42', UserLoanId, strftime(CreatedAt, '%Y-%m-%d %H:%M:%S.%f'), DefaultDPD21)) AS h
      FROM s)
SELECT UserLoanId, CreatedAt, DefaultDPD21, (row_number() OVER (ORDER BY h) - 1) // 64 AS batch_id FROM h""")
def o3_batches(spark, sf_dir):
    return PR.assign_batches(A.spine(spark, sf_dir), batch_size=64, seed=42)


@register("u1_union_train_test", f"""
WITH s AS ({SPINE})
SELECT * FROM s WHERE CreatedAt >= TIMESTAMP '{_TR[0]}' AND CreatedAt < TIMESTAMP '{_TR[1]}'
UNION ALL
SELECT * FROM s WHERE CreatedAt >= TIMESTAMP '{_TE[0]}' AND CreatedAt < TIMESTAMP '{_TE[1]}'""")
def u1_union_train_test(spark, sf_dir):
    tr, te = _split(spark, sf_dir)
    return PR.union_all(tr, te)


# -- F1..F5, F7 -------------------------------------------------------------------------------

@register("f1_trim", f"WITH p AS (SELECT conv_id, turn, {_PADDED_SQL.format(n='(turn % 3)', x='text')} AS text "
                     f"FROM conversations) SELECT conv_id, turn, TRIM(text) AS text FROM p")
def f1_trim(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").withColumn("text", A.padded(F.col("text"), F.col("turn") % 3))
    return c.select("conv_id", "turn", TX.unicode_trim("text").alias("text"))


@register("f2_interval", f"SELECT event_id, ts - INTERVAL '{A.LOOKBACK_DAYS} days' AS window_start FROM events")
def f2_interval(spark, sf_dir):
    ev = A.table(spark, sf_dir, "events")
    return ev.select("event_id", (F.col("ts") - F.make_dt_interval(days=F.lit(A.LOOKBACK_DAYS))).alias("window_start"))


@register("f3_date_parse", f"""
SELECT event_type, COUNT(*) AS n FROM events
WHERE ts >= TIMESTAMP '{_TE[0]}' AND ts < TIMESTAMP '{_TE[1]}' GROUP BY event_type""")
def f3_date_parse(spark, sf_dir):
    ev = A.table(spark, sf_dir, "events")
    return (ev.filter((F.col("ts") >= TX.parse_date(_TE[0])) & (F.col("ts") < TX.parse_date(_TE[1])))
            .groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))


@register("f4_token_count_words", f"SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS token_count FROM documents")
def f4_token_count_words(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.word_token_count("text").alias("token_count"))


@register("f5_truncate_words", f"SELECT doc_id, {truncate_sql('text', 256)} AS text FROM documents")
def f5_truncate_words(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", TX.word_truncate("text", 256).alias("text"))


@register("f5_truncate_bpe")
def f5_truncate_bpe(spark, sf_dir):
    """F4+F5 with a byte-level BPE tokenizer (Arrow UDF, one encode per text); rows-only check."""
    d = A.table(spark, sf_dir, "documents")
    r = TX.bpe_truncate_and_count("text", 256)
    return d.select("doc_id", r.text.alias("text"), r.token_count.alias("token_count"))


# -- V1..V6, O4, P9 ---------------------------------------------------------------------------
from vellum.operators import metrics as MT  # noqa: E402

SCORES = """SELECT m.model, CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'test' END AS split,
       CAST(label < 3 AS INTEGER) AS label,
       floor(CAST(embedding[m.i + 1] AS DOUBLE) * 100) / 100 AS score
FROM embeddings, (VALUES ('m0', 0), ('m1', 1), ('m2', 2)) m(model, i)"""
SCORES_P = f"SELECT *, CAST(score > 0 AS INTEGER) AS prediction FROM ({SCORES})"
_GROUPS = f"""
WITH s AS ({SCORES}),
g AS (SELECT model, split, score, SUM(label) AS pos, SUM(1 - label) AS neg FROM s GROUP BY ALL)"""
_AUC_SQL = _GROUPS + """,
c AS (SELECT *, coalesce(SUM(neg) OVER (PARTITION BY model, split ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)
SELECT model, split, SUM(pos * (nb + 0.5 * neg)) / (SUM(pos) * SUM(neg)) AS auc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
FROM c GROUP BY model, split"""


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@register("v1_roc_auc", f"SELECT model, split, round(auc, 6) AS auc, n_pos, n_neg FROM ({_AUC_SQL})")
def v1_roc_auc(spark, sf_dir):
    return _r6(MT.roc_auc(A.scores(spark, sf_dir), by=["model", "split"]), "auc")


@register("v2_roc_curve", _GROUPS + """,
c AS (SELECT *, SUM(pos) OVER w AS tps, SUM(neg) OVER w AS fps,
             SUM(pos) OVER (PARTITION BY model, split) AS P, SUM(neg) OVER (PARTITION BY model, split) AS N
      FROM g WINDOW w AS (PARTITION BY model, split ORDER BY score DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT model, split, round(fps / N, 6) AS fpr, round(tps / P, 6) AS tpr, score AS threshold FROM c
UNION ALL SELECT DISTINCT model, split, 0.0, 0.0, 'inf'::DOUBLE FROM g""")
def v2_roc_curve(spark, sf_dir):
    return _r6(MT.roc_curve(A.scores(spark, sf_dir), by=["model", "split"]), "fpr", "tpr")


@register("v2_roc_curve_dropped", _GROUPS + """,
c AS (SELECT *, SUM(pos) OVER w AS tps, SUM(neg) OVER w AS fps,
             SUM(pos) OVER (PARTITION BY model, split) AS P, SUM(neg) OVER (PARTITION BY model, split) AS N
      FROM g WINDOW w AS (PARTITION BY model, split ORDER BY score DESC
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT *, LAG(fps) OVER v AS pf, LAG(tps) OVER v AS pt, LEAD(fps) OVER v AS nf, LEAD(tps) OVER v AS nt
      FROM c WINDOW v AS (PARTITION BY model, split ORDER BY score DESC))
SELECT model, split, round(fps / N, 6) AS fpr, round(tps / P, 6) AS tpr, score AS threshold FROM d
WHERE pf IS NULL OR nf IS NULL OR NOT (fps - pf = nf - fps AND tps - pt = nt - tps)
UNION ALL SELECT DISTINCT model, split, 0.0, 0.0, 'inf'::DOUBLE FROM g""")
def v2_roc_curve_dropped(spark, sf_dir):
    return _r6(MT.roc_curve(A.scores(spark, sf_dir), by=["model", "split"], drop_intermediate=True), "fpr", "tpr")


_GAP_SQL = f"""
WITH a AS ({_AUC_SQL})
SELECT model, round(max(auc) FILTER (WHERE split = 'train'), 6) AS train_auc,
       round(max(auc) FILTER (WHERE split = 'test'), 6) AS test_auc,
       round(max(auc) FILTER (WHERE split = 'train') - max(auc) FILTER (WHERE split = 'test'), 6) AS gap
FROM a GROUP BY model"""


@register("v3_auc_gap", _GAP_SQL)
def v3_auc_gap(spark, sf_dir):
    return _r6(MT.auc_gap(A.scores(spark, sf_dir)), "train_auc", "test_auc", "gap")


@register("v6_model_comparison", f"""
WITH t AS ({_GAP_SQL})
SELECT *, CAST(row_number() OVER (ORDER BY test_auc DESC, model) AS INTEGER) AS rank FROM t ORDER BY rank""")
def v6_model_comparison(spark, sf_dir):
    return _r6(MT.compare_models(A.scores(spark, sf_dir)), "train_auc", "test_auc", "gap")


_CM_SQL = f"""
WITH s AS ({SCORES_P}),
cls AS (SELECT DISTINCT model, split, label AS c FROM s UNION SELECT DISTINCT model, split, prediction FROM s),
grid AS (SELECT a.model, a.split, a.c AS label, b.c AS prediction FROM cls a JOIN cls b
         ON a.model = b.model AND a.split = b.split),
cnt AS (SELECT model, split, label, prediction, COUNT(*) AS n FROM s GROUP BY ALL)
SELECT g.model, g.split, g.label, g.prediction, CAST(coalesce(cnt.n, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt USING (model, split, label, prediction)"""


@register("v4_confusion_matrix", _CM_SQL)
def v4_confusion_matrix(spark, sf_dir):
    return MT.confusion_matrix(A.scores(spark, sf_dir), by=["model", "split"])


@register("v5_classification_report", f"""
WITH cm AS ({_CM_SQL}),
tp AS (SELECT model, split, label AS c, SUM(CASE WHEN label = prediction THEN count ELSE 0 END) AS tp,
              SUM(count) AS support FROM cm GROUP BY ALL),
pp AS (SELECT model, split, prediction AS c, SUM(count) AS pred FROM cm GROUP BY ALL),
per AS (SELECT tp.*, pp.pred,
               CASE WHEN pred > 0 THEN tp / pred ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
        FROM tp JOIN pp USING (model, split, c)),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                    ELSE 0.0 END AS f1 FROM per),
agg AS (SELECT model, split, SUM(tp) AS tp, SUM(support) AS n, avg(precision) AS mp, avg(recall) AS mr,
               avg(f1) AS mf, SUM(precision * support) AS wp, SUM(recall * support) AS wr,
               SUM(f1 * support) AS wf FROM per2 GROUP BY ALL)
SELECT model, split, CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per2
UNION ALL SELECT model, split, 'accuracy', NULL, NULL, round(tp / n, 6), CAST(n AS BIGINT) FROM agg
UNION ALL SELECT model, split, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), CAST(n AS BIGINT) FROM agg
UNION ALL SELECT model, split, 'weighted avg', round(wp / n, 6), round(wr / n, 6), round(wf / n, 6),
                 CAST(n AS BIGINT) FROM agg""")
def v5_classification_report(spark, sf_dir):
    r = MT.classification_report(A.scores(spark, sf_dir), by=["model", "split"])
    return _r6(r, "precision", "recall", "f1")


@register("p9_decision", f"SELECT model, split, label, score, CAST(score > 0.05 AS INTEGER) AS decision FROM ({SCORES})")
def p9_decision(spark, sf_dir):
    s = A.scores(spark, sf_dir).drop("prediction")
    return MT.decide(s, "score", 0.05, out="decision")


# -- S1..S12 ----------------------------------------------------------------------------------
from vellum.session import scratch_path  # noqa: E402
from vellum.sources import cache as CA  # noqa: E402
from vellum.sources import catalog as CT  # noqa: E402
from vellum.sources.versions import VersionedTable  # noqa: E402


@register("s1_catalog")
def s1_catalog(spark, sf_dir):
    return CT.TableCatalog(spark, sf_dir).to_df()


@register("s2_read_full", "SELECT * FROM events")
def s2_read_full(spark, sf_dir):
    return CT.TableCatalog(spark, sf_dir).read_table("events")


def _daily_lake(spark, sf_dir):
    """The events table re-laid as an incremental table (one file per date) in the shared folder."""
    base = scratch_path(spark, "lake")
    CT.write_incremental(A.table(spark, sf_dir, "events"), f"{base}/events_daily", "ts")
    return CT.TableCatalog(spark, base)


@register("s3_read_one_date", f"SELECT * FROM events WHERE ts >= TIMESTAMP '{_TE[0]}' "
                              f"AND ts < TIMESTAMP '{_TE[0]}' + INTERVAL 1 DAY")
def s3_read_one_date(spark, sf_dir):
    return _daily_lake(spark, sf_dir).read_table("events_daily", _TE[0])


@register("s4_read_incremental_all", "SELECT * FROM events")
def s4_read_incremental_all(spark, sf_dir):
    return _daily_lake(spark, sf_dir).read_all("events_daily")


@register("s4_versioned_replace", """
SELECT event_id, ts, user_id, event_type, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN value + 1 ELSE value END AS value,
       props FROM events""")
def s4_versioned_replace(spark, sf_dir):
    """Events as a versioned table whose first ten days are then replaced in one commit."""
    ev = A.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    base = scratch_path(spark, "lake")
    table = VersionedTable(spark, f"{base}/log")
    table.replace_dates(ev, "ts")
    early = ev.filter(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    table.replace_dates(early.withColumn("value", F.col("value") + 1), "ts")
    return CT.TableCatalog(spark, base).read_all("log")


@register("s4_read_between", f"SELECT * FROM events WHERE ts >= TIMESTAMP '{_TE[0]}' AND ts < TIMESTAMP '{_TE[1]}'")
def s4_read_between(spark, sf_dir):
    """Reads only the files whose statistics meet the range."""
    lake = _daily_lake(spark, sf_dir)
    lake.update_statistics("events_daily", "ts")
    return lake.read_between("events_daily", "ts", *[_dt.datetime.fromisoformat(x) for x in _TE])


@register("s5_query_table", "SELECT event_type, COUNT(*) AS n, round(avg(value), 6) AS mean_value "
                            "FROM events GROUP BY event_type")
def s5_query_table(spark, sf_dir):
    cat = CT.TableCatalog(spark, sf_dir)
    return cat.query_table("events", "SELECT event_type, COUNT(*) AS n, round(avg(value), 6) AS mean_value "
                                     "FROM <table> GROUP BY event_type")


@register("s8_save_load", _F6_SQL)
def s8_save_load(spark, sf_dir):
    path = scratch_path(spark, "dataset")
    CA.save_data(_dataset(spark, sf_dir), path)
    return CA.load_data(spark, path)


@register("s10_materialize_set", f"WITH spine AS ({SPINE}) " + " UNION ALL ".join(
    f"SELECT *, '{n}' AS member FROM spine WHERE CreatedAt >= TIMESTAMP '{r[0]}' AND CreatedAt < TIMESTAMP '{r[1]}'"
    for n, r in (("train", _TR), ("test", _TE))))
def s10_materialize_set(spark, sf_dir):
    folder = scratch_path(spark, "sets")
    params = {"sf_dir": sf_dir, "train": _TR, "test": _TE}
    got = CA.materialize(spark, {"train": lambda: _split(spark, sf_dir)[0],
                                 "test": lambda: _split(spark, sf_dir)[1]}, folder, params)
    return got["train"].withColumn("member", F.lit("train")).unionByName(
        got["test"].withColumn("member", F.lit("test")))


@register("s11_embedding_store", "SELECT vec_id, embedding FROM embeddings")
def s11_embedding_store(spark, sf_dir):
    store = CA.EmbeddingStore(spark, scratch_path(spark, "vectors"))
    store.save(A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "raw", "all")
    return store.load("raw", "all")


# -- M1..M7 -----------------------------------------------------------------------------------
from vellum.operators import models as MD  # noqa: E402


@register("m1_standardize", """
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM e GROUP BY i)
SELECT vec_id, list(round((x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) ORDER BY i) AS z
FROM e JOIN st USING (i) GROUP BY vec_id""")
def m1_standardize(spark, sf_dir):
    em = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    st = MD.Standardizer(population=True).fit(em, "embedding")
    z = st.transform(em, "embedding", "z")
    return z.select("vec_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


def _fit_score(spark, sf_dir, preset):
    tr, te = A.vector_split(spark, sf_dir)
    fc = MD.fit_classifier(tr, "embedding", "label", preset, seed=42)
    return fc.score(tr, "train", ["vec_id"]).unionByName(fc.score(te, "test", ["vec_id"]))


@register("m2_logistic_balanced")
def m2_logistic_balanced(spark, sf_dir):
    return _fit_score(spark, sf_dir, "lr_stage2")


@register("m3_gbt_weighted")
def m3_gbt_weighted(spark, sf_dir):
    return _fit_score(spark, sf_dir, "gbt_quick")


@register("m4_mlp")
def m4_mlp(spark, sf_dir):
    return _fit_score(spark, sf_dir, "mlp")


#: Fewer trees and less patience than the configuration, for a query that ends soon; all else is as configured.
_STOPPING = {"n_estimators": 32, "early_stopping_rounds": 8, "learning_rate": 0.1}


@register("m6_gbt_early_stopping")
def m6_gbt_early_stopping(spark, sf_dir):
    tr, te = A.ruled_split(spark, sf_dir)
    fc = MD.fit_classifier(tr, "embedding", "label", "gbt_stage2", name="gbt_early_stop", **_STOPPING)
    return fc.score(tr, "train", ["vec_id"]).unionByName(fc.score(te, "test", ["vec_id"]))


@register("m7_compare_trained_models")
def m7_compare_trained_models(spark, sf_dir):
    tr, te = A.vector_split(spark, sf_dir)
    scored = MD.train_models(tr, te, models=["lr_checkpoint", "gbt_quick", "mlp"], keep=["vec_id"])
    return MT.compare_models(scored)


# -- facts of fitted classifiers: counts recomputed by the twin, probabilities and AUC of both splits held to
# bounds; the label is one that the vectors tell (``ruled_split``)

def _scored_facts(scored, floor):
    by = ["model", "split"]
    seen = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"), F.sum("label").alias("positives"),
        F.min(F.col("score").between(0, 1)).alias("in_range"), (F.stddev("score") > 0).alias("varied"),
        F.min((F.col("score") > 0.5) == (F.col("prediction") == 1)).alias("decided"))
    return seen.join(MT.roc_auc(scored, by=by).select(*by, (F.col("auc") > floor).alias("over_floor")), by)


def _stored_scores(spark, scored):
    path = scratch_path(spark, "scored")
    scored.write.parquet(path)  # scores are read twice
    return spark.read.parquet(path)


def _classifier_facts(spark, sf_dir, preset, floor, **settings):
    tr, te = A.ruled_split(spark, sf_dir)
    fc = MD.fit_classifier(tr, "embedding", "label", preset, seed=42, **settings)
    scored = fc.score(tr, "train", ["vec_id"]).unionByName(fc.score(te, "test", ["vec_id"]))
    return _scored_facts(_stored_scores(spark, scored), floor)


#: With batches of 256 a table of 250 training rows has one step per epoch, and 20 epochs of patience are 20
#: steps; all else is as configured.
_SMALL_STEPS = {"batch_size": 16, "learning_rate": 0.005}
_RULE_SQL = " + ".join(f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 5)) + " > 0.1"


def _classifier_facts_sql(*names):
    return f"""
SELECT m.model, CASE WHEN vec_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, COUNT(*) AS rows,
       COUNT(DISTINCT vec_id) AS ids, CAST(SUM(CAST({_RULE_SQL} AS INTEGER)) AS BIGINT) AS positives,
       TRUE AS in_range, TRUE AS varied, TRUE AS decided, TRUE AS over_floor
FROM embeddings, (VALUES {", ".join(f"('{n}')" for n in names)}) m(model) GROUP BY 1, 2"""


@register("m2_logistic_facts", _classifier_facts_sql("lr_stage2"))
def m2_logistic_facts(spark, sf_dir):
    return _classifier_facts(spark, sf_dir, "lr_stage2", 0.8)


@register("m3_gbt_facts", _classifier_facts_sql("gbt_quick"))
def m3_gbt_facts(spark, sf_dir):
    return _classifier_facts(spark, sf_dir, "gbt_quick", 0.6, n_estimators=30)


@register("m3_boosted_facts", _classifier_facts_sql("gbt_stage2"))
def m3_boosted_facts(spark, sf_dir):
    """The stage-2 configuration with L1, L2, gamma and minimum Hessian, without its stop."""
    return _classifier_facts(spark, sf_dir, "gbt_stage2", 0.6, n_estimators=24, learning_rate=0.1, early_stopping_rounds=0)


@register("m4_mlp_facts", _classifier_facts_sql("mlp"))
def m4_mlp_facts(spark, sf_dir):
    return _classifier_facts(spark, sf_dir, "mlp", 0.6, **_SMALL_STEPS)


@register("m6_stopping_facts", f"""
SELECT COUNT(*) FILTER (WHERE vec_id % 2 = 0) AS train_rows, COUNT(*) FILTER (WHERE vec_id % 2 = 1) AS watched_rows,
       TRUE AS best_is_the_first_maximum, TRUE AS best_auc_of_scores, TRUE AS stopped_in_time, TRUE AS over_floor
FROM embeddings""")
def m6_stopping_facts(spark, sf_dir):
    """The stop watches the test split here, as a given validation table."""
    tr, te = A.ruled_split(spark, sf_dir)
    fc = MD.fit_classifier(tr, "embedding", "label", "gbt_stage2", validation=te, **_STOPPING)
    h, best = fc.info["history"], fc.info["best_iteration"]
    scored = _stored_scores(spark, fc.score(te, "test", ["vec_id"]))
    auc = MT.roc_auc(scored).first()["auc"]
    rows = tr.agg(F.count(F.lit(1)).alias("train_rows")).crossJoin(scored.agg(F.count(F.lit(1)).alias("watched_rows")))
    return rows.select("*", F.lit(h.index(max(h)) + 1 == best).alias("best_is_the_first_maximum"),
                       F.lit(abs(auc - fc.info["best_score"]) < 1e-9).alias("best_auc_of_scores"),
                       F.lit(len(h) <= min(32, best + 8)).alias("stopped_in_time"), F.lit(auc > 0.6).alias("over_floor"))


@register("m7_switch_facts", _classifier_facts_sql("gbt_stage2", "lr_stage2", "mlp"))
def m7_switch_facts(spark, sf_dir):
    """``all`` trains exactly the three stage-2 configurations, the trees with all their rounds and patience."""
    tr, te = A.ruled_split(spark, sf_dir)
    scored = MD.train_models(tr, te, models="all", keep=["vec_id"], settings={"mlp": _SMALL_STEPS})
    return _scored_facts(_stored_scores(spark, scored), 0.6)


_FEWER_TREES = {"gbt_quick": {"n_estimators": 10}}


@register("v2_trained_roc_facts", """
SELECT model, TRUE AS from_zero, TRUE AS to_one, TRUE AS rising, TRUE AS area_is_auc
FROM (VALUES ('lr_stage2'), ('gbt_quick')) m(model)""")
def v2_trained_roc_facts(spark, sf_dir):
    """ROC points of trained models on the test split: ends, order, and the area under them."""
    tr, te = A.ruled_split(spark, sf_dir)
    got = EV.train_and_evaluate(tr.drop("batch_id"), te, "label", ["vec_id"], ["lr_stage2", "gbt_quick"], settings=_FEWER_TREES)
    w = Window.partitionBy("model").orderBy(F.col("threshold").desc())
    steps = got["roc"].withColumn("x0", F.lag("fpr").over(w)).withColumn("y0", F.lag("tpr").over(w))
    area = steps.groupBy("model").agg(
        (F.min("fpr") + F.min("tpr") == 0).alias("from_zero"), (F.max("fpr") + F.max("tpr") == 2).alias("to_one"),
        F.min(F.coalesce((F.col("fpr") >= F.col("x0")) & (F.col("tpr") >= F.col("y0")), F.lit(True))).alias("rising"),
        F.sum((F.col("fpr") - F.col("x0")) * (F.col("tpr") + F.col("y0")) / 2).alias("area"))
    auc = got["auc"].filter("split = 'test'").select("model", "auc")
    return area.join(auc, "model").select("model", "from_zero", "to_one", "rising",
                                          (F.abs(F.col("area") - F.col("auc")) < 1e-9).alias("area_is_auc"))


# -- E2, E3, E5..E9 ---------------------------------------------------------------------------
import numpy as _np  # noqa: E402

from vellum.operators import contrastive as CS  # noqa: E402

_PROJ_OUT = 8


def fixed_projection(d_in: int = 64, d_out: int = _PROJ_OUT) -> CS.ProjectionModel:
    """A rule-made projection for checks: W[j, i] = ((7 i + 3 j) mod 11 - 5) / 10, b[j] = j / 100."""
    W = _np.array([[((7 * i + 3 * j) % 11 - 5) / 10 for i in range(d_in)] for j in range(d_out)])
    return CS.ProjectionModel(W, _np.arange(d_out) / 100.0, normalize=False)


@register("e2_dense_projection", f"""
WITH e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i
           FROM embeddings),
o AS (SELECT unnest(range(0, {_PROJ_OUT})) AS j),
u AS (SELECT e.vec_id, o.j, SUM(x * (((7 * i + 3 * o.j) % 11) - 5) / 10.0) + o.j / 100.0 AS u
      FROM e, o GROUP BY e.vec_id, o.j)
SELECT vec_id, list(round(tanh(u), 6) ORDER BY j) AS z FROM u GROUP BY vec_id""")
def e2_dense_projection(spark, sf_dir):
    em = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    z = fixed_projection().transform(em, "embedding", "z", out_type="double")
    return z.select("vec_id", F.transform("z", lambda x: F.round(x, 6)).alias("z"))


@register("e3_l2_normalize", """
WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * i) AS v FROM embeddings)
SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS e
FROM s""")
def e3_l2_normalize(spark, sf_dir):
    em = A.table(spark, sf_dir, "embeddings")
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x * (i + 1))
    return em.select("vec_id", F.transform(CS.l2_normalize(scaled), lambda x: F.round(x, 6)).alias("e"))


_BATCH_PAIRS_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label < 3 AS INTEGER) AS y,
                  vec_id // 16 AS b FROM embeddings),
p AS (SELECT a.vec_id AS a, o.vec_id AS o, a.b, list_distance(a.e, o.e) AS d, a.y = o.y AS same
      FROM v a JOIN v o ON a.b = o.b AND a.vec_id <> o.vec_id)"""


@register("e5_batch_hard_soft_margin", _BATCH_PAIRS_SQL + """,
h AS (SELECT a, max(d) FILTER (WHERE same) AS hp, min(d) FILTER (WHERE NOT same) AS hn FROM p GROUP BY a)
SELECT round(avg(ln(1 + exp(hp - hn))), 6) AS loss, COUNT(*) AS n FROM h
WHERE hp IS NOT NULL AND hn IS NOT NULL""")
def e5_batch_hard_soft_margin(spark, sf_dir):
    return _r6(CS.batch_loss(A.vectors(spark, sf_dir), "batch_hard_soft_margin"), "loss")


@register("e6_batch_all_triplet", _BATCH_PAIRS_SQL + """,
t AS (SELECT ap.d - an.d + 0.5 AS l FROM p ap JOIN p an ON ap.a = an.a AND ap.same AND NOT an.same)
SELECT round(SUM(l) / COUNT(*), 6) AS loss, COUNT(*) AS n FROM t WHERE l > 1e-16""")
def e6_batch_all_triplet(spark, sf_dir):
    return _r6(CS.batch_loss(A.vectors(spark, sf_dir), "batch_all"), "loss")


@register("e7_semi_hard_triplet", _BATCH_PAIRS_SQL + """,
t AS (SELECT ap.a, ap.o, ap.d AS dap,
             coalesce(min(an.d) FILTER (WHERE an.d > ap.d), max(an.d)) AS dn
      FROM p ap JOIN p an ON ap.a = an.a AND ap.same AND NOT an.same GROUP BY ap.a, ap.o, ap.d)
SELECT round(avg(greatest(dap - dn + 0.5, 0)), 6) AS loss, COUNT(*) AS n FROM t""")
def e7_semi_hard_triplet(spark, sf_dir):
    return _r6(CS.batch_loss(A.vectors(spark, sf_dir), "semi_hard"), "loss")


_PAIRS_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label < 3 AS INTEGER) AS y FROM embeddings),
p AS (SELECT a.vec_id // 16 AS batch_id, 1 - list_cosine_similarity(a.e, b.e) AS d,
             list_cosine_similarity(a.e, b.e) AS cs, CAST(a.y = b.y AS INTEGER) AS label
      FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""


@register("e8_online_contrastive", _PAIRS_SQL + """,
st AS (SELECT batch_id, max(d) FILTER (WHERE label = 1) AS pmax, avg(d) FILTER (WHERE label = 1) AS pavg,
              count(*) FILTER (WHERE label = 1) AS np, min(d) FILTER (WHERE label = 0) AS nmin,
              avg(d) FILTER (WHERE label = 0) AS navg, count(*) FILTER (WHERE label = 0) AS nn
       FROM p GROUP BY batch_id),
t AS (SELECT p.batch_id, SUM(CASE
          WHEN label = 1 AND d > (CASE WHEN nn > 1 THEN nmin ELSE pavg END) THEN d * d
          WHEN label = 0 AND d < (CASE WHEN np > 1 THEN pmax ELSE navg END) THEN pow(greatest(0.5 - d, 0), 2)
          ELSE 0 END) AS loss
      FROM p JOIN st USING (batch_id) GROUP BY p.batch_id)
SELECT round(avg(loss), 6) AS loss, COUNT(*) AS n_batches FROM t""")
def e8_online_contrastive(spark, sf_dir):
    return _r6(CS.online_contrastive_loss(A.vector_pairs(spark, sf_dir)), "loss")


@register("e9_cosine_similarity_loss", _PAIRS_SQL + """
SELECT round(avg((cs - label) * (cs - label)), 6) AS loss, COUNT(*) AS n FROM p""")
def e9_cosine_similarity_loss(spark, sf_dir):
    return _r6(CS.cosine_similarity_loss(A.vector_pairs(spark, sf_dir)), "loss")


# -- E1, E4, E10..E13, V7, V8 ---------------------------------------------------------------
from vellum.operators import encode as EN  # noqa: E402
from vellum.plans import dataset as DS  # noqa: E402
from vellum.plans import evaluate as EV  # noqa: E402
from vellum.plans import stages as ST  # noqa: E402

_KEYS = ["UserLoanId", "CreatedAt"]
_TEXT = "concatenated_body"
_LABEL = "DefaultDPD21"


def _datasets(spark, sf_dir):
    return DS.build_train_test(A.messages(spark, sf_dir), A.spine(spark, sf_dir), _TR, _TE,
                               A.LOOKBACK_DAYS, max_tokens=256,
                               cache_dir=scratch_path(spark, "datasets"))


def _text_encoder(spark, sf_dir, tr):
    """Token vectors and projection trained together on the train split."""
    return EN.TextEncoder.fit_joint(tr, _TEXT, _LABEL, buckets=1 << 12, dim=32, embedding_dim=16, epochs=1, batch_size=16,
                                    lr=1e-2, seed=7)


def _both(tr, te):
    return tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))


def _text_features(spark, sf_dir):
    tr, te = _datasets(spark, sf_dir)
    return _text_encoder(spark, sf_dir, tr).features(_both(tr, te).select(*_KEYS, "split", _TEXT))


@register("e1_text_features")
def e1_text_features(spark, sf_dir):
    return _text_features(spark, sf_dir).drop(_TEXT)


_SPLIT_SQL = f"""
SELECT split, COUNT(*) AS rows, {{columns}} FROM (
  SELECT 'train' AS split, * FROM ({SPINE}) WHERE CreatedAt >= TIMESTAMP '{_TR[0]}' AND CreatedAt < TIMESTAMP '{_TR[1]}'
  UNION ALL
  SELECT 'test' AS split, * FROM ({SPINE}) WHERE CreatedAt >= TIMESTAMP '{_TE[0]}' AND CreatedAt < TIMESTAMP '{_TE[1]}')
GROUP BY split"""


@register("e1_feature_facts", _SPLIT_SQL.format(columns="32 AS least_dim, 32 AS most_dim, TRUE AS equal_texts_equal_vectors"))
def e1_feature_facts(spark, sf_dir):
    path = scratch_path(spark, "features")
    _text_features(spark, sf_dir).write.parquet(path)  # features are read twice
    made = spark.read.parquet(path)
    same = made.groupBy(_TEXT).agg(F.countDistinct("features").alias("n")).agg((F.max("n") == 1).alias("equal_texts_equal_vectors"))
    sizes = made.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("features")).alias("least_dim"),
                                      F.max(F.size("features")).alias("most_dim"))
    return sizes.join(F.broadcast(same))  # one row


def _projection_fit(**kw):
    base = dict(embedding_dim=16, epochs=2, batch_size=16, lr=1e-2, seed=7, steps_per_epoch=4,
                features="embedding", label="label", key="vec_id")
    base.update(kw)
    return CS.ContrastiveProjection(**base)


@register("e10_fit_projection")
def e10_fit_projection(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    model = _projection_fit().fit(v)
    return model.transform(v.select("vec_id", "label", "embedding"), "embedding", "projected").drop("embedding")


@register("e11_warm_start")
def e11_warm_start(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    first = _projection_fit(epochs=1).fit(v)
    model = _projection_fit(epochs=1).fit(v, initial=first)
    return model.transform(v.select("vec_id", "label", "embedding"), "embedding", "projected").drop("embedding")


@register("e12_fit_transform")
def e12_fit_transform(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("vec_id", "label", "embedding")
    return _projection_fit(epochs=1).fit_transform(v, "projected").drop("embedding")


@register("e13_checkpoint_resume")
def e13_checkpoint_resume(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    folder = scratch_path(spark, "checkpoints")
    _projection_fit(epochs=1, checkpoint_dir=folder, checkpoint_every=1).fit(v)
    latest = CA.list_checkpoints(spark, folder)[-1]
    model, state = CS.load_checkpoint(spark, latest)
    resumed = _projection_fit(epochs=1).fit(v, initial=model, state=state)
    return resumed.transform(v.select("vec_id", "label", "embedding"), "embedding", "projected").drop("embedding")


def _unit_rows(projected, col="projected"):
    """Rows, distinct ids, and whether all vectors have ``embedding_dim`` coordinates and norm 1."""
    norm = F.sqrt(F.aggregate(F.transform(col, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return projected.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"),
                         F.min(F.size(col)).alias("least_dim"), F.max(F.size(col)).alias("most_dim"),
                         (F.max(F.abs(norm - 1)) < 1e-5).alias("unit"))


_UNIT_SQL = """
SELECT COUNT(*) AS rows, COUNT(DISTINCT vec_id) AS ids, 16 AS least_dim, 16 AS most_dim, TRUE AS unit{more}
FROM embeddings"""


def _mean_loss(history):
    return sum(h["loss"] for h in history) / len(history)


@register("e10_fit_facts", _UNIT_SQL.format(more=", TRUE AS loss_fell, 24 AS steps"))
def e10_fit_facts(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    model = _projection_fit(epochs=6).fit(v)
    fell = _mean_loss(model.history[-4:]) < _mean_loss(model.history[:4])
    return _unit_rows(model.transform(v, "embedding", "projected")).select(
        "*", F.lit(fell).alias("loss_fell"), F.lit(len(model.history)).alias("steps"))


@register("e11_warm_start_facts", _UNIT_SQL.format(more=", TRUE AS starts_lower"))
def e11_warm_start_facts(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    first = _projection_fit(epochs=6).fit(v)
    second = _projection_fit(epochs=1).fit(v, initial=first)
    lower = _mean_loss(second.history[-4:]) < _mean_loss(first.history[:4])
    return _unit_rows(second.transform(v, "embedding", "projected")).select("*", F.lit(lower).alias("starts_lower"))


@register("e12_fit_transform_facts", _UNIT_SQL.format(more=""))
def e12_fit_transform_facts(spark, sf_dir):
    v = A.vectors(spark, sf_dir).select("vec_id", "label", "embedding")
    return _unit_rows(_projection_fit(epochs=1).fit_transform(v, "projected"))


@register("e13_resume_facts", _UNIT_SQL.format(more=", TRUE AS equals_one_run, 8 AS last_step"))
def e13_resume_facts(spark, sf_dir):
    """One epoch, checkpoint, reload, one epoch more: equal to two epochs in one run (1e-9)."""
    v = A.vectors(spark, sf_dir)
    folder = scratch_path(spark, "checkpoints")
    whole = _projection_fit(epochs=2, schedule_epochs=2).fit(v)
    _projection_fit(epochs=1, schedule_epochs=2, checkpoint_dir=folder, checkpoint_every=1).fit(v)
    model, state = CS.load_checkpoint(spark, CA.list_checkpoints(spark, folder)[-1])
    resumed = _projection_fit(epochs=1, schedule_epochs=2).fit(v, initial=model, state=state)
    equal = bool(abs(resumed.W - whole.W).max() < 1e-9 and abs(resumed.b - whole.b).max() < 1e-9)
    return _unit_rows(resumed.transform(v, "embedding", "projected")).select(
        "*", F.lit(equal).alias("equals_one_run"), F.lit(int(resumed.history[-1]["step"])).alias("last_step"))


@register("e4_encode_texts")
def e4_encode_texts(spark, sf_dir):
    tr, te = _datasets(spark, sf_dir)
    return _text_encoder(spark, sf_dir, tr).transform(_both(tr, te).select(*_KEYS, "split", _TEXT)).drop(_TEXT)


@register("e4_encode_facts", _SPLIT_SQL.format(columns="16 AS least_dim, 16 AS most_dim, TRUE AS unit"))
def e4_encode_facts(spark, sf_dir):
    made = e4_encode_texts(spark, sf_dir)
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return made.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("embedding")).alias("least_dim"),
                                     F.max(F.size("embedding")).alias("most_dim"), (F.max(F.abs(norm - 1)) < 1e-5).alias("unit"))


@register("e4_incremental_vectors", f"""
SELECT UserLoanId, CreatedAt, TRUE AS unit FROM ({SPINE})""")
def e4_incremental_vectors(spark, sf_dir):
    """Vectors of the train split, then of both splits from the same store: the second call encodes the
    texts that are new."""
    tr, te = _datasets(spark, sf_dir)
    enc = _text_encoder(spark, sf_dir, tr)
    store = scratch_path(spark, "vector-store")
    ST.update_vectors(enc, tr, store, _KEYS, ranges=2)
    got = ST.update_vectors(enc, _both(tr, te), store, _KEYS, ranges=2)
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return got.select(*_KEYS, (F.abs(norm - 1) < 1e-5).alias("unit"))


@register("e10_rounds_facts", _UNIT_SQL.format(more=", TRUE AS losses_fell, 5 AS losses, 20 AS jobs"))
def e10_rounds_facts(spark, sf_dir):
    """All five losses in rounds: one job per epoch; the loss of the last epoch is below the first's."""
    v = A.vectors(spark, sf_dir)
    losses = CS.LOSSES + CS.PAIR_LOSSES
    models = [_projection_fit(epochs=4, steps_per_epoch=None, loss=loss, shard_batches=16).fit(v) for loss in losses]
    fell = all(m.history[-1]["loss"] < m.history[0]["loss"] for m in models)
    return _unit_rows(models[-1].transform(v, "embedding", "projected")).select(
        "*", F.lit(fell).alias("losses_fell"), F.lit(len(models)).alias("losses"),
        F.lit(sum(len(m.history) for m in models)).alias("jobs"))


@register("v7_evaluate_checkpoint")
def v7_evaluate_checkpoint(spark, sf_dir):
    tr, te = _datasets(spark, sf_dir)
    path = scratch_path(spark, "encoder") + "/checkpoint-00000001"
    _text_encoder(spark, sf_dir, tr).save(path)
    store = CA.EmbeddingStore(spark, scratch_path(spark, "vectors"))
    return EV.evaluate_checkpoint(spark, path, tr, te, _LABEL, _KEYS, store)["report"]


@register("v8_evaluate_encoder")
def v8_evaluate_encoder(spark, sf_dir):
    tr, te = _datasets(spark, sf_dir)
    path = scratch_path(spark, "encoder")
    _text_encoder(spark, sf_dir, tr).save(path)
    return EV.evaluate_encoder(spark, path, tr, te, _LABEL, _KEYS)["comparison"]


# -- facts of the evaluators and of stage 1 ---------------------------------------------------

def _evaluation_facts(got):
    """Per model and split: rows, and the report's accuracy against the scores and the confusion matrix."""
    by = ["model", "split"]
    seen = got["scores"].groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"),
                                          F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("a"))
    cm = got["confusion"].groupBy(*by).agg(F.sum("count").alias("n"))
    report = got["report"].filter("class = 'accuracy'").select(*by, F.col("f1").alias("r"))
    auc = got["auc"].select(*by, "auc")
    return seen.join(cm, by).join(report, by).join(auc, by).select(
        *by, "rows", "positives", (F.col("n") == F.col("rows")).alias("all_in_matrix"),
        (F.abs(F.col("a") - F.col("r")) < 1e-9).alias("accuracy_of_scores"), F.col("auc").between(0, 1).alias("auc_in_range"))


def _evaluation_sql(*names):
    counts = _SPLIT_SQL.format(columns="CAST(SUM(DefaultDPD21) AS BIGINT) AS positives")
    return (f"SELECT m.model, s.*, TRUE AS all_in_matrix, TRUE AS accuracy_of_scores, TRUE AS auc_in_range "
            f"FROM ({counts}) s, (VALUES {', '.join(f'({n!r})' for n in names)}) m(model)")


@register("v7_checkpoint_facts", _evaluation_sql("lr_checkpoint", "gbt_quick"))
def v7_checkpoint_facts(spark, sf_dir):
    tr, te = _datasets(spark, sf_dir)
    path = scratch_path(spark, "encoder") + "/checkpoint-00000001"
    _text_encoder(spark, sf_dir, tr).save(path)
    return _evaluation_facts(EV.evaluate_checkpoint(spark, path, tr, te, _LABEL, _KEYS, settings=_FEWER_TREES))


@register("v8_encoder_facts", _evaluation_sql("lr_encoder", "gbt_quick", "mlp"))
def v8_encoder_facts(spark, sf_dir):
    tr, te = _datasets(spark, sf_dir)
    path = scratch_path(spark, "encoder")
    _text_encoder(spark, sf_dir, tr).save(path)
    return _evaluation_facts(EV.evaluate_encoder(spark, path, tr, te, _LABEL, _KEYS, settings=_FEWER_TREES))


@register("stage1_from_catalog", f"""
WITH lb AS ({_A2_SQL.replace("chr(10) || '---' || chr(10)", "'---'")})
SELECT UserLoanId, CreatedAt, DefaultDPD21, {truncate_sql('concatenated_body', 256)} AS concatenated_body,
       CASE WHEN CreatedAt < TIMESTAMP '{_TE[0]}' THEN 'train' ELSE 'test' END AS split, TRUE AS second_run_cached
FROM lb WHERE CreatedAt >= TIMESTAMP '{_TR[0]}' AND CreatedAt < TIMESTAMP '{_TE[1]}'""")
def stage1_from_catalog(spark, sf_dir):
    """Messages (one file per date) and spine by name -> datasets and encoder, twice; the rows of the second,
    cached run."""
    base = scratch_path(spark, "lake")
    CT.write_incremental(A.messages(spark, sf_dir), f"{base}/android_sms", "CreatedAt")
    A.spine(spark, sf_dir).write.parquet(f"{base}/label_spine.parquet")
    lake, cache = CT.TableCatalog(spark, base), scratch_path(spark, "stage1")
    settings = dict(buckets=1 << 12, dim=16, embedding_dim=8, epochs=1, batch_size=64)
    ST.fit_stage1(lake, cache, _TR, _TE, days=A.LOOKBACK_DAYS, encoder=settings)
    s = ST.fit_stage1(lake, cache, _TR, _TE, days=A.LOOKBACK_DAYS, encoder=settings)
    return _both(s.train, s.test).drop("token_count").withColumn("second_run_cached", F.lit(s.from_cache))
