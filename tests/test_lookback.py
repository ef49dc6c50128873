"""Look-back semantics on hand-made messages (FIXTURES §4) and equality of the four plan forms."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import lookback as LB

T0 = dt.datetime(2024, 1, 10, 12, 0, 0)
SCHEMA = "UserLoanId long, CreatedAt timestamp_ntz, body string"
SPINE = "UserLoanId long, CreatedAt timestamp_ntz, DefaultDPD21 int"


def run(spark, msgs, spine, days=7, sep="--", method="bucketed", **kw):
    m = spark.createDataFrame(msgs, SCHEMA)
    s = spark.createDataFrame(spine, SPINE)
    out = LB.label_join(LB.lookback_text(m, s, days, sep, method=method, **kw), s)
    return sorted((r.UserLoanId, r.CreatedAt, r.concatenated_body, r.DefaultDPD21) for r in out.collect())


def test_edges_inclusive_and_exclusive(spark):
    msgs = [(1, T0, "now"), (1, T0 - dt.timedelta(days=7), "edge"),
            (1, T0 - dt.timedelta(days=7, microseconds=1), "outside"),
            (1, T0 + dt.timedelta(microseconds=1), "later")]
    for method in LB.METHODS:
        got = run(spark, msgs, [(1, T0, 1)], method=method)
        assert got == [(1, T0, "edge--now", 1)], method


def test_same_time_duplicates_blanks_nulls(spark):
    msgs = [(1, T0, "b"), (1, T0, "a"), (1, T0 - dt.timedelta(hours=1), "a"), (1, T0 - dt.timedelta(hours=2), "a"),
            (1, T0 - dt.timedelta(hours=3), ""), (1, T0 - dt.timedelta(hours=3), "   "),
            (1, T0 - dt.timedelta(hours=4), " "), (1, T0 - dt.timedelta(hours=4), "　"),
            (1, T0 - dt.timedelta(hours=5), "\t"), (1, T0 - dt.timedelta(hours=5), "\n"),
            (1, T0 - dt.timedelta(hours=6), None)]
    got = run(spark, msgs, [(1, T0, 0)])
    assert got == [(1, T0, "\t--\n--a--b", 0)]


def test_blank_anchor_and_missing_message(spark):
    msgs = [(1, T0, " "), (1, T0 - dt.timedelta(days=1), "old"), (2, T0 - dt.timedelta(days=1), "x")]
    assert run(spark, msgs, [(1, T0, 1), (2, T0, 1)]) == []


def test_duplicate_spine_rows_fan_out_once(spark):
    msgs = [(1, T0, "x")]
    got = run(spark, msgs, [(1, T0, 1), (1, T0, 1)])
    assert got == [(1, T0, "x", 1), (1, T0, "x", 1)]


def test_byte_order_and_quote_separator(spark):
    msgs = [(1, T0, w) for w in ["b", "a", "B", "é", "z"]]
    got = run(spark, msgs, [(1, T0, 1)], sep="'")
    assert got[0][2] == "B'a'b'z'é"


def test_default_separator(spark):
    got = run(spark, [(1, T0, "x"), (1, T0, "y")], [(1, T0, 1)], sep=LB.DEFAULT_SEPARATOR)
    assert got[0][2] == "x\n---\ny"


def test_bad_arguments(spark):
    m = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        LB.lookback_text(m, None, -1)
    with pytest.raises(ValueError):
        LB.lookback_text(m, None, 1, method="nope")
    with pytest.raises(ValueError):
        LB.lookback_text(m.drop("body"), None, 1)


def test_split_is_half_open(spark):
    s = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 0), (2, dt.datetime(2024, 1, 15, 23, 59), 1),
                               (3, dt.datetime(2024, 1, 16), 1)], SPINE)
    tr, te = LB.split_spine(s, "2024-01-01", "2024-01-16", "2024-01-16", "2024-01-31")
    assert sorted(r.UserLoanId for r in tr.collect()) == [1, 2]
    assert [r.UserLoanId for r in te.collect()] == [3]
    with pytest.raises(ValueError):
        LB.split_spine(s, "2024/01/01", "2024-01-16", "2024-01-16", "2024-01-31")


def brute_force(msgs, spine, days, sep):
    clean = {(k, t, b) for k, t, b in msgs if k is not None and b is not None and b.strip("  　") != ""}
    out = []
    for k, t, y in spine:
        if not any(ck == k and ct == t for ck, ct, _ in clean):
            continue
        texts = sorted({b for ck, ct, b in clean if ck == k and t - dt.timedelta(days=days) <= ct <= t},
                       key=lambda s: s.encode("utf-8"))
        out.append((k, t, sep.join(texts), y))
    return sorted(out)


times = st.integers(min_value=0, max_value=20 * 24).map(lambda h: T0 + dt.timedelta(hours=h))
bodies = st.sampled_from(["a", "b", "B", "é", " ", "", None, "x y", "\t"])
msg = st.tuples(st.integers(1, 3), times, bodies)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(msgs=st.lists(msg, min_size=1, max_size=25), picks=st.lists(st.integers(0, 24), max_size=6),
       days=st.integers(0, 5))
def test_forms_equal_brute_force(spark, msgs, picks, days):
    spine = [(msgs[i % len(msgs)][0], msgs[i % len(msgs)][1], i % 2) for i in picks]
    want = brute_force(msgs, spine, days, "|")
    for method in LB.METHODS:
        assert run(spark, msgs, spine, days=days, sep="|", method=method) == want, method
    assert run(spark, msgs, spine, days=days, sep="|", method="bucketed", bucket_seconds=3600 * 5) == want


def test_plan_has_no_cartesian_product(spark):
    m = spark.createDataFrame([(1, T0, "x")], SCHEMA)
    s = spark.createDataFrame([(1, T0, 1)], SPINE)
    plan = LB.lookback_text(m, s, 7)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scale_plan_pushes_the_time_range(spark, tmp_path):
    spark.createDataFrame([(1, T0, "x")], SCHEMA).write.parquet(f"{tmp_path}/m")
    spark.createDataFrame([(1, T0, 1)], SPINE).write.parquet(f"{tmp_path}/s")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = LB.lookback_text(spark.read.parquet(f"{tmp_path}/m"), spark.read.parquet(f"{tmp_path}/s"), 7,
                              anchor_range=("2024-01-01", "2024-03-01"))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "GreaterThanOrEqual(CreatedAt,2023-12-25" in plan and "LessThan(CreatedAt,2024-03-01" in plan
    assert plan.count("Exchange hashpartitioning") <= 5  # 3 with texts, 2 of anchors


def test_truncation_cases(spark):
    from vellum.functions.text import word_token_count, word_truncate

    df = spark.createDataFrame([(None,), ("",), ("a b c",), ("a  b\tc d",)], "t string")
    got = df.select(word_truncate("t", 3).alias("x"), word_token_count(word_truncate("t", 3)).alias("n")).collect()
    assert [(r.x, r.n) for r in got] == [("", 0), ("", 0), ("a b c", 3), ("a b c", 3)]


def test_build_dataset_entry_rows(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() == 199
    assert df.columns == ["UserLoanId", "CreatedAt", "concatenated_body", "DefaultDPD21", "token_count"]
    assert df.filter(F.col("token_count") > 24).count() == 0


def test_fine_buckets_probe_only_filled_ones(spark):
    """A window of 10,081 minutes gives an anchor as many rows as it has minutes with a message."""
    msgs = [(1, T0 + dt.timedelta(hours=7 * h), f"b{h % 5}") for h in range(40)] + [(2, T0, "x"), (3, T0, "y")]
    spine = [(1, T0 + dt.timedelta(hours=7 * 30), 1), (1, T0, 0), (2, T0, 1), (4, T0, 1)]
    m = spark.createDataFrame(msgs, SCHEMA)
    rows = m.selectExpr("UserLoanId AS _k", "CreatedAt AS _mt").withColumn("_b", LB._bucket(F.col("_mt"), 60))
    a = spark.createDataFrame(spine, SPINE).selectExpr("UserLoanId AS _k", "CreatedAt AS _at")
    probed = LB._probes(a, rows, 7, 60)
    assert sorted(r["count"] for r in probed.groupBy("_k", "_at").count().collect()) == [1, 1, 25]
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    want = run(spark, msgs, spine, days=7)
    assert len(want) == 3 and run(spark, msgs, spine, days=7, method="bucketed", bucket_seconds=60) == want


def test_full_form_shuffles_messages_not_pairs(spark):
    """Every message an anchor: the windows are made where the messages lie, no table of (anchor, text) pairs."""
    m = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), f"b{h}") for h in range(50)], SCHEMA)
    s = spark.createDataFrame([(1, T0 + dt.timedelta(hours=49), 1)], SPINE)
    df = LB.lookback_text(m, s, 7, method="full")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "_at" not in plan  # pairs would carry the anchor's time beside the message's
    assert df.count() == 50
    assert run(spark, [(1, T0, "x"), (1, T0, "x")], [(1, T0, 1)], method="full") == [(1, T0, "x", 1)]
