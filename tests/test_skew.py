"""Hot keys: one key (or one set of identical copies) holds a large share of the rows.

Results must stay whole and equal to the plain forms, and the work of the hot key must be split
over several tasks instead of landing in one.
"""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import contrastive as CS
from vellum.operators import lookback as LB
from vellum.operators import profile as PR


@pytest.fixture()
def no_coalesce(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_seeded_order_splits_a_hot_key(no_coalesce):
    spark = no_coalesce
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                  F.col("id").alias("v"))
    out = PR.seeded_order(df, "k", seed=5)
    parts = out.filter("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    a = [r.v for r in out.collect()]
    b = [r.v for r in PR.seeded_order(df, "k", seed=5).collect()]
    assert a == b and sorted(a) == list(range(3000))
    keys = [r.k for r in out.collect()]
    first = keys.index(0)
    assert keys[first:first + 1000] == [0] * 1000          # the key's rows stay together


def test_seeded_order_splits_identical_copies(no_coalesce):
    spark = no_coalesce
    df = spark.range(2000).select(F.when(F.col("id") < 1000, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    out = PR.seeded_order(df, "k", seed=1)
    assert out.filter("k = -1").select(F.spark_partition_id()).distinct().count() > 1
    assert out.count() == 2000


def test_contrastive_batches_scatter_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [(0 if i % 2 else i, [float(x) for x in rng.normal(size=4)], int(i % 3 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "k long, features array<double>, label int")
    est = CS.ContrastiveProjection(embedding_dim=3, epochs=1, batch_size=16, seed=1, steps_per_epoch=2, key="k")
    batches, n_batches, _, _ = est._prepare(df)             # one row per batch
    biggest, total = batches.agg(F.max(F.size("xs")), F.sum(F.size("ys"))).first()
    assert n_batches == 75 and biggest < 60                # ~Poisson(16), not 600 rows of key 0
    assert total == 1200


def test_batch_losses_in_blocks_equal_one_block(monkeypatch):
    rng = np.random.default_rng(4)
    e, y = rng.normal(size=(30, 3)), rng.integers(0, 3, 30)
    e[5] = e[6] + 1e-9                                     # near-equal vectors: one formula at any size
    whole = {loss: CS.loss_terms(CS.pairwise_distances(e), y, loss, want_grad=True) for loss in CS.LOSSES}
    monkeypatch.setattr(CS, "BLOCK_VALUES", 200)
    for loss, (total, n, grad) in whole.items():
        got = CS.loss_terms(CS.pairwise_distances(e), y, loss, want_grad=True)
        assert got[0] == pytest.approx(total, rel=1e-12) and got[1] == n and np.array_equal(got[2], grad)


def test_balanced_weights_of_a_hot_label(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(100)], "id long, y int")
    out = PR.balanced_weights(df, "y")
    w = {r.y: r.weight for r in out.select("y", "weight").distinct().collect()}
    assert out.count() == 100 and w == pytest.approx({0: 100 / (2 * 90), 1: 100 / (2 * 10)})


def test_lookback_forms_agree_with_a_hot_key(spark):
    t0 = dt.datetime(2024, 1, 20)
    msgs, spine = [], []
    for i in range(600):
        k = 0 if i % 3 else i                               # two thirds of the rows on key 0
        t = t0 - dt.timedelta(hours=i % 400)
        msgs.append((k, t, f"text {i % 37}"))
        if i % 7 == 0:
            spine.append((k, t, i % 2))
    m = spark.createDataFrame(msgs, "UserLoanId long, CreatedAt timestamp_ntz, body string")
    s = spark.createDataFrame(spine, "UserLoanId long, CreatedAt timestamp_ntz, DefaultDPD21 int")
    results = {meth: sorted(map(tuple, LB.label_join(LB.lookback_text(m, s, 3, "|", method=meth), s).collect()))
               for meth in LB.METHODS}
    base = results.pop("bucketed")
    assert len(base) > 0
    for meth, rows in results.items():
        assert rows == base, meth


def test_balanced_weights_join(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 24 else 0) for i in range(30)], "id long, y int")
    w = {r.y: r.weight for r in PR.balanced_weights(df, "y").select("y", "weight").distinct().collect()}
    assert w == pytest.approx({0: 30 / (3 * 14), 1: 30 / (3 * 8), 2: 30 / (3 * 8)})


def test_large_scale_plan_joins_on_key_and_bucket(spark):
    """With broadcasts off (the shape at scale), the band join is a shuffle join on (key, bucket)
    and the rew join on (key, salt): no join is keyed by the key alone."""
    m = spark.createDataFrame([(1, dt.datetime(2024, 1, 9), "x")], "UserLoanId long, CreatedAt timestamp_ntz, body string")
    s = spark.createDataFrame([(1, dt.datetime(2024, 1, 9), 1)], "UserLoanId long, CreatedAt timestamp_ntz, DefaultDPD21 int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for meth, extra in (("bucketed", "_b"), ("rew", "_salt")):
            plan = LB.lookback_text(m, s, 7, method=meth)._jdf.queryExecution().executedPlan().toString()
            joins = [ln for ln in plan.splitlines() if "SortMergeJoin" in ln]
            assert any(extra in ln for ln in joins), (meth, joins)
            left_keys = [ln.split("SortMergeJoin [", 1)[1].split("]", 1)[0] for ln in joins]
            assert all("," in k for k in left_keys), (meth, joins)   # never the key alone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_batches_are_bounded_under_a_hot_key_and_copies(spark):
    rows = [(1, i) for i in range(600)] + [(2, 7)] * 2500 + [(k, k) for k in range(3, 200)] + [(None, None)]
    df = spark.createDataFrame(rows, "k int, v int")
    a = PR.assign_batches(df.repartition(3), 64, seed=1)
    sizes = {r.batch_id: r["count"] for r in a.groupBy("batch_id").count().collect()}
    assert sum(sizes.values()) == len(rows) and sorted(sizes) == list(range(len(sizes)))
    assert set(sizes.values()) <= {64, len(rows) % 64 or 64}
    got = [sorted(map(str, PR.assign_batches(df.repartition(n), 64, seed=1).collect())) for n in (2, 5)]
    assert got[0] == got[1]
    assert PR.assign_batches(df.limit(0), 64).count() == 0


def _skewed_log(spark, n=6000):
    """A third of the messages on key 0, spread over time; few anchors."""
    t0 = dt.datetime(2024, 1, 20)
    rows = [(0 if i % 3 == 0 else 1 + i % 1500, t0 - dt.timedelta(minutes=7 * i), f"text {i}") for i in range(n)]
    spine = [(k, t, 1) for i, (k, t, _) in enumerate(rows) if i % 10 == 0]
    m = spark.createDataFrame(rows, "UserLoanId long, CreatedAt timestamp_ntz, body string")
    return m, spark.createDataFrame(spine, "UserLoanId int, CreatedAt timestamp_ntz, DefaultDPD21 int")


def test_only_hot_keys_are_salted(no_coalesce):
    spark = no_coalesce
    m, s = _skewed_log(spark)
    hot = LB.hot_groups(m, "UserLoanId")
    assert [r["_hot"] for r in hot.collect()] == [m.filter("UserLoanId = 0").select(
        F.xxhash64("UserLoanId")).first()[0]]
    a = s.select(F.col("UserLoanId").alias("_k"), F.col("CreatedAt").alias("_at"))
    b = m.select(F.col("UserLoanId").alias("_k"), F.col("CreatedAt").alias("_mt"), F.col("body").alias("_body"))
    sa, sm = LB._salted(a, b, hot, 16, "_k")
    assert sa.filter("_k <> 0").count() == a.filter("_k <> 0").count()          # no copies for other keys
    assert sa.filter("_k = 0").count() == 16 * a.filter("_k = 0").count()
    groups = [r["count"] for r in sm.groupBy("_k", "_salt").count().collect()]
    assert max(groups) < 6000 / 3 / 16 * 1.6
    # dealt over partitions, the largest task has at most three times the median
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    sizes = sorted(r["count"] for r in sm.repartition(8, "_k", "_salt").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    unsalted = sorted(r["count"] for r in b.repartition(8, "_k").groupBy(F.spark_partition_id()).count().collect())
    assert unsalted[-1] > 3 * unsalted[len(unsalted) // 2]


@pytest.mark.parametrize("kw", [{"method": "rew"}, {"split_hot": True}, {"prefilter": True}, {"prefilter": True, "method": "rew"},
                                {"split_hot": True, "bucket_seconds": 3600}])
def test_hot_and_filtered_forms_equal_the_plain_one(spark, kw):
    m, s = _skewed_log(spark, 3000)
    s = s.filter("UserLoanId < 300")
    want = sorted(map(tuple, LB.lookback_text(m, s, 2, "|").collect()))
    assert want and sorted(map(tuple, LB.lookback_text(m, s, 2, "|", **kw).collect())) == want


def test_key_filter_drops_before_the_shuffle(spark):
    m, s = _skewed_log(spark)
    keys = s.filter("UserLoanId BETWEEN 1 AND 100")
    got = LB.key_filter(m, keys)
    exact = LB.fetch_keys(m, keys)
    assert exact.count() <= got.count() < 1.1 * exact.count() < m.count() / 2   # few pass wrongly, none is lost
    assert exact.exceptAll(got).count() == 0
    plan = LB.lookback_text(m, keys, 2, prefilter=True)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    semi = next(i for i, ln in enumerate(lines) if "BroadcastHashJoin" in ln and "LeftSemi" in ln and "getbit" in ln)
    deeper = [ln for ln in lines[semi + 1:] if "Exchange hashpartitioning(_k" in ln]
    assert not deeper                                                            # tested below the band join's shuffle
    assert LB.key_filter(m, keys.limit(0)).count() == 0
    doubles = keys.select(F.col("UserLoanId").cast("double").alias("UserLoanId"))
    assert LB.key_filter(m, doubles).count() == m.count()                        # other types: no filter, no loss
