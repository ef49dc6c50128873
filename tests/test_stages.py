"""Stage 1, stage 2, the evaluators, embedding a file and incremental vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vellum.operators import encode as EN
from vellum.operators import models as MD
from vellum.plans import evaluate as EV
from vellum.plans import stages as ST
from vellum.sources import cache as CA
from vellum.sources import catalog as CT

T0 = dt.datetime(2024, 1, 1)
TRAIN, TEST = ("2024-01-05", "2024-01-15"), ("2024-01-15", "2024-01-25")
ENCODER = dict(buckets=1 << 10, dim=8, embedding_dim=4, epochs=2, batch_size=16, lr=0.02)
FAST = {"gbt_stage2": {"n_estimators": 6, "early_stopping_rounds": 3, "learning_rate": 0.3, "min_child_weight": 1},
        "mlp": {"max_iter": 3}, "gbt_quick": {"n_estimators": 3, "max_depth": 2}}


def _lake(spark, base, words=("overdue reminder", "thanks paid")):
    msgs, spine = [], []
    for i in range(240):
        y, t = i % 2, T0 + dt.timedelta(days=i % 24, hours=i % 20)
        for h in range(3):
            msgs.append((i, t - dt.timedelta(hours=6 * h), f"{words[y]} number {h} of {i % 5}"))
        spine.append((i, t, y))
    CT.write_incremental(spark.createDataFrame(msgs, "UserLoanId long, CreatedAt timestamp_ntz, body string"),
                         base + "/android_sms", "CreatedAt")
    spark.createDataFrame(spine, "UserLoanId long, CreatedAt timestamp_ntz, DefaultDPD21 int") \
        .write.parquet(base + "/label_spine.parquet")
    return CT.TableCatalog(spark, base)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    return _lake(spark, str(tmp_path_factory.mktemp("lake")))


def test_stage1_goes_from_the_catalog_to_a_saved_encoder(spark, lake, tmp_dir, monkeypatch):
    args = (lake, tmp_dir, TRAIN, TEST)
    first = ST.fit_stage1(*args, days=3, encoder=ENCODER)
    assert not first.from_cache and first.train.count() == 100 and first.test.count() == 100
    assert first.train.filter("CreatedAt < '2024-01-05' OR CreatedAt >= '2024-01-15'").count() == 0
    body = first.train.orderBy("UserLoanId").first().concatenated_body
    assert body.count("---") == 2 and "number" in body
    assert {r.dataset: r.rows for r in first.profile().collect()} == {"train": 100, "test": 100}
    with monkeypatch.context() as m:  # the second run fits nothing and builds nothing
        m.setattr(EN.TextEncoder, "fit_joint", lambda *a, **k: pytest.fail("fitted again"))
        m.setattr("vellum.operators.lookback.build_dataset", lambda *a, **k: pytest.fail("built again"))
        second = ST.fit_stage1(*args, days=3, encoder=ENCODER)
    assert second.from_cache and second.encoder_path == first.encoder_path
    a, b = (sorted((r.UserLoanId, tuple(r.embedding)) for r in s.encoder.transform(s.test).collect()) for s in (first, second))
    assert a == b
    other = ST.fit_stage1(*args, days=3, encoder={**ENCODER, "epochs": 1})
    assert not other.from_cache and other.encoder_path != first.encoder_path
    assert not ST.fit_stage1(*args, days=3, encoder=ENCODER, use_cache=False).from_cache
    changed = _lake(spark, tmp_dir + "/lake2", ("overdue", "paid in time"))
    assert not ST.fit_stage1(changed, tmp_dir, TRAIN, TEST, days=3, encoder=ENCODER).from_cache


def test_stage2_trains_exactly_three_configurations(spark, lake, tmp_dir):
    s = ST.fit_stage1(lake, tmp_dir, TRAIN, TEST, days=3, encoder={**ENCODER, "epochs": 4})
    store = CA.EmbeddingStore(spark, tmp_dir + "/vectors")
    got = ST.run_stage2(s.encoder, s.train, s.test, store=store, encoder_id=s.encoder_path, settings=FAST)
    ranked = got["comparison"].collect()
    assert sorted(r.model for r in ranked) == ["gbt_stage2", "lr_stage2", "mlp"]
    assert [r["rank"] for r in sorted(ranked, key=lambda r: -r.test_auc)] == [1, 2, 3]
    assert {r.model: r.test_auc for r in ranked}["lr_stage2"] > 0.9  # the two kinds of text are told apart
    assert got["scores"].groupBy("model", "split").count().count() == 6
    roc = got["roc"].filter("model = 'lr_stage2'").agg(F.max("fpr"), F.max("tpr"), F.min("fpr")).first()
    assert tuple(roc) == (1.0, 1.0, 0.0)
    one = ST.run_stage2(s.encoder, s.train, s.test, models="logistic", store=store, encoder_id=s.encoder_path)
    assert [r.model for r in one["comparison"].collect()] == ["lr_stage2"]


def test_switch_names():
    assert MD.switch("all") == ["gbt_stage2", "lr_stage2", "mlp"] and MD.switch("trees") == ["gbt_stage2"]
    assert MD.switch(["network", "lr_encoder"]) == ["mlp", "lr_encoder"]
    with pytest.raises(ValueError):
        MD.switch("forest")
    with pytest.raises(ValueError):
        MD.switch([])


def test_evaluators_use_their_own_models(spark, lake, tmp_dir):
    s = ST.fit_stage1(lake, tmp_dir, TRAIN, TEST, days=3, encoder=ENCODER)
    keep = ["UserLoanId", "CreatedAt"]
    v7 = EV.evaluate_checkpoint(spark, s.encoder_path, s.train, s.test, "DefaultDPD21", keep, settings=FAST)
    v8 = EV.evaluate_encoder(spark, s.encoder_path, s.train, s.test, "DefaultDPD21", keep, settings=FAST)
    assert sorted(r.model for r in v7["comparison"].collect()) == ["gbt_quick", "lr_checkpoint"]
    assert sorted(r.model for r in v8["comparison"].collect()) == ["gbt_quick", "lr_encoder", "mlp"]
    for got, n in ((v7, 2), (v8, 3)):
        cm = got["confusion"].groupBy("model", "split").agg(F.sum("count").alias("n")).collect()
        assert len(cm) == 2 * n and {(r.split, r.n) for r in cm} == {("train", 100), ("test", 100)}
        assert got["report"].filter("class = 'accuracy'").count() == 2 * n
        brute = {(r.model, r.split): r.a for r in got["scores"].groupBy("model", "split").agg(
            F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("a")).collect()}
        acc = {(r.model, r.split): r.f1 for r in got["report"].filter("class = 'accuracy'").collect()}
        assert acc == pytest.approx(brute)


def test_embed_file(spark, lake, tmp_dir):
    s = ST.fit_stage1(lake, tmp_dir, TRAIN, TEST, days=3, encoder=ENCODER)
    s.test.write.parquet(tmp_dir + "/test")
    s.encoder.save(tmp_dir + "/cp/checkpoint-00000007")
    got = ST.embed_file(spark, tmp_dir + "/cp/checkpoint-00000007", tmp_dir + "/test", tmp_dir + "/out")
    assert got.columns == ["UserLoanId", "CreatedAt", "DefaultDPD21", "token_count", "embedding"] and got.count() == 100
    want = {r.UserLoanId: r.embedding for r in s.encoder.transform(s.test).collect()}
    assert {r.UserLoanId: r.embedding for r in got.collect()} == want
    with pytest.raises(FileNotFoundError, match="checkpoint-00000007"):
        ST.embed_file(spark, tmp_dir + "/cp/checkpoint-00000001", tmp_dir + "/test", tmp_dir + "/out2")
    with pytest.raises(FileNotFoundError):
        ST.embed_file(spark, tmp_dir + "/cp/checkpoint-00000007", tmp_dir + "/none", tmp_dir + "/out2")


class _Counting:
    """An encoder that counts the texts it is given."""

    def __init__(self, spark, fail_after=None):
        self.text, self.seen, self.fail_after, self.calls = "t", 0, fail_after, 0
        self.inner = EN.TextEncoder.fit_featurizer(spark.createDataFrame([("x",)], "t string"), "t", buckets=256, vector_size=4)

    def transform(self, df):
        self.calls += 1
        if self.fail_after is not None and self.calls > self.fail_after:
            raise KeyboardInterrupt
        self.seen += df.count()
        return self.inner.transform(df)


def test_one_new_row_encodes_one_row(spark, tmp_dir):
    rows = [(i, f"text {i % 70}") for i in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "k long, t string")
    enc = _Counting(spark)
    got = ST.update_vectors(enc, df, tmp_dir + "/v", ["k"])
    assert got.count() == 102 and enc.seen == 71           # copies once, null as the empty text
    enc.seen = 0
    more = df.unionByName(spark.createDataFrame([(300, "a new text"), (301, "text 5")], "k long, t string"))
    got = ST.update_vectors(enc, more, tmp_dir + "/v", ["k"])
    assert got.count() == 104 and enc.seen == 1
    want = {r.k: r.embedding for r in enc.inner.transform(more).collect()}
    assert {r.k: r.embedding for r in got.collect()} == want
    enc.seen = 0
    assert ST.update_vectors(enc, more, tmp_dir + "/v", ["k"]).count() == 104 and enc.seen == 0
    assert ST.update_vectors(enc, df.limit(0), tmp_dir + "/empty", ["k"]).count() == 0


def test_an_ended_run_goes_on(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(80)], "k long, t string")
    with pytest.raises(KeyboardInterrupt):
        ST.update_vectors(_Counting(spark, fail_after=3), df, tmp_dir + "/v", ["k"], ranges=8)
    enc = _Counting(spark)
    got = ST.update_vectors(enc, df, tmp_dir + "/v", ["k"], ranges=8)
    assert got.count() == 80 and 0 < enc.seen < 80         # the three finished ranges stay
    assert enc.calls == 5
