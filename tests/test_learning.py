"""Contrastive losses, projection fit, classifiers and encoders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import contrastive as CS
from vellum.operators import encode as EN
from vellum.operators import models as MD
from vellum.plans import analogs as A

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("loss", CS.LOSSES)
def test_gradient_matches_finite_differences(loss):
    rng = np.random.default_rng(0)
    X, y = rng.normal(size=(10, 5)), rng.integers(0, 3, 10)
    W, b = rng.normal(size=(3, 5)) * 0.5, rng.normal(size=3) * 0.1
    _, _, gW, gb = CS.batch_gradient(X, y, W, b, loss)
    h = 1e-6
    for i, j in [(0, 0), (1, 3), (2, 4)]:
        Wp, Wm = W.copy(), W.copy()
        Wp[i, j] += h
        Wm[i, j] -= h
        num = (CS.batch_gradient(X, y, Wp, b, loss)[0] - CS.batch_gradient(X, y, Wm, b, loss)[0]) / (2 * h)
        assert num == pytest.approx(gW[i, j], abs=1e-5)


def test_anchor_without_positive_or_negative_is_skipped():
    D = CS.pairwise_distances(np.eye(3))
    total, n, _ = CS.loss_terms(D, np.array([0, 1, 1]), "batch_hard_soft_margin")
    assert n == 2  # anchor 0 has no positive
    assert CS.loss_terms(D, np.array([1, 1, 1]), "batch_hard_soft_margin")[1] == 0


def test_batch_loss_matches_numpy(spark):
    v = A.vectors(spark, SF)
    got = CS.batch_loss(v, "batch_hard_soft_margin").first()
    pdf = v.toPandas()
    tot, n = 0.0, 0
    for _, g in pdf.groupby("batch_id"):
        t, k, _ = CS.loss_terms(CS.pairwise_distances(np.stack(g.embedding.values).astype(float)),
                                g.label.to_numpy(), "batch_hard_soft_margin")
        tot, n = tot + t, n + k
    assert got.n == n and got.loss == pytest.approx(tot / n, rel=1e-12)


def test_fit_lowers_loss_and_is_deterministic(spark, tmp_dir):
    v = A.vectors(spark, SF)
    kw = dict(embedding_dim=8, epochs=3, batch_size=16, lr=1e-2, seed=3, steps_per_epoch=3,
              features="embedding", label="label", key="vec_id")
    m1 = CS.ContrastiveProjection(**kw).fit(v)
    m2 = CS.ContrastiveProjection(**kw).fit(v)
    assert np.allclose(m1.W, m2.W, atol=1e-9)
    before = CS.batch_loss(CS.init_projection(64, 8, 3).transform(v, "embedding", "e"), embedding="e").first().loss
    after = CS.batch_loss(m1.transform(v, "embedding", "e"), embedding="e").first().loss
    assert after < before
    out = m1.transform(v, "embedding", "e").select(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x).alias("n2"))
    assert all(abs(r.n2 - 1) < 1e-5 for r in out.collect())
    m1.save(spark, tmp_dir + "/proj")
    back = CS.ProjectionModel.load(spark, tmp_dir + "/proj")
    assert np.array_equal(back.W, m1.W) and np.array_equal(back.b, m1.b)


def test_checkpoints_keep_newest_three(spark, tmp_dir):
    from vellum.sources.cache import list_checkpoints

    v = A.vectors(spark, SF)
    CS.ContrastiveProjection(embedding_dim=4, epochs=1, batch_size=16, lr=1e-2, seed=1, steps_per_epoch=5,
                             features="embedding", label="label", checkpoint_dir=tmp_dir,
                             checkpoint_every=1).fit(v)
    cps = list_checkpoints(spark, tmp_dir)
    assert [c.rsplit("-", 1)[-1] for c in cps] == ["00000003", "00000004", "00000005"]
    model, st = CS.load_checkpoint(spark, cps[-1])
    assert st.step == 5 and model.W.shape == (4, 64)


def test_fit_does_not_depend_on_partitioning_and_resumes(spark):
    v = A.vectors(spark, SF).select("embedding", "label")
    v = v.unionByName(v.limit(40))                       # identical rows too

    def fit(df, epochs, initial=None, state=None):
        est = CS.ContrastiveProjection(embedding_dim=4, epochs=epochs, batch_size=64, lr=1e-2, seed=1,
                                       features="embedding", label="label", steps_per_epoch=4, schedule_epochs=2)
        return est.fit(df, initial, state)

    state = CS.OptimizerState()
    once = fit(v.repartition(2), 1, state=state)
    resumed = fit(v.repartition(5), 1, once, state)
    both = fit(v.repartition(3), 2)
    assert np.abs(resumed.W - both.W).max() < 1e-9 and state.step == 8


def test_learning_rate_schedule():
    rates = [CS.lr_at(s, 20, 5, 1.0) for s in range(21)]
    assert rates[:5] == pytest.approx([0.2, 0.4, 0.6, 0.8, 1.0]) and rates[5] == 1.0
    assert all(a > b for a, b in zip(rates[5:], rates[6:])) and rates[20] == pytest.approx(0.0)


def test_lr_matches_newton_solution(spark):
    tr, _ = A.vector_split(spark, SF)
    fc = MD.fit_classifier(tr, "embedding", "label", "lr_checkpoint")
    pdf = tr.toPandas()
    X = np.stack(pdf.embedding.values).astype(float)
    y = pdf.label.to_numpy().astype(float)
    n, n1 = len(y), y.sum()
    w = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    Xb = np.hstack([X, np.ones((n, 1))])
    beta = np.zeros(Xb.shape[1])
    for _ in range(50):  # sklearn objective: C * sum w_i loss_i + 0.5 ||coef||^2 (intercept not penalized)
        p = 1 / (1 + np.exp(-Xb @ beta))
        reg = np.r_[beta[:-1], 0.0]
        g = Xb.T @ (w * (p - y)) + reg
        H = Xb.T @ (Xb * (w * p * (1 - p))[:, None]) + np.diag(np.r_[np.ones(X.shape[1]), 0.0])
        beta -= np.linalg.solve(H, g)
    coef = np.r_[fc.model.coefficients.toArray(), fc.model.intercept]
    assert np.abs(coef - beta).max() < 1e-4


def test_standardizer_population(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "x array<double>")
    st = MD.Standardizer(population=True).fit(df, "x")
    assert st.mean == [2.0, 5.0] and st.std == [1.0, 1.0]
    assert sorted(r.x for r in st.transform(df, "x").collect()) == [[-1.0, 0.0], [1.0, 0.0]]


def test_gbt_refuses_unsupported_settings(spark):
    tr, _ = A.vector_split(spark, SF)
    with pytest.raises(ValueError):
        MD.fit_classifier(tr, "embedding", "label", "gbt_quick", reg_lambda=10)


def test_class_balance_without_positives_raises(spark):
    from vellum.operators.profile import class_balance

    df = spark.createDataFrame([(0,), (0,)], "DefaultDPD21 int")
    with pytest.raises(Exception):
        class_balance(df).collect()


def _hashing_predict_fn(dim: int):
    """A user's own model: signed hashed bag of words, L2-normalized."""
    def make():
        import zlib

        import numpy as np

        def predict(texts):
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for r, t in enumerate(texts):
                for w in str(t).lower().split():
                    h = zlib.crc32(w.encode("utf-8"))
                    out[r, h % dim] += 1.0 if (h >> 31) & 1 else -1.0
            return out
        return predict
    return make


@pytest.mark.parametrize("kind", EN.FEATURIZERS)
def test_encoder_save_load_identity(spark, tmp_dir, kind):
    df = spark.createDataFrame([(i, f"text number {i} about {'cats' if i % 2 else 'dogs'}", i % 2)
                                for i in range(40)], "k long, t string, y int")
    enc = EN.TextEncoder.fit_featurizer(df, "t", kind=kind, vector_size=8, seed=1)
    enc = enc.fit_projection(df, "y", embedding_dim=4, epochs=1, batch_size=8, lr=1e-2, seed=1, steps_per_epoch=2)
    enc.save(tmp_dir + "/enc")
    back = EN.TextEncoder.load(spark, tmp_dir + "/enc")
    a = sorted((r.k, tuple(r.embedding)) for r in enc.transform(df).collect())
    b = sorted((r.k, tuple(r.embedding)) for r in back.transform(df).collect())
    assert a == b
    assert EN.load_encoder(spark, tmp_dir + "/missing") is None
    h = EN.embed_with_model(df, "t", _hashing_predict_fn(16), 16, batch_size=8)
    assert len(h.first().embedding) == 16


def test_bpe_truncation(spark):
    from vellum.functions.text import bpe_truncate_and_count

    df = spark.createDataFrame([(None,), ("",), ("hello world",), ("one two three four five six",)], "t string")
    r = df.select(bpe_truncate_and_count("t", 3).alias("r")).collect()
    assert (r[0].r.text, r[0].r.token_count) == ("", 0)
    assert (r[1].r.text, r[1].r.token_count) == ("", 0)
    assert (r[2].r.text, r[2].r.token_count) == ("hello world", 2)
    assert r[3].r.text == "one two three" and r[3].r.token_count == 3


def test_word2vec_vocabulary_is_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("a b c",), ("a b d",), ("e",)], "t string")
    assert EN.vocabulary_size(df, "t", 1, 100) == 5 and EN.vocabulary_size(df, "t", 2, 100) == 2
    monkeypatch.setattr(EN, "MAX_VOCAB", 3)
    with pytest.raises(ValueError, match="vocabulary over 3"):
        EN.TextEncoder.fit_featurizer(df, "t", kind="word2vec", vector_size=4)
    EN.TextEncoder.fit_featurizer(df, "t", kind="word2vec", vector_size=4, min_count=2)   # 2 words: allowed
