"""The relu network, the round-based contrastive fit and the pair losses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import contrastive as CS
from vellum.operators import models as MD
from vellum.operators import network as NW
from vellum.plans import analogs as A

SF = "/root/testdata/sf0.001"


def test_network_gradient_matches_finite_differences():
    rng = np.random.default_rng(0)
    shapes = NW.layer_shapes(5, [7, 4])
    theta = NW.init_theta(shapes, 3)
    x, y = rng.normal(size=(12, 5)), rng.integers(0, 2, 12).astype(float)
    _, grad = NW.loss_and_gradient(x, y, theta, shapes, 0.3)
    h = 1e-6
    for k in rng.choice(len(theta), 40, replace=False):
        up, down = theta.copy(), theta.copy()
        up[k] += h
        down[k] -= h
        num = (NW.loss_and_gradient(x, y, up, shapes, 0.3)[0] - NW.loss_and_gradient(x, y, down, shapes, 0.3)[0]) / (2 * h)
        assert num == pytest.approx(grad[k], abs=1e-6)


def _ring(spark, n=900, seed=0):
    """Class 1 inside a ring: no linear classifier does it."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = ((x**2).sum(1) < 1.2).astype(int)
    return spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "features array<double>, label int"), x, y


def test_network_learns_what_a_line_cannot(spark, tmp_dir):
    df, x, y = _ring(spark)
    est = NW.PerceptronClassifier(batch_size=64, learning_rate=0.01, max_iter=25, n_iter_no_change=25)
    model = est.fit(df.repartition(3))
    test, tx, ty = _ring(spark, 400, 9)
    assert ((model.probabilities(tx) > 0.5) == ty).mean() > 0.93
    again = est.fit(df.repartition(7))
    assert np.abs(again.theta - model.theta).max() < 1e-9  # rows are dealt by content
    model.save(spark, tmp_dir + "/net")
    back = NW.Network.load(spark, tmp_dir + "/net")
    got = back.transform(test).select("prediction").collect()
    assert [int(r.prediction) for r in got] == (model.probabilities(tx) > 0.5).astype(int).tolist()


def test_network_one_shard_is_plain_adam(spark):
    """One shard equals a plain loop over the same mini-batches."""
    df, _, _ = _ring(spark, 200)
    est = NW.PerceptronClassifier(batch_size=50, max_iter=3, early_stopping=False, n_iter_no_change=10)
    got = est.fit(df)
    shards, _ = NW.write_shards(df.select(F.col("features").alias("x"), F.col("label").cast("long").alias("y")), 4, 64, 42)
    rows = [r for b in shards.first()["batches"] for r in b["rows"]]
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    shapes = NW.layer_shapes(2, [64, 32])
    theta = NW.init_theta(shapes, 42)
    m, v, t, losses = np.zeros_like(theta), np.zeros_like(theta), 0, []
    for epoch in range(3):
        order, total = np.random.default_rng((42, epoch)).permutation(200), 0.0
        for at in range(0, 200, 50):
            pick = order[at: at + 50]
            loss, g = NW.loss_and_gradient(x[pick], y[pick], theta, shapes, 0.01)
            total += loss
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 1e-3 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        losses.append(total / 4)
    assert np.abs(got.theta - theta).max() < 1e-12
    assert [h["loss"] for h in got.info["history"]] == pytest.approx(losses)


def test_network_patience_and_shards(spark):
    df, x, y = _ring(spark, 600)
    est = NW.PerceptronClassifier(batch_size=32, learning_rate=0.02, max_iter=60, n_iter_no_change=3, shard_batches=4)
    model = est.fit(df)  # 19 batches in 5 shards
    h = [e["score"] for e in model.info["history"]]
    assert len(h) < 60
    best, waited = -np.inf, 0
    for s in h:
        waited = waited + 1 if s < best + est.tol else 0
        best = max(best, s)
    assert waited == 4 and model.info["best_score"] == max(h)
    assert ((model.probabilities(x) > 0.5) == y).mean() > 0.85


def test_network_bad_tables(spark):
    with pytest.raises(ValueError, match="empty"):
        NW.PerceptronClassifier().fit(spark.createDataFrame([], "features array<double>, label int"))
    with pytest.raises(ValueError, match="0 or 1"):
        NW.PerceptronClassifier().fit(spark.createDataFrame([([1.0], 2)], "features array<double>, label int"))


def test_network_preset(spark):
    tr, te = A.vector_split(spark, SF)
    fc = MD.fit_classifier(tr, "embedding", "label", "mlp", max_iter=4)
    assert MD.PRESETS["mlp"]["hidden"] == [64, 32] and fc.model.hidden == [64, 32]
    assert fc.score(te, "test", ["vec_id"]).filter("score BETWEEN 0 AND 1").count() == te.count()


# -- contrastive fit --------------------------------------------------------------------------

@pytest.mark.parametrize("loss", CS.PAIR_LOSSES)
def test_pair_gradient_matches_finite_differences(loss):
    rng = np.random.default_rng(4)
    X, y = rng.normal(size=(10, 5)), rng.integers(0, 3, 10)
    W, b = rng.normal(size=(3, 5)) * 0.5, rng.normal(size=3) * 0.1
    _, n, gW, gb = CS.batch_gradient(X, y, W, b, loss)
    assert n > 0 and np.abs(gW).max() > 0
    h = 1e-6
    for i in range(3):
        for j in range(5):
            Wp, Wm = W.copy(), W.copy()
            Wp[i, j] += h
            Wm[i, j] -= h
            num = (CS.batch_gradient(X, y, Wp, b, loss)[0] - CS.batch_gradient(X, y, Wm, b, loss)[0]) / (2 * h)
            assert num == pytest.approx(gW[i, j], abs=1e-5)


def test_pairs_are_bounded_and_equal_the_operators(spark):
    rng = np.random.default_rng(2)
    y = np.r_[np.zeros(300, int), rng.integers(1, 4, 20)]  # one key fills the batch
    i, j, same = CS.sample_pairs(y)
    assert len(i) <= 4 * len(y) and (i < j).all() and len({*zip(i, j)}) == len(i)
    assert same.any() and (~same).any() and (same == (y[i] == y[j])).all()
    assert len(CS.sample_pairs(np.array([1]))[0]) == 0
    e = rng.normal(size=(len(y), 4))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    pairs = spark.createDataFrame([(0, e[a].tolist(), e[b].tolist(), int(s)) for a, b, s in zip(i, j, same)],
                                  "batch_id long, emb_a array<double>, emb_b array<double>, label int")
    for loss, op in (("online_contrastive", CS.online_contrastive_loss), ("cosine_similarity", CS.cosine_similarity_loss)):
        total, n, _ = CS.embedding_gradient(e, y, loss)
        assert op(pairs).first().loss == pytest.approx(total / n, rel=1e-9)


def _fit(v, **kw):
    base = dict(embedding_dim=6, epochs=2, batch_size=32, lr=1e-2, seed=5, features="embedding", label="label", key="vec_id")
    return CS.ContrastiveProjection(**{**base, **kw}).fit(v)


def test_one_shard_equals_the_sequential_schedule(spark):
    v = A.vectors(spark, SF)
    rounds, steps = _fit(v.repartition(3), shard_batches=64), _fit(v)
    assert len(rounds.history) == 2 and len(steps.history) == 2 * 16  # two jobs against one per batch
    assert np.abs(rounds.W - steps.W).max() < 1e-9 and np.abs(rounds.b - steps.b).max() < 1e-9


@pytest.mark.parametrize("loss", CS.LOSSES + CS.PAIR_LOSSES)
def test_rounds_lower_every_loss(spark, loss):
    v = A.vectors(spark, SF)
    model = _fit(v, loss=loss, epochs=5, shard_batches=4, batch_size=32)
    assert len(model.history) == 5
    assert model.history[-1]["loss"] < model.history[0]["loss"]


def test_rounds_resume(spark, tmp_dir):
    from vellum.sources.cache import list_checkpoints

    v = A.vectors(spark, SF)
    kw = dict(shard_batches=4, schedule_epochs=2, batch_size=32)
    whole = _fit(v, epochs=2, **kw)
    _fit(v, epochs=1, checkpoint_dir=tmp_dir, **kw)
    model, state = CS.load_checkpoint(spark, list_checkpoints(spark, tmp_dir)[-1])
    est = CS.ContrastiveProjection(embedding_dim=6, epochs=1, lr=1e-2, seed=5, features="embedding", label="label",
                                   key="vec_id", **kw)
    assert np.abs(est.fit(v, model, state).W - whole.W).max() < 1e-9
