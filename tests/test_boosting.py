"""The histogram booster against a plain numpy booster on small tables."""

import numpy as np
import pytest

from vellum.operators import boosting as B
from vellum.operators import models as MD
from vellum.plans import analogs as A

SF = "/root/testdata/sf0.001"


def plain_booster(x, y, cuts, cfg, base, seed=42):
    """Trees as nested tuples, grown recursively with every gain computed row by row."""
    cfg = {**B.DEFAULTS, **cfg}
    a, lam = cfg["reg_alpha"], cfg["reg_lambda"]
    T = lambda g: np.sign(g) * max(abs(g) - a, 0.0)
    score = lambda g, h: T(g) ** 2 / (h + lam) if h + lam > 0 else 0.0
    margin, trees = np.full(len(y), base), []
    for t in range(cfg["n_estimators"]):
        g, h = B.gradients(margin, y, cfg["scale_pos_weight"])
        use = B.drawn_features(seed, t, x.shape[1], cfg["colsample_bytree"])

        def grow(rows, depth):
            G, H = g[rows].sum(), h[rows].sum()
            best = None
            if depth < cfg["max_depth"]:
                for f in use:
                    for c in cuts[f]:
                        left = x[rows, f] < c
                        gl, hl = g[rows][left].sum(), h[rows][left].sum()
                        gr, hr = G - gl, H - hl
                        if min(hl, hr) < cfg["min_child_weight"] or min(hl, hr) <= 0:
                            continue
                        gain = score(gl, hl) + score(gr, hr) - score(G, H)
                        if gain > 1e-6 and (best is None or gain > best[0]):
                            best = (gain, f, c, left)
            leaf = -cfg["learning_rate"] * T(G) / (H + lam) if H + lam > 0 else 0.0
            if best is None:
                return leaf
            gain, f, c, left = best
            l, r = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
            if not isinstance(l, tuple) and not isinstance(r, tuple) and gain < cfg["gamma"]:
                return leaf
            return (f, c, l, r)

        trees.append(grow(np.arange(len(y)), 0))
        margin = margin + plain_values(trees[-1], x)
    return trees, margin


def plain_values(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, l, r = tree
    return np.where(x[:, f] < c, plain_values(l, x), plain_values(r, x))


def _table(n=240, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.5) > 0.3).astype(int)
    return x, y


def _frame(spark, x, y):
    return spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "features array<double>, label int")


@pytest.mark.parametrize("settings", [
    {"max_depth": 3, "learning_rate": 0.3},
    {"max_depth": 3, "learning_rate": 0.1, "reg_alpha": 1.0, "reg_lambda": 10.0, "gamma": 1.0, "min_child_weight": 5.0,
     "scale_pos_weight": 1.7, "colsample_bytree": 0.6},
    {"max_depth": 4, "gamma": 4.0, "reg_lambda": 0.0, "min_child_weight": 2.0},
])
def test_equals_a_plain_booster(spark, monkeypatch, settings):
    monkeypatch.setattr(B, "MARGIN_EVERY", 3)  # the margin column is rewritten on the way
    x, y = _table()
    df = _frame(spark, x, y).repartition(3)
    model = B.HistogramBooster(n_estimators=7, base_score=0.5, **settings).fit(df)
    _, want = plain_booster(x, y, model.cuts, {**settings, "n_estimators": 7}, 0.0)
    assert len(model.trees) == 7
    assert np.abs(model.margins(x) - want).max() < 1e-9
    again = B.HistogramBooster(n_estimators=7, base_score=0.5, **settings).fit(df.repartition(5))
    assert np.abs(again.margins(x) - want).max() < 1e-9


def test_regularisation_settings_matter(spark):
    x, y = _table()
    df = _frame(spark, x, y)
    fit = lambda **kw: B.HistogramBooster(n_estimators=2, max_depth=3, **kw).fit(df)
    free = fit()
    for kw in ({"reg_alpha": 20.0}, {"reg_lambda": 50.0}, {"gamma": 30.0}, {"min_child_weight": 20.0}, {"subsample": 0.5},
               {"scale_pos_weight": 4.0}):
        assert np.abs(fit(**kw).margins(x) - free.margins(x)).max() > 1e-3, kw
    assert all((t.feature < 0).all() for t in fit(gamma=1e9).trees)


def _plain_auc(y, s):
    d = s[y == 1][:, None] - s[y == 0][None, :]
    return float(((d > 0) + 0.5 * (d == 0)).mean())


def test_stops_where_a_plain_loop_stops(spark, monkeypatch):
    monkeypatch.setattr(B, "AUC_EVERY", 5)
    monkeypatch.setattr(B, "MARGIN_EVERY", 4)
    x, y = _table(260, seed=1)
    vx, vy = _table(120, seed=2)
    cfg = {"max_depth": 2, "learning_rate": 0.5, "n_estimators": 40, "early_stopping_rounds": 4}
    model = B.HistogramBooster(base_score=0.5, **cfg).fit(_frame(spark, x, y), validation=_frame(spark, vx, vy).repartition(2))
    trees, _ = plain_booster(x, y, model.cuts, cfg, 0.0)
    margin, best, best_at, history = np.zeros(len(vy)), -1.0, 0, []
    for r, tree in enumerate(trees, 1):
        margin = margin + plain_values(tree, vx)
        history.append(_plain_auc(vy, margin))
        if history[-1] > best:
            best, best_at = history[-1], r
        elif r - best_at >= 4:
            break
    assert model.info["best_iteration"] == best_at == len(model.trees) and model.info["best_score"] == pytest.approx(best)
    assert model.info["history"] == pytest.approx(history) and len(history) < 40


def test_one_repeated_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0], i % 3 == 0) for i in range(400)], "features array<double>, label boolean")
    df = df.selectExpr("features", "CAST(label AS INT) AS label").repartition(2)
    model = B.HistogramBooster(n_estimators=30, early_stopping_rounds=3).fit(df)
    assert model.info["best_iteration"] == 1 and model.info["best_score"] == 0.5
    assert abs(1 / (1 + np.exp(-model.margins(np.array([[1.0, 2.0]]))[0])) - 1 / 3) < 0.06


def test_bad_tables_raise(spark):
    empty = spark.createDataFrame([], "features array<double>, label int")
    with pytest.raises(ValueError, match="empty"):
        B.HistogramBooster().fit(empty)
    with pytest.raises(ValueError, match="unknown"):
        B.HistogramBooster(depth=3)
    one = spark.createDataFrame([([float(i)], 0) for i in range(50)], "features array<double>, label int")
    with pytest.raises(ValueError, match="both classes"):
        B.HistogramBooster(early_stopping_rounds=2).fit(one)
    with pytest.raises(Exception, match="must be 0 or 1"):
        B.HistogramBooster().fit(spark.createDataFrame([([1.0], 2)], "features array<double>, label int"))


def test_nan_and_constant_features(spark):
    rows = [([float("nan") if i % 4 == 0 else float(i % 7), 5.0], int(i % 7 > 3)) for i in range(140)]
    model = B.HistogramBooster(n_estimators=3, max_depth=2).fit(spark.createDataFrame(rows, "features array<double>, label int"))
    assert len(model.cuts[1]) == 0 and all((t.feature != 1).all() for t in model.trees)


def test_preset_has_every_setting_and_round_trips(spark, tmp_dir):
    tr, te = A.vector_split(spark, SF)
    fc = MD.fit_classifier(tr, "embedding", "label", "gbt_stage2", n_estimators=4, early_stopping_rounds=2)
    assert {"reg_alpha", "reg_lambda", "gamma"} <= set(MD.PRESETS["gbt_stage2"])
    got = fc.score(te, "test", ["vec_id"]).collect()
    assert len(got) == te.count() and all(0 <= r.score <= 1 and r.prediction == (r.score > 0.5) for r in got)
    fc.model.save(spark, tmp_dir + "/trees")
    back = B.BoostedTrees.load(spark, tmp_dir + "/trees")
    x = np.stack([np.array(r.embedding, float) for r in te.collect()])
    assert np.array_equal(back.margins(x), fc.model.margins(x)) and back.info["best_iteration"] == fc.info["best_iteration"]
