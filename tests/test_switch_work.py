"""m7_switch_facts trains what is configured, and trees grown by one task are those of a job per level."""

import numpy as np
import pytest

from vellum.operators import boosting as B
from vellum.operators import models as MD
from vellum.plans import registry as R


def _embeddings(spark, base, n=120, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, 6))
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{base}/embeddings.parquet")


def test_switch_facts_trains_the_configurations_whole(spark, tmp_dir, monkeypatch):
    _embeddings(spark, tmp_dir)
    seen, plain = {}, MD.fit_classifier

    def fit(train, features, label, preset, seed=42, **settings):
        seen[preset] = {**MD.PRESETS[preset], **settings}
        return plain(train, features, label, "lr_stage2", seed=seed, name=preset)

    monkeypatch.setattr(MD, "fit_classifier", fit)
    assert R.m7_switch_facts(spark, tmp_dir).count() == 6
    assert set(seen) == {"gbt_stage2", "lr_stage2", "mlp"}
    assert seen["gbt_stage2"] == MD.PRESETS["gbt_stage2"] and seen["lr_stage2"] == MD.PRESETS["lr_stage2"]
    assert seen["gbt_stage2"]["n_estimators"] == 1000 and seen["gbt_stage2"]["early_stopping_rounds"] == 100
    # the perceptron's steps are smaller, its epochs and its patience are not fewer
    assert {k for k in seen["mlp"] if seen["mlp"][k] != MD.PRESETS["mlp"][k]} == {"batch_size", "learning_rate"}
    assert seen["mlp"]["batch_size"] <= MD.PRESETS["mlp"]["batch_size"]


@pytest.mark.parametrize("settings", [
    {"n_estimators": 9, "max_depth": 4, "subsample": 0.6, "colsample_bytree": 0.5, "gamma": 0.5, "min_child_weight": 3.0},
    {"n_estimators": 30, "max_depth": 2, "learning_rate": 0.5, "early_stopping_rounds": 3, "scale_pos_weight": 1.5},
])
def test_one_task_grows_the_same_trees(spark, monkeypatch, settings):
    for name, value in (("MARGIN_EVERY", 3), ("AUC_EVERY", 4), ("TREES_AT_ONCE", 5), ("BLOCK_ROWS", 40)):
        monkeypatch.setattr(B, name, value)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(260, 20)), 1)
    x[::9, 3] = np.nan
    y = (np.nan_to_num(x[:, 0] + x[:, 3]) + rng.normal(size=260) * 0.5 > 0.2).astype(int)
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "features array<double>, label int").repartition(3).cache()
    at_once = B.HistogramBooster(**settings).fit(df)
    monkeypatch.setattr(B, "TASK_BINS", 0)
    by_level = B.HistogramBooster(**settings).fit(df)
    df.unpersist()
    assert at_once.info == by_level.info and len(at_once.trees) == len(by_level.trees)
    for a, b in zip(at_once.trees, by_level.trees):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.array_equal(a.value, b.value)
    assert any((t.feature >= 0).any() for t in at_once.trees)
