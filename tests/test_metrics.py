"""AUC / ROC against brute force, report and confusion edge cases (FIXTURES §4)."""

import itertools
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql.utils import CapturedException

from vellum.operators import metrics as MT


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def auc(spark, rows, **kw):
    df = spark.createDataFrame(rows, "label int, score double")
    return MT.roc_auc(df, **kw).first().auc


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_auc_matches_brute_force_with_ties(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    assert auc(spark, rows, num_buckets=7) == pytest.approx(brute_auc(rows), abs=1e-12)
    flipped = [(y, -s) for y, s in rows]
    assert auc(spark, flipped, num_buckets=3) == pytest.approx(1 - brute_auc(rows), abs=1e-12)


def test_auc_edge_cases(spark):
    assert auc(spark, [(0, 0.3), (1, 0.3), (1, 0.3)]) == 0.5
    assert auc(spark, [(0, 0.1), (1, 0.9)]) == 1.0
    assert auc(spark, [(0, 0.9), (1, 0.1)]) == 0.0
    with pytest.raises((PySparkException, CapturedException, Exception)):
        auc(spark, [(1, 0.1), (1, 0.2)])


def test_roc_curve_points(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    pts = sorted((r.threshold, r.fpr, r.tpr) for r in MT.roc_curve(df, num_buckets=2).collect())
    assert pts == [(0.1, 1.0, 1.0), (0.35, 0.5, 1.0), (0.4, 0.5, 0.5), (0.8, 0.0, 0.5), (float("inf"), 0.0, 0.0)]
    dropped = MT.roc_curve(df, drop_intermediate=True).count()
    assert dropped <= 5


def _roc_dropped_brute(labels, scores):
    """The library rule on plain arrays: cumulative counts per distinct score (descending), drop a
    point whose count steps to both neighbours are equal on both axes, prepend (0, 0, inf)."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    last = np.r_[np.where(np.diff(s))[0], len(s) - 1]
    tps, fps = np.cumsum(y)[last], np.cumsum(1 - y)[last]
    keep = np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True]
    pts = [(float(t), round(f / fps[-1], 6), round(p / tps[-1], 6))
           for t, f, p in zip(s[last][keep], fps[keep], tps[keep])]
    return sorted(pts + [(float("inf"), 0.0, 0.0)])


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_roc_drop_intermediate_matches_library_rule(spark, buckets):
    rng = np.random.default_rng(7)
    # distinct scores in same-label runs (long equal-step stretches) plus heavily tied scores
    scores = np.r_[np.arange(300) / 300.0, np.round(rng.random(100), 1)]
    labels = np.r_[(np.arange(300) // 25) % 2, (rng.random(100) < 0.5)].astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores)], "label int, score double")
    got = sorted((r.threshold, round(r.fpr, 6), round(r.tpr, 6))
                 for r in MT.roc_curve(df, drop_intermediate=True, num_buckets=buckets).collect())
    assert got == _roc_dropped_brute(labels, scores)


def test_confusion_and_report_with_unpredicted_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 0)], "label int, prediction int")
    cm = {(r.label, r.prediction): r["count"] for r in MT.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 2, (1, 1): 0}
    rep = {r["class"]: r for r in MT.classification_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert rep["0"].precision == 0.5 and rep["0"].recall == 1.0
    assert rep["accuracy"].f1 == 0.5 and rep["accuracy"].support == 4
    assert rep["macro avg"].recall == 0.5


def test_compare_models_ranks_by_test_auc(spark):
    rows = []
    for m, good in (("a", True), ("b", False)):
        for split in ("train", "test"):
            for i in range(20):
                y = i % 2
                rows.append((m, split, y, float(y if good else (1 - y))))
    df = spark.createDataFrame(rows, "model string, split string, label int, score double")
    out = MT.compare_models(df).collect()
    assert [r.model for r in out] == ["a", "b"] and out[0].test_auc == 1.0 and out[1].gap == 0.0


@pytest.mark.parametrize("rows", [[(0, None), (1, 0.5)], [(2, 0.1), (1, 0.5)], [(None, 0.1), (1, 0.5)], [(0, float("nan")), (1, 0.5)]])
def test_auc_refuses_what_it_cannot_rank(spark, rows):
    from vellum.operators import metrics as MT

    df = spark.createDataFrame(rows, "label int, score double")
    with pytest.raises(Exception, match="must"):
        MT.roc_auc(df, label="label", score="score").collect()


def test_auc_takes_infinite_scores(spark):
    from vellum.operators import metrics as MT

    rows = [(0, float("-inf")), (0, 0.2), (1, 0.3), (1, float("inf")), (0, 0.4)]
    out = MT.roc_auc(spark.createDataFrame(rows, "label int, score double"), label="label", score="score").collect()
    assert any(abs(v - 5 / 6) < 1e-9 for v in out[0] if isinstance(v, float))


def test_confusion_matrix_refuses_nulls(spark):
    from vellum.operators import metrics as MT

    df = spark.createDataFrame([(0, None), (1, 1)], "label int, prediction int")
    with pytest.raises(Exception, match="must not be null"):
        MT.confusion_matrix(df).collect()
