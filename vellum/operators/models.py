"""Classifiers on vectors (M1-M7): standardization, weighted logistic regression, boosted trees
with early stopping, a perceptron, positive-class probability and a multi-model trainer.

All fits are ``pyspark.ml`` estimators (executors compute, the driver keeps only coefficients).
Inputs are DataFrames with a vector column (``array<float|double>`` or ``VectorUDT``) and a 0/1
label; outputs are scored tables ``(keys..., model, split, label, score, prediction)``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.boosting import DEFAULTS, BoostedTrees, HistogramBooster
from vellum.operators.network import PerceptronClassifier
from vellum.operators.profile import balanced_weights, class_balance
from vellum.session import require_columns


def as_vector(df: DataFrame, col: str, out: str = "features") -> DataFrame:
    """``array<float|double>`` -> ``VectorUDT`` (no-op for vectors)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.ArrayType):
        return df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))
    return df.withColumn(out, F.col(col)) if out != col else df


def as_array(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    dt = df.schema[col].dataType
    c = F.col(col).cast("array<double>") if isinstance(dt, T.ArrayType) else vector_to_array(F.col(col))
    return df.withColumn(out or col, c)


# -- M1 ---------------------------------------------------------------------------------------

@dataclass
class Standardizer:
    """Per-dimension ``(x - mean) / std`` fitted on one table, applied to any other. ``population``
    divides by the population deviation (n), else by the sample one (n - 1). A zero deviation
    scales by 1. The statistics are one distributed aggregate; only d means/deviations reach the
    driver."""

    population: bool = True
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, col: str) -> "Standardizer":
        v = as_vector(df, col, "_v")
        row = v.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).first()
        n = int(row.s["count"])
        var = [float(x) for x in row.s["variance"].toArray()]
        if self.population and n > 0:
            var = [x * (n - 1) / n for x in var]
        self.mean = [float(x) for x in row.s["mean"].toArray()]
        self.std = [math.sqrt(x) if x > 0 else 1.0 for x in var]
        return self

    def transform(self, df: DataFrame, col: str, out: str | None = None) -> DataFrame:
        if not self.mean:
            raise ValueError("Standardizer is not fitted")
        arr = as_array(df, col, "_x")
        mu = F.array(*[F.lit(m) for m in self.mean])
        sd = F.array(*[F.lit(s) for s in self.std])
        z = F.transform(F.col("_x"), lambda x, i: (x - F.element_at(mu, i + 1)) / F.element_at(sd, i + 1))
        return arr.withColumn(out or col, z).drop("_x")


# -- presets (values as in the reference's configurations) -------------------------------------

# Classifier configurations.
PRESETS = {
    "lr_stage2": {"kind": "logistic", "scale": True, "class_weight": "balanced", "C": 1.0, "max_iter": 1000},
    "lr_checkpoint": {"kind": "logistic", "scale": False, "class_weight": "balanced", "C": 1.0, "max_iter": 1000},
    "lr_encoder": {"kind": "logistic", "scale": False, "class_weight": None, "C": 1.0, "max_iter": 1000},
    "gbt_stage2": {"kind": "boost", "scale": False, "class_weight": "scale_pos", "n_estimators": 1000,
                   "max_depth": 3, "learning_rate": 0.01, "subsample": 0.5, "colsample_bytree": 0.5,
                   "min_child_weight": 10, "gamma": 1.0, "reg_alpha": 1.0, "reg_lambda": 10.0,
                   "early_stopping_rounds": 100},
    "gbt_quick": {"kind": "gbt", "scale": False, "class_weight": "scale_pos", "n_estimators": 100,
                  "max_depth": 6, "learning_rate": 0.1},
    "mlp": {"kind": "network", "scale": True, "class_weight": None, "hidden": [64, 32], "alpha": 0.01,
            "batch_size": 256, "learning_rate": 0.001, "max_iter": 200, "early_stopping": True,
            "validation_fraction": 0.1, "n_iter_no_change": 20},
}
# Settings that Spark's GBT (kind "gbt") cannot express; kind "boost" has them all.
UNSUPPORTED_GBT = ("reg_alpha", "reg_lambda")


def _weights(df: DataFrame, label: str, how: str | None) -> tuple[DataFrame, str | None]:
    if how is None:
        return df, None
    if how == "balanced":
        return balanced_weights(df, label, "_w"), "_w"
    if how == "scale_pos":
        cb = class_balance(df, label).select("scale_pos_weight")
        # a global aggregate (exactly one row): broadcast, the training rows keep their partitioning
        w = df.withColumn("_one", F.lit(1)).join(F.broadcast(cb.withColumn("_one", F.lit(1))), "_one").drop("_one")
        return w.withColumn("_w", F.when(F.col(label) == 1, F.col("scale_pos_weight")).otherwise(1.0))\
            .drop("scale_pos_weight"), "_w"
    raise ValueError(f"unknown class weighting {how!r}")


def positive_probability(pred: DataFrame, out: str = "score") -> DataFrame:
    """M5: probability of class 1 as a double column."""
    return pred.withColumn(out, vector_to_array(F.col("probability"))[1])


@dataclass
class FittedClassifier:
    name: str
    model: object
    scaler: Standardizer | None
    features: str
    label: str
    info: dict = field(default_factory=dict)

    def score(self, df: DataFrame, split: str | None = None, keep: list[str] | None = None) -> DataFrame:
        """``(keep..., model, split, label, score, prediction)``."""
        x = self.scaler.transform(df, self.features, "_z") if self.scaler else df.withColumn("_z", F.col(self.features))
        x = as_vector(x, "_z", "features")
        p = positive_probability(self.model.transform(x))
        cols = [*(keep or []), F.lit(self.name).alias("model")]
        if split is not None:
            cols.append(F.lit(split).alias("split"))
        return p.select(*cols, F.col(self.label).cast("int").alias("label"), "score",
                        F.col("prediction").cast("int").alias("prediction"))


def fit_classifier(train: DataFrame, features: str = "embedding", label: str = "label",
                   preset: str | dict = "lr_stage2", seed: int = 42, name: str | None = None,
                   validation: DataFrame | None = None, **overrides) -> FittedClassifier:
    """Fit one preset (or a dict of settings) on ``train``."""
    cfg = dict(PRESETS[preset]) if isinstance(preset, str) else dict(preset)
    cfg.update(overrides)
    require_columns(train, features, label, what="training table")
    bad = [k for k in UNSUPPORTED_GBT if cfg.get(k) and cfg["kind"] == "gbt"]
    if bad:
        raise ValueError(f"settings {bad} have no Spark equivalent; use kind='boost' or remove them")
    scaler = Standardizer(population=True).fit(train, features) if cfg.get("scale") else None
    x = scaler.transform(train, features, "_z") if scaler else train.withColumn("_z", F.col(features))
    kind = cfg["kind"]
    if kind == "boost":
        model = _fit_boost(x, label, cfg, seed, validation, features, scaler)
        return FittedClassifier(name or (preset if isinstance(preset, str) else kind), model, scaler, features,
                                label, model.info)
    if kind == "network":
        settings = {k: v for k, v in cfg.items() if k not in ("kind", "scale", "class_weight")}
        model = PerceptronClassifier(seed=seed, **settings).fit(x, "_z", label)
        return FittedClassifier(name or (preset if isinstance(preset, str) else kind), model, scaler, features,
                                label, model.info)
    x = as_vector(x, "_z", "features").withColumn(label, F.col(label).cast("double"))
    x, wcol = _weights(x, label, cfg.get("class_weight"))
    info: dict = {}
    if kind == "logistic":
        sw = x.agg(F.sum(wcol) if wcol else F.count(F.lit(1))).first()[0]
        est = LogisticRegression(featuresCol="features", labelCol=label, maxIter=int(cfg.get("max_iter", 100)),
                                 regParam=1.0 / (float(cfg.get("C", 1.0)) * float(sw)), elasticNetParam=0.0,
                                 standardization=False, tol=1e-6)
        if wcol:
            est.setWeightCol(wcol)
        model = est.fit(x)
    elif kind == "gbt":
        model, info = _fit_gbt(x, label, wcol, cfg, seed, validation, features, scaler)
    elif kind == "mlp":
        d = len(x.select("features").first()[0])
        est = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                             layers=[d, *cfg.get("hidden", [64, 32]), 2],
                                             maxIter=int(cfg.get("max_iter", 200)), seed=seed,
                                             blockSize=int(cfg.get("batch_size", 128)))
        model = est.fit(x)
    else:
        raise ValueError(f"unknown classifier kind {kind!r}")
    return FittedClassifier(name or (preset if isinstance(preset, str) else kind), model, scaler, features,
                            label, info)


def _fit_boost(x: DataFrame, label: str, cfg: dict, seed: int, validation: DataFrame | None, features: str,
               scaler: Standardizer | None) -> BoostedTrees:
    """M3/M6: the histogram booster with every setting of the configuration; positives weigh n0 / n1 under
    ``class_weight='scale_pos'``. Early stopping watches ``validation`` or a part of the training rows."""
    settings = {k: cfg[k] for k in DEFAULTS if k in cfg}
    if cfg.get("class_weight") == "scale_pos":
        settings["scale_pos_weight"] = class_balance(x, label).first()["scale_pos_weight"]
    if validation is not None:
        validation = scaler.transform(validation, features, "_z") if scaler else validation.withColumn("_z", F.col(features))
    return HistogramBooster(seed=seed, **settings).fit(x, "_z", label, validation)


def _gbt(cfg: dict, label: str, wcol: str | None, seed: int, n_trees: int) -> GBTClassifier:
    est = GBTClassifier(featuresCol="features", labelCol=label, maxIter=n_trees,
                        maxDepth=int(cfg.get("max_depth", 6)), stepSize=float(cfg.get("learning_rate", 0.1)),
                        subsamplingRate=float(cfg.get("subsample", 1.0)), seed=seed,
                        minInstancesPerNode=int(cfg.get("min_child_weight", 1)),
                        minInfoGain=float(cfg.get("gamma", 0.0)))
    cs = cfg.get("colsample_bytree")
    if cs and cs < 1.0:
        est.setFeatureSubsetStrategy(str(cs))
    if wcol:
        est.setWeightCol(wcol)
    return est


def _fit_gbt(x, label, wcol, cfg, seed, validation, features, scaler):
    n_trees = int(cfg.get("n_estimators", 100))
    patience = cfg.get("early_stopping_rounds")
    if not patience:
        return _gbt(cfg, label, wcol, seed, n_trees).fit(x), {}
    # M6: validation rows come from the training table (never the test table)
    if validation is None:
        h = F.pmod(F.xxhash64(F.lit(seed), F.col("_z")), F.lit(10))
        fit_part, valid = x.filter(h != 0), x.filter(h == 0)
    else:
        fit_part = x
        v = scaler.transform(validation, features, "_z") if scaler else validation.withColumn("_z", F.col(features))
        valid = as_vector(v, "_z", "features").withColumn(label, F.col(label).cast("double"))
    first = _gbt(cfg, label, wcol, seed, n_trees).fit(fit_part)
    losses = list(first.evaluateEachIteration(valid))
    best, best_i, since = float("inf"), 0, 0
    for i, l in enumerate(losses):
        if l < best - 1e-12:
            best, best_i, since = l, i, 0
        else:
            since += 1
            if since >= int(patience):
                break
    m = best_i + 1
    model = first if m == n_trees else _gbt(cfg, label, wcol, seed, m).fit(fit_part)
    return model, {"best_iteration": m, "best_score": best}


# The stage-2 switch: its three configurations by name.
SWITCH = {"trees": "gbt_stage2", "logistic": "lr_stage2", "network": "mlp"}


def switch(models: list[str] | str = "all") -> list[str]:
    """Presets for ``all`` (the three of the switch), a name of the switch, a preset, or a list of both."""
    names = list(SWITCH) if models == "all" else [models] if isinstance(models, str) else list(models)
    presets = [SWITCH.get(n, n) for n in names]
    unknown = [n for n in presets if n not in PRESETS]
    if unknown or not presets:
        raise ValueError(f"unknown models {unknown}; choose 'all', {sorted(SWITCH)} or presets {sorted(PRESETS)}")
    return presets


def train_models(train: DataFrame, test: DataFrame, features: str = "embedding", label: str = "label",
                 models: list[str] | str = "all", seed: int = 42, keep: list[str] | None = None,
                 settings: dict[str, dict] | None = None) -> DataFrame:
    """M7: fit each selected configuration (see ``switch``) on ``train`` and score both tables into one long
    table ``(keep..., model, split, label, score, prediction)``. ``settings`` overrides by preset name."""
    out = None
    for n in switch(models):
        fc = fit_classifier(train, features, label, n, seed=seed, **(settings or {}).get(n, {}))
        part = fc.score(train, "train", keep).unionByName(fc.score(test, "test", keep))
        out = part if out is None else out.unionByName(part)
    return out
