"""Exact ranking and classification metrics over a scored table.

Input rows: ``(by..., label 0/1, score[, prediction])``. AUC and ROC are exact (ties count half)
and never sort the whole table in one task: rows are first reduced to one row per distinct score
and group, scores are cut into ~``num_buckets`` ranges by approximate quantiles of the distinct scores (a
bounded list of boundaries), prefix sums run per range in parallel and the per-range offsets come from a table with
one row per (group, range).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import require_columns

SAMPLED_SCORES = 1 << 17


def _checked(df: DataFrame, label: str, score: str) -> tuple[F.Column, F.Column]:
    """Label and score of a row; a null or NaN score, or a label other than 0 and 1, is an error
    (dropping such rows would change the result without notice)."""
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    y = F.when(y.isin(0.0, 1.0), y.cast("int")).otherwise(
        F.raise_error(F.lit(f"scored table: '{label}' must be 0 or 1")).cast("int"))
    s = F.when(s.isNotNull() & ~F.isnan(s), s).otherwise(
        F.raise_error(F.lit(f"scored table: '{score}' must not be null or NaN")).cast("double"))
    return y, s


def _score_groups(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    require_columns(df, *by, label, score, what="scored table")
    y, s = F.col("_y"), F.col("_s")
    y_checked, s_checked = _checked(df, label, score)
    return (df.select(*by, y_checked.alias("_y"), s_checked.alias("_s")).groupBy(*by, s)
            .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("_pos"),
                 F.sum(F.when(y == 0, 1).otherwise(0)).cast("long").alias("_neg")))


def _raw_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.select(_checked(df, label, score)[1].alias("_s"))


def _num_buckets(df: DataFrame, num_buckets: int | None) -> int:
    if num_buckets:
        return max(1, int(num_buckets))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, 4 * n)


def _with_below(g: DataFrame, by: list[str], num_buckets: int | None, raw: DataFrame | None = None) -> DataFrame:
    """Add ``_pos_below`` / ``_neg_below`` (sums over strictly smaller scores in the same group) and
    the group totals ``_P`` / ``_N``, all carried by the per-(group, range) table."""
    k = _num_buckets(g, num_buckets)
    # boundaries: at most k values (a bounded driver-side list), then a JVM-side binary search
    qs = [i / k for i in range(1, k)]
    # quantiles of the distinct scores, so that a score with many rows does not use up the ranges. Beyond
    # SAMPLED_SCORES distinct ones (a map-side sketch counts them) those with a thin part of the hash values
    # stand for all; the ranges only deal out work
    src = (raw if raw is not None else g).select("_s")
    thin = 1 + int(src.agg(F.approx_count_distinct("_s").alias("d")).first()["d"]) // SAMPLED_SCORES
    some = src.filter(F.pmod(F.xxhash64("_s"), F.lit(thin)) == 0) if thin > 1 else src
    row = some.distinct().agg(F.percentile_approx("_s", qs, 10000).alias("q")).first()
    bounds = sorted({float(x) for x in (row["q"] or []) if x is not None and math.isfinite(x)})
    splits = [float("-inf")] + bounds + [float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    g = Bucketizer(splits=splits, inputCol="_s", outputCol="_bk", handleInvalid="keep").transform(g)
    g = g.withColumn("_bk", F.col("_bk").cast("int"))
    inner = Window.partitionBy(*by, "_bk").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    g = (g.withColumn("_pos_in", F.coalesce(F.sum("_pos").over(inner), F.lit(0)))
         .withColumn("_neg_in", F.coalesce(F.sum("_neg").over(inner), F.lit(0))))
    tot = g.groupBy(*by, "_bk").agg(F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bn"))
    # a window over the per-(group, range) table: at most ``k`` rows per group
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    outer = group.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_bk",
                      F.coalesce(F.sum("_bp").over(outer), F.lit(0)).alias("_po"),
                      F.coalesce(F.sum("_bn").over(outer), F.lit(0)).alias("_no"),
                      F.sum("_bp").over(group).alias("_P"), F.sum("_bn").over(group).alias("_N"))
    return (g.join(offs, on=[*by, "_bk"], how="inner")
            .withColumn("_pos_below", F.col("_po") + F.col("_pos_in"))
            .withColumn("_neg_below", F.col("_no") + F.col("_neg_in"))
            .drop("_pos_in", "_neg_in", "_po", "_no"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None,
            num_buckets: int | None = None) -> DataFrame:
    """V1: ``(by..., auc, n_pos, n_neg)``; ties count half; a group with one class raises."""
    by = list(by or [])
    g = _with_below(_score_groups(df, by, label, score), by, num_buckets, _raw_scores(df, label, score))
    agg = g.groupBy(*by).agg(
        F.sum(F.col("_pos") * (F.col("_neg_below") + 0.5 * F.col("_neg"))).alias("_u"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))) \
        .otherwise(F.raise_error(F.lit("roc_auc: only one class present, AUC is undefined")))
    return agg.select(*by, auc.cast("double").alias("auc"), "n_pos", "n_neg")


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", by: list[str] | None = None,
              num_buckets: int | None = None, drop_intermediate: bool = False) -> DataFrame:
    """V2: ``(by..., fpr, tpr, threshold)``: one point per distinct score (descending thresholds)
    plus the start point (0, 0, +inf). ``drop_intermediate`` applies the library rule: a point is
    dropped when the count steps to its neighbours are equal on both axes (the first and the last
    point of the curve are always kept, the start point is added afterwards)."""
    by = list(by or [])
    g = _with_below(_score_groups(df, by, label, score), by, num_buckets, _raw_scores(df, label, score))
    g = g.select(*by, "_bk", "_s", "_P", "_N", (F.col("_N") - F.col("_neg_below")).alias("_fps"),
                 (F.col("_P") - F.col("_pos_below")).alias("_tps"),
                 ((F.col("_pos_below") + F.col("_pos") == F.col("_P"))
                  & (F.col("_neg_below") + F.col("_neg") == F.col("_N"))).alias("_highest"))
    if drop_intermediate:
        g = _drop_equal_steps(g, by)
    both = (F.col("_P") > 0) & (F.col("_N") > 0)

    def rate(count: str, total: str) -> F.Column:
        return F.when(both, F.col(count) / F.col(total)).otherwise(
            F.raise_error(F.lit("roc_curve: only one class present")).cast("double"))

    point = F.struct(rate("_fps", "_N").alias("fpr"), rate("_tps", "_P").alias("tpr"), F.col("_s").alias("threshold"))
    start = F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    # the row of the group's highest score also gives the start point
    points = F.when(F.col("_highest"), F.array(start, point)).otherwise(F.array(point))
    return g.select(*by, F.explode(points).alias("_p")).select(*by, "_p.fpr", "_p.tpr", "_p.threshold")


def _drop_equal_steps(g: DataFrame, by: list[str]) -> DataFrame:
    """Neighbours in descending score order without a window over a whole group: inside a score
    range by lag/lead over that range; across ranges from a table of the top and bottom point of
    each (group, range), i.e. at most ``2 * num_buckets`` rows per group."""
    inb = Window.partitionBy(*by, "_bk").orderBy(F.col("_s").desc())
    g = (g.withColumn("_pf", F.lag("_fps").over(inb)).withColumn("_pt", F.lag("_tps").over(inb))
         .withColumn("_nf", F.lead("_fps").over(inb)).withColumn("_nt", F.lead("_tps").over(inb)))
    pt = F.struct(F.col("_fps").alias("f"), F.col("_tps").alias("t"))
    edges = g.groupBy(*by, "_bk").agg(F.max_by(pt, "_s").alias("_top"), F.min_by(pt, "_s").alias("_bot"))
    ow = Window.partitionBy(*by).orderBy("_bk") if by else Window.orderBy("_bk")  # bounded per group
    edges = edges.select(*by, "_bk", F.lead("_bot").over(ow).alias("_up"), F.lag("_top").over(ow).alias("_down"))
    g = g.join(edges, on=[*by, "_bk"], how="inner")
    pf, ptt = F.coalesce("_pf", "_up.f"), F.coalesce("_pt", "_up.t")
    nf, nt = F.coalesce("_nf", "_down.f"), F.coalesce("_nt", "_down.t")
    equal = ((F.col("_fps") - pf) == (nf - F.col("_fps"))) & ((F.col("_tps") - ptt) == (nt - F.col("_tps")))
    return g.filter(pf.isNull() | nf.isNull() | ~equal).drop("_pf", "_pt", "_nf", "_nt", "_up", "_down")


def auc_gap(df: DataFrame, label: str = "label", score: str = "score", model: str = "model",
            split: str = "split", train: str = "train", test: str = "test",
            num_buckets: int | None = None) -> DataFrame:
    """V3: ``(model, train_auc, test_auc, gap = train_auc - test_auc)``."""
    a = roc_auc(df, label, score, [model, split], num_buckets)
    p = a.groupBy(model).pivot(split, [train, test]).agg(F.first("auc"))
    return p.select(model, F.col(train).alias("train_auc"), F.col(test).alias("test_auc"),
                    (F.col(train) - F.col(test)).alias("gap"))


def compare_models(df: DataFrame, label: str = "label", score: str = "score", model: str = "model",
                   split: str = "split", num_buckets: int | None = None) -> DataFrame:
    """V6 + O4: the V3 table with a rank, best test AUC first (one row per model)."""
    t = auc_gap(df, label, score, model, split, num_buckets=num_buckets)
    w = Window.orderBy(F.col("test_auc").desc_nulls_last(), F.col(model))  # one row per model
    return t.withColumn("rank", F.row_number().over(w)).orderBy("rank")


def _pair_counts(df: DataFrame, by: list[str], label: str, prediction: str) -> DataFrame:
    """(by..., label, prediction, count), one row per pair that occurs; a null in either is an error."""
    require_columns(df, *by, label, prediction)
    df = df.select(*by, *[F.when(F.col(c).isNotNull(), F.col(c).cast("int")).otherwise(
        F.raise_error(F.lit(f"confusion matrix: '{c}' must not be null")).cast("int")).alias(c)
        for c in (label, prediction)])
    return df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("count"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     by: list[str] | None = None) -> DataFrame:
    """V4: ``(by..., label, prediction, count)`` for every pair of classes, zeros kept."""
    by = list(by or [])
    counts = _pair_counts(df, by, label, prediction)
    # per group, every class seen as a label or a prediction; the grid is the result's own size
    classes = (counts.select(*by, F.explode(F.array(label, prediction)).alias("_c"))
               .groupBy(*by).agg(F.array_sort(F.collect_set("_c")).alias("_cs")))
    grid = (classes.select(*by, F.explode("_cs").alias(label), "_cs")
            .select(*by, label, F.explode("_cs").alias(prediction), F.lit(0).cast("long").alias("count")))
    return (counts.unionByName(grid).groupBy(*by, label, prediction)
            .agg(F.sum("count").cast("long").alias("count")))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          by: list[str] | None = None, class_names: dict | None = None) -> DataFrame:
    """V5: per class precision, recall, f1, support, then 'accuracy', 'macro avg' and
    'weighted avg' rows. 0/0 gives 0."""
    by = list(by or [])
    counts = _pair_counts(df, by, label, prediction)
    n, none = F.col("count"), F.lit(0).cast("long")
    hit = F.when(F.col(label) == F.col(prediction), n).otherwise(none)
    sides = F.array(F.struct(F.col(label).alias("_c"), hit.alias("tp"), n.alias("support"), none.alias("pred")),
                    F.struct(F.col(prediction).alias("_c"), none.alias("tp"), none.alias("support"), n.alias("pred")))
    per = (counts.select(*by, F.explode(sides).alias("_x")).select(*by, "_x.*").groupBy(*by, "_c")
           .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "pred")]))

    def safe(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per = (per.withColumn("precision", safe(F.col("tp"), F.col("pred")))
           .withColumn("recall", safe(F.col("tp"), F.col("support")))
           .withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))
    name = F.col("_c").cast("string")
    if class_names:
        m = F.create_map(*[x for k, v in class_names.items() for x in (F.lit(int(k)), F.lit(str(v)))])
        name = F.coalesce(m[F.col("_c")], name)

    def row(cls, precision, recall, f1, support):
        return F.struct(cls.alias("class"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
                        support.cast("long").alias("support"))

    scores = ("precision", "recall", "f1")
    # one row per group holds its classes' rows, so the summary rows need no second read
    agg = per.groupBy(*by).agg(
        F.collect_list(row(name, *[F.col(c) for c in scores], F.col("support"))).alias("_rows"),
        F.sum("tp").alias("_tp"), F.sum("support").alias("_n"),
        *[F.avg(c).alias(f"_m_{c}") for c in scores],
        *[F.sum(F.col(c) * F.col("support")).alias(f"_w_{c}") for c in scores])
    total, null = F.col("_n"), F.lit(None).cast("double")
    summary = F.array(row(F.lit("accuracy"), null, null, F.col("_tp") / total, total),
                      row(F.lit("macro avg"), *[F.col(f"_m_{c}") for c in scores], total),
                      row(F.lit("weighted avg"), *[F.col(f"_w_{c}") / total for c in scores], total))
    return agg.select(*by, F.explode(F.concat("_rows", summary)).alias("_r")).select(*by, "_r.*")


def decide(df: DataFrame, score: str = "score", threshold: float = 0.5, out: str = "prediction") -> DataFrame:
    """Class 1 when the score passes the threshold."""
    return df.withColumn(out, (F.col(score) > F.lit(threshold)).cast("int"))
