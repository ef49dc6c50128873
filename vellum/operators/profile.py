"""Label distributions, class balance and weights, batch statistics, dataset profiles, seeded
ordering and batching, union. All results are DataFrames; nothing is collected to the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import require_columns


def label_distribution(df: DataFrame, label: str = "DefaultDPD21") -> DataFrame:
    """A3 sparse: ``(label, count)`` for the labels that occur, sorted by label."""
    require_columns(df, label)
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count")).orderBy(label)


def label_distribution_dense(df: DataFrame, label: str = "DefaultDPD21") -> DataFrame:
    """A3 dense (``bincount``): one row for every label ``0..max`` with zero counts kept.
    Labels must be non-negative integers; nulls are not counted."""
    require_columns(df, label)
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    top = counts.agg(F.max(label)).first()[0]  # one value
    # the 0..max grid is a distributed range, not one task exploding a sequence
    grid = df.sparkSession.range(0, (int(top) + 1) if top is not None else 0).select(
        F.col("id").cast("int").alias(label))
    counts = counts.withColumn(label, F.col(label).cast("int"))
    return (grid.join(counts, on=label, how="left")
            .select(label, F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
            .orderBy(label))


def class_balance(df: DataFrame, label: str = "DefaultDPD21") -> DataFrame:
    """A4: one row ``n0, n1, pct0, pct1, scale_pos_weight = n0 / n1``; no positives raises."""
    require_columns(df, label)
    agg = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    n = F.col("n0") + F.col("n1")
    return agg.select(
        "n0", "n1",
        (F.col("n0") * 100.0 / n).alias("pct0"),
        (F.col("n1") * 100.0 / n).alias("pct1"),
        F.when(F.col("n1") > 0, F.col("n0") / F.col("n1"))
        .otherwise(F.raise_error(F.lit("class_balance: no positive rows, scale_pos_weight undefined")))
        .cast("double").alias("scale_pos_weight"))


def balanced_weights(df: DataFrame, label: str = "DefaultDPD21", weight: str = "weight") -> DataFrame:
    """``weight = n / (n_classes * n_c)`` per row (sklearn's 'balanced').

    The per-class counts (one row per class) are joined back by label; whether that table is
    broadcast or shuffled is left to its measured size at run time, and AQE splits skewed labels."""
    require_columns(df, label)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))  # one row
    counts = _one_row_join(tot, counts).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight))
    return df.join(counts, on=label, how="left").select(*df.columns, weight)


def batch_stats(before: DataFrame, after: DataFrame, token_count: str = "token_count",
                by: str | None = None) -> DataFrame:
    """A5: look-back rows before the label join, rows after, min/max/mean token count (optionally per ``by``)."""
    require_columns(after, token_count)
    keys = [by] if by else []
    b = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after"),
                                 F.min(token_count).alias("min_tokens"),
                                 F.max(token_count).alias("max_tokens"),
                                 F.avg(token_count).alias("mean_tokens"))
    if keys:
        return b.join(a, on=keys, how="full").na.fill(0, ["rows_before", "rows_after"])
    return _one_row_join(b, a)


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` is a global aggregate (exactly one row, so broadcasting it is bounded); ``b`` keeps its
    partitioning."""
    return F.broadcast(a.withColumn("_one", F.lit(1))).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def dataset_profile(df: DataFrame, dataset: str, label: str | None = "DefaultDPD21") -> DataFrame:
    """``(dataset, rows, columns, label, count)``: one row per label value when the label
    column exists, else one row with null label/count. ``df`` is evaluated once: the rows are the sum of the
    label counts (a window over the one-row-per-label table)."""
    cols = F.array(*[F.lit(c) for c in df.columns])
    if label and label in df.columns:
        dist = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
        out = dist.withColumn("rows", F.sum("count").over(Window.partitionBy()))
    else:
        total = df.agg(F.count(F.lit(1)).alias("rows"))
        out = total.select("rows", F.lit(None).cast("int").alias("label"), F.lit(None).cast("long").alias("count"))
    return out.select(F.lit(dataset).alias("dataset"), "rows", cols.alias("columns"), "label", "count")


def distinct_labels(df: DataFrame, label: str = "DefaultDPD21") -> DataFrame:
    """The distinct labels, sorted."""
    return df.select(label).distinct().orderBy(label)


def _row_hash(df: DataFrame, columns: list[str], seed: int) -> Column:
    """md5 (hexadecimal) of the seed and the columns' texts; a timestamp's text has six decimals."""
    def text(c: str) -> Column:
        if isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return F.col(c).cast("string")
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(text(c), F.lit("")) for c in columns]))


def seeded_order(df: DataFrame, key: str, seed: int = 0, col: str = "order_key") -> DataFrame:
    """O2: a deterministic shuffle: order by ``md5(seed|key)`` (stable under task retries).

    Rows of one key are tied on that order; a hash of the whole row and then a row id break the
    ties so the range partitioner of the sort can split a key (or a set of identical copies) that
    holds a large share of the rows. Only the order among identical rows depends on the row id."""
    whole = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    return (df.withColumn(col, _row_hash(df, [key], seed))
            .withColumn("_tie", whole).withColumn("_rid", F.monotonically_increasing_id())
            .orderBy(col, key, "_tie", "_rid").drop("_tie", "_rid"))


def assign_batches(df: DataFrame, batch_size: int, by: list[str] | None = None, seed: int = 0,
                   col: str = "batch_id") -> DataFrame:
    """O3: batches of exactly ``batch_size`` rows (the last may hold fewer): a row's place in the
    order of ``md5(seed|by...)`` (all columns by default), divided by the batch size.

    Identical rows are counted map-side and take consecutive places, so a hot key or a run of copies
    spreads over as many batches as it needs. Places are running sums inside 65,536 hash ranges plus
    each range's offset (a table of at most that many rows): no global sort."""
    if batch_size <= 0:
        raise ValueError("batch_size must be > 0")
    cols = df.columns
    same = (df.withColumn("_h", _row_hash(df, list(by or cols), seed)).groupBy("_h", *cols)
            .agg(F.count(F.lit(1)).alias("_n")).withColumn("_range", F.substring("_h", 1, 4)))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = same.groupBy("_range").agg(F.sum("_n").alias("_size"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before.orderBy("_range")), F.lit(0)).alias("_off"))
    inside = before.partitionBy("_range").orderBy("_h", *cols)
    placed = (same.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
              .join(F.broadcast(offsets), "_range").withColumn("_at", F.col("_at") + F.col("_off")))
    # copies are numbered in chunks of 1,024 that are dealt anew, so no task makes all of a hot row's
    chunk = placed.select("*", F.explode(F.expr("sequence(0, (_n - 1) div 1024)")).alias("_c"))
    row = chunk.repartition("_h", "_c").select(
        *cols, "_at", F.explode(F.expr("sequence(_c * 1024, least(_n, (_c + 1) * 1024) - 1)")).alias("_i"))
    return row.select(*cols, F.expr(f"(_at + _i) div {int(batch_size)}").alias(col))


def rank_by(df: DataFrame, metric: str, ascending: bool = False) -> DataFrame:
    """Sort a metric table, best first."""
    return df.orderBy(F.col(metric).asc() if ascending else F.col(metric).desc())


def union_all(*dfs: DataFrame) -> DataFrame:
    """Vertical concat by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
