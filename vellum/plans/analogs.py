"""The driver's tables in the roles the operators expect.

messages : events as (UserLoanId, CreatedAt, body = event_type || ' ' || props)
spine    : signup events with DefaultDPD21 = value > 50
vectors  : embeddings with a binary label (label < 3) and fixed-size batches of consecutive ids
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the analog definitions.
TRAIN_RANGE = ("2024-01-01", "2024-01-16")
TEST_RANGE = ("2024-01-16", "2024-01-31")
LOOKBACK_DAYS = 7
MAX_TOKENS = 24
BATCH_SIZE = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, blanks: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    body = F.concat_ws(" ", "event_type", "props")
    if blanks:
        body = F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(body)
    return ev.select(F.col("user_id").alias("UserLoanId"), F.col("ts").alias("CreatedAt"),
                     body.alias("body"))


def spine(spark: SparkSession, sf_dir: str, blank_anchors: bool = False) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    types = ["signup", "error"] if blank_anchors else ["signup"]
    return (ev.filter(F.col("event_type").isin(types))
            .select(F.col("user_id").alias("UserLoanId"), F.col("ts").alias("CreatedAt"),
                    (F.col("value") > 50).cast("int").alias("DefaultDPD21")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, embedding array<float>, label 0/1, batch_id)."""
    em = table(spark, sf_dir, "embeddings")
    return em.select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("label"),
                     F.floor(F.col("vec_id") / BATCH_SIZE).cast("long").alias("batch_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows for the metric operators: three deterministic 'models' (vector coordinates,
    floored to 2 digits so ties occur) on a train/test split by id parity (every row is kept)."""
    em = table(spark, sf_dir, "embeddings")
    split = F.when(F.col("vec_id") % 2 == 0, F.lit("train")).otherwise(F.lit("test"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("model"), F.col("embedding")[i].cast("double").alias("x"))
                               for i, name in enumerate(["m0", "m1", "m2"])])).alias("s")  # one scan
    out = em.select(split.alias("split"), (F.col("label") < 3).cast("int").alias("label"), each)
    out = out.select("s.model", "split", "label", (F.floor(F.col("s.x") * 100) / 100).alias("score"))
    return out.withColumn("prediction", (F.col("score") > 0).cast("int"))


def ruled_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train / test vectors by id parity with a label that the vectors do tell: 1 where the first four
    coordinates sum to over 0.1 (the table's own labels are random)."""
    em = table(spark, sf_dir, "embeddings")
    total = sum(F.col("embedding")[i].cast("double") for i in range(4))
    v = em.select("vec_id", "embedding", (total > 0.1).cast("int").alias("label"))
    return v.filter(F.col("vec_id") % 2 == 0), v.filter(F.col("vec_id") % 2 == 1)


def padded(c: Column, n: Column) -> Column:
    """The text with outer blanks: spaces, a no-break and an ideographic space, ``n`` times each."""
    return F.concat(F.repeat(F.lit(" \u00a0"), n.cast("int")), c, F.repeat(F.lit("\u3000 "), n.cast("int")))


def vector_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train / test vectors by id parity (every row is in exactly one split)."""
    v = vectors(spark, sf_dir)
    return v.filter(F.col("vec_id") % 2 == 0), v.filter(F.col("vec_id") % 2 == 1)


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair table: each even id with the next id; label 1 when both have the same binary label."""
    v = vectors(spark, sf_dir)
    a = v.filter(F.col("vec_id") % 2 == 0).select("vec_id", F.col("embedding").alias("emb_a"),
                                                  F.col("label").alias("_ya"), "batch_id")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("emb_b"), F.col("label").alias("_yb"))
    return a.join(b, on="vec_id").select("vec_id", "batch_id", "emb_a", "emb_b",
                                         (F.col("_ya") == F.col("_yb")).cast("int").alias("label"))
