"""Hashed subword vectors trained with the projection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import contrastive as CS
from vellum.operators import encode as EN
from vellum.operators import subwords as SW


def _texts(spark, n=240, seed=0):
    """Three topics that share no whole words between train and held-out, only stems."""
    rng = np.random.default_rng(seed)
    stems = [["credit", "loan", "paym"], ["goal", "match", "leag"], ["rain", "wind", "cloud"]]
    rows = []
    for i in range(n):
        y = i % 3
        words = [stems[y][rng.integers(3)] + "".join(rng.choice(list("abcdefgh"), 2)) for _ in range(6)]
        words += ["".join(rng.choice(list("mnopqrst"), 4)) for _ in range(4)]
        rows.append((i, " ".join(rng.permutation(words)), y))
    return spark.createDataFrame(rows, "k long, t string, y int")


def _held_out(enc, df):
    e = enc.transform(df).withColumn("batch_id", F.col("k") % 8)
    return CS.batch_loss(e, label="y").first().loss


SETTINGS = dict(buckets=1 << 12, dim=16, embedding_dim=8, epochs=6, batch_size=16, lr=0.02, table_lr=0.05, shard_batches=4)


def test_joint_fit_lowers_the_held_out_loss(spark, tmp_dir):
    train, held = _texts(spark), _texts(spark, 120, seed=7)
    enc = EN.TextEncoder.fit_joint(train, "t", "y", **SETTINGS)
    start = EN.TextEncoder(SW.SubwordTable(None, 1 << 12, 16, 42), "t", CS.init_projection(16, 8, 42))
    assert _held_out(enc, held) < 0.75 * _held_out(start, held)
    assert enc.projection.history[-1]["loss"] < enc.projection.history[0]["loss"]
    # the table matters beside the head: the head alone on untrained vectors is worse
    rows = spark.read.parquet(enc.featurizer.path)
    assert rows.count() == rows.select("bucket").distinct().count() <= 1 << 12
    more = EN.TextEncoder.fit_joint(train, "t", "y", initial=enc, **{**SETTINGS, "epochs": 1})
    assert more.projection.history[6]["loss"] < enc.projection.history[0]["loss"]
    enc.save(tmp_dir + "/enc")
    back = EN.TextEncoder.load(spark, tmp_dir + "/enc")
    a, b = ({r.k: r.embedding for r in x.transform(held).collect()} for x in (enc, back))
    assert a == b


def test_vectors_do_not_depend_on_partitions(spark):
    df = _texts(spark, 120)
    kw = {**SETTINGS, "epochs": 2}
    got = []
    for parts in (2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            enc = EN.TextEncoder.fit_joint(df.repartition(parts), "t", "y", **kw)
            got.append((enc.featurizer.matrix(spark), enc.projection.W))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert np.abs(got[0][0] - got[1][0]).max() < 1e-9 and np.abs(got[0][1] - got[1][1]).max() < 1e-9


def test_one_shard_equals_a_plain_loop(spark):
    """Table and head after one epoch of one shard, against dense numpy with finite-difference gradients."""
    df = _texts(spark, 12)
    kw = dict(buckets=64, dim=3, embedding_dim=2, epochs=1, batch_size=12, lr=0.02, table_lr=0.05, shard_batches=4,
              loss="cosine_similarity")
    enc = EN.TextEncoder.fit_joint(df, "t", "y", **kw)
    split = SW.TextBuckets(64)
    # one batch: rows in the order of their content
    numbered = SW.write_shards(df.select(F.col("t").alias("x"), F.col("y").cast("long").alias("y")), 1, 4, 42)[0].first()
    texts = [(r["x"], r["y"]) for r in numbered["batches"][0]["rows"]]
    parts, y = [split(t) for t, _ in texts], np.array([k for _, k in texts])
    head = CS.init_projection(3, 2, 42)
    table = SW.rule_vectors(np.arange(64), 3, 42)

    def loss(tab):
        _, _, e = CS.projection_forward(SW.text_means(parts, tab), head.W, head.b)
        total, n, _ = CS.embedding_gradient(e, y, "cosine_similarity")
        return total / n

    grad, h = np.zeros_like(table), 1e-6
    for i in range(64):
        for j in range(3):
            up, down = table.copy(), table.copy()
            up[i, j] += h
            down[i, j] -= h
            grad[i, j] = (loss(up) - loss(down)) / (2 * h)
    acc = (grad * grad).mean(1)
    want = table - 0.05 * grad / (np.sqrt(acc) + 1e-8)[:, None]
    used = sorted({int(b) for at, _ in parts for b in at})
    got = enc.featurizer.matrix(spark)
    strong = [b for b in used if acc[b] > 1e-12]
    assert len(strong) > 20 and np.abs(got[strong] - want[strong]).max() < 1e-3
    rest = [b for b in range(64) if b not in used]
    assert np.allclose(got[rest], table[rest], atol=1e-7)


def test_odd_texts(spark):
    df = spark.createDataFrame([(0, None, 0), (1, "", 1), (2, " ... ", 0), (3, "ñandú 日本語 " * 5000, 1), (4, "one", 0),
                                (4, "one", 0), (5, "one", 1)], "k long, t string, y int")
    enc = EN.TextEncoder.fit_joint(df, "t", "y", **{**SETTINGS, "epochs": 1})
    got = {r.k: r.embedding for r in enc.transform(df).collect()}
    assert len(got) == 6 and got[0] == got[1] == got[2] and all(len(v) == 8 for v in got.values())
    with pytest.raises(ValueError, match="empty"):
        EN.TextEncoder.fit_joint(df.limit(0), "t", "y", **SETTINGS)
    with pytest.raises(ValueError, match="exceeds"):
        SW.SubwordTable(None, 1 << 24, 64, 1)


def test_hot_bucket_and_label(spark):
    """One word in every text, one text in a third of the rows: still bounded shards and finite vectors."""
    rows = [(i, "common " + ("same text" if i % 3 == 0 else f"text{i} of{i % 7}"), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, t string, y int")
    enc = EN.TextEncoder.fit_joint(df, "t", "y", **{**SETTINGS, "epochs": 1, "shard_batches": 2})
    assert np.isfinite(enc.featurizer.matrix(spark)).all() and np.isfinite(enc.projection.W).all()
