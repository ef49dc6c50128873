"""The steps that grow with the rows of v8_encoder_facts, m7_switch_facts and e4_incremental_vectors."""

import glob
import re

import numpy as np
from pyspark.sql import functions as F


def _nodes(df, name):
    return len(re.findall(name, df._jdf.queryExecution().executedPlan().toString()))


def test_texts_are_counted_together(monkeypatch):
    from vellum.operators import subwords as SW

    texts = [None, "", "one two one", "w" * 500, "\n-- !"] + [f"word{i} again {i % 5}" for i in range(300)] + ["last one", ""]
    want = []
    for t in texts:
        found = [SW.word_buckets(w, 97) for w in SW.WORD.findall((t or "").lower())]
        want.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.array([]), np.array([])))
    for words in (1, 7, 1 << 14):
        monkeypatch.setattr(SW, "WORDS", words)
        bounds, at, n = SW.TextBuckets(97).many(texts)
        assert len(bounds) == len(texts) + 1 and bounds[-1] == len(at) == len(n)
        for i, (a, k) in enumerate(want):
            assert np.array_equal(at[bounds[i]: bounds[i + 1]], a) and np.array_equal(n[bounds[i]: bounds[i + 1]], k)
    assert SW.TextBuckets(97).many([])[0].tolist() == [0]


def test_words_counted_together_are_bounded(monkeypatch):
    from vellum.operators import subwords as SW

    monkeypatch.setattr(SW, "WORDS", 100)
    seen, plain = [], SW.TextBuckets._counted
    monkeypatch.setattr(SW.TextBuckets, "_counted", lambda s, found, n: seen.append((len(found), len(n))) or plain(s, found, n))
    SW.TextBuckets(64).many(["a b c"] * 200 + ["d " * 1000])
    assert sum(w for w, _ in seen) == 1600 and all(w - 1000 < 100 for w, _ in seen) and sum(n for _, n in seen) == 201


def test_encoder_is_one_python_step(spark):
    from vellum.operators.contrastive import init_projection
    from vellum.operators.encode import TextEncoder
    from vellum.operators.subwords import SubwordTable

    enc = TextEncoder(SubwordTable(None, 64, 8, 3), "t", init_projection(8, 4, 3))
    df = spark.createDataFrame([("one two",), ("",), (None,), ("three",)], "t string")
    made = enc.transform(df)
    assert _nodes(made, "ArrowEvalPython") == 1
    x = np.array([r["f"] for r in enc.features(df, "f").collect()])
    from vellum.operators.contrastive import projection_forward
    _, _, e = projection_forward(x, enc.projection.W, enc.projection.b)
    assert np.allclose(np.array([r["embedding"] for r in made.collect()]), e.astype(np.float32), atol=1e-7)


def test_words_are_counted_once(spark):
    from vellum.operators.lookback import truncate_tokens

    df = spark.createDataFrame([(None,), ("",), (" ",), ("a  b\tc",), ("a b c d\n e",)], "t string")
    for most, want in ((3, [("", 0), ("", 0), (" ", 0), ("a  b\tc", 3), ("a b c", 3)]),
                       (0, [("", 0), ("", 0), (" ", 0), ("", 0), ("", 0)]),
                       (None, [("", 0), ("", 0), (" ", 0), ("a  b\tc", 3), ("a b c d\n e", 5)])):
        made = truncate_tokens(df, most, "t")
        assert [tuple(r) for r in made.collect()] == want and made.schema["token_count"].dataType.simpleString() == "bigint"
        assert _nodes(made, "regexp_extract_all") <= 2


def test_adam_step_in_place():
    from vellum.operators import network as NW

    r = np.random.default_rng(5)
    theta, m, v = r.normal(size=50), r.normal(size=50), r.random(50)
    a, b, c = theta.copy(), m.copy(), v.copy()
    adam = NW.Adam(a, b, c, 0.01, (0.9, 0.999), 1e-8)
    for t in range(1, 6):
        g = r.normal(size=50)
        m, v = 0.9 * m + (1 - 0.9) * g, 0.999 * v + (1 - 0.999) * g * g
        theta = theta - 0.01 * (np.sqrt(1 - 0.999**t) / (1 - 0.9**t)) * m / (np.sqrt(v) + 1e-8)
        adam.step(g, t)
        assert np.array_equal(a, theta) and np.array_equal(b, m) and np.array_equal(c, v)


def test_packed_shards_are_dealt_to_all_cores(spark):
    from vellum.operators import rounds as RD

    rows = spark.range(640).select(F.array(F.col("id") / 7, F.lit(1.5)).alias("x"), (F.col("id") % 2).alias("y"))
    dealt, _ = RD.write_shards(rows, 128, 2, 5)  # 64 shards
    packed, path = RD.pack_shards(dealt.coalesce(1))
    cores = spark.sparkContext.defaultParallelism
    assert len(glob.glob(f"{path}/*.parquet")) >= min(cores, 64)
    assert packed.select("shard").distinct().count() == packed.count() == 64


def test_quantile_marks_are_one_value(spark, monkeypatch):
    from vellum.operators import boosting as BO

    seen, plain = [], F.percentile_approx
    monkeypatch.setattr(BO.F, "percentile_approx", lambda c, marks, n: seen.append(marks) or plain(c, marks, n))
    df = spark.range(1, 101).select(F.array(F.col("id").cast("double"), F.lit(2.0)).alias("x"))
    cuts = BO.quantile_cuts(df, "x", 2, 4)
    assert [c.tolist() for c in cuts] == [[25.0, 50.0, 75.0], []]
    assert not any(isinstance(m, list) for m in seen)
