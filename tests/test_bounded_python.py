"""Python tasks hold a bounded number of texts, whatever an Arrow batch or a shard holds."""

import pyarrow as pa

from vellum.functions import text as TX


def test_tokens_of_a_batch_are_made_in_pieces(monkeypatch):
    with open(TX.default_tokenizer_path(), "rb") as f:
        data = f.read()
    tok = TX._load_tokenizer(data)
    seen = []

    class Spy:
        def encode_batch(self, texts, **kw):
            seen.append(sum(map(len, texts)))
            return tok.encode_batch(texts, **kw)

        def decode(self, ids, **kw):
            return tok.decode(ids, **kw)

    monkeypatch.setattr(TX, "_load_tokenizer", lambda _: Spy())
    texts = ["plain words, 12 of them " * k for k in range(40)] + [None, "", "é " * 3000]
    col = pa.array(texts, pa.string())
    whole = TX._truncate_count(col, data, 16).to_pylist()
    seen.clear()
    monkeypatch.setattr(TX, "PIECE", 1500)
    monkeypatch.setattr(TX, "ROWS", 7)
    assert TX._truncate_count(col, data, 16).to_pylist() == whole
    assert len(seen) > 10 and max(seen) == 6000  # one long text is a piece of its own
    assert [r["token_count"] for r in whole[-3:]] == [0, 0, 16] and whole[-3]["text"] == ""
    for t, r in zip(texts, whole):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert r["text"] == ((t or "") if len(ids) <= 16 else tok.decode(ids[:16]))
        assert r["token_count"] == len(tok.encode(r["text"], add_special_tokens=False).ids)
    assert TX._truncate_count(col.slice(0, 0), data, 16).to_pylist() == []


def test_shards_travel_as_arrays(spark):
    """A round gives its function arrays, and a task gives one vector for all its shards."""
    import numpy as np
    from pyspark.sql import functions as F

    from vellum.operators import rounds as RD

    rows = spark.range(300).select(F.array(F.col("id") / 7, F.lit(1.5)).alias("x"), (F.col("id") % 2).alias("y"))
    dealt, _ = RD.write_shards(rows, 20, 3, 5)
    packed, _ = RD.pack_shards(dealt)
    want = {r["shard"]: r["batches"] for r in dealt.collect()}
    assert len(want) == 7
    for batch in packed.toArrow().to_batches():
        for s in RD.packed_shards(batch):
            held = s.batches()
            for b in want.pop(s.shard):
                assert s.x[held[b["number"]]].tolist() == [r["x"] for r in b["rows"]]
                assert s.y[held[b["number"]]].tolist() == [r["y"] for r in b["rows"]]
            assert s.x.shape == (len(s.y), 2) and s.bounds[-1] == len(s.y)
    assert not want

    def local(state, shard):
        assert isinstance(shard.x, np.ndarray) and (shard.x[:, 1] == 1.5).all()
        return state + 1, float(len(shard.y)), np.array([shard.x[:, 0].sum(), float(shard.y.sum())])

    state, extras = RD.one_round(packed.coalesce(1), np.array([1.0, 2.0]), local)
    assert state.tolist() == [2.0, 3.0] and extras[1] == 150 and abs(extras[0] - sum(range(300)) / 7) < 1e-9


def test_texts_of_a_batch_are_embedded_in_parts(monkeypatch):
    import numpy as np

    from vellum.operators import subwords as SW

    split, vectors = SW.TextBuckets(512), SW.rule_vectors(np.arange(512), 8, 3)
    texts = [None, "", "one two", "w" * 500] + [f"word{i} again {i % 5}" for i in range(700)]
    col = pa.array(texts, pa.string())
    want = SW.text_means([SW.TextBuckets(512)(t) for t in texts], vectors)
    sizes, plain = [], SW.text_means
    monkeypatch.setattr(SW, "text_means", lambda counts, v: sizes.append(len(counts)) or plain(counts, v))
    assert (SW.column_means(col, split, vectors) == want).all()
    assert max(sizes) <= SW.TEXTS and sum(sizes) == len(texts)
    assert all(isinstance(v, np.ndarray) for v in split.memo.values())  # four bytes a bucket
    assert "w" * 500 not in split.memo and "again" in split.memo


def test_shards_of_texts_become_shards_of_buckets(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from vellum.operators import rounds as RD
    from vellum.operators import subwords as SW

    rows = spark.range(90).select(F.when(F.col("id") % 9 > 0, F.concat(F.lit("text "), F.col("id") % 7)).alias("x"),
                                  F.when(F.col("id") % 8 > 0, F.col("id") % 2).alias("y"))
    dealt, _ = RD.write_shards(rows, 12, 5, 1)
    made = {r["shard"]: r["batches"] for r in SW._with_buckets(dealt, 64).collect()}
    split, old = SW.TextBuckets(64), {r["shard"]: r["batches"] for r in dealt.collect()}
    assert len(made) == 3 and sorted(made) == sorted(old)
    for shard, batches in old.items():
        assert [b["number"] for b in batches] == [b["number"] for b in made[shard]]
        for b, m in zip(batches, made[shard]):
            assert [r["y"] for r in b["rows"]] == [r["y"] for r in m["rows"]]
            for r, q in zip(b["rows"], m["rows"]):
                at, n = split(r["x"])
                assert np.array_equal(at, q["at"]) and np.array_equal(n, q["n"])


def test_feature_facts_build_the_datasets_once(spark, monkeypatch):
    import __spark_entry__ as E
    from vellum.plans import registry as R

    made, build = [], R._datasets
    monkeypatch.setattr(R, "_datasets", lambda *a: made.append(a) or build(*a))
    got = E.queries()["e1_feature_facts"](spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1
    assert {r["split"] for r in got} == {"train", "test"} and all(r["equal_texts_equal_vectors"] for r in got)


def test_shard_tables_have_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from vellum.operators import rounds as RD

    rows = spark.range(40000).select(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3) + i).alias("x"),
                                     (F.col("id") % 2).alias("y"))
    dealt, _ = RD.write_shards(rows, 200, 10, 5)
    _, path = RD.pack_shards(dealt.coalesce(1))
    sizes = [f.metadata.num_row_groups for f in map(pq.ParquetFile, glob.glob(f"{path}/*.parquet"))]
    assert sum(sizes) >= 2  # 20 MB of vectors
