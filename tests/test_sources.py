"""Catalog rules, incremental reads and their errors, SQL over a table, caches and stores."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from vellum.sources import cache as CA
from vellum.sources import catalog as CT
from vellum.sources import lake as LK


def _write(spark, path, n=3):
    spark.range(n).withColumn("v", F.col("id") * 2).coalesce(1).write.mode("overwrite").parquet(path)


def _single_file(spark, folder, name):
    """A real single parquet *file* named ``name`` inside ``folder``."""
    tmp = os.path.join(folder, "_tmp_" + name)
    _write(spark, tmp)
    part = [f for f in os.listdir(tmp) if f.endswith(".parquet")][0]
    os.rename(os.path.join(tmp, part), os.path.join(folder, name))


def test_catalog_rules(spark, tmp_dir):
    _single_file(spark, tmp_dir, "spine.parquet")
    os.makedirs(os.path.join(tmp_dir, "sms", "nested"))
    _single_file(spark, os.path.join(tmp_dir, "sms"), "2024-01-01.parquet")
    _write(spark, os.path.join(tmp_dir, "sms", "2024-01-02.parquet"))  # Spark output dir
    _single_file(spark, os.path.join(tmp_dir, "sms", "nested"), "2024-01-03.parquet")
    os.makedirs(os.path.join(tmp_dir, "dup"))
    _single_file(spark, tmp_dir, "dup.parquet")
    _write(spark, os.path.join(tmp_dir, "out.parquet"))
    open(os.path.join(tmp_dir, "notes.txt"), "w").write("x")
    cat = CT.TableCatalog(spark, tmp_dir + "/")
    assert cat.tables["spine"][0] == CT.FULL
    assert cat.tables["sms"][0] == CT.INCREMENTAL
    assert cat.tables["dup"][0] == CT.FULL          # file wins over directory
    assert cat.tables["out"][0] == CT.FULL          # Spark output directory
    assert "notes" not in cat.tables
    assert list(cat.tables) == sorted(cat.tables)
    assert [r.table_name for r in cat.to_df().collect()] == sorted(cat.tables)
    # not descended into nested folders
    assert cat.read_all("sms").count() == 6
    assert cat.read_table("sms", "2024-01-02").count() == 3
    assert cat.read_table("spine").count() == 3
    with pytest.raises(ValueError):
        cat.read_table("sms")                       # date required
    with pytest.raises(FileNotFoundError):
        cat.read_table("sms", "2023-12-31")         # absent date
    with pytest.raises(ValueError):
        cat.read_table("nope")                      # unknown name
    q = cat.query_table("spine", "SELECT count(*) AS n FROM <table> a JOIN <table> b ON a.id = b.id")
    assert q.first().n == 3


def test_catalog_missing_and_empty(spark, tmp_dir):
    assert CT.TableCatalog(spark, os.path.join(tmp_dir, "missing")).tables == {}
    os.makedirs(os.path.join(tmp_dir, "empty"))
    cat = CT.TableCatalog(spark, tmp_dir)
    with pytest.raises(FileNotFoundError):
        cat.read_all("empty")


def test_write_incremental_roundtrip(spark, tmp_dir):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    dates = CT.write_incremental(df, os.path.join(tmp_dir, "ev"), "ts")
    cat = CT.TableCatalog(spark, tmp_dir)
    assert cat.tables["ev"][0] == CT.INCREMENTAL and len(dates) >= 28
    assert cat.read_all("ev").count() == df.count()
    assert cat.read_dates("ev", dates[0], dates[1]).count() == \
        df.filter(F.date_format("ts", "yyyy-MM-dd").isin(dates[:2])).count()


def test_materialize_all_or_nothing(spark, tmp_dir):
    calls = []

    def b(n):
        def f():
            calls.append(n)
            return spark.range(n)
        return f

    got = CA.materialize(spark, {"a": b(2), "b": b(3)}, tmp_dir, {"p": 1})
    assert got["b"].count() == 3 and calls == [2, 3]
    CA.materialize(spark, {"a": b(2), "b": b(3)}, tmp_dir, {"p": 1})
    assert calls == [2, 3]                          # cache hit
    CA.materialize(spark, {"a": b(2), "b": b(3), "c": b(4)}, tmp_dir, {"p": 1})
    assert calls == [2, 3, 2, 3, 4]                 # partial set -> rebuild all
    CA.materialize(spark, {"a": b(2)}, tmp_dir, {"p": 2})
    assert calls[-1] == 2                           # new parameters -> new key
    CA.materialize(spark, {"a": b(2)}, tmp_dir, {"p": 2}, use_cache=False)
    assert len(calls) == 7


def test_load_data_optional(spark, tmp_dir):
    assert CA.load_data(spark, os.path.join(tmp_dir, "nope")) is None
    bad = os.path.join(tmp_dir, "bad.parquet")
    open(bad, "w").write("not parquet")
    assert CA.load_data(spark, bad) is None
    CA.save_data(spark.range(4), os.path.join(tmp_dir, "ok"))
    assert CA.load_data(spark, os.path.join(tmp_dir, "ok")).count() == 4


def test_embedding_store(spark, tmp_dir):
    st = CA.EmbeddingStore(spark, tmp_dir)
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], "k long, embedding array<float>")
    st.save(df, "enc1", "train")
    st.save(df.limit(1), "enc1", "test")
    assert st.load("enc1", "train").count() == 2 and st.load("enc1", "test").count() == 1
    assert st.load("enc2", "train") is None
    for odd in ("/runA/checkpoint-1", "/runB/checkpoint-1", "a b=c:d"):
        assert st.load(odd, "train") is None           # the whole path counts, not its last part
        st.save(df, odd, "train")
        assert st.load(odd, "train").count() == 2


def test_failed_rebuild_keeps_the_published_set(spark, tmp_dir):
    def broken():
        raise RuntimeError("no")

    CA.materialize(spark, {"a": lambda: spark.range(5), "b": lambda: spark.range(1)}, tmp_dir, {"p": 1})
    with pytest.raises(RuntimeError):
        CA.materialize(spark, {"a": lambda: spark.range(9), "b": broken}, tmp_dir, {"p": 1}, use_cache=False)
    got = CA.materialize(spark, {"a": broken, "b": broken}, tmp_dir, {"p": 1})
    assert got["a"].count() == 5 and got["b"].count() == 1


def test_dataset_cache_is_keyed_by_its_inputs(spark, tmp_dir):
    from vellum.plans.dataset import build_train_test

    t = dt.datetime(2024, 1, 2)
    msgs = spark.createDataFrame([(k, t, "x") for k in range(6)], "UserLoanId long, CreatedAt timestamp_ntz, body string")
    spine = spark.createDataFrame([(k, t, 1) for k in range(6)], "UserLoanId long, CreatedAt timestamp_ntz, DefaultDPD21 int")
    args = (("2024-01-01", "2024-01-16"), ("2024-01-16", "2024-01-31"), 7)
    assert build_train_test(msgs, spine, *args, cache_dir=tmp_dir)[0].count() == 6
    few = spine.filter("UserLoanId < 2")
    assert build_train_test(msgs, few, *args, cache_dir=tmp_dir)[0].count() == 2


def test_lake_location_and_jdbc_profiles(spark, monkeypatch):
    loc = LK.LakeLocation(container="c", directory="/raw/x/", account="acct", account_key="k")
    assert loc.uri == "abfss://c@acct.dfs.core.windows.net/raw/x"
    assert list(loc.spark_conf()) == ["spark.hadoop.fs.azure.account.key.acct.dfs.core.windows.net"]
    assert LK.LakeLocation(base_uri="/tmp/lake/", directory="a").uri == "/tmp/lake/a"
    monkeypatch.delenv(LK.ACCOUNT_ENV, raising=False)
    monkeypatch.delenv(LK.KEY_ENV, raising=False)
    with pytest.raises(ValueError):
        LK.LakeLocation(container="c")
    monkeypatch.setenv(LK.ACCOUNT_ENV, "envacct")
    monkeypatch.setenv(LK.KEY_ENV, "envkey")
    assert LK.LakeLocation(container="c").uri.startswith("abfss://c@envacct.")
    src = LK.RelationalSources(spark, {"replica": LK.JdbcProfile("jdbc:x://h/db", read_only=True),
                                       "rw": LK.JdbcProfile("jdbc:x://h/db2", driver="d.D")})
    o = src.reader_options("rw", table="t", partition_column="id", lower_bound=0, upper_bound=100, num_partitions=4)
    assert o["numPartitions"] == "4" and o["driver"] == "d.D" and o["dbtable"] == "t"
    with pytest.raises(ValueError):
        src.reader_options("nope", table="t")
    with pytest.raises(ValueError):
        src.reader_options("rw", query="select 1", partition_column="id", lower_bound=0, upper_bound=1,
                           num_partitions=2)
    with pytest.raises(PermissionError):
        src.write(spark.range(1), "replica", "t")


def test_package_reaches_workers_from_any_directory(tmp_dir):
    """A fresh driver started outside the repository runs a UDF-backed query."""
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('entry_mod', {repo + '/__spark_entry__.py'!r})\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('ROWS', E.queries()['e5_batch_hard_soft_margin'](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_dir, env=env, capture_output=True, text=True,
                       timeout=600)
    assert "ROWS 1" in r.stdout, r.stderr[-2000:]


def test_train_test_datasets_one_pass_cache(spark, tmp_dir):
    """The cached pair equals the uncached pair, also when the ranges overlap."""
    from vellum.plans import analogs as A
    from vellum.plans import dataset as DS

    sf = "/root/testdata/sf0.001"
    m, s = A.messages(spark, sf), A.spine(spark, sf)
    for tr, te in [(("2024-01-01", "2024-01-16"), ("2024-01-16", "2024-01-31")),
                   (("2024-01-01", "2024-01-20"), ("2024-01-10", "2024-01-31"))]:
        plain = DS.build_train_test(m, s, tr, te, 7, max_tokens=32)
        cached = DS.build_train_test(m, s, tr, te, 7, max_tokens=32, cache_dir=tmp_dir)
        for a, b in zip(plain, cached):
            assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
            assert a.count() > 0


def test_incremental_write_keeps_rows_without_a_time(spark, tmp_dir):
    import datetime as dt

    from vellum.sources.catalog import TableCatalog, write_incremental

    rows = [(1, dt.datetime(2024, 1, 1, 5)), (2, None), (3, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    assert write_incremental(df, f"{tmp_dir}/lake/log", "ts") == ["2024-01-01", "2024-01-02", "undated"]
    lake = TableCatalog(spark, f"{tmp_dir}/lake")
    assert sorted(r.id for r in lake.read_all("log").collect()) == [1, 2, 3]
    assert sorted(r.id for r in lake.read_dates("log", "2024-01-01", "2024-01-31").collect()) == [1, 3]
