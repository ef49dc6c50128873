"""Atomic table versions, file statistics and time-pruned reads."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from vellum.sources import catalog as CT
from vellum.sources import fs as FS
from vellum.sources import versions as VT

T0 = dt.datetime(2024, 1, 1)


def _rows(spark, days, start=0):
    return spark.createDataFrame([(start + i, T0 + dt.timedelta(days=d, hours=i % 24)) for d in days for i in range(10)],
                                 "k long, ts timestamp_ntz")


def test_versions_are_kept_and_read(spark, tmp_dir):
    t = VT.VersionedTable(spark, tmp_dir + "/t")
    assert t.manifest() is None and t.versions() == []
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.overwrite(_rows(spark, [0])) == 1
    assert t.append(_rows(spark, [1], 100)) == 2
    assert t.replace_dates(_rows(spark, [1, 2], 500).unionByName(
        spark.createDataFrame([(9, None)], "k long, ts timestamp_ntz")), "ts") == 3
    assert [t.read(v).count() for v in (1, 2, 3)] == [10, 20, 41]
    assert t.replace_dates(_rows(spark, [2], 900), "ts") == 4
    assert t.read(date="2024-01-03").agg(F.min("k")).first()[0] == 900 and t.read().count() == 41
    assert t.read(3).filter("k >= 900").count() == 0  # the old version is as it was
    assert t.read(date="undated").count() == 1
    assert t.vacuum(keep=2) == 0 and t.versions() == [3, 4]  # both still name every folder
    t.overwrite(_rows(spark, [5]))
    assert t.vacuum() == 4 and t.read().count() == 10


def test_killed_writer_leaves_the_old_version_whole(spark, tmp_dir, monkeypatch):
    t = VT.VersionedTable(spark, tmp_dir + "/t")
    t.replace_dates(_rows(spark, [0, 1]), "ts")

    def killed(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(FS, "create_new", killed)  # the data folders are there, the commit never comes
        with pytest.raises(KeyboardInterrupt):
            t.replace_dates(_rows(spark, [0], 700), "ts")
    assert t.versions() == [1] and t.read().count() == 20 and t.read().filter("k >= 700").count() == 0
    assert t.vacuum() == 1 and t.read().count() == 20


def test_concurrent_writers_lose_nothing(spark, tmp_dir):
    t = VT.VersionedTable(spark, tmp_dir + "/t")
    t.overwrite(_rows(spark, [0]))
    writers = [threading.Thread(target=lambda i=i: t.append(_rows(spark, [i], 100 * i))) for i in range(1, 6)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert t.versions() == [1, 2, 3, 4, 5, 6] and t.read().count() == 60
    with pytest.raises(VT.Conflict):
        t.overwrite(_rows(spark, [9]), expected=3)
    assert t.read().count() == 60
    assert not FS.create_new(spark, f"{t.path}/_log/{1:020d}.json", "x")


def test_catalog_reads_the_latest_version(spark, tmp_dir):
    t = VT.VersionedTable(spark, tmp_dir + "/lake/log")
    t.replace_dates(_rows(spark, [0, 1]), "ts")
    t.replace_dates(_rows(spark, [1], 50), "ts")
    cat = CT.TableCatalog(spark, tmp_dir + "/lake")
    assert cat.tables["log"][0] == CT.INCREMENTAL
    assert cat.read_all("log").count() == 20 and cat.read_table("log", "2024-01-02").agg(F.min("k")).first()[0] == 50
    assert cat.query_table("log", "SELECT count(*) AS n FROM <table>").first().n == 20
    with pytest.raises(FileNotFoundError):
        cat.read_table("log", "2030-01-01")


def test_a_file_with_a_lying_name_is_still_read(spark, tmp_dir):
    base = tmp_dir + "/lake"
    CT.write_incremental(_rows(spark, range(6)), base + "/sms", "ts")
    _rows(spark, [2], 300).coalesce(1).write.parquet(base + "/sms/2031-12-31.parquet")  # rows of 2024-01-03
    cat = CT.TableCatalog(spark, base)
    lo, hi = T0 + dt.timedelta(days=2), T0 + dt.timedelta(days=3)
    unpruned = cat.read_between("sms", "ts", lo, hi)
    stats = cat.update_statistics("sms", "ts")
    assert stats.agg(F.sum("rows")).first()[0] == 70
    got = cat.read_between("sms", "ts", lo, hi)
    assert got.count() == unpruned.count() == 20 and got.filter("k >= 300").count() == 10
    assert len(got.inputFiles()) < len(unpruned.inputFiles())
    assert all("2024-01-03" in f or "2031-12-31" in f for f in got.inputFiles())
    # a file that came later is read, and the next update reads only that one
    _rows(spark, [2], 600).coalesce(1).write.parquet(base + "/sms/2024-01-09.parquet")
    assert cat.read_between("sms", "ts", lo, hi).count() == 30
    before = {r.file: r.modified for r in stats.collect()}
    after = {r.file: r.modified for r in cat.update_statistics("sms", "ts").collect()}
    assert set(before) < set(after) and len(after) == len(before) + 1
    assert cat.read_between("sms", "ts", lo, hi).count() == 30
    assert cat.update_statistics("sms", "ts").count() == len(after)
    assert cat.read_between("sms", "ts", T0 - dt.timedelta(days=9), T0 - dt.timedelta(days=8)).count() == 0


def test_replacing_a_date_keeps_the_old_one_until_the_new_one_is_there(spark, tmp_dir, monkeypatch):
    folder = tmp_dir + "/sms"
    CT.write_incremental(_rows(spark, [0, 1]), folder, "ts")
    with monkeypatch.context() as m:
        m.setattr(FS, "delete", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            CT.write_incremental(_rows(spark, [0], 70), folder, "ts")
    names = [e.name for e in FS.list_children(spark, folder)]
    assert "2024-01-01.parquet" in names and any(n.startswith("_replaced_") for n in names)
    assert CT.TableCatalog(spark, tmp_dir).read_table("sms", "2024-01-01").agg(F.min("k")).first()[0] == 70
