"""Table catalog over a lake folder.

A folder's immediate children are tables: a ``<name>.parquet`` file is a *full* table, a
directory is an *incremental* table holding one ``YYYY-MM-DD.parquet`` per date, or the versions of a
``VersionedTable`` (then the latest version's folders are its files). A Spark output
directory named ``<name>.parquet`` (it holds ``_SUCCESS``) also counts as a full table, and as one
date inside an incremental table. When a file and a directory share a name, the file wins.
"""

from __future__ import annotations

import datetime as _dt
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources import fs as FS
from vellum.sources.versions import UNDATED, VersionedTable, is_versioned

FULL, INCREMENTAL = "full", "incremental"
# Fixed value: the placeholder replaced by the table in query_table SQL.
TABLE_PLACEHOLDER = "<table>"
_SUFFIX = ".parquet"


def _is_hidden(name: str) -> bool:
    return name.startswith("_") or name.startswith(".")


def _is_spark_parquet_dir(spark: SparkSession, e: FS.Entry) -> bool:
    return e.is_dir and e.name.endswith(_SUFFIX) and FS.exists(spark, f"{e.path}/_SUCCESS")


def parquet_children(spark: SparkSession, uri: str) -> list[str]:
    """Direct ``*.parquet`` children of a folder (files, or Spark output dirs), sorted; no recursion
    into other sub-folders such as ``k=v`` partitions."""
    out = []
    for e in FS.list_children(spark, uri):
        if _is_hidden(e.name) or not e.name.endswith(_SUFFIX):
            continue
        if not e.is_dir or _is_spark_parquet_dir(spark, e):
            out.append(e.path)
    return out


class TableCatalog:
    """Name -> (type, path) for the tables directly under ``base``; reads and SQL by name."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._tables: dict[str, tuple[str, str]] | None = None

    # -- S1 -----------------------------------------------------------------------------------
    def refresh(self) -> dict[str, tuple[str, str]]:
        tables: dict[str, tuple[str, str]] = {}
        entries = [e for e in FS.list_children(self.spark, self.base) if not _is_hidden(e.name)]
        # directories first, files second: a file of the same name overrides the directory
        for e in entries:
            if e.is_dir and not _is_spark_parquet_dir(self.spark, e):
                tables[e.name] = (INCREMENTAL, e.path)
        for e in entries:
            if (not e.is_dir or _is_spark_parquet_dir(self.spark, e)) and e.name.endswith(_SUFFIX):
                tables[e.name[: -len(_SUFFIX)]] = (FULL, e.path)
        self._tables = dict(sorted(tables.items()))
        return self._tables

    @property
    def tables(self) -> dict[str, tuple[str, str]]:
        return self._tables if self._tables is not None else self.refresh()

    def to_df(self) -> DataFrame:
        """``(table_name, type, path)``, sorted by name."""
        schema = T.StructType([T.StructField("table_name", T.StringType(), False),
                               T.StructField("type", T.StringType(), False),
                               T.StructField("path", T.StringType(), False)])
        rows = [(n, t, p) for n, (t, p) in self.tables.items()]
        return self.spark.createDataFrame(rows, schema)

    def _info(self, name: str) -> tuple[str, str]:
        if name not in self.tables:
            raise ValueError(f"no table named '{name}' in the catalog; it has {sorted(self.tables)}")
        return self.tables[name]

    # -- S2 / S3 / S4 -------------------------------------------------------------------------
    def files(self, name: str, date: str | None = None) -> list[str]:
        kind, path = self._info(name)
        if kind == FULL:
            if not FS.exists(self.spark, path):
                raise FileNotFoundError(f"Table file not found: {path}")
            return [path]
        if is_versioned(self.spark, path):
            if date is not None:
                _dt.datetime.strptime(date, "%Y-%m-%d")
            found = VersionedTable(self.spark, path).folders(date=date)
            if not found:
                raise FileNotFoundError(f"no rows of '{name}' for date {date}")
            return found
        if date is not None:
            _dt.datetime.strptime(date, "%Y-%m-%d")
            p = f"{path}/{date}{_SUFFIX}"
            if not FS.exists(self.spark, p):
                raise FileNotFoundError(f"No file for date {date}: {p}")
            return [p]
        found = parquet_children(self.spark, path)
        if not found:
            raise FileNotFoundError(f"the folder of incremental table '{name}' holds no parquet file: {path}")
        return found

    def read_table(self, name: str, date: str | None = None) -> DataFrame:
        """A full table, or one date of an incremental table (a date is required for those)."""
        kind, _ = self._info(name)
        if kind == INCREMENTAL and date is None:
            raise ValueError(f"Table '{name}' is incremental: a date 'YYYY-MM-DD' is required")
        return self._read(self.files(name, date))

    def read_all(self, name: str) -> DataFrame:
        """Every date file of an incremental table (or the one file of a full table)."""
        return self._read(self.files(name))

    def read_dates(self, name: str, start: str, end: str) -> DataFrame:
        """Files whose date is in ``[start, end]``: only valid when file date = row date. Rows without
        a time (the ``undated`` file) are in no range; any other file without a date is an error."""
        lo = _dt.datetime.strptime(start, "%Y-%m-%d").date()
        hi = _dt.datetime.strptime(end, "%Y-%m-%d").date()
        keep = []
        for f in self.files(name):
            m = re.search(r"(\d{4}-\d{2}-\d{2})\.parquet$", f)
            if m is None and not f.endswith(f"/{UNDATED}{_SUFFIX}"):
                raise ValueError(f"file of '{name}' has no date in its name: {f}")
            if m and lo <= _dt.date.fromisoformat(m.group(1)) <= hi:
                keep.append(f)
        if not keep:
            raise FileNotFoundError(f"No files of '{name}' between {start} and {end}")
        return self._read(keep)

    def update_statistics(self, name: str, ts: str) -> DataFrame:
        """The statistics of a table's files, ``(file, size, modified, low, high, rows, nulls)``: least and
        greatest time per data file, by one distributed scan of the time column of those files that are new or
        changed since the last call. Published as a version of ``<base>/_statistics/<name>-<ts>``."""
        paths = self.files(name)
        stats = VersionedTable(self.spark, f"{self.base}/_statistics/{name}-{ts}")
        found = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file")
        size, modified = F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")
        data = self._read(paths).select(F.col(ts).alias("t"), found, size, modified)
        if stats.manifest() is not None:
            known = stats.read()
            here = {f: self._file_state(f) for p in paths for f in self._data_files(p)}
            now = self.spark.createDataFrame([(f, *s) for f, s in here.items()], "file string, size long, ms long")
            same = known.join(now, ["file", "size"]).filter(F.unix_millis("modified") == F.col("ms")).select(known.columns)
            old = {r["file"] for r in same.select("file").collect()}  # file names: metadata, as the listing is
            fresh = [f for f in here if f not in old]
            if not fresh and known.count() == len(old):
                return known
            data = self._read(fresh).select(F.col(ts).alias("t"), found, size, modified) if fresh else data.limit(0)
        made = data.groupBy("file", "size", "modified").agg(
            F.min("t").alias("low"), F.max("t").alias("high"), F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("t").isNull()).alias("nulls"))
        if stats.manifest() is not None:
            made = made.unionByName(same)
        stats.overwrite(made.coalesce(1))
        return stats.read()

    def _data_files(self, path: str) -> list[str]:
        """The data files of a listed path, named as Spark's file metadata names them."""
        return FS.data_files(self.spark, path)

    def _file_state(self, file: str) -> tuple[int, int]:
        return FS.state(self.spark, file)

    def read_between(self, name: str, ts: str, low, high) -> DataFrame:
        """Rows with ``low <= ts < high``, reading only the files whose statistics meet that range, whatever
        their names say. A file that changed or came after ``update_statistics`` is always read."""
        stats = VersionedTable(self.spark, f"{self.base}/_statistics/{name}-{ts}")
        files = [f for p in self.files(name) for f in self._data_files(p)]
        inside = (F.col(ts) >= F.lit(low)) & (F.col(ts) < F.lit(high))
        if stats.manifest() is not None:
            known = {r["file"]: r for r in stats.read().select(
                "file", "size", F.unix_millis("modified").alias("ms"),
                ((F.col("high") >= F.lit(low)) & (F.col("low") < F.lit(high))).alias("meets")).collect()}

            def needed(f: str) -> bool:
                r = known.get(f)
                return r is None or (r["size"], r["ms"]) != self._file_state(f) or bool(r["meets"])
            kept = [f for f in files if needed(f)]
        else:
            kept = files
        # with no file left, one file and a false filter keep the schema
        return self._read(kept).filter(inside) if kept else self._read(files[:1]).filter(F.lit(False))

    def _read(self, paths: list[str]) -> DataFrame:
        try:
            return self.spark.read.parquet(*paths)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
                raise FileNotFoundError(str(e)) from e
            raise

    # -- S5 -----------------------------------------------------------------------------------
    def query_table(self, name: str, query: str) -> DataFrame:
        """Run SQL where every ``<table>`` stands for the whole table (all dates of an incremental
        one). Self-joins are fine: each occurrence names the same temp view."""
        df = self.read_all(name)
        view = f"vellum_{re.sub(r'[^0-9A-Za-z_]', '_', name)}_{uuid.uuid4().hex[:10]}"
        df.createOrReplaceTempView(view)
        try:  # the plan is resolved here and needs the name no longer
            return self.spark.sql(query.replace(TABLE_PLACEHOLDER, view))
        finally:
            self.spark.catalog.dropTempView(view)


def write_incremental(df: DataFrame, folder: str, ts_col: str) -> list[str]:
    """Write ``df`` as an incremental table: one ``<folder>/<YYYY-MM-DD>.parquet`` per date of
    ``ts_col``, and ``undated.parquet`` for rows without one. One Spark job writes all dates (partitioned), then each partition folder is renamed
    into place (metadata only). A writer that dies leaves every replaced date either in place or beside it as
    ``_replaced_*``; ``VersionedTable.replace_dates`` replaces dates atomically. Returns the dates written."""
    spark = df.sparkSession
    folder = folder.rstrip("/")
    staging = f"{folder}/_staging_{uuid.uuid4().hex[:8]}"
    (df.withColumn("_vellum_date", F.coalesce(F.date_format(F.col(ts_col), "yyyy-MM-dd"), F.lit(UNDATED)))
     .write.mode("overwrite").partitionBy("_vellum_date").parquet(staging))
    fs, _ = FS._fs_path(spark, folder)
    jvm = spark._jvm
    dates = []
    for e in FS.list_children(spark, staging):
        if e.is_dir and e.name.startswith("_vellum_date="):
            d = e.name.split("=", 1)[1]
            target = f"{folder}/{d}{_SUFFIX}"
            FS.write_text(spark, f"{e.path}/_SUCCESS", "")
            if FS.exists(spark, target):  # the old date is moved aside, never deleted before the new one is in place
                aside = f"{folder}/_replaced_{uuid.uuid4().hex[:8]}_{d}"
                fs.rename(jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(aside))
                fs.rename(jvm.org.apache.hadoop.fs.Path(e.path), jvm.org.apache.hadoop.fs.Path(target))
                FS.delete(spark, aside)
            else:
                fs.rename(jvm.org.apache.hadoop.fs.Path(e.path), jvm.org.apache.hadoop.fs.Path(target))
            dates.append(d)
    FS.delete(spark, staging)
    return sorted(dates)
