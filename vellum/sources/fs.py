"""Thin access to the Hadoop FileSystem of a path (local, HDFS, abfss, s3a... alike).

Only metadata (names, kinds) goes through the driver; data is read by Spark."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool


def _fs_path(spark: SparkSession, uri: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(uri)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, uri: str) -> bool:
    fs, p = _fs_path(spark, uri)
    return bool(fs.exists(p))


def is_dir(spark: SparkSession, uri: str) -> bool:
    fs, p = _fs_path(spark, uri)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def list_children(spark: SparkSession, uri: str) -> list[Entry]:
    """Immediate children of ``uri`` (not recursive); a missing path gives an empty list."""
    uri = uri.rstrip("/") or "/"
    fs, p = _fs_path(spark, uri)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        out.append(Entry(name=name, path=f"{uri}/{name}", is_dir=bool(st.isDirectory())))
    return sorted(out, key=lambda e: e.name)


def delete(spark: SparkSession, uri: str, recursive: bool = True) -> bool:
    fs, p = _fs_path(spark, uri)
    return bool(fs.delete(p, recursive))


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    fs, p = _fs_path(spark, uri)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def create_new(spark: SparkSession, uri: str, text: str) -> bool:
    """Write ``text`` as a new file; False if the file is there already. The text is written beside it
    and renamed, so a file that can be seen is whole; a rename never replaces a file here."""
    fs, p = _fs_path(spark, uri)
    aside = f"{p.getParent().toString()}/.{p.getName()}.{uuid.uuid4().hex}"
    if fs.exists(p):
        return False
    write_text(spark, aside, text)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    try:
        # without an OVERWRITE option this rename fails where the target exists
        none = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        context.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), p, options)
        return True
    except Py4JJavaError as e:
        delete(spark, aside)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise


def read_text(spark: SparkSession, uri: str) -> str | None:
    fs, p = _fs_path(spark, uri)
    if not fs.exists(p):
        return None
    jvm = spark._jvm
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def data_files(spark: SparkSession, uri: str) -> list[str]:
    """The data files at ``uri`` (the file itself, or the visible ``*.parquet`` files of a folder and its
    partition folders), as URIs in the form of Spark's file metadata (a local one with a single slash)."""
    fs, p = _fs_path(spark, uri)
    if not fs.exists(p):
        return []
    if not fs.getFileStatus(p).isDirectory():
        return [_one_slash(fs.getFileStatus(p).getPath().toUri().toString())]
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith(("_", ".")) and "=" not in name:
            continue
        if st.isDirectory():
            out += data_files(spark, st.getPath().toString())
        elif name.endswith(".parquet"):
            out.append(_one_slash(st.getPath().toUri().toString()))
    return sorted(out)


def _one_slash(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def state(spark: SparkSession, uri: str) -> tuple[int, int]:
    """Size and modification time (ms) of a file."""
    fs, p = _fs_path(spark, uri)
    st = fs.getFileStatus(p)
    return int(st.getLen()), int(st.getModificationTime())
