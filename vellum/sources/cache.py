"""Materialized datasets, embeddings and models.

Everything is parquet (or Spark ML's own writer) under a shared folder; a ``_SUCCESS`` marker
means a write completed. A set of datasets is valid only as a whole, its folder is keyed by a hash of
the parameters that built it, and each build is a generation of its own that one marker publishes.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import fs as FS


# -- S8 / S9 ----------------------------------------------------------------------------------

def save_data(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write (replacing) a dataset; parents are created by the writer."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def load_data(spark: SparkSession, path: str) -> DataFrame | None:
    """The dataset at ``path``, or None when it is missing or its files cannot be read."""
    if not FS.exists(spark, path):
        return None
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018 - footers are read here
        return df
    except (AnalysisException, Exception):  # noqa: BLE001 - unreadable means "not cached"
        return None


# -- S10 --------------------------------------------------------------------------------------

def params_key(params: dict) -> str:
    return hashlib.sha1(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]


def materialize(spark: SparkSession, builders: dict[str, Callable[[], DataFrame]], folder: str,
                params: dict | None = None, use_cache: bool = True,
                partition_by: list[str] | None = None) -> dict[str, DataFrame]:
    """Read-through cache over a *set* of datasets: if every member was published under this
    parameter key, read them all; otherwise build and write them all into a new generation folder,
    publish it by one marker, then read it back (so the returned frames have a short lineage that
    survives executor loss). A build that fails leaves the published generation as it was. Older
    generations are kept: frames handed out before may still read them."""
    base = f"{folder.rstrip('/')}/{params_key(params or {})}"
    marker = f"{base}/_CURRENT.json"
    text = FS.read_text(spark, marker) if use_cache else None
    current = json.loads(text) if text else None
    if current is None or not set(builders) <= set(current["members"]):
        current = {"generation": uuid.uuid4().hex[:12], "members": sorted(builders)}
        for n, build in builders.items():
            save_data(build(), f"{base}/{current['generation']}/{n}", partition_by)
        FS.write_text(spark, f"{base}/_PARAMS.json", json.dumps(params or {}, sort_keys=True, default=str))
        FS.write_text(spark, marker, json.dumps(current))
    return {n: spark.read.parquet(f"{base}/{current['generation']}/{n}") for n in builders}


def content_hash(df: DataFrame, *cols: str) -> str:
    """Identity of a table's rows (of ``cols``, or of all), whatever their order: the row count and the
    sum of row hashes, by one aggregate with map-side combination."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in cols or df.columns]).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


# -- S11 --------------------------------------------------------------------------------------

class EmbeddingStore:
    """Vectors with their keys, one folder per encoder id and split. Ids are any text: folders are
    named by their hashes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _folder(self, encoder_id: str, split: str) -> str:
        a, b = (hashlib.sha1(x.encode()).hexdigest() for x in (encoder_id, split))
        return f"{self.folder}/{a}/{b}"

    def save(self, df: DataFrame, encoder_id: str, split: str) -> None:
        save_data(df, self._folder(encoder_id, split))

    def load(self, encoder_id: str, split: str) -> DataFrame | None:
        part = self._folder(encoder_id, split)
        return self.spark.read.parquet(part) if FS.exists(self.spark, f"{part}/_SUCCESS") else None


# -- S12 --------------------------------------------------------------------------------------

def save_model(model, path: str) -> None:
    """Spark ML writer (metadata JSON + parquet), never pickle."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, cls=None):
    """The model at ``path`` or None when absent / unreadable."""
    if not FS.exists(spark, path):
        return None
    if cls is None:
        from pyspark.ml import PipelineModel as cls  # noqa: N813
    try:
        return cls.load(path)
    except Exception:  # noqa: BLE001
        return None


def list_checkpoints(spark: SparkSession, folder: str, prefix: str = "checkpoint-") -> list[str]:
    """Checkpoint folders directly under ``folder``, sorted by name."""
    return [e.path for e in FS.list_children(spark, folder) if e.is_dir and e.name.startswith(prefix)]
