"""Session helpers: a configured SparkSession, the shared checkpoint folder, column checks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "vellum", master: str | None = None, shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with AQE on and the UI off.

    On a cluster the master and most settings come from ``spark-submit``; the defaults here only
    matter for local runs and tests.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("VELLUM_DRIVER_MEMORY", "16g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vellum`` importable in every Python worker, as ``--py-files`` would.

    UDF bodies refer to functions of this package by module name, so a worker must be able to
    import it wherever the driver was started. The package's ``.py`` files are zipped once per
    application and added with ``addPyFile`` (Spark ships the file to every executor)."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="vellum-pyfiles-"), "vellum.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession, sub: str | None = None) -> str:
    """The shared folder for lineage cuts and materialized tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only a local-mode session
    may fall back to a fresh temporary folder; on a cluster an unset folder is an error, because a
    machine-local path would not survive executor loss.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="vellum-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{sub}" if sub else base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for one materialized table."""
    return checkpoint_dir(spark, f"vellum/{name}-{uuid.uuid4().hex[:12]}")


def require_columns(df: DataFrame, *cols: str, what: str = "input") -> None:
    """Fail early, naming every missing column (the reference only fails inside a query)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing column(s) {missing}; has {df.columns}")
