"""Lake locations (S6) and relational sources by profile name.

S6 turns account + container + path into an ``abfss://`` URI and the Spark settings that carry
the key; any other base URI (hdfs://, s3a://, file:/, a local path) passes through unchanged.
S7 reads a table or query over JDBC from a profile the user supplies; nothing is hard-coded.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# The environment variable names used when no account/key is given.
ACCOUNT_ENV = "DATALAKE_ACCOUNT"
KEY_ENV = "DATALAKE_KEY"


@dataclass
class LakeLocation:
    """Where tables live. ``container`` + ``account`` build an Azure Data Lake URI; ``base_uri``
    overrides both for any other file system."""

    container: str | None = None
    directory: str = ""
    account: str | None = None
    account_key: str | None = None
    base_uri: str | None = None

    def __post_init__(self):
        if self.base_uri:
            return
        self.account = self.account or os.environ.get(ACCOUNT_ENV)
        self.account_key = self.account_key or os.environ.get(KEY_ENV)
        if not self.account or not self.account_key:
            raise ValueError(f"{ACCOUNT_ENV} and {KEY_ENV} must be given as arguments or environment variables")
        if not self.container:
            raise ValueError("container must be given")

    @property
    def uri(self) -> str:
        d = self.directory.strip("/")
        if self.base_uri:
            b = self.base_uri.rstrip("/")
            return f"{b}/{d}" if d else b
        root = f"abfss://{self.container}@{self.account}.dfs.core.windows.net"
        return f"{root}/{d}" if d else root

    def spark_conf(self) -> dict[str, str]:
        """Settings that let Spark's ABFS connector authenticate with the account key."""
        if self.base_uri:
            return {}
        return {f"spark.hadoop.fs.azure.account.key.{self.account}.dfs.core.windows.net": self.account_key}

    def apply(self, spark: SparkSession) -> None:
        hconf = spark._jsc.hadoopConfiguration()
        for k, v in self.spark_conf().items():
            hconf.set(k[len("spark.hadoop."):], v)


@dataclass
class JdbcProfile:
    url: str
    driver: str | None = None
    read_only: bool = False
    options: dict[str, str] = field(default_factory=dict)


class RelationalSources:
    """Named JDBC profiles; ``read`` by profile name, ``write`` refused for read-only profiles."""

    def __init__(self, spark: SparkSession, profiles: dict[str, JdbcProfile]):
        self.spark = spark
        self.profiles = dict(profiles)

    def profile(self, name: str) -> JdbcProfile:
        if name not in self.profiles:
            raise ValueError(f"Unknown database: {name}. Known: {sorted(self.profiles)}")
        return self.profiles[name]

    def reader_options(self, name: str, table: str | None = None, query: str | None = None,
                       partition_column: str | None = None, lower_bound=None, upper_bound=None,
                       num_partitions: int | None = None, fetch_size: int = 10000) -> dict[str, str]:
        p = self.profile(name)
        if (table is None) == (query is None):
            raise ValueError("give exactly one of table or query")
        opts = {"url": p.url, "fetchsize": str(fetch_size), **p.options}
        if p.driver:
            opts["driver"] = p.driver
        if table is not None:
            opts["dbtable"] = table
        else:
            opts["query"] = query
        if partition_column:
            if table is None:
                raise ValueError("partitioned reads need a table (Spark does not split a query)")
            if lower_bound is None or upper_bound is None or not num_partitions:
                raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
            opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                        upperBound=str(upper_bound), numPartitions=str(num_partitions))
        return opts

    def read(self, name: str, **kw) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.reader_options(name, **kw)).load()

    def write(self, df: DataFrame, name: str, table: str, mode: str = "append") -> None:
        p = self.profile(name)
        if p.read_only:
            raise PermissionError(f"profile '{name}' is read-only")
        opts = {"url": p.url, "dbtable": table, **p.options}
        if p.driver:
            opts["driver"] = p.driver
        df.write.format("jdbc").options(**opts).mode(mode).save()
