"""Written tables: versions of a table, rankings as CSV, cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints. Only in local mode, where
    one machine does everything, may a folder of this machine be chosen instead."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = named.get() if named.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="tidebars-")
        root = _LOCAL_ROOTS[app]
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tidebars-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table that several consumers read, and read it back. It survives
    lost executors, keeps column pruning and cuts the lineage."""
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` wrote for this application; call
    it when no result that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_ranking(df: DataFrame, path: str, decimals: int = 6) -> None:
    """One CSV file with a header, doubles rounded. A ranking has one row per
    filter, so a single file is fine."""
    cols = [F.round(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Version names, newest first. Lists the folder only."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted((n[2:] for n in names if n.startswith("v=")), reverse=True)


def snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write ``df`` as version ``version`` (a sortable stamp)."""
    df.write.mode("errorifexists").parquet(f"{root}/v={version}")
    return version


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    rows = [(v, i + 1) for i, v in enumerate(_versions(spark, root))]
    return spark.createDataFrame(rows, "version string, rank int")


def restore(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/v={version}")


def prune(spark: SparkSession, root: str, keep: int = 5) -> list[str]:
    """Delete all but the newest ``keep`` versions; returns what went."""
    gone = _versions(spark, root)[keep:]
    for v in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={v}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
