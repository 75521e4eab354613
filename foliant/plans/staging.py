"""Cutting lineage and spreading work.

Everything staged lands in the shared folder the cluster names in ``spark.checkpoint.dir``; only a
local master without that setting falls back to a folder of its own. Staged tables are Parquet:
compressed, splittable, and still there after an executor is lost.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` where it is set, else (local master only)
    a temporary folder that is removed when the process ends."""
    conf = spark.sparkContext.getConf()
    told = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_DIR:
        path = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, path, True)
        _LOCAL_DIR[key] = "file://" + path
    return _LOCAL_DIR[key]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, reuse costs a scan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-staged/{name}-{uuid.uuid4().hex}"
    if path.startswith(("file:", "/")):  # elsewhere the folder's own policy removes them
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work at least one partition a core.

    A scan of a small file comes as one partition; only then is a round-robin exchange paid for. A plan that already has
    an exchange is left alone."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(want) if have * 2 <= want else df


def bounded(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, which is counted; else as it is, for a join by exchange."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
