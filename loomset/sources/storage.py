"""Shared scratch folders for tables that are written and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Where that is unset, a session on
    this machine alone gets a temporary folder; on a cluster, whose machines do not
    share one, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loomset-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _named.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Folders that this process has named, per application.
_named: dict[str, list[str]] = {}


def drop_stored(spark: SparkSession) -> int:
    """Delete what this application has written under ``shared_dir`` so far; returns the number of folders.

    For the end of a job, when its results are written elsewhere or collected: tables that are
    read from those folders cannot be computed any more.
    """
    paths = _named.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    dropped = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results that several passes use: they are computed once, the lineage ends at
    the files, and lost executors cost no recomputation.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
