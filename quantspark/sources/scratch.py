"""Intermediate tables of iterative jobs, in the shared folder that ``spark.checkpoint.dir`` names.

Writing a table cuts the lineage of a loop; the files are on storage that all executors see, so a
lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; a session on one machine without the setting uses a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="quantspark-")
            atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
        base = "file://" + _OWN[context.applicationId]
    return f"{base.rstrip('/')}/quantspark/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partitioned_by: str) -> tuple[DataFrame, str]:
    """``df`` written to a fresh path and read again, and the path."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partitioned_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
