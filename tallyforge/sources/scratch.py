"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; where none is named and all runs on this machine (tests), one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-tallyforge-"))
    return base.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df there and reads it back: lineage ends, and lost executors cost nothing that came before."""
    path = f"{folder(df.sparkSession)}/tallyforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of keep() that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
