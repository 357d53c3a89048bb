"""Contribution files in and tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_contribution_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as text, with row_number in the order of each file.

    An empty cell is '', a cell that a short row lacks is null. Lines are numbered by partition and place in it, and a
    file's partitions by their offset, so that no task needs the whole file.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_corrupt_record"]])
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"', columnNameOfCorruptRecord="_corrupt_record")
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_id"))
    rows = raw.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = rows.groupBy("file", "_part").agg(F.min("_at").alias("_min"), F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(before.select("file", "_part", "_min", "_before"), ["file", "_part"])
    short = F.col("_corrupt_record").isNotNull()
    tail = lambda k: sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns[k:]), F.lit(0)) == 0
    cells = {c: F.when(short & tail(k), F.lit(None).cast("string")).otherwise(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for k, c in enumerate(columns)}
    return rows.select("file", (F.col("_before") + F.col("_at") - F.col("_min") + 1).alias("row_number"), *[x.alias(c) for c, x in cells.items()])


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("file_hash"))


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: str = "import_batch_id") -> None:
    """Tables as Parquet; of tables with the partition column only the partitions that are given are replaced."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(partition_by) if partition_by in df.columns else writer).parquet(f"{path}/{name}")
