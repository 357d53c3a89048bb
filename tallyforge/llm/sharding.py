"""Operator 8, sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, table


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Cuts docs, in id order, into n_shards contiguous runs of nearly equal bytes.

    Returns id_col, size, text_crc32, shard, slot. A document's size is its UTF-8 length plus
    `overhead`; the shard is that in which the document's middle byte falls, so that a shard is off
    the target by at most one document. Rows are ordered by id (null first), then size and checksum;
    full ties are equal rows, which may take each other's places. Null text is empty; an empty table
    gives no rows; other columns are ignored.

    The only thing the driver sees is two totals for each partition.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = save(
        narrow.repartitionByRange(parts, "_id", "size", "text_crc32").withColumn("_part", F.spark_partition_id()), "shard-rows"
    )
    totals = sorted(ordered.groupBy("_part").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect())
    rows = size = 0
    before = []
    for part, n, b in totals:
        before.append((part, rows, size))
        rows, size = rows + n, size + b
    starts = spark.createDataFrame(before, "_part int, _rows_before long, _bytes_before long")
    inside = Window.partitionBy("_part").orderBy(F.col("_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ordered.withColumns({"_row": F.count("*").over(inside), "_end": F.sum("size").over(inside)})
        .join(F.broadcast(starts), "_part")  # one row for each partition
        .withColumn("_row", F.col("_row") + F.col("_rows_before") - 1)
        # twice the middle byte, so that all stays in whole numbers
        .withColumn("_mid2", 2 * (F.col("_bytes_before") + F.col("_end")) - F.col("size"))
        .withColumn(
            "shard",
            F.least(F.expr(f"cast(cast(_mid2 as decimal(38,0)) * {n_shards} div {max(2 * size, 1)} as int)"), F.lit(n_shards - 1)),
        )
        .select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "_row")
    )
    placed = save(placed, "shard-placed")
    firsts = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("_shard")).select(
        id_col, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs to path/shard=N folders, in slot order.

    Rows need no unique id: of rows with one id and text, which are alike in what decides the place, each takes one of
    their places; a null id is an id. The columns shard and slot of docs, if any, are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = [F.col("_id"), F.col("_size"), F.col("_crc")]
    turn = lambda df, *order: df.withColumn("_turn", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))
    placed = shard_by_bytes(docs, n_shards, id_col, text_col).select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    rows = docs.drop("shard", "slot").withColumns({"_id": F.col(id_col), "_size": (F.octet_length(text) + 8).cast("long"), "_crc": F.crc32(text.cast("binary"))})
    rows, placed = turn(rows, F.lit(0)).alias("r"), turn(placed, "shard", "slot").alias("p")
    keys = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("_id", "_size", "_crc", "_turn")]
    joined = rows.join(placed, reduce(lambda a, b: a & b, keys)).select("r.*", "p.shard", "p.slot").drop("_id", "_size", "_crc", "_turn")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `bytes`."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
