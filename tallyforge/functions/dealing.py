"""How rows are dealt to tasks before work whose memory grows with a task's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys over all shuffle partitions.

    Spark merges the parts of a shuffle of its own until there is about one for each core, so that a task's sorts and
    maps, several of which it holds at once, grow with the input. A number that is named stays."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
