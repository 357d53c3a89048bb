"""Tables that are changed a part at a time: rows lie by part and run, a small pointer says which run's rows count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Versioned:
    """Rows of `key` under path/rows, in `parts` parts by a hash of the key, each part once for each run that changed it.

    A run writes the parts it changes and, last, a pointer (part, run) under path/pointers. Readers take the newest
    pointer, so that a run that dies leaves nothing that counts, and a run that is repeated writes the same again: both
    start from the pointer of the run before.
    """

    spark: SparkSession
    path: str
    key: str
    parts: int = 64

    def part(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.parts)).cast("int")

    def _pointers(self, before: int | None = None) -> dict[int, int]:
        """Part -> run; `parts` rows at most."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointers")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return {}
        rows = self.spark.read.schema("part int, run long, at long").parquet(f"{self.path}/pointers")
        rows = rows if before is None else rows.where(F.col("at") < before)
        newest = rows.agg(F.max("at")).first()[0]
        return {} if newest is None else {r["part"]: r["run"] for r in rows.where(F.col("at") == newest).collect()}

    def _read(self, pointers: dict[int, int], schema) -> DataFrame:
        rows = self.spark.read.schema(_copy(schema).add("part", T.IntegerType()).add("run", T.LongType())).parquet(f"{self.path}/rows")
        # literals on partition columns: only the folders named are listed and read
        wanted = F.lit(False)
        by_run: dict[int, list[int]] = {}
        for part, run in pointers.items():
            by_run.setdefault(run, []).append(part)
        for run, parts in by_run.items():
            wanted = wanted | ((F.col("run") == run) & F.col("part").isin(parts))
        return rows.where(wanted)

    def current(self, schema, parts: list[int] | None = None) -> DataFrame:
        """The rows that count (of some parts)."""
        pointers = {p: r for p, r in self._pointers().items() if parts is None or p in parts}
        return self._read(pointers, schema).drop("part", "run")

    def before(self, run: int, keys: DataFrame, schema) -> DataFrame:
        """The rows that counted before a run, of the parts that hold the keys."""
        parts = {r["part"] for r in keys.select(self.part().alias("part")).distinct().collect()}  # `parts` at most
        return self._read({p: r for p, r in self._pointers(before=run).items() if p in parts}, schema).drop("part", "run")

    def _publish(self, rows: DataFrame, run: int, touched: list[int], pointers: dict[int, int]) -> None:
        dealt = rows.withColumns({"part": self.part(), "run": F.lit(run).cast("long")}).hint("rebalance", "part")  # a large part is several tasks
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part").parquet(f"{self.path}/rows")
        new = pointers | dict.fromkeys(touched, run)
        self.spark.createDataFrame([(p, r, run) for p, r in new.items()], "part int, run long, at long").coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("at").parquet(f"{self.path}/pointers")

    def load(self, rows: DataFrame, run: int = 0) -> None:
        """The first rows."""
        self._publish(rows, run, list(range(self.parts)), {})

    def merge(self, changed: DataFrame, rows: DataFrame, run: int) -> list[int]:
        """All rows of the changed keys are replaced by `rows` (those of keys without any go); returns the parts read.

        changed: (key). Only parts with a changed key are read and written.
        """
        keys = changed.select(self.key).distinct()
        touched = sorted(r["part"] for r in keys.select(self.part().alias("part")).distinct().collect())  # `parts` at most
        if not touched:
            return []
        pointers = self._pointers(before=run)
        old = self._read({p: r for p, r in pointers.items() if p in set(touched)}, rows.schema).drop("part", "run")
        self._publish(old.join(keys, self.key, "left_anti").unionByName(rows), run, touched, pointers)
        return touched


def _copy(schema: T.StructType) -> T.StructType:
    """StructType.add() changes its own list."""
    return T.StructType(list(schema.fields))
