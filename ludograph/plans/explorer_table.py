"""The stored next-step table of all states: a state is a short range of files, found by the files' least and greatest keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludograph.functions.columns import MOVE_END
from ludograph.operators.explorer import opening_tree

FEW_STATES = 100_000  # so many may be broadcast; more are looked up by an ordinary join


class ExplorerTable:
    """``rows`` and, written behind them, ``keys`` (file, least and greatest hash) under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def write(self, table: DataFrame) -> ExplorerTable:
        keys = ["hash", "move"]
        table.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{self.path}/rows")
        held = self.read().groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/keys")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/keys")

    def of(self, states: DataFrame) -> DataFrame:
        """The rows of some states (``hash``), from the files that can hold them."""
        wanted = states.select("hash").distinct()
        if wanted.limit(FEW_STATES + 1).count() > FEW_STATES:
            return self.read().join(wanted, "hash", "left_semi")
        near = F.col("hash").between(F.col("least"), F.col("most"))
        paths = [r["file"] for r in self.keys().join(F.broadcast(wanted), near, "left_semi").select("file").collect()]
        rows = self.spark.read.schema(self.read().schema).parquet(*paths) if paths else self.read().limit(0)
        return rows.join(F.broadcast(wanted), "hash", "left_semi")

    def tree(self, root: object, depth: int = 2, breadth: int = 6, end=MOVE_END) -> DataFrame:
        """The most played moves from a state, level by level; the table must hold ``child``."""
        start = self.spark.range(1).select(F.lit(root).alias("hash"))
        return opening_tree(self.of, start, depth, breadth, end)
