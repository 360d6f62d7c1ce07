"""Results of micro-batches as tables in the shared folder.

Each epoch writes its own folder, so a repeated epoch overwrites what it wrote and nothing is added twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class EpochTable:
    """A table with one folder per epoch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.path, self.schema = path, schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/epoch=-1")

    def write(self, df: DataFrame, epoch: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def at(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/epoch={epoch}")

    def all(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType())])).parquet(self.path)
