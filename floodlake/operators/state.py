"""A table in parts that rounds rewrite one by one, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .regions import checkpointed


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        checkpointed(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


class PartTable:
    """Rows by their column ``part``, of at most ``parts`` values.

    ``rewrite`` writes the rows of some parts to a folder of their own and only
    then lets reads find them there, so a task that is run again after a lost
    executor changes nothing, and the other parts aren't touched.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType, parts: int) -> None:
        self.spark, self.parts, self.rounds = spark, parts, 0
        self.schema = T.StructType([f for f in schema.fields if f.name != "part"])
        self.path = shared_path(spark, "parts")
        self.written: dict[int, int] = {}

    def read(self, parts: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/v{v}/part={p}" for p, v in self.written.items() if parts is None or p in parts]
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())]))
        # The part is told by the name of the file's folder.
        part = F.regexp_extract("_metadata.file_path", r"part=(\d+)/[^/]*$", 1).cast("int")
        return self.spark.read.schema(self.schema).parquet(*paths).select("*", part.alias("part"))

    def rewrite(self, rows: DataFrame, parts: list[int]) -> DataFrame:
        """Let ``rows`` take the place of all rows of ``parts``; returns what was written, with ``part``."""
        rows.repartition("part").write.partitionBy("part").parquet(f"{self.path}/v{self.rounds}")
        new = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("part", T.IntegerType())])).parquet(f"{self.path}/v{self.rounds}")
        self.last = self.rounds
        self.rounds += 1
        return new

    def keep(self, found: list[int], parts: list[int]) -> None:
        """The parts that the last rewrite has rows for; the others of ``parts`` are empty now."""
        for p in parts:
            self.written.pop(p, None)
        self.written |= dict.fromkeys(found, self.last)
