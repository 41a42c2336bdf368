"""Intermediate tables of long jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a session that runs on this machine alone may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file:///tmp/checkpoints/wayfare"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back.

    Long jobs use it where several later steps read a result: the plan starts anew there, nothing is computed
    twice, and a lost executor costs no more than the step at hand."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """The table of a loop: every round writes the next one, and the one before the last is deleted."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths = spark, name, []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > 2:
            forget(self.spark, self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table, whichever store holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
