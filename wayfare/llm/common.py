"""Shared helpers: work folders, lineage cuts, partition counts, connected components."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import shared_folder

#: Word separators of every contract here: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one that the cluster names in spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables that an operator needs only until its own result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = work_dir(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete them; nothing that reads them may be evaluated again."""
        for p in self.paths:
            remove(self.spark, p)
        self.paths.clear()
        release(self.spark)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (u, v) longs -> (id, component), component = smallest id.

    Random-order contraction: each round every node is folded into the neighbour that comes first in
    a hash order drawn anew, so edges shrink by a constant factor whatever the graph's shape (a sorted
    chain included). Every round ends in written tables, so a lost executor costs one round; labels are followed
    through the rounds' tables, and written every fourth round. Nodes without edges do not appear. Self loops yield their
    own component.
    """
    spark = edges.sparkSession
    e = cut(edges.select("u", "v").where("u is not null and v is not null").distinct(), f"{name}-e")
    nodes = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    labels = nodes.select("id", F.col("id").alias("at"))
    live = e.where("u <> v")
    for k in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("v", "u"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c))
        to = (
            both.groupBy("u").agg(F.min(rank("v")).alias("b"))
            .select("u", F.when(rank("u") <= F.col("b"), F.col("u")).otherwise(F.col("b")["v"]).alias("m"))
        )
        to = cut(to, f"{name}-m{k}")
        a, b = to.select("u", F.col("m").alias("mu")), to.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        live = cut(
            live.join(a, "u").join(b, "v").where("mu <> mv")
            .select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct(),
            f"{name}-e{k}",
        )
        labels = labels.join(to.select(F.col("u").alias("at"), "m"), "at", "left").select("id", F.coalesce("m", "at").alias("at"))
        if k % 4 == 3:
            labels = cut(labels, f"{name}-l{k}")
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    labels = cut(labels, f"{name}-l")
    low = labels.groupBy("at").agg(F.min("id").alias("component"))
    return labels.join(low, "at").select("id", "component")


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files of finished steps go once their plans are gone."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


# Vectorised hashing of bytes, for use inside tasks.

_TABLE = np.random.default_rng(20240101).integers(0, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit rolling hash of every ``width`` bytes of data, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    block, size = _TABLE[data], 1
    done, have, left = None, 0, width
    while left:
        if left & 1:
            if done is None:
                done = block
            else:
                n = min(len(done), len(block) - have)
                done = done[:n] * _power(size) + block[have : have + n]
            have += size
        left >>= 1
        if left:
            block = block[:-size] * _power(size) + block[size:]
            size *= 2
    return done[: len(data) - width + 1]


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column (null counts as empty), without copying."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, b"").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets
