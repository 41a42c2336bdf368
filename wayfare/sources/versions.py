"""Tables in committed versions: written to a fresh folder, then published by one atomic step.

A commit is a small file ``<base>/commits/<number>`` that names the folder of the data. It is made complete under another name
and then linked or renamed to its number, which fails if another writer was first; that writer's commit stands, and the loser
takes the next number. So readers see a whole version or none, a killed write leaves nothing but an unnamed folder, and
nothing that a reader may hold open is ever replaced. Stores need an atomic rename that does not overwrite, as HDFS has;
on a local disk a hard link serves.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, base: str) -> list[int]:
    """Committed versions in order."""
    p, fs = _path(spark, f"{base}/commits")
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n) for n in names if n.isdigit())


def publish(spark: SparkSession, base: str, number: int, content: str) -> bool:
    """Commit ``content`` as this number; False if the number is taken."""
    jvm = spark.sparkContext._jvm
    target, fs = _path(spark, f"{base}/commits/{number:08d}")
    draft, _ = _path(spark, f"{base}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(content.encode()))
    out.close()
    fs.mkdirs(target.getParent())
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(target), local(draft))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(target):
            return False
        raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)


def content(spark: SparkSession, base: str, number: int) -> str:
    p, fs = _path(spark, f"{base}/commits/{number:08d}")
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def latest(spark: SparkSession, base: str) -> tuple[int, dict | None]:
    """(number, what it says) of the newest version; (0, None) without any."""
    have = numbers(spark, base)
    return (have[-1], json.loads(content(spark, base, have[-1]))) if have else (0, None)


def kept(spark: SparkSession, base: str, layout: str, build: Callable[[], dict[str, DataFrame]], force: bool = False) -> dict[str, DataFrame]:
    """The tables of the newest version, built first if there is none, if its layout is another, or by force. If another
    writer commits in the meantime, his version is taken, unless forced."""
    base = base.rstrip("/")
    number, said = latest(spark, base)
    if force or not said or said["layout"] != layout:
        folder = f"{base}/data/{uuid.uuid4().hex}"
        tables = build()
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        mine = {"layout": layout, "folder": folder, "tables": list(tables)}
        while not publish(spark, base, number + 1, json.dumps(mine)):
            number, said = latest(spark, base)
            if not force and said["layout"] == layout:
                mine = said
                break
        said = mine
    return {name: spark.read.parquet(f"{said['folder']}/{name}") for name in said["tables"]}


def append(spark: SparkSession, base: str, row: DataFrame) -> int:
    """Append rows as one commit and return its number: one more than the newest, whoever else appends."""
    base, run = base.rstrip("/"), uuid.uuid4().hex
    row.write.parquet(f"{base}/data/run={run}")
    number = (numbers(spark, base) or [0])[-1] + 1
    while not publish(spark, base, number, run):
        number += 1
    return number


def appended(spark: SparkSession, base: str, number_col: str = "run_order") -> DataFrame:
    """All committed rows with the number of their commit. Rows that were written but not committed do not show."""
    base = base.rstrip("/")
    commits = spark.read.text(f"{base}/commits").select(F.col("value").alias("run"), F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("int").alias(number_col))
    rows = spark.read.option("mergeSchema", True).option("basePath", f"{base}/data").parquet(f"{base}/data")
    return rows.withColumn("run", F.col("run").cast("string")).join(commits, "run").drop("run")
