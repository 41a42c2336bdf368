"""Fixed schemas. Points in long form are the working shape; nested records are read and normalised once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import finite
from . import versions

COORD = "struct<lon:double,lat:double>"
MASKED = f"traj_id long, timestamps array<long>, coords array<{COORD}>, mask array<boolean>"
TRUTH = f"traj_id long, coords array<{COORD}>"
TRIP = f"traj_id long, coords array<{COORD}>, departure_timestamp long, timestamps array<long>"
LABEL = "traj_id long, travel_time double"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested records from Parquet or line JSON, checked against a fixed schema."""
    reader = spark.read.schema(schema)
    df = reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)
    want = {f.name for f in spark.createDataFrame([], schema).schema.fields}
    missing = want - set(df.columns)
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    return df


def last_wins(df: DataFrame, key: str = "traj_id", order: str = "ord") -> DataFrame:
    """One row per key: the one that comes last in the given order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def points_of(records: DataFrame) -> DataFrame:
    """Masked or true records -> points(traj_id, idx, n, ts, lon, lat, known). Missing arrays give nulls;
    NaN becomes null; a masked point has no coordinates."""
    has = set(records.columns)
    zipped = F.arrays_zip(*[F.col(c).alias(a) for c, a in (("coords", "c"), ("timestamps", "t"), ("mask", "m")) if c in has])
    p = records.select("traj_id", F.size("coords").alias("n"), F.posexplode(zipped).alias("idx", "z"))
    known = F.coalesce(F.col("z.m"), F.lit(True)) if "mask" in has else F.lit(True)
    ts = F.col("z.t") if "timestamps" in has else F.lit(None).cast("long")
    return p.select(
        "traj_id", F.col("idx").cast("long"), F.col("n").cast("long"), ts.alias("ts"),
        F.when(known, finite(F.col("z.c.lon"))).alias("lon"), F.when(known, finite(F.col("z.c.lat"))).alias("lat"), known.alias("known"),
    )


def records_of(points: DataFrame) -> DataFrame:
    """points -> one record per trajectory with its coordinates in order."""
    row = F.struct("idx", "lon", "lat")
    return points.groupBy("traj_id").agg(
        F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(r["lon"].alias("lon"), r["lat"].alias("lat"))).alias("coords")
    )


def check_same_shape(left: DataFrame, right: DataFrame) -> DataFrame:
    """Trajectories whose ids or point counts differ between two point tables: empty if they agree."""
    count = lambda d, c: d.groupBy("traj_id").agg(F.count("*").alias(c))
    return count(left, "n_left").join(count(right, "n_right"), "traj_id", "full_outer").where(~F.col("n_left").eqNullSafe(F.col("n_right")))


def write_json(df: DataFrame, path: str) -> None:
    """Line JSON; NaN is written as null."""
    clean = [finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.json(path)


def dataset_name(name: str) -> str:
    """8 or 16 from the names that a masking ratio goes by."""
    short = name.strip().removeprefix("1/")
    if short not in ("8", "16"):
        raise ValueError(f"unknown dataset {name!r}")
    return short


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def append_log(spark: SparkSession, path: str, row: DataFrame, stamp: str) -> DataFrame:
    """Append one run's metrics to a log and return the log. ``run_order`` counts the commits, so runs stay in the order
    of appending, whoever appends; names and stamps may repeat."""
    versions.append(spark, path, row.withColumn("stamp", F.lit(stamp)))
    return versions.appended(spark, path).orderBy("run_order")


def reference_metrics(df: DataFrame) -> DataFrame:
    """mae, rmse, mape from a metrics document that may be flat or nested under global or val."""
    has = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def pick(name: str):
        cs = [F.col(f"{p}.{name}") for p in ("global", "val") if has.get(p) == "struct" and name in df.schema[p].dataType.fieldNames()]
        cs += [F.col(name)] if name in has else []
        return (F.coalesce(*cs) if cs else F.lit(None)).cast("double").alias(name)

    return df.select(pick("mae"), pick("rmse"), pick("mape"))


def predictions_in(spark: SparkSession, path: str, combined: str = "player_predictions_saved_cases.json") -> DataFrame:
    """Prediction records of a submission: a file of records; a folder with a combined file, which then counts alone; or a
    folder of files, of which per id the last by name counts. Only well-formed records. A path that is not there is an error."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, combined)
    source = whole.toString() if fs.getFileStatus(folder).isDirectory() and fs.exists(whole) else path
    df = spark.read.schema(TRUTH).option("recursiveFileLookup", "true").json(source).withColumn("ord", F.input_file_name())
    return last_wins(df.where("traj_id is not null and coords is not null")).drop("ord")
