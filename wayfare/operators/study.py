"""Case sampling and the comparison of several recoveries of the same gaps (player, two baselines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, haversine_m
from ..sources.osm import with_bbox
from ..sources.work import settled
from . import sequence as seq, spatial

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.98)


def representative(traj_mae: DataFrame, k: int = 6) -> DataFrame:
    """k trajectories at fixed quantiles of MAE (index rounded half to even), repeats replaced by the worst ones.

    Ranking is over one row per trajectory; only ranks near the quantiles and the k worst go on."""
    n = traj_mae.count()
    if n == 0:
        return traj_mae.select("traj_id", "mae", F.lit(0).alias("pick"))
    picks: list[int] = []
    for q in QUANTILES[:k]:
        i = min(n - 1, max(0, round(q * (n - 1))))
        if i not in picks:
            picks.append(i)
    for i in range(n - 1, -1, -1):
        if len(picks) >= min(k, n):
            break
        if i not in picks:
            picks.append(i)
    ranks = ranked(traj_mae, ["mae", "traj_id"]).where(F.col("rank0").isin(picks))
    place = F.create_map(*[F.lit(x) for i, r in enumerate(picks) for x in (r, i)])
    return ranks.select("traj_id", "mae", place[F.col("rank0").cast("int")].alias("pick"))


def ranked(df: DataFrame, by: list[str], slices: int = 64) -> DataFrame:
    """rank0: global rank from 0 without a single-partition window: rows are ranged, counted per range, and
    ranked within their range."""
    r = settled(df.repartitionByRange(slices, *by).withColumn("_p", F.spark_partition_id()), "ranges")  # fixed before they are counted
    inner = r.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*by)) - 1)
    # one row per range
    before = r.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn("rank0", (F.col("_r") + F.col("_b")).cast("long")).drop("_p", "_r", "_b")


def stratified_pool(cases: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """target cases spread over three score bins (sizes n//3, then 2n//3, the remainder in the last): quotas as
    even as possible, earlier bins get the extra, short bins are topped up from the rest. The draw is by a hash of
    id and seed, so it is the same on every run.

    cases(traj_id, score)."""
    n = cases.count()
    r = ranked(cases, ["score", "traj_id"])
    if target <= 0 or target >= n:
        return r.select("traj_id", "score", "rank0")
    i1, i2 = n // 3, 2 * n // 3
    sizes = (i1, i2 - i1, n - i2)
    quota = [target // 3 + (i < target % 3) for i in range(3)]
    bins = F.when(F.col("rank0") < i1, 0).when(F.col("rank0") < i2, 1).otherwise(2)
    left = target - sum(min(q, s) for q, s in zip(quota, sizes))
    drawn = r.withColumn("bin", bins).withColumn("h", F.md5(F.concat_ws(":", F.col("traj_id").cast("string"), F.lit(str(seed)))))
    drawn = drawn.withColumn("o", F.row_number().over(Window.partitionBy("bin").orderBy("h", "traj_id")))
    quotas = F.create_map(*[F.lit(x) for i, q in enumerate(quota) for x in (i, q)])
    inside = F.col("o") <= quotas[F.col("bin")]
    first = drawn.where(inside)
    if left:
        first = first.unionByName(drawn.where(~inside).orderBy("h", "traj_id").limit(left))
    return first.select("traj_id", "score", "rank0")


def hash_sample(df: DataFrame, k: int, seed: int = 0, key: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """k rows without replacement, drawn by a hash of the key; equal in distribution to a reservoir sample."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(k)


def gap_metrics(inputs: DataFrame, truth: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """Per gap and method: evaluated points, unfilled points, MAE, RMSE; methods side by side."""
    gaps = seq.gap_table(inputs)
    miss = gaps.select("traj_id", "gap_id", "missing_count", F.explode(F.sequence(F.col("start_idx") + 1, F.col("end_idx") - 1)).alias("idx"))
    j = miss.join(truth.select("traj_id", "idx", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), ["traj_id", "idx"])
    for m, p in methods.items():
        j = j.join(p.select("traj_id", "idx", F.col("lon").alias("_x"), F.col("lat").alias("_y")), ["traj_id", "idx"], "left").withColumn(f"e_{m}", haversine_m("_x", "_y", "_lon", "_lat")).drop("_x", "_y")
    aggs = [a for m in methods for a in (F.count(f"e_{m}").alias(f"n_{m}"), F.avg(f"e_{m}").alias(f"mae_{m}"), F.sqrt(F.avg(F.col(f"e_{m}") * F.col(f"e_{m}"))).alias(f"rmse_{m}"))]
    return j.groupBy("traj_id", "gap_id", "missing_count").agg(*aggs)


def case_metrics(inputs: DataFrame, truth: DataFrame, methods: dict[str, DataFrame]) -> DataFrame:
    """Per trajectory and method: total missing, evaluated, unfilled, MAE and RMSE over the finite pairs."""
    j = inputs.where(~F.col("known")).select("traj_id", "idx").join(truth.select("traj_id", "idx", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), ["traj_id", "idx"])
    for m, p in methods.items():
        j = j.join(p.select("traj_id", "idx", F.col("lon").alias("_x"), F.col("lat").alias("_y")), ["traj_id", "idx"], "left").withColumn(f"e_{m}", haversine_m("_x", "_y", "_lon", "_lat")).drop("_x", "_y")
    aggs = [a for m in methods for a in (F.count(f"e_{m}").alias(f"n_{m}"), F.avg(f"e_{m}").alias(f"mae_{m}"), F.sqrt(F.avg(F.col(f"e_{m}") * F.col(f"e_{m}"))).alias(f"rmse_{m}"))]
    return j.groupBy("traj_id").agg(F.count("*").alias("missing_count"), *aggs)


def study_summary(cases: DataFrame, method: str, against: list[str]) -> DataFrame:
    """One row: plain mean of case metrics, metrics weighted by all missing points (RMSE pooled by squares), and the
    share of cases in which the method beats each of the others."""
    w = F.col("missing_count")
    out = [F.count("*").alias("cases"), F.sum(w).alias("missing")]
    for m in (method, *against):
        mae, rmse = F.col(f"mae_{m}"), F.col(f"rmse_{m}")
        out += [F.avg(mae).alias(f"mean_mae_{m}"), (F.sum(w * mae) / F.sum(F.when(mae.isNotNull(), w))).alias(f"weighted_mae_{m}"), F.sqrt(F.sum(w * rmse * rmse) / F.sum(F.when(rmse.isNotNull(), w))).alias(f"weighted_rmse_{m}")]
    out += [F.avg(F.when(F.col(f"mae_{method}").isNotNull() & F.col(f"mae_{o}").isNotNull(), (F.col(f"mae_{method}") < F.col(f"mae_{o}")).cast("double"))).alias(f"win_rate_{o}") for o in against]
    return cases.agg(*out)


def polyline_errors(truth_missing: DataFrame, line: DataFrame, radius: float = 250.0) -> DataFrame:
    """Order-free error: distance of each missing true point to the nearest leg of its trajectory's predicted line;
    null if the trajectory has no leg or the point no place.

    Points meet legs in cells of the map, so a long trajectory is spread over tasks. The radius grows by four until
    each point has found a leg inside it, which then is the nearest one. Cells are as wide as a point's box."""
    legs = line.withColumn("lon2", F.lead("lon").over(seq.in_order())).withColumn("lat2", F.lead("lat").over(seq.in_order())).where("lon is not null and lat is not null and lon2 is not null and lat2 is not null")
    legs = settled(with_bbox(legs.select("traj_id", F.lit("").alias("seg_id"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2")), "legs")
    key = ["traj_id", "idx"]
    points = settled(truth_missing.select(*key, "lon", "lat").join(legs.groupBy("traj_id").agg(F.lit(True).alias("_has")), "traj_id", "left"), "points")
    can = F.col("_has").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    out = points.where(~can).select(*key, F.lit(None).cast("double").alias("error_m"))
    todo = points.where(can).drop("_has")
    while not todo.isEmpty():
        near = spatial.near_segments(todo, legs, radius, cell=2 * radius / DEGREE_M, by=("traj_id",)).groupBy(*key).agg(F.min("dist_m").alias("error_m"))
        got = settled(todo.join(near, key, "left"), "nearest")
        out = out.unionByName(got.where(F.col("error_m") <= radius).select(*key, "error_m"))
        todo = got.where(F.col("error_m").isNull() | (F.col("error_m") > radius)).drop("error_m")
        radius *= 4
        if radius > 1e12:
            raise ValueError("coordinates are not finite")
    return out


def resampled_errors(inputs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per gap, the predicted line between the anchors is resampled evenly and compared index by index."""
    gaps = seq.gap_table(inputs)
    spans = gaps.select("traj_id", "gap_id", "missing_count", "start_idx", F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    line = spans.join(predicted.select("traj_id", "idx", "lon", "lat"), ["traj_id", "idx"]).where("lon is not null and lat is not null")
    by = ("traj_id", "gap_id")
    got = seq.resample(line.select(*by, "idx", "lon", "lat"), seq.even_ratios(gaps, (F.col("missing_count") + 2).cast("int"), by), by)
    at = got.join(gaps.select(*by, "start_idx", "missing_count"), list(by)).where("k between 1 and missing_count").select("traj_id", "gap_id", (F.col("start_idx") + F.col("k")).alias("idx"), F.col("lon").alias("_x"), F.col("lat").alias("_y"))
    return at.join(truth.select("traj_id", "idx", "lon", "lat"), ["traj_id", "idx"]).select("traj_id", "gap_id", "idx", haversine_m("_x", "_y", "lon", "lat").alias("error_m"))


def ordered_unique(df: DataFrame, key: str = "traj_id", order: str = "ord") -> DataFrame:
    """First occurrence of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def common_ids(*tables: DataFrame) -> DataFrame:
    """Ids present in every table, sorted."""
    ids = tables[0].select("traj_id").distinct()
    for t in tables[1:]:
        ids = ids.join(t.select("traj_id"), "traj_id", "left_semi")
    return ids.orderBy("traj_id")
