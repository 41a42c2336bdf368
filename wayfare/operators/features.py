"""Trip features, cleaning, labels and weights for travel-time estimation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, finite, haversine_m
from ..functions.quantile import quantile_of, sorted_values
from . import sequence as seq

# The cleaning limits.
LEAST_TIME_S, MOST_TIME_S, LEAST_KMH, MOST_KMH = 60.0, 7200.0, 3.0, 120.0

TRIP_FEATURES = (
    "n_points", "path_m", "direct_m", "detour_ratio", "step_mean", "step_std", "step_p50", "step_p90", "step_max",
    "turn_mean", "turn_p90", "turn_max", "turn_share_30", "turn_share_60", "turn_share_90", "bbox_w", "bbox_h", "bbox_diag", "bbox_area",
    "heading_sin", "heading_cos", "start_lon", "start_lat", "end_lon", "end_lat",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "weekend", "minute_of_day", "log_path",
)


def departure(explicit: Column, first_ts: Column) -> Column:
    return F.coalesce(explicit, first_ts, F.lit(0).cast("long"))


def travel_time(timestamps: Column) -> Column:
    """Last minus first timestamp; null with fewer than two."""
    return F.when(F.size(timestamps) >= 2, F.element_at(timestamps, -1) - F.get(timestamps, F.lit(0))).cast("double")


def clock(ts: Column, tz_offset_s: int = 0, weekend: str = "fri_sat") -> dict[str, Column]:
    """Hour and day features of epoch seconds. Days count from Sunday = 0; weekend="fri_sat" flags days 5 and 6 of
    that count, "sat_sun" flags days 6 and 0."""
    t = ts + tz_offset_s
    day_s = F.pmod(t, F.lit(86400))
    hour = day_s / 3600.0
    dow = F.pmod(F.floor(t / 86400) + 4, F.lit(7))
    off = dow >= 5 if weekend == "fri_sat" else dow.isin(6, 0)
    return {
        "hour": F.floor(hour), "dow": dow, "hour_sin": F.sin(2 * math.pi * hour / 24), "hour_cos": F.cos(2 * math.pi * hour / 24),
        "dow_sin": F.sin(2 * math.pi * dow / 7), "dow_cos": F.cos(2 * math.pi * dow / 7), "weekend": off.cast("double"), "minute_of_day": day_s / 86400.0,
    }


def trip_features(points: DataFrame, trips: DataFrame, tz_offset_s: int = 0, weekend: str = "fri_sat") -> DataFrame:
    """One row per trip with the TRIP_FEATURES. points(traj_id, idx, lon, lat); trips(traj_id, departure_ts). A trip
    without points, and any undefined value, gives zeros (heading: 0, 1)."""
    s = seq.steps(points)
    turn, step = F.col("turn_deg"), F.col("step_m")
    share = lambda deg: F.when(F.count(turn) > 0, F.count(F.when(turn > deg, 1)) / F.count(turn))
    start_lon, start_lat, end_lon, end_lat = F.min_by("lon", "idx"), F.min_by("lat", "idx"), F.max_by("lon", "idx"), F.max_by("lat", "idx")
    path, direct = F.coalesce(F.sum(step), F.lit(0.0)), haversine_m(start_lon, start_lat, end_lon, end_lat)
    wide = DEGREE_M * F.greatest(F.lit(0.2), F.cos(F.radians((F.min("lat") + F.max("lat")) / 2)))
    w, h = (F.max("lon") - F.min("lon")) * wide, (F.max("lat") - F.min("lat")) * DEGREE_M
    # net heading: a unit vector; north where the ends coincide
    p1, p2, dl = F.radians(start_lat), F.radians(end_lat), F.radians(end_lon - start_lon)
    y, x = F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    r = F.hypot(x, y)
    moved = ~((F.abs(x) < 1e-12) & (F.abs(y) < 1e-12))
    steps, turns = sorted_values(step), sorted_values(turn)
    of_points = {
        "n_points": F.count("*").cast("double"), "path_m": F.sum(step), "direct_m": direct, "detour_ratio": path / F.greatest(direct, F.lit(1e-6)),
        "step_mean": F.avg(step), "step_std": F.stddev_pop(step), "step_p50": quantile_of(steps, 0.5), "step_p90": quantile_of(steps, 0.9), "step_max": F.max(step),
        "turn_mean": F.avg(turn), "turn_p90": quantile_of(turns, 0.9), "turn_max": F.max(turn), **{f"turn_share_{d}": share(d) for d in (30, 60, 90)},
        "bbox_w": w, "bbox_h": h, "bbox_diag": F.hypot(w, h), "bbox_area": w * h / 1_000_000,
        "heading_sin": F.when(moved, y / r).otherwise(0.0), "heading_cos": F.when(moved, x / r).otherwise(1.0),
        "start_lon": start_lon, "start_lat": start_lat, "end_lon": end_lon, "end_lat": end_lat, "log_path": F.log1p(path),
    }
    # All of it inside the aggregate, whose results are computed in many small methods: as a projection after the join it was one method
    # too long for the compiler of the JVM, which then interprets it. (count_if and nullif would be pulled out into such a projection.)
    a = s.groupBy("traj_id").agg(*[finite(c).alias(n) for n, c in of_points.items()])
    of_trip = {n: c for n, c in clock(F.col("departure_ts"), tz_offset_s, weekend).items() if n in TRIP_FEATURES}
    t = trips.select("traj_id", *[finite(c).alias(n) for n, c in of_trip.items()]).join(a, "traj_id", "left")
    return t.select("traj_id", *[F.coalesce(F.col(n), F.lit(1.0 if n == "heading_cos" else 0.0)).cast("double").alias(n) for n in TRIP_FEATURES])


def drop_reason(n_points: Column, time_s: Column, path_m: Column) -> Column:
    """Why a training trip is left out, first reason that holds; null if it is used."""
    kmh = path_m / time_s * 3.6
    return (
        F.when(n_points < 2, "too_short").when(time_s.isNull() | F.isnan(time_s) | (time_s <= 0), "invalid_label")
        .when((time_s < LEAST_TIME_S) | (time_s > MOST_TIME_S), "time_range").when((kmh < LEAST_KMH) | (kmh > MOST_KMH), "speed_range")
    )


def clean_trips(trips: DataFrame) -> DataFrame:
    """trips(traj_id, n_points, travel_time, path_m) with drop_reason. An empty training set is an error for the caller."""
    return trips.withColumn("drop_reason", drop_reason(F.col("n_points"), F.col("travel_time"), F.coalesce("path_m", F.lit(0.0))))


def sample_weight(y: Column, mode: str = "none") -> Column:
    """none: 1; short-boost: 1.8 up to ten minutes, 1.2 up to thirty, else 1."""
    return F.when(y <= 600, 1.8).when(y <= 1800, 1.2).otherwise(1.0) if mode == "short-boost" else F.lit(1.0)


def forward_target(y: Column, transform: str = "none") -> Column:
    return F.log1p(F.greatest(y, F.lit(0.0))) if transform == "log1p" else y


def inverse_target(z: Column, transform: str = "none") -> Column:
    """Back to seconds, one second at least."""
    return F.greatest(F.lit(1.0), F.expm1(z) if transform == "log1p" else z)


def trip_context(points: DataFrame, trips: DataFrame) -> DataFrame:
    """hour (UTC), n_points, path_km, direct_km, detour_ratio per trip."""
    s = points.withColumn("step_m", haversine_m(F.lag("lon").over(seq.in_order()), F.lag("lat").over(seq.in_order()), F.col("lon"), F.col("lat")))
    a = s.groupBy("traj_id").agg(F.count("*").alias("n_points"), (F.coalesce(F.sum("step_m"), F.lit(0.0)) / 1000).alias("path_km"), F.min_by(F.struct("lon", "lat"), "idx").alias("a"), F.max_by(F.struct("lon", "lat"), "idx").alias("b"))
    a = a.withColumn("direct_km", haversine_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) / 1000).drop("a", "b")
    a = a.withColumn("detour_ratio", F.col("path_km") / F.greatest(F.col("direct_km"), F.lit(1e-6)))
    return trips.select("traj_id", clock(F.col("departure_ts"))["hour"].alias("hour")).join(a, "traj_id", "left")


def first_rows(df: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows in the given order, which should be a total one; all of them if most is not positive."""
    return df.orderBy(*order).limit(most) if most > 0 else df
