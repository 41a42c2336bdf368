"""Grid joins: nearest nodes, nearest roads, snapping, proximity features.

A radius join is an equi-join on grid cells with an exact test afterwards. The cell size changes speed only.
Small maps are sent to the tasks. For larger ones dense cells are left to adaptive skew handling (both sides of the join are
plain shuffles).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, EARTH_M, angle_diff_deg, bearing_deg, haversine_m, metres_to_degrees
from ..sources.work import settled
from . import sequence as seq
from .metrics import quantiles

CELL = 0.0015
#: A map of so many nodes or segments is sent to the tasks, a larger one is shuffled.
SMALL = 20_000


def _cell(c, cell: float):
    return F.floor(c / cell).cast("long")


def _meet(many: DataFrame, few: DataFrame, on: list[str], small: bool) -> DataFrame:
    """many ⋈ few on cells. A small table is sent to the tasks. Otherwise both sides are shuffled: left alone, the planner would
    judge by the size before rows are spread over cells, and might send the spread points through the driver."""
    return many.join(F.broadcast(few), on) if small else many.hint("merge").join(few, on)


def _wide(reach: float, lat: str = "node_lat"):
    """Degrees of longitude that an arc of so many radians around a latitude touches; next to a pole all."""
    narrow = F.abs(F.cos(F.radians(lat)))
    return F.when(narrow > math.sin(reach), F.degrees(F.asin(F.least(F.lit(1.0), math.sin(reach) / narrow))) * (1 + 1e-9)).otherwise(360.0)


def _row_x(lon, row, cell: float):
    """Longitude in cells of a row of cells: their width is measured on the row's middle parallel, so it is about the same in
    metres on every row and a node near a pole does not lie in very many of them."""
    return lon * F.abs(F.cos(F.radians((row + 0.5) * cell))) / cell


def _spread(nodes: DataFrame, reach: float, cell: float) -> DataFrame:
    """nodes(node_lon, node_lat, …) once for each cell (_gx, _gy) that an arc of so many radians around them touches: up to three rows
    of about three cells. Next to a pole the arc holds every longitude. Beyond one, which no real node is, parallels shrink as before it."""
    high, wide = math.degrees(reach), _wide(reach)
    rows = nodes.withColumn("_gy", F.explode(F.sequence(_cell(F.col("node_lat") - high, cell), _cell(F.col("node_lat") + high, cell))))
    x = lambda d: _row_x(F.col("node_lon") + d, F.col("_gy"), cell)
    return rows.withColumn("_gx", F.explode(F.sequence(F.floor(x(-wide) - 1e-6).cast("long"), F.floor(x(wide) + 1e-6).cast("long"))))


def _about(nodes: DataFrame, places: DataFrame, reach: float, lon: str, lat: str) -> DataFrame:
    """Nodes that an arc of so many radians can join to the box of all places: what lies beyond meets none of them."""
    x0, x1, y0, y1 = places.agg(F.min(lon), F.max(lon), F.min(lat), F.max(lat)).first()
    if x0 is None or y0 is None:
        return nodes.limit(0)
    high, wide = math.degrees(reach) + 1e-6, _wide(reach) + 1e-6
    return nodes.where((F.col("node_lat") >= y0 - high) & (F.col("node_lat") <= F.lit(y1) + high) & (F.col("node_lon") >= x0 - wide) & (F.col("node_lon") <= F.lit(x1) + wide))


def _placed(points: DataFrame, nodes: DataFrame, radius: float, cell: float, lon: str, lat: str, within: DataFrame | None) -> tuple[DataFrame, DataFrame, bool]:
    """(points with their cell, nodes once for each cell that their radius touches, whether these are few). Of a large map only
    nodes about the box of the points count, or of ``within``, a table with lon and lat whose box holds them all."""
    reach = min(math.pi / 2, radius / EARTH_M) * (1 + 1e-9)
    cell = max(cell, math.degrees(reach))
    few = lambda df: df.limit(SMALL + 1).count() <= SMALL
    small = few(nodes)
    n = nodes.where("lon is not null and lat is not null").withColumnsRenamed({"lon": "node_lon", "lat": "node_lat"})
    if not small:
        n = _about(n, points, reach, lon, lat) if within is None else _about(n, within, reach, "lon", "lat")
        small = few(n)
    q = points.withColumn("_gy", _cell(F.col(lat), cell)).withColumn("_gx", F.floor(_row_x(F.col(lon), F.col("_gy"), cell)).cast("long"))
    return q, _spread(n, reach, cell), small


def near_nodes(points: DataFrame, nodes: DataFrame, radius: float, cell: float = CELL, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points ⋈ nodes within a radius: all columns of points, node_id, node_lon, node_lat, snap_m (and out_bearings
    if nodes has them). Cells are no smaller than the radius. Points lie in one cell; nodes are spread over the cells that
    their radius touches, measured as the distance is."""
    n = nodes.select("node_id", "lon", "lat", *(["out_bearings"] if "out_bearings" in nodes.columns else []))
    q, n, small = _placed(points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()), n, radius, cell, lon, lat, None)
    j = _meet(q, n, ["_gx", "_gy"], small).drop("_gx", "_gy").withColumn("snap_m", haversine_m(F.col(lon), F.col(lat), F.col("node_lon"), F.col("node_lat")))
    return j.where(F.col("snap_m") <= radius)


def with_nearest(points: DataFrame, nodes: DataFrame, radius: float, cell: float = CELL, within: DataFrame | None = None) -> DataFrame:
    """points with node_id, node_lon, node_lat, snap_m of the nearest node within the radius (ties to the smaller id), null
    where there is none. Points meet the list of nodes of their cell, so they stay one row each and are grouped by nothing."""
    q, n, small = _placed(points, nodes.select("node_id", "lon", "lat"), radius, cell, "lon", "lat", within)
    lists = n.groupBy("_gx", "_gy").agg(F.collect_list(F.struct("node_id", "node_lon", "node_lat")).alias("_near"))
    j = q.join(F.broadcast(lists), ["_gx", "_gy"], "left") if small else q.hint("merge").join(settled(lists, "node-cells"), ["_gx", "_gy"], "left")
    each = F.transform("_near", lambda n: F.struct(haversine_m(F.col("lon"), F.col("lat"), n["node_lon"], n["node_lat"]).alias("snap_m"), n["node_id"].alias("node_id"), n["node_lon"].alias("node_lon"), n["node_lat"].alias("node_lat")))
    best = F.array_min(F.filter(each, lambda n: n["snap_m"] <= radius))
    return j.select(*points.columns, best.alias("_b")).select(*points.columns, "_b.node_id", "_b.node_lon", "_b.node_lat", "_b.snap_m")


def nearest_node(points: DataFrame, nodes: DataFrame, radius: float, key: tuple[str, ...] = ("traj_id", "idx"), cell: float = CELL) -> DataFrame:
    """key, node_id, node_lon, node_lat, snap_m of the nearest node within the radius (ties to the smaller id)."""
    return with_nearest(points.select(*key, "lon", "lat"), nodes, radius, cell).where("node_id is not null").select(*key, "node_id", "node_lon", "node_lat", "snap_m")


def candidates(anchors: DataFrame, nodes: DataFrame, radius: float = 140.0, k: int = 4, sigma: float = 55.0, heading_weight: float = 0.7, fallback: float | None = 260.0, key: tuple[str, ...] = ("traj_id", "idx"), cell: float = CELL, more: tuple[str, ...] = ()) -> DataFrame:
    """The k cheapest nodes per anchor: cost = distance / sigma + weight * heading gap / 180. The heading gap is the
    least over the bearings that leave the node, 180 if none does, 0 if the anchor has no heading. Anchors without
    any node take those within the fallback radius, from the same join. ``more`` names columns of the anchors to keep."""
    wide = fallback is not None and fallback > radius
    j = near_nodes(anchors.select(*dict.fromkeys([*key, "lon", "lat", "heading", *more])), nodes, fallback if wide else radius, cell)
    gap = F.array_min(F.transform("out_bearings", lambda b: angle_diff_deg(F.col("heading"), b)))
    j = j.withColumn("heading_diff", F.when(F.col("heading").isNull(), 0.0).otherwise(F.coalesce(gap, F.lit(180.0))))
    j = j.withColumn("emit", F.col("snap_m") / max(sigma, 1e-6) + heading_weight * F.col("heading_diff") / 180.0)
    j = j.select(*key, "node_id", "node_lon", "node_lat", "snap_m", "heading_diff", "emit", *more)
    if wide:
        j = j.withColumn("_least", F.min("snap_m").over(Window.partitionBy(*key))).where((F.col("snap_m") <= radius) | (F.col("_least") > radius)).drop("_least")
    w = Window.partitionBy(*key).orderBy("emit", "node_id")
    return j.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k).select(*key, "rank", "node_id", "node_lon", "node_lat", "snap_m", "heading_diff", "emit", *more)


def snap(points: DataFrame, nodes: DataFrame, radius, cell: float = CELL, within: DataFrame | None = None) -> DataFrame:
    """points with lon and lat replaced by the nearest node within the radius; a number, or a column name with a
    radius per point (rows whose radius is not positive stay) whose greatest value is given as (name, most). ``within``: see ``with_nearest``."""
    name, most = radius if isinstance(radius, tuple) else (None, radius)
    if most <= 0:
        return points
    j = with_nearest(points, nodes, most, cell, within)
    inside = F.col("snap_m").isNotNull() & ((F.col("snap_m") <= F.col(name)) & (F.col(name) > 0) if name else F.lit(True))
    return j.withColumn("lon", F.when(inside, F.col("node_lon")).otherwise(F.col("lon"))).withColumn("lat", F.when(inside, F.col("node_lat")).otherwise(F.col("lat"))).select(*points.columns)


def _levels(segments: DataFrame, cell: float) -> tuple[DataFrame, dict[int, int]]:
    """segments with _level, the first level of doubled cells as long as the segment's box, and the levels in use (a few) with
    their numbers of segments."""
    long = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(long, F.lit(1e-12)) / cell))).cast("int")
    s = segments.where(long.isNotNull()).withColumn("_level", level)
    return s, dict(sorted(map(tuple, s.groupBy("_level").agg(F.count("*")).collect())))


def near_segments(points: DataFrame, segments: DataFrame, radius: float, key: tuple[str, ...] = ("traj_id", "idx"), cell: float = 0.003, by: tuple[str, ...] = (), more: tuple[str, ...] = (), of_segment: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """points ⋈ segments whose bounding box touches the point's box of the radius, with dist_m. ``by`` names columns of
    the key that a segment must share; ``more`` names columns of the points to keep, ``of_segment`` columns of the segments.
    ``outer``: a point also has a row without segment (seg_id and dist_m null, coordinates zero) where none lies in the first cell it
    probes, so each has a row at least.

    The grid has levels of doubled cells. A segment lies on the level whose cells are as long as it is, so in four of them at
    most, however long it is; a point probes the cells that its box touches on every level in use. A pair counts only
    in the lower left cell of its common area, so no distinct is needed. Of a large map only segments about the points' box count.

    Cells and distance are built column by column: as one expression their common parts are written out again at each use, and the
    join becomes a method too long for the JVM to compile."""
    s, levels = _levels(segments, cell)
    if sum(levels.values()) > SMALL:
        s, levels = _levels(_touching(segments, points, radius), cell)
    small, explode = sum(levels.values()) <= SMALL, F.explode_outer if outer else F.explode
    levels = levels or {0: 0}
    dx, dy = metres_to_degrees(radius, F.col("lat")), metres_to_degrees(radius)
    q = (points if outer else points.where("lon is not null and lat is not null")).select(*dict.fromkeys([*key, *more, "lon", "lat"]), (F.col("lon") - dx).alias("_x0"), (F.col("lon") + dx).alias("_x1"), (F.col("lat") - dy).alias("_y0"), (F.col("lat") + dy).alias("_y1"))
    size = cell * F.pow(F.lit(2.0), F.col("_level"))
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    span = lambda lo, hi, explode=F.explode: explode(F.sequence(at(lo), at(hi)))
    q = q.withColumn("_kx", DEGREE_M * F.greatest(F.lit(0.2), F.cos(F.radians("lat"))))
    q = q.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumns({"_px": at("_x0"), "_py": at("_y0")}).withColumn("_gx", span("_x0", "_x1", explode)).withColumn("_gy", span("_y0", "_y1", explode))
    s = s.withColumns({"_sx": at("min_lon"), "_sy": at("min_lat")}).withColumn("_gx", span("min_lon", "max_lon")).withColumn("_gy", span("min_lat", "max_lat"))
    first = (F.col("_gx") == F.greatest("_px", "_sx")) & (F.col("_gy") == F.greatest("_py", "_sy"))
    touch = (F.col("max_lon") >= F.col("_x0")) & (F.col("min_lon") <= F.col("_x1")) & (F.col("max_lat") >= F.col("_y0")) & (F.col("min_lat") <= F.col("_y1"))
    on = ["_level", "_gx", "_gy", *by]
    if outer:
        s = s.withColumnsRenamed({c: f"{c}_s" for c in on})
        same = [F.col(c) == F.col(f"{c}_s") for c in on]
        j = (q if small else q.hint("merge")).join(F.broadcast(s) if small else s, [*same, first & touch], "left")
        j = j.where(F.col("seg_id").isNotNull() | F.coalesce((F.col("_level") == min(levels)) & (F.col("_gx") == F.col("_px")) & (F.col("_gy") == F.col("_py")), F.lit(True)))
    else:
        j = _meet(q, s, on, small).where(first & touch)
    if outer:  # nulls would put branches into each step of the distance
        j = j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lon", "lat", "_kx", "lon1", "lat1", "lon2", "lat2")})
    j = _with_distance(j)
    if outer:
        j = j.withColumn("dist_m", F.when(F.col("seg_id").isNotNull(), F.col("dist_m")))
    return j.select(*key, *more, "seg_id", "lon1", "lat1", "lon2", "lat2", *of_segment, "dist_m")


def _touching(segments: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Segments whose box comes as near as the radius to the box of all points: the rest meets no point."""
    x0, x1, y0, y1 = points.where("lon is not null and lat is not null").agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    if x0 is None:
        return segments.limit(0)
    dx, dy = radius / (DEGREE_M * 0.2) + 1e-6, radius / DEGREE_M + 1e-6  # a degree of longitude counts as a fifth of one of latitude at least
    return in_box(segments, (x0 - dx, y0 - dy, x1 + dx, y1 + dy))


def _with_distance(pairs: DataFrame) -> DataFrame:
    """pairs(lon, lat, lon1, lat1, lon2, lat2, and _kx, the metres in a degree of longitude at the point) with dist_m as by ``point_segment_m``."""
    d = pairs.withColumns({"_ax": (F.col("lon1") - F.col("lon")) * F.col("_kx"), "_ay": (F.col("lat1") - F.col("lat")) * DEGREE_M, "_dx": (F.col("lon2") - F.col("lon1")) * F.col("_kx"), "_dy": (F.col("lat2") - F.col("lat1")) * DEGREE_M})
    d = d.withColumn("_nn", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    d = d.withColumn("_t", F.when(F.col("_nn") > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(F.col("_ax") * F.col("_dx") + F.col("_ay") * F.col("_dy")) / F.col("_nn")))).otherwise(0.0))
    d = d.withColumns({"_ex": F.col("_ax") + F.col("_t") * F.col("_dx"), "_ey": F.col("_ay") + F.col("_t") * F.col("_dy")})
    return d.withColumn("dist_m", F.sqrt(F.col("_ex") * F.col("_ex") + F.col("_ey") * F.col("_ey")))


def nearest_road(points: DataFrame, segments: DataFrame, radius: float, key: tuple[str, ...] = ("traj_id", "idx"), cell: float = 0.003) -> DataFrame:
    """key, road_m: distance to the nearest road. Points whose nearest road within the radius is not found search on at
    twice, then at four times the radius. Null if nothing is that near."""
    got, rest = None, points.select(*key, "lon", "lat")
    for times in (1, 2, 4):
        reach = times * radius
        found = settled(near_segments(rest, segments, reach, key, cell).groupBy(*key).agg(F.min("dist_m").alias("road_m")), "near")
        if times < 4:
            found = found.where(F.col("road_m") <= reach)
            rest = rest.join(found.select(*key), list(key), "left_anti")
        got = found if got is None else got.unionByName(found)
    return points.select(*key).join(got, list(key), "left")


def topology_violation(missing: DataFrame, segments: DataFrame, threshold: float = 35.0, cell: float = 0.003) -> DataFrame:
    """One row: share of predicted points farther than the threshold from any road (or with none near), and the mean
    and 95th percentile of the distances found."""
    d = settled(nearest_road(missing, segments, max(1.2 * threshold, 30.0), cell=cell), "road")
    bad = F.col("road_m").isNull() | (F.col("road_m") > threshold)
    return d.agg(F.count("*").alias("eval_points"), F.count_if(bad).alias("violations"), (F.count_if(bad) / F.count("*")).alias("violation_rate"), F.avg("road_m").alias("road_mean_m")).join(F.broadcast(quantiles(d, "road_m", {"road_p95_m": 0.95})), F.lit(True))  # one row each


MAP_FEATURES = ("road_mean", "road_p90", "road_max", "near_1", "near_2", "density_mean", "density_p90", "heading_mean", "heading_p90", "no_road")


@dataclass(frozen=True)
class MapCase:
    """Parameters of the map features: query radius, points per trajectory, the two thresholds of nearness."""

    radius: float = 120.0
    points: int = 24
    near: tuple[float, float] = (20.0, 50.0)


def map_features(points: DataFrame, segments: DataFrame, radius: float = 120.0, most_points: int = 24, near: tuple[float, float] = (20.0, 50.0), cell: float = 0.003) -> DataFrame:
    """Ten features per trajectory from at most most_points evenly spaced points: distance to the nearest road
    (mean, 90th percentile, greatest, share within two thresholds), roads within the radius (mean, 90th percentile),
    gap between travel and road direction at inner points (mean, 90th percentile, 90 without any), share of points
    with no road near. A point without a road counts as twice the radius away and as density 0."""
    return map_feature_cases(points, segments, {"": MapCase(radius, most_points, near)}, cell).drop("case")


def map_feature_cases(points: DataFrame, segments: DataFrame, cases: dict[str, MapCase], cell: float = 0.003) -> DataFrame:
    """(case, traj_id, features…) of many cases from one join; equal cases are worked out once."""
    used = list(dict.fromkeys(cases.values()))
    wide = map_feature_table(points, segments, used, cell)
    each = [F.struct(F.lit(name).alias("case"), *[F.col(f"case{used.index(c)}_{f}").alias(f) for f in MAP_FEATURES]) for name, c in cases.items()]
    return wide.select("traj_id", F.explode(F.array(*each)).alias("e")).where("e.no_road is not null").select("e.case", "traj_id", *[f"e.{f}" for f in MAP_FEATURES])


def map_feature_table(points: DataFrame, segments: DataFrame, cases: list[MapCase], cell: float = 0.003) -> DataFrame:
    """(traj_id, case0_road_mean, …): a row per trajectory with the features of all cases, from one join at the greatest radius: each
    pair of a point and a road counts in the cases that sample the point and whose radius it lies in.

    Points are dealt by trajectory once. With a map that is sent to the tasks they stay where they are: their pairs are put in order
    there, and the features of whole trajectories are worked out in Arrow batches."""
    radii = sorted({c.radius for c in cases})
    n = F.count("*").over(seq.whole())
    p = points.withColumn("travel", bearing_deg(F.lag("lon").over(seq.in_order()), F.lag("lat").over(seq.in_order()), F.lead("lon").over(seq.in_order()), F.lead("lat").over(seq.in_order()))).withColumn("_n", n)
    bits = {most: sum(1 << k for k, c in enumerate(cases) if c.points == most) for most in dict.fromkeys(c.points for c in cases)}
    sampled = reduce(lambda a, b: a + b, [F.when(seq.in_even_sample(F.col("idx"), F.col("_n"), most), F.lit(v).cast("long")).otherwise(F.lit(0).cast("long")) for most, v in bits.items()])
    s = p.select("traj_id", "idx", "lon", "lat", "travel", (DEGREE_M * F.greatest(F.lit(0.2), F.cos(F.radians("lat")))).alias("_east"), sampled.alias("_cases")).where("_cases > 0")
    if segments.limit(SMALL + 1).count() > SMALL:
        s = settled(s, "sampled")  # read for its box and for the join
    box = {f"_{n}_{c}": f(f"{c}1", f"{c}2") for c in ("lon", "lat") for n, f in (("lo", F.least), ("hi", F.greatest))}
    bearings = segments.withColumns({"_b": bearing_deg("lon1", "lat1", "lon2", "lat2"), **box})
    pairs = near_segments(s, bearings, radii[-1], cell=cell, more=("lon", "lat", "_east", "travel", "_cases"), of_segment=("_b", *box), outer=True)

    # without nulls, for which each comparison would have a branch, the step stays short enough for the JVM to compile
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    pairs = pairs.withColumns({c: zero(F.col(c)) for c in box}).withColumns({f"_dx{k}": zero(r / F.col("_east")) for k, r in enumerate(radii[:-1])})

    def touches(k: int):
        dx, dy = F.col(f"_dx{k}"), metres_to_degrees(radii[k])
        return (F.col("_hi_lon") >= F.col("lon") - dx) & (F.col("_lo_lon") <= F.col("lon") + dx) & (F.col("_hi_lat") >= F.col("lat") - dy) & (F.col("_lo_lat") <= F.col("lat") + dy)

    # the first radius whose box touches the road's, as all larger ones do: so many do not
    reach = F.when(F.col("seg_id").isNull(), -1).otherwise(reduce(lambda a, b: a + b, [F.when(touches(k), 0).otherwise(1) for k in range(len(radii) - 1)], F.lit(0)))
    place = F.row_number().over(Window.partitionBy("traj_id").orderBy("idx", "dist_m", "seg_id"))
    rows = pairs.select("traj_id", "idx", "travel", "_cases", "dist_m", "seg_id", F.col("_b").alias("b"), reach.alias("reach")).withColumn("place", place).drop("seg_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_trajectories(batches):
            ids, features = _case_features(t, cases, radii)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(f, from_pandas=True) for f in features]], names=out)

    out = ["traj_id", *[f"case{k}_{f}" for k in range(len(cases)) for f in MAP_FEATURES]]
    return rows.mapInArrow(run, f"traj_id {rows.schema['traj_id'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in out[1:]))


def _whole_trajectories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (place: from 1 in each trajectory) in tables that end where a trajectory does. What is carried on is the pairs of one
    trajectory's sampled points."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        starts = np.flatnonzero(b.column("place").to_numpy() == 1)
        if len(starts):
            if (kept or starts[-1]) and (done := [*kept, b.slice(0, starts[-1])]):
                yield pa.Table.from_batches(done)
            kept = []
            b = b.slice(starts[-1])
        if b.num_rows:
            kept.append(b)
    if kept:
        yield pa.Table.from_batches(kept)


def _quantile(values: np.ndarray, group: np.ndarray, starts: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    """Interpolated quantile of each group; groups lie one after the other."""
    v, at = values[np.lexsort((values, group))], q * (count - 1)
    low, high = np.floor(at), np.ceil(at)
    a, b = v[starts + low.astype(np.int64)], v[starts + high.astype(np.int64)]
    return np.where(a == b, a, (high - at) * a + (at - low) * b)


def _case_features(t: pa.Table, cases: list[MapCase], radii: list[float]) -> tuple[pa.Array, list[np.ndarray]]:
    """Trajectory ids and, case by case, their map features from ordered pairs (traj_id, place, idx, travel, _cases, dist_m, b, reach), a
    point's nearest road first. reach: place of the first radius that the road counts for, -1 where there is none."""
    idx, reach, dist, b = (t.column(c).to_numpy() for c in ("idx", "reach", "dist_m", "b"))
    head = t.column("place").to_numpy() == 1
    begins = head.copy()
    begins[1:] |= idx[1:] != idx[:-1]
    point, first = np.cumsum(begins) - 1, np.flatnonzero(begins)
    of, travel, taken = (np.cumsum(head) - 1)[first], t.column("travel").to_numpy()[first], t.column("_cases").to_numpy()[first]
    nearest, density = {}, {}
    for k, r in enumerate(radii):
        at = np.flatnonzero((reach >= 0) & (reach <= k))
        who = point[at]
        new = np.ones(len(at), bool)
        new[1:] = who[1:] != who[:-1]
        nearest[r] = np.full(len(first), -1)
        nearest[r][who[new]] = at[new]
        density[r] = np.bincount(who[dist[at] <= r], minlength=len(first)).astype(float)
    out, many = [], int(head.sum())
    for k, c in enumerate(cases):
        mine = np.flatnonzero(taken >> k & 1)
        group, near, den = of[mine], nearest[c.radius][mine], density[c.radius][mine]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        count = np.diff(np.r_[starts, len(group)])
        mean = lambda v, group=group, starts=starts, count=count: np.bincount(group, v, many)[group[starts]] / count
        d = np.where(near >= 0, dist[near], 2.0 * c.radius)
        gap = np.where(near >= 0, np.abs(np.mod(travel[mine] - b[near] + 180.0, 360.0) - 180.0), np.nan)
        some = ~np.isnan(gap)
        turned, gap = group[some], gap[some]
        heading = np.full((2, many), 90.0)
        if len(gap):
            s = np.flatnonzero(np.r_[True, turned[1:] != turned[:-1]])
            m = np.diff(np.r_[s, len(turned)])
            heading[:, turned[s]] = np.bincount(turned, gap, many)[turned[s]] / m, _quantile(gap, turned, s, m, 0.9)
        has = group[starts]  # trajectories with a sampled point
        for f in (
            mean(d), _quantile(d, group, starts, count, 0.9), np.maximum.reduceat(d, starts), mean((d <= min(c.near)).astype(float)), mean((d <= max(c.near)).astype(float)),
            mean(den), _quantile(den, group, starts, count, 0.9), heading[0, has], heading[1, has], mean((near < 0).astype(float)),
        ):
            out.append(np.full(many, np.nan))
            out[-1][has] = f
    return t.column("traj_id").combine_chunks().take(pa.array(np.flatnonzero(head))), out


def in_box(segments: DataFrame, box: tuple[float, float, float, float], most: int | None = None, seed: int = 0) -> DataFrame:
    """Segments whose box meets (min_lon, min_lat, max_lon, max_lat); optionally a hash-drawn sample of them."""
    a, b, c, d = box
    s = segments.where((F.col("max_lon") >= a) & (F.col("min_lon") <= c) & (F.col("max_lat") >= b) & (F.col("min_lat") <= d))
    return s if most is None else s.orderBy(F.xxhash64("seg_id", F.lit(seed)), "seg_id").limit(most)


__all__ = ["CELL", "DEGREE_M", "MAP_FEATURES", "MapCase", "candidates", "in_box", "map_feature_cases", "map_feature_table", "map_features", "near_nodes", "near_segments", "nearest_node", "nearest_road", "snap", "topology_violation", "with_nearest"]
