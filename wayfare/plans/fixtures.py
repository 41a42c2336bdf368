"""Trajectories, roads, trips and regression pairs derived from the driver's tables, in Spark and as SQL text.

P (points with truth), R (roads on a lattice), T (trips), Y (regression pairs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_m
from ..sources.osm import class_penalty, graph_nodes, with_bbox

SIDE, STEP, LON0, LAT0, ROADS_LAT0 = 41, 0.005, 108.8, 34.1, 34.195


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(c: str) -> Column:
    return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 1_000_000).cast("long")


def truth(spark: SparkSession, sf_dir: str, keep: int = 8) -> DataFrame:
    """points with true coordinates everywhere and the known flag of 1-of-keep masking."""
    w = Window.partitionBy("traj_id")
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "traj_id").select("traj_id", "event_id", "value", "ts", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("idx"), F.count("*").over(w).alias("n"))
    return e.select(
        "traj_id", "idx", "n", epoch("ts").alias("ts"),
        (F.lit(108.9) + F.lit(0.0005) * F.col("idx") + F.lit(0.00002) * F.col("value")).alias("lon"),
        (F.lit(34.2) + F.lit(0.0003) * F.col("idx") + F.lit(0.00001) * (F.col("event_id") % 997)).alias("lat"),
        ((F.col("idx") % keep == 0) | (F.col("idx") == F.col("n") - 1)).alias("known"),
    )


def masked(t: DataFrame) -> DataFrame:
    return t.withColumn("lon", F.when(F.col("known"), F.col("lon"))).withColumn("lat", F.when(F.col("known"), F.col("lat")))


def _road_legs(nodes: DataFrame) -> DataFrame:
    """Legs (highway, d, dir, a, b and both ends' lon and lat) between neighbours of nodes: along rows of SIDE nodes and across them."""
    i, j = F.floor(F.col("node_id") / SIDE), F.col("node_id") % SIDE
    highway = F.element_at(F.array(*map(F.lit, ("primary", "secondary", "residential"))), (i % 3 + 1).cast("int"))
    leg = lambda d, step, way: F.struct(F.lit(d).alias("d"), (F.col("node_id") + step).alias("b"), way.cast("int").alias("dir"))
    both = F.array(F.when(j < SIDE - 1, leg("h", 1, F.when(i % 5 == 0, 1).otherwise(0))), leg("v", SIDE, F.lit(0)))
    legs = nodes.select(F.col("node_id").alias("a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), highway.alias("highway"), F.explode(F.filter(both, lambda x: x.isNotNull())).alias("e")).select("a", "lon_a", "lat_a", "highway", "e.*")
    return legs.join(nodes.select(F.col("node_id").alias("b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b")), "b")


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per part: SIDE to a row, moved a little by the part's size and key, so that no two routes cost the same."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("node_id"), (F.lit(LON0) + F.lit(STEP) * (k % SIDE) + F.lit(0.00002) * F.col("p_size")).alias("lon"),
        (F.lit(ROADS_LAT0) + F.lit(STEP) * F.floor(k / SIDE) + F.lit(0.00001) * (k * 7919 % 97)).alias("lat"))


def roads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (with the bearings that leave them), directed edges, undirected segments of a road map that grows with part."""
    nodes = road_nodes(spark, sf_dir)
    legs = _road_legs(nodes)
    segments = with_bbox(legs.select(F.concat("d", F.col("a").cast("string")).alias("seg_id"), F.col("lon_a").alias("lon1"), F.col("lat_a").alias("lat1"), F.col("lon_b").alias("lon2"), F.col("lat_b").alias("lat2")))
    run = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), bearing_deg(f"lon_{a}", f"lat_{a}", f"lon_{b}", f"lat_{b}").alias("bearing"))
    both = F.filter(F.array(run("a", "b"), F.when(F.col("dir") == 0, run("b", "a"))), lambda x: x.isNotNull())
    length = haversine_m("lon_a", "lat_a", "lon_b", "lat_b").alias("dist_m")
    edges = legs.select(F.explode(both).alias("e"), length, class_penalty("highway").alias("class_penalty")).select("e.src", "e.dst", "dist_m", "e.bearing", "class_penalty")
    return graph_nodes(nodes, edges), edges, segments


def route_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes wanted: from a node per nation to one per supplier, up to twenty rows and forty columns away."""
    u, k = F.col("s_nationkey").cast("long") * 7, F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(u.alias("u"), (u + SIDE * (k * 13 % 20) + k * 7 % SIDE).alias("v"))


def lattice(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, directed edges, undirected segments of a 41 x 41 lattice; its size is fixed."""
    i = spark.range(SIDE).select(F.col("id").alias("i"))
    g = i.select("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SIDE - 1).cast("long"))).alias("j"))
    nodes = g.select((F.col("i") * SIDE + F.col("j")).alias("node_id"), (LON0 + STEP * F.col("j")).alias("lon"), (LAT0 + STEP * F.col("i")).alias("lat"))
    highway = F.element_at(F.array(*map(F.lit, ("primary", "secondary", "residential"))), (F.col("i") % 3 + 1).cast("int"))
    at = lambda a, b: (F.col("i") + a) * SIDE + F.col("j") + b
    legs = g.select("i", highway.alias("highway"), F.explode(F.filter(F.array(
        F.when(F.col("j") < SIDE - 1, F.struct(F.lit("h").alias("d"), at(0, 0).alias("a"), at(0, 1).alias("b"), F.when(F.col("i") % 5 == 0, 1).otherwise(0).alias("dir"))),
        F.when(F.col("i") < SIDE - 1, F.struct(F.lit("v").alias("d"), at(0, 0).alias("a"), at(1, 0).alias("b"), F.lit(0).alias("dir"))),
    ), lambda x: x.isNotNull())).alias("e")).select("highway", "e.*")
    end = lambda c: nodes.select(F.col("node_id").alias(c), F.col("lon").alias(f"lon_{c}"), F.col("lat").alias(f"lat_{c}"))
    legs = legs.join(end("a"), "a").join(end("b"), "b")
    segments = with_bbox(legs.select(F.concat("d", F.col("a").cast("string")).alias("seg_id"), F.col("lon_a").alias("lon1"), F.col("lat_a").alias("lat1"), F.col("lon_b").alias("lon2"), F.col("lat_b").alias("lat2")))
    run = lambda a, b: legs.select(F.col(a).alias("src"), F.col(b).alias("dst"), haversine_m("lon_a", "lat_a", "lon_b", "lat_b").alias("dist_m"), bearing_deg(f"lon_{a}", f"lat_{a}", f"lon_{b}", f"lat_{b}").alias("bearing"), class_penalty("highway").alias("class_penalty"), "dir")
    edges = run("a", "b").unionByName(run("b", "a").where("dir = 0")).drop("dir")
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.collect_list("bearing").alias("out_bearings"))
    return nodes.join(out, "node_id", "left").withColumn("out_bearings", F.coalesce("out_bearings", F.array().cast("array<double>"))), edges, segments


def trips(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(points, trips(traj_id, departure_ts, travel_time)) from orders and their lines."""
    w = Window.partitionBy("traj_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "traj_id").select(  # first, so that it is seen to be dealt by traj_id
        "traj_id", (F.row_number().over(w) - 1).cast("long").alias("idx"),
        (F.lit(108.8) + F.lit(0.0001) * (F.col("l_partkey") % 2000)).alias("lon"), (F.lit(34.1) + F.lit(0.001) * (F.col("l_suppkey") % 300)).alias("lat"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("traj_id"), epoch("o_orderdate").alias("departure_ts"), (F.col("o_totalprice").cast("double") / 100).alias("travel_time"))
    return li, o.join(li.select("traj_id").distinct(), "traj_id", "left_semi")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj_id, y_true, y_pred (null for orders without lines), departure_ts."""
    price = F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("traj_id")).agg((F.sum(price) / 100).alias("y_pred"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("traj_id"), (F.col("o_totalprice").cast("double") / 100).alias("y_true"), epoch("o_orderdate").alias("departure_ts"))
    return o.join(s, "traj_id", "left")


# The same as SQL.


def sql_epoch(c: str) -> str:
    return f"cast(floor(epoch_us(cast({c} as timestamp)) / 1000000) as bigint)"


def sql_points(keep: int = 8, name: str = "pts") -> str:
    return f"""{name} as (select traj_id, idx, n, ts, lon, lat, (idx % {keep} = 0 or idx = n - 1) as known from (
  select user_id as traj_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, count(*) over (partition by user_id) as n, {sql_epoch('ts')} as ts,
    108.9e0 + 0.0005e0 * (row_number() over (partition by user_id order by ts, event_id) - 1) + 0.00002e0 * value as lon,
    34.2e0 + 0.0003e0 * (row_number() over (partition by user_id order by ts, event_id) - 1) + 0.00001e0 * (event_id % 997) as lat from events))"""


def sql_linear(name: str = "lin", pts: str = "pts") -> str:
    """Linear recovery of the masked points, with the truth beside it (tlon, tlat)."""
    fill = lambda c, w, f: f"{f}(case when known then {c} end ignore nulls) over (partition by traj_id order by idx rows between {w})"
    back, ahead = "unbounded preceding and current row", "current row and unbounded following"
    knots = ", ".join(f"{fill(c, back, 'last_value')} as {c}0, {fill(c, ahead, 'first_value')} as {c}1" for c in ("ts", "lon", "lat"))
    one = lambda c: f"case when known then {c} else coalesce({c}0 + ({c}1 - {c}0) * coalesce((ts - ts0) / nullif(ts1 - ts0, 0)::double, case when {c}0 is not null and {c}1 is not null then 0 end), {c}0, {c}1) end"
    return f"{name} as (select traj_id, idx, n, ts, known, lon as tlon, lat as tlat, {one('lon')} as lon, {one('lat')} as lat from (select *, {knots} from {pts}))"


def sql_hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2))"
    return f"(case when ({a}) is not null and ({b}) is not null and ({c}) is not null and ({d}) is not null then 2 * 6371000e0 * asin(sqrt(least(1e0, greatest(0e0, {h})))) end)"


def sql_bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians(({c}) - ({a}))) * cos(radians({d}))"
    x = f"(cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos(radians(({c}) - ({a}))))"
    deg = f"(degrees(atan2({y}, {x})) + 360)"
    return f"(case when not (abs({y}) < 1e-12 and abs({x}) < 1e-12) then {deg} - 360 * floor({deg} / 360) end)"


def sql_angle(a: str, b: str) -> str:
    x = f"(({a}) - ({b}) + 180)"
    return f"abs({x} - 360 * floor({x} / 360) - 180)"


def sql_lattice() -> str:
    """nodes, segs, edges."""
    hw = "case i % 3 when 0 then 1.08e0 when 1 then 1.15e0 else 1.42e0 end"
    return f"""grid as (select a.range as i, b.range as j from range(41) a, range(41) b),
nodes as (select i * 41 + j as node_id, 108.8e0 + 0.005e0 * j as lon, 34.1e0 + 0.005e0 * i as lat from grid),
legs as (select 'h' || (i * 41 + j) as seg_id, i * 41 + j as a, i * 41 + j + 1 as b, case when i % 5 = 0 then 1 else 0 end as dir, {hw} as pen from grid where j < 40
  union all select 'v' || (i * 41 + j), i * 41 + j, (i + 1) * 41 + j, 0, {hw} from grid where i < 40),
segs as (select seg_id, p.lon as lon1, p.lat as lat1, q.lon as lon2, q.lat as lat2, dir, pen, a, b from legs join nodes p on a = p.node_id join nodes q on b = q.node_id),
edges as (select a as src, b as dst, {sql_hav('lon1', 'lat1', 'lon2', 'lat2')} as dist_m, {sql_bearing('lon1', 'lat1', 'lon2', 'lat2')} as bearing, pen from segs
  union all select b, a, {sql_hav('lon1', 'lat1', 'lon2', 'lat2')}, {sql_bearing('lon2', 'lat2', 'lon1', 'lat1')}, pen from segs where dir = 0)"""


def sql_roads() -> str:
    """nodes, segs, edges of the map from part."""
    hw = "case (a // 41) % 3 when 0 then 1.08e0 when 1 then 1.15e0 else 1.42e0 end"
    return f"""nodes as materialized (select p_partkey as node_id, 108.8e0 + 0.005e0 * (p_partkey % 41) + 0.00002e0 * p_size as lon, {ROADS_LAT0!r}e0 + 0.005e0 * (p_partkey // 41) + 0.00001e0 * (p_partkey * 7919 % 97) as lat from part),
legs as (select 'h' || node_id as seg_id, node_id as a, node_id + 1 as b, case when (node_id // 41) % 5 = 0 then 1 else 0 end as dir from nodes where node_id % 41 < 40 union all select 'v' || node_id, node_id, node_id + 41, 0 from nodes),
segs as materialized (select seg_id, p.lon as lon1, p.lat as lat1, q.lon as lon2, q.lat as lat2, dir, {hw} as pen, a, b from legs join nodes p on a = p.node_id join nodes q on b = q.node_id),
edges as materialized (select a as src, b as dst, {sql_hav('lon1', 'lat1', 'lon2', 'lat2')} as dist_m, {sql_bearing('lon1', 'lat1', 'lon2', 'lat2')} as bearing, pen from segs
  union all select b, a, {sql_hav('lon1', 'lat1', 'lon2', 'lat2')}, {sql_bearing('lon2', 'lat2', 'lon1', 'lat1')}, pen from segs where dir = 0),
wanted as materialized (select distinct u, u + 41 * (k * 13 % 20) + k * 7 % 41 as v from (select s_nationkey * 7 as u, s_suppkey as k from supplier))"""


def sql_trips() -> str:
    return f"""tp as (select l_orderkey as traj_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as idx,
  108.8e0 + 0.0001e0 * (l_partkey % 2000) as lon, 34.1e0 + 0.001e0 * (l_suppkey % 300) as lat from lineitem),
tr as (select o_orderkey as traj_id, {sql_epoch('o_orderdate')} as departure_ts, o_totalprice::double / 100 as travel_time from orders where o_orderkey in (select l_orderkey from lineitem))"""


def sql_pairs() -> str:
    return f"""pr as (select o_orderkey as traj_id, o_totalprice::double / 100 as y_true, y_pred, {sql_epoch('o_orderdate')} as departure_ts from orders
  left join (select l_orderkey, sum(l_extendedprice::double * (1 - l_discount::double)) / 100 as y_pred from lineitem group by 1) on l_orderkey = o_orderkey)"""


#: Added before rounding to six places: means of decimals often end in a five at the seventh place, where the last
#: bits of a sum, which depend on its order, would decide.
_NUDGE = 1.7e-8


def r6(*names: str) -> list[Column]:
    """Rounded to six places; no negative zero."""
    return [(F.round(F.col(n) + _NUDGE, 6) + 0.0).alias(n) for n in names]


def sql_r6(expr: str, name: str) -> str:
    return f"round(({expr}) + {_NUDGE!r}, 6) + 0e0 as {name}"
