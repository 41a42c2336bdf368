"""Round trips through every source and sink: a table is written to the work folder, read back and compared by its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets
from ..operators import features
from ..sources import osm, schemas
from ..sources.work import settled, shared_folder
from . import fixtures as fx
from .fixtures import r6, sql_r6


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _map_file(spark: SparkSession, sf_dir: str) -> str:
    """The road map of part as OpenStreetMap elements, with a footway, a way of one node and a reference that leads nowhere.
    The elements lie in any number of files, as the reader looks for elements and not for a whole document."""
    nodes = fx.road_nodes(spark, sf_dir)
    node = nodes.select(F.format_string('<node id="%d" lat="%s" lon="%s"/>', "node_id", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("value"))
    ref = lambda n: F.format_string('<nd ref="%d"/>', n)
    tag = lambda k, v: F.format_string('<tag k="%s" v="%s"/>', F.lit(k), v)
    way = lambda wid, refs, *tags: F.concat(F.format_string('<way id="%d">', wid), *refs, *tags, F.lit("</way>")).alias("value")
    g = nodes.select("node_id", F.floor(F.col("node_id") / fx.SIDE).alias("i"))
    kind = F.element_at(F.array(*map(F.lit, ("primary", " Secondary ", "residential"))), (F.col("i") % 3 + 1).cast("int"))
    one = F.when(F.col("i") % 5 == 0, "yes").otherwise("no")
    # a row leads from west to east in one way; the last tag of a name counts
    row = g.groupBy("i").agg(F.array_join(F.transform(F.sort_array(F.collect_list("node_id")), ref), "").alias("refs"))
    rows = row.select(way(F.col("i"), [F.col("refs")], tag("highway", F.lit("footway")), tag("highway", kind), tag("oneway", one)))
    columns = g.select(way(F.lit(1 << 40) + F.col("node_id"), [ref(F.col("node_id")), ref(F.col("node_id") + fx.SIDE)], tag("highway", kind)))
    odd = spark.createDataFrame([('<way id="9001"><nd ref="0"/><nd ref="1"/><tag k="highway" v="footway"/></way>',), ('<way id="9002"><nd ref="0"/><tag k="highway" v="primary"/></way>',), ('<way id="9003"><nd ref="5"/><nd ref="99999999999"/><tag k="highway" v="primary"/></way>',), ('<way id="9004"><nd ref="7"/><nd ref="7"/><tag k="highway" v="primary"/></way>',)], "value string")
    path = _folder(spark, "map")
    node.unionByName(rows).unionByName(columns).unionByName(odd).write.text(path)
    return path


def osm_edges(spark, sf_dir):
    """Directed edges of the drivable ways of a map file."""
    return osm.road_edges(*osm.read_osm(spark, _map_file(spark, sf_dir))).select("src", "dst", *r6("dist_m", "bearing"), "class_penalty")


def osm_segments(spark, sf_dir):
    """Undirected segments; the one of zero length stays."""
    return osm.road_segments(*osm.read_osm(spark, _map_file(spark, sf_dir))).select(*r6("lon1", "lat1", "lon2", "lat2", "min_lon", "max_lon", "min_lat", "max_lat"))


def graph_cache(spark, sf_dir):
    """Rows of the kept tables, built once, read from the cache, and built anew by force."""
    path, cache = _map_file(spark, sf_dir), _folder(spark, "graph")
    out = None
    for turn, force in enumerate((False, False, True)):
        for name, t in zip(("nodes", "edges", "segments"), osm.load_or_build(spark, path, cache, force)):
            r = settled(t.agg(F.lit(turn).alias("turn"), F.lit(name).alias("name"), F.count("*").alias("count")), "count")  # counted before the tables are replaced
            out = r if out is None else out.unionByName(r)
    return out


def record_round_trip(spark, sf_dir):
    """Points to nested records, written and read back with their schema, to points again."""
    path = _folder(spark, "records")
    schemas.records_of(fx.truth(spark, sf_dir)).write.parquet(path)
    return schemas.points_of(schemas.read_records(spark, path, schemas.TRUTH)).select("traj_id", "idx", "n", *r6("lon", "lat"), "known")


def json_round_trip(spark, sf_dir):
    """Regression pairs as line JSON; a missing or undefined prediction comes back as null."""
    path = _folder(spark, "pairs")
    p = fx.pairs(spark, sf_dir).select("traj_id", "y_true", F.when(F.col("traj_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("y_pred")).alias("y_pred"))
    schemas.write_json(p, path)
    return spark.read.schema("traj_id long, y_true double, y_pred double").json(path).select("traj_id", *r6("y_true", "y_pred"))


def csv_round_trip(spark, sf_dir):
    """Trips with their duration class as CSV with a header."""
    path = _folder(spark, "trips")
    _, t = fx.trips(spark, sf_dir)
    schemas.write_csv(t.select("traj_id", "departure_ts", buckets.duration_bucket("travel_time").alias("bucket")), path)
    return spark.read.option("header", True).schema("traj_id long, departure_ts long, bucket string").csv(path)


def run_log(spark, sf_dir):
    """A log of five runs, appended one after another; names and stamps repeat."""
    path = _folder(spark, "log")
    o = fx.table(spark, sf_dir, "orders")
    log = None
    for k in (3, 1, 2, 1, 0):
        row = o.where(F.col("o_orderkey") % 5 == k).agg(F.lit(f"run {k}").alias("milestone"), F.count("*").alias("count"))
        log = schemas.append_log(spark, path, row, "2024-01-01")
    return log.select("run_order", "milestone", "count")


def submission_scan(spark, sf_dir):
    """Predictions below a folder: of an id in several files that in the last file by name counts."""
    path = _folder(spark, "submissions")
    t = fx.truth(spark, sf_dir)
    shifted = t.where("traj_id % 3 = 0").withColumn("lon", F.col("lon") + 1)
    for name, part in (("a", t.where("traj_id % 2 = 0")), ("b/c", shifted)):
        schemas.records_of(part).write.json(f"{path}/{name}")
    spark.createDataFrame([("not a record",), ("{}",)], "value string").write.text(f"{path}/z")
    return schemas.points_of(schemas.predictions_in(spark, path)).select("traj_id", "idx", *r6("lon", "lat"))


def metrics_documents(spark, sf_dir):
    """Metrics read from a flat document, one nested under global, and one nested under val without a value."""
    m = fx.pairs(spark, sf_dir).where("y_pred is not null").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"), F.lit(2.5).alias("rmse"), F.lit(1.5).alias("mape"))
    docs = {"flat": m, "global": m.select(F.struct("mae", "rmse", "mape").alias("global")), "val": m.select(F.struct("mae", "mape").alias("val"))}
    out = None
    for name, d in docs.items():
        path = _folder(spark, "metrics")
        schemas.write_json(d, path)
        r = schemas.reference_metrics(spark.read.json(path)).select(F.lit(name).alias("form"), *r6("mae", "rmse", "mape"))
        out = r if out is None else out.unionByName(r)
    return out


def first_trips(spark, sf_dir):
    """The first 500 trips by departure: the row limit of a training run."""
    _, t = fx.trips(spark, sf_dir)
    return features.first_rows(t, 500, "departure_ts", "traj_id").select("traj_id", "departure_ts")


QUERIES = {f.__name__: f for f in (
    osm_edges, osm_segments, graph_cache, record_round_trip, json_round_trip, csv_round_trip, run_log, submission_scan, metrics_documents, first_trips)}

_BOX = ", ".join([*(sql_r6(c, c) for c in ("lon1", "lat1", "lon2", "lat2")), *(sql_r6(f"{f}({c}1, {c}2)", f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", "least"), ("max", "greatest")))])
SQL = {
    "osm_edges": f"with {fx.sql_roads()} select src, dst, {sql_r6('dist_m', 'dist_m')}, {sql_r6('bearing', 'bearing')}, pen as class_penalty from edges",
    "osm_segments": f"with {fx.sql_roads()}, s as (select lon1, lat1, lon2, lat2 from segs union all select lon, lat, lon, lat from nodes where node_id = 7) select {_BOX} from s",
    "graph_cache": f"with {fx.sql_roads()}, t as (select range::int as turn from range(3)), c as (select 'nodes' as name, count(*) as count from nodes union all select 'edges', count(*) from edges union all select 'segments', count(*) + 1 from segs) select turn, name, count from t, c",
    "record_round_trip": f"with {fx.sql_points()} select traj_id, idx, n, {sql_r6('lon', 'lon')}, {sql_r6('lat', 'lat')}, true as known from pts",
    "json_round_trip": f"with {fx.sql_pairs()} select traj_id, {sql_r6('y_true', 'y_true')}, {sql_r6('case when traj_id % 50 <> 0 then y_pred end', 'y_pred')} from pr",
    "csv_round_trip": f"with {fx.sql_trips()} select traj_id, departure_ts, case when travel_time <= 600 then 'short_le_10m' when travel_time <= 1800 then 'medium_10m_30m' else 'long_gt_30m' end as bucket from tr",
    "run_log": "select i::int as run_order, 'run ' || k as milestone, (select count(*) from orders where o_orderkey % 5 = k) as count from (values (1, 3), (2, 1), (3, 2), (4, 1), (5, 0)) v(i, k)",
    "submission_scan": f"with {fx.sql_points()} select traj_id, idx, {sql_r6('lon + case when traj_id % 3 = 0 then 1 else 0 end', 'lon')}, {sql_r6('lat', 'lat')} from pts where traj_id % 2 = 0 or traj_id % 3 = 0",
    "metrics_documents": f"with {fx.sql_pairs()}, m as (select avg(abs(y_pred - y_true)) as mae from pr where y_pred is not null) select form, {sql_r6('mae', 'mae')}, {sql_r6('rmse', 'rmse')}, {sql_r6('1.5e0', 'mape')} from m, (values ('flat', 2.5e0), ('global', 2.5e0), ('val', null)) f(form, rmse)",
    "first_trips": f"with {fx.sql_trips()} select traj_id, departure_ts from tr order by departure_ts, traj_id limit 500",
}
