"""Road network from an OpenStreetMap XML file: nodes, directed edges, undirected segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_m
from . import versions
from .work import settled

# Road classes that vehicles may use, and the cost factor of each.
CLASS_PENALTY = {
    "motorway": 1.00, "motorway_link": 1.04, "trunk": 1.02, "trunk_link": 1.06, "primary": 1.08,
    "primary_link": 1.12, "secondary": 1.15, "secondary_link": 1.20, "tertiary": 1.24, "tertiary_link": 1.28,
    "unclassified": 1.35, "residential": 1.42, "living_street": 1.52, "service": 1.65, "road": 1.32,
}
OTHER_PENALTY = 1.40

NODE = "_id long, _lat double, _lon double"
WAY = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"


def drivable(highway) -> Column:
    return F.coalesce(F.lower(F.trim(highway)).isin(*CLASS_PENALTY), F.lit(False))


def class_penalty(highway) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CLASS_PENALTY.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(highway))], F.lit(OTHER_PENALTY))


def oneway(value) -> Column:
    """1 forward, -1 backward, 0 both ways."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("yes", "true", "1"), 1).when(v.isin("-1", "reverse"), -1).otherwise(0)


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(node_id, lon, lat), ways(way_id, refs, highway, oneway)); of repeated tags the last counts.

    The reader that looks for elements is used, not the one that walks a whole document: it splits a large file over
    tasks, and elements may lie in several files."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).option("useLegacyXMLParser", True).schema(schema).load(path)
    nodes = xml("node", NODE).select(F.col("_id").alias("node_id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    ways = xml("way", WAY).select(
        F.col("_id").alias("way_id"), F.transform("nd", lambda n: n["_ref"]).alias("refs"),
        F.try_element_at(F.filter(F.reverse("tag"), lambda t: t["_k"] == "highway"), F.lit(1))["_v"].alias("highway"),
        F.try_element_at(F.filter(F.reverse("tag"), lambda t: t["_k"] == "oneway"), F.lit(1))["_v"].alias("oneway"),
    )
    return nodes, ways


def _legs(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Consecutive node pairs of drivable ways with both ends known; the array is walked in its row."""
    used = ways.where(drivable("highway") & (F.size("refs") >= 2))
    pairs = F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(F.get("refs", i).alias("a"), F.get("refs", i + 1).alias("b")))
    legs = used.select("way_id", "highway", oneway("oneway").alias("dir"), F.posexplode(pairs).alias("pos", "p")).select("way_id", "pos", "highway", "dir", "p.a", "p.b")
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.col("lon").alias(f"lon_{end}"), F.col("lat").alias(f"lat_{end}"))
    return legs.join(at("a"), "a").join(at("b"), "b")


def road_segments(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Undirected segments with bounding boxes; those of zero length stay."""
    s = _legs(nodes, ways)
    return s.select(
        F.concat_ws(":", "way_id", "pos").alias("seg_id"), F.col("lon_a").alias("lon1"), F.col("lat_a").alias("lat1"), F.col("lon_b").alias("lon2"), F.col("lat_b").alias("lat2"),
    ).transform(with_bbox)


def with_bbox(segments: DataFrame) -> DataFrame:
    return segments.select(
        "*", F.least("lon1", "lon2").alias("min_lon"), F.greatest("lon1", "lon2").alias("max_lon"),
        F.least("lat1", "lat2").alias("min_lat"), F.greatest("lat1", "lat2").alias("max_lat"),
    )


def road_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Directed edges(src, dst, dist_m, bearing, class_penalty): no zero lengths, one-way obeyed."""
    e = _legs(nodes, ways)
    e = e.select("*", haversine_m("lon_a", "lat_a", "lon_b", "lat_b").alias("dist_m")).where("dist_m > 0")
    run = lambda a, b, f: F.when(f, F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), bearing_deg(f"lon_{a}", f"lat_{a}", f"lon_{b}", f"lat_{b}").alias("bearing")))
    both = F.filter(F.array(run("a", "b", F.col("dir") >= 0), run("b", "a", F.col("dir") <= 0)), lambda x: x.isNotNull())
    return e.select(F.explode(both).alias("e"), "dist_m", class_penalty("highway").alias("class_penalty")).select("e.src", "e.dst", "dist_m", "e.bearing", "class_penalty")


def graph_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that some edge uses, with the bearings that lead out of them."""
    used = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.collect_list("bearing").alias("out_bearings"))
    return nodes.join(used, "node_id", "left_semi").join(out, "node_id", "left").withColumn("out_bearings", F.coalesce("out_bearings", F.array().cast("array<double>")))


def load_or_build(spark: SparkSession, path: str, cache: str, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, segments), kept in committed versions of a layout; a new version is built by force or for another layout.
    The file is read once for nodes and once for ways, as reading elements costs more than all that follows."""
    def build() -> dict[str, DataFrame]:
        raw, ways = (settled(t, name) for t, name in zip(read_osm(spark, path), ("raw-nodes", "raw-ways")))
        edges = settled(road_edges(raw, ways), "raw-edges")
        return {"nodes": graph_nodes(raw, edges), "edges": edges, "segments": road_segments(raw, ways)}

    got = versions.kept(spark, cache, "3", build, force)
    return got["nodes"], got["edges"], got["segments"]
