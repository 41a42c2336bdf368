"""Steps that decide how queries over events and lineitem grow: sizes of generated methods, shuffles."""

import math
import re

import pytest

from pyspark.sql import functions as F

from wayfare.functions.geo import point_segment_m
from wayfare.operators import metrics, sequence as seq, spatial
from wayfare.plans import fixtures as fx, recovery_queries, trip_queries

SF = "/root/testdata/sf0.001"
#: HotSpot does not compile a longer method, it interprets it.
LONGEST = 8000


@pytest.fixture
def fixed_plans(spark):
    """Plans as on large tables: no table is small enough to be sent to the tasks."""
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in fixed.items():
        spark.conf.set(k, v)
    yield spark
    for k in fixed:
        spark.conf.unset(k)


def _plan(df):
    return df._jdf.queryExecution().executedPlan()


def _longest_method(df):
    text = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(_plan(df))
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text)))


def test_trip_features_compile_and_lines_are_dealt_once(fixed_plans):
    df = trip_queries.trip_features(fixed_plans, SF)
    assert _longest_method(df) < LONGEST
    assert len(re.findall("Exchange hashpartitioning", _plan(trip_queries.features.seq.steps(trip_queries.fx.trips(fixed_plans, SF)[0])).toString())) == 1


def test_map_features_compile(fixed_plans):
    assert _longest_method(recovery_queries.map_case_features(fixed_plans, SF)) < LONGEST


def test_even_sample_by_arithmetic(spark):
    rows = [(n, idx) for n in (1, 2, 3, 13, 14, 15, 27, 40, 97) for idx in range(-1, n + 2)]
    df = spark.createDataFrame(rows, "n long, idx long")
    for most in (1, 2, 10, 14):
        got = {(r.n, r.idx) for r in df.where(seq.in_even_sample(F.col("idx"), F.col("n"), most)).collect()}
        want = {(n, i) for n, i in rows if (i == 0 if most == 1 else n <= most or i in {k * (n - 1) // (most - 1) for k in range(most)})}
        assert got == want


@pytest.mark.parametrize("small", [20_000, 3])
def test_distances_column_by_column(spark, monkeypatch, small):
    monkeypatch.setattr(spatial, "SMALL", small)
    points = spark.createDataFrame([(1, i, 108.9 + 0.0007 * i, 34.2 + 0.0004 * i) for i in range(30)], "traj_id long, idx long, lon double, lat double")
    legs = [(f"s{i}", 108.9 + 0.001 * (i % 7), 34.2 + 0.0013 * (i % 5), 108.9 + 0.001 * (i % 7) + 0.002 * (i % 3), 34.2 + 0.0013 * (i % 5) + 0.0011) for i in range(60)] + [("far", 100.0, 34.2, 100.1, 34.2)]
    segments = spark.createDataFrame(legs, "seg_id string, lon1 double, lat1 double, lon2 double, lat2 double")
    low, high = lambda c: F.least(f"{c}1", f"{c}2"), lambda c: F.greatest(f"{c}1", f"{c}2")
    segments = segments.withColumns({"min_lon": low("lon"), "max_lon": high("lon"), "min_lat": low("lat"), "max_lat": high("lat")})
    plain = points.crossJoin(segments).select("idx", "seg_id", point_segment_m("lon", "lat", "lon1", "lat1", "lon2", "lat2").alias("d")).where("d <= 300").collect()
    got = spatial.near_segments(points, segments, 300.0).where("dist_m <= 300").select("idx", "seg_id", F.col("dist_m").alias("d")).collect()
    assert plain and sorted(map(tuple, got)) == sorted(map(tuple, plain))


def test_facts_are_dealt_once(fixed_plans):
    t = fx.truth(fixed_plans, SF, 16)
    got = metrics.facts_in_place(t)
    assert _plan(got).toString().count("Exchange hashpartitioning") == 1
    m = fx.masked(t)
    want = metrics.point_facts(m, seq.interpolate_linear(m), t)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


@pytest.mark.parametrize("small", [20_000, 3])
def test_map_features_of_whole_trajectories(fixed_plans, monkeypatch, small):
    """Features equal a plain count over all pairs, for trajectories that lie in several Arrow batches, points without place and points
    far from any road; a map that is sent to the tasks leaves the points where they are."""
    spark = fixed_plans
    monkeypatch.setattr(spatial, "SMALL", small)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sizes = {1: 1, 2: 2, 3: 9, 4: 30, 5: 3}
        points = [(t, i, *((None, None) if (t, i) == (3, 4) else (100.0, 10.0) if t == 5 else (108.9 + 0.0007 * i + 0.001 * t, 34.2 + 0.0004 * i * (t % 3)))) for t, n in sizes.items() for i in range(n)]
        p = spark.createDataFrame(points, "traj_id long, idx long, lon double, lat double").repartition(3)
        legs = [(f"s{i}", 108.9 + 0.001 * (i % 7), 34.2 + 0.0013 * (i % 5), 108.9 + 0.001 * (i % 7) + 0.002 * (i % 3), 34.2 + 0.0013 * (i % 5) + 0.0011) for i in range(40)]
        segments = spark.createDataFrame([(*x, min(x[1], x[3]), min(x[2], x[4]), max(x[1], x[3]), max(x[2], x[4])) for x in legs], "seg_id string, lon1 double, lat1 double, lon2 double, lat2 double, min_lon double, min_lat double, max_lon double, max_lat double")
        cases = [spatial.MapCase(80.0, 5, (15.0, 35.0)), spatial.MapCase(160.0, 40, (50.0, 20.0))]
        df = spatial.map_feature_table(p, segments, cases)
        if small > 3:
            assert _plan(df).toString().count("Exchange hashpartitioning") == 1
        got = {r.traj_id: r.asDict() for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    both = p.where("lon is not null").crossJoin(segments).select("traj_id", "idx", "lon", "lat", "min_lon", "max_lon", "min_lat", "max_lat", point_segment_m("lon", "lat", "lon1", "lat1", "lon2", "lat2").alias("d")).collect()
    assert set(got) == set(sizes)
    for t, n in sizes.items():
        for k, c in enumerate(cases):
            near = []
            for i in range(n) if n <= c.points else sorted({j * (n - 1) // (c.points - 1) for j in range(c.points)}):
                dx, dy = (lambda lat: c.radius / (111_320.0 * max(0.2, math.cos(math.radians(lat)))))(next((x[3] for x in points if x[:2] == (t, i) and x[3] is not None), 0.0)), c.radius / 111_320.0
                d = [r.d for r in both if (r.traj_id, r.idx) == (t, i) and r.max_lon >= r.lon - dx and r.min_lon <= r.lon + dx and r.max_lat >= r.lat - dy and r.min_lat <= r.lat + dy]
                near.append((min(d, default=None), sum(x <= c.radius for x in d)))
            far = [2 * c.radius if d is None else d for d, _ in near]
            want = {"road_mean": sum(far) / len(far), "road_max": max(far), "near_1": sum(x <= min(c.near) for x in far) / len(far), "density_mean": sum(m for _, m in near) / len(near), "no_road": sum(d is None for d, _ in near) / len(near)}
            assert {f: got[t][f"case{k}_{f}"] for f in want} == pytest.approx(want)
