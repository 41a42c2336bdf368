"""Literal cases of the pinned semantics, folds against plain Python, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import buckets, geo
from wayfare.operators import features, folds, metrics, sequence as seq, study
from wayfare.sources import schemas
from wayfare.sources.work import settled

P = "traj_id long, idx long, ts long, lon double, lat double, known boolean"


def points(spark, *trajs):
    rows = []
    for t, ps in enumerate(trajs):
        for i, (ts, lon, lat) in enumerate(ps):
            rows.append((t, i, ts, lon, lat, lon is not None))
    return spark.createDataFrame(rows, P)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_geo_guards_nulls_and_wraps(spark):
    n = F.lit(None).cast("double")
    r = one(
        spark, geo.haversine_m(1.0, 2.0, n, 2.0), geo.haversine_m(0.0, 0.0, 180.0, 0.0), geo.bearing_deg(1.0, 1.0, 1.0, 1.0), geo.bearing_deg(0.0, 0.0, -1.0, 0.0),
        geo.angle_diff_deg(350.0, 10.0), geo.angle_diff_deg(10.0, 350.0), geo.planar_turn_deg(0.0, 0.0, 1.0, 0.0, 1.0, 1.0), geo.planar_turn_deg(0.0, 0.0, 0.0, 0.0, 1.0, 1.0),
        geo.point_segment_m(0.0, 1.0, -1.0, 0.0, 1.0, 0.0), geo.point_segment_m(0.0, 0.0, 1.0, 0.0, 1.0, 0.0), geo.finite(F.lit(float("nan"))))
    assert r[0] is None and r[1] == pytest.approx(math.pi * 6371000) and r[2] is None and r[3] == pytest.approx(270)
    assert r[4] == r[5] == pytest.approx(20) and r[6] == pytest.approx(90) and r[7] is None
    assert r[8] == pytest.approx(111320) and r[9] == pytest.approx(111320) and r[10] is None


def test_gap_runs_and_table(spark):
    x = (1.0, 1.0)
    p = points(spark, [(0, None, None), (1, *x), (2, None, None), (3, None, None), (9, *x), (8, None, None), (8, *x), (9, None, None)])
    assert [r.gap_size for r in seq.gap_runs(p).orderBy("idx").collect()] == [1, 0, 2, 2, 0, 1, 0, 1]
    g = seq.gap_table(p).orderBy("gap_id").collect()
    assert [(r.start_idx, r.end_idx, r.missing_count, r.delta_t, r.start_order, r.end_order) for r in g] == [(1, 4, 2, 8, 0, 1), (4, 6, 1, 0, 1, 2)]


def test_linear_edges_constant_and_empty(spark):
    p = points(spark, [(0, None, None), (1, 1.0, 5.0), (2, None, None), (3, 3.0, 7.0), (4, None, None)], [(0, None, None), (5, 2.0, 2.0), (6, None, None)], [(0, None, None), (1, None, None)])
    got = {(r.traj_id, r.idx): (r.lon, r.lat) for r in seq.interpolate_linear(p).collect()}
    assert [got[0, i] for i in range(5)] == [(1, 5), (1, 5), (2, 6), (3, 7), (3, 7)]
    assert {got[1, i] for i in range(3)} == {(2, 2)} and got[2, 0] == (None, None)


def test_pchip_is_monotone_and_keeps_knots(spark):
    ys = [0.0, 1.0, 1.0, 5.0, 4.0, 9.0]
    ps = []
    for k, y in enumerate(ys):
        ps.append((10 * k, y, -y))
        if k < len(ys) - 1:
            ps += [(10 * k + d, None, None) for d in (2, 5, 9)]
    r = seq.interpolate_pchip(points(spark, ps, [(0, 1.0, 1.0), (5, None, None), (10, 3.0, 3.0)])).orderBy("traj_id", "idx").collect()
    a, b = [x for x in r if x.traj_id == 0], [x for x in r if x.traj_id == 1]
    assert [x.lon for x in a[::4]] == ys and [x.lon for x in b] == [1, 2, 3]
    for k in range(len(ys) - 1):
        part = [x.lon for x in a[4 * k : 4 * k + 5]]
        assert all((u <= v) if ys[k] <= ys[k + 1] else (u >= v) for u, v in zip(part, part[1:]))
        assert [x.lat for x in a[4 * k : 4 * k + 5]] == pytest.approx([-u for u in part])


def turn(a, b, c):
    def bearing(p, q):
        y = math.sin(math.radians(q[0] - p[0])) * math.cos(math.radians(q[1]))
        x = math.cos(math.radians(p[1])) * math.sin(math.radians(q[1])) - math.sin(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.cos(math.radians(q[0] - p[0]))
        return None if abs(x) < 1e-12 and abs(y) < 1e-12 else math.degrees(math.atan2(y, x)) % 360

    u, v = bearing(a, b), bearing(b, c)
    return 0.0 if u is None or v is None else abs((v - u + 180) % 360 - 180)


def test_turn_limiter_sees_earlier_moves(spark):
    rng = np.random.default_rng(0)
    line = [tuple(map(float, x)) for x in rng.random((9, 2))]
    want = list(line)
    for _ in range(3):
        for i in range(1, len(want) - 1):
            if turn(want[i - 1], want[i], want[i + 1]) > 40:
                want[i] = tuple((p + q) / 2 for p, q in zip(want[i - 1], want[i + 1]))
    p = points(spark, [(k, *x) for k, x in enumerate(line)], [(0, 1.0, 1.0), (1, 2.0, 2.0)])
    got = folds.limit_turns(p, 40.0, 3).orderBy("traj_id", "idx").collect()
    assert np.allclose([(r.lon, r.lat) for r in got[:9]], want) and [(r.lon, r.lat) for r in got[9:]] == [(1.0, 1.0), (2.0, 2.0)]
    m = seq.lines_of(p).select("traj_id", seq.max_turn(F.col("line")).alias("m")).orderBy("traj_id").collect()
    assert m[0].m == pytest.approx(max(turn(*line[i : i + 3]) for i in range(7))) and m[1].m == 0
    assert folds.limit_turns(p, 179.0).exceptAll(p).isEmpty()  # such a cap moves nothing
    straight = points(spark, [(k, float(k), 0.0) for k in range(5)])
    assert folds.limit_turns(straight, -5.0).exceptAll(straight).isEmpty()  # a negative cap is zero


def test_folds_across_batches(spark):
    """Lines longer than a batch, several in one stream, nulls among them: as one plain walk over each line."""
    rng = np.random.default_rng(4)
    rows, want, kept = [], {}, {}
    for t in range(7):
        n = int(rng.integers(1, 60))
        line = [(float(k) * 0.01 + rng.random() * 0.02, float(rng.random()) * 0.02) for k in range(n)]
        for k in range(n):
            if rng.random() < 0.3 and k and line[k - 1][0] is not None:
                line[k] = (line[k - 1][0] + 3e-13 * float(rng.random() < 0.5), line[k - 1][1])
            if rng.random() < 0.04:
                line[k] = (None, None)
        rows += [(t, k, *p) for k, p in enumerate(line)]
        kept[t], last = [0], 0
        for k in range(1, n):
            near = None not in (*line[k], *line[last]) and math.hypot(line[k][0] - line[last][0], line[k][1] - line[last][1]) <= 1e-12
            if not near:
                kept[t].append(k)
                last = k
        out = list(line)
        for _ in range(2):
            for i in range(1, n - 1):
                three = out[i - 1 : i + 2]
                if not any(None in p for p in three) and turn(*three) > 30:
                    out[i] = tuple((u + v) / 2 for u, v in zip(three[0], three[2]))
        want[t] = out
    df = spark.createDataFrame(rows, "traj_id long, idx long, lon double, lat double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.traj_id, r.idx): (r.lon, r.lat) for r in folds.limit_turns(df, 30.0, 2).collect()}
        left = {}
        for r in folds.dedupe(df).collect():
            left.setdefault(r.traj_id, []).append(r.idx)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {t: sorted(v) for t, v in left.items()} == kept
    assert set(got) == {(t, k) for t, _, _, _ in [(r[0], 0, 0, 0) for r in rows] for k in range(len(want[t]))}
    for (t, k), p in got.items():
        assert p == (None, None) if None in want[t][k] else p == pytest.approx(want[t][k], abs=1e-12)
    assert folds.limit_turns(df.limit(0), 30.0).count() == folds.dedupe(df.limit(0)).count() == 0


def test_dedupe_compares_with_last_kept(spark):
    p = points(spark, [(0, 0.0, 0.0), (1, 6e-13, 0.0), (2, 1.2e-12, 0.0), (3, 1.2e-12, 0.0)])
    assert [x.lon for x in folds.dedupe(p).orderBy("idx").collect()] == [0.0, 1.2e-12]


def test_resample_beside_joins_of_its_line(spark):
    """Lines and samples that are already dealt by line, and a join by line behind: as large tables are, none is sent to the tasks."""
    keep = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for c in keep:
            spark.conf.set(c, "-1")
        v = settled(spark.range(900).select((F.col("id") % 90).alias("line_id"), F.floor(F.col("id") / 90).alias("idx"), (F.col("id") * 37 % 101 / 1000).alias("lon"), (F.col("id") * 53 % 97 / 1000).alias("lat")), "v")
        lines = settled(v.select("line_id").distinct(), "lines")
        got = seq.resample(v, seq.even_ratios(lines, 7), ("line_id",))
        j = got.join(lines.withColumn("w", F.col("line_id") * 2), ["line_id"]).join(lines.withColumn("z", F.lit(1)), ["line_id"], "left")
        assert j.count() == 90 * 7 and settled(j, "j").where("w = 2 * line_id and z = 1").count() == 90 * 7
        ends = v.where("idx = 9").join(got.where("k = 6").select("line_id", F.col("lon").alias("x"), F.col("lat").alias("y")), "line_id")
        assert ends.where("abs(lon - x) < 1e-9 and abs(lat - y) < 1e-9").count() == 90
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan  # vertices and samples meet in one deal
        assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, x in keep.items():
            spark.conf.unset(c) if x is None else spark.conf.set(c, x)


def test_resample_degenerate_lines(spark):
    v = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 2.0, 2.0), (1, 1, 2.0, 2.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 1.0), (2, 2, 0.0, 1.0), (2, 3, 0.0, 2.0)], "line_id long, idx long, lon double, lat double")
    s = spark.createDataFrame([(i, k, r) for i in range(3) for k, r in enumerate((-1.0, 0.25, 0.5, 2.0))], "line_id long, k long, ratio double")
    got = {(r.line_id, r.k): (r.lon, r.lat) for r in seq.resample(v, s).collect()}
    assert len(got) == 12 and got[0, 3] == (1, 1) and got[1, 2] == (2, 2)
    assert [got[2, k][1] for k in range(4)] == pytest.approx([0, 0.5, 1, 2])


def test_even_sample_and_smoothing(spark):
    p = points(spark, [(k, float(k), 0.0) for k in range(10)], [(0, 1.0, 1.0), (1, 5.0, 5.0)])
    got = seq.even_sample(p, 4).where("traj_id = 0").collect()
    assert sorted(r.idx for r in got) == [0, 3, 6, 9] and seq.even_sample(p, 1).count() == 2 and seq.even_sample(p, 10).count() == 12
    s = seq.smooth_gaussian(p, 1, 1.0).orderBy("traj_id", "idx").collect()
    w = math.exp(-0.5)
    assert s[0].lon == pytest.approx(w / (1 + w)) and s[5].lon == pytest.approx(5) and s[10].lon == 1.0


def test_fill_from_strokes(spark):
    g = spark.createDataFrame([(0, 0, 3, 3, 0.0, 0.0, 0.0, 4.0), (0, 1, 9, 1, 0.0, 0.0, 2.0, 0.0)], "traj_id long, gap_id long, start_idx long, missing_count long, lon0 double, lat0 double, lon1 double, lat1 double")
    s = spark.createDataFrame([(0, 1, 0, 1.0, 1.0), (0, 1, 1, float("nan"), 0.0)], "traj_id long, gap_id long, idx long, lon double, lat double")
    got = {r.idx: (r.lon, r.lat) for r in seq.fill_gaps_from_strokes(g, s).collect()}
    assert {k: v for k, v in got.items() if k < 9} == {4: pytest.approx((0, 1)), 5: pytest.approx((0, 2)), 6: pytest.approx((0, 3))} and got[10] == pytest.approx((1, 1), abs=1e-3)


def test_clock_weekend_and_drop_reasons(spark):
    day = 86400
    r = [one(spark, *[c.alias(k) for k, c in features.clock(F.lit(k * day + 3600).cast("long")).items()]) for k in range(7)]  # Thursday first
    assert [x.dow for x in r] == [4, 5, 6, 0, 1, 2, 3] and [x.weekend for x in r] == [0, 1, 1, 0, 0, 0, 0] and r[0].hour == 1
    s = [one(spark, features.clock(F.lit(k * day).cast("long"), weekend="sat_sun")["weekend"].alias("w")).w for k in range(7)]
    assert s == [0, 0, 1, 1, 0, 0, 0]
    rows = [(1, 100.0, 500.0), (3, None, 500.0), (3, 10.0, 500.0), (3, 100.0, 10.0), (3, 100.0, 1000.0), (3, float("nan"), 1.0)]
    d = spark.createDataFrame(rows, "n long, t double, p double").select(features.drop_reason(F.col("n"), F.col("t"), F.col("p")).alias("r")).collect()
    assert [x.r for x in d] == ["too_short", "invalid_label", "time_range", "speed_range", None, "invalid_label"]


def test_bucket_edges(spark):
    r = one(spark, buckets.duration_bucket(600.0), buckets.travel_time_bucket(600.0), buckets.gap_bucket(7, 8), buckets.gap_bucket(16, 16), buckets.turn_bucket(F.lit(None).cast("double")), buckets.turn_bucket(90.0), buckets.position_bucket(0.3), buckets.points_bucket(80.0), buckets.detour_bucket(1.5))
    assert list(r) == ["short_le_10m", "10-20m", "5-7", "16+", "invalid", "turn(30-90)", "middle(30-70%)", "<=80", ">=1.50"]


def test_duration_report_keeps_empty_buckets(spark):
    d = spark.createDataFrame([(700.0, 800.0)], "y_true double, y_pred double")
    got = {r.bucket: (r["count"], r.mae) for r in metrics.duration_report(d).collect()}
    assert got == {"short_le_10m": (0, None), "medium_10m_30m": (1, 100.0), "long_gt_30m": (0, None)}


def test_buckets_sum_to_the_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(float(e), int(g), float(t), float(p), int(n), float(s)) for e, g, t, p, n, s in zip(rng.random(500) * 99, rng.integers(1, 12, 500), rng.random(500) * 180, rng.random(500), rng.integers(50, 300, 500), rng.random(500))]
    f = spark.createDataFrame(rows, "error_m double, gap_size long, turn_angle double, position_ratio double, traj_length long, speed_var double")
    total = metrics.summary(f).first()
    for r in metrics.bucket_report(f, 8).groupBy("dimension").agg(F.sum("count").alias("n"), (F.sum(F.col("count") * F.col("mae")) / F.sum("count")).alias("mae"), F.sqrt(F.sum(F.col("count") * F.col("rmse") * F.col("rmse")) / F.sum("count")).alias("rmse")).collect():
        assert (r.n, r.mae, r.rmse) == (500, pytest.approx(total.mae), pytest.approx(total.rmse))


def test_stratified_pool_quotas_and_ranks(spark):
    c = spark.createDataFrame([(i, float((i * 37) % 10)) for i in range(10)], "traj_id long, score double")
    got = study.stratified_pool(c, 5, 1).collect()
    assert len({r.traj_id for r in got}) == 5 and sorted((r.rank0 >= 3) + (r.rank0 >= 6) for r in got) == [0, 0, 1, 1, 2]
    assert study.stratified_pool(c, 0).count() == 10
    assert sorted((r.rank0, r.score) for r in study.ranked(c, ["score", "traj_id"]).collect()) == [(i, float(i)) for i in range(10)]


def test_records_and_last_wins(spark):
    d = spark.createDataFrame([(1, [10, 20], [(1.0, 2.0), (float("nan"), 3.0)], [True, False])], schemas.MASKED)
    p = schemas.points_of(d).orderBy("idx").collect()
    assert [(r.ts, r.lon, r.known) for r in p] == [(10, 1.0, True), (20, None, False)]
    w = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "traj_id long, ord long, v string")
    assert [r.v for r in schemas.last_wins(w).collect()] == ["b"] and [r.v for r in study.ordered_unique(w).collect()] == ["a"]
    m = spark.createDataFrame([((1.0, 2.0),)], "global struct<mae:double,rmse:double>")
    assert tuple(schemas.reference_metrics(m).first()) == (1.0, 2.0, None)


def test_log_and_json(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    row = spark.createDataFrame([("a", 1.0)], "milestone string, mae double")
    schemas.append_log(spark, path, row, "2024-01-01")
    assert [r.run_order for r in schemas.append_log(spark, path, row, "2024-01-02").collect()] == [1, 2]
    schemas.write_json(spark.createDataFrame([(float("nan"),)], "x double"), f"file://{tmp_path}/j")
    assert "NaN" not in "".join(r.value for r in spark.read.text(f"file://{tmp_path}/j").collect())


def test_fills_are_running_both_ways(spark):
    """No frame reaches from a row to the end of its trajectory, which would cost the square of its length."""
    p = spark.createDataFrame([(0, 0, 5, None, None, False), (0, 1, 10, 1.0, 2.0, True), (0, 2, 15, None, None, False), (0, 3, 30, 3.0, None, True), (0, 4, 50, 9.0, 6.0, True), (0, 5, 60, None, None, False)], P)
    got = seq.interpolate_linear(p)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "unboundedfollowing" not in plan.lower()
    assert [r.lon for r in got.orderBy("idx").collect()] == [1.0, 1.0, 1.0 + 2.0 * 0.25, 3.0, 9.0, 9.0]
    assert [r.lat for r in got.orderBy("idx").collect()] == [2.0, 2.0, 2.0 + 4.0 * 0.25, None, 6.0, 6.0]
