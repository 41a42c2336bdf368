"""Gap, recovery, error and study queries over the event trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets
from ..functions.geo import bearing_deg, haversine_m
from ..operators import folds, metrics, sequence as seq, spatial, study, travel_time
from . import fixtures as fx
from .fixtures import r6, sql_angle, sql_bearing, sql_hav, sql_r6


def _facts(spark: SparkSession, sf_dir: str, keep: int = 8) -> DataFrame:
    return metrics.facts_in_place(fx.truth(spark, sf_dir, keep))


def recover_linear_by_gap(spark, sf_dir):
    f = metrics.summary(_facts(spark, sf_dir).select("error_m", buckets.gap_bucket("gap_size", 8).alias("bucket")), "bucket")
    return f.select("bucket", "count", *r6("mae", "rmse", "p75", "p95"))


def haversine_steps(spark, sf_dir):
    return seq.steps(fx.truth(spark, sf_dir)).select("traj_id", "idx", *r6("step_m"))


def bearings(spark, sf_dir):
    return seq.steps(fx.truth(spark, sf_dir)).select("traj_id", "idx", *r6("bearing", "turn_deg"))


def turn_planar(spark, sf_dir):
    return seq.planar_turns(fx.truth(spark, sf_dir)).select("traj_id", "idx", *[(F.round("turn_angle", 4) + 0.0).alias("turn_angle")])


def speed_change(spark, sf_dir):
    return seq.speed_change(fx.truth(spark, sf_dir)).select("traj_id", "idx", *r6("speed_var"))


def gap_runs(spark, sf_dir):
    return seq.gap_runs(fx.truth(spark, sf_dir)).select("traj_id", "idx", "gap_size")


def gap_table(spark, sf_dir):
    return seq.gap_table(fx.truth(spark, sf_dir))


def recover_linear(spark, sf_dir):
    return seq.interpolate_linear(fx.masked(fx.truth(spark, sf_dir))).select("traj_id", "idx", *r6("lon", "lat"))


def recover_pchip(spark, sf_dir):
    return seq.interpolate_pchip(fx.masked(fx.truth(spark, sf_dir, 16))).select("traj_id", "idx", *r6("lon", "lat"))


def smooth_gauss(spark, sf_dir):
    return seq.smooth_gaussian(fx.truth(spark, sf_dir), 2, 1.0).select("traj_id", "idx", *r6("lon", "lat"))


def anchor_headings(spark, sf_dir):
    return seq.anchor_headings(fx.truth(spark, sf_dir)).select("traj_id", "idx", *r6("heading"))


def resample_uniform(spark, sf_dir):
    v = fx.truth(spark, sf_dir).select("traj_id", "idx", "lon", "lat")
    return seq.resample(v, seq.even_ratios(v.select("traj_id").distinct(), 20, ("traj_id",)), ("traj_id",)).select("traj_id", "k", *r6("lon", "lat"))


def resample_speed_aware(spark, sf_dir):
    v = fx.truth(spark, sf_dir).select("traj_id", "idx", "lon", "lat")
    return seq.resample(v, seq.even_ratios(v.select("traj_id").distinct(), 20, ("traj_id",)), ("traj_id",), 30.0, 0.6).select("traj_id", "k", *r6("lon", "lat"))


def even_sample(spark, sf_dir):
    return seq.even_sample(fx.truth(spark, sf_dir), 14).select("traj_id", "idx")


def limit_turns(spark, sf_dir):
    return folds.limit_turns(fx.truth(spark, sf_dir).select("traj_id", "idx", "lon", "lat"), 45.0, 2).select("traj_id", "idx", *r6("lon", "lat"))


def max_turns(spark, sf_dir):
    return seq.lines_of(fx.truth(spark, sf_dir)).select("traj_id", F.round(seq.max_turn(F.col("line")), 5).alias("max_turn"))


def point_errors(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    m = fx.masked(t)
    return metrics.recovery_errors(m, seq.interpolate_linear(m), t).select("traj_id", "idx", *r6("error_m"))


def point_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("traj_id", "idx", "gap_size", "traj_length", *r6("error_m", "position_ratio", "speed_var"), F.round("turn_angle", 4).alias("turn_angle"))


def global_metrics(spark, sf_dir):
    return metrics.summary(_facts(spark, sf_dir)).select("count", *r6("mae", "rmse", "p75", "p95"))


def trajectory_mae(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    return metrics.trajectory_mae(t, _facts(spark, sf_dir)).select("traj_id", *r6("mae"))


def bucket_report(spark, sf_dir):
    return metrics.bucket_report(_facts(spark, sf_dir), 8).select("dataset", "dimension", "bucket", "count", *r6("mae", "rmse", "p75", "p95"))


def bucket_report_16(spark, sf_dir):
    return metrics.bucket_report(_facts(spark, sf_dir, 16), 16).select("dataset", "dimension", "bucket", "count", *r6("mae", "rmse", "p75", "p95"))


def decision_triggers(spark, sf_dir):
    return metrics.triggers(metrics.bucket_report(_facts(spark, sf_dir), 8), 8).select(*r6("sharp", "straight", "short_gap", "long_gap"), "curve_trigger", "gap_trigger")


def error_histogram(spark, sf_dir):
    return metrics.histogram(_facts(spark, sf_dir), "error_m", 2.0, 0.99)


def trajectory_bounds(spark, sf_dir):
    return metrics.bounds(fx.truth(spark, sf_dir)).select("traj_id", *r6("min_lon", "max_lon", "min_lat", "max_lat"))


def representative_pick(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    mae = metrics.trajectory_mae(t, _facts(spark, sf_dir)).select("traj_id", F.round("mae", 6).alias("mae"))
    return study.representative(mae).select("traj_id", "mae", F.col("pick").cast("long"))


def stratified_pool(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    mae = metrics.trajectory_mae(t, _facts(spark, sf_dir)).select("traj_id", F.round("mae", 6).alias("score"))
    return study.stratified_pool(mae, 20, 7)


def _methods(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    m = fx.masked(t)
    lin = seq.interpolate_linear(m)
    return m, t, {"linear": lin, "shift": lin.withColumn("lon", F.when(F.col("idx") % 3 != 1, F.col("lon") + 0.0001))}


_CASE = [f"{x}_{m}" for m in ("linear", "shift") for x in ("mae", "rmse")]


def gap_metrics(spark, sf_dir):
    return study.gap_metrics(*_methods(spark, sf_dir)).select("traj_id", "gap_id", "missing_count", "n_linear", "n_shift", *r6(*_CASE))


def case_metrics(spark, sf_dir):
    return study.case_metrics(*_methods(spark, sf_dir)).select("traj_id", "missing_count", "n_linear", "n_shift", *r6(*_CASE))


def study_summary(spark, sf_dir):
    s = study.study_summary(study.case_metrics(*_methods(spark, sf_dir)), "shift", ["linear"])
    return s.select("cases", "missing", *r6(*[c for c in s.columns if c not in ("cases", "missing")]))


def completion(spark, sf_dir):
    m, _, x = _methods(spark, sf_dir)
    return seq.completion(x["shift"])


def polyline_errors(spark, sf_dir):
    m, t, x = _methods(spark, sf_dir)
    return study.polyline_errors(t.where(~F.col("known")).select("traj_id", "idx", "lon", "lat"), x["linear"].select("traj_id", "idx", "lon", "lat")).select("traj_id", "idx", *r6("error_m"))


def resampled_errors(spark, sf_dir):
    m, t, x = _methods(spark, sf_dir)
    return study.resampled_errors(m, x["linear"], t).select("traj_id", "idx", *r6("error_m"))


def nearest_road(spark, sf_dir):
    return spatial.nearest_road(fx.truth(spark, sf_dir), fx.lattice(spark)[2], 60.0).select("traj_id", "idx", *r6("road_m"))


def nearest_node(spark, sf_dir):
    return spatial.nearest_node(fx.truth(spark, sf_dir), fx.lattice(spark)[0], 220.0).select("traj_id", "idx", "node_id", *r6("snap_m"))


def snap_points(spark, sf_dir):
    return spatial.snap(fx.truth(spark, sf_dir), fx.lattice(spark)[0], 150.0).select("traj_id", "idx", *r6("lon", "lat"))


def knn_nodes(spark, sf_dir):
    a = seq.anchor_headings(fx.truth(spark, sf_dir))
    return spatial.candidates(a, fx.lattice(spark)[0], 500.0, 4, 55.0, 0.7, 800.0).select("traj_id", "idx", F.col("rank").cast("long"), "node_id", *r6("snap_m", "heading_diff", "emit"))


def topology_rate(spark, sf_dir):
    t = fx.truth(spark, sf_dir)
    p = seq.interpolate_linear(fx.masked(t)).where(~F.col("known"))
    return spatial.topology_violation(p, fx.lattice(spark)[2]).select("eval_points", "violations", *r6("violation_rate", "road_mean_m", "road_p95_m"))


def distributions(spark, sf_dir):
    """Histograms of trajectory lengths, time steps and gap sizes for both maskings."""
    out = None
    for keep in (8, 16):
        t = fx.truth(spark, sf_dir, keep).withColumn("dataset", F.lit(f"1/{keep}"))
        step = t.withColumn("step", F.col("ts") - F.lag("ts").over(seq.in_order())).where("step is not null")
        gap = seq.gap_runs(t).where(~F.col("known"))
        for kind, values, column, low, high, width in (("length", t.groupBy("dataset", "traj_id").agg(F.count("*").alias("length")), "length", 50, 245, 5), ("interval", step, "step", 0, 60, 1), ("gap", gap, "gap_size", 0.5, 16.5, 1)):
            h = metrics.binned(values, column, low, high, width, "dataset").select(F.lit(kind).alias("kind"), "dataset", F.col("bin").cast("double").alias("bin"), "count")
            out = h if out is None else out.unionByName(h)
    return out


def map_case_features(spark, sf_dir):
    """Map features of all cases of the sweep, from one join."""
    used = {k: c for k, c in travel_time.CASES.items() if c is not None}
    return spatial.map_feature_cases(fx.truth(spark, sf_dir), fx.roads(spark, sf_dir)[2], used).select("case", "traj_id", *r6(*spatial.MAP_FEATURES))


def map_features(spark, sf_dir):
    return spatial.map_features(fx.truth(spark, sf_dir), fx.lattice(spark)[2], 300.0, 14, (50.0, 20.0)).select("traj_id", *r6(*spatial.MAP_FEATURES))


QUERIES = {f.__name__: f for f in (
    recover_linear_by_gap, haversine_steps, bearings, turn_planar, speed_change, gap_runs, gap_table, recover_linear, recover_pchip, smooth_gauss, anchor_headings, resample_uniform,
    resample_speed_aware, even_sample, limit_turns, max_turns, point_errors, point_facts, global_metrics, trajectory_mae, bucket_report, bucket_report_16, decision_triggers, error_histogram,
    trajectory_bounds, representative_pick, stratified_pool, gap_metrics, case_metrics, study_summary, completion, polyline_errors, resampled_errors, nearest_road, nearest_node, snap_points, knn_nodes, distributions, map_case_features,
    topology_rate, map_features)}

# SQL

_W = "(partition by traj_id order by idx)"
_LAG, _LEAD = (lambda c, k=1: f"lag({c}, {k}) over {_W}"), (lambda c, k=1: f"lead({c}, {k}) over {_W}")


def _steps_sql() -> str:
    return f"st as (select *, lag(lon) over {_W} as plon, lag(lat) over {_W} as plat, lead(lon) over {_W} as nlon, lead(lat) over {_W} as nlat, lag(ts) over {_W} as pts_, lead(ts) over {_W} as nts from pts)"


def _facts_sql(keep: int = 8) -> str:
    planar = "(case when plon is not null and nlon is not null and sqrt(pow(lon-plon,2)+pow(lat-plat,2)) >= 1e-12 and sqrt(pow(nlon-lon,2)+pow(nlat-lat,2)) >= 1e-12 then degrees(acos(greatest(-1e0, least(1e0, ((lon-plon)*(nlon-lon)+(lat-plat)*(nlat-lat)) / (sqrt(pow(lon-plon,2)+pow(lat-plat,2)) * sqrt(pow(nlon-lon,2)+pow(nlat-lat,2))))))) end)"
    speed = f"(case when plon is not null and nlon is not null then abs({sql_hav('lon', 'lat', 'nlon', 'nlat')} / greatest(1, nts - ts) - {sql_hav('plon', 'plat', 'lon', 'lat')} / greatest(1, ts - pts_)) end)"
    return f"""{fx.sql_points(keep)}, {fx.sql_linear()}, {_steps_sql()},
gr as (select traj_id, idx, case when known then 0 else sum(case when known then 0 else 1 end) over (partition by traj_id, k) end::bigint as gap_size from
  (select *, sum(case when known then 1 else 0 end) over (partition by traj_id order by idx) as k from pts)),
facts as (select l.traj_id, l.idx, {sql_hav('l.lon', 'l.lat', 'l.tlon', 'l.tlat')} as error_m, gap_size, turn_angle, position_ratio, traj_length, speed_var from lin l join gr using (traj_id, idx)
  join (select traj_id, idx, {planar} as turn_angle, {speed} as speed_var, idx / greatest(1, n - 1)::double as position_ratio, n as traj_length from st) s using (traj_id, idx) where not l.known)"""


_AGG = ", ".join([f"count(error_m) as count, {sql_r6('avg(abs(error_m))', 'mae')}, {sql_r6('sqrt(avg(error_m * error_m))', 'rmse')}, {sql_r6('quantile_cont(error_m, 0.75)', 'p75')}, {sql_r6('quantile_cont(error_m, 0.95)', 'p95')}"])


def _ladder(v: str, steps, rest: str, op: str = "<=") -> str:
    return "case " + " ".join(f"when {v} {op} {e} then '{n}'" for e, n in steps) + f" else '{rest}' end"


def _report_sql(keep: int) -> str:
    gaps = buckets.GAPS_8 if keep == 8 else buckets.GAPS_16
    return f"""with {_facts_sql(keep)},
ed as (select case when n < 100 or (q1 - q0 < 1e-9 and hi - lo < 1e-9) then 1 when q1 - q0 < 1e-9 then lo else q0 end as a, case when n < 100 or (q1 - q0 < 1e-9 and hi - lo < 1e-9) then 3 when q1 - q0 < 1e-9 then hi else q1 end as b
  from (select count(speed_var) as n, quantile_cont(speed_var, 0.33) as q0, quantile_cont(speed_var, 0.66) as q1, min(speed_var) as lo, max(speed_var) as hi from facts)),
d as (select error_m, 'gap_size' as dimension, {_ladder('gap_size', *gaps)} as bucket from facts
  union all select error_m, 'turn_angle', case when turn_angle is null then 'invalid' when turn_angle < 30 then 'straight(<30)' when turn_angle <= 90 then 'turn(30-90)' else 'sharp(>90)' end from facts
  union all select error_m, 'position', {_ladder('position_ratio', *buckets.POSITIONS, op='<')} from facts
  union all select error_m, 'traj_length', {_ladder('traj_length', *buckets.LENGTHS)} from facts
  union all select error_m, 'speed_var', case when speed_var is null then 'invalid' when speed_var <= a then 'low' when speed_var <= b then 'mid' else 'high' end from facts, ed)"""


def _resample_sql(speed: bool) -> str:
    turn = f"coalesce({sql_angle('b', f'lag(b) over {_W}')}, 0)"
    over = "greatest(0e0, least(1e0, (greatest(t, coalesce(lead(t) over (partition by traj_id order by idx), 0)) - 30) / 150e0))"
    d = f"d / (1 - {over} * 0.4e0)" if speed else "d"
    return f"""with {fx.sql_points()},
a as (select traj_id, idx, lon, lat, lead(lon) over {_W} as lon2, lead(lat) over {_W} as lat2 from pts),
b as (select *, {sql_hav('lon', 'lat', 'lon2', 'lat2')} as d, case when lon2 is not null then {sql_bearing('lon', 'lat', 'lon2', 'lat2')} end as b from a),
c as (select *, {turn} as t from b),
e as (select *, {d} as dd from c),
f as (select *, coalesce(sum(dd) over (partition by traj_id order by idx rows between unbounded preceding and 1 preceding), 0) as s from e),
tot as (select traj_id, max(s) as total from f group by 1),
q as (select traj_id, r.range as k, total, r.range / 19e0 * total as s from tot, range(20) r),
m as (select q.traj_id, k, q.s, total, max(f.idx) as idx from q join f on f.traj_id = q.traj_id and f.s <= q.s and f.lon2 is not null group by all)
select m.traj_id, k::bigint as k, {sql_r6('lon + (lon2 - lon) * coalesce(least(1e0, (m.s - f.s) / nullif(dd, 0)), 0)', 'lon')}, {sql_r6('lat + (lat2 - lat) * coalesce(least(1e0, (m.s - f.s) / nullif(dd, 0)), 0)', 'lat')}
from m join f on f.traj_id = m.traj_id and f.idx = m.idx"""


def _gauss() -> dict[str, str]:
    import math

    ws = {k: math.exp(-0.5 * k * k) for k in range(-2, 3)}
    shift = lambda c, k: f"lag({c}, {k}) over {_W}" if k > 0 else f"lead({c}, {-k}) over {_W}" if k < 0 else c
    top = lambda c: " + ".join(f"coalesce({shift(c, k)} * {w!r}, 0)" for k, w in ws.items())
    bottom = lambda c: " + ".join(f"case when {shift(c, k)} is not null then {w!r} else 0 end" for k, w in ws.items())
    return {c: f"case when n < 3 then {c} else ({top(c)}) / ({bottom(c)}) end" for c in ("lon", "lat")}


def _pchip_sql() -> str:
    knots = f"kn as (select traj_id, idx, ts, lon, lat, (lead(ts) over {_W} - ts)::double as h, count(*) over (partition by traj_id) as nk from pts where known)"
    d = ", ".join(f"(lead({c}) over {_W} - {c}) / nullif(h, 0) as d_{c}" for c in ("lon", "lat"))
    lag = lambda c, k=1: f"lag({c}, {k}) over {_W}"
    lead = lambda c: f"lead({c}) over {_W}"

    def end(h0, h1, d0, d1):
        m = f"((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1})"
        return f"case when sign({m}) <> sign({d0}) then 0 when sign({d0}) <> sign({d1}) and abs({m}) > abs(3 * {d0}) then 3 * {d0} else {m} end"

    slope = lambda c: (
        f"case when h0 is null then {end('h', 'h_1', f'd_{c}', f'd1_{c}')} when h is null then {end('h0', 'h00', f'd0_{c}', f'd00_{c}')}"
        f" when d_{c} * d0_{c} <= 0 then 0 else (3 * h + 3 * h0) / ((2 * h + h0) / d0_{c} + (h + 2 * h0) / d_{c}) end as m_{c}")
    near = ", ".join([f"{lag('h')} as h0, {lag('h', 2)} as h00, {lead('h')} as h_1", *[f"{lag(f'd_{c}')} as d0_{c}, {lag(f'd_{c}', 2)} as d00_{c}, {lead(f'd_{c}')} as d1_{c}" for c in ("lon", "lat")]])
    herm = lambda c: (
        f"case when l.known or not ok then l.{c} else (2*t*t*t - 3*t*t + 1) * a.{c} + (t*t*t - 2*t*t + t) * hi * a.m_{c} + (-2*t*t*t + 3*t*t) * b.{c} + (t*t*t - t*t) * hi * b.m_{c} end")
    return f"""with {fx.sql_points(16)}, {fx.sql_linear()}, {knots}, kd as (select *, {d} from kn), kk as (select *, {near} from kd),
ks as (select *, {slope('lon')}, {slope('lat')} from kk where nk >= 3),
kok as (select traj_id, min(h) > 0 as ok from kn where nk >= 3 group by 1),
w as (select l.*, last_value(case when known then idx end ignore nulls) over (partition by traj_id order by idx rows between unbounded preceding and current row) as i0,
  first_value(case when known then idx end ignore nulls) over (partition by traj_id order by idx rows between current row and unbounded following) as i1 from lin l),
j as (select l.traj_id, l.idx, l.known, l.lon, l.lat, coalesce(ok, false) and b.ts > a.ts as ok, a.lon as alon, b.ts - a.ts as hi, (l.ts - a.ts) / nullif(b.ts - a.ts, 0)::double as t, i0, i1 from w l left join ks a on a.traj_id = l.traj_id and a.idx = i0 left join ks b on b.traj_id = l.traj_id and b.idx = i1 left join kok on kok.traj_id = l.traj_id)
select l.traj_id, l.idx, {sql_r6(herm('lon'), 'lon')}, {sql_r6(herm('lat'), 'lat')} from j l left join ks a on a.traj_id = l.traj_id and a.idx = i0 left join ks b on b.traj_id = l.traj_id and b.idx = i1"""


_GAPS = f"""gt as (select traj_id, row_number() over (partition by traj_id order by idx) - 1 as gap_id, idx as start_idx, e as end_idx, e - idx - 1 as missing_count, greatest(0, ts2 - ts) as delta_t, o as start_order, o + 1 as end_order
  from (select traj_id, idx, ts, lead(idx) over {_W} as e, lead(ts) over {_W} as ts2, row_number() over {_W} - 1 as o from pts where known) where e - idx > 1)"""
_METHODS = f"""mt as (select l.traj_id, l.idx, {sql_hav('lon', 'lat', 'tlon', 'tlat')} as e_linear, case when idx % 3 <> 1 then {sql_hav('lon + 0.0001e0', 'lat', 'tlon', 'tlat')} end as e_shift from lin l where not known)"""
_CASE_SQL = ", ".join(f"count(e_{m}) as n_{m}, {sql_r6(f'avg(e_{m})', f'mae_{m}')}, {sql_r6(f'sqrt(avg(e_{m} * e_{m}))', f'rmse_{m}')}" for m in ("linear", "shift"))


def _point_segment(lon: str, lat: str) -> str:
    kx = f"(111320e0 * greatest(0.2e0, cos(radians({lat}))))"
    ax, ay, dx, dy = f"((s.lon1 - {lon}) * {kx})", f"((s.lat1 - {lat}) * 111320e0)", f"((s.lon2 - s.lon1) * {kx})", "((s.lat2 - s.lat1) * 111320e0)"
    n = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(case when {n} > 1e-12 then greatest(0e0, least(1e0, -({ax} * {dx} + {ay} * {dy}) / {n})) else 0 end)"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


def _touch(r: float) -> str:
    x = f"({r} / (111320e0 * greatest(0.2e0, cos(radians(p.lat)))))"
    y = f"({r} / 111320e0)"
    return f"greatest(s.lon1, s.lon2) >= p.lon - {x} and least(s.lon1, s.lon2) <= p.lon + {x} and greatest(s.lat1, s.lat2) >= p.lat - {y} and least(s.lat1, s.lat2) <= p.lat + {y}"


_KNN = lambda r, src: f"""select traj_id, idx, node_id, d, hd, d / 55e0 + 0.7e0 * hd / 180e0 as emit from (select p.traj_id, p.idx, n.node_id, {sql_hav('p.lon', 'p.lat', 'n.lon', 'n.lat')} as d,
  case when p.heading is null then 0 else coalesce((select min({sql_angle('p.heading', 'e.bearing')}) from edges e where e.src = n.node_id), 180) end as hd from {src} p join nodes n on abs(n.lat - p.lat) < 0.01 and abs(n.lon - p.lon) < 0.012) where d <= {r}"""  # noqa: E731
_AH = f"ah as (select traj_id, idx, lon, lat, {sql_bearing('x0', 'y0', 'x1', 'y1')} as heading from (select *, coalesce(lag(lon) over {_W}, lon) as x0, coalesce(lag(lat) over {_W}, lat) as y0, coalesce(lead(lon) over {_W}, lon) as x1, coalesce(lead(lat) over {_W}, lat) as y1 from pts where known))"
_RANKED = f"""with {_facts_sql()}, m as (select traj_id, coalesce(mae, 0) as mae from (select traj_id, round(avg(error_m), 6) as mae from facts group by 1) right join (select distinct traj_id from pts) using (traj_id)),
r as (select traj_id, mae, row_number() over (order by mae, traj_id) - 1 as rank0, count(*) over () as n from m)"""

def _limit_turns_sql(cap: float = 45.0) -> str:
    """Two sweeps, each a recursion over idx that carries the last finished point."""
    def sweep(name: str, src: str) -> str:
        turn = f"coalesce({sql_angle(sql_bearing('b.lon', 'b.lat', 'b.nlon', 'b.nlat'), sql_bearing('a.lon', 'a.lat', 'b.lon', 'b.lat'))}, 0)"
        move = lambda c: f"case when b.n{c} is not null and {turn} > {cap} then (a.{c} + b.n{c}) / 2 else b.{c} end"
        return f"""{name}p as materialized (select traj_id, idx, lon, lat, lead(lon) over w as nlon, lead(lat) over w as nlat from {src} window w as (partition by traj_id order by idx)),
{name} as (select traj_id, idx, lon, lat from {name}p where idx = 0 union all select b.traj_id, b.idx, {move('lon')}, {move('lat')} from {name} a join {name}p b on b.traj_id = a.traj_id and b.idx = a.idx + 1)"""

    return f"with recursive {fx.sql_points()}, {sweep('s1', 'pts')}, {sweep('s2', 's1')} select traj_id, idx, {sql_r6('lon', 'lon')}, {sql_r6('lat', 'lat')} from s2"


def _map_features_sql(tag: str, radius: float, most: int, a: float, b: float) -> str:
    """f{tag}(traj_id, features): as parts of a with clause that has st and segs."""
    t = tag
    return f"""p{t} as (select distinct t.*, {sql_bearing('plon', 'plat', 'nlon', 'nlat')} as travel from st t left join range({most}) r on t.idx = floor(r.range * (n - 1) / {most - 1}) where n <= {most} or r.range is not null),
      j{t} as (select p.traj_id, p.idx, p.travel, s.seg_id, {_point_segment('p.lon', 'p.lat')} as dist, {sql_bearing('s.lon1', 's.lat1', 's.lon2', 's.lat2')} as b from p{t} p left join segs s on {_touch(float(radius))}),
      k{t} as (select traj_id, idx, any_value(travel) as travel, min(dist) as d0, count(*) filter (dist <= {radius}) as den, arg_min(b, row(dist, seg_id)) as b from j{t} group by 1, 2),
      m{t} as (select traj_id, coalesce(d0, {2 * radius}) as d, d0 is null as none, den::double as den, {sql_angle('travel', 'b')} as gap from k{t}),
      f{t} as (select traj_id, {sql_r6('avg(d)', 'road_mean')}, {sql_r6('quantile_cont(d, 0.9)', 'road_p90')}, {sql_r6('max(d)', 'road_max')}, {sql_r6(f'avg((d <= {a})::int)', 'near_1')}, {sql_r6(f'avg((d <= {b})::int)', 'near_2')}, {sql_r6('avg(den)', 'density_mean')}, {sql_r6('quantile_cont(den, 0.9)', 'density_p90')},
        {sql_r6('coalesce(avg(gap), 90)', 'heading_mean')}, {sql_r6('coalesce(quantile_cont(gap, 0.9), 90)', 'heading_p90')}, {sql_r6('avg(none::int)', 'no_road')} from m{t} group by 1)"""


def _map_cases_sql() -> str:
    used = {k: c for k, c in travel_time.CASES.items() if c is not None}
    parts = ", ".join(_map_features_sql(f"_{i}", c.radius, c.points, *c.near) for i, c in enumerate(used.values()))
    return f"with {fx.sql_points()}, {_steps_sql()}, {fx.sql_roads()}, {parts} " + " union all ".join(f"select '{name}' as \"case\", * from f_{i}" for i, name in enumerate(used))


def _distributions_sql() -> str:
    def one(keep: int) -> str:
        src = {"length": "select count(*)::double as v from {p} group by traj_id", "interval": "select v::double as v from (select ts - lag(ts) over (partition by traj_id order by idx) as v from {p}) where v is not null",
               "gap": "select (count(*) over (partition by traj_id, k))::double as v from (select *, count(*) filter (known) over (partition by traj_id order by idx) as k from {p}) where not known"}
        bins = {"length": (50, 39, 5), "interval": (0, 60, 1), "gap": (0.5, 16, 1)}
        return " union all ".join(
            f"select '{kind}' as kind, '1/{keep}' as dataset, ({lo} + r.range * {w})::double as bin, (select count(*) from ({q.format(p=f'pts{keep}')}) where v >= {lo} + r.range * {w} and (v < {lo} + (r.range + 1) * {w} or (r.range = {n - 1} and v = {lo} + {n} * {w}))) as count from range({n}) r"
            for kind, q in src.items() for lo, n, w in (bins[kind],))

    return f"with {fx.sql_points(8, 'pts8')}, {fx.sql_points(16, 'pts16')} {one(8)} union all {one(16)}"


SQL = {
    "recover_linear_by_gap": f"with {_facts_sql()} select {_ladder('gap_size', *buckets.GAPS_8)} as bucket, {_AGG} from facts group by 1",
    "haversine_steps": f"with {fx.sql_points()}, {_steps_sql()} select traj_id, idx, {sql_r6(sql_hav('plon', 'plat', 'lon', 'lat'), 'step_m')} from st",
    "bearings": f"with {fx.sql_points()}, {_steps_sql()} select traj_id, idx, case when plon is not null then b end as bearing, case when plon is not null and nlon is not null then t end as turn_deg from (select *, {sql_r6(sql_bearing('plon', 'plat', 'lon', 'lat'), 'b')}, {sql_r6(sql_angle(sql_bearing('lon', 'lat', 'nlon', 'nlat'), sql_bearing('plon', 'plat', 'lon', 'lat')), 't')} from st)",
    "turn_planar": f"with {_facts_sql().replace('where not l.known)', ')')} select traj_id, idx, round(turn_angle, 4) + 0e0 as turn_angle from facts",
    "speed_change": f"with {_facts_sql().replace('where not l.known)', ')')} select traj_id, idx, {sql_r6('speed_var', 'speed_var')} from facts",
    "gap_runs": f"with {_facts_sql()} select traj_id, idx, gap_size from gr",
    "gap_table": f"with {fx.sql_points()}, {_GAPS} select * from gt",
    "recover_linear": f"with {fx.sql_points()}, {fx.sql_linear()} select traj_id, idx, {sql_r6('lon', 'lon')}, {sql_r6('lat', 'lat')} from lin",
    "recover_pchip": _pchip_sql(),
    "smooth_gauss": f"with {fx.sql_points()} select traj_id, idx, {', '.join(sql_r6(e, c) for c, e in _gauss().items())} from pts",
    "anchor_headings": f"with {fx.sql_points()}, {_AH} select traj_id, idx, {sql_r6('heading', 'heading')} from ah",
    "resample_uniform": _resample_sql(False),
    "resample_speed_aware": _resample_sql(True),
    "even_sample": f"with {fx.sql_points()} select distinct p.traj_id, p.idx from pts p left join range(14) r on p.idx = floor(r.range * (n - 1) / 13) where n <= 14 or r.range is not null",
    "limit_turns": _limit_turns_sql(),
    "max_turns": f"with {fx.sql_points()}, {_steps_sql()} select traj_id, round(coalesce(max({sql_angle(sql_bearing('lon', 'lat', 'nlon', 'nlat'), sql_bearing('plon', 'plat', 'lon', 'lat'))}), 0), 5) as max_turn from st where plon is not null and nlon is not null group by 1",
    "point_errors": f"with {_facts_sql()} select traj_id, idx, {sql_r6('error_m', 'error_m')} from facts",
    "point_facts": f"with {_facts_sql()} select traj_id, idx, gap_size, traj_length, {', '.join(sql_r6(c, c) for c in ('error_m', 'position_ratio', 'speed_var'))}, round(turn_angle, 4) as turn_angle from facts",
    "global_metrics": f"with {_facts_sql()} select {_AGG} from facts",
    "trajectory_mae": f"with {_facts_sql()} select traj_id, coalesce(mae, 0) as mae from (select distinct traj_id from pts) left join (select traj_id, {sql_r6('avg(error_m)', 'mae')} from facts group by 1) using (traj_id)",
    "bucket_report": f"{_report_sql(8)} select '1/8' as dataset, dimension, bucket, {_AGG} from d group by dimension, bucket",
    "bucket_report_16": f"{_report_sql(16)} select '1/16' as dataset, dimension, bucket, {_AGG} from d group by dimension, bucket",
    "decision_triggers": f"""{_report_sql(8)}, b as (select dimension, bucket, avg(error_m) as mae from d group by 1, 2), x as (select max(mae) filter (dimension = 'turn_angle' and bucket = 'sharp(>90)') as sharp, max(mae) filter (dimension = 'turn_angle' and bucket = 'straight(<30)') as straight,
      max(mae) filter (dimension = 'gap_size' and bucket = '1-2') as short_gap, max(mae) filter (dimension = 'gap_size' and bucket = '5-7') as long_gap from b)
      select {', '.join(sql_r6(c, c) for c in ('sharp', 'straight', 'short_gap', 'long_gap'))}, coalesce(sharp >= 1.5 * straight, false) as curve_trigger, coalesce(long_gap >= 1.3 * short_gap, false) as gap_trigger from x""",
    "error_histogram": f"with {_facts_sql()}, t as (select quantile_cont(error_m, 0.99) as top from facts) select floor(error_m / 2e0) * 2e0 as bin, count(*) as count from facts, t where error_m <= top group by 1",
    "trajectory_bounds": f"with {fx.sql_points()} select traj_id, " + ", ".join(sql_r6(f"{f}({c}) {s} 0.08e0 * greatest(max({c}) - min({c}), 1e-9)", f"{f}_{c}") for c in ("lon", "lat") for f, s in (("min", "-"), ("max", "+"))) + " from pts group by 1",
    "representative_pick": f"{_RANKED}, q as (select *, row_number() over () - 1 as k from (select unnest([0.1e0, 0.25e0, 0.5e0, 0.75e0, 0.9e0, 0.98e0]) as q)) select traj_id, mae, k::bigint as pick from r join q on rank0 = round_even(q * (n - 1), 0)",
    "stratified_pool": f"""{_RANKED}, b as (select *, case when rank0 < n // 3 then 0 when rank0 < 2 * n // 3 then 1 else 2 end as bin, md5(traj_id || ':7') as h from r),
      o as (select *, row_number() over (partition by bin order by h, traj_id) as o, count(*) over (partition by bin) as size from b), q as (select *, 20 // 3 + (bin < 20 % 3)::int as quota from o),
      f as (select * from q where o <= quota), g as (select * from q where o > quota order by h, traj_id limit (select 20 - count(*) from f))
      select traj_id, mae as score, rank0 from (select * from f union all select * from g)""",
    "resampled_errors": f"""with {fx.sql_points()}, {fx.sql_linear()}, {_GAPS}, a as (select g.traj_id, gap_id, missing_count, start_idx, l.idx, l.lon, l.lat, lead(l.lon) over w as lon2, lead(l.lat) over w as lat2 from gt g join lin l on l.traj_id = g.traj_id and l.idx between start_idx and end_idx window w as (partition by g.traj_id, gap_id order by l.idx)),
      b as (select *, {sql_hav('lon', 'lat', 'lon2', 'lat2')} as d from a), f as (select *, coalesce(sum(d) over (partition by traj_id, gap_id order by idx rows between unbounded preceding and 1 preceding), 0) as s from b),
      q as (select traj_id, gap_id, start_idx, r.range as k, total * r.range / (missing_count + 1)::double as s from (select traj_id, gap_id, missing_count, start_idx, max(s) as total from f group by all), range(1, 17) r where r.range <= missing_count),
      m as (select q.traj_id, q.gap_id, q.start_idx, k, q.s, max(f.idx) as idx from q join f on f.traj_id = q.traj_id and f.gap_id = q.gap_id and f.s <= q.s and f.lon2 is not null group by all),
      x as (select m.traj_id, m.start_idx + k as idx, lon + (lon2 - lon) * coalesce(least(1e0, (m.s - f.s) / nullif(d, 0)), 0) as x, lat + (lat2 - lat) * coalesce(least(1e0, (m.s - f.s) / nullif(d, 0)), 0) as y from m join f on f.traj_id = m.traj_id and f.gap_id = m.gap_id and f.idx = m.idx)
      select x.traj_id, x.idx, {sql_r6(sql_hav('x.x', 'x.y', 'l.tlon', 'l.tlat'), 'error_m')} from x join lin l on l.traj_id = x.traj_id and l.idx = x.idx""",
    "map_features": f"with {fx.sql_points()}, {_steps_sql()}, {fx.sql_lattice()}, {_map_features_sql('', 300, 14, 20, 50)} select * from f",
    "map_case_features": _map_cases_sql(),
    "distributions": _distributions_sql(),
    "gap_metrics": f"with {fx.sql_points()}, {fx.sql_linear()}, {_GAPS}, {_METHODS} select g.traj_id, gap_id, missing_count, {_CASE_SQL} from gt g join mt on mt.traj_id = g.traj_id and mt.idx > start_idx and mt.idx < end_idx group by 1, 2, 3",
    "case_metrics": f"with {fx.sql_points()}, {fx.sql_linear()}, {_METHODS} select traj_id, count(*) as missing_count, {_CASE_SQL} from mt group by 1",
    "study_summary": f"with {fx.sql_points()}, {fx.sql_linear()}, {_METHODS}, c as (select traj_id, count(*) as w, " + ", ".join(f"avg(e_{m}) as mae_{m}, sqrt(avg(e_{m} * e_{m})) as rmse_{m}" for m in ("shift", "linear")) + " from mt group by 1) select count(*) as cases, sum(w)::bigint as missing, " + ", ".join(f"{sql_r6(f'avg(mae_{m})', f'mean_mae_{m}')}, {sql_r6(f'sum(w * mae_{m}) / sum(w) filter (mae_{m} is not null)', f'weighted_mae_{m}')}, {sql_r6(f'sqrt(sum(w * rmse_{m} * rmse_{m}) / sum(w) filter (rmse_{m} is not null))', f'weighted_rmse_{m}')}" for m in ("shift", "linear")) + f", {sql_r6('avg(case when mae_shift is not null and mae_linear is not null then (mae_shift < mae_linear)::int end)', 'win_rate_linear')} from c",
    "completion": f"with {fx.sql_points()} select traj_id, count(*) filter (not known) as total_missing, count(*) filter (not known and idx % 3 <> 1) as filled, count(*) filter (not known) = count(*) filter (not known and idx % 3 <> 1) as is_complete from pts group by 1",
    "polyline_errors": f"with {fx.sql_points()}, {fx.sql_linear()}, s as (select * from (select traj_id, lon as lon1, lat as lat1, lead(lon) over {_W} as lon2, lead(lat) over {_W} as lat2 from lin) where lon2 is not null) select p.traj_id, p.idx, {sql_r6('min(' + _point_segment('p.lon', 'p.lat') + ')', 'error_m')} from pts p join s on s.traj_id = p.traj_id where not p.known group by 1, 2",
    "nearest_road": f"with {fx.sql_points()}, {fx.sql_lattice()} select p.traj_id, p.idx, {sql_r6('min(' + _point_segment('p.lon', 'p.lat') + ')', 'road_m')} from pts p left join segs s on {_touch(240.0)} group by 1, 2",
    "nearest_node": f"with {fx.sql_points()}, {fx.sql_lattice()}, j as (select p.traj_id, p.idx, node_id, {sql_hav('p.lon', 'p.lat', 'n.lon', 'n.lat')} as d from pts p join nodes n on abs(n.lat - p.lat) < 0.006 and abs(n.lon - p.lon) < 0.006) select traj_id, idx, arg_min(node_id, d) as node_id, {sql_r6('min(d)', 'snap_m')} from j where d <= 220 group by 1, 2",
    "snap_points": f"with {fx.sql_points()}, {fx.sql_lattice()}, j as (select p.traj_id, p.idx, n.lon as x, n.lat as y, {sql_hav('p.lon', 'p.lat', 'n.lon', 'n.lat')} as d from pts p join nodes n on abs(n.lat - p.lat) < 0.006 and abs(n.lon - p.lon) < 0.006), b as (select traj_id, idx, arg_min(x, d) as x, arg_min(y, d) as y from j where d <= 150 group by 1, 2) select traj_id, idx, {sql_r6('coalesce(x, lon)', 'lon')}, {sql_r6('coalesce(y, lat)', 'lat')} from pts left join b using (traj_id, idx)",
    "knn_nodes": f"with {fx.sql_points()}, {fx.sql_lattice()}, {_AH}, c1 as ({_KNN(500, 'ah')}), rest as (select * from ah where (traj_id, idx) not in (select traj_id, idx from c1)), c as (select * from c1 union all {_KNN(800, 'rest')}), r as (select *, row_number() over (partition by traj_id, idx order by emit, node_id) - 1 as rank from c) select traj_id, idx, rank, node_id, {sql_r6('d', 'snap_m')}, {sql_r6('hd', 'heading_diff')}, {sql_r6('emit', 'emit')} from r where rank < 4",
    "topology_rate": f"with {fx.sql_points()}, {fx.sql_linear()}, {fx.sql_lattice()}, d as (select p.traj_id, p.idx, min({_point_segment('p.lon', 'p.lat')}) as m from lin p left join segs s on {_touch(168.0)} where not p.known group by 1, 2) select count(*) as eval_points, count(*) filter (m is null or m > 35) as violations, {sql_r6('count(*) filter (m is null or m > 35) / count(*)::double', 'violation_rate')}, {sql_r6('avg(m)', 'road_mean_m')}, {sql_r6('quantile_cont(m, 0.95)', 'road_p95_m')} from d",
}
