"""Trip features, cleaning, regression reports, routing and map-matching queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import buckets
from ..functions.geo import haversine_m
from ..operators import features, metrics, recovery, routing, sequence as seq, travel_time
from ..sources import schemas
from ..sources.osm import graph_nodes
from ..sources.work import settled
from . import fixtures as fx, recovery_sql
from .fixtures import r6, sql_angle, sql_bearing, sql_hav, sql_r6
from .recovery_queries import _AH, _KNN, _ladder


def trip_features(spark, sf_dir):
    p, t = fx.trips(spark, sf_dir)
    f = features.trip_features(p, t)
    return f.select("traj_id", *[(F.round(c, 5) + 0.0).alias(c) for c in features.TRIP_FEATURES if c != "detour_ratio"], (F.round("detour_ratio", 3) + 0.0).alias("detour_ratio"))


def clean_reasons(spark, sf_dir):
    p, t = fx.trips(spark, sf_dir)
    a = seq.steps(p).groupBy("traj_id").agg(F.count("*").alias("n_points"), F.coalesce(F.sum("step_m"), F.lit(0.0)).alias("path_m"))
    return features.clean_trips(t.join(a, "traj_id")).groupBy(F.coalesce("drop_reason", F.lit("used")).alias("outcome")).agg(F.count("*").alias("count"))


def sample_weights(spark, sf_dir):
    _, t = fx.trips(spark, sf_dir)
    return t.groupBy(features.sample_weight(F.col("travel_time"), "short-boost").alias("weight")).agg(F.count("*").alias("count"))


def trip_context(spark, sf_dir):
    p, t = fx.trips(spark, sf_dir)
    return features.trip_context(p, t).select("traj_id", "hour", "n_points", *r6("path_km", "direct_km"), (F.round("detour_ratio", 3) + 0.0).alias("detour_ratio"))


def reg_metrics(spark, sf_dir):
    return metrics.regression_summary(fx.pairs(spark, sf_dir)).select("count", *r6("mae", "rmse", "mape", "bias", "p50", "p90", "p95"))


def reg_grade(spark, sf_dir):
    r = fx.pairs(spark, sf_dir).agg(*metrics.regression_aggs())
    return r.select(buckets.grade("mae", "rmse", "mape").alias("grade"), "count")


def duration_buckets(spark, sf_dir):
    return metrics.duration_report(fx.pairs(spark, sf_dir)).select("bucket", "count", *r6("mae", "rmse", "mape"))


def _report(spark, sf_dir):
    p, t = fx.trips(spark, sf_dir)
    j = fx.pairs(spark, sf_dir).where("y_pred is not null").join(features.trip_context(p, t), "traj_id", "left")
    dims = {"travel_time": buckets.travel_time_bucket("y_true"), "hour": buckets.hour_bucket("hour"), "path_km": buckets.path_bucket("path_km"), "points": buckets.points_bucket("n_points"), "detour": buckets.detour_bucket(F.round("detour_ratio", 6))}
    return metrics.regression_report(j, dims)


def trip_bucket_report(spark, sf_dir):
    return _report(spark, sf_dir).select("group", "bucket", "count", *r6("share", "mae", "rmse", "mape", "bias", "p50", "p90", "p95"))


def worst_and_best(spark, sf_dir):
    return metrics.worst_and_best(_report(spark, sf_dir))


def coverage(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    t = p.where("traj_id % 7 <> 0").select("traj_id", F.col("y_true").alias("travel_time"))
    q = p.where("traj_id % 11 <> 0").select("traj_id", F.col("y_pred").alias("travel_time"))
    return metrics.coverage(t, q)


def id_differences(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("traj_id")
    return metrics.id_differences(p.where("traj_id % 7 <> 0"), p.where("traj_id % 11 <> 0"))


def top_errors(spark, sf_dir):
    return metrics.top_errors(fx.pairs(spark, sf_dir), 30).select("rank", "traj_id", *r6("y_true", "y_pred", "abs_error"))


def positional_check(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("ord"), F.col("o_orderkey").alias("traj_id"))
    moved = o.select("ord", (F.col("traj_id") + F.when(F.col("ord") % 100 == 3, 1).otherwise(0)).alias("traj_id"))
    return metrics.positional_pairs(o, moved).groupBy("disagree").agg(F.count("*").alias("count"))


def last_record_wins(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("traj_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), F.col("l_partkey").alias("value"))
    return schemas.last_wins(li).select("traj_id", "value")


def milestone_trend(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).where("y_pred is not null")
    runs = p.groupBy((F.col("traj_id") % 6).alias("run_order"), (F.col("traj_id") % 2).alias("ratio")).agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("mae"))
    return metrics.milestone_trend(runs).select("run_order", "ratio", *r6("mae", "mae_change_pct"), "is_best")


def blend_search(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).where("y_pred is not null").select("y_true", F.col("y_pred").alias("resid"), (F.col("y_true") * 0.9 + 50).alias("base2"))
    return travel_time.blend_search(p).select(*r6("w", "mae", "rmse", "mape"))


def count_control(spark, sf_dir):
    p, t = fx.trips(spark, sf_dir)
    j = t.join(p.groupBy("traj_id").agg(F.count("*").alias("n_points")), "traj_id")
    return travel_time.count_control(j.where("traj_id % 5 <> 0"), j.where("traj_id % 5 = 0")).select("traj_id", *r6("y_pred"))


def parameter_sweep(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).where("y_pred is not null").select("y_true", "y_pred")
    cases = {f"scale_{k}": p.withColumn("y_pred", F.col("y_pred") * (1 + k / 10)) for k in range(-1, 2)}
    return travel_time.sweep(cases, "scale_0").select("case", "count", *r6("mae", "rmse", "mape", "d_mae", "d_rmse", "d_mape"))


def _labelled(spark, sf_dir):
    """Trip features with the travel time, written once."""
    p, t = fx.trips(spark, sf_dir)
    return settled(features.trip_features(p, t).join(t.select("traj_id", "travel_time"), "traj_id"), "labelled")


def fit_linear(spark, sf_dir):
    """Linear model on trip features, scored on held-out trips."""
    f = _labelled(spark, sf_dir)
    m = travel_time.fit(f.where("traj_id % 5 <> 0"), features.TRIP_FEATURES, "linear", weights="short-boost")
    return travel_time.predict(m, f.where("traj_id % 5 = 0")).select("traj_id", *r6("travel_time"), (F.round("y_pred", 3) + 0.0).alias("y_pred")).withColumnRenamed("travel_time", "y_true")


def fit_boosted(spark, sf_dir):
    """Boosted ensemble of three models on trip features, scored on held-out trips."""
    f = _labelled(spark, sf_dir)
    m = travel_time.fit_ensemble(f.where("traj_id % 5 <> 0"), features.TRIP_FEATURES)
    return travel_time.predict_ensemble(m, f.where("traj_id % 5 = 0"), 0.5).select("traj_id", F.col("travel_time").alias("y_true"), "base1", "base2", "resid", "y_pred")


def map_sweep(spark, sf_dir):
    """The cases of the sweep on trip and map features, fitted side by side and scored on held-out trips."""
    p, t = fx.trips(spark, sf_dir)
    wide, columns = travel_time.case_table(_labelled(spark, sf_dir), p, fx.lattice(spark)[2])
    wide = settled(wide, "cases")
    return travel_time.sweep_cases(wide.where("traj_id % 5 <> 0"), wide.where("traj_id % 5 = 0"), features.TRIP_FEATURES, columns)


def _graph(spark, sf_dir):
    """Nodes and edges as tables, as a loaded map would be."""
    e = settled(fx.roads(spark, sf_dir)[1], "edges")
    return settled(graph_nodes(fx.road_nodes(spark, sf_dir), e), "nodes"), e


def route_cost(spark, sf_dir):
    """Least-cost lengths of the wanted pairs, without turn cost."""
    n, e = _graph(spark, sf_dir)
    return routing.routes(fx.route_pairs(spark, sf_dir), e, n, 1.0, 0.0, 55.0, None).select("u", "v", *r6("cost"))


def route_turns(spark, sf_dir):
    """Routes with turn cost."""
    n, e = _graph(spark, sf_dir)
    return routing.routes(fx.route_pairs(spark, sf_dir), e, n, most=None).select("u", "v", *r6("cost", "dist_m"), F.size("path").alias("hops"))


def route_turn_costs(spark, sf_dir):
    """Least costs with turn cost; ties between routes do not show in them."""
    return route_turns(spark, sf_dir).select("u", "v", "cost")


def recover_map(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    p, _ = recovery.recover_map(settled(fx.masked(fx.truth(spark, sf_dir)), "points"), n, e, recovery.MapOptions(match_radius=400.0, max_snap=400.0, max_detour=6.0, min_speed=0.0))
    return p.select("traj_id", "idx", *r6("lon", "lat"))


def recover_hmm(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    o = recovery.HmmOptions(radius=300.0, fallback=500.0, max_snap=500.0, max_detour=6.0, min_speed=0.0)
    p, _ = recovery.recover_hmm(settled(fx.masked(fx.truth(spark, sf_dir)), "points"), n, e, o)
    return p.select("traj_id", "idx", *r6("lon", "lat"))


def recover_hmm_outcomes(spark, sf_dir):
    n, e = _graph(spark, sf_dir)
    o = recovery.HmmOptions(radius=300.0, fallback=500.0, max_snap=500.0, max_detour=6.0, min_speed=0.0)
    return recovery.counters(recovery.recover_hmm(settled(fx.masked(fx.truth(spark, sf_dir)), "points"), n, e, o)[1])


def recover_hmm_statistics(spark, sf_dir):
    """Ten counters of a recovery whose candidates lie so near that some trajectories have none."""
    n, e = _graph(spark, sf_dir)
    o = recovery.HmmOptions(radius=150.0, fallback=250.0, max_snap=220.0, max_detour=1.6, min_speed=0.0, max_speed=48.0)
    return recovery.statistics(recovery.run_hmm(settled(fx.masked(fx.truth(spark, sf_dir)), "points"), n, e, o))


def recover_hmm_post(spark, sf_dir):
    """With sharp turns, smoothing, limited turns and binding."""
    n, e = _graph(spark, sf_dir)
    o = recovery.HmmOptions(
        radius=300.0, fallback=500.0, max_snap=500.0, max_detour=6.0, min_speed=0.0, sharp_turn_deg=30.0, sharp_conf=0.1, sharp_tolerance_deg=60.0, smooth_below=0.5, smooth_strength=0.75,
        limit_above_speed_dev=0.1, limit_turn_deg=20.0, limit_strength=0.8, bind="low-conf", bind_conf=0.6)
    p, _ = recovery.recover_hmm(settled(fx.masked(fx.truth(spark, sf_dir)), "points"), n, e, o)
    return p.select("traj_id", "idx", *r6("lon", "lat"))


def fusion_alpha(spark, sf_dir):
    """Confidence and blend share of made-up gaps on a grid of distances and gap lengths."""
    li = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 17).alias("missing_count"), (F.col("l_partkey") % 140).alias("s"), (F.col("l_suppkey") % 50).alias("d")).distinct()
    o = recovery.HmmOptions(fusion="continuous", small_gap=4, large_gap=12, fusion_gap_bias=0.1, fusion_power=1.5, low_conf=0.2)
    g = li.withColumn("raw_conf", recovery.confidence(F.col("s").cast("double"), 1 + F.col("d") / 25, F.col("d") / 40, o))
    return recovery.fusion(g, o).select("missing_count", "s", "d", *r6("conf", "alpha", "snap_radius"))


def viterbi_path(spark, sf_dir):
    """Cheapest states of made-up candidate sequences, three candidates per step."""
    li = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("traj_id"), (F.col("l_linenumber") - 1).alias("o0")).agg(F.min("l_partkey").alias("a"), F.min("l_suppkey").alias("b"))
    from pyspark.sql import Window

    s = li.withColumn("o", (F.row_number().over(Window.partitionBy("traj_id").orderBy("o0")) - 1).cast("int"))
    emit = F.array(*[(F.pmod(F.col("a") * (j + 3), F.lit(101)) + j / 7).cast("double") for j in range(3)])
    trans = F.array(*[F.array(*[(F.pmod(F.col("b") * (3 * j + k + 1), F.lit(89)) + (3 * j + k) / 11).cast("double") for k in range(3)]) for j in range(3)])
    v = recovery.viterbi(s.select("traj_id", "o", emit.alias("emit"), F.when(F.col("o") > 0, trans).alias("trans")))
    return v.select("traj_id", *r6("cost"), F.array_join(F.transform("states", lambda x: x.cast("string")), ",").alias("states"))


QUERIES = {f.__name__: f for f in (
    trip_features, clean_reasons, sample_weights, trip_context, reg_metrics, reg_grade, duration_buckets, trip_bucket_report, worst_and_best, coverage, id_differences, top_errors, positional_check,
    last_record_wins, milestone_trend, blend_search, count_control, parameter_sweep, map_sweep, fit_linear, fit_boosted, route_cost, route_turns, route_turn_costs, recover_map, recover_hmm, recover_hmm_outcomes, recover_hmm_statistics, recover_hmm_post, fusion_alpha, viterbi_path)}

# SQL

_W = "(partition by traj_id order by idx)"
_STEPS = f"""{fx.sql_trips()}, ts0 as (select *, lag(lon) over {_W} as plon, lag(lat) over {_W} as plat from tp),
ts as (select *, {sql_hav('plon', 'plat', 'lon', 'lat')} as step, case when plon is not null then {sql_bearing('plon', 'plat', 'lon', 'lat')} end as b from ts0),
tt as (select *, {sql_angle(f'lead(b) over {_W}', 'b')} as turn from ts)"""
_E = "(y_pred - y_true)"
_REG = f"count({_E}) as count, {sql_r6(f'avg(abs({_E}))', 'mae')}, {sql_r6(f'sqrt(avg({_E} * {_E}))', 'rmse')}, {sql_r6(f'100 * avg(abs({_E}) / greatest(abs(y_true), 1e-6))', 'mape')}"
_TAILS = f", {sql_r6(f'avg({_E})', 'bias')}, " + ", ".join(sql_r6(f"quantile_cont(abs({_E}), {q})", n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95)))


def _features_part(places: int | None = 5, last: bool = False) -> str:
    """The steps of the features as parts of a with clause, or the select that comes last. places: digits that features are
    rounded to; None leaves them as they are."""
    def r(e: str, n: str, k: int = 5) -> str:
        return f"coalesce({e}, 0)::double as {n}" if places is None else f"round(coalesce({e}, 0), {k}) + 0e0 as {n}"

    share = lambda d: f"count(*) filter (turn > {d}) / nullif(count(turn), 0)::double as s{d}"
    y = "sin(radians(x1 - x0)) * cos(radians(y1))"
    x = "(cos(radians(y0)) * sin(radians(y1)) - sin(radians(y0)) * cos(radians(y1)) * cos(radians(x1 - x0)))"
    moved = f"not (abs({x}) < 1e-12 and abs({y}) < 1e-12)"
    h = f"sqrt(pow({x}, 2) + pow({y}, 2))"
    day = "(departure_ts - 86400 * floor(departure_ts / 86400e0))"
    dow = "(cast(floor(departure_ts / 86400e0) as bigint) + 4) % 7"
    wave = lambda f, e, n, k: r(f"{f}(2 * {math.pi!r} * ({e}) / {n})", k)
    if not last:
        return f"""{_STEPS}, a as (select traj_id, count(*) as n, sum(step) as path, avg(step) as m, stddev_pop(step) as sd, quantile_cont(step, 0.5) as q5, quantile_cont(step, 0.9) as q9, max(step) as mx,
  avg(turn) as tm, quantile_cont(turn, 0.9) as t9, max(turn) as tx, {share(30)}, {share(60)}, {share(90)}, arg_min(lon, idx) as x0, arg_min(lat, idx) as y0, arg_max(lon, idx) as x1, arg_max(lat, idx) as y1,
  min(lon) as lx, max(lon) as hx, min(lat) as ly, max(lat) as hy from tt group by 1),
b as (select *, {sql_hav('x0', 'y0', 'x1', 'y1')} as direct, (hx - lx) * 111320e0 * greatest(0.2e0, cos(radians((ly + hy) / 2))) as w, (hy - ly) * 111320e0 as h from a)"""
    return f"""select t.traj_id, round(coalesce(n, 0), 5)::double as n_points, {r('path', 'path_m')}, {r('direct', 'direct_m')}, {r('coalesce(path, 0) / greatest(direct, 1e-6)', 'detour_ratio', 3)}, {r('m', 'step_mean')}, {r('sd', 'step_std')}, {r('q5', 'step_p50')}, {r('q9', 'step_p90')}, {r('mx', 'step_max')},
  {r('tm', 'turn_mean')}, {r('t9', 'turn_p90')}, {r('tx', 'turn_max')}, {r('s30', 'turn_share_30')}, {r('s60', 'turn_share_60')}, {r('s90', 'turn_share_90')}, {r('w', 'bbox_w')}, {r('h', 'bbox_h')}, {r('sqrt(w * w + h * h)', 'bbox_diag')}, {r('w * h / 1000000', 'bbox_area')},
  {r(f'case when {moved} then {y} / {h} else 0 end', 'heading_sin')}, {r(f'case when {moved} then {x} / {h} else 1 end', 'heading_cos')}, {r('x0', 'start_lon')}, {r('y0', 'start_lat')}, {r('x1', 'end_lon')}, {r('y1', 'end_lat')},
  {wave('sin', f'{day} / 3600e0', 24, 'hour_sin')}, {wave('cos', f'{day} / 3600e0', 24, 'hour_cos')}, {wave('sin', dow, '7e0', 'dow_sin')}, {wave('cos', dow, '7e0', 'dow_cos')}, ({dow} >= 5)::int::double as weekend, {r(f'{day} / 86400e0', 'minute_of_day')}, {r('ln(1 + coalesce(path, 0))', 'log_path')}
from tr t left join b using (traj_id)"""


def _fit_linear_sql() -> str:
    """Moments, products of all columns, Gauss-Jordan elimination on lists, prediction."""
    cols, n = features.TRIP_FEATURES, len(features.TRIP_FEATURES)
    return f"""with recursive {_features_part()}, f as materialized ({_features_part(None, True)}),
v as materialized (select f.traj_id, travel_time as y, (case when travel_time <= 600 then 1.8e0 when travel_time <= 1800 then 1.2e0 else 1e0 end) as w, f.traj_id % 5 <> 0 as train, [{', '.join(cols)}]::double[] as x from f join tr using (traj_id)),
mo as materialized (select j, avg(x[j]) as m, stddev_pop(x[j]) as s from v, (select unnest(range(1, {n + 1})) as j) where train group by j),
ms as materialized (select list(m order by j) as m, list(case when s > 1e-10 * greatest(1, abs(m)) then s end order by j) as s from mo),
z as materialized (select traj_id, y, w, train, list_concat([1e0], list_transform(x, lambda e, j: coalesce((e - ms.m[j]) / ms.s[j], 0e0)), [y]) as z from v, ms),
gr as materialized (select i, j, sum(w * z[i] * z[j]) + (case when i = j and i > 1 then {travel_time.RIDGE!r} else 0 end) as g from z, (select unnest(range(1, {n + 2})) as i), (select unnest(range(1, {n + 3})) as j) where train group by i, j),
ro as (select i, list(g order by j) as r from gr group by i),
gj as (select 1 as k, list(r order by i) as a from ro union all select k + 1, list_transform(a, lambda r, i: case when i = k then list_transform(r, lambda e: e / a[k][k]) else list_transform(r, lambda e, j: e - r[k] / a[k][k] * a[k][j]) end) from gj where k <= {n + 1}),
co as (select list_transform(a, lambda r: r[{n + 2}]) as c from gj where k = {n + 2})
select traj_id, {sql_r6('y', 'y_true')}, round(greatest(1e0, list_dot_product(c, z[1:{n + 1}])), 3) + 0e0 as y_pred from z, co where not train"""


_CTX = f"""{_STEPS}, cx as (select t.traj_id, cast(floor((departure_ts - 86400 * floor(departure_ts / 86400e0)) / 3600e0) as bigint) as hour, n_points, path_km, direct_km, path_km / greatest(direct_km, 1e-6) as detour from tr t left join
  (select traj_id, count(*) as n_points, coalesce(sum(step), 0) / 1000 as path_km, {sql_hav('arg_min(lon, idx)', 'arg_min(lat, idx)', 'arg_max(lon, idx)', 'arg_max(lat, idx)')} / 1000 as direct_km from tt group by 1) using (traj_id))"""
_BUCKETED = f"""{_CTX}, {fx.sql_pairs()}, j as (select pr.*, hour, path_km, n_points, detour from pr left join cx using (traj_id) where y_pred is not null), d as (""" + " union all ".join(
    f"select '{n}' as \"group\", {e} as bucket, y_true, y_pred from j" for n, e in (
        ("travel_time", _ladder("y_true", *buckets.TRAVEL_TIMES, op="<")), ("hour", _ladder("hour", *buckets.HOURS, op="<")), ("path_km", _ladder("path_km", *buckets.PATHS, op="<")),
        ("points", _ladder("n_points", *buckets.POINTS)), ("detour", _ladder("round(detour, 6)", *buckets.DETOURS, op="<")))) + ")"

def _route_sql(turns: bool, hops: int = 95) -> str:
    """Least costs from all sources at once, one edge per round; with turns a state is a node and the one before it."""
    turn = f"coalesce(greatest(0, {sql_angle('e.bearing', 'w.b')} - 55) / 125 * 55, 0)" if turns else "0"
    before = "e.src" if turns else "-1::bigint"
    return f"""with recursive {fx.sql_roads()}, walk as (select distinct u, u as node, -1::bigint as before, null::double as b, 0e0 as cost, 0e0 as dist, 0 as hops from wanted where u in (select node_id from nodes)
  union all select u, node, before, min(b), min(cost), arg_min(dist, cost), hops from (select w.u, e.dst as node, {before} as before, e.bearing as b, w.cost + e.dist_m * e.pen + {turn} as cost, w.dist + e.dist_m as dist, w.hops + 1 as hops from walk w join edges e on e.src = w.node where w.hops < {hops}) group by u, node, before, hops),
best as (select u, node as v, min(cost) as cost, arg_min(dist, cost) as dist, arg_min(hops, cost) as hops from walk where (u, node) in (select (u, v) from wanted) group by u, node)"""


#: SQL of the candidates within 300 m, of those within 500 m for points without any, and of the headings.
_MATCH = (_KNN(300, "ah"), _KNN(500, "re"), _AH)

SQL = {
    "trip_features": f"with {_features_part()} {_features_part(last=True)}",
    "fit_linear": _fit_linear_sql(),
    "clean_reasons": f"""with {_STEPS}, a as (select traj_id, count(*) as n, coalesce(sum(step), 0) as path from tt group by 1), c as (select *, path / travel_time * 3.6 as kmh from tr join a using (traj_id))
      select case when n < 2 then 'too_short' when travel_time is null or travel_time <= 0 then 'invalid_label' when travel_time < 60 or travel_time > 7200 then 'time_range' when kmh < 3 or kmh > 120 then 'speed_range' else 'used' end as outcome, count(*) as count from c group by 1""",
    "sample_weights": f"with {fx.sql_trips()} select (case when travel_time <= 600 then 1.8 when travel_time <= 1800 then 1.2 else 1.0 end)::double as weight, count(*) as count from tr group by 1",
    "trip_context": f"with {_CTX} select traj_id, hour, n_points, {sql_r6('path_km', 'path_km')}, {sql_r6('direct_km', 'direct_km')}, round(detour, 3) + 0e0 as detour_ratio from cx",
    "reg_metrics": f"with {fx.sql_pairs()} select {_REG}{_TAILS} from pr",
    "reg_grade": f"with {fx.sql_pairs()}, m as (select count({_E}) as count, avg(abs({_E})) as mae, sqrt(avg({_E} * {_E})) as rmse, 100 * avg(abs({_E}) / greatest(abs(y_true), 1e-6)) as mape from pr) select case " + " ".join(f"when mape <= {p} and mae <= {m} and rmse <= {r} then '{n}'" for n, p, m, r in buckets.GRADES) + " else 'weak' end as grade, count from m",
    "duration_buckets": f"with {fx.sql_pairs()}, l as (select unnest(['short_le_10m', 'medium_10m_30m', 'long_gt_30m']) as bucket), m as (select {_ladder('y_true', *buckets.DURATIONS)} as bucket, {_REG} from pr where y_pred is not null group by 1) select bucket, coalesce(count, 0) as count, mae, rmse, mape from l left join m using (bucket)",
    "trip_bucket_report": f"with {_BUCKETED}, m as (select \"group\", bucket, {_REG}{_TAILS} from d group by 1, 2) select *, {sql_r6('count / (sum(count) over (partition by \"group\"))::double', 'share')} from m",
    "worst_and_best": f"with {_BUCKETED}, m as (select \"group\", bucket, 100 * avg(abs({_E}) / greatest(abs(y_true), 1e-6)) as mape from d group by 1, 2) select \"group\", arg_max(bucket, mape) as worst, arg_min(bucket, mape) as best from m group by 1",
    "coverage": f"with {fx.sql_pairs()}, t as (select traj_id, y_true from pr where traj_id % 7 <> 0), q as (select traj_id as q_id, y_pred from pr where traj_id % 11 <> 0) select count(*) filter (traj_id is not null and q_id is not null) as n_both, count(*) filter (q_id is null) as n_missing, count(*) filter (traj_id is null) as n_extra, count(*) filter (traj_id is not null and q_id is not null and (y_true is null or y_pred is null)) as n_not_finite from t full join q on traj_id = q_id",
    "id_differences": "(select o_orderkey as traj_id, 'truth' as side from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 = 0 order by 1 limit 20) union all (select o_orderkey, 'predicted' from orders where o_orderkey % 7 = 0 and o_orderkey % 11 <> 0 order by 1 limit 20)",
    "top_errors": f"with {fx.sql_pairs()}, e as (select *, abs({_E}) as e from pr where y_pred is not null order by e desc, traj_id limit 30) select row_number() over (order by e desc, traj_id) as rank, traj_id, {sql_r6('y_true', 'y_true')}, {sql_r6('y_pred', 'y_pred')}, {sql_r6('e', 'abs_error')} from e",
    "positional_check": "select (o_orderkey - 1) % 100 = 3 as disagree, count(*) as count from orders group by 1",
    "last_record_wins": "select l_orderkey as traj_id, arg_max(l_partkey, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice)) as value from lineitem group by 1",
    "milestone_trend": f"with {fx.sql_pairs()}, r as (select traj_id % 6 as run_order, traj_id % 2 as ratio, avg(abs({_E})) as mae from pr where y_pred is not null group by 1, 2), w as (select *, first_value(mae) over (partition by ratio order by run_order) as f, row_number() over (partition by ratio order by mae, run_order) = 1 as is_best from r) select run_order, ratio, {sql_r6('mae', 'mae')}, {sql_r6('100 * (mae - f) / f', 'mae_change_pct')}, is_best from w",
    "blend_search": f"with {fx.sql_pairs()}, b as (select y_true, r.range / 80e0 as w, r.range / 80e0 * y_pred + (1 - r.range / 80e0) * (y_true * 0.9e0 + 50) as y_pred from pr, range(81) r where y_pred is not null), m as (select w as w0, {_REG} from b group by 1) select {sql_r6('w0', 'w')}, mae, rmse, mape from m",
    "count_control": f"with {fx.sql_trips()}, c as (select tr.traj_id, travel_time, n - 1 as x from tr join (select traj_id, count(*) as n from tp group by 1) using (traj_id)), k as (select sum(x * travel_time) / sum(x * x) as k from c where traj_id % 5 <> 0) select traj_id, {sql_r6('greatest(1, k * x)', 'y_pred')} from c, k where traj_id % 5 = 0",
    "parameter_sweep": f"with {fx.sql_pairs()}, b as (select 'scale_' || (r.range - 1) as \"case\", y_true, y_pred * (1 + (r.range - 1) / 10e0) as y_pred from pr, range(3) r where y_pred is not null), m as (select \"case\", count(*) as count, avg(abs({_E})) as mae, sqrt(avg({_E} * {_E})) as rmse, 100 * avg(abs({_E}) / greatest(abs(y_true), 1e-6)) as mape from b group by 1), c as (select mae as a, rmse as b, mape as p from m where \"case\" = 'scale_0') select \"case\", count, {sql_r6('mae', 'mae')}, {sql_r6('rmse', 'rmse')}, {sql_r6('mape', 'mape')}, {sql_r6('mae - a', 'd_mae')}, {sql_r6('rmse - b', 'd_rmse')}, {sql_r6('mape - p', 'd_mape')} from m, c",
    "fusion_alpha": """with g as (select distinct l_orderkey % 17 as missing_count, l_partkey % 140 as s, l_suppkey % 50 as d from lineitem),
      c as (select *, exp(-s / 55e0) * exp(-(d / 25e0) / 1.6e0) * exp(-(d / 40e0) / 1.2e0) as raw from g),
      k as (select *, greatest(0, least(1, raw + 0.1e0 * (2 * greatest(0, least(1, (missing_count - 4) / 8e0)) - 1))) as conf,
        case when missing_count >= 12 then 0.7e0 else 0.45e0 end as lo, case when missing_count <= 4 then 0.65e0 else 0.9e0 end as hi,
        case when missing_count <= 4 then 1.1e0 when missing_count >= 12 then 0.75e0 else 0.85e0 end as pure from c),
      a as (select *, case when conf >= pure then 1e0 else greatest(lo, least(hi, lo + (hi - lo) * pow(conf, 1.5))) end as a0 from k)
      select missing_count, s, d, """ + ", ".join((sql_r6("conf", "conf"), sql_r6("case when conf < 0.2 then least(a0, 0.5e0) else a0 end", "alpha"), sql_r6("45e0 * greatest(0, least(1, (0.7e0 - conf) / 0.7e0))", "snap_radius"))) + " from a",
    "viterbi_path": """with recursive s as (select traj_id, a, b, row_number() over (partition by traj_id order by o) - 1 as o from (select l_orderkey as traj_id, l_linenumber as o, min(l_partkey) as a, min(l_suppkey) as b from lineitem group by 1, 2)),
      r as (select traj_id, 0 as o, j, ((a * (j + 3)) % 101 + j / 7e0) as cost, [j]::bigint[] as way from s, (select range as j from range(3)) where o = 0
        union all select s.traj_id, r.o + 1, t.j, r.cost + ((s.a * (t.j + 3)) % 101 + t.j / 7e0) + ((s.b * (3 * t.j + r.j + 1)) % 89 + (3 * t.j + r.j) / 11e0), list_append(r.way, t.j) from r join s on s.traj_id = r.traj_id and s.o = r.o + 1, (select range as j from range(3)) t),
      l as (select traj_id, max(o) as o from s group by 1)
      select r.traj_id, """ + sql_r6("min(cost)", "cost") + """, array_to_string(arg_min(way, row(cost, list_reverse(way))), ',') as states from r join l on r.traj_id = l.traj_id and r.o = l.o group by 1""",
    "recover_map": recovery_sql.recover_map(),
    "recover_hmm": recovery_sql.recover_hmm(*_MATCH),
    "recover_hmm_outcomes": recovery_sql.outcomes(*_MATCH),
    "recover_hmm_statistics": recovery_sql.statistics(_KNN(150, "ah"), _KNN(250, "re"), _AH, 220, 1.6),
    "recover_hmm_post": recovery_sql.recover_hmm_post(*_MATCH),
    "route_turns": _route_sql(True) + f" select u, v, {sql_r6('cost', 'cost')}, {sql_r6('dist', 'dist_m')}, hops + 1 as hops from best",
    "route_turn_costs": _route_sql(True) + f" select u, v, {sql_r6('cost', 'cost')} from best",
    "route_cost": _route_sql(False) + f" select u, v, {sql_r6('cost', 'cost')} from best",
}
