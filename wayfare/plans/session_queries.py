"""Study sessions derived from events: every user is a case, several users make a session, and an event is an edit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..operators import sequence as seq, session
from . import fixtures as fx
from .fixtures import r6, sql_hav, sql_r6


def _edits(spark, sf_dir):
    k = F.col("event_id") % 20
    action = F.when(k == 19, "submit").when(k == 18, "clear").when(k >= 13, "undo").when(k >= 11, "remove").otherwise("add")
    e = fx.table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 13).alias("session_id"), F.col("user_id").alias("traj_id"), F.when(action != "submit", F.col("event_id") % 3).alias("gap_id"), F.col("event_id").alias("ord"), action.alias("action"),
                    (F.lit(108.9) + F.lit(0.001) * F.col("value")).alias("lon"), (F.lit(34.2) + F.lit(0.0001) * (F.col("event_id") % 97)).alias("lat"))


def session_strokes(spark, sf_dir):
    """What is left of every line after all edits."""
    return session.strokes(_edits(spark, sf_dir)).select(*session.GAP, "idx", *r6("lon", "lat"))


def session_summary(spark, sf_dir):
    """Saved cases of each session with their mean errors of two fillings."""
    t = fx.truth(spark, sf_dir)
    e = seq.interpolate_linear(fx.masked(t), ("x", "y")).join(t.select("traj_id", "idx", F.col("lon").alias("tx"), F.col("lat").alias("ty")), ["traj_id", "idx"]).where(~F.col("known"))
    scores = e.groupBy("traj_id").agg(F.avg(haversine_m("x", "y", "tx", "ty")).alias("mae_linear"), F.avg(haversine_m(F.col("x") + 0.001, F.col("y"), F.col("tx"), F.col("ty"))).alias("mae_shift"))
    pool = t.where("idx = 0 and traj_id % 4 <> 3").select("traj_id", F.col("traj_id").alias("ord"))
    s = session.summary(_edits(spark, sf_dir), pool, scores, ("linear", "shift"))
    return s.select("session_id", "saved_case_count", F.array_join(F.transform("saved_case_ids", lambda x: x.cast("string")), ",").alias("saved_case_ids"), *r6("mae_mean_linear", "mae_mean_shift"), "current_case_index", "total_cases")


QUERIES = {f.__name__: f for f in (session_strokes, session_summary)}

_EDITS = """ed as materialized (select user_id % 13 as session_id, user_id as traj_id, case when event_id % 20 <> 19 then event_id % 3 end as gap_id, event_id as ord,
  case when event_id % 20 = 19 then 'submit' when event_id % 20 = 18 then 'clear' when event_id % 20 >= 13 then 'undo' when event_id % 20 >= 11 then 'remove' else 'add' end as action, 108.9e0 + 0.001e0 * value as lon, 34.2e0 + 0.0001e0 * (event_id % 97) as lat from events)"""
SQL = {
    # every edit replayed, with the lines before it as history
    "session_strokes": f"""with recursive {_EDITS}, n as materialized (select *, row_number() over (partition by session_id, traj_id, gap_id order by ord) as k from ed where gap_id is not null),
      f as (select session_id, traj_id, gap_id, 0::bigint as k, []::bigint[] as line, []::bigint[][] as before from n where k = 1
        union all select f.session_id, f.traj_id, f.gap_id, n.k, case n.action when 'add' then list_append(line, n.ord) when 'remove' then line[1:len(line) - 1] when 'clear' then [] else coalesce(before[len(before)], line) end,
          case when n.action = 'undo' then before[1:len(before) - 1] else list_append(before, line) end from f join n on n.session_id = f.session_id and n.traj_id = f.traj_id and n.gap_id = f.gap_id and n.k = f.k + 1),
      z as (select session_id, traj_id, gap_id, arg_max(line, k) as line from f group by all),
      v as (select session_id, traj_id, gap_id, unnest(line) as ord, generate_subscripts(line, 1) - 1 as idx from z)
      select v.session_id, v.traj_id, v.gap_id, idx, {sql_r6('lon', 'lon')}, {sql_r6('lat', 'lat')} from v join ed using (ord)""",
    "session_summary": f"""with {fx.sql_points()}, {fx.sql_linear()}, {_EDITS}, sc as (select traj_id, avg({sql_hav('lon', 'lat', 'tlon', 'tlat')}) as a, avg({sql_hav('lon + 0.001e0', 'lat', 'tlon', 'tlat')}) as b from lin where not known group by 1),
      po as (select distinct user_id as traj_id from events where user_id % 4 <> 3), ip as (select ed.* from ed join po using (traj_id)),
      la as (select session_id, arg_max(traj_id, ord)::int as current_case_index from ip group by 1), sv as (select distinct session_id, traj_id from ip where action = 'submit'),
      su as (select session_id, count(*) as n, string_agg(traj_id::varchar, ',' order by traj_id) as ids, avg(a) as a, avg(b) as b from sv left join sc using (traj_id) group by 1)
      select session_id, coalesce(n, 0) as saved_case_count, coalesce(ids, '') as saved_case_ids, {sql_r6('a', 'mae_mean_linear')}, {sql_r6('b', 'mae_mean_shift')}, current_case_index, (select count(*) from po) as total_cases from la left join su using (session_id)""",
}
