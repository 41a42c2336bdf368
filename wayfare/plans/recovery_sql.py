"""SQL of the map and hidden-Markov recoveries: candidates, least-cost routes by recursion, decoding by recursion, gates, sampling, blending."""

from __future__ import annotations

import math

from . import fixtures as fx
from .fixtures import sql_angle, sql_bearing, sql_hav, sql_r6

_W = "(partition by traj_id order by idx)"


def _routes(name: str, pairs: str, turns: bool, by_class: bool, hops: int = 16) -> str:
    """name(u, v, dist, path): cheapest routes of pairs(u, v), one edge per round from all sources at once."""
    turn = f"coalesce(greatest(0, {sql_angle('e.bearing', 'w.b')} - 55) / 125 * 55, 0)" if turns else "0"
    before = "e.src" if turns else "-1::bigint"
    return f"""{name}w as (select distinct u, u as node, -1::bigint as before, null::double as b, 0e0 as cost, 0e0 as dist, [u] as path, 0 as hops from {pairs}
  union all select u, node, before, min(b), min(cost), arg_min(dist, cost), arg_min(path, cost), hops from (
    select w.u, e.dst as node, {before} as before, e.bearing as b, w.cost + e.dist_m {'* e.pen' if by_class else ''} + {turn} as cost, w.dist + e.dist_m as dist, list_append(w.path, e.dst) as path, w.hops + 1 as hops
    from {name}w w join edges e on e.src = w.node where w.hops < {hops}) group by u, node, before, hops),
{name} as materialized (select u, node as v, arg_min(dist, cost) as dist, arg_min(path, cost) as path from {name}w where (u, node) in (select (u, v) from {pairs}) group by u, node)"""


def _gaps(least: int) -> str:
    """gap(traj_id, start_idx, end_idx, missing, ts0, ts1, lon0, lat0, lon1, lat1) between neighbouring known points."""
    lead = ", ".join(f"lead({c}) over {_W} as {n}" for c, n in (("idx", "end_idx"), ("ts", "ts1"), ("lon", "lon1"), ("lat", "lat1")))
    return f"gap as materialized (select traj_id, idx as start_idx, end_idx, end_idx - idx - 1 as missing, ts as ts0, ts1, lon as lon0, lat as lat0, lon1, lat1 from (select traj_id, idx, ts, lon, lat, {lead} from pts where known) where end_idx - idx - 1 >= {least})"


def _gates(src: str, max_snap: float, max_detour: float, min_speed: float, max_speed: float) -> str:
    """gated: src(…, n0, n1, snap0, snap1, dist, path) with its measures and reason (null: takes the route)."""
    return f"""ga as (select *, {sql_hav('lon0', 'lat0', 'lon1', 'lat1')} as straight, greatest(1, ts1 - ts0)::double as dt from {src}),
gb as (select *, greatest(coalesce(dist, straight), straight) as route_m from ga), gc as (select *, route_m / dt as speed, route_m / greatest(straight, 1e-6) as detour from gb),
gated as materialized (select *, case when n0 is null or n1 is null then 'no_match' when path is null or len(path) < 2 then 'no_path' when snap0 > {max_snap} or snap1 > {max_snap} then 'snap_too_far'
  when detour > {max_detour} then 'detour_too_large' when speed < {min_speed} then 'speed_too_low' when speed > {max_speed} then 'speed_too_high' end as reason from gc)"""


def _sampled(ends: tuple[str, str, str, str]) -> str:
    """sampled(traj_id, start_idx, idx, lon, lat): accepted routes between the given ends, at the time shares of the missing points."""
    x0, y0, x1, y1 = ends
    part = "(partition by traj_id, start_idx order by i)"
    at = lambda c: f"case when total < 1e-6 then f{c} else v.{c} + (v.{c}2 - v.{c}) * coalesce(least(1e0, (m.s - v.s) / nullif(v.d, 0)), 0) end as {c}"
    return f"""vx as (select traj_id, start_idx, 0 as i, {x0} as lon, {y0} as lat from gated where reason is null union all select traj_id, start_idx, j, n.lon, n.lat from (select traj_id, start_idx, unnest(path) as node_id, generate_subscripts(path, 1) as j from gated where reason is null) join nodes n using (node_id)
  union all select traj_id, start_idx, len(path) + 1, {x1}, {y1} from gated where reason is null),
vl as (select *, lead(lon) over {part} as lon2, lead(lat) over {part} as lat2 from vx), vd as (select *, {sql_hav('lon', 'lat', 'lon2', 'lat2')} as d from vl),
vs as materialized (select *, coalesce(sum(d) over (partition by traj_id, start_idx order by i rows between unbounded preceding and 1 preceding), 0) as s from vd),
vt as (select traj_id, start_idx, max(s) as total, arg_min(lon, i) as flon, arg_min(lat, i) as flat from vs group by all),
sq as (select g.traj_id, g.start_idx, p.idx, total, flon, flat, greatest(0e0, least(1e0, case when ts1 <= ts0 then (p.idx - g.start_idx) / (end_idx - g.start_idx)::double else (p.ts - ts0) / (ts1 - ts0)::double end)) * total as s
  from gated g join pts p on p.traj_id = g.traj_id and p.idx > g.start_idx and p.idx < g.end_idx join vt on vt.traj_id = g.traj_id and vt.start_idx = g.start_idx where reason is null),
sm as (select q.traj_id, q.start_idx, q.idx, q.s, total, flon, flat, max(v.i) as i from sq q join vs v on v.traj_id = q.traj_id and v.start_idx = q.start_idx and v.s <= q.s and v.lon2 is not null group by all),
sampled as materialized (select m.traj_id, m.start_idx, m.idx, {at('lon')}, {at('lat')} from sm m join vs v on v.traj_id = m.traj_id and v.start_idx = m.start_idx and v.i = m.i)"""


def recover_map() -> str:
    """Nearest nodes within 400 m, shortest routes, detour up to 6, blend 0.7."""
    near = f"""an as (select traj_id, start_idx as idx, lon0 as lon, lat0 as lat from gap union select traj_id, end_idx, lon1, lat1 from gap),
ne as materialized (select traj_id, idx, arg_min(node_id, row(d, node_id)) as node_id, min(d) as d from (select an.*, n.node_id, {sql_hav('an.lon', 'an.lat', 'n.lon', 'n.lat')} as d from an join nodes n on abs(n.lon - an.lon) < 0.01 and abs(n.lat - an.lat) < 0.01) where d <= 400 group by all)"""
    return f"""with recursive {fx.sql_points()}, {fx.sql_linear()}, {fx.sql_roads()}, {_gaps(4)}, {near},
gm as (select gap.*, a.node_id as n0, a.d as snap0, b.node_id as n1, b.d as snap1 from gap left join ne a on a.traj_id = gap.traj_id and a.idx = start_idx left join ne b on b.traj_id = gap.traj_id and b.idx = end_idx),
ask as materialized (select distinct n0 as u, n1 as v from gm where n0 is not null and n1 is not null), {_routes('ro', 'ask', False, False)},
gr as (select gm.*, dist, path from gm left join ro on u = n0 and v = n1), {_gates('gr', 400, 6, 0, 35)}, {_sampled(('lon0', 'lat0', 'lon1', 'lat1'))}
select l.traj_id, l.idx, {sql_r6('case when not l.known and s.lon is not null then 0.7e0 * s.lon + (1 - 0.7e0) * l.lon else l.lon end', 'lon')}, {sql_r6('case when not l.known and s.lon is not null then 0.7e0 * s.lat + (1 - 0.7e0) * l.lat else l.lat end', 'lat')}
from lin l left join sampled s on s.traj_id = l.traj_id and s.idx = l.idx"""


def _matched(knn: str, rest: str, headings: str) -> str:
    """chosen(traj_id, idx, node_id, slon, slat, snap), failed(traj_id), ro: candidates of known points, decoded."""
    ref = "greatest(straight / dt, 0.1e0)"
    turn = f"coalesce({sql_angle(sql_bearing('p.lon', 'p.lat', 'c.lon', 'c.lat'), sql_bearing('p.alon', 'p.alat', 'c.alon', 'c.alat'))} / 180, 0)"
    return f"""{headings}, c1 as materialized ({knn}), re as (select * from ah where (traj_id, idx) not in (select (traj_id, idx) from c1)), ca as (select * from c1 union all {rest}),
cr as (select *, row_number() over (partition by traj_id, idx order by emit, node_id) - 1 as rank from ca),
ko as (select traj_id, idx, ts, lon, lat, row_number() over {_W} - 1 as o from pts where known),
per as (select traj_id, count(*) as n, count(c.idx) as m from ko left join (select distinct traj_id, idx from cr) c using (traj_id, idx) group by 1),
failed as (select traj_id from per where n >= 2 and m < n),
cd as materialized (select ko.traj_id, ko.idx, ko.o, ko.ts, ko.lon as alon, ko.lat as alat, rank, node_id, d, emit, n.lon, n.lat from ko join cr using (traj_id, idx) join nodes n using (node_id) where rank < 4 and ko.traj_id in (select traj_id from per where n >= 2 and m = n)),
pa as materialized (select c.traj_id, c.o, c.rank, p.rank as prank, p.node_id as u, c.node_id as v, c.emit, {sql_hav('p.alon', 'p.alat', 'c.alon', 'c.alat')} as straight, greatest(1, c.ts - p.ts)::double as dt, {turn} as turn from cd c join cd p on p.traj_id = c.traj_id and p.o = c.o - 1),
ask as materialized (select distinct u, v from pa), {_routes('ro', 'ask', True, True)},
tr2 as materialized (select traj_id, o, rank, prank, emit, case when dist is null then 8e0 else 3e0 * (greatest(dist, straight) / greatest(straight, 1e-6) - 1) + 1.5e0 * (abs(greatest(dist, straight) / dt - {ref}) / greatest({ref}, 0.5e0)) + 0.5e0 * turn end as c from pa left join ro using (u, v)),
vi as (select traj_id, o, rank, emit as cost, [rank] as way from cd where o = 0
  union all select traj_id, o, rank, min(cost), list_append(arg_min(way, row(cost, prank)), rank) from (select t.traj_id, t.o, t.rank, t.prank, vi.cost + t.emit + t.c as cost, vi.way from vi join tr2 t on t.traj_id = vi.traj_id and t.o = vi.o + 1 and t.prank = vi.rank) group by traj_id, o, rank),
ve as (select traj_id, max(o) as o from cd group by 1), vb as (select vi.traj_id, arg_min(way, row(cost, rank)) as way from vi join ve using (traj_id, o) group by 1),
chosen as materialized (select cd.traj_id, cd.idx, node_id, cd.lon as slon, cd.lat as slat, d as snap from cd join vb on vb.traj_id = cd.traj_id and way[cd.o + 1] = rank)"""


def _hmm(knn: str, rest: str, headings: str, max_snap: float = 500, max_detour: float = 6) -> str:
    end = lambda k, i: f"left join chosen {k} on {k}.traj_id = gap.traj_id and {k}.idx = {i}"
    return f"""with recursive {fx.sql_points()}, {fx.sql_linear()}, {fx.sql_roads()}, {_gaps(1)}, {_matched(knn, rest, headings)},
gm as (select gap.*, a.node_id as n0, a.slon as slon0, a.slat as slat0, a.snap as snap0, b.node_id as n1, b.slon as slon1, b.slat as slat1, b.snap as snap1 from gap {end('a', 'start_idx')} {end('b', 'end_idx')} where missing >= 4),
gr as (select gm.*, dist, path from gm left join ro on u = n0 and v = n1), {_gates('gr', max_snap, max_detour, 0, 48)}"""


def recover_hmm(knn: str, rest: str, headings: str) -> str:
    ref = "greatest(straight / dt, 0.1e0)"
    near = f"""sn as (select s.traj_id, s.idx, arg_min(row(n.lon, n.lat), row({sql_hav('s.lon', 's.lat', 'n.lon', 'n.lat')}, n.node_id)) as b from sampled s join nodes n on abs(n.lon - s.lon) < 0.002 and abs(n.lat - s.lat) < 0.002 where {sql_hav('s.lon', 's.lat', 'n.lon', 'n.lat')} <= 45 group by all)"""
    pick = lambda c, k: sql_r6(f"case when not l.known and s.lon is not null then alpha * coalesce(b[{k}], s.{c}) + (1 - alpha) * l.{c} else l.{c} end", c)
    return f"""{_hmm(knn, rest, headings)}, {_sampled(('slon0', 'slat0', 'slon1', 'slat1'))}, {near},
al as (select traj_id, start_idx, case when conf >= 0.85 then 1e0 else greatest(0.45e0, least(0.9e0, 0.45e0 + (0.9e0 - 0.45e0) * conf)) end as alpha from (
  select traj_id, start_idx, greatest(0e0, least(1e0, exp(-((snap0 + snap1) / 2) / 55) * exp(-greatest(0, detour - 1) / 1.6e0) * exp(-(abs(speed - {ref}) / greatest({ref}, 0.5e0)) / 1.2e0))) as conf from gated where reason is null))
select l.traj_id, l.idx, {pick('lon', 1)}, {pick('lat', 2)} from lin l left join sampled s on s.traj_id = l.traj_id and s.idx = l.idx left join al on al.traj_id = s.traj_id and al.start_idx = s.start_idx left join sn on sn.traj_id = s.traj_id and sn.idx = s.idx"""


def statistics(knn: str, rest: str, headings: str, max_snap: float, max_detour: float) -> str:
    gates = ("snap_too_far", "detour_too_large", "speed_too_low", "speed_too_high")
    each = ", ".join(f"count(*) filter (reason = '{g}') as fallback_{g}" for g in gates)
    return f"""{_hmm(knn, rest, headings, max_snap, max_detour)}, w as (select g.traj_id is not null as tried, g.reason from gap left join gated g on g.traj_id = gap.traj_id and g.start_idx = gap.start_idx where gap.traj_id not in (select traj_id from failed))
select count(*) as segments_total, count(*) filter (tried) as segments_try_map, count(*) filter (tried and reason is null) as segments_map_success, count(*) filter (reason in ('no_path', 'no_match')) as fallback_no_path,
  count(*) filter (reason in {gates}) as fallback_low_confidence, {each}, (select coalesce(sum(n - 1), 0)::bigint from per where traj_id in (select traj_id from failed)) as fallback_no_candidates from w"""


def recover_hmm_post(knn: str, rest: str, headings: str) -> str:
    """With sharp turns, smoothing of gaps of confidence below 0.5, limited turns from a speed deviation of 0.1 on, and binding
    of gaps of confidence below 0.6."""
    ref = "greatest(straight / dt, 0.1e0)"
    legs = "(partition by traj_id, start_idx order by i)"
    part = "(partition by traj_id, start_idx order by idx)"
    near = lambda src, name: f"""{name} as (select s.traj_id, s.idx, arg_min(row(n.lon, n.lat), row({sql_hav('s.lon', 's.lat', 'n.lon', 'n.lat')}, n.node_id)) as b from {src} s join nodes n on abs(n.lon - s.lon) < 0.002 and abs(n.lat - s.lat) < 0.002 where {sql_hav('s.lon', 's.lat', 'n.lon', 'n.lat')} <= 45 group by all)"""
    agree = lambda h, r: f"coalesce({sql_angle(h, r)} <= 60, true)"
    ws = {k: math.exp(-0.5 * k * k) for k in range(-2, 3)}
    shift = lambda c, k: f"lag({c}, {k}) over {part}" if k > 0 else f"lead({c}, {-k}) over {part}" if k < 0 else c
    gauss = lambda c: "(" + " + ".join(f"coalesce({shift(c, k)} * {w!r}, 0)" for k, w in ws.items()) + ") / (" + " + ".join(f"case when {shift(c, k)} is not null then {w!r} else 0 end" for k, w in ws.items()) + ")"
    turn = f"coalesce({sql_angle(sql_bearing('b.lon', 'b.lat', 'b.nlon', 'b.nlat'), sql_bearing('a.lon', 'a.lat', 'b.lon', 'b.lat'))}, 0)"
    move = lambda c: f"case when b.nlon is not null and {turn} > 20 then (a.{c} + b.n{c}) / 2 else b.{c} end"
    return f"""{_hmm(knn, rest, headings)}, {_sampled(('slon0', 'slat0', 'slon1', 'slat1'))}, {near('sampled', 'sn')},
cf as (select *, abs(speed - {ref}) / greatest({ref}, 0.5e0) as sdev from gated where reason is null),
cg as (select *, greatest(0e0, least(1e0, exp(-((snap0 + snap1) / 2) / 55) * exp(-greatest(0, detour - 1) / 1.6e0) * exp(-sdev / 1.2e0))) as conf from cf),
vu as (select traj_id, start_idx, i, case when d is not null then {sql_bearing('lon', 'lat', 'lon2', 'lat2')} end as br from vd), vw as (select *, lag(br) over {legs} as pbr from vu),
tu as (select traj_id, start_idx, coalesce(max({sql_angle('br', 'pbr')}), 0) as sharp from vw group by all),
en as (select traj_id, start_idx, arg_min(br, i) filter (i = 0) as r0, max(br) filter (i = last) as r1 from (select *, max(i) over (partition by traj_id, start_idx) - 1 as last from vu) group by all),
al as materialized (select cg.traj_id, cg.start_idx, missing, conf, sdev, case when sharp >= 30 and conf >= 0.1 and {agree('h0.heading', 'r0')} and {agree('h1.heading', 'r1')} then greatest(0.9e0, alpha) else alpha end as alpha
  from (select *, case when conf >= 0.85 then 1e0 else greatest(0.45e0, least(0.9e0, 0.45e0 + (0.9e0 - 0.45e0) * conf)) end as alpha from cg) cg left join tu using (traj_id, start_idx) left join en using (traj_id, start_idx)
  left join ah h0 on h0.traj_id = cg.traj_id and h0.idx = cg.start_idx left join ah h1 on h1.traj_id = cg.traj_id and h1.idx = cg.end_idx),
f0 as materialized (select s.traj_id, s.start_idx, s.idx, missing, conf, sdev, alpha * coalesce(b[1], s.lon) + (1 - alpha) * l.lon as lon, alpha * coalesce(b[2], s.lat) + (1 - alpha) * l.lat as lat
  from sampled s join al on al.traj_id = s.traj_id and al.start_idx = s.start_idx join lin l on l.traj_id = s.traj_id and l.idx = s.idx left join sn on sn.traj_id = s.traj_id and sn.idx = s.idx),
f1 as materialized (select * replace (case when conf < 0.5 and missing >= 3 then (1 - 0.75e0) * lon + 0.75e0 * glon else lon end as lon, case when conf < 0.5 and missing >= 3 then (1 - 0.75e0) * lat + 0.75e0 * glat else lat end as lat) from (select *, {gauss('lon')} as glon, {gauss('lat')} as glat from f0)),
f1p as materialized (select traj_id, start_idx, idx, lon, lat, lead(lon) over {part} as nlon, lead(lat) over {part} as nlat from f1),
lt as (select traj_id, start_idx, idx, lon, lat from f1p where idx = start_idx + 1 union all select b.traj_id, b.start_idx, b.idx, {move('lon')}, {move('lat')} from lt a join f1p b on b.traj_id = a.traj_id and b.start_idx = a.start_idx and b.idx = a.idx + 1),
f2 as materialized (select f1.traj_id, f1.start_idx, f1.idx, conf, case when sdev >= 0.1 and missing >= 3 then (1 - 0.8e0) * f1.lon + 0.8e0 * lt.lon else f1.lon end as lon, case when sdev >= 0.1 and missing >= 3 then (1 - 0.8e0) * f1.lat + 0.8e0 * lt.lat else f1.lat end as lat from f1 join lt using (traj_id, start_idx, idx)),
{near('f2', 'sb')}, f3 as (select f2.traj_id, f2.idx, case when conf < 0.6 then coalesce(b[1], lon) else lon end as lon, case when conf < 0.6 then coalesce(b[2], lat) else lat end as lat from f2 left join sb using (traj_id, idx))
select l.traj_id, l.idx, {sql_r6('case when not l.known then coalesce(f3.lon, l.lon) else l.lon end', 'lon')}, {sql_r6('case when not l.known then coalesce(f3.lat, l.lat) else l.lat end', 'lat')} from lin l left join f3 on f3.traj_id = l.traj_id and f3.idx = l.idx"""


def outcomes(knn: str, rest: str, headings: str) -> str:
    return f"""{_hmm(knn, rest, headings)}, w as (select case when gap.traj_id in (select traj_id from failed) then 'no_candidates' when g.traj_id is null then 'short_gap' else coalesce(g.reason, 'map') end as outcome
  from gap left join gated g on g.traj_id = gap.traj_id and g.start_idx = gap.start_idx) select outcome, count(*) as count from w group by 1"""
