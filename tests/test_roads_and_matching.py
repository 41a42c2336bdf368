"""Road network, grid joins, routing and map matching against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions.geo import metres_to_degrees
from wayfare.operators import decode, recovery, routing, spatial
from wayfare.plans import fixtures as fx
from wayfare.sources import osm
from wayfare.sources.work import settled

MAP = """<osm><bounds minlat="0" minlon="0" maxlat="1" maxlon="1"/>
<node id="1" lat="0" lon="0"/><node id="2" lat="0" lon="0.001"/><node id="3" lat="0.001" lon="0.001"/><node id="4" lat="0.001" lon="0.001"/><node id="9" lat="5" lon="5"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="primary"/></way>
<way id="11"><nd ref="3"/><nd ref="1"/><tag k="highway" v="service"/><tag k="oneway" v="no"/><tag k="oneway" v="yes"/></way>
<way id="12"><nd ref="1"/><nd ref="3"/><tag k="highway" v="residential"/><tag k="oneway" v="-1"/></way>
<way id="13"><nd ref="3"/><nd ref="4"/><nd ref="77"/><tag k="highway" v="road"/></way>
<way id="14"><nd ref="1"/><nd ref="9"/><tag k="highway" v="footway"/></way><way id="15"><nd ref="1"/><tag k="highway" v="road"/></way></osm>"""


@pytest.fixture(scope="module")
def lattice(spark):
    return [t.cache() for t in fx.lattice(spark)]


def test_osm_graph_and_segments(spark, tmp_path):
    (tmp_path / "m.osm").write_text(MAP)
    nodes, ways = osm.read_osm(spark, f"file://{tmp_path}/m.osm")
    e = osm.road_edges(nodes, ways)
    assert sorted((r.src, r.dst, r.class_penalty) for r in e.collect()) == [(1, 2, 1.08), (2, 1, 1.08), (2, 3, 1.08), (3, 1, 1.42), (3, 1, 1.65), (3, 2, 1.08)]
    assert osm.road_segments(nodes, ways).count() == 5  # the leg of zero length stays, the leg to an unknown node goes
    g = {r.node_id: len(r.out_bearings) for r in osm.graph_nodes(nodes, e).collect()}
    assert g == {1: 1, 2: 2, 3: 3}
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        n, ed, s = osm.load_or_build(spark, f"file://{tmp_path}/m.osm", cache)
        assert (n.count(), ed.count(), s.count()) == (3, 6, 5)


def test_map_file_is_read_once(spark, tmp_path, monkeypatch):
    """The kept tables are built from tables that were read before, none of them from the file itself."""
    (tmp_path / "m.osm").write_text(MAP)
    built = {}
    monkeypatch.setattr(osm.versions, "kept", lambda spark, base, layout, build, force=False: built.update(build()) or built)
    n, e, s = osm.load_or_build(spark, f"file://{tmp_path}/m.osm", f"file://{tmp_path}/cache")
    assert (n.count(), e.count(), s.count()) == (3, 6, 5)
    assert not any("xml" in t._jdf.queryExecution().sparkPlan().toString().lower() for t in built.values())


def test_grid_joins_do_not_depend_on_the_cell(spark, lattice):
    nodes, _, segs = lattice
    rng = np.random.default_rng(0)
    p = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(108.79 + 0.1 * rng.random(60), 34.09 + 0.1 * rng.random(60)))], "traj_id long, idx long, lon double, lat double")
    near = [sorted(map(tuple, spatial.nearest_road(p, segs, 60.0, cell=c).select("idx", F.round("road_m", 6)).collect())) for c in (0.0007, 0.003, 0.02)]
    assert near[0] == near[1] == near[2] and any(m is None for _, m in near[0]) or all(m is not None for _, m in near[0])
    snap = [sorted(map(tuple, spatial.nearest_node(p, nodes, 300.0, cell=c).select("idx", "node_id").collect())) for c in (0.0007, 0.01)]
    assert snap[0] == snap[1]
    plan = spatial.nearest_road(p, segs, 60.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_segments_lie_in_few_cells(spark):
    """Segments of any length take four cells at most, and joins find the same pairs as all pairs do."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        x, y, reach = 108 + rng.random(), 34 + rng.random(), 10.0 ** rng.uniform(-4, 0.5)
        rows.append((str(k), float(x), float(y), float(x + reach * rng.normal()), float(y + reach * rng.normal())))
    segs = osm.with_bbox(spark.createDataFrame(rows, "seg_id string, lon1 double, lat1 double, lon2 double, lat2 double"))
    s, levels = spatial._levels(segs, 0.003)
    size = 0.003 * F.pow(F.lit(2.0), F.col("_level"))
    cells = (F.floor(F.col("max_lon") / size) - F.floor(F.col("min_lon") / size) + 1) * (F.floor(F.col("max_lat") / size) - F.floor(F.col("min_lat") / size) + 1)
    assert s.agg(F.max(cells)).first()[0] <= 4 and len(levels) > 5
    p = spark.createDataFrame([(0, k, float(108 + rng.random()), float(34 + rng.random())) for k in range(80)], "traj_id long, idx long, lon double, lat double")
    got = {(r.idx, r.seg_id) for r in spatial.near_segments(p, segs, 900.0).collect()}
    dx, dy = metres_to_degrees(900.0, F.col("lat")), metres_to_degrees(900.0)
    want = p.crossJoin(segs).where((F.col("max_lon") >= F.col("lon") - dx) & (F.col("min_lon") <= F.col("lon") + dx) & (F.col("max_lat") >= F.col("lat") - dy) & (F.col("min_lat") <= F.col("lat") + dy))
    assert got == {(r.idx, r.seg_id) for r in want.select("idx", "seg_id").collect()} and got
    near = {r.idx: r.road_m for r in spatial.nearest_road(p, segs, 900.0).collect()}
    once = {r.idx: r.m for r in spatial.near_segments(p, segs, 3600.0).groupBy("idx").agg(F.min("dist_m").alias("m")).collect()}
    assert near == {k: once.get(k) for k in range(80)}


def test_search_and_relaxation_agree(spark, lattice):
    nodes, edges, _ = lattice
    small = nodes.where("node_id % 41 < 6 and node_id < 246")
    inner = edges.join(small.select(F.col("node_id").alias("src")), "src", "left_semi").join(small.select(F.col("node_id").alias("dst")), "dst", "left_semi").cache()
    pairs = spark.createDataFrame([(0, 209), (5, 205), (82, 82), (0, 100000)], "u long, v long")
    a = {(r.u, r.v): (round(r.cost, 6), round(r.dist_m, 6)) for r in routing.routes(pairs, inner, small, most=None).collect()}
    b = {(r.u, r.v): (round(r.cost, 6), round(r.dist_m, 6)) for r in routing.routes(pairs, inner, small, broadcast_edges=0).collect()}
    assert a == b and set(a) == {(0, 209), (5, 205), (82, 82)} and a[82, 82] == (0, 0)
    for most in (3, 60):
        c, d = ({(r.u, r.v) for r in routing.routes(pairs, inner, small, most=most, broadcast_edges=k).collect()} for k in (10**6, 0))
        assert c == d and c < set(a)


def test_relaxation_visits_little(spark, lattice):
    """The same routes with and without landmarks; no state beyond a pair's cost and the window; landmarks visit less."""
    nodes, edges, _ = lattice
    small = nodes.where("node_id % 41 < 16 and node_id < 656").cache()
    inner = edges.join(small.select(F.col("node_id").alias("src")), "src", "left_semi").join(small.select(F.col("node_id").alias("dst")), "dst", "left_semi").cache()
    pairs = spark.createDataFrame([(0, 4), (126, 215), (300, 45)], "u long, v long")
    want = {(r.u, r.v): r.cost for r in routing.routes(pairs, inner, small, most=None).collect()}
    marks = routing.landmarks(inner, small, 4)
    m = {r.node_id: r for r in marks.collect()}
    assert len(m) == small.count() and all(len(r.away) == len(r.back) <= 4 for r in m.values())
    visited = {}
    for name, table in (("line", None), ("marks", marks)):
        s = routing._search(pairs, inner, small, 1.0, 55.0, 55.0, None, table, 600.0, 500).cache()
        got = {(r.u, r.v): r.c for r in s.where("node = v").groupBy("u", "v").agg(F.min("cost").alias("c")).collect()}
        assert got == {k: pytest.approx(c) for k, c in want.items()}
        closed = s.where("not open")
        visited[name] = closed.count()
        for r in closed.groupBy("u", "v").agg(F.max("bound").alias("b")).collect():
            # a state is grown only within the window of the least open bound, which never passes the route's cost; its edge adds at most its own length
            assert r.b <= want[r.u, r.v] + 600.0 + 1e-6
    flood = small.count() * 3 * 3  # states of all pairs, about three ways into each node
    assert visited["marks"] < visited["line"] < flood / 2


def test_viterbi_equals_enumeration(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for t in range(20):
        sizes = rng.integers(1, 4, 5)
        emit = [rng.random(n).round(3).tolist() for n in sizes]
        trans = [None, *[rng.random((sizes[k], sizes[k - 1])).round(3).tolist() for k in range(1, 5)]]
        rows += [(t, k, emit[k], trans[k]) for k in range(5)]
        cost = lambda w, emit=emit, trans=trans: sum(emit[k][w[k]] for k in range(5)) + sum(trans[k][w[k]][w[k - 1]] for k in range(1, 5))
        want[t] = min(cost(w) for w in itertools.product(*map(range, sizes)))
        want[t, "cost"] = cost
    got = recovery.viterbi(spark.createDataFrame(rows, "traj_id long, o int, emit array<double>, trans array<array<double>>")).collect()
    for r in got:
        assert r.cost == pytest.approx(want[r.traj_id]) == pytest.approx(want[r.traj_id, "cost"](r.states))
    assert len(got) == 20


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_viterbi_in_chunks(spark, chunk):
    """Sequences of any length, with a changing number of states, cut in chunks: the plain decoder's states."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for t in range(9):
        n = int(rng.integers(1, 50))
        sizes = rng.integers(1, 5, n)
        emit = [rng.random(k) for k in sizes]
        trans = [None] + [rng.random((sizes[k], sizes[k - 1])) for k in range(1, n)]
        rows += [(t, k, emit[k].tolist(), trans[k].tolist() if k else None) for k in range(n)]
        cost, back = emit[0], []
        for k in range(1, n):
            each = cost[None, :] + emit[k][:, None] + trans[k]
            back.append(each.argmin(1))
            cost = each.min(1)
        way = [int(cost.argmin())]
        for b in reversed(back):
            way.append(int(b[way[-1]]))
        want[t] = (float(cost.min()), way[::-1])
    df = spark.createDataFrame(rows, "traj_id long, o int, emit array<double>, trans array<array<double>>").repartition(3)
    states, costs = decode.states(df, chunk=chunk)
    got = {}
    for r in states.collect():
        got.setdefault(r.traj_id, {})[r.o] = r.state
    assert {t: [x[k] for k in range(len(x))] for t, x in got.items()} == {t: w for t, (_, w) in want.items()}
    assert {r.traj_id: r.cost for r in costs.collect()} == {t: pytest.approx(c) for t, (c, _) in want.items()}
    assert decode.states(df.limit(0), chunk=chunk)[0].count() == 0


def test_hmm_recovery_follows_the_road(spark, lattice):
    nodes, edges, _ = lattice
    # along a street, then around a corner, observed at every eighth point
    line = [(108.80 + 0.0005 * k, 34.105) for k in range(41)] + [(108.82, 34.105 + 0.0005 * k) for k in range(1, 40)]
    rows = [(1, i, 10 * i, x if i % 8 == 0 or i == 79 else None, y if i % 8 == 0 or i == 79 else None, i % 8 == 0 or i == 79) for i, (x, y) in enumerate(line)]
    rows += [(2, 0, 0, 0.0, 0.0, True), (2, 1, 5, None, None, False), (2, 2, 9, 0.1, 0.0, True), (3, 0, 0, None, None, False)]
    p = spark.createDataFrame(rows, "traj_id long, idx long, ts long, lon double, lat double, known boolean")
    o = recovery.HmmOptions(radius=400.0, max_snap=400.0, max_detour=9.0, min_gap=1, snap_radius=0.0, alpha=(1.0, 1.0), smooth_below=0.01, limit_above_speed_dev=50.0, limit_turn_deg=170.0, bind="low-conf", bind_conf=-1.0, sharp_turn_deg=60.0, speed_aware=True)
    got, reasons = recovery.recover_hmm(p, nodes, edges, o)
    r = {(x.traj_id, x.idx): (x.lon, x.lat) for x in got.collect()}
    assert len(r) == len(rows) and all(r[t, i] == (x, y) for t, i, _, x, y, k in rows if k)
    why = {(x.traj_id, x.start_idx): x.reason for x in reasons.collect()}
    assert why[2, 0] == "no_candidates" and r[2, 1][0] == pytest.approx(0.1 * 5 / 9) and r[3, 0] == (None, None)
    done = [k for k, v in why.items() if v is None]
    assert done
    for t, a in done:  # sampled points lie on the lattice's streets
        for i in range(a + 1, min(a + 8, 79)):
            x, y = r[t, i]
            assert min(abs((x - 108.8) / 0.005 - round((x - 108.8) / 0.005)), abs((y - 34.1) / 0.005 - round((y - 34.1) / 0.005))) < 1e-3
    m, _ = recovery.recover_map(p, nodes, edges, recovery.MapOptions(match_radius=400.0, max_snap=400.0, max_detour=9.0, min_gap=1))
    assert m.count() == len(rows)


def test_fusion_rules(spark):
    g = spark.createDataFrame([(2, 0.9), (8, 0.9), (20, 0.76), (8, 0.1)], "missing_count long, raw_conf double")
    o = recovery.HmmOptions(small_gap=3, large_gap=15, low_conf=0.2, low_conf_alpha_cap=0.3)
    got = [r.alpha for r in recovery.fusion(g, o).collect()]
    assert got == [pytest.approx(0.45 + 0.2 * 0.9), 1.0, 1.0, 0.3]
    c = recovery.fusion(g, recovery.HmmOptions(fusion="continuous")).collect()
    assert c[0].snap_radius == 0 and c[3].snap_radius == pytest.approx(45 * (0.6 / 0.7)) and math.isclose(c[3].alpha, 0.45 + 0.45 * 0.1)


def test_small_maps_are_sent_and_large_ones_shuffled(spark, lattice, monkeypatch):
    """Points spread over cells are never sent through the driver, whatever sizes the planner guesses."""
    nodes, _, segs = fx.lattice(spark)
    p = spark.range(50).select(F.col("id").alias("traj_id"), F.lit(0).cast("long").alias("idx"), (108.8 + F.col("id") / 1000).alias("lon"), F.lit(34.11).alias("lat"), F.lit(20.0).alias("heading"))
    joins = {"nodes": lambda: spatial.candidates(p, nodes, 500.0, 4, 55.0, 0.7, 800.0), "roads": lambda: spatial.near_segments(p, segs, 300.0)}
    rows = {}
    for name, join in joins.items():
        plan = join()._jdf.queryExecution().sparkPlan().toString()
        last = next(line for line in plan.splitlines() if "Join" in line and "_g" in line)
        assert "BroadcastHashJoin" in last and "BuildRight" in last, last
        rows[name] = sorted(map(tuple, join().collect()))
    monkeypatch.setattr(spatial, "SMALL", 10)
    for name, join in joins.items():
        plan = join()._jdf.queryExecution().sparkPlan().toString()
        last = next(line for line in plan.splitlines() if "Join" in line and "_g" in line)
        assert "SortMergeJoin" in last, last
        assert sorted(map(tuple, join().collect())) == rows[name] and rows[name]


def test_nodes_just_within_the_radius_are_found(spark):
    """The cells that a radius touches are measured as the distance is: nodes between 219.76 and 220 m away, next to a cell's edge."""
    y = 0.0015 * 22800 + 1e-7
    near = [(k, 0, 108.9, y - m / 111194.926) for k, m in enumerate((219.8, 219.9, 219.99))] + [(9, 0, 108.9, y - 220.01 / 111194.926)]
    p = spark.createDataFrame(near, "traj_id long, idx long, lon double, lat double")
    nodes = spark.createDataFrame([(7, 108.9, y)], "node_id long, lon double, lat double")
    assert sorted(r.traj_id for r in spatial.nearest_node(p, nodes, 220.0).collect()) == [0, 1, 2]


def test_nodes_towards_a_pole_lie_in_few_cells(spark):
    """However near a node is to a pole, or beyond it by mistake, it is spread over a few cells, and joins find what all pairs give."""
    rng = np.random.default_rng(5)
    lat = np.concatenate([90 - 10.0 ** rng.uniform(-4, 1.5, 150), [90.0, 89.9999, 60.0, 120.0, 179.9]])
    nodes = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(rng.uniform(-90, 90, len(lat)), lat))]
    points = [(k, 0, x + float(rng.uniform(-1, 1)) * min(180.0, 0.003 / max(1e-9, abs(math.cos(math.radians(y))))), min(y + float(rng.uniform(-1, 1)) * 0.002, 90.0 if y <= 90 else 180.0)) for k, x, y in nodes]
    n, p = spark.createDataFrame(nodes, "node_id long, lon double, lat double"), spark.createDataFrame(points, "traj_id long, idx long, lon double, lat double")
    reach = 300.0 / 6371000.0
    cells = spatial._spread(n.withColumnsRenamed({"lon": "node_lon", "lat": "node_lat"}), reach, math.degrees(reach)).groupBy("node_id").count()
    assert cells.agg(F.max("count")).first()[0] <= 60 and cells.where("count > 12").count() < 60

    def metres(a, b, c, d):
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, max(0.0, h))))

    want = sorted((t, k) for t, _, x, y in points for k, u, v in nodes if metres(x, y, u, v) <= 300.0)
    assert sorted((r.traj_id, r.node_id) for r in spatial.near_nodes(p, n, 300.0).collect()) == want and len(want) > 150


def test_viterbi_ties_of_whole_ways(spark):
    """Two ways whose sums are the same double in the end: the one with the lower states counts, although its cost half-way is greater by a bit."""
    a = 0.1 + 0.2  # 0.30000000000000004
    steps = [(1, 0, [a, 0.3], None), (1, 1, [1000.0, 2000.0], [[5.0, 5.0], [5.0, 5.0]]), (1, 2, [7.0, 7.0], [[1.0, 1.0], [1.0, 1.0]])]
    df = spark.createDataFrame(steps, "traj_id long, o int, emit array<double>, trans array<array<double>>")
    assert a > 0.3 and a + 1000.0 + 5.0 == 0.3 + 1000.0 + 5.0
    assert recovery.viterbi(df).first().states == [0, 0, 0]


def test_tiles_give_the_routes_of_the_whole_graph(spark, lattice):
    """Small tiles: searches that leave them go on in wider ones or are left over, never to a dearer route; a dead end and a cut pair too."""
    nodes, edges, _ = lattice
    small = nodes.where("node_id % 41 < 12 and node_id < 492").cache()
    inner = edges.join(small.select(F.col("node_id").alias("src")), "src", "left_semi").join(small.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    inner = inner.where("not (src = 86 and dst = 87)").where("dst <> 300").cache()  # a detour, and a node that nothing leads to
    pairs = spark.createDataFrame([(85, 88), (86, 87), (0, 421), (5, 205), (128, 45), (128, 130), (84, 300), (0, 100000)], "u long, v long")
    for most in (None, 40):
        want = {(r.u, r.v): (r.cost, r.dist_m, r.path) for r in routing.routes(pairs, inner, small, most=most).collect()}
        for widen, tile_edges in ((0, 10**6), (2, 10**6), (0, 60)):
            found, rest = routing.by_tiles(pairs, inner, small, 1.0, 55.0, 55.0, most, 0.006, tile_edges, widen)
            got = {(r.u, r.v): (r.cost, r.dist_m, r.path) for r in found.collect()}
            left = {(r.u, r.v) for r in rest.collect()}
            assert all(got[k] == want[k] for k in got) and set(want) <= set(got) | left and not set(got) & left
            assert (tile_edges > 60 and widen == 2) <= (len(left) < 3)
        assert want
    whole = {(r.u, r.v): r.cost for r in routing.routes(pairs, inner, small, most=None).collect()}
    assert {(r.u, r.v): r.cost for r in routing.routes(pairs, inner, small, most=None, broadcast_edges=0).collect()} == whole


def test_of_a_large_map_only_what_lies_about_the_points_counts(spark, lattice, monkeypatch):
    """Nodes that no point can reach are left out before they are spread over cells, and edges that no search can reach before they are placed."""
    nodes, edges, _ = fx.lattice(spark)
    p = spark.range(40).select(F.col("id").alias("traj_id"), F.lit(0).cast("long").alias("idx"), (108.801 + F.col("id") * 37 % 40 / 8000).alias("lon"), (34.101 + F.col("id") / 8000).alias("lat"), F.lit(20.0).alias("heading"))
    p = p.unionByName(spark.createDataFrame([(99, 0, None, 34.1, None)], "traj_id long, idx long, lon double, lat double, heading double"))
    ask = lambda: (spatial.candidates(p, nodes, 500.0, 4, 55.0, 0.7, 800.0), spatial.with_nearest(p, nodes, 300.0))
    want = [sorted(map(str, df.collect())) for df in ask()]
    assert len(want[1]) == 41 and "traj_id=99, idx=0, lon=None, lat=34.1, heading=None, node_id=None" in "".join(want[1])
    monkeypatch.setattr(spatial, "SMALL", 50)  # of 1681 nodes
    for df, rows in zip(ask(), want):
        assert "BroadcastHashJoin" in df._jdf.queryExecution().sparkPlan().toString() and sorted(map(str, df.collect())) == rows
    monkeypatch.setattr(spatial, "SMALL", 2)
    for df, rows in zip(ask(), want):
        assert "SortMergeJoin" in df._jdf.queryExecution().sparkPlan().toString() and sorted(map(str, df.collect())) == rows
    placed = {}
    monkeypatch.setattr(routing, "settled", lambda df, name: placed.setdefault(name, settled(df, name)))
    routing.by_tiles(spark.createDataFrame([(0, 42), (2, 1)], "u long, v long"), edges, nodes, tile=0.006, widen=0)
    assert 0 < placed["placed"].count() < edges.count() / 3


def test_recoveries_join_no_points(spark, lattice, monkeypatch):
    """Points get their gap, ratio and filling from windows; only nodes near them come from a join. What nobody reads is not written."""
    nodes, edges = (settled(t, "map") for t in lattice[:2])
    line = [(108.80 + 0.0005 * k, 34.105) for k in range(41)]
    rows = [(t, i, 10 * i, *((x, y) if i % 8 == 0 else (None, None)), i % 8 == 0) for t in (1, 2) for i, (x, y) in enumerate(line)]
    p = settled(spark.createDataFrame(rows, "traj_id long, idx long, ts long, lon double, lat double, known boolean"), "p")
    names = []
    monkeypatch.setattr(recovery, "settled", lambda df, name: names.append(name) or settled(df, name))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    m, _ = recovery.recover_map(p, nodes, edges, recovery.MapOptions(match_radius=400.0, max_snap=400.0, max_detour=9.0))
    assert "Join" not in plan(m) and m.count() == len(rows) and m.where("lon is null").isEmpty() and m.columns == ["traj_id", "idx", "ts", "known", "lon", "lat"]
    r = recovery.run_hmm(p, nodes, edges, recovery.HmmOptions(radius=400.0, max_snap=400.0, max_detour=9.0))
    assert plan(r.points).count("Join") == 1 and r.points.count() == len(rows) and r.points.columns == m.columns
    assert sum(x["count"] for x in recovery.counters(r.gaps).collect()) == recovery.statistics(r).first().segments_try_map == 10
    assert not {"filled", "vertices", "transitions", "matched"} & set(names)


def test_statistics_of_short_and_lost_gaps(spark, lattice):
    """A gap below min_gap counts as short although it has a route, and one of a trajectory without candidates as neither."""
    nodes, edges, _ = lattice
    known = {1: (0, 8, 11, 16), 2: (0, 8, 16)}
    rows = [(t, i, 10 * i, 108.80 + 0.0005 * i + (40 if t == 2 else 0) if i in k else None, 34.105 if i in k else None, i in k) for t, k in known.items() for i in range(18)]
    p = spark.createDataFrame(rows, "traj_id long, idx long, ts long, lon double, lat double, known boolean")
    r = recovery.run_hmm(p, nodes, edges, recovery.HmmOptions(radius=400.0, max_snap=400.0, max_detour=9.0))
    why = {(x.traj_id, x.start_idx): (x.reason, x.conf is None, x.alpha is None) for x in r.gaps.collect()}
    assert why[1, 8] == ("short_gap", True, True) and why[1, 0] == (None, False, False) and why[2, 0][0] == why[2, 8][0] == "no_candidates"
    s = recovery.statistics(r).first()
    assert (s.segments_total, s.segments_try_map, s.segments_map_success, s.fallback_no_path, s.fallback_no_candidates) == (3, 2, 1, 1, 2)
    assert r.points.where("known or idx = 17").count() == 9 and r.points.count() == len(rows)
