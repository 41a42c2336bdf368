"""Recovery of unknown points: by road routes between anchors, and by hidden-Markov map matching."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_diff_deg, bearing_deg, haversine_m
from ..sources.work import settled
from . import decode, folds, routing, sequence as seq, spatial

KEY = ("traj_id", "start_idx")


# The parameters of both recoveries.
@dataclass(frozen=True)
class MapOptions:
    min_gap: int = 4
    match_radius: float = 220.0
    max_snap: float = 90.0
    max_settled: int | None = 6000
    max_detour: float = 2.0
    min_speed: float = 0.3
    max_speed: float = 35.0
    blend: float = 0.7


@dataclass(frozen=True)
class HmmOptions:
    k: int = 4
    radius: float = 140.0
    fallback: float | None = 260.0
    sigma: float = 55.0
    heading_weight: float = 0.7
    min_gap: int = 4
    max_settled: int | None = 7000
    class_weight: float = 1.0
    turn_penalty_m: float = 55.0
    turn_threshold_deg: float = 55.0
    w_detour: float = 3.0
    w_speed: float = 1.5
    w_turn: float = 0.5
    no_path: float = 8.0
    max_snap: float = 90.0
    max_detour: float = 2.8
    min_speed: float = 0.25
    max_speed: float = 48.0
    snap_radius: float = 45.0
    alpha: tuple[float, float] = (0.45, 0.90)
    pure: float = 0.85
    small_gap: int = -1
    small_gap_alpha_max: float = 0.65
    large_gap: int = -1
    large_gap_alpha_min: float = 0.70
    large_gap_pure: float = 0.75
    conf_sigma: tuple[float, float, float] = (55.0, 1.6, 1.2)
    interpolation: str = "linear"
    speed_aware: bool = False
    slow_turn_deg: float = 30.0
    least_speed_factor: float = 0.6
    fusion: str = "legacy"
    fusion_power: float = 1.0
    fusion_gap_bias: float = 0.0
    fusion_snap_conf: float = 0.7
    low_conf: float = -1.0
    low_conf_alpha_cap: float = 0.5
    smooth_below: float = -1.0
    smooth_radius: int = 2
    smooth_sigma: float = 1.0
    smooth_strength: float = 1.0
    limit_above_speed_dev: float = -1.0
    limit_turn_deg: float = -1.0
    limit_sweeps: int = 1
    limit_strength: float = 1.0
    bind: str = "off"
    bind_conf: float = 0.35
    bind_min_gap: int = 0
    bind_radius: float = 0.0
    sharp_turn_deg: float = -1.0
    sharp_alpha_min: float = 0.9
    sharp_conf: float = 0.2
    sharp_tolerance_deg: float = 45.0
    drop_zero_legs: bool = False


def _clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def recover_linear(points: DataFrame) -> DataFrame:
    return seq.interpolate_linear(points)


def _in_gaps(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples(KEY, k = idx, ratio, the columns of base, its lon and lat as _bx, _by), rows of base outside of gaps). A sample is a missing
    point between known ones; its ratio is the time share of its gap, the index share without time. Both come from running fills."""
    end = F.struct("idx", "ts")
    b = base.withColumn("_a", seq.knot(end, True)).withColumn("_z", seq.knot(end, False))
    inside = F.coalesce(~F.col("known") & F.col("_a").isNotNull() & F.col("_z").isNotNull() & F.col("traj_id").isNotNull(), F.lit(False))
    dt, start = F.col("_z.ts") - F.col("_a.ts"), F.col("_a.idx")
    ratio = F.when(dt <= 0, (F.col("idx") - start) / (F.col("_z.idx") - start)).otherwise((F.col("ts") - F.col("_a.ts")) / dt)
    rest = [c for c in base.columns if c not in ("traj_id", "idx", "lon", "lat")]
    return b.where(inside).select("traj_id", start.alias("start_idx"), F.col("idx").alias("k"), ratio.alias("ratio"), *rest, F.col("lon").alias("_bx"), F.col("lat").alias("_by")), b.where(~inside).select("traj_id", "idx", *rest, "lon", "lat")


def _vertices(routed: DataFrame, first: tuple[str, str], last: tuple[str, str], *more: str) -> DataFrame:
    """Vertices (KEY, idx, lon, lat) of anchor, route nodes, anchor; the first one also has the gap's columns ``more``."""
    end = lambda c: F.array(F.struct(F.col(c[0]).alias("lon"), F.col(c[1]).alias("lat")))
    v = routed.select(*KEY, *more, F.posexplode(F.concat(end(first), "path", end(last))).alias("i", "p"))
    return v.select(*KEY, F.col("i").cast("long").alias("idx"), "p.lon", "p.lat", *[F.when(F.col("i") == 0, F.col(c)).alias(c) for c in more])


def _gap_ends(anchors: DataFrame, *more: str) -> DataFrame:
    """Gaps between neighbouring known points, with both ends' coordinates, times and columns ``more``, from one window."""
    cols = {"ts": "ts", "lon": "lon", "lat": "lat"} | {c: c for c in more}
    ends = [x for c in cols for x in (F.col(c).alias(f"{c}0"), F.lead(c).over(seq.in_order()).alias(f"{c}1"))]
    g = anchors.select("traj_id", F.col("idx").alias("start_idx"), F.lead("idx").over(seq.in_order()).alias("end_idx"), *ends).where("traj_id is not null and end_idx - start_idx > 1")
    return g.withColumn("missing_count", F.col("end_idx") - F.col("start_idx") - 1)


def _routed(g: DataFrame, r: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gaps with dist_m and path, the places of the route between their nodes n0 and n1. Places are looked up once per route in use."""
    used = r.join(g.select(F.col("n0").alias("u"), F.col("n1").alias("v")).distinct(), ["u", "v"], "left_semi")
    node = used.select("u", "v", "dist_m", F.posexplode("path").alias("i", "node_id")).join(nodes.select("node_id", "lon", "lat"), "node_id")
    line = F.transform(F.sort_array(F.collect_list(F.struct("i", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    lines = settled(node.groupBy(F.col("u").alias("n0"), F.col("v").alias("n1")).agg(F.first("dist_m").alias("dist_m"), line.alias("path")), "lines")
    return g.join(lines, ["n0", "n1"], "left")


def _gates(g: DataFrame, o) -> DataFrame:
    """Route length, speed, detour, and the reason why a gap keeps its interpolation (null: it takes the route)."""
    g = g.withColumn("straight", haversine_m("lon0", "lat0", "lon1", "lat1")).withColumn("dt", F.greatest(F.lit(1), F.col("ts1") - F.col("ts0")).cast("double"))
    g = g.withColumn("route_m", F.greatest("dist_m", "straight")).withColumn("speed", F.col("route_m") / F.col("dt")).withColumn("detour", F.col("route_m") / F.greatest("straight", F.lit(1e-6)))
    why = (
        F.when(F.col("n0").isNull() | F.col("n1").isNull(), "no_match").when(F.col("path").isNull() | (F.size("path") < 2), "no_path")
        .when((F.col("snap0") > o.max_snap) | (F.col("snap1") > o.max_snap), "snap_too_far").when(F.col("detour") > o.max_detour, "detour_too_large")
        .when(F.col("speed") < o.min_speed, "speed_too_low").when(F.col("speed") > o.max_speed, "speed_too_high")
    )
    return g.withColumn("reason", why)


def recover_map(points: DataFrame, nodes: DataFrame, edges: DataFrame, o: MapOptions = MapOptions()) -> tuple[DataFrame, DataFrame]:
    """(points filled, gaps with their reason). Every gap of at least min_gap points is routed between the nodes nearest
    to its anchors; an accepted route is sampled at the time shares and blended with the linear filling."""
    a = spatial.with_nearest(points.where("known").select("traj_id", "idx", "ts", "lon", "lat"), nodes, o.match_radius)
    a = a.select("traj_id", "idx", "ts", "lon", "lat", F.col("node_id").alias("n"), F.col("snap_m").alias("snap"))
    g = settled(_gap_ends(a, "n", "snap").where(F.col("missing_count") >= o.min_gap), "ends")
    r = routing.routes(g.where("n0 is not null and n1 is not null").select(F.col("n0").alias("u"), F.col("n1").alias("v")), edges, nodes, 0.0, 0.0, 55.0, o.max_settled)
    g = settled(_gates(_routed(g, r, nodes), o), "gaps")
    base = seq.interpolate_linear(points)
    samples, rest = _in_gaps(base)
    keep = (*[c for c in rest.columns if c not in ("traj_id", "idx", "lon", "lat")], "_bx", "_by")
    f = seq.resample(_vertices(g.where("reason is null"), ("lon0", "lat0"), ("lon1", "lat1")), samples, KEY, keep=keep, every=True).withColumnRenamed("k", "idx")
    blend = lambda c, b: F.coalesce(o.blend * F.col(c) + (1 - o.blend) * F.col(b), F.col(b)).alias(c)
    return rest.unionByName(f.select("traj_id", "idx", *keep[:-2], blend("lon", "_bx"), blend("lat", "_by"))), g.select(*KEY, "end_idx", "missing_count", "reason")


def transition_cost(o: HmmOptions) -> Column:
    """Cost of one candidate pair from straight, dt, dist_m (null: no route), and the headings of anchors and nodes."""
    ref = F.greatest(F.col("straight") / F.col("dt"), F.lit(0.1))
    route = F.greatest("dist_m", "straight")
    speed = F.abs(route / F.col("dt") - ref) / F.greatest(ref, F.lit(0.5))
    turn = F.coalesce(angle_diff_deg(bearing_deg("p_lon", "p_lat", "c_lon", "c_lat"), bearing_deg("lon0", "lat0", "lon1", "lat1")) / 180.0, F.lit(0.0))
    cost = o.w_detour * (route / F.greatest("straight", F.lit(1e-6)) - 1.0) + o.w_speed * speed + o.w_turn * turn
    return F.when(F.col("dist_m").isNull(), o.no_path).otherwise(cost)


def viterbi(steps: DataFrame) -> DataFrame:
    """traj_id, cost, states: the cheapest sequence of candidates in one array; ``decode.states`` has it as rows.

    steps(traj_id, o, emit array, trans array of arrays [candidate][candidate before]); o = 0 has no trans. Ties take the
    lowest candidate."""
    way, cost = decode.states(steps)
    line = way.groupBy("traj_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "state"))), lambda x: x["state"]).alias("states"))
    return cost.join(line, "traj_id")


def match(points: DataFrame, nodes: DataFrame, edges: DataFrame, o: HmmOptions = HmmOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen candidate per anchor, routes, trajectories that failed). A trajectory needs two anchors and a candidate for
    each. Routes are found once per distinct node pair."""
    a = seq.anchor_headings(points).withColumn("o", (F.row_number().over(seq.in_order()) - 1).cast("int"))
    a = settled(a.select("traj_id", "idx", "ts", "o", "lon", "lat", "heading"), "anchors")
    c = settled(spatial.candidates(a, nodes, o.radius, o.k, o.sigma, o.heading_weight, o.fallback, more=("o", "ts", "lon", "lat")), "candidates")
    per = a.groupBy("traj_id").agg(F.count("*").alias("n")).join(c.groupBy("traj_id").agg(F.count_if(F.col("rank") == 0).alias("m")), "traj_id", "left")
    failed = per.where("n >= 2 and (m is null or m < n)").select("traj_id", "n")
    c = c.join(settled(per.where("n >= 2 and m = n").select("traj_id"), "good"), "traj_id", "left_semi")
    # dealt by trajectory once: an anchor's candidates are one row, beside those of the anchor before it, and their pairs stay in their task
    at = lambda n: F.first(n).alias(n)
    step = c.repartition("traj_id").groupBy("traj_id", "o").agg(at("ts"), at("lon"), at("lat"), F.collect_list(F.struct("rank", "emit", "node_id", "node_lon", "node_lat")).alias("cs"))
    step = step.withColumn("_b", F.lag(F.struct("ts", "lon", "lat", "cs")).over(Window.partitionBy("traj_id").orderBy("o")))
    pairs = step.select("traj_id", "o", "ts", "lon", "lat", "_b", F.explode("cs").alias("c")).select("traj_id", "o", "ts", "lon", "lat", "_b", "c", F.explode_outer("_b.cs").alias("p"))
    pairs = pairs.select(
        "traj_id", "o", F.col("c.rank").alias("rank"), F.col("c.emit").alias("emit"), F.col("c.node_id").alias("v"), F.col("c.node_lon").alias("c_lon"), F.col("c.node_lat").alias("c_lat"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"),
        F.col("ts").alias("ts1"), F.col("p.rank").alias("p"), F.col("p.node_id").alias("u"), F.col("p.node_lon").alias("p_lon"), F.col("p.node_lat").alias("p_lat"), F.col("_b.lon").alias("lon0"), F.col("_b.lat").alias("lat0"), F.col("_b.ts").alias("ts0"))
    r = routing.routes(pairs.where("u is not null").select("u", "v"), edges, nodes, o.class_weight, o.turn_penalty_m, o.turn_threshold_deg, o.max_settled)
    t = pairs.join(settled(r.select("u", "v", "dist_m"), "lengths"), ["u", "v"], "left")
    t = t.withColumn("straight", haversine_m("lon0", "lat0", "lon1", "lat1")).withColumn("dt", F.greatest(F.lit(1), F.col("ts1") - F.col("ts0")).cast("double"))
    before = F.when(F.col("p").isNotNull(), F.struct("p", transition_cost(o).alias("c")))  # the first anchor has none before it
    row = t.groupBy("traj_id", "o", "rank").agg(at("emit"), F.transform(F.sort_array(F.collect_list(before)), lambda x: x["c"]).alias("t"))
    line = row.groupBy("traj_id", "o").agg(F.sort_array(F.collect_list(F.struct("rank", "emit", "t"))).alias("s"))
    way, _ = decode.states(line.select("traj_id", "o", F.transform("s", lambda x: x["emit"]).alias("emit"), F.when(F.col("o") > 0, F.transform("s", lambda x: x["t"])).alias("trans")))
    way = way.select("traj_id", F.col("o").cast("int").alias("o"), F.col("state").alias("rank"))
    chosen = c.join(way, ["traj_id", "o", "rank"]).select("traj_id", "idx", "node_id", "node_lon", "node_lat", "snap_m")
    return chosen, r, failed


def gap_position(gap: Column, o: HmmOptions) -> Column:
    """Where a gap lies between small and large, in [0, 1]."""
    if o.small_gap >= 0 and o.large_gap > o.small_gap:
        return _clip((gap - o.small_gap) / float(o.large_gap - o.small_gap))
    if o.large_gap > 0:
        return _clip(gap / float(o.large_gap))
    if o.small_gap >= 0:
        return F.when(gap <= o.small_gap, 0.0).otherwise(1.0)
    return F.lit(0.5)


def confidence(snap: Column, detour: Column, speed_dev: Column, o: HmmOptions) -> Column:
    a, b, c = (max(1e-6, x) for x in o.conf_sigma)
    return F.exp(-snap / a) * F.exp(-F.greatest(F.lit(0.0), detour - 1.0) / b) * F.exp(-speed_dev / c)


def fusion(g: DataFrame, o: HmmOptions) -> DataFrame:
    """Adds conf (as the rules see it), alpha and snap_radius to gaps(missing_count, raw_conf)."""
    gap, conf = F.col("missing_count"), _clip(F.col("raw_conf"))
    lo, hi, pure = F.lit(o.alpha[0]), F.lit(o.alpha[1]), F.lit(o.pure)
    if o.small_gap >= 0:
        small = gap <= o.small_gap
        hi, pure = F.when(small, F.least(hi, F.lit(o.small_gap_alpha_max))).otherwise(hi), F.when(small, F.greatest(pure, F.lit(1.1))).otherwise(pure)
    if o.large_gap >= 0:
        large = gap >= o.large_gap
        lo, pure = F.when(large, F.greatest(lo, F.lit(o.large_gap_alpha_min))).otherwise(lo), F.when(large, F.least(pure, F.lit(o.large_gap_pure))).otherwise(pure)
    g = g.withColumn("_lo", _clip(lo)).withColumn("_hi", F.greatest(_clip(hi), _clip(lo))).withColumn("_pure", pure)
    if o.fusion == "continuous":
        g = g.withColumn("conf", _clip(conf + o.fusion_gap_bias * (2 * gap_position(gap, o) - 1)))
        curve = F.pow("conf", F.lit(max(1e-6, o.fusion_power)))
        shrink = _clip((o.fusion_snap_conf - F.col("conf")) / max(1e-6, o.fusion_snap_conf)) if o.snap_radius > 0 and o.fusion_snap_conf > 0 else F.lit(1.0)
        radius = o.snap_radius * shrink
    else:
        g = g.withColumn("conf", conf)
        curve, radius = F.col("conf"), F.lit(o.snap_radius)
    ramp = F.greatest(F.col("_lo"), F.least(F.col("_hi"), F.col("_lo") + (F.col("_hi") - F.col("_lo")) * curve))
    alpha = F.when(F.col("conf") >= F.col("_pure"), 1.0).otherwise(ramp)
    if o.low_conf >= 0:
        alpha = F.when(F.col("conf") < o.low_conf, F.least(alpha, F.lit(min(1.0, max(0.0, o.low_conf_alpha_cap))))).otherwise(alpha)
    return g.withColumn("alpha", alpha).withColumn("snap_radius", radius.cast("double")).drop("_lo", "_hi", "_pure")


@dataclass(frozen=True)
class Recovered:
    """points: filled; gaps: each with its reason, conf and alpha; failed(traj_id, n): trajectories of n anchors of which one has
    no candidate."""

    points: DataFrame
    gaps: DataFrame
    failed: DataFrame


def recover_hmm(points: DataFrame, nodes: DataFrame, edges: DataFrame, o: HmmOptions = HmmOptions()) -> tuple[DataFrame, DataFrame]:
    """(points filled, gaps with their reason) of run_hmm."""
    r = run_hmm(points, nodes, edges, o)
    return r.points, r.gaps


def run_hmm(points: DataFrame, nodes: DataFrame, edges: DataFrame, o: HmmOptions = HmmOptions()) -> Recovered:
    """Map matching of the anchors, then per gap route, gates, sampling, snapping, blend, and the optional smoothing,
    curvature limit and binding, in this order; known points stay."""
    chosen, r, failed = match(points, nodes, edges, o)
    failed = settled(failed, "failed")
    a = points.where("known").select("traj_id", "idx", "ts", "lon", "lat").join(chosen.select("traj_id", "idx", F.col("node_id").alias("n"), F.col("node_lon").alias("slon"), F.col("node_lat").alias("slat"), F.col("snap_m").alias("snap")), ["traj_id", "idx"], "left")
    g = _gates(_routed(settled(_gap_ends(a, "n", "slon", "slat", "snap"), "ends"), r, nodes), o)
    ref = F.greatest(F.col("straight") / F.col("dt"), F.lit(0.1))
    g = g.withColumn("speed_dev", F.abs(F.col("speed") - ref) / F.greatest(ref, F.lit(0.5)))
    g = fusion(g.withColumn("raw_conf", confidence((F.col("snap0") + F.col("snap1")) / 2, F.col("detour"), F.col("speed_dev"), o)), o)
    tried = F.col("missing_count") >= o.min_gap
    g = settled(g.withColumn("reason", F.when(~tried, "short_gap").otherwise(F.col("reason"))), "gaps")
    reasons = g.join(failed.select("traj_id", F.lit(True).alias("_f")), "traj_id", "left").select(
        *KEY, "end_idx", "missing_count", F.when(F.col("_f"), "no_candidates").otherwise(F.col("reason")).alias("reason"), *[F.when(tried, F.col(c)).alias(c) for c in ("conf", "alpha")])
    ok, ends = g.where("reason is null"), (("slon0", "slat0"), ("slon1", "slat1"))
    vertices = _vertices(ok, *ends)
    if o.sharp_turn_deg >= 0:
        ok = _sharp_turns(points, ok, vertices, o)
    post = (o.smooth_below >= 0 and o.smooth_radius > 0) or (o.limit_above_speed_dev >= 0 and o.limit_turn_deg >= 0) or o.bind != "off"
    more = ("missing_count", "alpha", "conf", "speed_dev", "snap_radius") if post else ("alpha", "snap_radius")
    base = seq.interpolate(points, o.interpolation)
    samples, rest = _in_gaps(base.withColumnsRenamed({c: f"_{c}" for c in more if c in base.columns}))
    keep = (*[c for c in rest.columns if c not in ("traj_id", "idx", "lon", "lat")], "_bx", "_by")
    f = seq.resample(_vertices(ok, *ends, *more), samples, KEY, o.slow_turn_deg if o.speed_aware else None, o.least_speed_factor, keep, more, True).withColumnRenamed("k", "idx")
    f = spatial.snap(f, nodes, ("snap_radius", o.snap_radius), within=vertices)  # a place on a leg lies in the box of its ends
    f = f.withColumn("lon", F.col("alpha") * F.col("lon") + (1 - F.col("alpha")) * F.col("_bx")).withColumn("lat", F.col("alpha") * F.col("lat") + (1 - F.col("alpha")) * F.col("_by"))
    plain = lambda df: df.select("traj_id", "idx", *keep[:-2], F.coalesce("lon", "_bx").alias("lon"), F.coalesce("lat", "_by").alias("lat"))
    named = lambda df: df.withColumnsRenamed({f"_{c}": c for c in more if c in base.columns})
    if not post:
        return Recovered(named(rest.unionByName(plain(f))), reasons, failed)
    f = settled(f, "filled")
    rest, f = rest.unionByName(plain(f.where("lon is null or lat is null"))), f.where("lon is not null and lat is not null")
    if o.smooth_below >= 0 and o.smooth_radius > 0:
        s = seq.smooth_gaussian(f, o.smooth_radius, o.smooth_sigma, KEY).select(*KEY, "idx", F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
        f = _toward(f, s, (F.col("conf") < o.smooth_below) & (F.col("missing_count") >= 3), o.smooth_strength)
    if o.limit_above_speed_dev >= 0 and o.limit_turn_deg >= 0:
        s = folds.limit_turns(f.select(*KEY, "idx", "lon", "lat"), o.limit_turn_deg, o.limit_sweeps, KEY).select(*KEY, "idx", F.col("lon").alias("_sx"), F.col("lat").alias("_sy"))
        f = _toward(f, s, (F.col("speed_dev") >= o.limit_above_speed_dev) & (F.col("missing_count") >= 3), o.limit_strength)
    if o.bind != "off":
        allowed = {"all": F.lit(True), "high-conf": F.col("conf") >= o.bind_conf, "low-conf": F.col("conf") < o.bind_conf}[o.bind] & (F.col("missing_count") >= max(0, o.bind_min_gap))
        radius = o.bind_radius if o.bind_radius > 0 else o.snap_radius
        f = spatial.snap(settled(f.withColumn("_r", F.when(allowed, F.lit(float(radius))).otherwise(0.0)), "bound"), nodes, ("_r", radius)).drop("_r")
    return Recovered(named(rest.unionByName(plain(f))), reasons, failed)


def _toward(f: DataFrame, s: DataFrame, where: Column, strength: float) -> DataFrame:
    w = min(1.0, max(0.0, strength))
    j = f.join(s, [*KEY, "idx"], "left")
    mix = lambda c, n: F.when(where & F.col(n).isNotNull(), (1 - w) * F.col(c) + w * F.col(n)).otherwise(F.col(c)).alias(c)
    return j.select(*[c for c in f.columns if c not in ("lon", "lat")], mix("lon", "_sx"), mix("lat", "_sy"))


def _sharp_turns(points: DataFrame, ok: DataFrame, vertices: DataFrame, o: HmmOptions) -> DataFrame:
    """Raise alpha where the route turns sharply and leaves and enters along the observed headings. The snapped end
    repeats the route's end node, so those legs have no bearing and agree with everything, unless drop_zero_legs."""
    lines = seq.lines_of(folds.dedupe(vertices, KEY) if o.drop_zero_legs else vertices, KEY)
    bear = lambda a, b: bearing_deg(a["lon"], a["lat"], b["lon"], b["lat"])
    at = lambda i: F.try_element_at("line", F.lit(i))
    lines = lines.select(*KEY, seq.max_turn(F.col("line")).alias("_turn"), bear(at(1), at(2)).alias("_r0"), bear(at(-2), at(-1)).alias("_r1"))
    h = seq.anchor_headings(points).select("traj_id", "idx", "heading")
    j = ok.join(lines, list(KEY), "left")
    j = j.join(h.select("traj_id", F.col("idx").alias("start_idx"), F.col("heading").alias("_h0")), ["traj_id", "start_idx"], "left").join(h.select("traj_id", F.col("idx").alias("end_idx"), F.col("heading").alias("_h1")), ["traj_id", "end_idx"], "left")
    tol = min(180.0, max(0.0, o.sharp_tolerance_deg))
    agree = lambda a, b: F.coalesce(angle_diff_deg(F.col(a), F.col(b)) <= tol, F.lit(True))
    sharp = (F.col("_turn") >= o.sharp_turn_deg) & (F.col("conf") >= o.sharp_conf) & agree("_h0", "_r0") & agree("_h1", "_r1")
    return j.withColumn("alpha", F.when(sharp, F.greatest("alpha", F.lit(min(1.0, max(0.0, o.sharp_alpha_min))))).otherwise(F.col("alpha"))).select(*ok.columns)


def counters(reasons: DataFrame) -> DataFrame:
    """How many gaps ended in which way; null reason: taken from the map."""
    return reasons.groupBy(F.coalesce("reason", F.lit("map")).alias("outcome")).agg(F.count("*").alias("count"))


def statistics(r: Recovered) -> DataFrame:
    """One row of ten counters. A trajectory without candidates counts all its pairs of neighbouring anchors as
    ``fallback_no_candidates`` and none of its gaps; ``fallback_low_confidence`` is the sum of the four gates."""
    g = r.gaps.where("reason is null or reason <> 'no_candidates'")
    is_ = lambda *names: F.count_if(F.coalesce(F.col("reason").isin(*names), F.lit(False)))
    gates = ("snap_too_far", "detour_too_large", "speed_too_low", "speed_too_high")
    one = g.agg(
        F.count("*").alias("segments_total"), F.count_if(F.coalesce(F.col("reason") != "short_gap", F.lit(True))).alias("segments_try_map"), F.count_if(F.col("reason").isNull()).alias("segments_map_success"),
        is_("no_path", "no_match").alias("fallback_no_path"), is_(*gates).alias("fallback_low_confidence"), *[is_(n).alias(f"fallback_{n}") for n in gates])
    lost = r.failed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("fallback_no_candidates"))
    return one.join(lost, F.lit(True))  # one row each


__all__ = ["HmmOptions", "MapOptions", "confidence", "counters", "fusion", "gap_position", "match", "recover_hmm", "recover_linear", "recover_map", "replace", "run_hmm", "statistics", "transition_cost", "viterbi"]
