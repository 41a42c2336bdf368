"""Gaps, interpolation, smoothing and resampling of point sequences.

Input is points(traj_id, idx, ts, lon, lat, known); lon and lat are null where a point is not known. Every
window is partitioned by trajectory. Steps that see earlier results are in ``folds``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, haversine_m, planar_turn_deg
from . import folds


def in_order():
    """Per trajectory in order. (A function: windows need a live session.)"""
    return Window.partitionBy("traj_id").orderBy("idx")


def whole():
    return Window.partitionBy("traj_id")


def back():
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead():
    """Backwards from the end to the current row, as a running frame."""
    return whole().orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def gap_runs(points: DataFrame) -> DataFrame:
    """gap_size: length of the run of unknown points a point lies in, leading and trailing runs included; 0 if known."""
    island = points.withColumn("_k", F.sum(F.col("known").cast("int")).over(back()))
    runs = Window.partitionBy("traj_id", "_k")
    return island.withColumn("gap_size", F.when(F.col("known"), 0).otherwise(F.count_if(~F.col("known")).over(runs)).cast("long")).drop("_k")


def gap_table(points: DataFrame) -> DataFrame:
    """gaps(traj_id, gap_id, start_idx, end_idx, missing_count, delta_t, start_order, end_order): one row per pair
    of neighbouring known points with something missing between; leading and trailing runs are no gaps."""
    k = points.where("known").select("traj_id", "idx", "ts", (F.row_number().over(in_order()) - 1).alias("o"))
    pairs = k.select("traj_id", F.col("idx").alias("start_idx"), F.lead("idx").over(in_order()).alias("end_idx"), "ts", F.lead("ts").over(in_order()).alias("ts2"), "o")
    g = pairs.where("end_idx - start_idx > 1")
    return g.select(
        "traj_id", (F.row_number().over(Window.partitionBy("traj_id").orderBy("start_idx")) - 1).cast("long").alias("gap_id"), "start_idx", "end_idx",
        (F.col("end_idx") - F.col("start_idx") - 1).alias("missing_count"), F.greatest(F.lit(0).cast("long"), F.col("ts2") - F.col("ts")).alias("delta_t"),
        F.col("o").cast("long").alias("start_order"), (F.col("o") + 1).cast("long").alias("end_order"),
    )


def knot(c: Column, before: bool) -> Column:
    """The value at the last known point that has one, up to this one or from this one on: a running fill either way, whose cost
    does not grow with the length of a trajectory."""
    return F.last(F.when(F.col("known"), c), True).over(back() if before else ahead())


def interpolate_linear(points: DataFrame, out: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """Linear in time between known neighbours, the nearest known value beyond them; known points stay as they are."""
    p = points
    for c in ("ts", "lon", "lat"):
        p = p.withColumn(f"_{c}0", knot(F.col(c), True)).withColumn(f"_{c}1", knot(F.col(c), False))
    share = (F.col("ts") - F.col("_ts0")) / F.nullif(F.col("_ts1") - F.col("_ts0"), F.lit(0))
    for c, name in zip(("lon", "lat"), out):
        a, b = F.col(f"_{c}0"), F.col(f"_{c}1")
        p = p.withColumn(f"_{name}", F.when(F.col("known"), F.col(c)).otherwise(F.coalesce(a + (b - a) * F.coalesce(share, F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0))), a, b)))
    return p.select(*[c for c in points.columns if c not in out], *[F.col(f"_{n}").alias(n) for n in out])


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """One-sided three-point slope, cut so that the curve stays monotone."""
    m = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(m) != F.signum(d0), F.lit(0.0)).when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > F.abs(3 * d0)), 3 * d0).otherwise(m)


def interpolate_pchip(points: DataFrame, out: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """Monotone cubic (weighted harmonic slopes) in time over the known points, constant beyond them. Linear where
    a trajectory has fewer than three known points or its known times do not increase."""
    k = points.where("known").select("traj_id", "idx", "ts", "lon", "lat")
    steps = k.withColumn("h", (F.lead("ts").over(in_order()) - F.col("ts")).cast("double"))
    for c in ("lon", "lat"):
        steps = steps.withColumn(f"d_{c}", (F.lead(c).over(in_order()) - F.col(c)) / F.nullif(F.col("h"), F.lit(0.0)))
    h, h0, h_last2 = F.col("h"), F.lag("h").over(in_order()), F.lag("h", 2).over(in_order())
    slopes = steps.withColumn("ok", (F.count("*").over(whole()) >= 3) & F.coalesce(F.min("h").over(whole()) > 0, F.lit(False)))
    for c in ("lon", "lat"):
        d, d0 = F.col(f"d_{c}"), F.lag(f"d_{c}").over(in_order())
        w1, w2 = 2 * h + h0, h + 2 * h0
        inner = F.when(d * d0 <= 0, F.lit(0.0)).otherwise((w1 + w2) / (w1 / d0 + w2 / d))
        first = _end_slope(h, F.lead("h").over(in_order()), d, F.lead(f"d_{c}").over(in_order()))
        last = _end_slope(h0, h_last2, d0, F.lag(f"d_{c}", 2).over(in_order()))
        slopes = slopes.withColumn(f"m_{c}", F.when(h0.isNull(), first).when(h.isNull(), last).otherwise(inner))
    p = interpolate_linear(points, ("_x", "_y")).join(slopes.select("traj_id", "idx", "m_lon", "m_lat", "ok"), ["traj_id", "idx"], "left")
    for c in ("ts", "lon", "lat", "m_lon", "m_lat"):
        p = p.withColumn(f"{c}_0", knot(F.col(c), True)).withColumn(f"{c}_1", knot(F.col(c), False))
    p = p.withColumn("_ok", F.coalesce(F.max("ok").over(whole()), F.lit(False)))
    hi = (F.col("ts_1") - F.col("ts_0")).cast("double")
    t = (F.col("ts") - F.col("ts_0")) / hi
    inside = F.col("_ok") & ~F.col("known") & (hi > 0)
    for c, base, name in zip(("lon", "lat"), ("_x", "_y"), out):
        y = (
            (2 * t * t * t - 3 * t * t + 1) * F.col(f"{c}_0") + (t * t * t - 2 * t * t + t) * hi * F.col(f"m_{c}_0")
            + (-2 * t * t * t + 3 * t * t) * F.col(f"{c}_1") + (t * t * t - t * t) * hi * F.col(f"m_{c}_1")
        )
        p = p.withColumn(f"_o_{name}", F.when(inside, y).otherwise(F.col(base)))
    return p.select(*[c for c in points.columns if c not in out], *[F.col(f"_o_{n}").alias(n) for n in out])


def interpolate(points: DataFrame, mode: str = "linear") -> DataFrame:
    return interpolate_pchip(points) if mode == "pchip" else interpolate_linear(points)


def smooth_gaussian(line: DataFrame, radius: int = 2, sigma: float = 1.0, by: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Gaussian mean over ``radius`` neighbours each side, weights renormalised at the ends; the input is read
    unsmoothed. Lines of fewer than three points stay."""
    import math

    w = Window.partitionBy(*by).orderBy("idx")
    out = line.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    for c in ("lon", "lat"):
        top, bottom = F.lit(0.0), F.lit(0.0)
        for k in range(-radius, radius + 1):
            g = math.exp(-0.5 * (k / max(sigma, 1e-6)) ** 2)
            near = F.lead(c, -k).over(w) if k < 0 else F.lag(c, k).over(w) if k else F.col(c)
            top, bottom = top + F.coalesce(near * g, F.lit(0.0)), bottom + F.when(near.isNotNull(), g).otherwise(0.0)
        out = out.withColumn(f"_{c}", F.when(F.col("_n") < 3, F.col(c)).otherwise(top / bottom))
    return out.select(*[c for c in line.columns if c not in ("lon", "lat")], F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))


def _bear(a: Column, b: Column) -> Column:
    return bearing_deg(a["lon"], a["lat"], b["lon"], b["lat"])


def _turn(a: Column, b: Column, c: Column) -> Column:
    d = F.abs(F.pmod(_bear(b, c) - _bear(a, b) + 180.0, F.lit(360.0)) - 180.0)
    return F.coalesce(d, F.lit(0.0))


def max_turn(line: Column) -> Column:
    """Largest change of bearing at an inner vertex of an array of points; 0 with fewer than three."""
    inner = F.transform(F.sequence(F.lit(1), F.size(line) - 2), lambda i: _turn(F.get(line, i - 1), F.get(line, i), F.get(line, i + 1)))
    return F.when(F.size(line) >= 3, F.array_max(inner)).otherwise(0.0)


def lines_of(points: DataFrame, by: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """One row per line: an array of its points in order."""
    return points.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line"))


def points_from_lines(lines: DataFrame, by: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    return lines.select(*by, F.posexplode("line").alias("idx", "p")).select(*by, F.col("idx").cast("long"), "p.lon", "p.lat")


def _along(by: tuple[str, ...]):
    """Per line in order of idx; rows without idx, which are no vertices, come last."""
    return Window.partitionBy(*by).orderBy(F.col("idx").asc_nulls_last())


def with_lengths(vertices: DataFrame, by: tuple[str, ...] = ("line_id",), slow_turn: float | None = None, least_factor: float = 0.6) -> DataFrame:
    """Vertices with the running abscissa ``s`` and the next vertex (lon2, lat2, s2).

    The abscissa is metres; with slow_turn it is pseudo-time: a leg is slowed by the larger turn at its two ends,
    from full speed at slow_turn degrees down to least_factor at 180."""
    w = _along(by)
    v = vertices.withColumn("lon2", F.lead("lon").over(w)).withColumn("lat2", F.lead("lat").over(w))
    v = v.withColumn("_d", haversine_m("lon", "lat", "lon2", "lat2"))
    if slow_turn is not None:
        v = v.withColumn("_b", bearing_deg("lon", "lat", "lon2", "lat2"))
        v = v.withColumn("_t", F.coalesce(F.abs(F.pmod(F.col("_b") - F.lag("_b").over(w) + 180.0, F.lit(360.0)) - 180.0), F.lit(0.0)))
        turn = F.greatest("_t", F.coalesce(F.lead("_t").over(w), F.lit(0.0)))
        over = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (turn - slow_turn) / max(180.0 - slow_turn, 1e-6)))
        v = v.withColumn("_d", F.col("_d") / (1.0 - over * (1.0 - least_factor))).drop("_b", "_t")
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("s", F.coalesce(F.sum("_d").over(run), F.lit(0.0)))
    return v.withColumn("s2", F.col("s") + F.col("_d")).drop("_d")


def resample(vertices: DataFrame, samples: DataFrame, by: tuple[str, ...] = ("line_id",), slow_turn: float | None = None, least_factor: float = 0.6, keep: tuple[str, ...] = (), of_line: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """Points at given shares of each line's length.

    samples(by…, k, ratio): the ratio is cut to [0, 1]. A line with one vertex, or shorter than 1e-6, repeats its
    first vertex. Vertices and samples are dealt by line once, all together: samples come after the vertices, so the running
    abscissa at a sample is the line's length, and each takes the last vertex at or before its share of it by a running
    fill. No pair of sample and vertex is ever built. The deal is written out, as a union's own partitioning may change while it runs.

    keep names columns of samples that stay with them, of_line columns of vertices that samples take from their line's first one; with
    every, samples of a line without vertices stay, without coordinates."""
    none = lambda df, cs: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cs]
    v = vertices.select(*by, F.lit(0).alias("_o"), F.col("idx").cast("long").alias("idx"), "lon", "lat", F.lit(None).cast("long").alias("k"), F.lit(None).cast("double").alias("ratio"), *of_line, *none(samples, keep))
    q = samples.select(*by, F.lit(1).alias("_o"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), F.col("k").cast("long").alias("k"), F.col("ratio").cast("double").alias("ratio"), *none(vertices, of_line), *keep)
    both = v.unionByName(q).repartition(*by)
    first = F.first(F.when(F.col("_o") == 0, F.struct("lon", "lat", *of_line))).over(_along(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = with_lengths(both.withColumn("_first", first), by, slow_turn, least_factor)
    both = both if every else both.where("_first is not null")
    leg = F.when(F.col("s2").isNotNull(), F.struct("lon", "lat", "lon2", "lat2", "s", "s2"))
    at = F.when(F.col("_o") == 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ratio"))) * F.col("s")).otherwise(F.col("s"))
    both = both.select(*by, "k", "_o", "idx", "_first", *keep, leg.alias("_knot"), F.col("s").alias("_total"), at.alias("s"))
    w = Window.partitionBy(*by).orderBy("s", "_o", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.withColumn("_v", F.last("_knot", True).over(w)).where("_o = 1")
    share = F.coalesce(F.least(F.lit(1.0), (F.col("s") - F.col("_v.s")) / F.nullif(F.col("_v.s2") - F.col("_v.s"), F.lit(0.0))), F.lit(0.0))
    short = F.coalesce(F.col("_total") < 1e-6, F.lit(True)) | F.col("_v").isNull()
    pick = lambda c: F.when(short, F.col(f"_first.{c}")).otherwise(F.col(f"_v.{c}") + (F.col(f"_v.{c}2") - F.col(f"_v.{c}")) * share)
    return at.select(*by, "k", pick("lon").alias("lon"), pick("lat").alias("lat"), *keep, *[F.col(f"_first.{c}").alias(c) for c in of_line])


def even_ratios(lines: DataFrame, n: Column | int, by: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """n evenly spaced ratios per line, both ends included."""
    n = F.lit(n) if isinstance(n, int) else n
    return lines.select(*by, n.alias("_n")).select(*by, "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k")).select(*by, F.col("k").cast("long"), (F.col("k") / F.greatest(F.lit(1), F.col("_n") - 1)).alias("ratio"))


def fill_gaps_from_strokes(gaps: DataFrame, strokes: DataFrame, by: tuple[str, ...] = ("traj_id", "gap_id")) -> DataFrame:
    """Fill each gap along a drawn line: start anchor, finite stroke points, end anchor, resampled evenly and the
    ends dropped. gaps(by…, start_idx, missing_count, lon0, lat0, lon1, lat1); strokes(by…, idx, lon, lat). No stroke gives
    the straight line."""
    ends = gaps.select(*by, F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("idx"), F.col("lon0").alias("lon"), F.col("lat0").alias("lat")), F.struct(F.lit(1 << 40).cast("long").alias("idx"), F.col("lon1").alias("lon"), F.col("lat1").alias("lat")))).alias("p")).select(*by, "p.*")
    drawn = strokes.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)").select(*by, F.col("idx").cast("long"), "lon", "lat")
    lines = folds.dedupe(ends.unionByName(drawn.join(gaps.select(*by), list(by), "left_semi")), by)
    ratios = even_ratios(gaps, (F.col("missing_count") + 2).cast("int"), by)
    got = resample(lines, ratios, by)
    return got.join(gaps.select(*by, "start_idx", "missing_count"), list(by)).where("k between 1 and missing_count").select(*by, (F.col("start_idx") + F.col("k")).alias("idx"), "lon", "lat")


def anchor_headings(points: DataFrame) -> DataFrame:
    """Known points with heading: bearing from the previous to the next known point, one-sided at the ends."""
    k = points.where("known")
    a = lambda c: F.coalesce(F.lag(c).over(in_order()), F.col(c))
    b = lambda c: F.coalesce(F.lead(c).over(in_order()), F.col(c))
    return k.withColumn("heading", bearing_deg(a("lon"), a("lat"), b("lon"), b("lat")))


def steps(points: DataFrame) -> DataFrame:
    """step_m, bearing and turn_deg into and at each point, from its predecessors."""
    p = points.withColumn("step_m", haversine_m(F.lag("lon").over(in_order()), F.lag("lat").over(in_order()), F.col("lon"), F.col("lat")))
    p = p.withColumn("bearing", bearing_deg(F.lag("lon").over(in_order()), F.lag("lat").over(in_order()), F.col("lon"), F.col("lat")))
    return p.withColumn("turn_deg", F.abs(F.pmod(F.lead("bearing").over(in_order()) - F.col("bearing") + 180.0, F.lit(360.0)) - 180.0))


def speed_change(points: DataFrame) -> DataFrame:
    """speed_var: absolute difference of the speeds into and out of a point, time steps of a second at least."""
    into = haversine_m(F.lag("lon").over(in_order()), F.lag("lat").over(in_order()), F.col("lon"), F.col("lat"))
    out = haversine_m(F.col("lon"), F.col("lat"), F.lead("lon").over(in_order()), F.lead("lat").over(in_order()))
    dt0, dt1 = F.greatest(F.lit(1), F.col("ts") - F.lag("ts").over(in_order())), F.greatest(F.lit(1), F.lead("ts").over(in_order()) - F.col("ts"))
    return points.withColumn("speed_var", F.abs(out / dt1 - into / dt0))


def planar_turns(points: DataFrame) -> DataFrame:
    lag, lead = lambda c: F.lag(c).over(in_order()), lambda c: F.lead(c).over(in_order())
    return points.withColumn("turn_angle", planar_turn_deg(lag("lon"), lag("lat"), F.col("lon"), F.col("lat"), lead("lon"), lead("lat")))


def position_ratio(points: DataFrame) -> DataFrame:
    return points.withColumn("position_ratio", F.col("idx") / F.greatest(F.lit(1), F.count("*").over(whole()) - 1))


def in_even_sample(idx: Column, n: Column, most: int) -> Column:
    """Whether a point is among at most ``most`` of n, evenly spaced by index and truncated; all are if there are no more."""
    if most == 1:
        return idx == 0
    i = F.ceil(idx * (most - 1) / F.greatest(F.lit(1), n - 1))  # the only one that can fall on idx, as steps are a point at least
    return (n <= most) | ((i >= 0) & (i <= most - 1) & (F.floor(i * (n - 1) / (most - 1)) == idx))


def even_sample(points: DataFrame, most: int) -> DataFrame:
    """At most ``most`` points per trajectory, evenly spaced."""
    return points.withColumn("_n", F.count("*").over(whole())).where(in_even_sample(F.col("idx"), F.col("_n"), most)).drop("_n")


def finite_runs(points: DataFrame, least: int = 2) -> DataFrame:
    """Points in maximal runs of finite coordinates of at least ``least`` points, with run_id."""
    ok = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
    p = points.withColumn("_ok", ok).withColumn("run_id", F.sum((~F.col("_ok")).cast("long")).over(back()))
    return p.where("_ok").withColumn("_n", F.count("*").over(Window.partitionBy("traj_id", "run_id"))).where(F.col("_n") >= least).drop("_n", "_ok")


def player_start(points: DataFrame) -> DataFrame:
    """Start of a manual filling: unknown points have no coordinates."""
    return points.withColumn("lon", F.when(F.col("known"), F.col("lon"))).withColumn("lat", F.when(F.col("known"), F.col("lat")))


def completion(points: DataFrame) -> DataFrame:
    """Per trajectory: missing points, how many are filled, and whether all are."""
    filled = F.count_if(~F.col("known") & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return points.groupBy("traj_id").agg(F.count_if(~F.col("known")).alias("total_missing"), filled.alias("filled")).withColumn("is_complete", F.col("filled") == F.col("total_missing"))
