"""Errors, bucket summaries, coverage, study metrics. Percentiles are exact and linearly interpolated; those of large
groups are read from rows sorted over all tasks (``quantiles``), so no task has to hold a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import buckets
from ..functions.geo import haversine_m
from ..sources.work import settled
from . import sequence as seq

TAILS = {"p75": 0.75, "p95": 0.95}


def quantiles(df: DataFrame, value: str, qs: dict[str, float], *by: str) -> DataFrame:
    """by, and for each name in qs that quantile of value in the group; nulls do not count.

    Equal values of a group are counted first, so a value is one row however often it comes. These are dealt by range; counts
    per range and group give the rank at which each range begins. Only values at the two ranks next to a quantile contribute, so only
    ranges that hold such a rank are counted through."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    rows = settled(rows.repartitionByRange(parts, *by, "_v").withColumn("_p", F.spark_partition_id()), "ranges")  # ranges are drawn from a sample, so they are fixed before they are counted
    group = [F.col(c) for c in by] or [F.lit(0)]
    count = rows.groupBy("_p", *by).agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = count.select(F.col("_p").alias("_q"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], before.alias("_before"), F.sum("_m").over(Window.partitionBy(*group)).alias("_all"), "_m")
    ranks = {name: q * (F.col("_all") - 1) for name, q in qs.items()}
    inside = lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_m"))
    count = count.where(reduce(lambda a, b: a | b, [inside(F.floor(at)) | inside(F.floor(at) + 1) for at in ranks.values()])).drop("_m")
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_p", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = rows.join(count, same).withColumn("_r", inner).withColumn("_k", F.col("_r") + F.col("_before"))
    weights = {}
    for name, at in ranks.items():
        low = F.floor(at)
        holds = lambda k: (k >= F.col("_k")) & (k < F.col("_k") + F.col("_n"))
        weights[name] = F.when(holds(low), 1 - (at - low)).otherwise(0.0) + F.when(holds(low + 1), at - low).otherwise(0.0)
    some = r.select(*by, "_v", *[w.alias(n) for n, w in weights.items()]).where(F.greatest(*qs, F.lit(0.0)) > 0)
    return some.groupBy(*by).agg(*[F.sum(F.when(F.col(n) > 0, F.col("_v") * F.col(n))).alias(n) for n in qs])


def _with_tails(df: DataFrame, aggs: list[Column], value: str, qs: dict[str, float], *by: str) -> DataFrame:
    """Aggregates and quantiles per group. df is read twice, so it should be a written table."""
    q = quantiles(df, value, qs, *by).select(*[F.col(c).alias(f"_{c}") for c in by], *qs)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.groupBy(*by).agg(*aggs).join(F.broadcast(q) if not by else q, same, "left").drop(*[f"_{c}" for c in by])


def recovery_errors(inputs: DataFrame, predicted: DataFrame, truth: DataFrame, strict: bool = True) -> DataFrame:
    """error_m of every unknown point: inputs ⋈ predicted ⋈ truth on (traj_id, idx).

    strict keeps unknown points that lack a prediction or truth, with a null error, so the caller can see them."""
    how = "left" if strict else "inner"
    p = predicted.select("traj_id", "idx", F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    t = truth.select("traj_id", "idx", F.col("lon").alias("_tlon"), F.col("lat").alias("_tlat"))
    j = inputs.where(~F.col("known")).select("traj_id", "idx").join(p, ["traj_id", "idx"], how).join(t, ["traj_id", "idx"], how)
    return j.select("traj_id", "idx", haversine_m("_plon", "_plat", "_tlon", "_tlat").alias("error_m"))


def unmatched(inputs: DataFrame, other: DataFrame) -> DataFrame:
    """Trajectories of inputs that other lacks."""
    return inputs.select("traj_id").distinct().join(other.select("traj_id"), "traj_id", "left_anti")


def point_facts(inputs: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Fact rows of unknown points: error_m, gap_size, turn_angle, position_ratio, traj_length, speed_var."""
    gaps = seq.gap_runs(inputs).where(~F.col("known")).select("traj_id", "idx", "gap_size")
    shape = seq.position_ratio(seq.planar_turns(seq.speed_change(truth)))
    shape = shape.withColumn("traj_length", F.count("*").over(seq.whole())).select("traj_id", "idx", "turn_angle", "speed_var", "position_ratio", "traj_length", F.col("lon").alias("_tlon"), F.col("lat").alias("_tlat"))
    p = predicted.select("traj_id", "idx", F.col("lon").alias("_plon"), F.col("lat").alias("_plat"))
    j = gaps.join(shape, ["traj_id", "idx"]).join(p, ["traj_id", "idx"])
    return j.select("traj_id", "idx", haversine_m("_plon", "_plat", "_tlon", "_tlat").alias("error_m"), "gap_size", "turn_angle", "position_ratio", "traj_length", "speed_var")


def facts_in_place(points: DataFrame) -> DataFrame:
    """``point_facts`` of the linear recovery where truth and known flag lie in one table: points(traj_id, idx, ts, lon, lat, known). Dealt
    by trajectory once, without joins."""
    p = seq.interpolate_linear(seq.gap_runs(points), ("_plon", "_plat"))
    p = seq.position_ratio(seq.planar_turns(seq.speed_change(p))).withColumn("traj_length", F.count("*").over(seq.whole())).where(~F.col("known"))
    return p.select("traj_id", "idx", haversine_m("_plon", "_plat", "lon", "lat").alias("error_m"), "gap_size", "turn_angle", "position_ratio", "traj_length", "speed_var")


def trajectory_mae(inputs: DataFrame, facts: DataFrame) -> DataFrame:
    """MAE per trajectory; one without unknown points has MAE 0."""
    ids = inputs.select("traj_id").distinct()
    return ids.join(facts.groupBy("traj_id").agg(F.avg("error_m").alias("mae")), "traj_id", "left").select("traj_id", F.coalesce("mae", F.lit(0.0)).alias("mae"))


def error_aggs(e: str = "error_m") -> list[Column]:
    return [F.count(e).alias("count"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(F.col(e) * F.col(e))).alias("rmse")]


def summary(facts: DataFrame, *by: str) -> DataFrame:
    """count, mae, rmse, p75, p95 of error_m per group."""
    return _with_tails(settled(facts.select(*by, "error_m"), "errors"), error_aggs(), "error_m", TAILS, *by)


def speed_edges(facts: DataFrame, value: str = "speed_var") -> DataFrame:
    """One row (low, high): quantiles 0.33 and 0.66 of the whole set; 1 and 3 if there are fewer than 100
    values; the extremes if the quantiles coincide, and 1 and 3 again if those do."""
    v = _with_tails(facts, [F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")], value, {f"q{i}": q for i, q in enumerate(buckets.SPEED_QUANTILES)})
    few, flat, same = F.col("n") < 100, F.col("q1") - F.col("q0") < 1e-9, F.col("hi") - F.col("lo") < 1e-9
    pick = lambda fixed, ends, q: F.when(few | (flat & same), F.lit(fixed)).when(flat, F.col(ends)).otherwise(F.col(q))
    return v.select(pick(1.0, "lo", "q0").alias("low"), pick(3.0, "hi", "q1").alias("high"))


def bucket_report(facts: DataFrame, ratio: int, dataset: str | None = None) -> DataFrame:
    """dataset, dimension, bucket, count, mae, rmse, p75, p95 over five dimensions; the facts are computed once."""
    facts = settled(facts.select("error_m", "gap_size", "turn_angle", "position_ratio", "traj_length", "speed_var"), "facts")
    edges = F.broadcast(speed_edges(facts))  # one row
    f = facts.join(edges, F.lit(True))
    dims = {
        "gap_size": buckets.gap_bucket("gap_size", ratio), "turn_angle": buckets.turn_bucket("turn_angle"), "position": buckets.position_bucket("position_ratio"),
        "traj_length": buckets.length_bucket("traj_length"), "speed_var": buckets.speed_bucket("speed_var", "low", "high"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), b.alias("bucket")) for d, b in dims.items()])).alias("x")
    return summary(f.select("error_m", rows).select("error_m", "x.dimension", "x.bucket"), "dimension", "bucket").select(F.lit(dataset or f"1/{ratio}").alias("dataset"), "*")


def triggers(report: DataFrame, ratio: int) -> DataFrame:
    """Whether sharp turns err 1.5 times as much as straight legs, and long gaps 1.3 times as much as short ones."""
    short, long = ("1-2", "5-7") if ratio == 8 else ("1-4", "9-15")
    mae = lambda d, b: F.max(F.when((F.col("dimension") == d) & (F.col("bucket") == b), F.col("mae")))
    r = report.agg(mae("turn_angle", "sharp(>90)").alias("sharp"), mae("turn_angle", "straight(<30)").alias("straight"), mae("gap_size", short).alias("short_gap"), mae("gap_size", long).alias("long_gap"))
    test = lambda a, b, k: F.coalesce(F.col(a) >= k * F.greatest(F.lit(1e-9), F.col(b)), F.lit(False)) & F.col(b).isNotNull()
    return r.withColumn("curve_trigger", test("sharp", "straight", 1.5)).withColumn("gap_trigger", test("long_gap", "short_gap", 1.3))


# Regression: y_true and y_pred in seconds.


def regression_aggs(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    e = F.col(p) - F.col(y)
    return [
        F.count(e).alias("count"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(1e-6)))).alias("mape"), F.avg(e).alias("bias"),
    ]


def regression_summary(pairs: DataFrame, *by: str) -> DataFrame:
    """The metrics and the percentiles of the absolute error per group."""
    p = settled(pairs.select(*by, "y_true", "y_pred", F.abs(F.col("y_pred") - F.col("y_true")).alias("_e")), "pairs")
    return _with_tails(p, regression_aggs(), "_e", {"p50": 0.5, "p90": 0.9, "p95": 0.95}, *by)


def duration_report(pairs: DataFrame) -> DataFrame:
    """Count, MAE, RMSE, MAPE per duration class; empty classes appear with count 0."""
    labels = [*[x for _, x in buckets.DURATIONS[0]], buckets.DURATIONS[1]]
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], "bucket string")
    got = pairs.where("y_pred is not null").groupBy(buckets.duration_bucket("y_true").alias("bucket")).agg(*regression_aggs())
    return every.join(got, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("count"), "mae", "rmse", "mape")


def regression_report(pairs: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Per group (a name in labels) and bucket: count, share of the group's rows, and the metrics; one pass over pairs."""
    x = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), b.alias("bucket")) for g, b in labels.items()])).alias("x")
    r = regression_summary(pairs.select("y_true", "y_pred", x).select("y_true", "y_pred", "x.group", "x.bucket"), "group", "bucket")
    return r.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("group")))


def coverage(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: ids in both, only in truth, only in predictions, and pairs dropped because a value is not finite."""
    t = truth.select("traj_id", F.col("travel_time").alias("y"), F.lit(True).alias("t"))
    p = predicted.select("traj_id", F.col("travel_time").alias("p"), F.lit(True).alias("q"))
    j = t.join(p, "traj_id", "full_outer")
    both = F.col("t").isNotNull() & F.col("q").isNotNull()
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return j.agg(
        F.count_if(both).alias("n_both"), F.count_if(F.col("t").isNotNull() & F.col("q").isNull()).alias("n_missing"),
        F.count_if(F.col("t").isNull()).alias("n_extra"), F.count_if(both & ~(good("y") & good("p"))).alias("n_not_finite"),
    )


def id_differences(truth: DataFrame, predicted: DataFrame, k: int = 20) -> DataFrame:
    """The first k ids on either side only."""
    side = lambda a, b, s: a.select("traj_id").join(b.select("traj_id"), "traj_id", "left_anti").select("traj_id", F.lit(s).alias("side")).orderBy("traj_id").limit(k)
    return side(truth, predicted, "truth").unionByName(side(predicted, truth, "predicted"))


def top_errors(pairs: DataFrame, k: int = 30, id_col: str = "traj_id") -> DataFrame:
    """The k largest absolute errors, ties to the smaller id, with their rank."""
    e = pairs.where("y_true is not null and y_pred is not null").withColumn("abs_error", F.abs(F.col("y_pred") - F.col("y_true"))).orderBy(F.desc("abs_error"), id_col).limit(max(1, k))
    return e.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("abs_error"), id_col)))


def positional_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pair two files by their explicit order column; disagree: their ids differ at that place."""
    a, b = left.select("ord", F.col("traj_id").alias("left_id")), right.select("ord", F.col("traj_id").alias("right_id"))
    return a.join(b, "ord", "full_outer").withColumn("disagree", ~F.col("left_id").eqNullSafe(F.col("right_id")))


def milestone_trend(runs: DataFrame) -> DataFrame:
    """runs(run_order, milestone, ratio, mae, …) with the change of MAE in per cent against the ratio's first run,
    and whether the run is its ratio's best."""
    w = Window.partitionBy("ratio")
    first = F.min_by("mae", "run_order").over(w)
    return runs.withColumn("mae_change_pct", 100 * (F.col("mae") - first) / first).withColumn("is_best", F.struct("mae", "run_order") == F.min(F.struct("mae", "run_order")).over(w))


def worst_and_best(report: DataFrame, metric: str = "mape") -> DataFrame:
    return report.groupBy("group").agg(F.max_by("bucket", F.struct(metric, "bucket")).alias("worst"), F.min_by("bucket", F.struct(metric, "bucket")).alias("best"))


def histogram(values: DataFrame, column: str, width: float, cut_at: float | None = None) -> DataFrame:
    """Counts per bin of a width; values above the quantile cut_at are left out."""
    v = values.where(F.col(column).isNotNull())
    if cut_at is not None:
        v = settled(v.select(column), "values")
        top = quantiles(v, column, {"_top": cut_at})  # one row
        v = v.join(F.broadcast(top), F.col(column) <= F.col("_top"))
    return v.groupBy((F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count("*").alias("count"))


def binned(values: DataFrame, column: str, low: float, high: float, width: float, *by: str) -> DataFrame:
    """by, bin (its lower edge), count: a histogram with fixed bins from low to high, empty ones included; the last bin holds its
    upper edge too, and what lies outside is left out. Groups are those of values."""
    n = max(1, round((high - low) / width))
    v = F.col(column).cast("double")
    k = F.least(F.floor((v - low) / width), F.lit(n - 1)).cast("int")
    found = values.where((v >= low) & (v <= low + n * width)).groupBy(*by, k.alias("_k")).agg(F.count("*").alias("count"))
    every = values.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_k"))
    same = F.col("e._k") == F.col("f._k")
    for c in by:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}"))
    j = every.alias("e").join(found.alias("f"), same, "left")
    return j.select(*[F.col(f"e.{c}").alias(c) for c in by], (low + F.col("e._k") * width).alias("bin"), F.coalesce("count", F.lit(0)).alias("count"))


def bounds(points: DataFrame, by: tuple[str, ...] = ("traj_id",), pad: float = 0.08) -> DataFrame:
    """Bounding box of the finite points with padding; the unit box where there are none."""
    ok = F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat")
    ext = points.groupBy(*by).agg(*[f(F.when(ok, F.col(c))).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max))])
    out = []
    for c in ("lon", "lat"):
        lo, hi = F.col(f"min_{c}"), F.col(f"max_{c}")
        m = pad * F.greatest(hi - lo, F.lit(1e-6))
        out += [F.coalesce(lo - m, F.lit(0.0)).alias(f"min_{c}"), F.coalesce(hi + m, F.lit(1.0)).alias(f"max_{c}")]
    return ext.select(*by, *out)
