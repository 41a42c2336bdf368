"""Travel-time regression: exact ridge and boosted trees, ensemble, blend search, parameter sweep, saved models."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, features, metrics
from .boosting import Boosted, Target, Trees
from .spatial import MAP_FEATURES, MapCase, map_feature_table

# The settings of the models.
BASE, SECOND, RESIDUAL = Boosted(0.05, 8, 450, 40, 0.05), Boosted(0.035, 10, 620, 30, 0.02), Boosted(0.05, 6, 260, 55, 0.08)
RIDGE = 3.0
#: The cases of the map-feature sweep; None has no map features.
CASES = {
    "nomap_ref": None,
    "map_r80_p10_t1535": MapCase(80.0, 10, (15.0, 35.0)), "map_r95_p12_t1540": MapCase(95.0, 12, (15.0, 40.0)), "map_r120_p14_t2050": MapCase(120.0, 14, (20.0, 50.0)),
    "map_r90_p18_t1545": MapCase(90.0, 18, (15.0, 45.0)), "map_r140_p18_t2060": MapCase(140.0, 18, (20.0, 60.0)), "map_r160_p22_t2570": MapCase(160.0, 22, (25.0, 70.0)),
    "map_r120_p14_t2050_c08": MapCase(120.0, 14, (20.0, 50.0)),
}
SWEEP = Boosted(0.05, 8, 260, 40, 0.05)


@dataclass(frozen=True)
class Ridge:
    """intercept + sum of coefficient * (value - mean) / scale, columns bound by name."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficient: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        parts = [(F.col(c).cast("double") - m) / s * k for c, m, s, k in zip(self.columns, self.mean, self.scale, self.coefficient)]
        return reduce(lambda a, b: a + b, parts, F.lit(self.intercept))


@dataclass(frozen=True)
class Fitted:
    """A model with what is needed to use it: kind, transform of the target, and the columns it binds by name."""

    kind: str
    transform: str
    model: Ridge | Trees

    @property
    def columns(self) -> tuple[str, ...]:
        return self.model.columns


def gram(rows: DataFrame, columns: tuple[str, ...], label: str, weight: str, mean: list[float], scale: list[float]) -> DataFrame:
    """(i, j, value): weighted sums of products of [1, standardised columns…, label], one table whatever the rows. Batches
    are multiplied inside tasks, and only their products are shuffled."""
    k = len(columns)
    m, s = np.array(mean), np.array(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 2, k + 2))
        for b in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
            z = np.column_stack([np.ones(len(a)), (a[:, :k] - m) / s, a[:, k]])
            total += (z * a[:, k + 1 :]).T @ z
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int64()), pa.array(j.ravel(), pa.int64()), pa.array(total.ravel())], names=["i", "j", "value"])

    x = rows.select(*[F.col(c).cast("double") for c in columns], F.col(label).cast("double"), F.col(weight).cast("double"))
    return x.mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def fit_ridge(rows: DataFrame, columns: tuple[str, ...], label: str, weight: str, alpha: float = RIDGE) -> Ridge:
    """Exact weighted ridge on columns standardised by their plain mean and deviation (constant ones stay at zero); the
    intercept is not penalised. Two passes: moments, then the products of all columns; the small system is solved on the
    driver. Null features are an error, as are no rows."""
    moments = rows.agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"m{j}") for j, c in enumerate(columns)], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{j}") for j, c in enumerate(columns)]).first()
    if not moments["n"]:
        raise ValueError("no rows to fit")
    mean = [moments[f"m{j}"] for j in range(len(columns))]
    if any(m is None or m != m for m in mean):
        raise ValueError("a feature is null or not a number")
    scale = [moments[f"s{j}"] if moments[f"s{j}"] > 1e-10 * max(1.0, abs(m)) else float("inf") for j, m in enumerate(mean)]
    g = np.zeros((len(columns) + 2, len(columns) + 2))
    for r in gram(rows, columns, label, weight, mean, scale).collect():  # a table of fixed size
        g[r.i, r.j] = r.value
    if np.isnan(g).any():
        raise ValueError("a feature or label is null or not a number")
    a, b = g[:-1, :-1].copy(), g[:-1, -1]
    a[np.arange(1, len(a)), np.arange(1, len(a))] += alpha
    solved = np.linalg.solve(a, b)
    return Ridge(tuple(columns), tuple(mean), tuple(scale), tuple(float(x) for x in solved[1:]), float(solved[0]))


def _prepared(train: DataFrame, columns: tuple[str, ...], transform: str, weights: str, label: str) -> DataFrame:
    y = F.col(label).cast("double")
    return train.where(F.col(label).isNotNull()).select("traj_id", *columns, features.forward_target(y, transform).alias("_y"), features.sample_weight(y, weights).cast("double").alias("_w"))


def fit(train: DataFrame, columns: tuple[str, ...], kind: str = "linear", transform: str = "none", weights: str = "none", spec: Boosted = BASE, label: str = "travel_time") -> Fitted:
    """train(traj_id, columns…, label in seconds). linear: exact ridge; boosted: histogram boosting."""
    rows = _prepared(train, columns, transform, weights, label)
    if kind == "linear":
        return Fitted(kind, transform, fit_ridge(rows, columns, "_y", "_w"))
    return Fitted(kind, transform, boosting.boost(rows, [Target(columns, "_y", None if weights == "none" else "_w", spec)], "traj_id")[0])


def predict(model: Fitted, rows: DataFrame, out: str = "y_pred") -> DataFrame:
    """Seconds, one at least. Columns are bound by name; one that is missing is an error that names it."""
    missing = [c for c in model.columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows.withColumn(out, features.inverse_target(model.model.score(), model.transform))


def save(model: Fitted, spark: SparkSession, path: str) -> None:
    """Write the model and its columns below path; an existing path is an error."""
    about = {"kind": model.kind, "transform": model.transform, "columns": list(model.columns)}
    if isinstance(model.model, Ridge):
        about |= {"mean": model.model.mean, "scale": [s if s != float("inf") else None for s in model.model.scale], "coefficient": model.model.coefficient, "intercept": model.model.intercept}
    else:
        boosting.save(model.model, spark, f"{path}/trees")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Fitted:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    if about["kind"] == "linear":
        scale = tuple(float("inf") if s is None else s for s in about["scale"])
        return Fitted("linear", about["transform"], Ridge(tuple(about["columns"]), tuple(about["mean"]), scale, tuple(about["coefficient"]), about["intercept"]))
    return Fitted(about["kind"], about["transform"], boosting.load(spark, f"{path}/trees"))


def train(trips: DataFrame, columns: tuple[str, ...], validation: DataFrame | None = None, **how) -> tuple[Fitted, DataFrame]:
    """(model, report) from trips(traj_id, n_points, path_m, travel_time, columns…): trips are cleaned first, and none left is an
    error. report(split, bucket, count, mae, rmse, mape) has the used training trips and, if given, the validation trips
    by travel-time bucket, bucket ``all`` for all of them."""
    used = features.clean_trips(trips).where("drop_reason is null")
    if used.isEmpty():
        raise ValueError("no training trip is left after cleaning")
    model = fit(used, columns, **how)
    report = None
    for split, rows in (("train", used), ("validation", validation)):
        if rows is not None:
            r = report_by_duration(predict(model, rows).select(F.col("travel_time").alias("y_true"), "y_pred")).select(F.lit(split).alias("split"), "*")
            report = r if report is None else report.unionByName(r)
    return model, report


def report_by_duration(pairs: DataFrame) -> DataFrame:
    """(bucket, count, mae, rmse, mape) of pairs(y_true, y_pred): all, then the duration buckets."""
    whole = pairs.where("y_true is not null and y_pred is not null").agg(*metrics.regression_aggs()).select(F.lit("all").alias("bucket"), "count", "mae", "rmse", "mape")
    return whole.unionByName(metrics.duration_report(pairs).select("bucket", "count", "mae", "rmse", "mape"))


def evaluate(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Report of predicted(traj_id, travel_time) against truth(traj_id, travel_time): true trips without a prediction are left
    out, and of repeated predictions the last record counts if there is a column ``ord``, else any one."""
    if "ord" in predicted.columns:
        p = predicted.groupBy("traj_id").agg(F.max_by("travel_time", "ord").alias("y_pred"))
    else:
        p = predicted.groupBy("traj_id").agg(F.max("travel_time").alias("y_pred"))
    return report_by_duration(truth.select("traj_id", F.col("travel_time").alias("y_true")).join(p, "traj_id"))


def check_align(inputs: DataFrame, others: DataFrame) -> DataFrame:
    """One row: how many positions of two trip tables were compared and in how many they differ by departure, number of
    points, first and last point. Both: (ord, departure_ts, n_points, first, last), points as struct(lon, lat), paired
    by position; ends are compared where the numbers of points agree and are not zero."""
    a, b = inputs.alias("a"), others.alias("b")
    j = a.join(b, F.col("a.ord") == F.col("b.ord"))
    same_n = F.col("a.n_points") == F.col("b.n_points")
    off = lambda c: same_n & (F.col("a.n_points") > 0) & (F.greatest(F.abs(F.col(f"a.{c}.lon") - F.col(f"b.{c}.lon")), F.abs(F.col(f"a.{c}.lat") - F.col(f"b.{c}.lat"))) > 1e-9)
    return j.agg(
        F.count("*").alias("checked"), F.count_if(~F.col("a.departure_ts").eqNullSafe(F.col("b.departure_ts"))).alias("mismatch_departure"), F.count_if(~same_n).alias("mismatch_length"),
        F.count_if(off("first")).alias("mismatch_first_point"), F.count_if(off("last")).alias("mismatch_last_point"),
    )


def fit_ensemble(train: DataFrame, columns: tuple[str, ...], specs: tuple[Boosted, Boosted, Boosted] = (BASE, SECOND, RESIDUAL), label: str = "travel_time") -> tuple[Fitted, Fitted, Fitted]:
    """Two models of the logarithm, grown side by side, the first with more weight on short trips, and one of the first
    model's error in seconds."""
    y = F.col(label).cast("double")
    rows = train.where(F.col(label).isNotNull()).select("traj_id", *columns, y.alias("_t"), features.forward_target(y, "log1p").alias("_y"), features.sample_weight(y, "short-boost").cast("double").alias("_w"))
    first, second = (Fitted("boosted", "log1p", m) for m in boosting.boost(rows, [Target(columns, "_y", "_w", specs[0]), Target(columns, "_y", None, specs[1])], "traj_id"))
    rest = predict(first, rows, "_p").withColumn("_r", F.col("_t") - F.col("_p"))
    return first, second, Fitted("boosted", "none", boosting.boost(rest, [Target(columns, "_r", None, specs[2])], "traj_id")[0])


def predict_ensemble(models: tuple[Fitted, Fitted, Fitted], rows: DataFrame, w: float) -> DataFrame:
    """base1, base2, resid (base1 plus the predicted error), and y_pred = w * resid + (1 - w) * base2."""
    p = predict(models[1], predict(models[0], rows, "base1"), "base2")
    p = p.withColumn("resid", F.greatest(F.lit(1.0), F.col("base1") + models[2].model.score()))
    return p.withColumn("y_pred", w * F.col("resid") + (1 - w) * F.col("base2"))


def blend_search(pairs: DataFrame, steps: int = 81) -> DataFrame:
    """w, mae, rmse, mape for each blend w * resid + (1 - w) * base2 of pairs(y_true, resid, base2): every row is
    read once and contributes to all weights."""
    w = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / (steps - 1))).alias("w")
    p = pairs.select("y_true", "resid", "base2", w).withColumn("y_pred", F.col("w") * F.col("resid") + (1 - F.col("w")) * F.col("base2"))
    return p.groupBy("w").agg(*metrics.regression_aggs()).select("w", "mae", "rmse", "mape")


def best_blend(found: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The weight with the least (mape, mae, rmse), and whether it is accepted: no worse than the reference in all three and
    better in one."""
    b = found.agg(F.min(F.struct("mape", "mae", "rmse", "w")).alias("b")).select("b.w", "b.mape", "b.mae", "b.rmse")
    if reference is None:
        return b.withColumn("accepted", F.lit(True))
    names = ("mape", "mae", "rmse")
    r = reference.select(*[F.coalesce(F.col(c), F.lit(float("inf"))).alias(f"_{c}") for c in names])
    ok = reduce(lambda x, y: x & y, [F.col(c) <= F.col(f"_{c}") for c in names]) & reduce(lambda x, y: x | y, [F.col(c) < F.col(f"_{c}") for c in names])
    return b.join(r, F.lit(True)).withColumn("accepted", ok).drop("_mape", "_mae", "_rmse")


def count_control(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Control prediction k * (n_points - 1), k fitted on train through the origin."""
    x = F.col("n_points") - 1
    k = train.agg((F.sum(x * F.col("travel_time")) / F.sum(x * x)).alias("k"))  # one row
    return rows.join(F.broadcast(k), F.lit(True)).withColumn("y_pred", F.greatest(F.lit(1.0), F.col("k") * (F.col("n_points") - 1))).drop("k")


def sweep(cases: dict[str, DataFrame], control: str) -> DataFrame:
    """cases: name -> pairs(y_true, y_pred). Metrics per case, deltas against the control, best first by (mape, mae, rmse)."""
    rows = None
    for name, pairs in cases.items():
        r = pairs.agg(*metrics.regression_aggs()).select(F.lit(name).alias("case"), "count", "mae", "rmse", "mape")
        rows = r if rows is None else rows.unionByName(r)
    c = rows.where(F.col("case") == control).select(*[F.col(m).alias(f"_{m}") for m in ("mae", "rmse", "mape")])
    j = rows.join(F.broadcast(c), F.lit(True))
    return j.select("case", "count", "mae", "rmse", "mape", *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in ("mae", "rmse", "mape")]).orderBy("mape", "mae", "rmse")


def case_table(trips: DataFrame, points: DataFrame, segments: DataFrame, cases: dict[str, MapCase | None] = CASES) -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """(trips with the map features of all cases side by side, the map columns of each case), from one join; equal cases share theirs.
    A trip without points has zeros."""
    used = list(dict.fromkeys(c for c in cases.values() if c is not None))
    columns = {c: tuple(f"case{k}_{f}" for f in MAP_FEATURES) for k, c in enumerate(used)}
    if used:
        of_map = map_feature_table(points, segments, used)
        trips = trips.join(of_map, "traj_id", "left").fillna(0.0, [c for cs in columns.values() for c in cs])
    return trips, {name: () if c is None else columns[c] for name, c in cases.items()}


def sweep_cases(train: DataFrame, validation: DataFrame, columns: tuple[str, ...], case_columns: dict[str, tuple[str, ...]], control: str = "nomap_ref", spec: Boosted = SWEEP) -> DataFrame:
    """(case, status, count, mae, rmse, mape, d_mae, d_rmse, d_mape, error): one boosted model per case on the columns and the
    case's own, all grown side by side, scored on the validation trips; best first, failed cases last. If the joint fit fails
    the cases are fitted one by one, and those that fail stay as rows with their error."""
    spark = train.sparkSession
    rows = train.where("travel_time is not null").withColumn("_y", F.col("travel_time").cast("double"))
    targets = {name: Target((*columns, *cs), "_y", None, spec) for name, cs in case_columns.items()}
    fitted, failed = {}, {}
    try:
        fitted = dict(zip(targets, boosting.boost(rows, list(targets.values()), "traj_id")))
    except Exception:
        for name, t in targets.items():
            try:
                fitted[name] = boosting.boost(rows, [t], "traj_id")[0]
            except Exception as e:
                failed[name] = f"{type(e).__name__}: {e}".splitlines()[0]
    scored = validation
    for k, m in enumerate(fitted.values()):
        scored = scored.withColumn(f"_p{k}", F.greatest(F.lit(1.0), m.score()))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("case"), F.col(f"_p{k}").alias("y_pred")) for k, name in enumerate(fitted)])).alias("e")
    names = "case string, status string, error string"
    out = spark.createDataFrame([(n, "failed", e) for n, e in failed.items()], names)
    if fitted:
        pairs = scored.where("travel_time is not null").select(F.col("travel_time").cast("double").alias("y_true"), each).select("y_true", "e.case", "e.y_pred")
        done = pairs.groupBy("case").agg(*metrics.regression_aggs()).select("case", F.lit("ok").alias("status"), "count", "mae", "rmse", "mape")
        ref = done.where(F.col("case") == control).select(*[F.col(m).alias(f"_{m}") for m in ("mae", "rmse", "mape")])
        done = done.join(ref, F.lit(True), "left").select("case", "status", "count", "mae", "rmse", "mape", *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in ("mae", "rmse", "mape")])  # one row per case
        out = done.unionByName(out, allowMissingColumns=True)
    else:
        out = out.selectExpr("case", "status", *[f"cast(null as double) as {m}" for m in ("count", "mae", "rmse", "mape", "d_mae", "d_rmse", "d_mape")], "error")
    return out.orderBy(F.col("mape").asc_nulls_last(), "mae", "rmse", "case")
