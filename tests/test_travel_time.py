"""Boosting against a plain version, ridge against the normal equations, saved models, reports, alignment."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import boosting, travel_time
from wayfare.operators.boosting import Boosted, Target

COLUMNS = ("a", "b", "c", "d")


def table(spark, n, seed=0, parts=3):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 6, n), r.random(n) ** 3 * 100, np.ones(n)])
    y = 300 + 80 * np.sin(2 * x[:, 0]) + 30 * (x[:, 1] > 2) * x[:, 0] + x[:, 2] + r.normal(size=n) * 5
    w = r.choice([1.0, 1.2, 1.8], n)
    rows = [(k, *map(float, x[k]), float(y[k]), float(w[k])) for k in range(n)]
    return x, y, w, spark.createDataFrame(rows, "traj_id long, a double, b double, c double, d double, y double, w double").repartition(parts)


def plain_boost(x, y, w, spec, held=None):
    """Best-first trees with a heap, sums taken anew for every node. (predictions, losses)."""
    held = np.zeros(len(y), bool) if held is None else held
    edges = [boosting.find_edges(x[:, j], spec.bins) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    use = ~held
    score = np.full(len(y), np.average(y[use], weights=w[use]))
    losses = []

    def best(rows, depth):
        if depth >= spec.depth or len(rows) < 2 * spec.leaf:
            return None
        g, h = (score[rows] - y[rows]) * w[rows], w[rows]
        whole, found = g.sum() ** 2 / (h.sum() + spec.l2), None
        for j in range(x.shape[1]):
            for cut in range(len(edges[j])):
                left = bins[rows, j] <= cut
                n = left.sum()
                if n < spec.leaf or len(rows) - n < spec.leaf:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + spec.l2) + g[~left].sum() ** 2 / (h[~left].sum() + spec.l2) - whole
                if gain > 1e-9 and (found is None or gain > found[0] * (1 + 1e-12)):
                    found = (gain, j, cut)
        return found

    for _ in range(spec.rounds):
        if held.any():
            losses.append(float((w[held] * (score[held] - y[held]) ** 2).sum() / 2 / w[held].sum()))
            last = losses[-spec.patience - 1 :]
            if len(last) > spec.patience and all(v >= last[0] - spec.tolerance for v in last[1:]):
                break
        every, heap, leaves, order = np.arange(len(y)), [], [], 0

        def push(rows, depth):
            nonlocal order
            b = best(rows[use[rows]], depth)
            if b is None:
                leaves.append(rows)
            else:
                heapq.heappush(heap, (-b[0], order, rows, depth, b))
                order += 1

        push(every, 0)
        while heap and len(heap) + len(leaves) < spec.leaves:
            _, _, rows, depth, (_, j, cut) = heapq.heappop(heap)
            left = bins[rows, j] <= cut
            push(rows[left], depth + 1)
            push(rows[~left], depth + 1)
        step = np.zeros(len(y))
        for rows in leaves + [h[2] for h in heap]:
            t = rows[use[rows]]
            step[rows] = -spec.rate * ((score[t] - y[t]) * w[t]).sum() / (w[t].sum() + spec.l2)
        score = score + step
    return score, losses


@pytest.mark.parametrize("spec, weighted", [(Boosted(0.1, 4, 12, 5, 0.05, 8), True), (Boosted(0.3, 9, 6, 12, 0.5, 31, 20), False), (Boosted(0.1, 1, 5, 1, 0.0, 31), True)])
def test_boosting_equals_plain_version(spark, spec, weighted):
    x, y, w, df = table(spark, 400)
    model = boosting.boost(df, [Target(COLUMNS, "y", "w" if weighted else None, spec)], "traj_id")[0]
    want, _ = plain_boost(x, y, w if weighted else np.ones(len(y)), spec)
    assert np.abs(model.raw(x) - want).max() < 1e-9 * np.abs(want).max()
    assert len(model.trees) == spec.rounds
    got = {r.traj_id: r.p for r in df.withColumn("p", model.score()).collect()}
    assert np.allclose([got[k] for k in range(len(y))], want)


def test_side_by_side_and_any_partitioning(spark, monkeypatch):
    """Models fitted together, over other blocks and orders, are the same to the last bit."""
    x, y, w, df = table(spark, 300)
    specs = [Target(COLUMNS, "y", "w", Boosted(0.1, 3, 13, 8)), Target(("b", "a"), "y", None, Boosted(0.2, 5, 4, 8))]
    together = boosting.boost(df, specs, "traj_id")
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 37)
    monkeypatch.setattr(boosting, "STRIDE", 2)
    alone = [boosting.boost(df.orderBy("c"), [s], "traj_id")[0] for s in specs]
    for a, b, cols in zip(together, alone, ((0, 1, 2, 3), (1, 0))):
        assert (a.raw(x[:, cols]) == b.raw(x[:, cols])).all() and len(a.trees) == len(b.trees)


def test_rounds_end_when_kept_back_rows_gain_nothing(spark):
    spec = Boosted(0.5, 4, 200, 5, hold_above=100, holdout=0.3, patience=4)
    x, y, w, df = table(spark, 300, 5)
    model = boosting.boost(df, [Target(COLUMNS, "y", "w", spec)], "traj_id")[0]
    held = {r.traj_id: r.h for r in df.select("traj_id", (F.pmod(F.xxhash64(F.col("traj_id").cast("string"), F.lit("holdout-42")), F.lit(1 << 30)) / float(1 << 30) < 0.3).alias("h")).collect()}
    want, losses = plain_boost(x, y, w, spec, np.array([held[k] for k in range(len(y))]))
    assert len(model.trees) < 200 and model.losses == pytest.approx(losses)
    assert np.abs(model.raw(x) - want).max() < 1e-9 * np.abs(want).max()


def test_boosting_edge_cases(spark):
    _, _, _, df = table(spark, 40)
    with pytest.raises(ValueError, match="no rows"):
        boosting.boost(df.limit(0), [Target(COLUMNS, "y")], "traj_id")
    same = df.withColumn("y", F.lit(7.0))
    m = boosting.boost(same, [Target(COLUMNS, "y", None, Boosted(rounds=3))], "traj_id")[0]
    assert m.base == 7.0 and np.allclose(m.raw(np.zeros((2, 4))), 7.0)
    with pytest.raises(Exception, match="null or not a number"):
        boosting.boost(df.withColumn("a", F.lit(None).cast("double")), [Target(COLUMNS, "y")], "traj_id")


def test_ridge_solves_the_normal_equations(spark):
    x, y, w, df = table(spark, 250)
    m = travel_time.fit_ridge(df, COLUMNS, "y", "w")
    sd = x.std(axis=0)
    z = np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0)
    a = np.column_stack([np.ones(len(z)), z])
    want = np.linalg.solve(a.T @ (a * w[:, None]) + np.diag([0, 3, 3, 3, 3]), a.T @ (w * y))
    assert np.allclose([m.intercept, *m.coefficient], want, rtol=1e-10, atol=1e-10) and m.coefficient[3] == 0
    with pytest.raises(ValueError):
        travel_time.fit_ridge(df.limit(0), COLUMNS, "y", "w")


@pytest.mark.parametrize("kind, transform", [("linear", "none"), ("boosted", "log1p"), ("linear", "log1p")])
def test_saved_models_predict_alike(spark, tmp_path, kind, transform):
    _, _, _, df = table(spark, 200)
    df = df.withColumnRenamed("y", "travel_time")
    m = travel_time.fit(df, COLUMNS, kind, transform, "short-boost", Boosted(rounds=6, leaf=5))
    path = f"file://{tmp_path}/model"
    travel_time.save(m, spark, path)
    back = travel_time.load(spark, path)
    assert (back.kind, back.transform, back.columns) == (kind, transform, COLUMNS)
    shuffled = df.select("d", "c", "b", "a", "traj_id")  # bound by name
    a, b = ({r.traj_id: r.y_pred for r in travel_time.predict(x, shuffled).collect()} for x in (m, back))
    assert a == b and min(a.values()) >= 1.0
    with pytest.raises(ValueError, match="columns missing: a"):
        travel_time.predict(back, df.drop("a"))


def test_train_evaluate_and_ensemble(spark):
    _, _, _, df = table(spark, 240)
    trips = df.withColumnRenamed("y", "travel_time").withColumns({"n_points": F.lit(5), "path_m": F.lit(3000.0)})
    trips = trips.withColumn("n_points", F.when(F.col("traj_id") < 10, 1).otherwise(F.col("n_points")))
    m, report = travel_time.train(trips, COLUMNS, trips.limit(7), kind="boosted", spec=Boosted(rounds=5, leaf=5))
    got = {(r.split, r.bucket): r["count"] for r in report.collect()}
    assert got["train", "all"] == 230 and got["validation", "all"] == 7 and got["train", "long_gt_30m"] == 0
    with pytest.raises(ValueError, match="no training trip"):
        travel_time.train(trips.withColumn("n_points", F.lit(1)), COLUMNS)
    truth = spark.createDataFrame([(1, 100.0), (2, 700.0), (3, 5.0)], "traj_id long, travel_time double")
    predicted = spark.createDataFrame([(1, 0, 1.0), (1, 1, 90.0), (2, 2, 710.0), (9, 3, 1.0)], "traj_id long, ord int, travel_time double")
    e = {r.bucket: (r["count"], r.mae) for r in travel_time.evaluate(predicted, truth).collect()}
    assert e == {"all": (2, 10.0), "short_le_10m": (1, 10.0), "medium_10m_30m": (1, 10.0), "long_gt_30m": (0, None)}
    small = tuple(Boosted(0.1, 3, 4, 5) for _ in range(3))
    models = travel_time.fit_ensemble(trips, COLUMNS, small)
    r = travel_time.predict_ensemble(models, trips, 0.25).first()
    assert r.y_pred == pytest.approx(0.25 * r.resid + 0.75 * r.base2)


def test_check_align(spark):
    point = "struct<lon:double,lat:double>"
    schema = f"ord long, departure_ts long, n_points int, first {point}, last {point}"
    p, q = (1.0, 2.0), (1.0, 2.1)
    a = spark.createDataFrame([(0, 5, 2, p, p), (1, 6, 2, p, p), (2, 7, 3, p, p), (3, 7, 0, None, None), (4, 1, 1, p, p)], schema)
    b = spark.createDataFrame([(0, 5, 2, p, p), (1, 7, 2, q, q), (2, 7, 2, q, q), (3, 7, 0, None, None)], schema)
    assert tuple(travel_time.check_align(a, b).first()) == (4, 1, 1, 1, 1)


def test_blend_is_accepted_only_if_it_dominates(spark):
    found = spark.createDataFrame([(0.0, 5.0, 6.0, 2.0), (0.5, 4.0, 6.0, 2.0), (1.0, 1.0, 1.0, 3.0)], "w double, mae double, rmse double, mape double")
    ref = lambda *v: spark.createDataFrame([v], "mae double, rmse double, mape double")
    accepted = lambda r: travel_time.best_blend(found, r).select("w", "accepted").first()
    assert tuple(accepted(None)) == (0.5, True) and tuple(accepted(ref(4.0, 6.0, 2.0))) == (0.5, False)
    assert tuple(accepted(ref(4.0, 6.5, 2.0))) == (0.5, True) and tuple(accepted(ref(3.9, 9.0, 9.0))) == (0.5, False) and tuple(accepted(ref(9.0, None, 9.0))) == (0.5, True)


def test_boosting_sends_only_cuts_to_the_driver(spark, monkeypatch):
    """A level sends a cut per node and feature, whatever the bins and the number of blocks."""
    import pickle

    from pyspark import RDD

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, float(a), float(b), float(a * b)) for k, (a, b) in enumerate(rng.random((600, 2)))], "traj_id long, a double, b double, y double")
    sizes, collect = [], RDD.collect

    def spy(self):
        got = collect(self)
        sizes.append(len(pickle.dumps(got)))
        return got

    monkeypatch.setattr(RDD, "collect", spy)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 40)
    model = boosting.boost(df, [Target(("a", "b"), "y", None, Boosted(rounds=2, leaf=5))], "traj_id")[0]
    assert len(model.trees) == 2 and len(sizes) > 4 and max(sizes) < 10_000


def test_boosting_deals_blocks_evenly_and_grows_equal_models_once(spark, monkeypatch):
    """Every partition sends its sums once per level, so there are no more of them than cores, however many the blocks; a state that was
    written in between changes nothing."""
    from pyspark import RDD

    x, y, w, df = table(spark, 600, parts=7)
    targets = [Target(COLUMNS, "y", None, Boosted(0.1, 3, 7, 8)), Target(("a", "b"), "y", "w", Boosted(0.2, 4, 5, 8)), Target(COLUMNS, "y", None, Boosted(0.1, 3, 7, 8))]
    plain = boosting.boost(df, targets, "traj_id")
    assert plain[0] is plain[2]
    parts, persist = [], RDD.persist

    def spy(self, *a):
        parts.append(self.getNumPartitions())
        return persist(self, *a)

    monkeypatch.setattr(RDD, "persist", spy)
    for name, v in (("BLOCK_ROWS", 50), ("DEALT_ROWS", 16), ("WRITE", 2)):
        monkeypatch.setattr(boosting, name, v)
    again = boosting.boost(df, targets, "traj_id")
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism
    for a, b, cols in zip(plain, again, ((0, 1, 2, 3), (0, 1), (0, 1, 2, 3))):
        assert len(a.trees) == len(b.trees) > 4 and (a.raw(x[:, cols]) == b.raw(x[:, cols])).all()


def test_equal_cases_share_their_columns(spark):
    points = spark.createDataFrame([(1, 0, 108.9, 34.2)], "traj_id long, idx long, lon double, lat double")
    segments = spark.createDataFrame([("s", 108.9, 34.1, 108.9, 34.3, 108.9, 34.1, 108.9, 34.3)], "seg_id string, lon1 double, lat1 double, lon2 double, lat2 double, min_lon double, min_lat double, max_lon double, max_lat double")
    wide, columns = travel_time.case_table(spark.createDataFrame([(1,), (2,)], "traj_id long"), points, segments)
    assert columns["map_r120_p14_t2050"] == columns["map_r120_p14_t2050_c08"] and columns["nomap_ref"] == () and len(wide.columns) == 1 + 6 * 10
    got = {r.traj_id: r.asDict() for r in wide.collect()}
    assert got[1]["case0_heading_mean"] == 90.0 and got[1]["case0_density_mean"] == 1.0 and set(got[2].values()) == {2, 0.0}
