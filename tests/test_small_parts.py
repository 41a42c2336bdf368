"""Parts that queries use only now and then: runs, boxes, draws, names, transforms, quantiles of hot values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.operators import features, metrics, sequence as seq, spatial, study
from wayfare.sources import osm, schemas


def test_quantiles_of_hot_and_equal_values(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", 5.0)] * 3000 + [("one", 7.0)] + [("mixed", float(v)) for v in rng.integers(0, 9, 500)] + [(None, float(v)) for v in rng.random(101)] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    qs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: tuple(r[k] for k in qs) for r in metrics.quantiles(df, "v", qs, "g").collect()}
    for g in ("hot", "one", "mixed", None):
        want = np.quantile([v for k, v in rows if k == g and v is not None], list(qs.values()))
        assert got[g] == pytest.approx(tuple(want))
    assert "none" not in got
    assert metrics.quantiles(df.where("g = 'hot'"), "v", {"m": 0.5}).first().m == 5.0


def test_finite_runs(spark):
    rows = [(0, 0, 1.0, 1.0), (0, 1, 2.0, 2.0), (0, 2, None, 1.0), (0, 3, 3.0, 3.0), (0, 4, float("nan"), 1.0), (0, 5, 4.0, 4.0), (0, 6, 5.0, 5.0), (0, 7, 6.0, 6.0)]
    got = seq.finite_runs(spark.createDataFrame(rows, "traj_id long, idx long, lon double, lat double")).orderBy("idx").collect()
    assert [r.idx for r in got] == [0, 1, 5, 6, 7] and got[0].run_id == got[1].run_id != got[2].run_id


def test_segments_in_a_box(spark):
    s = osm.with_bbox(spark.createDataFrame([(str(k), float(k), 0.0, k + 1.5, 1.0) for k in range(10)], "seg_id string, lon1 double, lat1 double, lon2 double, lat2 double"))
    assert sorted(r.seg_id for r in spatial.in_box(s, (3.0, 0.5, 4.0, 9.0)).collect()) == ["2", "3", "4"]
    assert spatial.in_box(s, (0.0, 0.0, 20.0, 1.0), 4, 1).count() == 4 and spatial.in_box(s, (0.0, 2.0, 20.0, 3.0)).count() == 0


def test_draws_and_common_ids(spark):
    df = spark.range(200).withColumnRenamed("id", "traj_id")
    a, b = ({r.traj_id for r in study.hash_sample(df, 20, s).collect()} for s in (1, 2))
    assert len(a) == len(b) == 20 and a != b and a == {r.traj_id for r in study.hash_sample(df.orderBy(F.desc("traj_id")), 20, 1).collect()}
    assert study.hash_sample(df, 500).count() == 200
    assert sorted(r[0] for r in study.common_ids(df.where("traj_id > 3"), df.where("traj_id < 8"), df.where("traj_id % 2 = 0")).select("traj_id").collect()) == [4, 6]


def test_names_targets_and_shapes(spark):
    assert [schemas.dataset_name(x) for x in ("8", " 1/16 ", "1/8")] == ["8", "16", "8"]
    with pytest.raises(ValueError):
        schemas.dataset_name("1/4")
    r = spark.createDataFrame([(100.0,), (-5.0,)], "y double").select(features.forward_target(F.col("y"), "log1p").alias("z"), "y").select("z", features.inverse_target(F.col("z"), "log1p").alias("b"), features.inverse_target(F.col("y")).alias("c")).collect()
    assert r[0].z == pytest.approx(math.log1p(100)) and r[0].b == pytest.approx(100) and r[0].c == 100 and (r[1].z, r[1].b, r[1].c) == (0, 1, 1)
    p = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "traj_id long, idx long")
    assert schemas.check_same_shape(p, p).isEmpty()
    assert sorted((x.traj_id, x.n_left, x.n_right) for x in schemas.check_same_shape(p, p.where("idx = 0 and traj_id = 1")).collect()) == [(1, 2, 1), (2, 1, None)]


def test_sweep_keeps_failed_cases(spark):
    from wayfare.operators import travel_time
    from wayfare.operators.boosting import Boosted

    df = spark.range(120).selectExpr("id as traj_id", "cast(id % 7 as double) as a", "cast(id % 5 as double) as b", "if(id = 3, cast('nan' as double), 1.0) as c", "100.0 + 10 * (id % 7) as travel_time")
    got = {r.case: r for r in travel_time.sweep_cases(df, df.where("traj_id > 90"), ("a",), {"nomap_ref": (), "with_b": ("b",), "broken": ("c",)}, spec=Boosted(0.1, 3, 5, 3)).collect()}
    assert {k: r.status for k, r in got.items()} == {"nomap_ref": "ok", "with_b": "ok", "broken": "failed"}
    assert got["nomap_ref"].d_mae == 0 and got["broken"].mae is None and got["broken"].error and got["with_b"]["count"] == 29


def test_submissions_of_every_form(spark, tmp_path):
    line = lambda i, x: f'{{"traj_id": {i}, "coords": [{{"lon": {x}, "lat": 0.0}}]}}'
    (tmp_path / "one.json").write_text("\n".join([line(1, 1.0), line(2, 2.0), "{}", "no record"]))
    for name, text in (("cases/a/player_pred.json", line(1, 3.0)), ("cases/b/player_pred.json", line(1, 4.0)), ("cases/c/player_pred.json", line(5, 5.0))):
        p = tmp_path / "session" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    read = lambda p: {r.traj_id: r.coords[0].lon for r in schemas.predictions_in(spark, f"file://{p}").collect()}
    assert read(tmp_path / "one.json") == {1: 1.0, 2: 2.0}
    assert read(tmp_path / "session") == {1: 4.0, 5: 5.0}
    (tmp_path / "session" / "player_predictions_saved_cases.json").write_text(line(9, 9.0))
    assert read(tmp_path / "session") == {9: 9.0}
    with pytest.raises(Exception, match="nowhere"):
        schemas.predictions_in(spark, f"file://{tmp_path}/nowhere")
