"""Edits of a study replayed one by one against the window form; snapshots merged with later edits."""

import numpy as np
from pyspark.sql import functions as F

from wayfare.operators import session

EDITS = "session_id long, traj_id long, gap_id long, ord long, action string, lon double, lat double"


def replay(actions):
    line, history = [], []
    for k, a in actions:
        if a == "undo":
            line = history.pop() if history else line
            continue
        history.append(line)
        line = line + [k] if a == "add" else line[:-1] if a == "remove" else []
    return line


def test_strokes_equal_replay(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(40):
        acts = [(1000 * g + k, str(rng.choice(["add", "add", "add", "remove", "undo", "undo", "clear"], p=[0.2, 0.2, 0.2, 0.15, 0.1, 0.1, 0.05]))) for k in range(int(rng.integers(1, 40)))]
        want[g] = replay(acts)
        rows += [(g % 3, 5, g, k, a, float(k), 0.0) for k, a in acts]
    rows += [(0, 5, None, 99, "submit", None, None), (None, 5, 0, 5, "add", 1.0, 1.0), (0, 5, 0, None, "add", 1.0, 1.0)]
    got = {}
    for r in session.strokes(spark.createDataFrame(rows, EDITS).repartition(3)).orderBy("idx").collect():
        got.setdefault(r.gap_id, []).append(int(r.lon))
    assert got == {g: v for g, v in want.items() if v}
    assert session.strokes(spark.createDataFrame([], EDITS)).count() == 0


def test_snapshot_and_later_edits(spark):
    gaps = spark.createDataFrame([(5, 0, 0, 3, 0.0, 0.0, 0.0, 4.0), (5, 1, 4, 1, 0.0, 4.0, 0.0, 6.0)], "traj_id long, gap_id long, start_idx long, missing_count long, lon0 double, lat0 double, lon1 double, lat1 double")
    edits = spark.createDataFrame([(1, 5, 0, 1, "add", 9.0, 9.0), (1, 5, 0, 3, "add", 0.0, 2.0), (2, 5, 1, 2, "add", 0.0, 5.0), (2, 5, 1, 4, "clear", None, None)], EDITS)
    saved = spark.createDataFrame([(1, 5, 2, k, 7.0, 7.0) for k in (1, 2, 3, 5)] + [(1, 5, 1, 1, 8.0, 8.0)], "session_id long, traj_id long, ord long, idx long, lon double, lat double")
    got = {(r.session_id, r.idx): (round(r.lon, 6), round(r.lat, 6)) for r in session.present_fill(gaps, edits, saved).collect()}
    # session 1: gap 0 was drawn anew after the snapshot, gap 1 stands; session 2 cleared its only line
    assert got == {(1, 1): (0.0, 1.0), (1, 2): (0.0, 2.0), (1, 3): (0.0, 3.0), (1, 5): (7.0, 7.0)}
    alone = {(r.session_id, r.idx) for r in session.present_fill(gaps, edits).collect()}
    assert alone == {(1, 1), (1, 2), (1, 3)}


def test_summary(spark):
    edits = spark.createDataFrame([(1, 5, None, 1, "submit", None, None), (1, 5, None, 2, "submit", None, None), (1, 6, None, 3, "submit", None, None), (1, 7, 0, 4, "add", 1.0, 1.0), (2, 9, None, 1, "submit", None, None), (3, 6, 0, 1, "add", 1.0, 1.0)], EDITS)
    pool = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "ord int, traj_id long")
    scores = spark.createDataFrame([(5, 2.0), (6, float("nan")), (7, 9.0)], "traj_id long, mae_p double")
    got = {r.session_id: (r.saved_case_count, r.saved_case_ids, r.mae_mean_p, r.current_case_index, r.total_cases) for r in session.summary(edits, pool, scores, ("p",)).collect()}
    assert got == {1: (2, [5, 6], 2.0, 2, 3), 3: (0, [], None, 1, 3)}
