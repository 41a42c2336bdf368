"""Sessions of a manual study as tables: what a log of edits leaves of each line, how saved cases and later edits make the
present filling, and the summary of a session.

edits(session_id, traj_id, gap_id, ord, action, lon, lat): ``add`` puts a vertex at the end of the gap's line, ``remove`` takes the last
one off, ``clear`` empties the line, ``undo`` takes back the latest step of the gap that is not yet taken back, ``submit`` (no gap)
saves the case. ``ord`` is the session's clock. A step without effect (removing from an empty line) is a step that undo takes back;
undo without a step does nothing. Rows with a null key or order are not read.

Nothing is replayed step by step: which pushes of a stack survive its pops follows from the running depth, so all of it is
window functions over one gap's edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sequence as seq

GAP = ("session_id", "traj_id", "gap_id")
CASE = ("session_id", "traj_id")


def survivors(rows: DataFrame, by: tuple[str, ...], order: str, push: Column, pop: Column) -> DataFrame:
    """The pushes that no later pop takes off; a pop takes the latest push that is left, and does nothing on an empty stack.

    The depth is the running sum of pushes less pops, lifted by how far it ever fell below zero. A push stays if the depth
    never falls below its own again."""
    w = Window.partitionBy(*by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(push, 1).when(pop, -1).otherwise(0)
    d = rows.withColumn("_push", push).withColumn("_sum", F.sum(step).over(run))
    d = d.withColumn("_depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(run)))
    d = d.withColumn("_later", F.min("_depth").over(w.rowsBetween(1, Window.unboundedFollowing)))
    return d.where(F.col("_push") & (F.col("_later").isNull() | (F.col("_later") >= F.col("_depth")))).select(*rows.columns)


def strokes(edits: DataFrame) -> DataFrame:
    """(GAP, idx, lon, lat): the vertices that are left of each gap's line, in order."""
    e = edits.where(F.col("action").isin("add", "remove", "clear", "undo") & F.col("ord").isNotNull() & F.col("session_id").isNotNull() & F.col("traj_id").isNotNull() & F.col("gap_id").isNotNull())
    steps = survivors(e, GAP, "ord", F.col("action") != "undo", F.col("action") == "undo")
    cleared = F.max(F.when(F.col("action") == "clear", F.col("ord"))).over(Window.partitionBy(*GAP))
    line = steps.withColumn("_c", cleared).where((F.col("action") != "clear") & (F.col("_c").isNull() | (F.col("ord") > F.col("_c")))).drop("_c")
    left = survivors(line, GAP, "ord", F.col("action") == "add", F.col("action") == "remove")
    return left.select(*GAP, (F.row_number().over(Window.partitionBy(*GAP).orderBy("ord")) - 1).cast("long").alias("idx"), "lon", "lat")


def present_fill(gaps: DataFrame, edits: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """(session_id, traj_id, idx, lon, lat): filled points of every session. gaps(traj_id, gap_id, start_idx, missing_count, lon0, lat0,
    lon1, lat1).

    saved(session_id, traj_id, ord, idx, lon, lat) holds snapshots of cases: the latest one of a case stands but for the gaps edited after
    it, whose lines start empty. A gap whose line has no vertex left is not filled."""
    e = edits
    if saved is not None:
        last = saved.groupBy(*CASE).agg(F.max("ord").alias("_saved"))
        e = edits.join(last, list(CASE), "left").where(F.col("_saved").isNull() | (F.col("ord") > F.col("_saved"))).drop("_saved")
    lines = strokes(e)
    g = gaps.join(lines.select(*GAP).distinct(), ["traj_id", "gap_id"])
    drawn = seq.fill_gaps_from_strokes(g, lines, GAP).select(*CASE, "idx", "lon", "lat")
    if saved is None:
        return drawn
    edited = e.where(F.col("gap_id").isNotNull() & (F.col("action") != "submit")).select(*GAP).distinct().join(gaps.select("traj_id", "gap_id", "start_idx", "missing_count"), ["traj_id", "gap_id"])
    gone = edited.select(*CASE, F.explode(F.sequence(F.col("start_idx") + 1, F.col("start_idx") + F.col("missing_count"))).alias("idx"))
    kept = saved.join(last, list(CASE)).where(F.col("ord") == F.col("_saved")).select(*CASE, "idx", "lon", "lat")
    return kept.join(gone, [*CASE, "idx"], "left_anti").unionByName(drawn)


def summary(edits: DataFrame, pool: DataFrame, scores: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(session_id, saved_case_count, saved_case_ids, mae_mean per method, current_case_index, total_cases): pool(ord from 0, traj_id) are
    the cases, scores(traj_id, mae_<method>…) their errors; submitted cases of the pool count, undefined errors do not. The current
    case is that of the session's last edit."""
    in_pool = edits.where("ord is not null and session_id is not null").join(pool.select("traj_id", F.col("ord").cast("int").alias("_case")), "traj_id")
    last = in_pool.groupBy("session_id").agg(F.max_by("_case", "ord").alias("current_case_index"))
    saved = in_pool.where("action = 'submit'").select("session_id", "traj_id").distinct().join(scores, "traj_id", "left")
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    s = saved.groupBy("session_id").agg(F.count("*").alias("saved_case_count"), F.sort_array(F.collect_list("traj_id")).alias("saved_case_ids"), *[F.avg(fine(f"mae_{m}")).alias(f"mae_mean_{m}") for m in methods])
    total = pool.agg(F.count("*").alias("total_cases"))
    out = last.join(s, "session_id", "left").join(total, F.lit(True))  # one row
    return out.withColumns({"saved_case_count": F.coalesce("saved_case_count", F.lit(0)), "saved_case_ids": F.coalesce("saved_case_ids", F.array().cast(saved.select(F.collect_list("traj_id")).schema[0].dataType))})
