"""Bucket labels of the error reports, as column expressions. Labels and edges are fixed values of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def ladder(value, steps: list[tuple[float, str]], rest: str, closed: bool = True) -> Column:
    """First label whose edge is not exceeded (closed) or not reached (open); ``rest`` beyond the last."""
    c = col(value)
    out = None
    for edge, label in steps:
        test = c <= edge if closed else c < edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(rest)


# Labels and edges of the two error reports, and the grades.
GAPS_8 = [(2, "1-2"), (4, "3-4"), (7, "5-7")], "8+"
GAPS_16 = [(4, "1-4"), (8, "5-8"), (15, "9-15")], "16+"
POSITIONS = [(0.3, "start(0-30%)"), (0.7, "middle(30-70%)")], "end(70-100%)"
LENGTHS = [(100, "50-100"), (150, "101-150"), (240, "151-240")], "241+"
SPEED_QUANTILES = (0.33, 0.66)
DURATIONS = [(600, "short_le_10m"), (1800, "medium_10m_30m")], "long_gt_30m"
TRAVEL_TIMES = [(600, "00-10m"), (1200, "10-20m"), (1800, "20-30m"), (2700, "30-45m")], "45m+"
HOURS = [(6, "00-06"), (10, "06-10"), (17, "10-17"), (20, "17-20")], "20-24"
PATHS = [(8, "<8km"), (12, "8-12km"), (16, "12-16km"), (22, "16-22km")], "22km+"
POINTS = [(80, "<=80"), (120, "81-120"), (160, "121-160"), (200, "161-200")], ">200"
DETOURS = [(1.15, "<1.15"), (1.30, "1.15-1.30"), (1.50, "1.30-1.50")], ">=1.50"
GRADES = (("strong", 1.5, 20, 30), ("good", 2.0, 30, 45), ("fair", 3.0, 45, 65))


def gap_bucket(size, ratio: int) -> Column:
    """Missing run length; edges depend on the masking ratio (1 of 8 or 1 of 16 kept)."""
    return ladder(size, *(GAPS_8 if ratio == 8 else GAPS_16))


def turn_bucket(angle) -> Column:
    c = col(angle)
    return F.when(c.isNull(), "invalid").when(c < 30, "straight(<30)").when(c <= 90, "turn(30-90)").otherwise("sharp(>90)")


def position_bucket(ratio) -> Column:
    return ladder(ratio, *POSITIONS, closed=False)


def length_bucket(n) -> Column:
    return ladder(n, *LENGTHS)


def speed_bucket(value, low, high) -> Column:
    c = col(value)
    return F.when(c.isNull(), "invalid").when(c <= col(low), "low").when(c <= col(high), "mid").otherwise("high")


def duration_bucket(seconds) -> Column:
    """Three classes, upper edges included."""
    return ladder(seconds, *DURATIONS)


def travel_time_bucket(seconds) -> Column:
    """Minutes, upper edges excluded."""
    return ladder(seconds, *TRAVEL_TIMES, closed=False)


def hour_bucket(hour) -> Column:
    return ladder(hour, *HOURS, closed=False)


def path_bucket(km) -> Column:
    return ladder(km, *PATHS, closed=False)


def points_bucket(n) -> Column:
    return ladder(n, *POINTS)


def detour_bucket(ratio) -> Column:
    return ladder(ratio, *DETOURS, closed=False)


def grade(mae, rmse, mape) -> Column:
    """A coarse grade of a regression result (seconds, seconds, per cent)."""
    tests = [F.when((col(mape) <= p) & (col(mae) <= m) & (col(rmse) <= r), name) for name, p, m, r in GRADES]
    return F.coalesce(*tests, F.lit("weak"))
