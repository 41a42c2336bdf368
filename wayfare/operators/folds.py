"""Steps over a line that see the results of earlier ones, in time linear in the line's length.

Rows are dealt by line and sorted, and a task walks them once as a stream of batches: only the last finished point and
the one that waits for its successor go from batch to batch, so a line may be longer than memory. Within a batch, numpy finds the
few vertices where something can happen; only from these on the walk goes step by step. Null coordinates never move,
never move others, and stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SAME_PLACE = 1e-12

Batches = Iterator[pa.RecordBatch]


def _stream(points: DataFrame, by: tuple[str, ...], step: Callable[[Batches], Batches]) -> DataFrame:
    """points(by…, idx, lon, lat, …) dealt by line, in order of idx, through ``step``."""
    return points.repartition(*by).sortWithinPartitions(*by, "idx").mapInArrow(step, points.schema)


def _starts(b: pa.RecordBatch, by: tuple[str, ...]) -> np.ndarray:
    """Which rows begin a line, the first one left open (False)."""
    out = np.zeros(b.num_rows, bool)
    for c in by:
        col = b.column(b.schema.get_field_index(c))
        here, before = col.slice(1), col.slice(0, max(len(col) - 1, 0))
        differ = pc.fill_null(pc.not_equal(here, before), False)
        one_null = pc.xor(pc.is_null(here), pc.is_null(before))
        out[1:] |= pc.or_(differ, one_null).to_numpy(zero_copy_only=False)
    return out


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.float64)


def _with(b: pa.RecordBatch, **values: np.ndarray) -> pa.RecordBatch:
    columns = list(b.columns)
    for name, v in values.items():
        columns[b.schema.get_field_index(name)] = pa.array(v, pa.float64(), mask=np.isnan(v))
    return pa.RecordBatch.from_arrays(columns, schema=b.schema)


def _joined(held: pa.RecordBatch | None, b: pa.RecordBatch) -> pa.RecordBatch:
    return b if held is None else pa.Table.from_batches([held, b.cast(held.schema)]).combine_chunks().to_batches()[0]


def bearing(x0, y0, x1, y1) -> np.ndarray:
    """Degrees in [0, 360), NaN where the points coincide."""
    p, q, d = np.radians(y0), np.radians(y1), np.radians(x1 - x0)
    y, x = np.sin(d) * np.cos(q), np.cos(p) * np.sin(q) - np.sin(p) * np.cos(q) * np.cos(d)
    out = np.mod(np.degrees(np.arctan2(y, x)) + 360.0, 360.0)
    return np.where((np.abs(x) < 1e-12) & (np.abs(y) < 1e-12), np.nan, out)


def turn(x0, y0, x1, y1, x2, y2) -> np.ndarray:
    """Change of bearing at the middle point, NaN if undefined."""
    return np.abs(np.mod(bearing(x1, y1, x2, y2) - bearing(x0, y0, x1, y1) + 180.0, 360.0) - 180.0)


def _sweep(batches: Batches, by: tuple[str, ...], cap: float) -> Batches:
    held: pa.RecordBatch | None = None  # the last row, which waits for its successor
    left: tuple[float, float] | None = None  # the finished point before it, None at a line's start
    for b in batches:
        if not b.num_rows:
            continue
        b = _joined(held, b)
        n, start = b.num_rows, _starts(b, by)
        x, y = _numbers(b, "lon"), _numbers(b, "lat")
        inner = np.zeros(n, bool)
        inner[1:-1] = ~start[1:-1] & ~start[2:]
        if n > 1 and left is not None:
            inner[0] = not start[1]
        px, py = np.concatenate([[left[0] if left else np.nan], x[:-1]]), np.concatenate([[left[1] if left else np.nan], y[:-1]])
        nx, ny = np.concatenate([x[1:], [np.nan]]), np.concatenate([y[1:], [np.nan]])
        with np.errstate(invalid="ignore"):
            sharp = np.flatnonzero(inner & (turn(px, py, x, y, nx, ny) > cap))
        done = -1
        for i in sharp.tolist():
            # from a vertex that moves on, its successors see the moved one
            while i > done:
                ax, ay = (x[i - 1], y[i - 1]) if i else left
                done = i
                if not turn(ax, ay, x[i], y[i], nx[i], ny[i]) > cap:
                    break
                x[i], y[i] = (ax + nx[i]) / 2, (ay + ny[i]) / 2
                if i + 1 < n and inner[i + 1]:
                    i += 1
        out = _with(b, lon=x, lat=y)
        yield out.slice(0, n - 1)
        held = out.slice(n - 1)
        if n > 1:
            left = None if start[n - 1] else (x[n - 2], y[n - 2])
    if held is not None:
        yield held


def limit_turns(points: DataFrame, most_deg: float, sweeps: int = 1, by: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Curvature limiter: a vertex that turns more than the cap becomes the midpoint of its neighbours, in order of idx,
    later vertices seeing earlier moves; each sweep reads the last one's line. The cap is cut to 0 and more; from 179 on
    nothing moves. Ends stay. An empty table stays empty."""
    cap = max(0.0, most_deg)
    if cap >= 179.0:
        return points
    typed = points.withColumns({c: points[c].cast("double") for c in ("lon", "lat")})

    def run(batches: Batches) -> Batches:
        for _ in range(max(1, sweeps)):
            batches = _sweep(batches, by, cap)
        return batches

    return _stream(typed, by, run)


def _distinct(batches: Batches, by: tuple[str, ...]) -> Batches:
    last: pa.RecordBatch | None = None  # the last kept row
    for b in batches:
        if not b.num_rows:
            continue
        whole = _joined(last, b)
        off = whole.num_rows - b.num_rows
        start = _starts(whole, by)
        if not off:
            start[0] = True
        x, y = _numbers(whole, "lon"), _numbers(whole, "lat")
        keep = np.ones(len(x), bool)
        with np.errstate(invalid="ignore"):
            near = np.flatnonzero(~start[1:] & (np.hypot(np.diff(x), np.diff(y)) <= SAME_PLACE)) + 1
            done = -1
            for i in near.tolist():
                if i <= done:
                    continue
                kept = i - 1
                # one row is dropped: the next ones are compared with the last one kept
                while i < len(x) and not start[i] and np.hypot(x[i] - x[kept], y[i] - y[kept]) <= SAME_PLACE:
                    keep[i] = False
                    i += 1
                done = i
                if i < len(x) and not start[i]:
                    done = i  # kept, and its successor is compared with it as in the first pass
        rows = np.flatnonzero(keep)
        last = whole.slice(int(rows[-1]), 1)
        yield whole.filter(pa.array(keep)).slice(off)


def dedupe(points: DataFrame, by: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """Drop a vertex within SAME_PLACE degrees of the last one kept on its line."""
    return _stream(points, by, lambda batches: _distinct(batches, by))
