"""Cheapest state sequences (Viterbi) by (min, +) matrices.

A step's emission and transition costs are a matrix from the states before to its own, and a run of steps is the (min, +)
product of theirs. Sequences are cut into chunks of CHUNK steps, which are dealt over tasks by themselves: first each
chunk's product, then along each sequence the costs with which each chunk is entered, then each chunk's best way back
from every exit, then backwards the exit taken from each chunk, and last the states inside. So one sequence is spread over
many tasks, time is linear in its length, and what goes from chunk to chunk is a vector of states. Ways are traced
inside a chunk. If no sequence is longer than a chunk, the last pass alone does it all.

Tasks read their steps as sorted streams and advance all chunks of a batch together, step by step. Ties take the lowest
last state, then the lowest one before it, and so on; inside a chunk they are judged by the costs of whole ways as they add up. Missing costs count as infinite; a sequence without any finite way has infinite cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import settled

CHUNK = 256


class _Steps:
    """Costs of the steps of a batch: emit[row, state], trans[row, state, state before], filled with infinity."""

    def __init__(self, emit: pa.Array, trans: pa.Array) -> None:
        n = len(emit)
        sizes = np.diff(emit.offsets.to_numpy())
        flat = emit.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        width = int(sizes.max(initial=1))
        self.emit = np.full((n, width), np.inf)
        row = np.repeat(np.arange(n), sizes)
        self.emit[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(np.isnan(flat), np.inf, flat)
        outer = np.where(trans.is_valid().to_numpy(zero_copy_only=False), np.diff(trans.offsets.to_numpy()), 0)
        inner = trans.flatten()
        isize = np.diff(inner.offsets.to_numpy())
        values = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        before = int(isize.max(initial=1))
        self.trans = np.full((n, width, max(before, width)), np.inf)
        step = np.repeat(np.arange(n), outer)
        state = np.arange(len(step)) - np.repeat(np.cumsum(outer) - outer, outer)
        at = np.repeat(np.arange(len(isize)), isize)
        self.trans[step[at], state[at], np.arange(len(at)) - np.repeat(np.cumsum(isize) - isize, isize)] = np.where(np.isnan(values), np.inf, values)
        self.width = self.trans.shape[2]
        if width < self.width:
            self.emit = np.concatenate([self.emit, np.full((n, self.width - width), np.inf)], axis=1)
            self.trans = np.concatenate([self.trans, np.full((n, self.width - width, self.width), np.inf)], axis=1)


def _forward(s: _Steps, first: np.ndarray, size: np.ndarray, entry: np.ndarray | None) -> np.ndarray:
    """Advance all chunks: cost[row, state]. entry[chunk, state before] is what a chunk begins with; rows of NaN, and None,
    begin a sequence, which pays the first step's emission alone."""
    cost = s.emit.copy()
    if entry is not None:
        go = ~np.isnan(entry[:, 0])
        r = first[go]
        cost[r] = (entry[go][:, None, :] + s.emit[r][:, :, None] + s.trans[r]).min(axis=2)
    for t in range(1, int(size.max(initial=0))):
        r = first[size > t] + t
        cost[r] = (cost[r - 1][:, None, :] + s.emit[r][:, :, None] + s.trans[r]).min(axis=2)
    return cost


def _most(least: np.ndarray, emit: np.ndarray, trans: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The greatest x with x + emit + trans <= limit as doubles add up; least is such a one."""
    scale = np.maximum.reduce([np.abs(least), np.abs(emit), np.abs(trans), np.abs(limit)])
    wide = ~np.isfinite(scale)
    with np.errstate(invalid="ignore"):
        lo, hi = np.where(wide, 0.0, least), np.where(wide, 0.0, np.maximum(least, limit - trans - emit) + 16 * np.spacing(np.where(wide, 0.0, scale)))
        while True:
            mid = lo + (hi - lo) / 2
            open_ = (mid > lo) & (mid < hi)
            if not open_.any():
                return np.where(wide, np.inf, lo)
            ok = mid + emit + trans <= limit
            lo, hi = np.where(open_ & ok, mid, lo), np.where(open_ & ~ok, mid, hi)


def _trace(s: _Steps, first: np.ndarray, size: np.ndarray, cost: np.ndarray, entry: np.ndarray | None, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state[row], state before the chunk) of each chunk's cheapest way into its state last. Of ways whose costs, added up in
    order, are the same double, the one with the lowest state before the last counts, then with the lowest one before that."""
    state, now = np.zeros(len(cost), np.int32), last.astype(np.int64)
    limit = cost[first + size - 1, now]
    for t in range(int(size.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(size > t)
        state[first[live] + t] = now[live]
        if t == 0:
            live = live[~np.isnan(entry[live, 0])] if entry is not None else live[:0]
        r = first[live] + t
        before = cost[r - 1] if t else entry[live] if entry is not None else cost[r]
        emit, trans = s.emit[r, now[live]], s.trans[r, now[live]]
        p = (before + emit[:, None] + trans <= limit[live][:, None]).argmax(axis=1)
        if t:
            at = np.arange(len(live))
            limit[live] = _most(before[at, p], emit, trans[at, p], limit[live])
        now[live] = p
    return state, now


def _product(s: _Steps, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The (min, +) product of each chunk: [chunk, state, state before]."""
    out = s.emit[first][:, :, None] + s.trans[first]
    for t in range(1, int(size.max(initial=0))):
        live = np.flatnonzero(size > t)
        r = first[live] + t
        step = s.emit[r][:, :, None] + s.trans[r]
        out[live] = (step[:, :, :, None] + out[live][:, None, :, :]).min(axis=2)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, first row of each chunk, its size): whole chunks of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < 2 * CHUNK:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        first = _firsts(rows)
        if len(first) > 1:
            yield rows.slice(0, int(first[-1])), first[:-1], np.diff(first)
        held = [rows.slice(int(first[-1]))]
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()
        if rows:
            first = _firsts(rows[0])
            yield rows[0], first, np.diff(np.append(first, rows[0].num_rows))


def _firsts(rows: pa.RecordBatch) -> np.ndarray:
    seq, c = rows.column(0).to_numpy(zero_copy_only=False), rows.column(1).to_numpy()
    return np.flatnonzero(np.concatenate([[True], (seq[1:] != seq[:-1]) | (c[1:] != c[:-1])])) if rows.num_rows else np.zeros(0, np.int64)


def _lists(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of doubles."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1)))


def _entry(rows: pa.RecordBatch, first: np.ndarray, width: int) -> np.ndarray:
    """Entry costs of the chunks, NaN where a sequence begins."""
    out = np.full((len(first), width), np.inf)
    col = rows.column(rows.schema.get_field_index("entry"))
    for k, r in enumerate(first.tolist()):
        v = col[r].as_py()
        if v is None:
            out[k] = np.nan
        else:
            out[k, : len(v)] = v[:width]
    return out


def states(steps: DataFrame, key: str = "traj_id", chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(states(key, o, state), costs(key, cost)) of steps(key, o from 0, emit array, trans array of arrays [state][state
    before]); o = 0 has no trans."""
    kind = steps.schema[key].dataType.simpleString()
    s = settled(steps.select(key, F.floor(F.col("o") / chunk).cast("long").alias("c"), F.col("o").cast("long").alias("o"), "emit", "trans"), "steps")
    cut = (s.agg(F.max("c")).first()[0] or 0) > 0
    entered = exits = None
    dealt = lambda df: df.repartition(key, "c").sortWithinPartitions(key, "c", "o")
    if cut:
        entered, exits = _between(s, key, kind, dealt)
        s = s.join(entered, [key, "c"], "left").join(exits, [key, "c"], "left")
    else:
        s = s.withColumns({"entry": F.lit(None).cast("array<double>"), "exit": F.lit(None).cast("int")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first, size in _chunks(batches):
            st = _Steps(rows.column(3), rows.column(4))
            entry = _entry(rows, first, st.width) if cut else None
            cost = _forward(st, first, size, entry)
            end = cost[first + size - 1]
            given = rows.column(6)
            now = np.array([given[r].as_py() if given[r].is_valid else -1 for r in first.tolist()]) if cut else np.full(len(first), -1)
            state, _ = _trace(st, first, size, cost, entry, np.where(now < 0, end.argmin(axis=1), now))
            best = np.full(rows.num_rows, np.nan)
            best[first + size - 1] = end.min(axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(state), pa.array(best, mask=np.isnan(best))], names=[key, "o", "state", "cost"])

    out = settled(dealt(s).select(key, "c", "o", "emit", "trans", "entry", "exit").mapInArrow(run, f"`{key}` {kind}, o long, state int, cost double"), "states")
    return out.drop("cost"), out.where("cost is not null").groupBy(key).agg(F.max_by("cost", "o").alias("cost"))


def _between(s: DataFrame, key: str, kind: str, dealt) -> tuple[DataFrame, DataFrame]:
    """(entry costs, exit states) of each chunk."""
    narrow = s.select(key, "c", "o", "emit", "trans")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first, size in _chunks(batches):
            st = _Steps(rows.column(3), rows.column(4))
            begins = rows.column(1).take(pa.array(first)).to_numpy() == 0
            p = _product(st, first, size)
            if begins.any():  # the cost vector itself, as the only column
                p[begins] = np.inf
                p[begins, :, 0] = _forward(st, first[begins], size[begins], None)[first[begins] + size[begins] - 1]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), rows.column(1).take(pa.array(first)), _lists(p.reshape(len(p), -1))], names=[key, "c", "p"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cost = None, None
        for b in batches:
            got = []
            for k, c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                m = p.values.to_numpy(zero_copy_only=False)
                width = int(round(len(m) ** 0.5))
                m = m.reshape(width, width)
                if c == 0 or k != last:
                    got.append(None)
                    cost = m[:, 0]
                else:
                    got.append(cost.tolist())
                    v = np.full(width, np.inf)
                    v[: min(width, len(cost))] = cost[:width]
                    cost = (m + v).min(axis=1)
                last = k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.float64()))], names=[key, "c", "entry"])

    p = settled(dealt(narrow).mapInArrow(products, f"`{key}` {kind}, c long, p array<double>"), "products")
    entered = settled(p.repartition(key).sortWithinPartitions(key, "c").mapInArrow(entries, f"`{key}` {kind}, c long, entry array<double>"), "entries")

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first, size in _chunks(batches):
            st = _Steps(rows.column(3), rows.column(4))
            entry = _entry(rows, first, st.width)
            cost = _forward(st, first, size, entry)
            at = np.column_stack([_trace(st, first, size, cost, entry, np.full(len(first), k))[1] for k in range(st.width)])
            cost = cost[first + size - 1]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), rows.column(1).take(pa.array(first)), _lists(at.astype(np.float64)), pa.array(cost.argmin(axis=1).astype(np.int32))], names=[key, "c", "way", "best"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            got = []
            for k, way, best in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if k != last:
                    state = best
                got.append(state)
                state, last = int(way[state].as_py()), k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.int32())], names=[key, "c", "exit"])

    with_entry = dealt(narrow.join(entered, [key, "c"], "left")).select(key, "c", "o", "emit", "trans", "entry")
    w = settled(with_entry.mapInArrow(ways, f"`{key}` {kind}, c long, way array<double>, best int"), "ways")
    exits = settled(w.repartition(key).sortWithinPartitions(key, F.desc("c")).mapInArrow(taken, f"`{key}` {kind}, c long, `exit` int"), "exits")
    return entered, exits


__all__ = ["CHUNK", "states"]
