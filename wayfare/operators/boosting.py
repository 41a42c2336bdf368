"""Histogram gradient boosting for least squares, grown on Spark one level at a time.

Features are binned once, at quantiles of a bounded sample. The binned rows lie in blocks of one byte per value, column by
column, in about as many partitions as there are cores, as each sends its sums once per level. A level
of a tree is one aggregation: each partition sums gradients, weights and counts by (node, feature, bin), the sums
are dealt by feature and added up, the task that holds features finds their best cuts, and the driver gets one cut per node and
task, whatever the rows. Of two siblings only the smaller is summed, the other is its parent less that one. A tree grows
best-first to ``leaves`` leaves: a node is split if it is among the ``leaves - 1`` greatest by the least gain on its way
from the root, so a whole level of candidates can be summed at once and nothing is lost.

Several models (other labels, weights, columns or settings over the same rows) grow side by side in the same jobs; they begin
their trees together. Equal ones are grown once.

Gradients, weights and losses are rounded to a grid so fine that sums of all rows stay whole numbers below 2^53. Sums are
therefore exact in any order: the model is the same for every partitioning and after any lost executor. What rows
have got from the trees so far is kept with the blocks and moved on every few rounds from the previous state, so a lost
block is computed again from the written ones and the trees. After many moves the state is written, so that its line of
descent stays short.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import Rounds, settled

#: Rows that the bins are drawn from, rows of a block at most, and of one as it is dealt, trees after which the state is moved, moves
#: after which it is written, and rows of a partition at most.
SAMPLE, BLOCK_ROWS, DEALT_ROWS, STRIDE, WRITE, MOST_ROWS = 200_000, 65_536, 8_192, 1, 40, 1 << 20


@dataclass(frozen=True)
class Boosted:
    """Settings of one boosted model. Above ``hold_above`` rows a share of ``holdout`` is kept back, and rounds end when
    none of the last ``patience`` made its loss smaller by more than ``tolerance``."""

    rate: float = 0.05
    depth: int = 8
    rounds: int = 450
    leaf: int = 40
    l2: float = 0.05
    leaves: int = 31
    bins: int = 255
    holdout: float = 0.1
    hold_above: int = 10_000
    patience: int = 10
    tolerance: float = 1e-7


@dataclass(frozen=True)
class Target:
    """One model to fit: feature columns, label column, weight column (none: all one)."""

    columns: tuple[str, ...]
    label: str
    weight: str | None = None
    spec: Boosted = Boosted()


@dataclass
class Tree:
    """Nodes in order of their making; feature is -1 at leaves; rows with bin <= cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def rows(self, bins: np.ndarray, rows: np.ndarray, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(node, those of the rows of bins[feature, row] that come to it) of all leaves, or of the wanted nodes."""
        way = None
        if wanted is not None:
            above = {int(c): n for n in np.flatnonzero(self.feature >= 0) for c in (self.left[n], self.right[n])}
            way = set()
            for n in wanted:
                while n in above and above[n] not in way:
                    n = above[n]
                    way.add(n)
        todo = [(0, rows)]
        while todo:
            node, at = todo.pop()
            if wanted is not None and node in wanted:
                yield node, at
            if self.feature[node] >= 0 and (way is None or node in way):
                below = bins[self.feature[node]].take(at) <= self.cut[node]
                todo += [(int(self.left[node]), at[below]), (int(self.right[node]), at[~below])]
            elif wanted is None:
                yield node, at

    def add(self, bins: np.ndarray, score: np.ndarray) -> None:
        """Add each row's leaf to its score."""
        for node, at in self.rows(bins, np.arange(bins.shape[1])):
            score[at] += self.value[node]


@dataclass
class Trees:
    """A fitted model: prediction = base + the values of the leaves a row falls into."""

    columns: tuple[str, ...]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return bin_columns(x, self.edges)

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins, out = self.bin(x), np.full(len(x), self.base)
        for t in self.trees:
            t.add(bins, out)
        return out

    def score(self) -> Column:
        """The raw prediction as a column over the feature columns, bound by name."""

        @F.pandas_udf("double")
        def run(*xs: pd.Series) -> pd.Series:
            return pd.Series(self.raw(np.column_stack([x.to_numpy(np.float64) for x in xs])))

        return run(*[F.col(c).cast("double") for c in self.columns])


def find_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of all bins but the last: midpoints of neighbouring values if there are few, else quantiles that lie
    midway between the values next to them."""
    values = np.unique(x)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.percentile(x, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint"))


def bin_columns(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """bins[column, row] of x[row, column]."""
    if np.isnan(x).any():
        raise ValueError("a feature is null or not a number")
    out = np.empty((len(edges), len(x)), np.uint8)
    for j, e in enumerate(edges):
        out[j] = np.searchsorted(e, x[:, j], side="left")
    return out


def _grid(most: float, rows: int) -> float:
    """A power of two; whole multiples of its inverse up to ``most`` in size stay below 2^52 when all rows are added."""
    return 2.0 ** math.floor(52 - math.log2(max(most, 1e-300) * max(rows, 1)))


@dataclass
class _Fit:
    """What tasks need to know of one model besides its trees."""

    columns: np.ndarray
    widths: list[int]
    label: int
    weight: int | None
    grid: float
    loss_grid: float
    weight_grid: float
    base: float
    held_weight: float | None


@dataclass
class _Request:
    """Sums wanted: nodes of the growing tree by slot, per slot the node's parent and sibling (-1: the root), and whether the loss of
    the rows kept back is."""

    tree: Tree
    nodes: list[int]
    kin: list[tuple[int, int]]
    loss: bool


class _Node:
    def __init__(self, depth: int, totals: np.ndarray) -> None:
        self.depth, self.totals = depth, totals
        self.gain, self.rank, self.below = -np.inf, -np.inf, None
        self.feature, self.cut, self.left, self.right = -1, -1, -1, -1


#: Best cut of a node: (gain, feature, bin, sums below it).
Cut = tuple[float, int, int, np.ndarray]


def _best_cuts(hist: np.ndarray, fit: _Fit, spec: Boosted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, bin, sums below it) per node on one feature from hist[node, sum, bin] with sums of gradients, weights and counts; the
    first of equal gains wins, and a gain that is not positive is no cut."""
    below = hist.cumsum(axis=2)
    total, below = below[:, :, -1:], below[:, :, :-1]
    if not below.shape[2]:
        return np.full(len(hist), -np.inf), np.zeros(len(hist), np.int64), np.zeros((len(hist), 3))
    above = total - below
    gain = lambda s: np.square(s[:, 0] / fit.grid) / (s[:, 1] / fit.weight_grid + spec.l2)
    with np.errstate(invalid="ignore", divide="ignore"):
        g = gain(below) + gain(above) - gain(total)
    ok = (below[:, 2] >= spec.leaf) & (above[:, 2] >= spec.leaf) & (below[:, 1] > 1e-3 * fit.weight_grid) & (above[:, 1] > 1e-3 * fit.weight_grid)
    g = np.where(ok, g, -np.inf)
    k, each = g.argmax(axis=1), np.arange(len(hist))
    return g[each, k], k, below[each, :, k]


def _choose(node: _Node, cut: Cut | None, spec: Boosted) -> None:
    if cut is not None and node.depth < spec.depth and node.totals[2] >= 2 * spec.leaf:
        node.gain, node.feature, node.cut, node.below = cut


#: What comes back of a request: the best cut of each node that has one, sums of the root, mean loss.
Answer = tuple[dict[int, Cut], np.ndarray | None, float]


def _grow(fit: _Fit, spec: Boosted, model: Trees) -> Generator[_Request, Answer, None]:
    """Rounds of one model. Yields requests and gets answers."""
    columns = fit.columns
    for _ in range(spec.rounds):
        nodes = [_Node(0, np.zeros(3))]
        cuts, nodes[0].totals, loss = yield _Request(_tree(nodes, columns), [0], [(-1, -1)], fit.held_weight is not None)
        if fit.held_weight is not None:
            model.losses.append(loss)
            last = model.losses[-spec.patience - 1 :]
            if len(last) > spec.patience and all(x >= last[0] - spec.tolerance for x in last[1:]):
                return
        _choose(nodes[0], cuts.get(0), spec)
        nodes[0].rank = nodes[0].gain
        while True:
            known = sorted((n for n in nodes if n.feature >= 0), key=lambda n: -n.rank)[: spec.leaves - 1]
            ready = [n for n in known if n.left < 0]
            if not ready:
                break
            small, kin = [], []
            for n in ready:
                left = n.below
                n.left, n.right = len(nodes), len(nodes) + 1
                nodes += [_Node(n.depth + 1, left), _Node(n.depth + 1, n.totals - left)]
                if n.depth + 1 < spec.depth and max(left[2], n.totals[2] - left[2]) >= 2 * spec.leaf:
                    pair = (n.left, n.right) if left[2] <= n.totals[2] - left[2] else (n.right, n.left)
                    small.append(pair[0])
                    kin.append((nodes.index(n), pair[1]))
            cuts = (yield _Request(_tree(nodes, columns), small, kin, False))[0] if small else {}
            for n in ready:
                for c in (n.left, n.right):
                    _choose(nodes[c], cuts.get(c), spec)
                    nodes[c].rank = min(n.rank, nodes[c].gain)
        kept = {id(n) for n in sorted((n for n in nodes if n.feature >= 0), key=lambda n: -n.rank)[: spec.leaves - 1]}
        model.trees.append(_pruned(nodes, kept, fit, spec))


def _tree(nodes: list[_Node], columns: np.ndarray) -> Tree:
    """The growing tree as far as its children are made; features are columns of the blocks."""
    split = [n.left >= 0 for n in nodes]
    return Tree(
        np.array([columns[n.feature] if s else -1 for n, s in zip(nodes, split)], np.int32), np.array([n.cut for n in nodes], np.int32),
        np.array([n.left for n in nodes], np.int32), np.array([n.right for n in nodes], np.int32), np.zeros(len(nodes)),
    )


def _pruned(nodes: list[_Node], kept: set[int], fit: _Fit, spec: Boosted) -> Tree:
    rows: list[list] = []

    def put(k: int) -> int:
        n, at = nodes[k], len(rows)
        g, w = n.totals[0] / fit.grid, n.totals[1] / fit.weight_grid
        rows.append([-1, -1, -1, -1, -spec.rate * g / (w + spec.l2) if w + spec.l2 > 0 else 0.0])
        if id(n) in kept:
            left, right = put(n.left), put(n.right)
            rows[at][:4] = [n.feature, n.cut, left, right]
        return at

    put(0)
    f, c, a, b, v = zip(*rows)
    return Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(a, np.int32), np.array(b, np.int32), np.array(v))


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # bins[column, row], numbers[kind, row], kept back, score[model, row]


def _moved(block: Block, fits: list[_Fit], new: list[list[Tree]]) -> Block:
    bins, numbers, held, score = block
    if any(new):
        score = score.copy()
        for k, trees in enumerate(new):
            mine = bins[fits[k].columns] if trees else bins
            for t in trees:
                t.add(mine, score[k])
    return bins, numbers, held, score


def _pack(g: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Whole numbers that hold g above and a one below, and how many bits are below: one sum gives both. None if sums could
    overflow."""
    bits = len(g).bit_length()
    return ((g.astype(np.int64) << bits) + 1, bits) if (float(np.abs(g).sum()) + 1) * 2.0**bits < 2.0**62 else None


def _hist(bins: np.ndarray, fit: _Fit, slots: np.ndarray | int, size: int, rows: np.ndarray | None, use: np.ndarray, g: np.ndarray, w: np.ndarray | None) -> np.ndarray:
    """hist[sum, feature, slot, bin] of gradients and counts, and of weights if there are any. rows: which ones, None for all of ``use``."""
    out = np.zeros((2 if w is None else 3, len(fit.columns), size, 256))
    key = np.empty(len(g), np.intp)
    packed = _pack(g)
    one = None if packed is None else np.where(use, packed[0], 0) if rows is None else packed[0]
    for j, c in enumerate(fit.columns):
        np.add(bins[c] if rows is None else bins[c].take(rows), slots, out=key)
        if one is None:
            out[0, j] = np.bincount(key, g, size * 256).reshape(size, 256)
            out[1, j] = np.bincount(key, use if rows is None else None, size * 256).reshape(size, 256)
        else:
            both = np.zeros(size * 256, np.int64)
            np.add.at(both, key, one)
            out[0, j], out[1, j] = (both >> packed[1]).reshape(size, 256), (both & ((1 << packed[1]) - 1)).reshape(size, 256)
        if w is not None:
            out[2, j] = np.bincount(key, w, size * 256).reshape(size, 256)
    return out


def _sums(block: Block, fits: list[_Fit], asked: dict[int, _Request]) -> dict[int, tuple[np.ndarray, float]]:
    """Sums of one block: per model its ``_hist`` and the loss of rows kept back."""
    bins, numbers, held, score = block
    every, out = np.zeros(len(held), bool), {}
    for k, r in asked.items():
        f = fits[k]
        off = score[k] - numbers[f.label]
        weight = numbers[f.weight] if f.weight is not None else None
        loss, use, rows = 0.0, ~every, None
        if f.held_weight is not None:
            use = ~held
            if r.loss:
                loss = float(np.rint(np.square(off[held]) * (1.0 if weight is None else weight[held]) * f.loss_grid).sum())
        slots: np.ndarray | int = 0
        if r.kin[0][0] >= 0:
            place = {n: i for i, n in enumerate(r.nodes)}
            parts = list(r.tree.rows(bins, np.flatnonzero(use), set(place)))
            rows = np.concatenate([at for _, at in parts])
            slots = np.repeat(np.array([place[n] * 256 for n, _ in parts]), [len(at) for _, at in parts])
            off, weight = off[rows], weight if weight is None else weight[rows]
        g, w = np.rint((off if weight is None else off * weight) * f.grid), weight if weight is None else np.rint(weight * f.weight_grid)
        if rows is None and f.held_weight is not None:
            g, w = np.where(use, g, 0.0), w if w is None else np.where(use, w, 0.0)
        out[k] = (_hist(bins, f, slots, len(r.nodes), rows, use, g, w), loss)
    return out


def _split(held: dict[int, np.ndarray], sums: list[np.ndarray], r: _Request, fit: _Fit, spec: Boosted) -> tuple[dict[int, np.ndarray], list[tuple[int, float, int, np.ndarray]], np.ndarray]:
    """(hist per node, best cut per node that has one, sums of the first node) of one feature; held has the parents' hist[sum, bin], sums
    has gradients, counts and, if rows have any, weights by [slot, bin]."""
    new = {}
    whole = np.stack([sums[0], sums[2] if len(sums) > 2 else sums[1] * fit.weight_grid, sums[1]], axis=1)
    for node, (parent, sibling), h in zip(r.nodes, r.kin, whole):
        new[node] = h
        if parent >= 0:
            new[sibling] = held[parent] - h
    gains, at, below = _best_cuts(np.stack(list(new.values())), fit, spec)
    return new, [(n, float(gains[i]), int(at[i]), below[i]) for i, n in enumerate(new) if gains[i] > 0], whole[0].sum(axis=1)


def _better(a: Cut | None, b: Cut) -> Cut:
    """The greater gain, of equal ones the first feature."""
    return b if a is None or (-b[0], b[1]) < (-a[0], a[1]) else a


def boost(rows: DataFrame, targets: list[Target], key: str, seed: int = 42) -> list[Trees]:
    """Fit all targets side by side. ``key`` tells rows apart for the sample and for the rows kept back. Null or NaN features
    and an empty table are errors; further columns are not read."""
    spark, wanted, targets = rows.sparkSession, targets, list(dict.fromkeys(targets))
    columns = list(dict.fromkeys(c for t in targets for c in t.columns))
    numbers = list(dict.fromkeys(c for t in targets for c in (t.label, t.weight) if c))
    spec_hold = max(t.spec.holdout for t in targets)
    draw = lambda salt: F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(f"{salt}-{seed}")), F.lit(1 << 30)) / float(1 << 30)
    data = settled(rows.select(*[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)], *[F.col(c).cast("double").alias(f"n{j}") for j, c in enumerate(numbers)], draw("sample").alias("drawn"), (draw("holdout") < spec_hold).alias("held")), "boost-rows")
    n = data.count()
    if not n:
        raise ValueError("no rows to fit")
    x_cols, n_cols = [f"x{j}" for j in range(len(columns))], [f"n{j}" for j in range(len(numbers))]
    sample = data.where(F.col("drawn") < SAMPLE / n).select(*x_cols).toPandas().to_numpy(np.float64)
    if np.isnan(sample).any():
        raise ValueError("a feature is null or not a number")
    bins = min(255, max(t.spec.bins for t in targets))
    edges = [find_edges(sample[:, j], bins) for j in range(len(columns))]
    del sample

    fits, models = [], []
    moments = _moments(data, targets, n_cols, numbers, n)
    for t, whole in zip(targets, moments):
        held = n > t.spec.hold_above and t.spec.holdout > 0
        if whole["lo"] is None or whole["sum_w"] is None or not whole["sum_w"]:
            raise ValueError("no labels to fit")
        spread = max(2 * (whole["hi"] - whole["lo"]), 1e-9)
        base = float(Decimal(whole["sum_yw"]) / Decimal(whole["sum_w"]))
        index = np.array([columns.index(c) for c in t.columns])
        fits.append(_Fit(index, [len(edges[j]) + 1 for j in index], numbers.index(t.label), numbers.index(t.weight) if t.weight else None, _grid(spread * whole["w"], n), _grid(spread * spread * whole["w"], n), _grid(whole["w"], n), base, whole["held"] if held and whole["held"] else None))
        models.append(Trees(t.columns, [edges[j] for j in index], base))

    most = BLOCK_ROWS

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches, min(most, DEALT_ROWS)):
            get = lambda cols: np.column_stack([b.column(c).to_numpy().astype(np.float64) for c in cols])
            held = b.column("held").to_numpy().astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bin_columns(get(x_cols), edges), get(n_cols).T.copy(), held)], names=["bins", "numbers", "held"])

    width, kinds, bases = len(columns), len(numbers), np.array([[f.base] for f in fits])
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-n // DEALT_ROWS)), -(-n // MOST_ROWS))
    stored = settled(data.drop("drawn").mapInArrow(blocks, "bins binary, numbers binary, held binary"), "boost-blocks")
    wrote = Rounds(spark, "boost-state")

    def load(it: Iterator) -> Iterator[Block]:
        """The blocks of a partition, small ones joined."""
        kept: list[Block] = []
        for r in it:
            held = np.frombuffer(r.held, bool)
            score = np.frombuffer(r.score).reshape(len(bases), -1) if "score" in r else np.repeat(bases, len(held), axis=1)
            b = np.frombuffer(r.bins, np.uint8).reshape(width, -1), np.frombuffer(r.numbers).reshape(kinds, -1), held, score
            if kept and sum(len(x[2]) for x in kept) + len(held) > most:
                yield tuple(np.concatenate(x, axis=-1) for x in zip(*kept))
                kept = []
            kept.append(b)
        if kept:
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*kept))

    def dealt(blocks: DataFrame) -> RDD:
        """Blocks in turn, so that all partitions have about as many rows."""
        return blocks.rdd.zipWithIndex().map(lambda x: (x[1], x[0])).partitionBy(parts, lambda i: i).values().mapPartitions(load).persist(StorageLevel.MEMORY_AND_DISK)

    state = dealt(stored)
    tasks = max(1, min(parts, sum(len(f.columns) for f in fits), spark.sparkContext.defaultParallelism))
    specs, held_sums, old, moves = [t.spec for t in targets], None, None, 0
    growing = {k: _grow(f, t.spec, m) for k, (f, t, m) in enumerate(zip(fits, targets, models))}
    asked, done = {}, [0] * len(models)
    for k, g in list(growing.items()):
        asked[k] = next(g)
    while asked:
        fresh = [m.trees[d:] for m, d in zip(models, done)]
        if max(map(len, fresh)) >= STRIDE:
            old, moves, new = state, moves + 1, spark.sparkContext.broadcast((fits, fresh))
            state = old.map(lambda b, new=new: _moved(b, *new.value))
            if moves % WRITE == 0:
                rows_of = state.map(lambda b: (b[0].tobytes(), b[1].tobytes(), b[2].tobytes(), b[3].tobytes()))
                state = dealt(wrote.put(spark.createDataFrame(rows_of, "bins binary, numbers binary, held binary, score binary")))
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            done, fresh = [len(m.trees) for m in models], [[] for _ in models]
        now = {k: r for k, r in asked.items() if r.kin[0][0] >= 0}  # models that have ended their tree wait for the others
        begins = not now
        now = now or dict(asked)
        job = (fits, fresh, now, specs)

        def one(it: Iterator[Block], job=job) -> Iterator[tuple]:
            fits, fresh, now, _ = job
            total: dict = {}
            for b in it:
                for k, (hist, loss) in _sums(_moved(b, fits, fresh), fits, now).items():
                    if k in total:
                        total[k][0].__iadd__(hist)
                        total[k][1] += loss
                    else:
                        total[k] = [hist, loss]
            for k, (hist, loss) in total.items():
                yield (k, -1), loss
                for j, size in enumerate(fits[k].widths):
                    part = hist[:, j, :, :size]
                    yield (k, j), (part[0].copy(), part[1].astype(np.int32), *part[2:].copy())

        def cut(it: Iterator[tuple], job=job) -> Iterator[tuple]:
            """Sums of the nodes of each feature, and at last per model: the best cut of each node among the task's features, sums of the
            first node, loss."""
            fits, _, now, specs = job
            total: dict = {}
            held: dict = {}
            found: dict[int, list] = {}
            for key, v in it:
                if key[1] < 0:
                    found.setdefault(key[0], [{}, None, 0.0])[2] += v
                elif isinstance(v, dict):
                    held[key] = v
                else:
                    total[key] = [a + b for a, b in zip(total[key], v)] if key in total else [x.astype(float) for x in v]
            for key, sums in total.items():
                k, j = key
                got = found.setdefault(k, [{}, None, 0.0])
                new, cuts, first = _split(held.pop(key, {}), sums, now[k], fits[k], specs[k])
                for node, gain, at, below in cuts:
                    got[0][node] = _better(got[0].get(node), (gain, j, at, below))
                if j == 0:
                    got[1] = first
                yield key, new
            yield None, found

        sums = state.mapPartitions(one)
        if not begins:  # the parents' sums are dealt along with the new ones
            parents = {k: {parent for parent, _ in r.kin} for k, r in now.items()}
            sums = sums.union(held_sums.flatMap(lambda x, parents=parents: [(x[0], {n: x[1][n] for n in parents[x[0][0]]})] if x[0] is not None and x[0][0] in parents else []))
        level = sums.partitionBy(tasks).mapPartitions(cut, True).persist(StorageLevel.MEMORY_AND_DISK)
        got: dict[int, list] = {k: [{}, None, 0.0] for k in now}
        for k, (cuts, first_sums, loss) in level.filter(lambda x: x[0] is None).flatMap(lambda x: x[1].items()).collect():  # a cut per node and task
            for node, c in cuts.items():
                got[k][0][node] = _better(got[k][0].get(node), c)
            got[k][1] = got[k][1] if first_sums is None else first_sums
            got[k][2] += loss / fits[k].loss_grid / 2 / (fits[k].held_weight or 1.0)
        if old is not None:  # the new state was made by this job
            old.unpersist()
            old = None
        if held_sums is not None:
            held_sums.unpersist()
        held_sums = level
        for k in now:
            try:
                asked[k] = growing[k].send(tuple(got[k]))
            except StopIteration:
                del asked[k]
    if held_sums is not None:
        held_sums.unpersist()
    state.unpersist()
    fitted = dict(zip(targets, models))
    return [fitted[t] for t in wanted]


def _moments(data: DataFrame, targets: list[Target], n_cols: list[str], numbers: list[str], n: int) -> list[dict]:
    """Per target lo, hi of the label, w, the greatest weight, held, the weight kept back, and sums of weights and weighted labels over the
    rows that are fitted, all from one reading. Decimals add up exactly, in any order."""
    aggs = []
    for i, t in enumerate(targets):
        y, w = F.col(n_cols[numbers.index(t.label)]), F.col(n_cols[numbers.index(t.weight)]) if t.weight else F.lit(1.0)
        used = ~F.col("held") if n > t.spec.hold_above and t.spec.holdout > 0 else F.lit(True)
        exact = lambda c, used=used: F.sum(F.when(used, c.cast("decimal(28,9)")))
        of = {"lo": F.min(y), "hi": F.max(y), "w": F.max(w), "held": F.sum(F.when(F.col("held"), w)), "sum_yw": exact(y * w), "sum_w": exact(w)}
        aggs.append({name: c.alias(f"{name}_{i}") for name, c in of.items()})
    r = data.agg(*[c for a in aggs for c in a.values()]).first()
    return [{name: r[f"{name}_{i}"] for name in a} for i, a in enumerate(aggs)]


def _joined(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of the batches in tables of ``most`` rows; the last holds what is left."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        while kept and sum(x.num_rows for x in kept) + b.num_rows > most or b.num_rows > most:
            room = most - sum(x.num_rows for x in kept)
            yield pa.Table.from_batches([*kept, b.slice(0, room)])
            kept, b = [], b.slice(room)
        if b.num_rows:
            kept.append(b)
    if kept:
        yield pa.Table.from_batches(kept)


def save(model: Trees, spark: SparkSession, path: str) -> None:
    """A table of nodes (tree, node, column, edge, left, right, value); the row with tree -1 holds the base, one with tree
    -2 each column's name in order."""
    rows = [(-1, 0, None, None, -1, -1, model.base)] + [(-2, j, c, None, -1, -1, 0.0) for j, c in enumerate(model.columns)]
    for k, t in enumerate(model.trees):
        for i in range(len(t.feature)):
            f = int(t.feature[i])
            rows.append((k, i, model.columns[f] if f >= 0 else None, float(model.edges[f][t.cut[i]]) if f >= 0 else None, int(t.left[i]), int(t.right[i]), float(t.value[i])))
    spark.createDataFrame(rows, "tree int, node int, column string, edge double, left int, right int, value double").coalesce(1).write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> Trees:
    """A saved model; its size depends on its settings alone."""
    rows = spark.read.parquet(path).toPandas().sort_values(["tree", "node"])
    names = tuple(rows[rows.tree == -2].column)
    edges = [np.unique(rows[(rows.tree >= 0) & (rows.column == c)].edge.to_numpy(np.float64)) for c in names]
    model = Trees(names, edges, float(rows[rows.tree == -1].value.iloc[0]))
    for _, t in rows[rows.tree >= 0].groupby("tree"):
        f = np.array([names.index(c) if isinstance(c, str) else -1 for c in t.column], np.int32)
        cut = np.array([np.searchsorted(edges[j], e) if j >= 0 else -1 for j, e in zip(f, t.edge)], np.int32)
        model.trees.append(Tree(f, cut, t.left.to_numpy(np.int32), t.right.to_numpy(np.int32), t.value.to_numpy(np.float64)))
    return model
