"""Shortest routes between node pairs, with road-class preference and turn cost.

The state of a search is (node, node before it), so turn costs are exact. Distinct pairs are routed once and joined
back by the caller. A road graph of up to BROADCAST_EDGES edges is sent to the tasks, which search with a heap. A larger
one is never sent anywhere: pairs meet the edges of the nine map tiles around their start, and a search that would go on from
a node outside of these is left to wider tiles; what is left in the end, or lies in tiles of too many edges, is relaxed by
joins, one edge per round. All ways give the same routes, also
where ``most`` ends a search: a pair has no route if at least that many states have a lower bound (cost so far and
straight line to the target) below the cost of its cheapest route.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, angle_diff_deg, haversine_m
from ..sources.work import Rounds, settled

BROADCAST_EDGES = 2_000_000
#: Costs in metres that differ by less count as equal where states are counted.
SAME_COST = 1e-6
ROUTE = "u long, v long, dist_m double, cost double, path array<long>"
#: Width in degrees of the smallest tiles, most edges of nine tiles that a task holds, pairs of a tile that a task searches.
TILE, TILE_EDGES, TILE_PAIRS = 0.02, 200_000, 256
#: So many nodes around the wanted pairs are sent to the tasks, more are shuffled.
SENT_NODES = 200_000


class _Left(Exception):
    """A search has come to a node outside of the edges at hand."""


def edge_cost(dist, penalty, class_weight: float):
    return dist * (1.0 + max(class_weight, 0.0) * (F.greatest(penalty, F.lit(1.0)) - 1.0))


def turn_cost(before, after, penalty_m: float, threshold_deg: float):
    """0 up to the threshold, then growing evenly to the full penalty at 180 degrees; 0 if a bearing is undefined."""
    t = max(0.0, min(179.0, threshold_deg))
    over = (angle_diff_deg(before, after) - t) / max(1e-6, 180.0 - t)
    return F.coalesce(F.greatest(F.lit(0.0), over) * max(penalty_m, 0.0), F.lit(0.0))


class _Graph:
    """Adjacency for the search in tasks. Edges that begin at nodes of ``outside`` are not at hand."""

    def __init__(self, edges: pd.DataFrame, nodes: pd.DataFrame, outside: set[int] = frozenset()) -> None:
        self.outside = outside
        self.at = {n: (x, y) for n, x, y in zip(nodes["node_id"].tolist(), nodes["lon"].tolist(), nodes["lat"].tolist())}
        self.out: dict[int, list[tuple]] = {}
        for s, d, m, b, c in zip(*(edges[k].tolist() for k in ("src", "dst", "dist_m", "bearing", "class_penalty"))):
            self.out.setdefault(s, []).append((d, m, None if b is None or b != b else b, c))

    def straight(self, a: int, b: int) -> float:
        (x1, y1), (x2, y2) = self.at[a], self.at[b]
        p, q = math.radians(y1), math.radians(y2)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))

    def reach(self, u: int, targets: set[int], class_weight: float, penalty_m: float, threshold: float) -> tuple[dict[int, tuple[float, float, list[int]]], bool]:
        """({target: (metres, cost, nodes)}, whether the search came to a node outside): routes from one node to many."""
        limit = max(0.0, min(179.0, threshold))
        todo, found = set(targets), {}
        best = {(u, -1): 0.0}
        came: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(0.0, 0.0, u, -1, None)]
        done: set[tuple[int, int]] = set()
        while heap and todo:
            cost, metres, node, before, bearing = heapq.heappop(heap)
            state = (node, before)
            if state in done:
                continue
            done.add(state)
            if node in todo:
                todo.discard(node)
                at, path = state, [node]
                while at in came:
                    at = came[at]
                    path.append(at[0])
                found[node] = metres, cost, path[::-1]
            if node in self.outside:
                return found, bool(todo)
            for nxt, m, b, c in self.out.get(node, ()):
                new, total = (nxt, node), cost + self.step(m, b, c, bearing, class_weight, penalty_m, limit)
                if new not in done and total < best.get(new, math.inf):
                    best[new] = total
                    came[new] = state
                    heapq.heappush(heap, (total, metres + m, nxt, node, b))
        return found, False

    @staticmethod
    def step(m: float, b: float | None, c: float, bearing: float | None, class_weight: float, penalty_m: float, limit: float) -> float:
        step = m * (1.0 + max(class_weight, 0.0) * (max(c, 1.0) - 1.0))
        if penalty_m > 0 and bearing is not None and b is not None:
            turn = abs((b - bearing + 180.0) % 360.0 - 180.0)
            if turn > limit:
                step += penalty_m * (turn - limit) / max(1e-6, 180.0 - limit)
        return step

    def route(self, u: int, v: int, class_weight: float, penalty_m: float, threshold: float, most: int | None) -> tuple[float, float, list[int]] | None:
        """(metres, cost, nodes): least cost first, the straight line to the target as lower bound. Raises _Left at a node
        outside: until then, all states of a lower bound were at hand."""
        if u not in self.at or v not in self.at:
            return None
        if u == v:
            return 0.0, 0.0, [u]
        limit = max(0.0, min(179.0, threshold))
        best = {(u, -1): 0.0}
        came: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(self.straight(u, v), 0.0, 0.0, u, -1, None)]
        done: set[tuple[int, int]] = set()
        below, level = 0, 0.0  # states whose bound lies below the present one; bounds never fall
        while heap:
            bound, cost, metres, node, before, bearing = heapq.heappop(heap)
            state = (node, before)
            if state in done:
                continue
            if bound > level + SAME_COST:
                below, level = len(done), bound
                if most is not None and below >= most:
                    return None
            done.add(state)
            if node == v:
                path = [node]
                while state in came:
                    state = came[state]
                    path.append(state[0])
                return metres, cost, path[::-1]
            if node in self.outside:
                raise _Left
            for nxt, m, b, c in self.out.get(node, ()):
                new, total = (nxt, node), cost + self.step(m, b, c, bearing, class_weight, penalty_m, limit)
                if new not in done and total < best.get(new, math.inf):
                    best[new] = total
                    came[new] = state
                    heapq.heappush(heap, (total + self.straight(nxt, v), total, metres + m, nxt, node, b))
        return None


_KEPT: dict[str, _Graph] = {}


def _kept_graph(token: str, held) -> _Graph:
    """The graph of a job, built once per worker process, which keeps one."""
    if token not in _KEPT:
        _KEPT.clear()
        _KEPT[token] = _Graph(*held.value)
    return _KEPT[token]


def routes(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, class_weight: float = 1.0, turn_penalty_m: float = 55.0, turn_threshold_deg: float = 55.0, most: int | None = 7000, broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """u, v, dist_m (true length of the preferred route), cost, path for each distinct pair that has a route.

    The result is a written table, as recoveries read it more than once. most leaves out pairs whose search is larger (see
    above); None searches on."""
    want = settled(pairs.select("u", "v").distinct(), "wanted")
    same = want.where("u = v").join(nodes.select(F.col("node_id").alias("u")), "u", "left_semi").select("u", "v", F.lit(0.0).alias("dist_m"), F.lit(0.0).alias("cost"), F.array("u").alias("path"))
    want = want.where("u <> v")
    n = edges.count()
    if n > broadcast_edges:
        found, rest = by_tiles(want, edges, nodes, class_weight, turn_penalty_m, turn_threshold_deg, most)
        if not rest.isEmpty():
            found = found.unionByName(relax(rest, edges, nodes, class_weight, turn_penalty_m, turn_threshold_deg, most))
        return settled(found.unionByName(same), "routes")
    spark = pairs.sparkSession
    used = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()
    held = spark.sparkContext.broadcast((edges.select("src", "dst", "dist_m", "bearing", "class_penalty").toPandas(), nodes.select("node_id", "lon", "lat").join(used, "node_id", "left_semi").toPandas()))  # bounded above

    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            graph = _kept_graph(token, held)
            rows = []
            for u, v in zip(b["u"].tolist(), b["v"].tolist()):
                got = graph.route(u, v, class_weight, turn_penalty_m, turn_threshold_deg, most)
                if got:
                    rows.append((u, v, *got))
            yield pd.DataFrame(rows, columns=["u", "v", "dist_m", "cost", "path"])

    # a search costs far more than its row: fixed partitions, which adaptive execution leaves apart
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return settled(want.repartition(parts, "u", "v").mapInPandas(run, ROUTE).unionByName(same), "routes")


def by_tiles(want: DataFrame, edges: DataFrame, nodes: DataFrame, class_weight: float = 1.0, turn_penalty_m: float = 55.0, turn_threshold_deg: float = 55.0, most: int | None = None, tile: float = TILE, tile_edges: int = TILE_EDGES, widen: int = 2) -> tuple[DataFrame, DataFrame]:
    """(routes, pairs that are not settled) between different nodes, on graphs that no task can hold.

    A pair goes to the tile of its first node, of doubled widths the first that is twice as wide as the pair is long, and meets
    there the edges that begin in this tile and the eight around it; only edges within reach of some pair's tiles are placed. A search takes states in order of their bound (of their
    cost, without ``most``, when all targets of a node are searched at once), so its result is the one of the whole graph as long
    as it has not come to a node outside. Pairs whose search has are tried in tiles of twice the width, ``widen`` times."""
    at = lambda c, n: nodes.select(F.col("node_id").alias(c), F.col("lon").alias(f"x{n}"), F.col("lat").alias(f"y{n}"))
    long = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.lit(1e-12))
    todo = settled(want.join(at("u", 0), "u").join(at("v", 1), "v").withColumn("k", F.greatest(F.lit(0), F.ceil(F.log2(2 * long / tile))).cast("int")), "goals")
    x0, x1, y0, y1, k = todo.agg(F.min("x0"), F.max("x0"), F.min("y0"), F.max("y0"), F.max("k")).first()
    if k is None:
        x0 = x1 = y0 = y1 = k = 0
    reach = 2 * tile * 2.0 ** (k + widen)  # no search at hand begins an edge farther from the first nodes than this
    begin = at("src", 0).where(F.col("x0").between(x0 - reach, x1 + reach) & F.col("y0").between(y0 - reach, y1 + reach))
    few = begin.limit(SENT_NODES + 1).count() <= SENT_NODES
    e = edges.select("src", "dst", "dist_m", "bearing", "class_penalty").join(F.broadcast(begin) if few else begin, "src")
    e = settled(e.join(at("dst", 1), "dst"), "placed")
    size = tile * F.pow(F.lit(2.0), F.col("k"))
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    key, task = ["k", "gx", "gy"], ["k", "gx", "gy", "part"]
    found = rest = None

    def run(pairs: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        places = [near[["src", "x0", "y0"]], near[["dst", "x1", "y1"]], pairs[["u", "x0", "y0"]], pairs[["v", "x1", "y1"]]]
        graph = _Graph(near, pd.concat([p.set_axis(["node_id", "lon", "lat"], axis=1) for p in places]).drop_duplicates("node_id"), set(near.loc[near["out"], "dst"].tolist()))
        rows = []
        for u, same in pairs.groupby("u"):
            targets = same["v"].tolist()
            if most is None:
                got, left = graph.reach(u, set(targets), class_weight, turn_penalty_m, turn_threshold_deg)
                rows += [(u, v, *got.get(v, (None, None, None)), left and v not in got) for v in targets]
                continue
            for v in targets:
                try:
                    rows.append((u, v, *(graph.route(u, v, class_weight, turn_penalty_m, turn_threshold_deg, most) or (None, None, None)), False))
                except _Left:
                    rows.append((u, v, None, None, None, True))
        return pd.DataFrame(rows, columns=["u", "v", "dist_m", "cost", "path", "open"])

    for _ in range(widen + 1):
        goals = todo.withColumn("gx", cell("x0")).withColumn("gy", cell("y0"))
        tiles = settled(goals.groupBy(*key).agg(F.ceil(F.count("*") / TILE_PAIRS).cast("int").alias("parts")), "tiles")
        levels = [r.k for r in tiles.select("k").distinct().collect()]
        if not levels:
            break
        around = tiles.withColumn("cx", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)))
        near = e.withColumn("k", F.explode(F.array(*map(F.lit, levels)))).withColumn("cx", cell("x0")).withColumn("cy", cell("y0")).join(around, ["k", "cx", "cy"])
        near = settled(near.withColumn("out", (F.abs(cell("x1") - F.col("gx")) > 1) | (F.abs(cell("y1") - F.col("gy")) > 1)).drop("cx", "cy"), "tile-edges")
        full = near.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > tile_edges).select(*key)
        dealt = goals.join(tiles, key).join(full, key, "left_anti").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
        held = near.join(full, key, "left_anti").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        got = settled(dealt.groupBy(*task).cogroup(held.groupBy(*task)).applyInPandas(run, f"{ROUTE}, open boolean"), "tile-routes")
        done = got.where("path is not null").drop("open")
        found = done if found is None else found.unionByName(done)
        over = goals.join(full, key, "left_semi").select("u", "v")
        rest = over if rest is None else rest.unionByName(over)
        todo = settled(todo.join(got.where("open").select("u", "v"), ["u", "v"], "left_semi").withColumn("k", F.col("k") + 1), "goals")
    left = todo.select("u", "v")
    if found is None:
        return left.limit(0).select("u", "v", *[F.lit(None).cast(t).alias(c) for c, t in (("dist_m", "double"), ("cost", "double"), ("path", "array<long>"))]), left
    return found, settled(left.unionByName(rest), "rest")


def landmarks(edges: DataFrame, nodes: DataFrame, count: int = 8, class_weight: float = 1.0, rounds: int = 10_000) -> DataFrame:
    """(node_id, away array, back array): least costs, without turn cost, from each landmark to the node and from the node to
    each landmark; infinite where there is no way. Landmarks are the outermost nodes of ``count`` directions.

    Rounds of joins over (landmark, node); only nodes that got nearer go on. As many rounds as the longest cheapest route has
    edges, so the table is made once per map and kept (``sources.versions``)."""
    spark = edges.sparkSession
    used = nodes.join(edges.select(F.col("src").alias("node_id")).union(edges.select(F.col("dst").alias("node_id"))).distinct(), "node_id", "left_semi")
    turns = [2 * math.pi * k / count for k in range(count)]
    far = used.agg(*[F.max_by("node_id", F.struct(F.col("lon") * math.cos(t) + F.col("lat") * math.sin(t), -F.col("node_id"))).alias(str(k)) for k, t in enumerate(turns)]).first()
    chosen = list(dict.fromkeys(far[str(k)] for k in range(count) if far[str(k)] is not None))
    if not chosen:
        return nodes.limit(0).select("node_id", F.array().cast("array<double>").alias("away"), F.array().cast("array<double>").alias("back"))
    step = settled(edges.select("src", "dst", edge_cost(F.col("dist_m"), F.col("class_penalty"), class_weight).alias("c")).groupBy("src", "dst").agg(F.min("c").alias("c")), "steps")
    # both directions at once: ``out`` tells whether edges are walked forwards
    both = step.select(F.lit(True).alias("out"), F.col("src").alias("at"), F.col("dst").alias("to"), "c").unionByName(step.select(F.lit(False).alias("out"), F.col("dst").alias("at"), F.col("src").alias("to"), "c"))
    start = [(o, k, n, 0.0, True) for k, n in enumerate(chosen) for o in (True, False)]
    kept = Rounds(spark, "landmarks")
    best = kept.put(spark.createDataFrame(start, "out boolean, mark int, at long, cost double, open boolean"))
    for _ in range(rounds):
        grown = best.where("open").join(both, ["out", "at"]).select("out", "mark", F.col("to").alias("at"), (F.col("cost") + F.col("c")).alias("cost"), F.lit(True).alias("open"))
        every = best.withColumn("open", F.lit(False)).unionByName(grown)
        best = kept.put(every.groupBy("out", "mark", "at").agg(F.min(F.struct("cost", "open")).alias("s")).select("out", "mark", "at", "s.cost", "s.open"))
        if best.where("open").isEmpty():
            break
    else:
        raise RuntimeError(f"landmarks are not settled after {rounds} rounds")
    row = lambda out: F.transform(F.sequence(F.lit(0), F.lit(len(chosen) - 1)), lambda k: F.coalesce(F.element_at(F.map_from_entries(F.collect_list(F.when(F.col("out") == out, F.struct("mark", "cost")))), k), F.lit(float("inf"))))
    return settled(best.groupBy(F.col("at").alias("node_id")).agg(row(True).alias("away"), row(False).alias("back")), "landmarks")


def _lower(away, back, away_v, back_v):
    """Lower bound from a node to the target by the triangle rule, over all landmarks: away(v) - away(n) and back(n) - back(v);
    pairs of infinities say nothing."""
    gap = lambda a, b: F.when((a < float("inf")) & (b < float("inf")), a - b).otherwise(0.0)
    one = F.coalesce(F.array_max(F.zip_with(away_v, away, gap)), F.lit(0.0))
    two = F.coalesce(F.array_max(F.zip_with(back, back_v, gap)), F.lit(0.0))
    return F.greatest(F.lit(0.0), one, two)


def relax(want: DataFrame, edges: DataFrame, nodes: DataFrame, class_weight: float = 1.0, turn_penalty_m: float = 55.0, turn_threshold_deg: float = 55.0, most: int | None = None, marks: DataFrame | None = None, window_m: float = 2000.0, rounds: int = 10_000) -> DataFrame:
    """Routes between different nodes by rounds of joins, for graphs of which no task can hold a pair's tiles.

    All pairs advance together, each from its own cheapest states: a round grows the open states whose lower bound (cost so
    far plus a bound of the rest) lies within ``window_m`` of the pair's least one. So a pair never visits a state whose
    bound exceeds its route's cost by more than the window, from the first round on, and it ends as soon as no open
    state can be cheaper. The rest is bounded by the straight line, or by ``marks`` (``landmarks`` of the same class weight) where
    they say more. ``most`` ends a pair as soon as that many settled states lie below all open ones; it is defined by the straight line, so marks are
    not used with it. Each round writes one table. Raises if the rounds run out first."""
    states = _search(want, edges, nodes, class_weight, turn_penalty_m, turn_threshold_deg, most, marks, window_m, rounds)
    out = states.where("node = v").groupBy("u", "v").agg(F.min_by(F.struct("dist_m", "cost", "path"), F.struct("cost", "dist_m")).alias("s")).select("u", "v", "s.dist_m", "s.cost", "s.path")
    if most is None:
        return out
    size = states.join(out.select("u", "v", F.col("cost").alias("_goal")), ["u", "v"]).where(f"bound < _goal - {SAME_COST}").groupBy("u", "v").agg(F.count("*").alias("_n")).where(F.col("_n") >= most)
    return out.join(size.select("u", "v"), ["u", "v"], "left_anti")


def _search(want: DataFrame, edges: DataFrame, nodes: DataFrame, class_weight: float, turn_penalty_m: float, turn_threshold_deg: float, most: int | None, marks: DataFrame | None, window_m: float, rounds: int) -> DataFrame:
    """All states that the pairs visited, as a written table."""
    spark = want.sparkSession
    place = nodes.select("node_id", "lon", "lat")
    if marks is not None and most is None:
        place = place.join(marks, "node_id", "left")
    else:
        place = place.withColumns({c: F.lit(None).cast("array<double>") for c in ("away", "back")})
    place = settled(place, "places")
    at = lambda c: place.select(F.col("node_id").alias(c), *[F.col(x).alias(f"_{x}_{c}") for x in ("lon", "lat", "away", "back")])
    e = edges.select("src", "dst", F.col("dist_m").alias("d2"), F.col("bearing").alias("b2"), edge_cost(F.col("dist_m"), F.col("class_penalty"), class_weight).alias("c2"))
    e = settled(e.join(at("dst"), "dst").join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi"), "steps")

    def rest(n: str):
        straight = haversine_m(f"_lon_{n}", f"_lat_{n}", "_lon_v", "_lat_v")
        by_marks = _lower(F.col(f"_away_{n}"), F.col(f"_back_{n}"), F.col("_away_v"), F.col("_back_v"))
        return F.greatest(straight, by_marks)

    kept = Rounds(spark, "states")
    target = ["_lon_v", "_lat_v", "_away_v", "_back_v"]
    goals = settled(want.join(at("v"), "v").select("u", "v", *target), "goals")
    state = kept.put(goals.join(at("u"), "u").select(
        "u", "v", F.col("u").alias("node"), F.lit(-1).cast("long").alias("before"), F.lit(None).cast("double").alias("bearing"), F.lit(0.0).alias("cost"),
        rest("u").alias("bound"), F.lit(0.0).alias("dist_m"), F.array("u").alias("path"), F.lit(True).alias("open")))
    key = ["u", "v", "node", "before"]
    inner = [c for c in state.columns if c not in key]
    for _ in range(rounds):
        pair = state.groupBy("u", "v").agg(F.min(F.when(F.col("open"), F.col("bound"))).alias("_least"), F.min(F.when(F.col("node") == F.col("v"), F.col("cost"))).alias("_goal"))
        if most is not None:
            # with the straight line a state below all open ones is settled for good
            done = state.where("not open").join(pair, ["u", "v"]).where(f"bound < _least - {SAME_COST}").groupBy("u", "v").agg(F.count("*").alias("_n"))
            pair = pair.join(done, ["u", "v"], "left").where(F.coalesce(F.col("_n"), F.lit(0)) < most).drop("_n")
        live = f"_least is not null and (_goal is null or bound < _goal + {SAME_COST}) and bound <= _least + {window_m}"
        marked = state.join(pair, ["u", "v"], "left").withColumn("_grow", F.expr(f"open and node <> v and {live}")).drop("_least", "_goal")
        cost = F.col("cost") + F.col("c2") + turn_cost(F.col("bearing"), F.col("b2"), turn_penalty_m, turn_threshold_deg)
        grown = marked.where("_grow").join(goals, ["u", "v"]).join(e, F.col("node") == F.col("src")).select(
            "u", "v", F.col("dst").alias("node"), F.col("node").alias("before"), F.col("b2").alias("bearing"), cost.alias("cost"), (cost + rest("dst")).alias("bound"),
            (F.col("dist_m") + F.col("d2")).alias("dist_m"), F.concat("path", F.array("dst")).alias("path"), (F.col("dst") != F.col("v")).alias("open"), F.lit(True).alias("_new"), F.lit(True).alias("_hit"))
        old = marked.select(*state.columns, F.lit(False).alias("_new"), F.coalesce("_grow", F.lit(False)).alias("_hit")).withColumn("open", F.col("open") & ~F.col("_hit"))
        every = old.unionByName(grown)
        nxt = every.groupBy(*key).agg(F.min_by(F.struct(*inner, "_hit"), F.struct("cost", "_new")).alias("s")).select(*key, *[F.col(f"s.{c}").alias(c) for c in [*inner, "_hit"]])
        state = kept.put(nxt)
        ended = state.where("_hit").isEmpty()
        state = state.drop("_hit")
        if ended:
            break
    else:
        raise RuntimeError(f"routes are not settled after {rounds} rounds")
    return state
