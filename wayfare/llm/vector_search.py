"""Nearest neighbours by collision counting: every vector is projected on random lines and each line keeps
its vectors in a sorted array. Around a query a window grows on all lines at once (virtual rehashing: a
wider window is the same array read further out, nothing is hashed again). A vector that falls into the
windows of enough lines is verified by its true distance. A query stops at radius R when it has verified
k vectors within R.

A shard of the vectors (by hash of the id) goes to one task, which builds the sorted arrays once and then reads the
queries as a stream; only beyond QUERY_ROWS queries they are split into blocks, each with its own copy of the
shards, so that tasks stay bounded. The k best per shard meet per query.

Defined results: vectors that are null, zero, or hold a null or non-finite number take no part; vectors
of different length are not compared; a row repeated with the same id counts once; an id that names several
vectors stands for all of them: its distance is the least of any pair; ties go to the smaller id; with fewer
than k candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, table

#: Lines, share of lines in whose windows a vector has to fall, window half-width per radius, growth of
#: the radius, and the share of a shard in the first windows.
LINES, SHARE, WIDTH, GROWTH, FIRST = 48, 0.55, 1.0, 1.15, 0.2
SHARD_ROWS, QUERY_ROWS, LEAST_SHARDS = 32768, 131072, 8


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


class Shard:
    """Vectors with their projections sorted on every line."""

    def __init__(self, base: np.ndarray, ids: np.ndarray, seed: int = 5) -> None:
        self.base, self.ids, self.verified = base, ids, 0
        self.n_ids = len(np.unique(ids))
        self.several = self.n_ids < len(ids)
        self.lines = np.random.default_rng(seed).standard_normal((base.shape[1], LINES))
        proj = np.ascontiguousarray((base @ self.lines).T)
        self.order = np.argsort(proj, axis=1, kind="stable").astype(np.int32)
        self.arrays = np.take_along_axis(proj, self.order, axis=1)


def search_shard(shard: Shard, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest found of each query in the shard: query ids, base ids, distances. ``shard.verified`` counts the vectors
    whose true distance was taken."""
    base, base_ids, lines, arrays, order = shard.base, shard.ids, shard.lines, shard.arrays, shard.order
    n = len(base)
    need = int(np.ceil(SHARE * LINES))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 128):
        qs, qids = queries[at : at + 128], query_ids[at : at + 128]
        centre = qs @ lines
        lo = np.stack([a.searchsorted(c) for a, c in zip(arrays, centre.T)], axis=1)
        hi = lo.copy()
        own = base_ids[None, :] == qids[:, None]
        want = np.minimum(k, shard.n_ids - own.any(axis=1))
        count = np.zeros(own.shape, np.int16)
        seen = own
        dist = np.full(own.shape, np.inf)
        # first windows: half of the lines hold about FIRST of the shard in them
        reach = max(k, int(n * FIRST / 2))
        edge = [np.minimum(a[np.minimum(i + reach, n - 1)] - c, c - a[np.maximum(i - reach, 0)]) for a, c, i in zip(arrays, centre.T, lo.T)]
        radius = np.maximum(np.median(np.maximum(edge, 0), axis=0), 1e-9)
        active = np.flatnonzero(want > 0)
        while len(active):
            half = WIDTH * radius[active]
            for j in range(LINES):
                c = centre[active, j]
                new_lo = np.minimum(arrays[j].searchsorted(c - half, "left"), lo[active, j])
                new_hi = np.maximum(arrays[j].searchsorted(c + half, "right"), hi[active, j])
                for q, a, b, x, y in zip(active, new_lo, lo[active, j], hi[active, j], new_hi):
                    row = count[q]
                    row[order[j, a:b]] += 1
                    row[order[j, x:y]] += 1
                lo[active, j], hi[active, j] = new_lo, new_hi
            for q in active:
                new = np.flatnonzero((count[q] >= need) & ~seen[q])
                if len(new):
                    seen[q, new] = True
                    shard.verified += len(new)
                    d = base[new] - qs[q]
                    dist[q, new] = np.sqrt((d * d).sum(axis=1))
            near = dist[active] <= radius[active, None]
            # an id of several vectors is one neighbour
            got = np.array([len(np.unique(base_ids[x])) for x in near]) if shard.several else near.sum(axis=1)
            open_ = (got < want[active]) & ~seen[active].all(axis=1)
            active = active[open_]
            radius[active] *= GROWTH
        for q in np.flatnonzero(want > 0):
            found = np.flatnonzero(np.isfinite(dist[q]))
            best = found[np.lexsort((base_ids[found], dist[q, found]))]
            if shard.several:
                best = best[np.sort(np.unique(base_ids[best], return_index=True)[1])]
            best = best[:k]
            out.append((np.full(len(best), qids[q]), base_ids[best], dist[q, best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for the rows of vectors where is_query holds."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(usable(F.col("v")) & F.col("id").isNotNull())
    n, nq = v.agg(F.count("*"), F.count_if("q")).first()
    shards = max(-(-n // SHARD_ROWS), min(LEAST_SHARDS, -(-n // 256)), 1)
    blocks = max(-(-nq // QUERY_ROWS), 1)
    dim = F.size("v").alias("dim")
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = v.select(dim, shard.alias("shard"), every(blocks).alias("block"), F.lit(False).alias("asks"), "id", "v")
    queries = v.where("q").select(dim, every(shards).alias("shard"), block.alias("block"), F.lit(True).alias("asks"), "id", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, built = None, [], None  # rows of a shard come first, then the queries it answers
        for batch in batches:
            for key, d in batch.groupby(["dim", "shard", "block"], sort=False):
                if key != now:
                    now, held, built = key, [], None
                held.append(d[~d["asks"]])
                ask = d[d["asks"]]
                if len(ask):
                    if built is None:
                        rows = pd.concat(held)
                        built, held = (Shard(*_distinct(rows)) if len(rows) else False), []
                    if built:
                        a, c, s = search_shard(built, np.stack(ask["v"].to_numpy()), ask["id"].to_numpy(), k)
                        yield pd.DataFrame({"query_id": a, "vec_id": c, "score": s})

    parts = max(shuffle_parts(vectors.sparkSession), shards * blocks)
    dealt = base.unionByName(queries).repartition(parts, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "asks")
    found = dealt.mapInPandas(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _distinct(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and ids of the rows by id, repeated rows once."""
    m, ids = np.stack(rows["v"].to_numpy()), rows["id"].to_numpy()
    first = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        both = np.column_stack([ids.astype(np.int64).view(np.float64), m])
        first = np.unique(both.view(np.uint64), axis=0, return_index=True)[1]
        first = first[np.argsort(ids[first], kind="stable")]
    return m[first], ids[first]


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op10_vector_search": op10_vector_search}
