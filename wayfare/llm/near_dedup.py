"""Near-duplicate groups by min-max hashing.

Every permutation yields two values, the least and the greatest hash of a document's shingle set, so half
the hash evaluations fill a signature; bands of the signature bring likely pairs into one bucket.

1. per document: shingle set, a 128-bit fingerprint of the set, signature bands.
2. documents with equal sets form one class; only classes go on.
3. classes in a bucket are tied to the bucket's least member (never to each other), which gives candidate
   clusters; a cluster holds every pair that shares a bucket.
4. clusters are verified on full sets. In one of more than BLOCK classes each class first meets the busiest hub that
   it is tied to; true links found so are contracted, and only classes of buckets that still hold several groups
   stay open. Open clusters, and small ones, are verified in tiles: classes are dealt to blocks of about BLOCK, a large
   group to blocks of its own, and every two blocks, but those of one group, meet in one bounded task, which counts
   exact intersections and returns a spanning forest of the true links, at most one row per class. Every pair that
   shares a bucket is compared, or known to be in one group already.
5. connected components of the true links.

A cluster of m classes that are near copies of each other costs about m comparisons; one of m classes of which few are
linked costs m * m / 2, in tiles.

Bands are as wide as the least similarity allows (``band_width``): a pair at that similarity misses all of
them with probability MISS at most. PERMUTATIONS 80 give 160 values; at 0.85 bands of 6 miss with 5e-6,
at 0.8 bands of 5 with 3e-6.

Defined results: a document without words has an empty set and is linked with nothing; fewer words than a
shingle make one shingle; repeated rows belong to one class; null ids belong to classes but name a group
only if it has no other id; extra columns are kept by drop_near_duplicates and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _TABLE, components, cut, mix, release, table, texts_of

PERMUTATIONS, BAND, BLOCK = 80, 6, 128
#: Greatest probability that a pair at the least similarity shares no band.
MISS = 1e-5
#: Bytes hashed at a time; a longer text is cut at a blank.
SLICE = 1 << 21

_ODD = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, from, to) of about SLICE bytes, texts cut only at blanks."""
    held, size = [], 0
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        while a < b:
            end = b
            if b - a > SLICE:
                step = a + SLICE
                while step < b:  # the next blank
                    blank = np.flatnonzero(_BLANK[data[step : min(step + 65536, b)]])
                    if len(blank):
                        end = step + int(blank[0])
                        break
                    step += 65536
            held.append((i, a, end))
            size += end - a
            a = end
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and 64-bit hash of every word, in order; A to Z count as a to z."""
    powers = np.full(1024, np.uint64(0x9E3779B97F4A7C15), np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    for group in _pieces(data, offsets):
        lens = np.array([b - a + 1 for _, a, b in group])
        joined = np.full(int(lens.sum()), 32, np.uint8)
        at = np.cumsum(lens) - lens
        for (_, a, b), k in zip(group, at):
            joined[k : k + b - a] = data[a:b]
        blank = _BLANK[joined]
        start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if not len(start):
            continue
        gap = np.diff(np.append(start, len(joined)))
        place = np.arange(start[0], len(joined)) - np.repeat(start, gap)
        top = int(place.max()) + 1
        if top > len(powers):
            more = np.full(top, np.uint64(0x9E3779B97F4A7C15), np.uint64)
            more[0] = 1
            powers = np.cumprod(more)
        value = _TABLE[_LOWER[joined[start[0] :]]] * powers[place]
        value[blank[start[0] :]] = 0
        h = mix(np.add.reduceat(value, start - start[0]))
        yield np.array([g[0] for g in group])[np.searchsorted(at, start, "right") - 1], h


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and its sorted distinct shingle hashes, rows with at least one word only, in order."""
    data, offsets = texts_of(column)
    held: list[np.ndarray] = []
    now = -1

    def one(w: np.ndarray) -> np.ndarray:
        n = max(len(w) - width + 1, 1)
        s = np.full(n, min(len(w), width), np.uint64)
        for k in range(min(width, len(w))):
            s = s * _ODD[200] + w[k : k + n] * _ODD[201 + k]
            s ^= s >> np.uint64(29)
        return np.unique(mix(s))

    for row, h in words(data, offsets):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if row[a] != now and held:
                yield now, one(np.concatenate(held))
                held = []
            now = int(row[a])
            held.append(h[a:b])
    if held:
        yield now, one(np.concatenate(held))


def min_max(values: np.ndarray, start: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Signatures of several sets (concatenated): per set the least and greatest value of each permutation."""
    out = np.empty((len(start), 2 * permutations), np.uint64)
    for k in range(permutations):
        x = values * _ODD[k]
        out[:, 2 * k] = np.minimum.reduceat(x, start)
        out[:, 2 * k + 1] = np.maximum.reduceat(x, start)
    return out


def band_width(percent: int, permutations: int = PERMUTATIONS) -> int:
    """The widest band, BAND at most, that misses a pair at ``percent`` with probability MISS at most."""
    for band in range(BAND, 0, -1):
        if (1 - (percent / 100) ** band) ** (2 * permutations // band) <= MISS:
            return band
    raise ValueError(f"{permutations} permutations are too few for {percent} per cent")


def band_keys(signature: np.ndarray, band: int = BAND) -> np.ndarray:
    n = signature.shape[1] // band
    cut_ = mix(signature[:, : n * band]).reshape(-1, n, band)
    key = np.arange(1, n + 1, dtype=np.uint64)[None, :] * _ODD[255]
    for k in range(band):
        key = mix(key + cut_[:, :, k] * _ODD[240 + k])
    return key


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, band: int = BAND) -> DataFrame:
    """id, th (hash of the text), n, cid and fp (the set's fingerprint), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            n, cid, fp = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            keys: list = [None] * rows
            held: list[tuple[int, np.ndarray]] = []

            def sign() -> None:
                sets = [s for _, s in held]
                start = np.cumsum([0] + [len(s) for s in sets[:-1]])
                k = band_keys(min_max(np.concatenate(sets), start), band).view(np.int64)
                size = np.array([len(s) for s in sets])
                rows_ = [i for i, _ in held]
                n[rows_] = size
                cid[rows_] = np.add.reduceat(np.concatenate(sets), start) + size.astype(np.uint64) * _ODD[254:255]
                fp[rows_] = np.add.reduceat(mix(np.concatenate(sets) ^ _ODD[253]), start)
                for i, key in zip(rows_, k):
                    keys[i] = key
                held.clear()

            size = 0
            for i, s in shingle_sets(b.column(2), width):
                held.append((i, s))
                size += len(s)
                if size > 200_000:
                    sign()
                    size = 0
            if held:
                sign()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(mix(cid).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["id", "th", "n", "cid", "fp", "bands"])

    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("th"), t.cast("binary").alias("b"))
    return d.mapInArrow(run, "id long, th long, n long, cid long, fp long, bands array<long>")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Adjacency: 100 * intersection >= percent * union, exact counts."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m <= 3:
        inter = np.diag(size).astype(np.int64)
        for i in range(m):
            for j in range(i):
                inter[i, j] = inter[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        value, who = np.concatenate(sets), np.repeat(np.arange(m), size)
        order = np.argsort(value, kind="stable")
        value, who = value[order], who[order]
        fresh = np.concatenate([[True], value[1:] != value[:-1]])
        col = np.cumsum(fresh) - 1
        shared = np.bincount(col)[col] > 1  # values of one set alone meet nothing
        who, col = who[shared], col[shared]
        inter = np.zeros((m, m), np.float64)
        if len(col):
            _, col = np.unique(col, return_inverse=True)
            edges = np.searchsorted(col, np.arange(0, col[-1] + 8193, 8192))
            for a, b in zip(edges[:-1], edges[1:]):
                part = np.zeros((m, 8192), np.float32)
                part[who[a:b], col[a:b] % 8192] = 1
                inter += part @ part.T
    union = size[:, None] + size[None, :] - inter
    return 100 * inter >= percent * union


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """Root (least index) of each node's component."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            front = np.zeros(len(adjacent), bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = adjacent[front].any(axis=0) & (root < 0)
    return root


def _in_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """cid, cluster, s, tile -> a spanning forest (u, v) of the true links between classes of one tile and cluster."""

    def verify(d: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for _, c in d.groupby("cluster", sort=False):
            if len(c) > 1:
                cid = c["cid"].to_numpy()
                root = _forest(linked([np.frombuffer(x, np.uint64) for x in c["s"]], percent))
                tied = np.flatnonzero(root != np.arange(len(cid)))
                u.append(cid[root[tied]])
                v.append(cid[tied])
        return pd.DataFrame({"u": np.concatenate(u) if u else np.zeros(0, np.int64), "v": np.concatenate(v) if v else np.zeros(0, np.int64)})

    return tiles.groupBy("tile").applyInPandas(verify, "u long, v long")


def _large(sets: DataFrame, near: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """True links (u, v) among the classes of large clusters: sets(cid, s), near(u hub, v), members(cid, key)."""
    near = near.join(classes.select(F.col("cid").alias("v")), "v", "left_semi")
    busy = cut(near.groupBy("u").agg(F.count("*").alias("n")), "busy")
    own = cut(near.join(busy, "u").groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")), "own")
    # a hub's followers come in parts, each with a copy of the hub's set
    parts = cut(own.groupBy("u").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts")), "parts")
    follow = own.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("cid"))
    lead = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("cid"))

    def star(d: pd.DataFrame) -> pd.DataFrame:
        hub = int(d["u"].iloc[0])
        cid, s = d["cid"].to_numpy(), [np.frombuffer(x, np.uint64) for x in d["s"]]
        k = int(np.flatnonzero(cid == hub)[0])
        same = np.array([len(np.intersect1d(x, s[k], assume_unique=True)) for x in s])
        either = np.array([len(x) for x in s]) + len(s[k]) - same
        return pd.DataFrame({"u": hub, "v": cid[(100 * same >= percent * either) & (cid != hub)]})

    first = cut(follow.unionByName(lead).join(sets, "cid").groupBy("u", "part").applyInPandas(star, "u long, v long"), "stars")
    tied = components(first, "stars").select(F.col("id").alias("cid"), F.col("component").alias("grp"))
    group = cut(classes.join(tied, "cid", "left").select("cid", F.coalesce("grp", "cid").alias("grp")), "groups")
    keyed = cut(members.join(group, "cid").select("key", "cid", "grp"), "keyed")
    open_keys = cut(keyed.groupBy("key").agg(F.min("grp").alias("a"), F.max("grp").alias("b"), F.min("cid").alias("u")).where("a < b").select("key", "u"), "open")
    if open_keys.isEmpty():
        return first
    still = keyed.join(open_keys, "key").select("u", F.col("cid").alias("v"))
    cluster = components(still, "open").select(F.col("id").alias("cid"), F.col("component").alias("cluster"))
    rows = cut(cluster.join(group, "cid"), "open-rows")
    # blocks: a group of at least BLOCK has its own, [at, at + n); all smaller groups of a cluster share some
    size = rows.groupBy("cluster", "grp").agg(F.count("*").alias("n"))
    own_blocks = F.when(F.col("n") >= BLOCK, F.col("grp")).alias("grp")
    size = size.groupBy("cluster", own_blocks).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("n"))
    w = Window.partitionBy("cluster")
    size = cut(size.select("cluster", F.col("grp").alias("pure"), "n", F.coalesce(F.sum("n").over(w.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("at"), F.sum("n").over(w).cast("int").alias("all")), "blocks")
    c, z = rows.alias("c"), size.alias("z")
    large = c.join(z, (F.col("c.cluster") == F.col("z.cluster")) & (F.col("c.grp") == F.col("z.pure"))).select("c.cid", "c.cluster", "pure", "n", "at", "all")
    rest = rows.join(large.select("cid"), "cid", "left_anti").alias("c").join(size.where("pure is null").alias("z"), "cluster").select("cid", "cluster", "pure", "n", "at", "all")
    mine = (F.col("at") + F.pmod(F.xxhash64("cid"), F.col("n"))).cast("int")
    placed = large.unionByName(rest).withColumn("mine", mine)
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda x: F.col("pure").isNull() | (x < F.col("at")) | (x >= F.col("at") + F.col("n")))
    met = placed.select("cid", "cluster", "mine", F.explode(others).alias("other"))
    tile = F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile")
    return first.unionByName(_in_tiles(met.select("cid", "cluster", tile).join(sets, "cid"), percent))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """id, th, n_shingles, component_id per row of docs. Links: shingles of ``width`` words, at least
    ``percent`` per cent of the union shared."""
    spark = docs.sparkSession
    sig = cut(signatures(docs, id_col, text_col, width, band_width(percent)), "signatures")
    classes = cut(sig.where("n > 0").groupBy("cid", "fp", "n").agg(F.min(F.struct("id", "th")).alias("rep"), F.min("id").alias("low"), F.first("bands").alias("bands")), "classes")
    members = classes.select("cid", F.explode("bands").alias("key"))
    hubs = cut(members.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("far")).where("hub < far").select("key", "hub"), "hubs")
    near = cut(members.join(hubs, "key").where("cid <> hub").select(F.col("hub").alias("u"), F.col("cid").alias("v")).distinct(), "near")
    clusters = cut(components(near, "clusters").withColumnRenamed("id", "cid").withColumnRenamed("component", "cluster"), "clusters")
    release(spark)
    sizes = cut(clusters.groupBy("cluster").agg((F.count("*") > BLOCK).alias("large")), "sizes")
    todo = cut(clusters.join(sizes, "cluster").join(classes.select("cid", "rep"), "cid").select("cid", "cluster", "large", "rep.id", "rep.th"), "todo")
    t = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id0"), F.xxhash64(t).alias("th0"), t.cast("binary").alias("b"))
    # the texts always meet by a sorted merge: the other side grows with the input, so it is never broadcast
    with_text = texts.join(todo.hint("merge"), texts["id0"].eqNullSafe(todo["id"]) & (texts["th0"] == todo["th"])).select("cid", "cluster", "large", "b")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = dict(shingle_sets(b.column(3), width))
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                s = pa.array([found[i].tobytes() if i in found else b"" for i in range(at, at + part.num_rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], s], ["cid", "cluster", "large", "s"])

    full = cut(with_text.mapInArrow(sets, "cid long, cluster long, large boolean, s binary"), "sets")
    if full.count() > todo.count():  # repeated rows: one set of each class
        full = cut(full.dropDuplicates(["cid"]), "sets")
    release(spark)
    small = full.where("not large")
    n_small = small.count()
    links = _in_tiles(small.select("cid", "cluster", "s", F.pmod(F.xxhash64("cluster"), F.lit(max(1, n_small // 256))).alias("tile")), percent)
    if not sizes.where("large").isEmpty():
        links = links.unionByName(_large(full.where("large").select("cid", "s"), near, todo.where("large").select("cid"), members, percent))
    label = components(links, "links").withColumnRenamed("id", "cid")
    tied = classes.select("cid", "low").join(label, "cid")
    tied = cut(tied, "tied")
    lowest = tied.groupBy("component").agg(F.min("low").alias("component_id"))
    named = cut(tied.join(lowest, "component").select("cid", "component_id").unionByName(
        classes.select("cid", F.col("low").alias("component_id")).join(label.select("cid"), "cid", "left_anti")), "named")
    return (
        sig.select("id", "th", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"))
        .join(named, "cid", "left")
        .select("id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a near-duplicate of smaller id in their group."""
    g = groups(docs, id_col, text_col, width, percent)
    gone = cut(g.where(~F.col("id").eqNullSafe(F.col("component_id"))).select("id", "th").distinct(), "gone")
    t = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["id"]) & (t == gone["th"]), "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(table(spark, sf_dir, "documents"), width=3, percent=85)
    return g.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
