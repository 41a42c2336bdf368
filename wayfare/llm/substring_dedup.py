"""Exact removal of repeated byte strings by prefix-free parsing.

Triggers are places whose rolling hash is the least among its neighbours: every run of LENGTH bytes
holds at least one trigger, chosen by the run's own bytes. Windows of LENGTH bytes that share their
trigger form a phrase; phrases overlap by LENGTH - 1 bytes, so no phrase suffix of LENGTH bytes or more is a
prefix of another place's without being equal to it there: each window is the start of exactly one dictionary
suffix, and equal windows start suffixes of phrases with equal triggers.

1. parse: per phrase its trigger hash, its content hash, document and place. Triggers seen once are dropped.
2. dictionary: each distinct phrase with its first place in the parse. Every later place is a copy, removed whole.
3. suffix array of the dictionary, over the phrases whose trigger has several phrases: their suffixes are sorted by
   their bytes, as far as LENGTH bytes, in groups of whole triggers of bounded size (suffixes that are equal this far
   have equal triggers, so groups never need one another). Suffixes that stand alone drop out of the sorting as soon
   as they do.
4. both are combined into corpus order: in each run of equal suffixes the parse gives every phrase's first place; the
   run's earliest place stays, all others are removed. What follows a phrase in the parse orders suffixes only beyond
   LENGTH bytes, which decides nothing here, so the parse is sorted by place and not by its own suffixes.
5. the removed runs meet their texts, document by document.

A trigger with more than HEAVY phrases is not brought to one task: its suffixes are aggregated by hash (64 bits
beside the trigger's 64) over all tasks. Joins on phrases are salted by how often the trigger occurs.

Defined results: null text is empty; texts under LENGTH bytes stay whole; repeated rows (same id and
text) do not count as earlier than one another and get the same result; rows that share an id but not
the text are told apart and ordered by a 64-bit hash of the text; a null id counts as the smallest;
extra columns are kept by remove_repeats and not read otherwise. Cuts of ``remove_repeats`` drop
characters of which any byte goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, cut, mix, release, rolling, shuffle_parts, table, texts_of

LENGTH, TRIGGER = 100, 32
_SPAN = LENGTH - TRIGGER + 1
#: Bytes hashed at a time; longer texts are cut into slices that overlap by LENGTH - 1.
SLICE = 1 << 21
#: Phrases of one trigger that one task sorts at most.
HEAVY = 1000
#: Windows in one row at most. place = start << 7 | windows.
_MOST = 127

_NO_ID = -(1 << 63)


def _windows_min(h: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbours, by doubling."""
    low, size = h, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    n = len(h) - span + 1
    return np.minimum(low[:n], low[span - size : span - size + n])


def _slices(offsets: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
    """Groups of (row, place in the text, from, to) of at most about SLICE bytes."""
    held, size = [], 0
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        for at in range(a, b - LENGTH + 1, SLICE):
            end = min(at + SLICE + LENGTH - 1, b)
            held.append((i, at - a, at, end))
            size += end - at
            if size >= SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _parse(data: np.ndarray, offsets: np.ndarray, with_content: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases: row, start, windows, trigger hash, content hash."""
    for group in _slices(offsets):
        joined = np.concatenate([data[a:b] for _, _, a, b in group])
        lens = np.array([b - a for _, _, a, b in group])
        begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
        hashes = mix(rolling(joined, TRIGGER))
        low = _windows_min(hashes, _SPAN)
        n = len(low)  # windows, some across two texts
        change = np.zeros(n + 1, bool)
        # another trigger: another hash, or the same hash again further right (the rightmost counts)
        change[1:n] = (low[1:] != low[:-1]) | (hashes[_SPAN : _SPAN + n - 1] == low[1:])
        inside = np.zeros(n + 1, np.int8)
        inside[begin] += 1
        inside[np.minimum(begin + lens - LENGTH + 1, n)] -= 1
        inside = np.cumsum(inside)[:n] > 0
        change[begin] = True
        first = np.flatnonzero(change[:n] & inside)
        seg = np.searchsorted(begin, first, "right") - 1
        last = np.minimum(np.append(first[1:], n), (begin + lens - LENGTH + 1)[seg])
        row = np.array([g[0] for g in group])[seg]
        start = np.array([g[1] for g in group])[seg] + first - begin[seg]
        content = None
        if with_content:
            h = rolling(joined, LENGTH)
            content = mix(h[first] * np.uint64(3) + mix(h[last - 1]) + (last - first).astype(np.uint64))
        yield row, start, last - first, low[first], content


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, the text's 64-bit hash (the two name a row), the text's bytes."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(t).alias("h"), t.cast("binary").alias("b"))


def _triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for *_, low, _ in _parse(*texts_of(b.column(0)), False):
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64))], ["a"])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, h = b.column(0).to_numpy(), b.column(1).to_numpy()
        for row, start, n, low, content in _parse(*texts_of(b.column(2)), True):
            place = start.astype(np.int64) << 7 | n
            yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[row]), pa.array(h[row]), pa.array(place)], ["a", "f", "id", "h", "place"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with their ambiguous phrases: the phrase's bytes, or for heavy triggers every suffix's hash."""
    names = ["a", "id", "h", "place", "bytes", "w", "salts"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.int32()]
    for b in batches:
        rows: list[list] = [[] for _ in names]
        for i, h, text, todo in zip(*(b.column(c).to_pylist() for c in range(4))):
            for p in todo:
                start, n = p["place"] >> 7, p["place"] & 127
                part = text[start : start + n + LENGTH - 1]
                if p["heavy"]:
                    w = mix(rolling(np.frombuffer(part, np.uint8), LENGTH)).view(np.int64)
                    for k in range(n):
                        for col, x in zip(rows, (p["a"], i, h, (start + k) << 7 | 1, None, int(w[k]), p["salts"])):
                            col.append(x)
                else:
                    for col, x in zip(rows, (p["a"], i, h, p["place"], part, None, p["salts"])):
                        col.append(x)
            if len(rows[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names)
                rows = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds)], names)


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number that sorts like them."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at]).view(">u8").ravel().astype(np.uint64)


def equal_suffixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of the suffix array of data over the places ``at`` where LENGTH bytes or more are shared: indices into
    ``at`` in the suffixes' order, and the number of the run of equal ones that each belongs to.

    Sorting goes on eight bytes at a time, within runs that are equal so far; suffixes alone in their run drop out."""
    live, run = np.arange(len(at)), np.zeros(len(at), np.int64)
    for off in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        if not len(live):
            break
        w = _word(data, at[live] + off)
        order = np.lexsort((w, run)) if off else np.argsort(w, kind="stable")
        live, run, w = live[order], run[order], w[order]
        same = np.zeros(len(live) + 1, bool)
        same[1:-1] = (run[1:] == run[:-1]) & (w[1:] == w[:-1])
        tied = same[1:] | same[:-1]
        live, run = live[tied], np.cumsum(~same[:-1])[tied]
    return live, run


def _later_suffixes(ids: np.ndarray, h: np.ndarray, place: np.ndarray, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a set of phrases with their first places: id, text hash and start of every suffix that equals an earlier one."""
    data, offsets = texts_of(parts)
    n = place & 127
    who = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    live, run = equal_suffixes(data, offsets[:-1][who] + k)
    who, at = who[live], (place[who[live]] >> 7) + k[live]
    i, h = ids[who], h[who]
    order = np.lexsort((at, h, i, run))  # corpus order within a run
    i, h, at, run = i[order], h[order], at[order], run[order]
    first = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    # a repeat of the same place is not later than itself
    later = (i != i[lead]) | (h != h[lead]) | (at != at[lead])
    return i[later], h[later], at[later]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by trigger; whole triggers are settled some thousand phrases at a time."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        part = t.column("bytes").chunk(0) if t.num_rows else pa.array([], pa.binary())
        i, h, start = _later_suffixes(*(t.column(c).to_numpy() for c in ("id", "h", "place")), part)
        order = np.lexsort((start, h, i))
        i, h, start = i[order], h[order], start[order]
        # neighbouring windows become one run
        fresh = np.ones(len(i), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(i)))
        pieces = -(-size // _MOST)
        who = np.repeat(first, pieces)
        off = (np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _MOST
        n = np.minimum(np.repeat(size, pieces) - off, _MOST)
        place = (start[who] + off) << 7 | n
        return pa.RecordBatch.from_arrays([pa.array(i[who]), pa.array(h[who]), pa.array(place)], ["id", "h", "place"])

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= 8192:
            t = pa.Table.from_batches(held)
            a = t.column("a").to_numpy()
            whole = int(np.searchsorted(a, a[-1]))
            if whole:
                yield done(t.slice(0, whole))
                held, rows = t.slice(whole).to_batches(), t.num_rows - whole
    if held:
        yield done(pa.Table.from_batches(held))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h, places: per document the runs of windows that also start earlier in the corpus."""
    spark = docs.sparkSession
    parts, scratch = shuffle_parts(spark), Scratch(spark)
    keyed = _keyed(docs, id_col, text_col)
    again = scratch.cut(keyed.select("b").mapInArrow(_triggers, "a long").groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a", _salts("n")), "triggers")
    parse = keyed.mapInArrow(_phrases, "a long, f long, id long, h long, place long")
    found = scratch.cut(parse.join(again, "a"), "phrases")
    release(spark)
    book = scratch.cut(found.groupBy("a", "f", "salts").agg(F.min(F.struct("id", "h", "place")).alias("first"), F.count("*").alias("n")), "dictionary")
    copies = _but_first(found, book.where("n > 1").select("a", "f", "salts", "first"), "f")
    per = scratch.cut(book.groupBy("a").agg(F.count("*").alias("m")).where("m > 1"), "ambiguous")
    open_ = book.select("a", "first").join(per.select("a", (F.col("m") > HEAVY).alias("heavy"), _salts("m")), "a").select("first.id", "first.h", F.struct("a", "first.place", "heavy", "salts").alias("phrase"))
    by_doc = open_.groupBy("id", "h").agg(F.collect_list("phrase").alias("todo"))
    full = keyed.where(F.length("b") >= LENGTH).join(by_doc, ["id", "h"])
    suffixes = scratch.cut(full.select("id", "h", "b", "todo").mapInArrow(_suffixes, "a long, id long, h long, place long, bytes binary, w long, salts int"), "suffixes")
    release(spark)
    light = suffixes.where("w is null").select("a", "id", "h", "place", "bytes").repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_settle, "id long, h long, place long")
    hot = suffixes.where("w is not null").select("a", "w", "salts", "id", "h", "place")
    lead = scratch.cut(hot.groupBy("a", "w", "salts").agg(F.min(F.struct("id", "h", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "heavy")
    late = _but_first(hot, lead, "w")
    gone = copies.unionByName(light).unionByName(late)
    out = cut(gone.groupBy("id", "h").agg(F.collect_set("place").alias("places")), "repeats")
    del again, parse, found, book, copies, per, open_, by_doc, full, suffixes, light, hot, lead, late, gone
    scratch.clear()
    return out


def _salts(count: str) -> Column:
    """Parts that the rows of a trigger with so many occurrences are split into when they are joined."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(count) / 16)).cast("int").alias("salts")


def _but_first(rows: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """Places of rows that are not the first of their (a, key). A hot key's rows are dealt over its salts."""
    r = rows.select("a", key, F.pmod(F.xxhash64("id", "h", "place"), F.col("salts")).cast("int").alias("salt"), "id", "h", "place")
    f = firsts.select("a", key, "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return r.join(f, ["a", key, "salt"]).where("struct(id, h, place) > first").select("id", "h", "place")


def removed_runs(places: list[int] | np.ndarray | None) -> np.ndarray:
    """Maximal removed byte runs [from, to) of one text, sorted."""
    if places is None or len(places) == 0:
        return np.zeros((0, 2), np.int64)
    p = np.asarray(places, np.int64)
    a, b = p >> 7, (p >> 7) + (p & 127) + LENGTH - 1
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    fresh = np.concatenate([[True], a[1:] > b[:-1]])
    return np.stack([a[fresh], b[np.append(np.flatnonzero(fresh)[1:] - 1, len(b) - 1)]], axis=1)


def _kept(text: bytes, runs: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in runs:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, places in zip(b.column(1), b.column(2)):
                t = text.as_py()
                runs = removed_runs(places.values.to_numpy() if places.is_valid else None)
                row = (len(t), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(_kept(t, runs)).hexdigest())
                for col, x in zip(out, row):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = repeats(docs, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col)
    plain = keyed.where(F.length("b") < LENGTH).select("id", F.length("b").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("b", 256).alias("kept_sha256"))
    rows = keyed.where(F.length("b") >= LENGTH).join(found, ["id", "h"], "left").select("id", "b", "places")
    out = rows.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").unionByName(plain)
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id"))).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every repeated run taken out of text_col; null stays null, other columns stay."""
    found = repeats(docs, id_col, text_col)
    t = F.coalesce(F.col(text_col), F.lit(""))
    names = docs.columns
    d = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(t).alias("h"))
    at = f"_{names.index(text_col)}"

    @F.pandas_udf("string")
    def kept(texts, places):
        return texts.combine(places, lambda t, p: _kept(t.encode(), removed_runs(p)).decode("utf-8", "ignore"))

    joined = d.join(found, ["id", "h"], "left")
    hit = F.col("places").isNotNull() & F.col(at).isNotNull()
    changed = joined.where(hit).withColumn(at, kept(F.col(at), F.col("places")))
    both = joined.where(~hit).unionByName(changed)
    return both.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
