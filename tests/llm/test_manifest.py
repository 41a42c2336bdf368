"""Merkle manifest against a plain tree, on groups around the powers of eight, ties, nulls and repeated rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from wayfare.llm import manifest as mf

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    each = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in each])


def climb(nodes):
    """(root, siblings before and after of every node, bottom up)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        for w, k in zip(ways, at):
            run = runs[k // 8]
            w.append((run[: k % 8], run[k % 8 + 1 :]))
        nodes, at = [h(*r) for r in runs], [k // 8 for k in at]
    return nodes[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    first_none = lambda v: (v is not None, v if v is not None else 0)
    trees = {g: sorted(((leaf(r), r) for r in rs), key=lambda x: (first_none(x[1]["doc_id"]), x[0])) for g, rs in groups.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    lower = {g: climb([x for x, _ in trees[g]]) for g in order}
    root, ways = climb([lower[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, ways):
        for (lf, r), way in zip(trees[g], lower[g][1]):
            whole = way + top
            t = r["text"]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and t is not None
            f = leaf({**r, "text": "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)}) if hit else lf
            for a, b in whole:
                f = h(*a, f, *b)
            out.append((r["doc_id"], lf, lower[g][0], root, h(*[x for a, b in whole for x in (*a, *b)]), f, f == root))
    return out


def query(spark, tmp_path, rows, name):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    df.withColumn("g", df.doc_id).withColumn("i", df.lang).repartition(3).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return [tuple(r) for r in mf.op12_merkle_manifest(spark, f"{tmp_path}/{name}").collect()]


def test_against_plain_tree(spark, tmp_path):
    rows = [dict(doc_id=k * 7 % 1009 - 5, text=f"Text {k}" if k % 5 else "", lang=lang, source=f"s{k % 3}", n_chars=k) for lang, n in (("en", 513), ("de", 65), ("fr", 64), ("é", 9), ("Z", 8), ("", 2), ("one", 1), (None, 3)) for k in range(n)]
    rows += [dict(doc_id=d, text=t, lang="en", source=None, n_chars=None) for d in (None, None, 3, 3, 3) for t in (None, "A\x00B ünï Z", "A\x00B ünï Z", "X" * 100_000)]
    rows += [dict(doc_id=9, text="same", lang="en", source="s", n_chars=1)] * 40
    got = query(spark, tmp_path, rows, "a")
    assert Counter(got) == Counter(plain(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [dict(doc_id=3, text="Abc", lang=None, source="s", n_chars=3)]])
def test_small(spark, tmp_path, rows):
    assert Counter(query(spark, tmp_path, rows, "b")) == Counter(plain(rows))


def test_hot_group_is_spread(spark):
    """Equal rows need not share a range: places are still dense."""
    df = spark.range(20_000).selectExpr("'x' as g", "cast(1 as long) as doc_id", "'same' as h")
    got = mf.placed(df, ("doc_id", "h"), "hot")
    assert sorted(r.i for r in got.select("i").collect()) == list(range(20_000))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = mf.op12_merkle_manifest(spark, SF)
    want = con.execute(mf.SQL["op12_merkle_manifest"])
    cols = [d[0] for d in want.description]
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(want.fetchall())
