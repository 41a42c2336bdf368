"""Source divergence against a plain version over all pairs and terms, with awkward rows."""

import re
from collections import Counter, defaultdict

import duckdb

from wayfare.llm import divergence as dv

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=3, top=200):
    rows = [tuple(v or "" for v in r) for r in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        c = Counter(t.translate(FOLD) for t in TERM.findall(text))
        counts[lang, source].update(c)
        docs[lang].update(c.keys())
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        p, whole = {}, Counter()
        for s in sources:
            n = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 1) // (n + v) for t in kept}
            for t in kept:
                whole[t] += counts[lang, s][t]
        total = sum(whole.values())
        q = {t: 1 + 10**9 * (whole[t] + 1) // (total + v) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, each, most in (("pair", pairs, None), ("term", terms, top)):
                each.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(each[:most], 1)]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("text", "lang", "source", "1 as term", "'x' as n", "2 as docs")
    return Counter(tuple(r) for r in dv.audit(df.repartition(3), **more).collect())


def test_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(dv, "HELD", 50)
    words = "the The of ÉTÉ été ß naïve x1y2z it's a-b 漢字 rain".split()
    rows = [(" ".join(words[(k * j) % len(words)] for j in range(k % 9)), ["en", "de", None, ""][k % 4], [None, "", "a", "b", "c"][k * k % 5]) for k in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("one two", "es", "a"), ("!!! 123", "es", "b"), ("the " * 70_000, "en", "a"), ("w" * 200_000, "en", "a")]
    rows += [("same same words", "en", "b")] * 30
    assert run(spark, rows) == Counter(plain(rows))
    assert run(spark, rows, least_docs=1, top=2) == Counter(plain(rows, 1, 2))


def test_empty_and_single(spark):
    assert not run(spark, [])
    assert not run(spark, [("a a a", "en", "s")])
    assert run(spark, [("a", "en", "s"), ("b", "en", "t")]) == Counter([("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)])


def test_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(dv, "PIECE_BYTES", 7)
    text = "Alpha beta,GAMMA delta é alpha-Alpha ééééééééé x" * 3
    assert dv.term_counts(text.encode()) == {t.encode(): n for t, n in Counter(t.translate(FOLD) for t in TERM.findall(text)).items()}


def test_shares_are_exact_beyond_64_bits(spark):
    n, total = 10**16 + 3, 3 * 10**16 + 1
    got = spark.range(1).selectExpr(f"{n}L as n", f"{total}L as t").select(dv.share(dv.F.col("n"), dv.F.col("t"), dv.F.lit(5).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (total + 5)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(dv.SQL["op13_source_divergence"])
    cols = [d[0] for d in want.description]
    assert Counter(tuple(r) for r in dv.op13_source_divergence(spark, SF).select(*cols).collect()) == Counter(want.fetchall())
