"""Divergence of sources: how far the word frequencies of each source of a language lie from every other source's, and
which words set a source apart from its language.

Null text, language and source count as empty texts and stand for a value of their own. Terms are runs of ASCII letters and
of all characters beyond ASCII; only A-Z are lower-cased. A language keeps the V terms that stand in at least ``least_docs`` of its documents
(repeated rows are documents of their own). A group of N kept occurrences gives a term with count c the
smoothed share p = 1 + floor(SCALE * (c + 1) / (N + V)); the divergence of p from q is floor((p - q)^2 / q). All of it
is whole-number arithmetic.

The sum over V terms is never taken term by term for all pairs. A pair starts at V times the divergence of two zero
counts. A posting (term, source, count) corrects it, and that correction depends on the count alone as long as the
other source lacks the term, so postings are counted by (source, count) first and then meet the language's other sources.
Only where both sources have the term a further correction is needed; a term's posting list emits these, which are
summed before they are shuffled. No row is ever built for a source that lacks a term.

Texts are counted in batches inside tasks, in pieces cut between terms, and words of a batch are added up before
they are shuffled. Ranks of terms need only the first ``top`` rows per source of each task. An empty table gives an
empty result; a source without terms has zero counts; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
PIECE_BYTES, HELD = 4 << 20, 400_000
POSTING = "lang string, source string, term string, n long, docs long"


def term_counts(text: memoryview | bytes) -> Counter:
    """How often each term stands in a UTF-8 text."""
    out, at = Counter(), 0
    text = bytes(text)
    while at < len(text):
        cut_at = _GAP.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
        end = cut_at.start() if cut_at else len(text)
        out.update(text[at:end].translate(_LETTERS).split())
        at = end
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term) with occurrences and documents, added up over as many rows as fit HELD entries."""
    words: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for key, counts in words.items():
            terms = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(terms), pa.string()), pa.array([key[1]] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(counts.values(), pa.int64()), pa.array([docs[key][t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        words.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            got = term_counts(text.as_py())
            words.setdefault((lang, source), Counter()).update(got)
            docs.setdefault((lang, source), Counter()).update(got.keys())
        if sum(map(len, words.values())) > HELD:
            yield from flush()
    yield from flush()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for counts beyond 64 bits of product."""
    whole = lambda c: c.cast("decimal(20,0)")
    up = (F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1)).cast("decimal(38,0)")
    return (F.call_function("div", up, whole(total + terms).cast("decimal(38,0)")) + 1).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups(lang, source, total, terms, p0), postings(lang, term, source, n, p, lang_p)), both written.

    groups has every occurring group; terms is the language's V and p0 the share of a count of zero (null if V is 0)."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    # each source once per task is enough for the list of groups
    every = rows.select("lang", "source").distinct()
    counted = cut(rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, POSTING).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counted")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("list")).where(F.col("docs") >= least_docs)
    kept = cut(kept.select("lang", "term", "lang_n", "list"), "kept")
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    flat = kept.select("lang", "term", "lang_n", F.explode("list").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    g = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    g = g.select("lang", "source", zero("total"), zero("lang_total"), zero("terms"))
    g = cut(g.withColumn("p0", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))), "groups")
    post = flat.join(g, ["lang", "source"])
    post = post.select("lang", "term", "source", "n", "p0", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_p"))
    return g, cut(post, "postings")


def pair_sums(groups: DataFrame, post: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each source from every other of its language, over all V terms."""
    a = groups.select("lang", "source", "terms", "p0")
    b = a.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    base = a.join(b, "lang").where("source <> item").select("lang", "source", "item", zero(F.col("terms") * apart(F.col("p0"), F.col("q0"))).alias("value"))
    # one side has the term: the correction depends on the count alone
    alike = cut(post.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("k")), "alike")
    met = alike.join(b, "lang").where("source <> item")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("q0")
    out_of = met.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (apart(p, q0) - apart(p0, q0))).alias("value"))
    into = met.groupBy("lang", F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("k") * (apart(q0, p) - apart(q0, p0))).alias("value"))
    # both have it
    lists = post.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p0", "p")).alias("l")).where(F.size("l") > 1)
    x = lists.select("lang", "l", F.explode("l").alias("x")).select("lang", "x", F.explode("l").alias("y")).where("x.source <> y.source")
    xp, x0, yp, y0 = F.col("x.p"), F.col("x.p0"), F.col("y.p"), F.col("y.p0")
    both = x.groupBy("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item")).agg(F.sum(apart(xp, yp) - apart(xp, y0) - apart(x0, yp) + apart(x0, y0)).alias("value"))
    parts = base.unionByName(out_of).unionByName(into).unionByName(both)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources by how far the source lies from
    them, part ``term`` the source's terms that are more frequent than in its language, up to ``top``."""
    groups, post = postings(docs, least_docs)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_sums(groups, post).withColumn("rank", F.row_number().over(w))
    terms = post.where("p > lang_p").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("lang_p")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = {
    "op13_source_divergence": r"""
with d as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
keep as (select lang, term, count(*) as ln from t group by lang, term having count(distinct row) >= 3),
v as (select lang, count(*) as v, sum(ln) as lt from keep group by lang),
c as (select lang, source, term, count(*) as n from t join keep using (lang, term) group by lang, source, term),
grp as (select distinct lang, source from d),
tot as (select lang, source, coalesce(sum(n), 0) as n from grp left join c using (lang, source) group by lang, source),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + v.v) as p, 1 + (1000000000::hugeint * (k.ln + 1)) // (v.lt + v.v) as q
      from tot g join keep k on k.lang = g.lang join v on v.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
"""
}
QUERIES = {"op13_source_divergence": op13_source_divergence}
