"""Secret scan with corpus-wide ownership frequency.

Base spans come from three fixed patterns. The method adds candidates of further kinds (signed web
tokens, private-key blocks, long mixed tokens), hashes every candidate value, and aggregates the hashes
over the corpus by distinct repositories and distinct owners: a value that many owners carry is a widely
copied example, one that stays with few owners is a live-looking credential. Base spans always stay;
added candidates become spans only when they look live.

Native: SQL expressions only. Positions follow from the pieces between matches (split) and the matches
themselves; only documents that contain a candidate get past the first filter. The work of a text is linear in its
length and about linear in its matches: places are added up in chunks, overlaps are found by windows over sorted
spans, and masking goes block by block.

Defined results: null text is empty (no spans, the hash of the empty string); repeated rows are told
apart by (id, text) and each gets its row; a null repository counts as one unknown owner; extra columns of
the input are not read, so clashing names cannot occur. All matches of the longest text count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

_KEYWORD = (
    "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
)
_ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_MIXED = r"[A-Za-z0-9_-]{24,}"
_JWT = r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]*"

#: kind, pattern, group that holds the value, fewest characters of the value. Order is the tie order.
BASE_KINDS = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
ADDED_KINDS = (("jwt", _JWT, 0, 30), ("pem", _PEM, 0, 40), ("mixed", _MIXED, 0, 24))
KINDS = tuple(k for k, *_ in BASE_KINDS + ADDED_KINDS)

#: True only if some pattern can match with a long enough value.
PREFILTER = rf"""(?:{_KEYWORD})["']?\x20*[:=]|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}|{_JWT}|-----BEGIN |[A-Za-z0-9_-]{{24}}"""

#: A value that this many owners carry is a widely copied example.
EXAMPLE_OWNERS = 3

_SPAN = "array<struct<start:bigint,ord:int,kind:string,stop:bigint,value:string>>"
#: Matches whose places are added up at a time, and characters that are masked at a time: arrays and strings grow by
#: copying, so both bound what is copied per match.
CHUNK, BLOCK = 512, 1 << 16


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(t: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches of one kind with their places, short values dropped."""
    m = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    v = F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    parts = F.filter(F.arrays_zip(F.split(t, pattern, -1).alias("p"), m.alias("m"), v.alias("v")), lambda e: e["m"].isNotNull())
    size = lambda e: (F.length(e["p"]) + F.length(e["m"])).cast("bigint")

    def placed(chunk: Column, start: Column) -> Column:
        zero = F.struct(start.alias("pos"), F.array().cast(_SPAN).alias("out"))

        def step(a: Column, e: Column) -> Column:
            stop = a["pos"] + size(e)
            row = F.struct((stop - F.length(e["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), stop.alias("stop"), e["v"].alias("value"))
            return F.struct(stop.alias("pos"), F.when(F.length(e["v"]) >= least, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"))

        return F.aggregate(chunk, zero, step, lambda a: a["out"])

    def starts(chunks: Column) -> Column:
        total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, e: a + size(e))
        zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(chunks, zero, lambda a, c: F.struct((a["pos"] + total(c)).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"])

    chunked = lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, CHUNK))
    every = lambda cs: _let(starts(cs), lambda at: F.flatten(F.transform(cs, lambda c, i: placed(c, F.get(at, i)))))
    return _let(parts, lambda p: _let(chunked(p), every))


def _mixed_enough(s: Column) -> Column:
    return s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")


KEY = ("_id", "_h", "_repo")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """One row per input row: _id, _h (of the text), _repo, and an array of the matches of all kinds."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("_repo"), t.alias("_t"))
    d = d.withColumn("_hit", F.col("_t").rlike(PREFILTER)).withColumn("_h", F.xxhash64("_t"))
    one = {k: _spans(F.col("_t"), k, p, g, n) for k, p, g, n in BASE_KINDS + ADDED_KINDS}
    one["mixed"] = F.filter(one["mixed"], _mixed_enough)
    return d.select(*KEY, F.when(F.col("_hit"), F.concat(*one.values())).otherwise(F.array().cast(_SPAN)).alias("matches"))


def clear_spans(cand: DataFrame) -> DataFrame:
    """One row per distinct (_id, _h, _repo) and span: all base ones, signed tokens and key blocks that touch no base
    one, and mixed tokens that touch none of these. Values are hashed."""
    flat = cand.where("size(matches) > 0").dropDuplicates(list(KEY)).select(*KEY, F.explode("matches").alias("s")).select(*KEY, "s.start", "s.ord", "s.kind", "s.stop", F.sha2("s.value", 256).alias("value_hash"))
    up = Window.partitionBy(*KEY).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*KEY).orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n_base, n_sure = len(BASE_KINDS), len(KINDS) - 1
    for name, n in (("base", n_base), ("sure", n_sure)):
        mine = F.col("ord") < n
        flat = flat.withColumn(f"_to_{name}", F.max(F.when(mine, F.col("stop"))).over(up)).withColumn(f"_from_{name}", F.min(F.when(mine, F.col("start"))).over(down))
    free = lambda name: (F.coalesce(F.col(f"_to_{name}"), F.lit(0)) <= F.col("start")) & F.coalesce(F.col(f"_from_{name}") >= F.col("stop"), F.lit(True))
    keep = (F.col("ord") < n_base) | ((F.col("ord") < n_sure) & free("base")) | free("sure")
    return flat.where(keep).select(*KEY, "start", "ord", "kind", "stop", "value_hash")


def ownership(spans: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per value hash: distinct repositories and owners over the whole corpus, and the verdict.

    A repository's owner is the part before the first slash. Distinct triples first, so a value that
    fills the corpus is one row per repository before it is counted.
    """
    return (
        spans.select("value_hash", "_repo", F.substring_index("_repo", "/", 1).alias("_owner"))
        .distinct()
        .groupBy("value_hash")
        .agg(F.countDistinct("_repo").alias("n_repos"), F.countDistinct("_owner").alias("n_owners"))
        .withColumn("live", F.col("n_owners") < example_owners)
    )


def judged_spans(cand: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """The spans that stay, with n_repos, n_owners, live: base ones, and added ones that look live. Both sides of the join
    are written tables, so a value that fills the corpus is split by adaptive skew handling."""
    spans = cut(clear_spans(cand), "spans")
    own = cut(ownership(spans, example_owners), "owners")
    return spans.join(own, "value_hash").where((F.col("ord") < len(BASE_KINDS)) | F.col("live"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: _id, _h, and all spans with value_hash, n_repos, n_owners, live (null if there are none)."""
    cand = cut(candidates(docs, id_col, text_col, repo_col), "secrets")
    per = cut(judged_spans(cand, example_owners).groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("start", "ord", "kind", "stop", "value_hash", "n_repos", "n_owners", "live"))).alias("spans")
    ), "per-row")
    c, p = cand.select(*KEY).alias("c"), per.alias("p")
    same = F.col("c._id").eqNullSafe(F.col("p._id")) & (F.col("c._h") == F.col("p._h")) & (F.col("c._repo") == F.col("p._repo"))
    return c.join(p, same, "left").select("c._id", "c._h", F.col("p.spans").alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    some = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,ord:int,kind:string,stop:bigint,value_hash:string,n_repos:bigint,n_owners:bigint,live:boolean>>"))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE_KINDS))
    return scanned.withColumn("spans", some).withColumn("base", base).select(
        F.col("_id").alias(id_col),
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("bigint").alias("n_example"),
    )


def _marks(spans: DataFrame) -> DataFrame:
    """Per (_id, _h): block -> places to mask there (from, to, word), spans that overlap being one."""
    w = Window.partitionBy("_id", "_h").orderBy("start", "ord")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col("start") >= before, F.lit(True)), 1).otherwise(0)
    s = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    word = F.when(F.min_by("live", F.struct("start", "ord")), "[SECRET]").otherwise("[EXAMPLE_SECRET]")
    whole = s.groupBy("_id", "_h", "island").agg(F.min("start").alias("a"), F.max("stop").alias("b"), word.alias("word"))
    at = whole.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("b") - 1) / BLOCK))))
    off = F.col("block") * BLOCK
    one = F.struct(
        F.greatest(F.col("a") - off, F.lit(0)).cast("int").alias("a"), F.least(F.col("b") - off, F.lit(BLOCK)).cast("int").alias("b"),
        F.when(F.col("a") >= off, F.col("word")).otherwise("").alias("word"))
    per = at.groupBy("_id", "_h", F.col("block").cast("int").alias("block")).agg(F.sort_array(F.collect_list(one)).alias("places"))
    return per.groupBy("_id", "_h").agg(F.map_from_entries(F.collect_list(F.struct("block", "places"))).alias("marks"))


def _masked(t: Column, marks: Column) -> Column:
    def block(x: Column, places: Column) -> Column:
        gap = lambda m, i: F.substr(x, _end(places, i - 1) + 1, m["a"] - _end(places, i - 1))
        parts = F.transform(places, lambda m, i: F.concat(gap(m, i), m["word"]))
        return F.concat(F.array_join(parts, ""), F.substr(x, _end(places, F.size(places) - 1) + 1))

    _end = lambda places, i: F.when(i >= 0, F.get(places, F.greatest(i, F.lit(0)))["b"]).otherwise(0)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(t) / BLOCK).cast("int")),
        lambda k: _let(F.substr(t, k * BLOCK + 1, F.lit(BLOCK)), lambda x: _let(F.element_at(marks, k), lambda p: F.when(p.isNull(), x).otherwise(block(x, p)))))
    return F.array_join(blocks, "")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source") -> DataFrame:
    """docs with every span masked: [SECRET] where it looks live, [EXAMPLE_SECRET] where it is widely
    copied. Overlapping spans are masked once. Documents without a candidate never leave their task."""
    cand = cut(candidates(docs, id_col, text_col, repo_col), "secrets")
    spans = judged_spans(cand).dropDuplicates(["_id", "_h", "start", "ord"])
    found = cut(_marks(spans), "marks")
    hit = F.coalesce(F.col(text_col).rlike(PREFILTER), F.lit(False))
    # the input's columns travel in one struct, so none of their names can clash
    some = docs.where(hit).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    joined = some.join(found, F.col("key").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_h")), "left")
    text = F.when(F.col("marks").isNotNull(), _masked(F.col("t"), F.col("marks"))).otherwise(F.col("t"))
    back = joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    return docs.where(~hit).unionByName(back)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _sql_kind(kind: str, pattern: str, group: int, least: int) -> str:
    return (
        f"select doc_id, source, '{kind}' as kind, {KINDS.index(kind)} as ord, unnest(range(1, len(m) + 1)) as i, m, v, p from"
        f" (select doc_id, source, regexp_extract_all(t, '{_q(pattern)}', 0) as m, regexp_extract_all(t, '{_q(pattern)}', {group}) as v, string_split_regex(t, '{_q(pattern)}') as p from d) where len(m) > 0"
    )


_LEAST = " ".join(f"when '{k}' then {n}" for k, _, _, n in BASE_KINDS + ADDED_KINDS)
SQL = {
    "op2_secret_scan": f"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as t from documents),
k as ({' union all '.join(_sql_kind(*k) for k in BASE_KINDS + ADDED_KINDS)}),
s0 as (select doc_id, source, kind, ord, v[i] as value, length(m[i]) as n,
       list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start from k),
s1 as (select doc_id, source, kind, ord, value, start::bigint as start, (start + n)::bigint as stop from s0 where length(value) >= case kind {_LEAST} end
       and (kind <> 'mixed' or (regexp_matches(value, '[a-z]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[0-9]')))),
s as (select * from s1 a where ord < 3 or not exists (select 1 from s1 b where b.doc_id = a.doc_id and b.ord < (case when a.kind = 'mixed' then 5 else 3 end)
       and b.start < a.stop and a.start < b.stop)),
o as (select value, count(distinct source) as n_repos, count(distinct string_split(source, '/')[1]) as n_owners from s group by value),
j as (select s.*, o.n_owners < {EXAMPLE_OWNERS} as live from s join o using (value) where ord < 3 or o.n_owners < {EXAMPLE_OWNERS}),
g as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
      string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) filter (ord < 3) as base,
      string_agg(kind || ':' || start || ':' || stop, ',' order by start, ord) as spans,
      count(*) filter (live) as n_live, count(*) filter (not live) as n_example from j group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join g using (doc_id)
""",
}
QUERIES = {"op2_secret_scan": op2_secret_scan}
