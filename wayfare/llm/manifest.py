"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups' roots, and for every
row the siblings that prove it.

Digests are SHA-256 as lowercase hex. Rows of a group ascend by key (null first), rows with equal keys by digest; rows
that are equal in all fields are leaves of their own. While a group has several nodes, every ``fan`` consecutive ones
become the digest of their concatenation; the last node is the group's root, and the groups' roots, by group (null
first), make the same kind of tree.

Each level is one window: partitioned by group and parent index, an ordered full-frame ``collect_list`` gives every node
its run, which is the parent's preimage and holds the node's siblings; the run's first node stands for the parent
on the next level. Going down again, each level joins its parents' paths on the same keys as its window, so that
join needs no shuffle of its own on the leaves' side. No window or join is keyed by the group alone, so a
group may hold any share of the rows. Places in a group come from ranges (``placed``), not from one sorted task.

Nulls count as a value of their own in every field (``-``), empty texts are ``0:``, texts are digested whole, an empty
table gives an empty result, and further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_parts, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return digest(*[framed(changed.get(f, F.col(f))) for f in FIELDS])


def group_key(group: Column) -> Column:
    """A text that sorts like the group by UTF-8 bytes, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """rows(g, …) with i, its place within g by ``order`` from 0, and n, the size of g. Written.

    Rows are dealt in ranges of (g, order) and numbered where they lie; a count per range and group gives the offsets.
    Rows equal in all of these are split by a number of their own, so that they need not share a range."""
    spark = rows.sparkSession
    keys = ["g", *order, "_salt"]
    dealt = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), f"{name}-dealt")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy("g", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("g")
    counts = counts.select(
        "g", "_part", "_first", F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("n")
    )
    counts = cut(counts, f"{name}-counts")
    at = dealt.withColumn("_part", part).join(counts, ["g", "_part"])
    return cut(at.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before"), name)


def with_run(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """nodes(g, i, n, h, …) with p, the parent's place, and run, the digests of the parent's children in order. A node
    alone in its group has no parent: p is -1."""
    p = F.when(F.col("n") > 1, F.floor(F.col("i") / fan)).otherwise(-1).cast("long")
    w = Window.partitionBy("g", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return nodes.withColumn("p", p).withColumn("run", F.collect_list("h").over(w))


def parents(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """The next level, nodes(g, i, n, h): one row per run. Groups of one node are finished and left out."""
    first = with_run(nodes.select("g", "i", "n", "h"), fan).where((F.col("n") > 1) & (F.col("i") % fan == 0))
    return first.select("g", F.col("p").alias("i"), F.ceil(F.col("n") / fan).alias("n"), digest(F.array_join("run", "")).alias("h"))


def levels(leaves: DataFrame, name: str, fan: int = FAN) -> list[DataFrame]:
    """All levels from the leaves up, each written; the list ends when no group has several nodes."""
    out = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(cut(parents(out[-1], fan), f"{name}-level{len(out)}"))
        most = -(-most // fan)
    return out


def roots(tree: list[DataFrame]) -> DataFrame:
    """(g, level, h): each group's root and the level it stands on."""
    tops = [t.where("n = 1").select("g", F.lit(k).alias("level"), "h") for k, t in enumerate(tree)]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


PATH = "array<struct<before:string,after:string>>"


def paths(tree: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """leaves(g, i, …) with path, an array of (before, after) siblings level by level, and the columns of tops.

    tops(g, level, path, …) continues the path above each group's root."""
    more = [c for c in tops.columns if c not in ("g", "level", "path")]
    above = None
    for k in reversed(range(len(tree))):
        top = tops.where(F.col("level") == k).select("g", F.lit(-1).cast("long").alias("p"), F.col("path").alias("_up"), *more)
        up = top if above is None else above.select("g", F.col("i").alias("p"), F.col("path").alias("_up"), *more).unionByName(top)
        at = (F.col("i") % fan).cast("int")
        sides = F.array(F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(fan)), "").alias("after")))
        # a merge at every size, on the keys that the window has dealt by
        j = with_run(tree[k], fan).join(up.hint("merge"), ["g", "p"])
        above = j.withColumn("path", F.concat(F.when(F.col("n") > 1, sides).otherwise(F.array().cast(PATH)), F.col("_up"))).drop("_up", "run", "p")
    return above


def recomputed(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(docs: DataFrame, probe: Column | None = None, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, lang, leaf, subroot, root, path (siblings level by level, those before and after the node),
    probe (another leaf digest, or the leaf). The group is lang."""
    rows = docs.select(*FIELDS)
    narrow = cut(rows.select(group_key(F.col("lang")).alias("g"), "doc_id", "lang", leaf_digest().alias("h"), (leaf_digest() if probe is None else probe).alias("probe")), "leaves")
    tree = levels(placed(narrow, ("doc_id", "h"), "placed"), "tree", fan)
    subroots = cut(roots(tree), "subroots")
    top = levels(placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("group"), "level", "h"), ("group",), "groups"), "top", fan)
    root = roots(top).select("g", "level", F.array().cast(PATH).alias("path"), F.col("h").alias("root"))
    tops = paths(top, root, fan).select(F.col("group").alias("g"), F.col("level").cast("int").alias("level"), "path", F.col("h").alias("subroot"), "root")
    return paths(tree, cut(tops, "tops"), fan).select("doc_id", "lang", F.col("h").alias("leaf"), "subroot", "root", "path", "probe")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; the probe lower-cases the texts whose id's CRC-32 divides by 3."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    probe = leaf_digest(text=F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
    m = manifest(table(spark, sf_dir, "documents"), probe)
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), recomputed(F.col("probe"), F.col("path")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(doc_levels: int = 9, group_levels: int = 4) -> str:
    """Levels unrolled: enough for 8^9 documents per language and 8^4 languages."""
    frame = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(frame(text if f == "text" else f) for f in FIELDS) + ")"
    crc = "xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda a, x: list_reduce([xor(a, x)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384::bigint * (c & 1)))), 4294967295::bigint)"
    parts = [
        f"d as (select doc_id, text, lang, source, n_chars, coalesce('=' || lang, '') as g, {crc} % 3 = 0 as hit from documents)",
        f"l as (select doc_id, g, {leaf('text')} as h, {leaf(f'''(case when hit then translate(text, '{UPPER}', '{LOWER}') else text end)''')} as probe from d)",
        "a0 as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n from l)",
        "a0n as (select g, i, n, h from a0)",
    ]

    def climb(a: str, k: int) -> list[str]:
        src = f"{a}{k}n"
        return [
            f"{a}{k}r as (select g, i // 8 as p, n, string_agg(h, '' order by i) as run, list(h order by i) as hs from {src} where n > 1 group by g, i // 8, n)",
            f"{a}{k + 1}n as (select g, p as i, (n + 7) // 8 as n, sha256(run) as h from {a}{k}r)",
        ]

    for k in range(doc_levels):
        parts += climb("a", k)
    tops = " union all ".join(f"select g, {k} as level, h from a{k}n where n = 1" for k in range(doc_levels + 1))
    parts += [f"sub as ({tops})", "b0 as (select g as grp, h, level, row_number() over (order by g) - 1 as i, count(*) over () as n from sub)", "b0n as (select '' as g, i, n, h from b0)"]
    for k in range(group_levels):
        parts += climb("b", k)
    parts.append("root as (" + " union all ".join(f"select h as root from b{k}n where n = 1" for k in range(group_levels + 1)) + ")")

    def walk(a: str, k: int, src: str) -> list[str]:
        at = f"(s.i // {8**k})"
        return [
            f"{src}{k + 1} as (select s.* exclude (proof, folded), s.proof || coalesce(array_to_string(list_filter(r.hs, lambda x, j: j <> {at} % 8 + 1), ''), '') as proof, "
            f"case when r.hs is null then s.folded else sha256(array_to_string(list_transform(r.hs, lambda x, j: case when j = {at} % 8 + 1 then s.folded else x end), '')) end as folded from {src}{k} s left join {a}{k}r r on r.g = s.g and r.p = s.i // {8 ** (k + 1)})"
        ]

    parts.append("w0 as (select doc_id, g, i, h as leaf, '' as proof, probe as folded from a0)")
    for k in range(doc_levels):
        parts += walk("a", k, "w")
    parts.append(f"v0 as (select w.doc_id, w.leaf, w.proof, w.folded, b.h as subroot, '' as g, b.i from w{doc_levels} w join b0 b on b.grp = w.g)")
    for k in range(group_levels):
        parts += walk("b", k, "v")
    return "with " + ", ".join(parts) + f" select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from v{group_levels}, root"


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL = {"op12_merkle_manifest": _sql()}
