"""Rule bitmask ledger: every quality rule is evaluated once per document; its failure bit and the
measurements are stored, policies are masks over the bits, and ablations are bitwise aggregates.

Native: SQL expressions only. Nothing is exploded, so the ledger is a map over the scan without a shuffle.

Defined results: null text counts as empty (no words: fails ``few_words``); repeated rows are judged
each on its own; an empty table gives an empty ledger; extra columns of the input are carried only on
request (``carry``), so clashing names cannot occur.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WS = r"[\\x20\\x09-\\x0D]+"
_TRIM = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"

#: Measurements, in this order. ``words`` and ``grams`` are working columns and not stored.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_ended_lines")


@dataclass(frozen=True)
class Rule:
    """name, SQL predicate over MEASURES that is true when the document fails, and the bit's place."""

    name: str
    fails: str
    bit: int


#: The base rules come first: a policy always includes them. Comparisons are in whole numbers.
RULES = (
    Rule("few_words", "n_words < 50", 0),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words", 1),
    Rule("symbols", "100 * n_symbols > 10 * n_words", 2),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines", 3),
    Rule("short_words", "word_chars < 2 * n_words", 4),
    Rule("long_words", "word_chars > 15 * n_words", 5),
    Rule("many_words", "n_words > 200000", 6),
)
BASE = ("few_words", "repeated_words")

#: Versioned policies: the rules that decide.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "duplicate_lines", "short_words", "long_words"),
}


def mask(rules: tuple[str, ...]) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in rules)


def _repeat_words() -> str:
    """Words inside 3-word windows that occur twice or more. One-element arrays bind a value to a lambda
    variable, so it is computed once. Windows are compared by 64-bit hash within the document."""
    covered = """
      aggregate(
        transform(array(sort_array(transform(grams, (g, i) -> struct(g as g, i as i)))), s ->
          sort_array(transform(
            filter(s, (e, k) -> (k > 0 and s[k - 1].g = e.g) or (k < size(s) - 1 and s[k + 1].g = e.g)),
            e -> e.i)))[0],
        struct(-3 as last, 0L as total),
        (a, p) -> struct(p as last, a.total + least(3, p - a.last) as total),
        a -> a.total)"""
    return f"case when size(grams) < 2 or size(array_distinct(grams)) = size(grams) then 0L else {covered} end"


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id_col, carried columns, and MEASURES as longs."""
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    d = d.withColumn("_b", F.expr(f"btrim(_t, {_TRIM})"))
    d = d.withColumn("words", F.expr(f"case when _b = '' then cast(array() as array<string>) else split(_b, '{WS}') end"))
    d = d.withColumn("lines", F.expr(f"filter(split(_t, '\\n'), l -> btrim(l, {_TRIM}) <> '')"))
    d = d.withColumn(
        "grams",
        F.expr("case when size(words) < 3 then cast(array() as array<bigint>) else slice(transform(words, (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2))), 1, size(words) - 2) end"),
    )
    return d.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_c_{c}").alias(c) for c in carry],
        F.expr("cast(size(words) as bigint) as n_words"),
        F.expr("cast(length(array_join(words, '')) as bigint) as word_chars"),
        F.expr("cast(length(_t) - length(regexp_replace(_t, '[#*$%&|<>]+', '')) as bigint) as n_symbols"),
        F.expr("cast(size(lines) as bigint) as n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines"),
        F.expr(f"{_repeat_words()} as n_repeat_words"),
        F.expr(f"cast(size(filter(lines, l -> rtrim({_TRIM}, l) rlike '[.!?]$')) as bigint) as n_ended_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """measure() plus ``fail_bits``: bit k is set where RULES[k] fails. Each rule is evaluated once."""
    bits = " | ".join(f"(case when {r.fails} then {1 << r.bit}L else 0L end)" for r in RULES)
    return measure(docs, id_col, text_col, carry).withColumn("fail_bits", F.expr(bits))


def verdict(policy: str = "v2", bits: Column | None = None) -> Column:
    """True where a policy keeps the document."""
    return (bits if bits is not None else F.col("fail_bits")).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(led: DataFrame, policies: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Per policy and rule: documents that the policy drops, that the rule fails, and that only this rule
    of the policy fails (they would stay without it), with the bitwise or / and over the dropped ones.

    The ledger is first summed by its bits (at most 2**len(RULES) groups), so the rest works on a few rows.
    """
    by = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    spark = led.sparkSession
    rows = [(p, mask(rs), r, mask((r,))) for p, rs in (policies or POLICIES).items() for r in rs]
    grid = F.broadcast(spark.createDataFrame(rows, "policy string, policy_mask long, rule string, rule_bit long"))
    hit = F.col("fail_bits").bitwiseAND(F.col("policy_mask"))
    return (
        by.join(grid, hit.bitwiseAND(F.col("rule_bit")) != 0)
        .groupBy("policy", "rule")
        .agg(
            F.sum("n").alias("rule_fails"),
            F.sum(F.when(hit == F.col("rule_bit"), F.col("n")).otherwise(0)).alias("only_this_rule"),
            F.bit_or(hit).alias("bits_or"),
            F.bit_and(hit).alias("bits_and"),
        )
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict("v1")).alias("base_failed"), verdict("v2").alias("kept"), "n_lines", "n_ended_lines", "fail_bits",
    )


_W = r"[^\x20\x09-\x0D]+"
SQL = {
    "op8_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{_W}') as ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_W}')) as ls from d),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
t as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) as n from g),
r as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from t where n > 1) group by doc_id),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(r.n, 0)::bigint as n_repeat_words,
        len(list_filter(ls, lambda l: regexp_matches(l, '[.!?][\x20\x09-\x0D]*$')))::bigint as n_ended_lines
      from w left join r using (doc_id)),
b as (select *, (case when n_words < 50 then 1 else 0 end | case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
        | case when 100 * n_symbols > 10 * n_words then 4 else 0 end | case when 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
        | case when word_chars < 2 * n_words then 16 else 0 end | case when word_chars > 15 * n_words then 32 else 0 end
        | case when n_words > 200000 then 64 else 0 end)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed,
       (fail_bits & 63) = 0 as kept, n_lines, n_ended_lines, fail_bits from b
""",
}
QUERIES = {"op8_quality_rules": op8_quality_rules}
