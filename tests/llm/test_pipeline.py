"""The corpus pipeline against a brute-force chain, and its stages on awkward tables."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfare.llm import language_id, packing

from .test_corpus_operators import SCHEMA, brute_groups, brute_repeats, brute_spans, with_clashes

STEMS = {"en": "the and ing tion of that", "de": "der und ung keit nicht ein", "fr": "les et ment eau que é", "es": "los y ción que ado ñ"}


def sentence(rng, lang, n):
    stems = STEMS[lang].split()
    return " ".join("".join(rng.choice(stems, int(rng.integers(1, 4)))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    langs = list(STEMS)
    texts = [(sentence(rng, langs[k % 4], int(rng.integers(30, 120))), langs[k % 4]) for k in range(200)]
    passage = sentence(rng, "en", 60)
    texts += [(sentence(rng, "en", 40) + " " + passage + " " + sentence(rng, "en", 40), "en") for _ in range(5)]
    texts += [(texts[3][0], "es"), (texts[3][0] + " los", "es"), (texts[8][0], "en")]
    own = [f"mine Qw{k}eR5tY7uI9oP1aS3dF5gH7j end" for k in range(3)]
    texts += [(f"{sentence(rng, 'en', 20)} password = hunter2{k} and {own[k]}", "en") for k in range(3)]
    texts += [(f"{sentence(rng, 'de', 15 + k)} Zx9aB3dE5gH7jK9mN1pQ3sT5v {sentence(rng, 'de', 15)}", "de") for k in range(6)]
    texts += [("Это обычный русский текст о погоде и людях, которые живут в этом городе", None), ("xq zzkv wqpt jjx kkq vvx zzq wvx qqj xkz", None), ("", "en"), (None, "en"), ("123 456", "fr")]
    texts.append((sentence(rng, "fr", 30_000), "fr"))
    return [(i, t, lang, f"src{i % 5}", len(t or "")) for i, (t, lang) in enumerate(texts)]


def brute_mask(rows):
    """rows: (id, text, source). Base kinds and long mixed tokens only, as the fixture holds no others."""
    spans = {}
    for i, t, _ in rows:
        base = [(a, o, b) for a, o, _, b in brute_spans(t)]
        free = [m for m in re.finditer(r"[A-Za-z0-9_-]{24,}", t or "") if all(re.search(p, m.group()) for p in ("[a-z]", "[A-Z]", "[0-9]"))]
        spans[i] = base + [(m.start(), 9, m.end()) for m in free if all(b <= m.start() or a >= m.end() for a, _, b in base)]

    def value(t, a, o, b):
        return re.sub(r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", "", t[a:b]) if o == 0 else t[a:b]

    owners = {}
    for i, t, src in rows:
        for a, o, b in spans[i]:
            owners.setdefault(value(t, a, o, b), set()).add(src)
    out = {}
    for i, t, _ in rows:
        parts, at = [], 0
        for a, o, b in sorted(spans[i]):
            live = len(owners[value(t, a, o, b)]) < 3
            if o == 9 and not live:
                continue
            if a >= at:
                parts += [t[at:a], "[SECRET]" if live else "[EXAMPLE_SECRET]"]
            at = max(at, b)
        out[i] = t if t is None else "".join(parts) + t[at:]
    return out


def test_run_equals_a_brute_force_chain(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    n = len(rows)
    foreign = {n - 6, n - 5, n - 4, n - 3, n - 2}  # Russian, random letters, empty, null, digits
    kept = [(i, t, s) for i, t, _, s, _ in rows if i not in foreign]
    group = {i: g for i, _, g in brute_groups([(i, t) for i, t, _ in kept], 5, 80)}
    kept = [r for r in kept if group[r[0]] == r[0]]
    assert len(kept) == n - 5 - 3
    seen, cut = set(), []
    for i, t, s in kept:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        cut.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore"), s))
    want = brute_mask(cut)
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = spark.createDataFrame(f(spark, stage, str(tmp_path)).collect(), SCHEMA)
    got = {r.doc_id: r for r in stage.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(want[i]) for i, r in got.items())
    assert sum("[SECRET]" in t for t in want.values()) == 3
    by_doc, by_bin = {}, {}
    for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    encode = packing.encoder().encode_ordinary
    assert set(by_doc) == set(want)
    for i, t in want.items():
        ids = np.array([*encode(t), 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.piece):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_bin.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_awkward_rows(spark, rows, stage):
    some = [*rows[:60], (None, rows[70][1], "fr", None, 1), (None, None, None, None, None), (None, "", "de", "s", 0), rows[5], rows[5], rows[-1]]
    docs = with_clashes(spark.createDataFrame(some, SCHEMA)).withColumn("_lang", F.lit("x")).withColumn("key", F.lit(1)).withColumn("h_", F.lit(1))
    out = stage(spark, docs, "")
    got = out.collect()
    ids = [r.doc_id for r in got]
    if stage is corpus_pipeline.pack:
        assert set(ids) == {r[0] for r in some} and ids.count(5) == 3
    else:
        assert out.columns == docs.columns
        lost = {corpus_pipeline.identify_language: 2}.get(stage, 0)
        assert len(got) == len(some) - lost and ids.count(5) == 3
    assert stage(spark, docs.where("false"), "").count() == 0


def test_only_rejected_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.count() >= docs.where(F.col("text").rlike("[A-Za-z]")).count() - 2
    texts = ["Это обычный русский текст о погоде", "これは日本語の文章です、とても短い文章です", "xq zzkv wqpt jjx kkq vvx qqz wvx", "#%$ 44 = a -- 9 && 3"]
    model = language_id.train(docs)
    assert (language_id.judge(texts, model)[2] < model["least"]).all()
