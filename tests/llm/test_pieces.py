"""Suffix-array encoding against the SentencePiece library, and exact round trips."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from wayfare.llm import pieces

HARD = [
    None, "", " ", "  a b  ", "▁a é\x00漢字", "Hello  world\tab\n x", "x" * 3000, "ab" * 2000, " " * 60 + "q", "日本語 🙂 naïve", "\x00\x00", "🙂",
    "same text", "same text", "word " * 20_000,
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeinrst  ▁éß漢\n\x00🙂THE") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library():
    v = pieces.Vocabulary(_path())
    texts = HARD + random_texts(800, 1)
    for t, raw in zip(texts, v.encode(texts)):
        ids = v.library.encode(t or "")
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert v.decode(ids) == v.library.decode(ids)


def _path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_groups_and_forgetting_change_nothing(monkeypatch):
    texts = HARD + random_texts(100, 2)
    want = list(pieces.Vocabulary(_path()).encode(texts))
    monkeypatch.setattr(pieces, "GROUP", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    assert list(pieces.Vocabulary(_path()).encode(texts)) == want


def test_every_piece_occurrence_is_found():
    v = pieces.vocabulary()
    text = " the cat thethe\0 then é"
    raw = text.encode()
    pos, ids, size = v.occurrences(np.frombuffer(raw, np.uint8))
    got = sorted((int(p), v.name[int(i)]) for p, i in zip(pos, ids))
    want = sorted((p, x) for x in v.id for p in range(len(raw)) if raw.startswith(x.encode(), p))
    assert got == want
    assert all(len(v.name[int(i)].encode()) == n for i, n in zip(ids, size))


def test_query_columns_and_clashing_names(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("t", F.lit(1)).withColumn("k0", F.lit(2))
    coded = pieces.encode(df)
    got = pieces.decode(coded, keep=("doc_id", "ids", "ids_crc32", "n_bytes")).collect()
    assert len(got) == len(rows)
    lib = pieces.vocabulary().library
    texts = dict(rows[:-1])
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.ids == lib.encode(t)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.decoded == t.replace("▁", " ")
        assert r.n_bytes == sum(lib.is_byte(i) for i in r.ids)
    assert pieces.encode(df.where("false")).count() == 0


def test_decode_of_ids_that_no_text_gives(spark):
    v = pieces.vocabulary()
    ids = [[int(v.byte_id[0xE6]), int(v.byte_id[0x41])], [0, 1, 2], [], None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in pieces.decode(df).collect()}
    assert got == {0: v.library.decode(ids[0]), 1: v.library.decode(ids[1]), 2: "", 3: ""}
