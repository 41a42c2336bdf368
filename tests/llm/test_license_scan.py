"""Licence scan: planted notices are found where they stand, general talk and prose are left alone."""

import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from wayfare.llm import license_scan as L

PROSE = [" ".join(random.Random(k).choices("nan tion the ere ouel schge and ist vor de la un with by".split(), k=30)) for k in range(300)]


@pytest.fixture(scope="module")
def model():
    return L.Model(PROSE)


def test_held_out_accuracy(model):
    assert model.accuracy > 0.97


def test_every_template_holds_an_anchor_and_is_found(model):
    for family, notices in L.TEMPLATES.items():
        for t in notices:
            assert L.ANCHOR.search(t), t
            assert [x[:3] for x in L.scan_text(t.capitalize() + ".", model)] == [(0, len(t), family)], t


def test_general_sentences_license_nothing(model):
    for t in (*L.GENERAL, *PROSE, "All rights reserved.", "my license plate was stolen"):
        assert not [x for x in L.scan_text(t, model) if x[2] != L.UNKNOWN], t


def test_notice_anywhere_in_long_texts_has_its_span(model):
    notice = "Licensed under the Apache License, Version 2.0"
    for before, after, sep in ((0, 50, " "), (500, 0, " "), (777, 333, " "), (40_000, 9, "\n"), (0, 0, " ")):
        text = sep.join([*["nan"] * before, notice, *["tion"] * after])
        at = text.index(notice)
        assert [x[:3] for x in L.scan_text(text, model)] == [(at, at + len(notice), "apache")]


@pytest.mark.parametrize("mark", ["", "// ", "# ", " * "])
def test_wrapped_notices_are_found_whole(model, mark):
    for family, notices in L.TEXTS.items():
        for t in (x for x in notices if len(x.split()) > 4):
            text = "/*\n" + "\n".join(mark + x for x in textwrap.wrap(t, 60)) + "\n*/\n\n" + PROSE[0]
            a, b = text.index(t[:12]), text.index("\n*/")
            assert [x[:3] for x in L.scan_text(text, model)] == [(a, b, family)], (family, t)


def test_two_families_in_one_paragraph(model):
    text = "This is licensed under the MIT license or the Apache License,\nVersion 2.0, at your option."
    assert [(text[a:b], f) for a, b, f, _ in L.scan_text(text, model)] == [("licensed under the MIT license", "mit"), ("the Apache License,\nVersion 2.0", "apache")]
    assert [x[2] for x in L.scan_text("MIT License\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software", model)] == ["mit", "mit"]


@pytest.mark.parametrize("text, families", [
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd"]), ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["mit", "apache"]), ("(MIT OR Apache-2.0)", ["mit", "apache"]), ("SPDX-License-Identifier: GPL-2.0-only", ["gpl"]),
    ("SPDX-License-Identifier: LGPL-2.1-or-later", ["lgpl"]), ("SPDX-License-Identifier: MIT", ["mit"]), ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", ["gpl"]), ("Apache License\nVersion 2.0, January 2004", ["apache"]),
    ("Mozilla Public License Version 2.0", ["mpl"]), ("BSD 3-Clause License", ["bsd"]), ("You may use this file under the terms of the GPL v2 or later", ["gpl"]), ("License: ISC License", ["isc"]), ("Licensed under CC BY-SA 4.0", ["cc-by-sa"]),
    ("GNU AFFERO GENERAL PUBLIC LICENSE", ["agpl"]), ("Released under the GNU Lesser General Public License", ["lgpl"]),
])
def test_names_and_identifiers(model, text, families):
    assert [x[2] for x in L.scan_text(text, model)] == families
    assert [x[2] for x in L.scan_text(f"{PROSE[3]}\n\n{text}\n\n{PROSE[4]}", model)] == families


class Everything:
    """The classifier switched off: every family is likely everywhere."""

    def predict(self, w):
        return [(f, 1.0) for f in L.TEMPLATES], 0.0


def test_the_classifier_decides(model):
    talk = ["Which is better, the MIT License or the Apache License, Version 2.0?", "We do not accept code under the GPL v3.", "An article about the Mozilla Public License appeared today.", "Questions about the BSD 3-Clause License are answered here."]
    for t in talk:
        assert not [x for x in L.scan_text(t, model) if x[2] != L.UNKNOWN], t
        assert [x for x in L.scan_text(t, Everything()) if x[2] != L.UNKNOWN], t


def test_templates_turn_down_the_wrong_family(model):
    """A family that no template confirms is not found, however likely it is."""
    class Sure:
        def predict(self, w):
            return [("mit", 1.0)], 0.0

    for t in ("SPDX-License-Identifier: BSD-3-Clause", "Licensed under the Apache License, Version 2.0", "GNU General Public License"):
        assert not [x for x in L.scan_text(t, Sure()) if x[2] == "mit"]


def test_anchors_lose_nothing():
    """Whatever part of a template confirms a family alone, its text holds an anchor."""
    for f in L.TEMPLATES:
        for t in (*L._NOTICES[f], *L._SHORT[f]):
            for a in range(0, len(t)):
                for b in range(a + 2, min(len(t), a + L.LONG) + 1):
                    if L.confirm(t[a:b], f):
                        assert L.ANCHOR.search(" ".join(t[a:b])), (f, t[a:b])


def plain_scan(text, model):
    """Units in order, classified and confirmed one by one, without the anchor filter and caches: the families of each text."""
    out = set()
    for para in re.split(r"\n[^\w\n]*(?=\n)", text):
        w = L.words(para)
        starts = [0] if len(w) <= L.LONG else range(0, len(w) - L.LONG // 2, L.LONG // 2)
        for k in starts:
            rest = w[k : k + L.LONG]
            while rest:
                got = [(f, a, b) for f, _ in model.predict(rest)[0] for a, b in L.confirm(rest, f)]
                out |= {f for f, _, _ in got}
                for _, a, b in got:
                    rest[a : b + 1] = [""] * (b + 1 - a)
                if not got:
                    break
    return out


def test_families_equal_a_plain_scan(model):
    r = random.Random(5)
    pieces = [*(t for ts in L.TEMPLATES.values() for t in ts), *(x for xs in L.TEXTS.values() for x in xs), *(n for ns in L.NAMES.values() for n in ns), *L.GENERAL, *PROSE[:40]]
    for k in range(150):
        text = "".join(r.choice(pieces) + r.choice([" ", "\n", "\n\n", ". ", "\n * "]) for _ in range(r.randint(1, 9)))
        assert {x[2] for x in L.scan_text(text, model)} - {L.UNKNOWN} == plain_scan(text, model), text


def test_repeated_and_mixed_notices(model):
    lines = ["Released under the MIT License.", "plain", "Licensed under CC BY-NC 4.0."] * 50
    got = L.scan_text("\n".join(lines), model)
    assert [x[2] for x in got] == ["mit", "cc-by-nc"] * 50


def test_scan_defined_results(spark):
    texts = [None, "", "\n\n", "Released under the MIT License.", "Released under the MIT License.", "nothing here", "a permission to use"]
    df = spark.createDataFrame([(k % 6, t) for k, t in enumerate(texts)], "doc_id int, text string").withColumn("findings", F.lit(1)).withColumn("line", F.lit("x")).withColumn("id", F.lit(2))
    got = L.scan(df, L.train(df)).collect()
    assert sorted((r.doc_id, tuple(x.family for x in r.findings)) for r in got) == [(0, ()), (0, ("unknown",)), (1, ()), (2, ()), (3, ("mit",)), (4, ("mit",)), (5, ())]
    none = df.where("false")
    assert L.scan(none, L.train(none)).count() == 0


def test_query_finds_planted_notices_and_nothing_else(spark, tmp_path):
    rows = [(k, "\n".join([PROSE[k], *(["This work is licensed under the GNU General Public License, version 3."] if k % 3 == 0 else [])])) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op6_license_scan(spark, f"file://{tmp_path}").collect()}
    for k, text in rows:
        at = text.find("This work")
        assert got[k].spans == ("" if at < 0 else f"gpl:{at}:{len(text) - 1}")
        assert (got[k].n_found, got[k].n_unknown, got[k].families) == ((1, 0, "gpl") if at >= 0 else (0, 0, ""))
