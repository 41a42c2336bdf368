"""Licence scan: a trained paragraph classifier whose predictions a template comparison confirms.

A paragraph is a run of lines that hold words: line ends and comment marks are no words, so a wrapped or commented
notice is one piece. A unit is a paragraph, or if it has more than ``LONG`` words a window of that many, half
overlapping, so every run of LONG / 2 words stands whole in one unit. Units with an anchor (below) are classified by
multinomial logistic regression on sparse word uni- and bigrams. The classes are the licence families and
``unknown``; probabilities are calibrated with a temperature. The classifier decides whether a unit licenses
something: a family needs the probability that, of held-out units that are not its own, all but one in two hundred stay
below. Every family that reaches it, so also two in one unit, is confirmed once a template and the unit share enough
word pairs that stand close together, among them an anchor and a pair that no other family's templates have; these words
give the span. So a text that only talks about a licence is turned down by the classifier, and one that names
another licence than the likeliest by the templates. A family confirmed in a paragraph is also sought by its templates in the
paragraph's other units, so a long notice is found whole. Of families that claim the same words the one with
the better template match wins. Other units with a licence word are ``unknown``. A unit without an anchor holds nothing that
could be confirmed, so leaving it out loses nothing.

The classifier is trained here: positives are windows of the templates with words dropped, changed and surrounded, names
and identifiers of licences in usual phrases, and choices between two; negatives are sentences that talk about licences
or name one, and lines of the corpus, a sample of about ``sample`` lines
drawn by hash, of which ``LONG`` words each (a random window) are used. Fitting is one task of bounded size.
Scanning covers every whole text inside its scan task, without a shuffle.

Defined results: null or empty text has no units and no findings; repeated rows are scanned each; an empty
table gives no rows; of equal probabilities the first family in order wins; extra columns are not read.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Words of a window of a long line.
LONG = 40
#: Share of a template's word pairs that a unit must hold, or the number of close pairs that is enough of a long one;
#: and the most words between two of them.
COVER, PAIRS, GAP = 0.6, 12, 4
#: Templates of so many words at most, names above all, must be met without a gap.
SHORT = 8
UNKNOWN = "unknown"

#: Usual notices of each family, lower case.
TEMPLATES = {
    "agpl": ("this program is licensed under the gnu affero general public license version 3", "you can redistribute it under the terms of the gnu affero general public license", "spdx license identifier agpl 3 0 or later"),
    "apache": ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license", "spdx license identifier apache 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd 3 clause license", "released under the bsd 2 clause license", "use of this source code is governed by a bsd style license"),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc0": ("released under cc0 1 0 universal", "the person who associated a work with this deed has dedicated the work to the public domain"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "it under the terms of the gnu general public license as published by the free software foundation", "spdx license identifier gpl 3 0 or later"),
    "isc": ("released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("licensed under the gnu lesser general public license version 2 1", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "spdx license identifier mit"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license version 2 0", "licensed under the mozilla public license 2 0"),
    "proprietary": ("all rights reserved unauthorized copying of this file is strictly prohibited", "proprietary and confidential all rights reserved"),
}
#: Longer notices and licence texts, lower case words only.
TEXTS = {
    "agpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "apache": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "lgpl": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",),
}
#: Names, short names and SPDX identifiers of each family, as words.
NAMES = {
    "agpl": ("gnu affero general public license", "gnu affero general public license version 3", "agpl v3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"),
    "apache": ("apache license version 2 0", "apache license version 2 0 january 2004", "apache license 2 0", "apache 2 0", "apache 2 0 license"),
    "bsd": ("bsd 3 clause license", "bsd 2 clause license", "bsd 3 clause", "bsd 2 clause", "3 clause bsd license", "2 clause bsd license", "new bsd license", "simplified bsd license", "bsd license"),
    "cc-by": ("cc by 4 0", "cc by 3 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international"),
    "cc-by-nc": ("cc by nc 4 0", "cc by nc 3 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international"),
    "cc-by-sa": ("cc by sa 4 0", "cc by sa 3 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international"),
    "cc0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero"),
    "gpl": ("gnu general public license", "gnu general public license version 2", "gnu general public license version 2 june 1991", "gnu general public license version 3", "gpl v2", "gpl v3", "gpl v2 or later", "gpl v3 or later", "gpl 2 0", "gpl 3 0", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl version 2", "gpl version 3"),
    "isc": ("isc license",),
    "lgpl": ("gnu lesser general public license", "gnu lesser general public license version 2 1", "lgpl v2 1", "lgpl v3", "lgpl 2 1", "lgpl 3 0", "lgpl 2 1 or later", "lgpl 3 0 or later"),
    "mit": ("mit license", "the mit license"),
    "mpl": ("mozilla public license", "mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
}
#: SPDX identifiers of families whose name is no identifier of its own.
BARE = {"isc": ("isc",), "mit": ("mit",)}
#: Phrases around a name (#) that license something.
GRANTS = (
    "#", "#", "license #", "licensed under the #", "released under the #", "distributed under the terms of the #", "under the terms of the #", "available under the #", "you may use this file under the terms of the #",
    "this project is licensed under the #", "code is under #", "is licensed under # see license for details", "subject to the #", "spdx license identifier #", "copyright 2020 the authors licensed under #", "see the # for more details",
)
#: Phrases around one or two names that talk about licences and license nothing.
TALK = (
    "which is better the # or the #", "how does the # differ from the #", "the # was written by lawyers", "a history of the # and its authors", "unlike the # our contract forbids copies", "we do not accept code under the #",
    "this is not licensed under the #", "it is incompatible with the #", "the court read the # aloud", "students discussed the # in class", "an article about the # appeared today", "critics of the # say it is too strict",
    "he explained the # to the jury", "many people confuse the # with the #", "is the # valid in france", "the popularity of the # has declined", "never released under the #", "questions about the # are answered here",
)
#: Sentences about licences that license nothing.
GENERAL = (
    "the driver lost his license after the second offence", "a fishing license is required in this county", "copyright law has been debated for years",
    "the court dismissed the copyright claim of the author", "the store needs a new liquor license", "which license should i choose for my project",
    "the council may license street vendors", "his poetic license offended some readers", "licensed nurses are in short supply", "the old reserved table was free",
    "you need permission from your parents to use the car", "the gnu is a large antelope of africa", "the apache people lived in the plains", "students of mit won the general prize",
    "the terms of the public contract were published", "the mozilla foundation hired a new director", "creative writing is a common course", "she asked permission to copy the form",
    "redistribution of wealth is a topic of politics", "proprietary drugs cost more than others", "the confidential file was left on the desk", "the software license fee rose this year",
    "students of mit or harvard apply early", "she studied at stanford or mit and wrote a book", "an apache 2 0 helicopter flew by",
)
#: Words that licences and talk about them hold.
LICENCE_WORDS = ("licen[cs]e", "copyright", "spdx", "cc0", "public domain", "redistribut", "hereby granted", "permission to use", "proprietary", "rights reserved", "general public")
LICENCE = re.compile("|".join(LICENCE_WORDS), re.IGNORECASE)
#: A unit needs one of these, and so does every run of words that confirms a family.
ANCHORS = (*LICENCE_WORDS, "gpl", r"\bmpl\b", "mozilla", r"\bapache\W", r"\bbsd\b", r"\bisc\b", "creative commons", r"\bcc\W+by\b", r"\bmit\W+(?:or|and)\b", r"\b(?:or|and)\W+mit\b")
ANCHOR = re.compile("|".join(ANCHORS), re.IGNORECASE)

_WORD = re.compile(r"[^\W_]+")


#: A line without a word ends a paragraph.
_BLANK = re.compile(r"\n[^\w\n]*(?=\n)")
_NOTICES = {f: [t.split() for t in (*TEMPLATES[f], *TEXTS.get(f, ()))] for f in TEMPLATES}
#: Names count as templates, bare identifiers where they stand in an expression.
_SHORT = {f: [*(n.split() for n in NAMES.get(f, ())), *(["spdx", "license", "identifier", *n.split()] for n in (*NAMES.get(f, ()), *BARE.get(f, ()))), *(x for n in BARE.get(f, ()) for x in ([n, "or"], ["or", n], [n, "and"], ["and", n]))] for f in TEMPLATES}


def _places(t: list[str]) -> dict[tuple[str, str], list[int]]:
    """Places of every word pair of a template."""
    out: dict[tuple[str, str], list[int]] = {}
    for k, g in enumerate(zip(t, t[1:])):
        out.setdefault(g, []).append(k)
    return out


_PLACES = {f: [_places(t) for t in (*_NOTICES[f], *_SHORT[f])] for f in TEMPLATES}
#: Word pairs that only this family's templates have.
_OWN = {f: set().union(*_PLACES[f]) - set().union(*(p for g in TEMPLATES if g != f for p in _PLACES[g])) for f in TEMPLATES}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(w: list[str]) -> list[str]:
    return [*w, *map(" ".join, zip(w, w[1:]))]


def _examples(lines: list[str], rng: np.random.Generator, per_template: int) -> tuple[list[list[str]], list[str]]:
    filler = [w for t in lines for w in words(t)] or "some other words stand around it here".split()
    around = lambda n: [filler[k] for k in rng.integers(0, len(filler), n)]
    out, labels = [], []
    for family, notices in _NOTICES.items():
        for t in notices:
            for _ in range(per_template * (1 + len(t) // LONG)):
                n = min(len(t), LONG)
                at = int(rng.integers(0, len(t) - n + 1))
                w = [x for x in t[at : at + n] if rng.random() > 0.03]
                more = int(rng.integers(0, LONG - len(w) + 1))
                ahead = int(rng.integers(0, more + 1))
                out.append([*around(ahead), *w, *around(more - ahead)] if rng.random() < 0.6 else w)
                labels.append(family)
    names = [(f, n) for f in TEMPLATES for n in (*NAMES.get(f, ()), *BARE.get(f, ()))]

    def placed(w: list[str]) -> list[str]:
        more = int(rng.integers(0, max(1, LONG - len(w) + 1))) if rng.random() < 0.6 else 0
        ahead = int(rng.integers(0, more + 1))
        return [*around(ahead), *w, *around(more - ahead)][:LONG]

    for f, n in names:
        for phrase in GRANTS:
            if n not in BARE.get(f, ()) or "identifier" in phrase:
                for _ in range(2):
                    out.append(placed(phrase.replace("#", n).split()))
                    labels.append(f)
        for _ in range(4):  # a choice is an example of both
            g, m = names[int(rng.integers(0, len(names)))]
            if g != f:
                w = placed([*(["spdx", "license", "identifier"] if rng.random() < 0.5 else []), *n.split(), str(rng.choice(["or", "or", "and"])), *m.split()])
                out += [w, w]
                labels += [f, g]
    for phrase in TALK:
        for _ in range(per_template):
            w = phrase
            while "#" in w:
                w = w.replace("#", names[int(rng.integers(0, len(names)))][1], 1)
            out.append(placed(w.split()))
            labels.append(UNKNOWN)
    for t in GENERAL:
        for _ in range(per_template):
            w = [x if rng.random() > 0.15 else around(1)[0] for x in t.split()]
            out.append(w + around(int(rng.integers(0, LONG - len(w) + 1))))
            labels.append(UNKNOWN)
    for t in lines:
        w = words(t)
        at = int(rng.integers(0, max(1, len(w) - LONG + 1)))
        if not ANCHOR.search(t):
            out.append(w[at : at + LONG])
            labels.append(UNKNOWN)
    return out, labels


class Model:
    """Weights over sparse n-grams, a temperature and the probability that each family needs."""

    def __init__(self, lines: list[str], seed: int = 11, per_template: int = 24, steps: int = 320) -> None:
        rng = np.random.default_rng(seed)
        texts, labels = _examples(sorted(lines), rng, per_template)
        self.classes = [*TEMPLATES, UNKNOWN]
        y = np.array([self.classes.index(v) for v in labels])
        hold = rng.random(len(y)) < 0.25
        counts = Counter(g for t, h in zip(texts, hold) if not h for g in set(_grams(t)))
        self.index = {g: k for k, g in enumerate(sorted(g for g, n in counts.items() if n >= 5))}
        rows = [self._row(t) for t in texts]
        self.weights = np.zeros((len(self.index) + 1, len(self.classes)))
        fit, test = np.flatnonzero(~hold), np.flatnonzero(hold)
        # sparse rows as flat (row, column, value) lists
        r = np.repeat(np.arange(len(fit)), [len(rows[i][0]) for i in fit])
        c, v = np.concatenate([rows[i][0] for i in fit]), np.concatenate([rows[i][1] for i in fit])
        order = np.argsort(c, kind="stable")
        by_column, heads = order, np.flatnonzero(np.diff(c[order], prepend=-1))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
        target = np.eye(len(self.classes))[y[fit]]
        share = 1 / (len(self.classes) * np.bincount(y[fit], minlength=len(self.classes)).clip(1))[y[fit]][:, None]
        moment = np.zeros_like(self.weights)
        for _ in range(steps):
            z = np.add.reduceat(self.weights[c] * v[:, None], starts, axis=0)
            g = (self._soft(z) - target) * share
            grad = 1e-5 * self.weights
            grad[c[by_column][heads]] += np.add.reduceat(g[r[by_column]] * v[by_column][:, None], heads, axis=0)
            moment = 0.9 * moment - 20 * grad
            self.weights += moment
        self.weights[np.abs(self.weights) < 1e-3] = 0
        self.temperature, self.least = 1.0, [0.5] * len(TEMPLATES)
        z = np.stack([self._margins(texts[i]) for i in test])
        losses = [(-np.log(self._soft(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean(), t) for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)]
        self.temperature = min(losses)[1]
        p = self._soft(z / self.temperature)
        # a choice stands twice, with both labels: it is foreign to neither
        labelled: dict[tuple, set] = {}
        for t, k in zip(texts, y):
            labelled.setdefault(tuple(t), set()).add(int(k))
        self.accuracy = float(np.mean([int(k) in labelled[tuple(texts[i])] for k, i in zip(p.argmax(axis=1), test)]))
        foreign = np.array([[k not in labelled[tuple(texts[i])] for k in range(len(TEMPLATES))] for i in test])
        self.least = [float(max(0.15, np.quantile(p[foreign[:, k], k], 0.995))) if foreign[:, k].any() else 0.5 for k in range(len(TEMPLATES))]

    def _row(self, w: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = sorted({self.index[g] for g in _grams(w) if g in self.index})
        x = np.full(len(got) + 1, 1 / np.sqrt(len(got) + 1))
        return np.array([*got, len(self.index)]), x

    def _margins(self, w: list[str]) -> np.ndarray:
        k, v = self._row(w)
        return v @ self.weights[k]

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def predict(self, w: list[str]) -> tuple[list[tuple[str, float]], float]:
        """Families that are likely enough, likeliest first, and the probability of the unknown class."""
        p = self._soft(self._margins(w) / self.temperature)
        order = np.argsort(-p[:-1], kind="stable")
        return [(self.classes[k], float(p[k])) for k in order if p[k] >= self.least[k]], float(p[-1])


def confirm(w: list[str], family: str, alone: bool = True) -> list[tuple[int, int]]:
    """First and last word of each run of words that the unit shares with a template of the family, in the template's
    order, where that is enough. A run that stands alone needs an anchor and a pair of the family's own."""
    pairs, out = list(zip(w, w[1:])), []
    for own in _PLACES.get(family, ()):
        runs: list[list[int]] = []
        gap = GAP if len(own) >= SHORT else 1
        at = -1  # place in the template, which only grows within a run
        for k, g in enumerate(pairs):
            if g in own:
                later = next((x for x in own[g] if x > at), None)
                if not runs or later is None or k - runs[-1][-1] > gap:
                    runs.append([])
                    later = own[g][0]
                runs[-1].append(k)
                at = later
        for run in runs:
            share = len({pairs[k] for k in run}) / len(own)
            dense = len(run) / (run[-1] - run[0] + 1)
            if share >= COVER or (len(run) >= PAIRS and dense >= 0.8):
                if not alone or (any(pairs[k] in _OWN[family] for k in run) and ANCHOR.search(" ".join(w[run[0] : run[-1] + 2]))):
                    out.append((run[0], run[-1] + 1))
    return out


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every paragraph that has an anchor."""
    hit = ANCHOR.search(text)
    if not hit:
        return
    cuts = [m.end() for m in _BLANK.finditer(text)]
    a = 0
    for b in (*cuts, len(text)):
        if hit is None:
            return
        if hit.start() < b:
            yield a, b
            hit = ANCHOR.search(text, b)
        a = b


def units(spots: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """First and last word (exclusive) of every unit of a paragraph."""
    if len(spots) <= LONG:
        yield 0, len(spots)
    else:
        for k in range(0, len(spots) - LONG // 2, LONG // 2):
            yield k, min(k + LONG, len(spots))


Finding = tuple[int, int, str, float]


def _claims(w: list[str], families: list[tuple[str, float]], alone: bool = True) -> list[Finding]:
    return [(a, b, f, p) for f, p in families for a, b in confirm(w, f, alone)]


def scan_text(text: str | None, model: Model) -> list[Finding]:
    """(start, end, family, probability) in code points, by start; overlapping findings of one
    family are one, and an unknown unit that overlaps a confirmed finding is left out."""
    out: list[Finding] = []
    judged = lru_cache(4096)(lambda unit: model.predict(list(unit)))
    for a, b in paragraphs(text or ""):
        out += _scan_paragraph(text, a, b, judged)
    return sorted(out)


def _scan_paragraph(text: str, a: int, b: int, judged) -> list[Finding]:
    spots = [m.span() for m in _WORD.finditer(text, a, b)]
    w = [text[x:y].lower() for x, y in spots]
    claims, seen, unsure = [], {}, []
    for i, j in units(spots):
        if not ANCHOR.search(text, spots[i][0], spots[j - 1][1]):
            continue
        rest, found = w[i:j], False
        while True:  # what a confirmed family leaves is judged again
            families, none = judged(tuple(rest))
            got = _claims(rest, families)
            for x, y, f, p in got:
                claims.append((i + x, i + y, f, p))
                seen[f] = max(seen.get(f, 0.0), p)
                rest[x : y + 1] = [""] * (y + 1 - x)
            found = found or bool(got)
            if not got or not ANCHOR.search(" ".join(rest)):
                break
        if not found and LICENCE.search(text, spots[i][0], spots[j - 1][1]):
            unsure.append((i, j, UNKNOWN, none if not families else 1 - families[0][1]))
    if seen:  # the rest of a notice may hold no anchor, or a family too faint beside another
        for i, j in units(spots):
            claims += [(i + x, i + y, f, p) for x, y, f, p in _claims(w[i:j], list(seen.items()), False)]
    known = [(spots[x][0], spots[y][1], f, p) for x, y, f, p in _joined(claims, w)]
    ends = [x[1] for x in known]  # known findings do not overlap, so both ends ascend
    merged: list[Finding] = []
    for i, j, f, p in unsure:
        x = (spots[i][0], spots[j - 1][1], f, p)
        k = bisect_right(ends, x[0])
        if k < len(known) and known[k][0] < x[1]:
            continue  # a window that cuts a notice which its neighbour holds whole says nothing
        if merged and merged[-1][1] > x[0]:
            last = merged.pop()
            x = (last[0], x[1], f, max(last[3], p))
        merged.append(x)
    return known + merged


def _joined(claims: list[Finding], w: list[str]) -> list[Finding]:
    """Claims (first word, last word, family, probability) by place. Overlapping ones of one family become one; then the
    family that matches more word pairs keeps the words that several claim."""
    by_family: list[Finding] = []
    for c in sorted(set(claims), key=lambda c: (c[2], c[0], c[1])):
        if by_family and by_family[-1][2] == c[2] and c[0] <= by_family[-1][1]:
            o = by_family.pop()
            c = (o[0], max(o[1], c[1]), c[2], max(o[3], c[3]))
        by_family.append(c)
    matched = lambda c: sum(any(g in own for own in _PLACES[c[2]]) for g in zip(w[c[0] : c[1]], w[c[0] + 1 : c[1] + 1]))
    starts: list[int] = []
    kept: list[Finding] = []  # by start, free of overlaps
    for _, c in sorted(((matched(c), c) for c in by_family), key=lambda m: (-m[0], -m[1][3], m[1])):
        k = bisect_right(starts, c[0])
        if (k == 0 or kept[k - 1][1] < c[0]) and (k == len(kept) or c[1] < kept[k][0]):
            starts.insert(k, c[0])
            kept.insert(k, c)
    return kept


def train(docs: DataFrame, text_col: str = "text", sample: int = 2000) -> Model:
    """Fit with about ``sample`` lines of the corpus as part of the unknown class."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.explode(F.split(text_col, "\n")).alias("line"))
    total = docs.agg(F.sum(F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    span = 1 << 30
    low = span if total <= sample else int(span * sample / total) + 1
    draw = lines.where((F.pmod(F.xxhash64("line", F.lit(5)), F.lit(span)) < low) & (F.length("line") > 0)).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"model": [pickle.dumps(Model([t for b in batches for t in b["line"]]))]})

    found = draw.repartition(1).mapInPandas(run, "model binary").collect()  # one row of bounded size
    return pickle.loads(found[0][0]) if found else Model([])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, and findings: array of (start, end, family, probability)."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[dict(zip(("start", "end", "family", "probability"), x)) for x in scan_text(t.as_py(), model)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], ["id", "findings"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, findings array<struct<start:bigint,end:bigint,family:string,probability:double>>").withColumnRenamed("id", id_col)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: confirmed findings, unknown ones, the families and spans, and the least probability of a confirmed one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = F.filter("findings", lambda x: x["family"] != UNKNOWN)
    span = lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))
    return scan(docs, train(docs)).select(
        "doc_id", F.size(known).cast("long").alias("n_found"), (F.size("findings") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(known, span), ",").alias("spans"), F.array_min(F.transform(known, lambda x: x["probability"])).alias("least_probability"),
    )


QUERIES = {"op6_license_scan": op6_license_scan}
