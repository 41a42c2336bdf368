"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear
support vector machines that separate the languages within it.

Features are frequencies of hashed byte n-grams of the lower-cased text. A decision is the mean weight
over all n-grams of the whole text, so scoring streams over the text, however long it is.

Each family also meets a class of strange texts: sample texts with their letters exchanged or moved to another
script, random letters, and symbols with few letters. The chance of the winning family against it says whether a text
is in any learned language at all. Chances come from margins by logistic links, fitted on a quarter of the sample that the
machines do not see; the score is the product of the family's, the language's and this last chance.

Fitting uses a bounded sample: about ``per_language`` documents of each language (drawn by a hash of the
id, so the same rows whatever the partitions); it runs in one task, which holds 33 MB of features per 1,000 rows
(1.5 rows per document), and only the weights come back.
Scoring covers every document, inside its scan task and without a shuffle.

Defined results: null text, or one without any letter, gives ``und`` with score 0; with no labelled rows
everything is ``und``; with one language that one is predicted, its score being the chance against strange texts; ties
go to the first label in sort order; repeated rows are scored each; extra columns are carried only on request.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

BITS = 13
ORDERS = (1, 2, 3, 4)
#: Bytes scored at a time; longer texts are scored in overlapping slices.
SLICE = 1 << 20

#: Language families. A language outside this table is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_FAMILY = {x: f for f, xs in FAMILIES.items() for x in xs}

# letters and bytes of longer characters stay; every other ASCII byte is a blank
_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Hashed n-grams at every position of data where one fits."""
    n = len(data) - order + 1
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h *= np.uint32(0x01000193)
        h ^= data[k : k + n]
    h *= np.uint32(0x85EBCA6B)
    h >>= np.uint32(32 - BITS)
    return h


def _bytes(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEEP).split()) + b" "


def features(text: str) -> np.ndarray:
    """Frequencies of the hashed n-grams of one text, all orders together."""
    raw, total, x = _bytes(text), 0, np.zeros(1 << BITS)
    for at in range(0, len(raw), SLICE):
        for n in ORDERS:
            part = np.frombuffer(raw[at : at + SLICE + n - 1], np.uint8)
            if len(part) >= n:
                x += np.bincount(_grams(part, n), minlength=1 << BITS)
                total += len(part) - n + 1
    return (x / max(total, 1)).astype(np.float32)


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Mean weight over all n-grams of each text, for each column of weights."""
    raws = [_bytes(t) for t in texts]
    sums, totals = np.zeros((len(raws), weights.shape[1])), np.zeros(len(raws))
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            data = np.frombuffer(b"".join(r for _, r in group), np.uint8)
            lens = np.array([len(r) for _, r in group])
            ends = np.cumsum(lens)
            who = np.array([i for i, _ in group])
            for n in ORDERS:
                ok = lens >= n
                cum = np.zeros((len(data) - n + 2, weights.shape[1]))
                np.cumsum(weights[_grams(data, n)], axis=0, out=cum[1:])
                a, b = (ends - lens)[ok], (ends - n + 1)[ok]
                np.add.at(sums, who[ok], cum[b] - cum[a])
                np.add.at(totals, who[ok], b - a)
            group.clear()
            size = 0

    for i, r in enumerate(raws):
        if len(r) <= SLICE:
            group.append((i, r))
            size += len(r)
        else:
            for at in range(0, len(r), SLICE):
                for n in ORDERS:
                    part = np.frombuffer(r[at : at + SLICE + n - 1], np.uint8)
                    if len(part) >= n:
                        sums[i] += weights[_grams(part, n)].sum(axis=0, dtype=np.float64)
                        totals[i] += len(part) - n + 1
        if size >= SLICE // 2:
            flush()
    flush()
    return sums / np.maximum(totals, 1)[:, None]


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, classes weighted evenly; accelerated full gradient. Rows with y = 0
    take no part (so no copy of x is made per pair)."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w.copy(), b
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), np.where(y < 0, 0.5 / max((y < 0).sum(), 1), 0)).astype(np.float32)
    rate = 1 / (1 / c + 2 * float((share * (np.einsum("ij,ij->i", x, x) + 1)).sum()))
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb))
        g = -2 * share * y * slack
        pw, pb = w, b
        w, b = vw - rate * (vw / c + x.T @ g), vb - rate * float(g.sum())
    return w, b


#: First letters of runs of letters in other scripts.
_SCRIPTS = (0x3B1, 0x430, 0x5D0, 0x627, 0x905, 0xE01, 0x3042, 0x4E00, 0xAC00, 0x10D0)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
STRANGE = "?"


def strange(text: str, kind: int, rng: np.random.Generator) -> str:
    """A text in no language, made from one that is in some."""
    if kind % 4 == 0:  # other letters, in the same script
        return text.lower().translate(dict(zip(map(ord, _LETTERS), "".join(rng.permutation(list(_LETTERS))))))
    if kind % 4 == 1:
        first = int(rng.choice(_SCRIPTS))
        return "".join(chr(first + int(k)) if c.isalpha() else c for c, k in zip(text, rng.integers(0, 20, len(text))))
    if kind % 4 == 2:
        return " ".join("".join(rng.choice(list(_LETTERS), n)) for n in rng.integers(1, 12, max(1, len(text) // 7)))
    return "".join(rng.choice(list("#$%&*+-=/<>|_~0123456789" * 4 + _LETTERS[:6]), max(1, len(text))))


def _part(text: str, most: int, rng: np.random.Generator) -> str:
    """Some neighbouring words."""
    w = text.split()
    n = int(rng.integers(2, most))
    at = int(rng.integers(0, max(1, len(w) - n + 1)))
    return " ".join(w[at : at + n])


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance of y = 1 given a margin, with smoothed targets; the slope stays positive."""
    up, down = float((y > 0).sum()), float((y < 0).sum())
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    w = np.where(y > 0, 1 / max(up, 1), 1 / max(down, 1))
    a, b = 3.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = w * (q - t), w * np.maximum(q * (1 - q), 1e-9)
        step = np.linalg.solve([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]], [(g * m).sum(), g.sum()])
        a, b = max(a - np.clip(step[0], -2, 2), 0.1), b - float(np.clip(step[1], -2, 2))
    return float(a), float(b)


def fit(texts: list[str], langs: list[str], seed: int = 3) -> dict:
    """The model: families, and per pair a column of weights, a bias and a logistic link. One feature matrix, changed in
    place. ``least`` is a fifth of the chance against strange texts that all but one in a thousand of the texts kept back
    reach: a text below it is in no learned language."""
    labels = sorted(set(langs))
    family = {x: _FAMILY.get(x, x) for x in labels}
    groups = {f: [x for x in labels if family[x] == f] for f in sorted(set(family.values()))}
    if not labels:
        return {"groups": groups, "pairs": [], "w": np.zeros((1 << BITS, 0), np.float32), "b": np.zeros(0), "links": [], "least": 0.0}
    rng = np.random.default_rng(seed)
    rows = list(zip(texts, langs))
    rows += [(_part(t, 30, rng), v) for t, v in zip(texts[::4], langs[::4])]
    rows += [(strange(_part(t, 300, rng), k, rng), STRANGE) for k, t in enumerate(texts[1::4] or texts)]
    x = np.empty((len(rows), 1 << BITS), np.float32)
    for i, (t, _) in enumerate(rows):
        x[i] = features(t)
    mean = x.mean(axis=0)
    x -= mean
    scale = (8 / np.sqrt(x.shape[1])) / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4)
    x *= scale
    lang = np.array([v for _, v in rows])
    fam = np.array([family.get(v, v) for v in lang])
    back = rng.random(len(rows)) < 0.25  # kept back for the links
    pairs, ws, bs, links = [], [], [], []
    levels = [("", fam, list(combinations(groups, 2))), (STRANGE, fam, [(f, STRANGE) for f in groups]), *((f, lang, list(combinations(g, 2))) for f, g in groups.items())]
    for level, of, duels in levels:
        for p, q in duels:
            y = np.where(of == p, 1.0, np.where(of == q, -1.0, 0.0)).astype(np.float32)
            w, b = _svm(x, np.where(back, np.float32(0), y))
            test = np.flatnonzero(back & (y != 0))
            links.append(_platt(x[test] @ w + b, y[test]))
            w = w * scale
            pairs.append((level, p, q))
            ws.append(w)
            bs.append(b - float(w @ mean))
    model = {"groups": groups, "pairs": pairs, "w": np.stack(ws, axis=1).astype(np.float32), "b": np.array(bs), "links": links, "least": 0.0}
    kept = [t for (t, v), k in zip(rows[: len(texts)], back) if k and has_letter(t)]
    if kept:
        model["least"] = 0.2 * float(min(0.5, np.quantile(judge(kept, model)[2], 0.001)))
    return model


def _vote(margins: np.ndarray, chances: np.ndarray, pairs: list[tuple[int, str, str]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one: index of the winner by votes, then by summed margins; and its least win chance."""
    n = len(margins)
    votes, sums, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
    for col, p, q in pairs:
        m = margins[:, col]
        for name, sign, c in ((p, 1, chances[:, col]), (q, -1, 1 - chances[:, col])):
            k = names.index(name)
            votes[:, k] += (m >= 0) if sign > 0 else (m < 0)
            sums[:, k] += sign * m
            least[:, k] = np.minimum(least[:, k], c)
    best = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1)
    return best, least[np.arange(n), best]


def judge(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score, and chance of being in any learned language, of each text."""
    out, score, known = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if has_letter(t)]
    names = list(model["groups"])
    if not some or not names:
        return out, score, known
    margins = scores([texts[i] for i in some], model["w"]) + model["b"]
    a, b = np.array(model["links"]).T
    chances = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
    pairs = [(k, lv, p, q) for k, (lv, p, q) in enumerate(model["pairs"])]
    fam, sure = _vote(margins, chances, [(k, p, q) for k, lv, p, q in pairs if lv == ""], names)
    for f, name in enumerate(names):
        rows = np.flatnonzero(fam == f)
        if len(rows):
            inner = model["groups"][name]
            best, s = _vote(margins[rows], chances[rows], [(k, p, q) for k, lv, p, q in pairs if lv == name], inner)
            real = chances[rows, next(k for k, lv, p, _ in pairs if lv == STRANGE and p == name)]
            for r, k, v, x in zip(rows, best, s * sure[rows] * real, real):
                out[some[r]], score[some[r]], known[some[r]] = inner[k], v, x
    return out, score, known


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 700) -> dict:
    """Fit on about per_language labelled documents of each language that are not held out.

    The share of each language comes from its count; a document is in when the hash of its id is low.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}  # one row per language
    if not counts:
        return fit([], [])
    span = 1 << 20
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(min(span, span * per_language / n) + 1))])
    draw = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(span)) < share[F.col(lang_col)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((v, t) for b in batches for v, t in zip(b["lang"], b["text"]) if has_letter(t))
        yield pd.DataFrame({"model": [pickle.dumps(fit([t for _, t in rows], [v for v, _ in rows]))]})

    one = draw.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).repartition(1).mapInPandas(run, "model binary")
    found = one.collect()  # one row of bounded size
    return pickle.loads(found[0][0]) if found else fit([], [])


def classify(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), pred: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """The kept columns of every row with the predicted language, its score and, if named, the chance of being in any
    learned language."""
    inner = [f"k{i}" for i in range(len(keep))]
    picked = docs.select(F.col(text_col).alias("t"), *[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner)])
    schema = T.StructType([*picked.schema.fields[1:], T.StructField("p", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("z", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, s, z = judge(b.column(0).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p, pa.string()), pa.array(s, pa.float64()), pa.array(z, pa.float64())], [*inner, "p", "s", "z"])

    told = picked.mapInArrow(run, schema)
    return told.toDF(*keep, pred, score, known) if known else told.drop("z").toDF(*keep, pred, score)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
