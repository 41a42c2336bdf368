"""Main text of HTML pages by a tree-structured graphical model over the page's blocks.

Every block element of a page (paragraph, list, division, …) is a binary variable: does its own text belong to the
article? A block's features (tag, words of its class and id, lengths, link share, place) give its own potential, each
parent and child a 2 x 2 potential by the child's tag. Sum-product message passing, from the leaves up and from
the root down, gives exact marginals; a block's text is kept if its marginal is at least a half. The weights are fitted to
labelled pages by maximum likelihood, whose gradient comes from the same marginals. Labelled pages are HTML in which
``data-main="1"`` marks elements of the article and ``data-main="0"`` what is not; an element without the mark follows its
parent. ``labelled_pages`` makes them, as no table has labels; ``fit`` takes any others.

Null pages are empty ones. A page without text, or without main text, gives an empty text. Pages are read whole, however
long or deeply nested; repeated rows give a row each; other columns are not read. Character references
are decoded, then white space (as ``str.split`` has it, no-break spaces included) within a block becomes one space, and
blocks are joined in page order by one space. Blocks of scripts, styles, comments and the head are never text. Broken
markup is read leniently: open elements end with their parents, end tags that match nothing are ignored, a tag or
comment cut off by the page's end is dropped.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes svg math template object".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of the first set, unless one of the second lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "table"])), "dd": (frozenset(["dd", "dt"]), frozenset(["dl", "table"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])), "tfoot": (frozenset(["thead", "tbody"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
}
IN_TABLE = frozenset("table caption thead tbody tfoot tr td th".split())
CELL = frozenset(["td", "th", "caption"])
TAGS = tuple(sorted(ENDS_P | IN_TABLE | set(ENDS) | {"html", "body", "button", "select", "label", "noscript", "legend", "optgroup", "figcaption"})) + ("other",)
TAG_ID = {t: k for k, t in enumerate(TAGS)}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Dom:
    """Block elements of one page in page order; node 0 is the page. runs: pieces of text between block borders."""

    tag: list[str] = field(default_factory=lambda: ["html"])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    mark: list[str | None] = field(default_factory=lambda: [None])
    runs: list[tuple[int, list[str]]] = field(default_factory=list)
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])

    def text(self, run: int) -> str:
        return " ".join("".join(self.runs[run][1]).split())


def parse(page: str) -> Dom:
    """The block tree of a page."""
    dom = Dom()
    stack, opened = [0], Counter()
    at, size = 0, len(page)
    link = 0  # depth of the stack at which a link was opened, 0 if none is open
    fresh = True  # a block border lies before the next text

    def pop_to(k: int) -> None:
        nonlocal link, fresh
        while len(stack) > k:
            opened[dom.tag[stack.pop()]] -= 1
        if link > len(stack):
            link = 0
        fresh = True

    def put(s: str) -> None:
        nonlocal fresh
        node = stack[-1]
        if fresh:
            dom.runs.append((node, [s]))
            fresh = False
        else:
            dom.runs[-1][1].append(s)
        n = len(s) if s.isalnum() else len(s.strip())
        dom.chars[node] += n
        if link:
            dom.linked[node] += n

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            s = page[at:lt]
            s = html.unescape(s) if "&" in s else s
            if not fresh or not s.isspace():
                put(s)
            at = lt
            continue
        m = _TAG.match(page, at)
        if m is None:
            two = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 2)
                at = size if end < 0 else end + 3
            elif two in ("!", "?") or two == "/" and not page[at + 2 : at + 3].isalpha() and page[at + 2 : at + 3]:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            elif two.isascii() and two.isalpha() or two == "/":
                at = size  # cut off inside a tag
            else:
                put("<")
                at += 1
            continue
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag == "a":
            link = 0 if closing else len(stack)
            continue
        if tag in INLINE:
            continue
        if closing:
            if tag in ("html", "body") or not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                t = dom.tag[stack[k]]
                if t == tag:
                    pop_to(k)
                    break
                if t in CELL and tag not in IN_TABLE:
                    break
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at) if not m[3].endswith("/") or tag not in ("svg", "math") else None
            if end:
                gt = page.find(">", end.end())
                at = size if gt < 0 else gt + 1
            elif not m[3].endswith("/"):
                at = size
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in ENDS_P and dom.tag[stack[-1]] == "p":
            pop_to(len(stack) - 1)
        if tag in VOID:
            fresh = fresh or tag == "hr"
            continue
        if tag in ("html", "body", "head"):
            if tag != "body" or opened["body"]:
                continue
        if tag in HEADINGS and dom.tag[stack[-1]] in HEADINGS:
            pop_to(len(stack) - 1)
        if tag in ENDS:
            ended, walls = ENDS[tag]
            if any(opened[t] for t in ended):
                for k in range(len(stack) - 1, 0, -1):
                    t = dom.tag[stack[k]]
                    if t in ended:
                        pop_to(k)
                        break
                    if t in walls:
                        break
        names, mark = (), None
        if m[3]:
            got = []
            for a in _ATTR.finditer(m[3]):
                v = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-main":
                    mark = v
                else:
                    got += [w.lower() for w in _WORDS.findall(v)]
            names = tuple(dict.fromkeys(got))
        dom.tag.append(tag)
        dom.parent.append(stack[-1])
        dom.depth.append(len(stack))
        dom.names.append(names)
        dom.mark.append(mark)
        dom.chars.append(0)
        dom.linked.append(0)
        stack.append(len(dom.tag) - 1)
        opened[tag] += 1
        fresh = True
    return dom


HASHED = 4096
_STEPS = {"own": (1, 15, 40, 100, 250, 700), "all": (1, 40, 150, 500, 1500, 5000), "part": (0.02, 0.1, 0.3, 0.6, 0.9), "link": (0.01, 0.2, 0.5, 0.8), "place": (0.02, 0.1, 0.5, 0.9, 0.98), "depth": (1, 2, 3, 4, 6, 9)}
_BASE: dict[str, int] = {}
_at = HASHED + len(TAGS) + 1
for _name, _edges in [*_STEPS.items(), ("ownlink", _STEPS["link"])]:
    _BASE[_name] = _at
    _at += len(_edges) + 1
_BASE |= {"mark": _at, "stop": _at + 1, "plain": _at + 2, "pars": _at + 3}
FEATURES = _at + 6


@functools.lru_cache(1 << 16)
def _hashed(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % HASHED


@dataclass
class Forest:
    """The trees of several pages: parent (-1 at roots), depth, tag, and features as (rows, columns)."""

    parent: np.ndarray
    depth: np.ndarray
    tag: np.ndarray
    rows: np.ndarray
    cols: np.ndarray

    @functools.cached_property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per depth from 1 on: the nodes in order of their parents, where each parent's begin, and the parents."""
        order = np.lexsort((self.parent, self.depth))
        out = []
        for level in np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)[1:]:
            above = self.parent[level]
            starts = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            out.append((level, starts, above[starts]))
        return out


def _raise(f: Forest, *values: np.ndarray) -> None:
    """Add to every node the sums of its children."""
    for level, starts, above in reversed(f.levels):
        for v in values:
            v[above] += np.add.reduceat(v[level], starts)


def forest(doms: list[Dom]) -> Forest:
    """All features of all blocks."""
    sizes = np.array([len(d.tag) for d in doms])
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())
    flat = lambda name: np.fromiter((x for d in doms for x in getattr(d, name)), np.int64, n)
    parent, depth, own, linked = flat("parent"), flat("depth"), flat("chars"), flat("linked")
    parent = np.where(parent >= 0, parent + start, -1)
    tag = np.fromiter((TAG_ID.get(t, len(TAGS) - 1) for d in doms for t in d.tag), np.int64, n)
    whole, whole_linked = own.astype(float), linked.astype(float)
    out = Forest(parent, depth, tag, np.zeros(0, np.int64), np.zeros(0, np.int64))
    _raise(out, whole, whole_linked)
    page = np.maximum(whole[start], 1)
    before = np.cumsum(own) - own
    place = (before - before[start]) / page
    node = np.arange(n)
    cols = [HASHED + tag]
    values = {"own": own, "all": whole, "part": whole / page, "link": whole_linked / np.maximum(whole, 1), "place": place, "depth": depth, "ownlink": linked / np.maximum(own, 1)}
    for name, v in values.items():
        cols.append(_BASE[name] + np.searchsorted(_STEPS["link" if name == "ownlink" else name], v, side="right"))
    pars = np.bincount(parent[(tag == TAG_ID["p"]) & (parent >= 0)], minlength=n)
    cols.append(_BASE["pars"] + np.minimum(pars, 2))
    rows = [np.tile(node, len(cols))]
    cols = [np.concatenate(cols)]
    extra_r, extra_c = [], []
    for d, s in zip(doms, np.cumsum(sizes) - sizes):
        for k, names in enumerate(d.names):
            if names:
                for w in names:
                    extra_r += (s + k, s + k) if len(w) > 3 else (s + k,)
                    extra_c += (_hashed(w), _hashed(w[:4] + "*")) if len(w) > 3 else (_hashed(w),)
            elif k:
                extra_r.append(s + k)
                extra_c.append(_BASE["plain"])
        seen = -1
        for node_k, parts in d.runs:
            if node_k != seen:
                seen, last = node_k, parts[-1].rstrip()
                if "\N{COPYRIGHT SIGN}" in parts[0]:
                    extra_r.append(s + node_k)
                    extra_c.append(_BASE["mark"])
                if last.endswith((".", "!", "?", "\N{HORIZONTAL ELLIPSIS}", ":")):
                    extra_r.append(s + node_k)
                    extra_c.append(_BASE["stop"])
    rows.append(np.array(extra_r, np.int64))
    cols.append(np.array(extra_c, np.int64))
    out.rows, out.cols = np.concatenate(rows), np.concatenate(cols)
    return out


@dataclass(frozen=True)
class Model:
    """own: weight of each feature for being main text; pair[tag of child, parent's state, child's state]."""

    own: np.ndarray
    pair: np.ndarray


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(a, axis=axis)


def beliefs(f: Forest, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product on all trees at once, level by level: log marginals (node, state), and log pair marginals
    (node, parent's state, state), of no meaning at roots."""
    n = len(f.parent)
    up = np.zeros((n, 2))
    up[:, 1] = np.bincount(f.rows, model.own[f.cols], minlength=n)
    psi = model.pair[f.tag]
    sent = np.zeros((n, 2))
    for level, starts, above in reversed(f.levels):
        sent[level] = _lse(psi[level] + up[level][:, None, :], 2)
        up[above] += np.add.reduceat(sent[level], starts, axis=0)
    full = up.copy()
    pairs = np.zeros((n, 2, 2))
    for level, _, _ in f.levels:
        rest = full[f.parent[level]] - sent[level]
        joint = psi[level] + rest[:, :, None]
        full[level] = up[level] + _lse(joint, 1)
        joint = joint + up[level][:, None, :]
        pairs[level] = joint - _lse(joint.reshape(-1, 4), 1)[:, None, None]
    return full - _lse(full, 1)[:, None], pairs


def labels(dom: Dom) -> np.ndarray:
    """States of a labelled page: a block with text of its own follows its mark; one without, the greater part of the
    text below it."""
    n = len(dom.tag)
    mark = np.zeros(n, np.int64)
    for k in range(1, n):
        mark[k] = int(dom.mark[k]) if dom.mark[k] is not None else mark[dom.parent[k]]
    whole = np.array(dom.chars, float)
    main = whole * mark
    for k in range(n - 1, 0, -1):
        whole[dom.parent[k]] += whole[k]
        main[dom.parent[k]] += main[k]
    return np.where(np.array(dom.chars) > 0, mark, (main * 2 > whole).astype(np.int64))


def fit(pages: list[str], rounds: int = 100, penalty: float = 1.0, rate: float = 0.25) -> Model:
    """Maximum likelihood with a squared penalty, by gradient steps scaled per weight (Adam)."""
    doms = [parse(p) for p in pages]
    f, y = forest(doms), np.concatenate([labels(d) for d in doms])
    child = f.parent >= 0
    size = len(pages)
    seen_own = np.bincount(f.cols, y[f.rows], minlength=FEATURES)
    seen_pair = np.zeros((len(TAGS), 2, 2))
    np.add.at(seen_pair, (f.tag[child], y[f.parent[child]], y[child]), 1.0)
    w = np.zeros(FEATURES + seen_pair.size)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        model = Model(w[:FEATURES], w[FEATURES:].reshape(seen_pair.shape))
        one, two = beliefs(f, model)
        p = np.exp(one[:, 1])
        got_pair = np.zeros_like(seen_pair)
        np.add.at(got_pair, f.tag[child], np.exp(two[child]))
        g = np.concatenate([seen_own - np.bincount(f.cols, p[f.rows], minlength=FEATURES), (seen_pair - got_pair).ravel()]) / size - penalty / size * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(w[:FEATURES].copy(), w[FEATURES:].reshape(seen_pair.shape).copy())


def extract(pages: list[str], model: Model) -> list[str]:
    """Main texts of some pages."""
    if not pages:
        return []
    doms = [parse(p) for p in pages]
    keep = beliefs(forest(doms), model)[0]
    keep = keep[:, 1] >= keep[:, 0]
    out, at = [], 0
    for d in doms:
        out.append(" ".join(t for r in range(len(d.runs)) if keep[at + d.runs[r][0]] and (t := d.text(r))))
        at += len(d.tag)
    return out


BATCH_CHARS = 2 << 20


def main_text(pages: DataFrame, model: Model, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep…, text. Pages are scored a few megabytes at a time."""
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            htmls, texts, held, size = b.column(len(keep)), [], [], 0
            for x in htmls:
                held.append(x.as_py() or "")
                size += len(held[-1])
                if size >= BATCH_CHARS:
                    texts += extract(held, model)
                    held, size = [], 0
            texts += extract(held, model)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "text string"])
    return rows.mapInArrow(run, schema)


# Labelled pages: layouts of many kinds, whose words and lengths say nothing about what is main text.

_ROLES = {
    "nav": "nav navbar menu navigation topnav breadcrumb breadcrumbs links tabs toc pager pagination main-nav sub-menu site-nav skip",
    "header": "header masthead banner top topbar branding logo site-header page-header head",
    "footer": "footer bottom copyright colophon legal site-footer credits foot page-footer",
    "side": "sidebar side aside widget related recommended trending popular right-col left-col rail more-stories tags secondary",
    "ad": "ad ads advert advertisement adsbygoogle sponsor sponsored promo banner-ad ad-slot adbox commercial dfp",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay newsletter subscribe paywall cookie-banner message",
    "form": "form search login signup contact searchbox subscribe-form signin",
    "share": "share social sharing buttons share-bar social-links tools print",
    "comments": "comments comment comment-list reply replies discussion disqus respond reader-comments thread user-comments feedback",
    "main": "content main article post entry story text body article-body post-content entry-content main-content page-content story-body single hentry maincontent prose",
    "neutral": "wrapper container row col page inner outer site box block grid layout section clearfix",
}
ROLES = {k: v.split() for k, v in _ROLES.items()}
_TAGS_OF = {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "ad": ["div", "div", "aside", "ins", "section"], "notice": ["div", "div", "section", "dialog"], "form": ["form"], "share": ["div", "ul"], "comments": ["section", "div", "div", "ol"]}


class _Maker:
    def __init__(self, r: random.Random) -> None:
        self.r = r
        self.bits = ["".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiouéü") for _ in range(r.randint(1, 3))) for _ in range(60)]

    def words(self, n: int) -> str:
        r = self.r
        glue = r.choice([" "] * 12 + [" | ", "*** ", "&amp; ", "\n", " &nbsp;"])
        return glue.join(r.choice(self.bits) for _ in range(n))

    def sentence(self, most: int = 18) -> str:
        return self.words(self.r.randint(1, most)).capitalize() + self.r.choice(["."] * 7 + ["", "?", "!"])

    def prose(self, main: bool = False) -> str:
        """A paragraph of any length; what is not main text is rarely long."""
        r = self.r
        n = r.choice([1, 1, 1, 2, 3, 5, 9, 20]) if main else r.choice([1, 1, 1, 2, 2, 3, 5])
        if r.random() < (0.06 if main else 0.002):
            n = r.choice([40, 80, 160, 320])
        out = []
        for _ in range(n):
            s = self.sentence()
            k = r.random()
            if k < 0.08:
                s = f"<a href='/{r.randint(0, 99)}'>{s}</a>"
            elif k < 0.16:
                s = f"<{r.choice(['b', 'em', 'span', 'strong', 'code'])}>{s}" + r.choice(["", "</b></em></span></strong></code>"])
            out.append(s + ("<br>" if r.random() < 0.06 else ""))
        return " ".join(out)

    def attr(self, role: str, chance: float = 0.9) -> str:
        r = self.r
        if r.random() > chance:
            return ""
        a, b = r.choice(ROLES[role]), r.choice(ROLES[role] + ROLES["neutral"])
        value = r.choice([a, a, f"{a} {b}", f"{b} {a}", f"{a}-{b}", f"{a}_{r.randint(1, 9)}", a + b.capitalize()])
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def links(self, tag: str, attr: str) -> str:
        r = self.r
        items = [f"<a href=/{r.randint(0, 99)}>{self.words(r.choice([1, 1, 1, 2, 6]))}</a>" for _ in range(r.choice([1, 3, 4, 5, 6, 8, 20]))]
        if tag == "ul" or r.random() < 0.6:
            lis = "".join(f"<li>{i}" + ("</li>" if r.random() < 0.8 else "") for i in items)
            return f"<ul{attr}>{lis}</ul>" if tag == "ul" else f"<{tag}{attr}><ul>{lis}</ul></{tag}>"
        return f"<{tag}{attr}>{' | '.join(items)}</{tag}>"

    def block(self, role: str) -> str:
        """Something that is not main text."""
        r = self.r
        tag = r.choice(_TAGS_OF[role])
        attr = self.attr(role, 1.0 if tag in ("div", "ul", "ol", "section", "ins") else 0.4)
        mark = f'{attr} data-main="0"'
        if role in ("nav", "share") or role == "side" and r.random() < 0.4 or role == "footer" and r.random() < 0.2:
            return self.links(tag, mark)
        if role == "form":
            return f"<form{mark}><label>{self.words(2)}</label><input name=q><select><option>{self.words(1)}<option>{self.words(1)}</select><button>{self.words(1)}</button></form>"
        if role == "footer":
            return f"<{tag}{mark}>{r.choice(['&copy; ', '', ''])}{self.sentence(9)}{r.choice(['', ' &middot; ' + self.prose()])}</{tag}>"
        if role == "comments":
            each = [(r.choice(["<p>{}</p>", "{}", "<b>{}</b><p>{}</p>", "<div class=comment-body><p>{}</p></div>"])).replace("{}", self.prose()) for _ in range(r.choice([1, 2, 4, 9]))]
            inner = r.choice(["div", "li", "article", "p", "section"])
            body = "".join(f'<{inner}{self.attr("comments", 1.0 if inner == "article" else 0.6)}>{e}</{inner}>' for e in each)
            return f"<{tag}{mark}>" + r.choice(["", f"<h3>{self.sentence(4)}</h3>"]) + body + f"</{tag}>" + (self.block("form") if r.random() < 0.2 else "")
        if role == "header":
            return f"<{tag}{mark}>" + r.choice([f"<h1>{self.words(2)}</h1>", f"<p>{self.sentence(8)}</p>", f"<div{self.attr('header')}>{self.words(3)}</div>", f"<a href=/>{self.words(2)}</a>"]) + (self.block("nav") if r.random() < 0.5 else "") + f"</{tag}>"
        inner = r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<h4>{}</h4><p>{}</p>", "<p>{}</p><p>{}</p>"]).replace("{}", self.prose())
        return f"<{tag}{mark}>{inner}</{tag}>"

    def article(self) -> str:
        """Blocks of main text, now and then with something else between."""
        r = self.r
        out = [f"<h1>{self.sentence(9)}</h1>"] if r.random() < 0.8 else []
        if out and r.random() < 0.15:
            out = [f"<header{self.attr('header', 0.3)}>{out[0]}</header>"]
        n = r.choice([0, 1, 1, 2, 3, 5, 8, 15]) if r.random() < 0.94 else r.choice([40, 120])
        brief = n > 15 and r.random() < 0.6
        for _ in range(n):
            k = r.random()
            if brief and k < 0.9:
                out.append(f"<p>{self.sentence(r.choice([1, 3, 9]))}</p>")
                continue
            if k < 0.74:
                out.append(f"<p>{self.prose(True)}" + ("</p>" if r.random() < 0.85 else ""))
            elif k < 0.79:
                out.append(f"<{r.choice(['h2', 'h3', 'h4'])}>{self.sentence(6)}</h2></h3></h4>")
            elif k < 0.83:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.prose(True)}</li>" for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif k < 0.86:
                out.append(f"<blockquote><p>{self.prose(True)}</p></blockquote>" if r.random() < 0.5 else f"<blockquote>{self.prose(True)}</blockquote>")
            elif k < 0.88:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(2)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.90:
                out.append(f"<figure><img src=x><figcaption>{self.sentence(9)}</figcaption></figure>")
            elif k < 0.92:
                out.append(f"<pre>{self.words(12)}</pre>")
            elif k < 0.95:
                out.append(f"<div>{self.prose(True)}</div>")
            elif k < 0.965:
                out.append(f"<section><h2>{self.sentence(5)}</h2><p>{self.prose(True)}</p></section>")
            else:
                out.append(self.block(r.choice(["ad", "share", "form", "side", "notice"])))
        if not out:
            out.append(f"<p>{self.prose(True)}</p>")
        if r.random() < 0.06:
            out.append(self.block("comments"))
        return "\n".join(out) if r.random() < 0.3 else "".join(out)

    def page(self) -> str:
        r = self.r
        some = lambda roles, chance: [self.block(x) for x in roles if r.random() < chance]
        before = some(["header", "nav", "notice", "ad", "form"], 0.5)
        after = some(["side", "comments", "share", "notice", "ad", "form", "nav"], 0.3)
        if r.random() < 0.5:
            r.shuffle(before)
            r.shuffle(after)
        if r.random() < 0.8:
            after.append(self.block("footer"))
        body, k = self.article(), r.random()
        if k < 0.40:
            tag = r.choice(["article", "article", "main"])
            body = f'<{tag}{self.attr("main", 0.3)} data-main="1">{body}</{tag}>'
            if tag == "article" and r.random() < 0.3:
                body = f"<main>{body}</main>"
        elif k < 0.78:
            body = f'<{r.choice(["div", "div", "section"])}{self.attr("main", 1.0)} data-main="1">{body}</div></section>'
            if r.random() < 0.3:
                body = f"<div{self.attr('main', 1.0)}>{body}</div>"
        elif k < 0.86:
            side = self.block(r.choice(["nav", "side"]))
            cells = [f"<td>{side}</td>", f'<td{self.attr("main", 0.5)} data-main="1">{body}</td>']
            if r.random() < 0.5:
                cells.reverse()
            body = f"<table><tr>{''.join(cells)}</tr></table>"
        elif 'data-main="0"' in body:
            body = f'<div{self.attr("neutral", 0.5)} data-main="1">{body}</div>'
        else:
            body = re.sub(r"<(h1|h2|h3|h4|p|div|ul|ol|blockquote|table|figure|pre|section)>", r'<\1 data-main="1">', body)
        if r.random() < 0.3:
            body = f"<div{self.attr('neutral')}>{body}{''.join(after[:1])}</div>"
            after = after[1:]
        inner = "".join(before) + body + "".join(after)
        if r.random() < 0.3:
            inner = f"<div{self.attr('neutral')}>{inner}</div>"
        head = f"<head><title>{self.words(3)}</title><style>p{{}}</style><script>var a = '<p>';</script></head>" if r.random() < 0.8 else ""
        out = f"<!DOCTYPE html><html>{head}<body>{inner}</body></html>"
        return out[: int(len(out) * r.uniform(0.5, 1.0))] if r.random() < 0.1 else out


def labelled_pages(count: int = 2000, seed: int = 7) -> list[str]:
    """``count`` labelled pages, the same for the same seed."""
    out = []
    for k in range(count):
        out.append(_Maker(random.Random(seed * 1_000_003 + k)).page())
    return out


@functools.lru_cache(2)
def trained(count: int = 2000, seed: int = 7) -> Model:
    return fit(labelled_pages(count, seed))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), trained()).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op11_main_text": op11_main_text}
