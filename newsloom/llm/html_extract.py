"""HTML extraction: gradient-boosted trees over DOM elements with hierarchical decoding.

Each block element of a page gets features: its own and its subtree's text and link density, groups
of tags and attribute words (its own and its ancestors'), depth, place, and sibling statistics.
Boosted trees, trained here on generated pages with known roles (PAGES of them, one seed), give the
probability that an element belongs to the main text. Decoding takes the most probable labelling in
which a dropped element drops all below it, so that no choice contradicts an ancestor's; the blocks
of text in kept elements are the page's text.

Defined results: null, empty and textless pages give an empty text; a page of text
alone is all main text; broken markup is read as a
browser would roughly read it; nothing is capped; repeated rows are extracted one by one; columns of
the input that clash with output columns are replaced. A line break element is white space.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from newsloom.llm.common import arrow_map, table
from newsloom.llm.dom import attributes, parse

PAGES, SEED, TREES, DEPTH, RATE, BINS = 800, 11, 100, 4, 0.25, 32

# Words of attributes by what they name.
WORD_GROUPS = [
    "article content main post entry story body text prose",
    "nav navigation menu navbar breadcrumb breadcrumbs tabs pagination pager",
    "footer foot copyright legal colophon",
    "header masthead banner topbar logo branding",
    "sidebar side aside widget rail",
    "comment comments reply replies discussion disqus respond",
    "ad ads advert advertisement sponsor sponsored promo promotion adslot",
    "cookie cookies consent notice alert modal popup overlay gdpr warning",
    "share sharing social follow",
    "related recommended recommendations more popular trending teaser",
    "form search subscribe newsletter signup login input",
    "meta byline author date tags category",
]
_GROUP = {w: i for i, g in enumerate(WORD_GROUPS) for w in g.split()}
TAG_GROUPS = ["p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "div", "article main", "section", "nav menu", "aside", "header hgroup", "footer", "form fieldset legend label button select option optgroup textarea",
              "table thead tbody tfoot tr td th caption", "ul ol dl", "blockquote pre figure figcaption address", "#text", "head title script style noscript template svg iframe", "dialog details summary", "html body #root"]
_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_ABOVE = [i for i, g in enumerate(TAG_GROUPS) if g.split()[0] in ("article", "section", "nav", "aside", "header", "footer", "form", "ul", "dialog", "blockquote")]
_WORDS = re.compile("[a-z]+")


def _groups(raw: str) -> tuple[int, ...]:
    return _known_groups(raw) if len(raw) <= 300 else _known_groups.__wrapped__(raw)


@lru_cache(maxsize=20_000)
def _known_groups(raw: str) -> tuple[int, ...]:
    a = attributes(raw)
    text = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label")))
    return tuple(sorted({_GROUP[w] for w in _WORDS.findall(text.lower()) if w in _GROUP}))


N_TAGS, N_WORDS, N_ABOVE = len(TAG_GROUPS), len(WORD_GROUPS), len(_ABOVE)
N_FEATURES = 16 + N_TAGS + 2 * N_WORDS + N_ABOVE


def page_features(nodes, texts) -> np.ndarray:
    n = len(nodes)
    up = [x.up for x in nodes]
    own, below, links, marks, blocks, size = [0] * n, [0] * n, [x.links for x in nodes], [0] * n, [0] * n, [1] * n
    for k, t in texts:
        own[k] += len(t)
        below[k] += len(t)
        marks[k] += t.count(".") + t.count(",")
        blocks[k] += 1
    for k in range(n - 1, 0, -1):
        u = up[k]
        below[u] += below[k]
        links[u] += links[k]
        marks[u] += marks[k]
        blocks[u] += blocks[k]
        size[u] += size[k]
    whole, place = max(below[0], 1), [0] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[up[k]].append(k)
    seen = 0
    for k in range(n):
        place[k] = seen
        seen += own[k]
    x = np.zeros((n, N_FEATURES), np.float32)
    above_words: list[tuple[int, ...]] = [()] * n
    above_tags: list[tuple[int, ...]] = [()] * n
    for k in range(n):
        node, u = nodes[k], up[k]
        g, tag = _groups(node.attrs) if node.attrs else (), _TAG.get(node.tag, 4)
        if u >= 0:
            pw, pt = _groups(nodes[u].attrs) if nodes[u].attrs else (), _TAG.get(nodes[u].tag, 4)
            above_words[k] = tuple({*above_words[u], *pw}) if pw else above_words[u]
            above_tags[k] = (*above_tags[u], pt) if pt in _ABOVE and pt not in above_tags[u] else above_tags[u]
        mates = children[u] if u >= 0 else [k]
        b = below[k]
        row = x[k]
        row[:16] = (
            math.log1p(own[k]), math.log1p(b), math.log1p(b / size[k]), links[k] / max(b, 1), 20 * marks[k] / max(b, 20), math.log1p(blocks[k]), b / whole,
            b / max(below[u], 1) if u >= 0 else 1.0, node.depth, len(mates), place[k] / whole, 0, 0, math.log1p(size[k]), math.log1p(b / max(blocks[k], 1)), math.log1p(len(children[k])))
        row[16 + tag] = 1
        for i in g:
            row[16 + N_TAGS + i] = 1
        for i in above_words[k]:
            row[16 + N_TAGS + N_WORDS + i] = 1
        for i in above_tags[k]:
            row[16 + N_TAGS + 2 * N_WORDS + _ABOVE.index(i)] = 1
    for mates in children:
        for i, k in enumerate(mates):
            x[k, 11] = math.log1p(below[mates[i - 1]]) if i else -1
            x[k, 12] = math.log1p(below[mates[i + 1]]) if i + 1 < len(mates) else -1
    return x


class Boosted:
    """Gradient-boosted trees for a yes-or-no label: depth-wise, on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rate = (y.sum() + 1) / (len(y) + 2)
        self.start = math.log(rate / (1 - rate))
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        n_features, z = x.shape[1], np.full(len(y), self.start)
        flat = bins + np.arange(n_features) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                where = ((at - first)[:, None] * (n_features * BINS) + flat).ravel()
                hg = np.bincount(where, np.repeat(g, n_features), width * n_features * BINS).reshape(width, n_features, BINS)
                hh = np.bincount(where, np.repeat(h, n_features), width * n_features * BINS).reshape(width, n_features, BINS)
                lg, lh = hg.cumsum(2), hh.cumsum(2)
                tg, th = lg[:, :1, -1:], lh[:, :1, -1:]
                gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                gain[(lh < 1) | (th - lh < 1)] = 0
                for k in range(width):
                    j, b = divmod(int(gain[k].argmax()), BINS)
                    if gain[k, j, b] > 1e-3 and b < len(self.cuts[j]):
                        feature[first + k], cut[first + k] = j, self.cuts[j][b]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**DEPTH - 1)
            value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((feature, cut, value))
            z += value[leaf]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            z += value[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def decoded(up: list[int], p: np.ndarray) -> list[bool]:
    """The most probable labels among those in which a dropped element drops all below it."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    drop, keep = np.log(1 - p).tolist(), np.log(p).tolist()
    for k in range(len(up) - 1, 0, -1):
        keep[up[k]] += max(keep[k], drop[k])
        drop[up[k]] += drop[k]
    kept = [keep[0] >= drop[0]]
    for k in range(1, len(up)):
        kept.append(kept[up[k]] and keep[k] >= drop[k])
    return kept


# ---- generated training pages --------------------------------------------------------------

def _made_page(r: random.Random) -> tuple[str, set[str]]:
    """A page and its main blocks' markers; every text block ends with a marker of its own."""
    main: set[str] = set()
    count = [0]

    def say(words: int, keep: bool) -> str:
        count[0] += 1
        mark = f"m{count[0]}x"
        if keep:
            main.add(mark)
        out, left = [], words
        while left > 0:
            k = min(left, r.randint(1, 18))
            s = " ".join("".join(r.choice("bcdfghklmnprstvw") * r.randint(0, 1) + r.choice("aeiouéü") for _ in range(r.choice((1, 1, 2, 2, 3, 4)))) + r.choice(("", "", "s", "n")) for _ in range(k))
            out.append(s.capitalize() + r.choice((".", ".", ",", "")))
            left -= k
        return " ".join(out) + f" {mark}"

    def tag(name: str, inner: str, *words: str, close: bool = True) -> str:
        attr = r.choice(("class", "class", "id")) if words else ""
        style = r.choice(words) if words else ""
        if not words and r.random() < 0.15:  # a name that tells nothing
            attr, style = "class", r.choice(("css-", "c", "td_", "x-", "wp-", "u-")) + str(r.randint(1, 99))
        return f"<{name}" + (f' {attr}="{style}"' if style else "") + f">{inner}" + (f"</{name}>" if close else "")

    def links(n: int) -> str:
        items = [tag("li", f'<a href="/{k}">{say(r.randint(1, 4), False)}</a>') for k in range(n)]
        return tag(r.choice(("ul", "ul", "ol")), "".join(items))

    def side() -> str:
        kind = r.randrange(12)
        some = r.randint(1, 40)
        if kind == 0:
            return tag(r.choice(("nav", "nav", "div")), links(r.randint(3, 9)), "nav", "menu", "main-menu", "navbar")
        if kind == 1:
            return tag(r.choice(("aside", "div")), tag("h3", say(3, False)) + r.choice((links(4), tag("p", say(some, False)))), "sidebar", "side-widget", "rail")
        if kind == 2:
            return tag("div", r.choice((say(some, False), tag("p", say(some, False)))), "ad", "ads", "advert", "sponsored", "promo-box")
        if kind == 3:
            return tag("div", r.choice((say(some, False), tag("p", say(some, False)) + "<button>" + say(1, False) + "</button>")), "cookie-notice", "consent", "cookie", "notice", "alert")
        if kind == 4:
            return tag("form", "<label>" + say(2, False) + "</label><input name=q><button>" + say(1, False) + "</button>" + tag("p", say(some, False)), "search", "newsletter", "subscribe", "")
        if kind == 5:
            return tag("div", tag("h3", say(3, False)) + links(r.randint(2, 6)), "related", "recommended", "popular", "more")
        if kind == 6:
            return tag("div", links(3), "share", "social", "share-links")
        if kind == 7:
            return comments()
        if kind == 8:
            return tag("header", tag("div", say(3, False), "logo", "") + r.choice(("", tag("p", say(8, False)))), "masthead", "header", "")
        if kind == 9:
            return tag("aside", r.choice((say(some, False), tag("p", say(some, False)))))
        if kind == 10:
            return tag(r.choice(("section", "div")), tag("p", say(some, False)), "newsletter", "subscribe", "signup")
        return tag("div", say(r.randint(2, 8), False), "breadcrumbs", "topbar", "pagination")

    def comments() -> str:
        each = [tag(r.choice(("div", "li", "article")), tag("p", say(r.randint(2, 50), False)), "comment", "comment-body", "reply") for _ in range(r.randint(1, 5))]
        return tag(r.choice(("section", "div", "ol")), tag("h3", say(2, False)) * r.randint(0, 1) + "".join(each), "comments", "comment-list", "discussion", "replies")

    def paragraph() -> str:
        words = r.choice((1, 2, r.randint(3, 15), r.randint(10, 80), r.randint(30, 250)))
        kind = r.randrange(14)
        text = say(words, True)
        if kind < 7:
            return tag("p", text)
        if kind == 7:
            return r.choice((f"<p><b>{text}<br>", f"<p>{text}", f"<p><strong>{say(2, True)}</strong> {text}<br><br>", f"<p><span>{text}</span>"))
        if kind == 8:
            return tag(f"h{r.randint(2, 4)}", say(r.randint(1, 7), True)) + tag("p", text)
        if kind == 9:
            return tag("ul", "".join(tag("li", say(r.randint(1, 20), True), close=r.random() < 0.7) for _ in range(r.randint(1, 5)))) + tag("p", text)
        if kind == 10:
            return tag("blockquote", r.choice((text, tag("p", text))))
        if kind == 11:
            return tag("p", f'{text} <a href="/x">{say(2, True)}</a> <em>{say(1, True)}</em>')
        if kind == 12:
            return r.choice((tag("div", text), tag("pre", text), tag("figure", tag("figcaption", text)), tag("table", tag("tr", tag("td", text) + tag("td", say(2, True))))))
        return text + tag("p", say(3, True))

    body = [paragraph() for _ in range(r.choice((0, 1, 1, 2, 3, r.randint(3, 9), r.randint(5, 20))))]
    for _ in range(r.choice((0, 0, 0, 1, 2))):
        body.insert(r.randint(0, len(body)), side())
    if r.random() < 0.15:
        body.append(comments())
    title = tag("h1", say(r.randint(2, 14), True)) if r.random() < 0.85 or not body else ""
    inner = title + "".join(body)
    kind = r.randrange(10)
    if kind < 6:
        core = tag("article", inner) if r.random() < 0.7 else tag("article", inner, "post", "story", "entry")
    elif kind == 6:
        core = tag("main", inner)
    elif kind == 7:
        core = tag("div", inner, "content", "article-body", "post", "entry-content", "main-content")
    elif kind == 8:
        core = tag("main", tag("article", inner))
    else:
        core = tag("div", tag("section", inner, "story", "text", "article"), "main", "page", "wrap")
    if r.random() < 0.2:  # no element says that this is the article
        core = r.choice((inner, tag("div", inner), tag("div", tag("div", inner)), tag("section", inner), tag("table", tag("tr", tag("td", inner)))))
    if r.random() < 0.08:  # a page of text alone, or of text with a little about it
        some = [say(r.choice((1, 3, 8, 30, 120)), True) for _ in range(r.choice((1, 1, 2, 4)))]
        bare = r.choice(("".join(f"<p>{x}</p>" for x in some), "<br>".join(some), some[0], "".join(f"<div>{x}</div>" for x in some), tag("div", "".join(f"<p>{x}</p>" for x in some))))
        return r.choice((bare, f"<body>{bare}</body>", f"<html><head><title>{say(3, False)}</title></head><body>{bare}</body></html>", f"<body>{bare}{tag('footer', say(4, False))}</body>")), main
    around = [side() for _ in range(r.choice((1, 1, 2, 3, 5)))]
    cut = r.randint(0, len(around))
    top = tag("nav", links(r.randint(3, 8))) if r.random() < 0.8 else ""
    foot = tag("footer", say(r.randint(3, 30), False) + r.choice(("", links(3)))) if r.random() < 0.85 else tag("div", say(12, False), "footer", "copyright")
    middle = "".join(around[:cut]) + core + "".join(around[cut:])
    if r.random() < 0.25:
        middle = tag("div", middle, "wrapper", "page", "container")
    return f"<html><head><title>{say(4, False)}</title><style>p{{}}</style></head><body>{top}{middle}{foot}" + r.choice(("</body></html>", "")), main


_MARK = re.compile(r"\bm\d+x\b")


def labelled(page: str, main: set[str]):
    """Features and labels of a generated page's elements: kept if main text stands in or below them."""
    nodes, texts = parse(page)
    keep = [False] * len(nodes)
    for k, t in texts:
        if any(m in main for m in _MARK.findall(t)):
            keep[k] = True
    for k in range(len(nodes) - 1, 0, -1):
        keep[nodes[k].up] |= keep[k]
    return nodes, texts, page_features(nodes, texts), np.array(keep, float)


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Boosted:
    r = random.Random(seed)
    made = [labelled(*_made_page(r))[2:] for _ in range(pages)]
    return Boosted(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]))


def extracted(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of every page."""
    read = [parse(p) for p in pages]
    x = [page_features(*r) for r in read]
    p = model.probability(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for nodes, texts in read:
        kept = decoded([n.up for n in nodes], p[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for k, t in texts if kept[k]))
    return out


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The carried columns with text and n_chars."""
    carry = [c for c in (pages.columns if carry is None else carry) if c.lower() not in ("text", "n_chars")]
    used = pages.select(*dict.fromkeys([*carry, html]))
    schema = T.StructType([used.schema[c] for c in carry] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = extracted(b.column(html).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carry], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return arrow_map(used, run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
