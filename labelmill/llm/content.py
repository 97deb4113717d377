"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a binary variable: does it hold the page's main text?  A log-linear potential on each
element (its tag, what its class and id say, length, links, place) and one on each pair of parent and child make a tree-shaped
Markov field.  Sum-product messages, upward from the leaves and downward from the root, give every element's exact
marginal; the text of the elements that are likelier content than not is the page's text.

The weights maximise the likelihood of labelled pages, that is of (html, text) pairs: an element is content if most of its
characters are in the text's lines.  The likelihood's gradient comes from the same messages.  At most ``FIT_PAGES`` labelled
pages are learned from; the weights are one vector of fixed width, so what is sent to the tasks does not grow with the pages.

Pages are independent: one row in, one row out, nothing is shuffled.  A task holds one batch of pages.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.labelled_pages import labelled_pages

FIT_PAGES = 400
WIDTH = 1 << 11                 # places of the hashed features of an element
STEPS, RATE, RIDGE = 120, 0.2, 0.3
_BATCH_NODES = 50_000           # elements whose messages are passed together

# HTML's element kinds.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("button canvas head iframe math noframes noscript object script select style svg template textarea title".split())
RAW = frozenset("iframe noframes noscript script style textarea title".split())
CLOSES_P = BLOCKS - frozenset("body html caption li dd dt legend option optgroup summary tbody td tfoot th thead tr".split())
# An element of the first kind ends an open one of the second kinds, up to the nearest of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# What the words of a class, id or role say.
SAYS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar skip",
    "head": "header masthead topbar top branding logo banner",
    "foot": "footer bottom copyright colophon legal imprint",
    "side": "sidebar side aside rail widget widgets complementary secondary",
    "advert": "ad ads adv advert adverts advertisement adbox adslot banner sponsor sponsored promo promotion promoted commercial dfp",
    "notice": "cookie cookies consent gdpr notice alert warning popup modal overlay message disclaimer notification",
    "form": "form search login signup signin register subscribe subscription newsletter contact input",
    "talk": "comment comments commentlist reply replies respond discussion disqus responses reader readers feedback",
    "share": "share sharing social follow like buttons tags tag related more recommended popular trending links meta",
    "text": "article content post entry story text body main page blog news paragraph",
}
_SAYS = {word: kind for kind, words in SAYS.items() for word in words.split()}
_KIND = {t: k for k, ts in {
    "head": "h1 h2 h3 h4 h5 h6 hgroup", "para": "p pre blockquote", "item": "li dd dt", "list": "ul ol dl menu dir",
    "cell": "td th tr tbody thead tfoot table caption", "main": "article main", "edge": "nav header footer aside form",
}.items() for t in ts.split()}
KINDS = ["box", "head", "para", "item", "list", "cell", "main", "edge", "text"]
EDGES = len(KINDS) ** 2

_TAG = re.compile(
    r"<(?:!--(?:.*?-->|.*)|!\[CDATA\[|[!?][^>]*>?|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<end2>/)?(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*)>?)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """The block elements of a page in page order, the root first, and their texts.

    ``parent`` and ``tag`` of each; ``says``: what class, id and role say; ``text`` of those that hold one block of text.
    A block of text beside block elements is an element of its own, tagged ``#``.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.says, self.text, self.linked = ["html"], [-1], [()], [""], [0]
        self._read(html)

    def _add(self, tag: str, parent: int, says: tuple = ()) -> int:
        for values, value in ((self.tag, tag), (self.parent, parent), (self.says, says), (self.text, ""), (self.linked, 0)):
            values.append(value)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        open_, unread, at, link = [0], [], 0, False
        parts: list[str] = []
        linked = 0
        blocks: list[tuple[int, str, int]] = []

        def end_block():
            nonlocal linked
            text = " ".join("".join(parts).split())
            if text:
                blocks.append((open_[-1], text, min(linked, len(text))))
                # The block's place among the elements, before its owner's further children.
                self._mark(len(blocks) - 1, open_[-1])
            parts.clear()
            linked = 0

        self._pending: list[tuple[int, int]] = []
        found = _TAG.search(html)
        while True:
            text = html[at:found.start()] if found else html[at:]
            if text and not unread:
                text = entities.unescape(text) if "&" in text else text
                parts.append(text)
                linked += len(text.strip()) if link else 0
            if not found:
                break
            at = found.end()
            name = (found["name"] or found["name2"] or "").lower()
            closing = found["end"] or found["end2"]
            if not name:
                found = _TAG.search(html, at)
                continue
            if unread:
                if closing and name == unread[-1]:
                    unread.pop()
                elif not closing and name == unread[-1] and name not in VOID:
                    unread.append(name)
            elif name in UNREAD and not closing:
                rest = found["rest"] or found["rest2"] or ""
                if name in RAW:
                    close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
                    at = close.end() if close else len(html)
                elif not rest.rstrip().endswith("/"):
                    unread.append(name)
                parts.append(" ")
            elif name == "a":
                link = not closing
            elif name == "br":
                parts.append(" ")
            elif name in BLOCKS or "-" in name:
                end_block()
                link = False
                if closing:
                    self._close(open_, name)
                elif name not in ("html", "body") or (name == "body" and "body" not in self.tag):
                    self._imply(open_, name)
                    node = self._add(name, open_[-1], self._said(found["rest"] or found["rest2"] or ""))
                    if name not in VOID:
                        open_.append(node)
            found = _TAG.search(html, at)
        end_block()
        self._place(blocks)

    @staticmethod
    def _said(rest: str) -> tuple:
        out = set()
        if rest:
            for name, value in _ATTRIBUTE.findall(rest):
                name = name.lower()
                value = value.strip("\"'")
                if name in ("class", "id", "role"):
                    out.update(_SAYS[w.lower()] for w in _WORDS.findall(value) if w.lower() in _SAYS)
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                        name == "style" and re.search(r"display\s*:\s*none", value)):
                    out.add("hidden")
        return tuple(sorted(out))

    def _close(self, open_: list[int], name: str) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if self.tag[open_[i]] == name:
                del open_[i:]
                return
            if self.tag[open_[i]] in ("table", "td", "th") and name in ("p", "li", "div"):
                return

    def _imply(self, open_: list[int], name: str) -> None:
        if name in CLOSES_P and self.tag[open_[-1]] == "p":
            open_.pop()
        ends, up_to = IMPLIED.get(name, ((), ()))
        for i in range(len(open_) - 1, 0, -1):
            tag = self.tag[open_[i]]
            if tag in up_to:
                return
            if tag in ends:
                rest = [t for t in (self.tag[j] for j in open_[1:i]) if t in ends and name in ("tr", "tbody", "tfoot")]
                del open_[i:]
                if not rest:
                    return

    def _mark(self, block: int, owner: int) -> None:
        self._pending.append((block, len(self.tag)))

    def _place(self, blocks: list[tuple[int, str, int]]) -> None:
        """Give each block of text to its element, or to a text element of its own where that has other children."""
        owners = Counter(owner for owner, _, _ in blocks)
        parents = set(self.parent)
        order = [float(i) for i in range(len(self.tag))]
        for (block, before), (owner, text, linked) in zip(self._pending, blocks):
            if owners[owner] > 1 or owner in parents or owner == 0:
                node = self._add("#", owner)
                order.append(before - 0.5 + block * 1e-9)
            else:
                node = owner
            self.text[node], self.linked[node] = text, linked
        # Elements in page order, parents before children.
        rank = sorted(range(len(order)), key=order.__getitem__)
        new = {old: i for i, old in enumerate(rank)}
        self.tag, self.says, self.text, self.linked = ([v[i] for i in rank] for v in (self.tag, self.says, self.text, self.linked))
        self.parent = [new.get(self.parent[i], -1) for i in rank]


class Field:
    """The elements of several pages as arrays: parents, edge kinds, hashed features, and the layers of equal depth."""

    def __init__(self, pages: list[Page]):
        parent, edge, features, sizes = [], [], [], []
        for page in pages:
            first = len(parent)
            parent += [first + p if p >= 0 else -1 for p in page.parent]
            for f, e in _features(page):
                features += f
                sizes.append(len(f))
                edge.append(e)
        self.n = len(parent)
        self.parent, self.edge = np.array(parent, np.int64), np.array(edge, np.int64)
        self.feature, self.owner = np.array(features, np.int64), np.repeat(np.arange(self.n), sizes)
        depth = np.zeros(self.n, np.int64)
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        self.layers = [order[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def marginals(self, weights: np.ndarray, bonds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """([element, state] probabilities, [element, parent's state, own state] probabilities, zero for roots)."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.owner, weights[self.feature], self.n)
        up = own.copy()                          # own potential and all messages from children
        message = np.zeros((self.n, 2))          # from an element to its parent
        for layer in reversed(self.layers[1:]):
            message[layer] = _log_sum(bonds[self.edge[layer]] + up[layer][:, None, :], 2)
            np.add.at(up, self.parent[layer], message[layer])
        belief = up.copy()
        pair = np.zeros((self.n, 2, 2))
        for layer in self.layers[1:]:
            down = belief[self.parent[layer]] - message[layer]
            joint = down[:, :, None] + bonds[self.edge[layer]] + up[layer][:, None, :]
            joint -= _log_sum(joint.reshape(-1, 4), 1)[:, None, None]
            pair[layer] = np.exp(joint)
            belief[layer] = _log_sum(joint, 1)
        belief -= _log_sum(belief, 1)[:, None]
        return np.exp(belief), pair


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _place(name: str) -> int:
    return zlib.crc32(name.encode()) % WIDTH


_PLACES: dict[str, int] = {}


def _features(page: Page) -> Iterator[tuple[list[int], int]]:
    """Per element the places of its features, and the kind of its edge to its parent."""
    n = len(page.tag)
    chars, linked, leaves = [len(t) for t in page.text], list(page.linked), [int(bool(t)) for t in page.text]
    before = np.cumsum([0, *chars])[:-1]
    whole = sum(chars) or 1
    longest = max(chars, default=0) or 1
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        leaves[p] += leaves[i]
    inside: list[frozenset] = []
    kinds = []
    for i in range(n):
        tag, p, text = page.tag[i], page.parent[i], page.text[i]
        kind = "text" if tag == "#" else _KIND.get(tag, "box")
        kinds.append(KINDS.index(kind))
        here = frozenset(page.says[i]) | ({tag} if _KIND.get(tag) in ("edge", "main") else frozenset())
        above = inside[p] if p >= 0 else frozenset()
        inside.append(above | here)
        links = linked[i] * 4 // max(chars[i], 1)
        size = chars[i].bit_length()
        names = ["bias", f"tag {tag}", f"links {links}", f"size {size}", f"{kind} links {links}", f"{kind} size {min(size, 9) // 2}",
                 f"share {chars[i] * 8 // whole}", f"at {before[i] * 4 // whole}", f"leaves {min(leaves[i], 16).bit_length()}"]
        names += [f"says {s}" for s in page.says[i]] or ["says nothing"]
        names += [f"in {s}" for s in above]
        if p >= 0:
            names.append(f"under {page.tag[p]}")
        if text:
            names += [f"long {chars[i] * 4 // longest}", f"stop {text[-1] in '.!?…:;'}", f"sign {text[0] in '©®' or '©' in text}"]
        for name in names:
            if name not in _PLACES:
                _PLACES[name] = _place(name)
        yield [_PLACES[x] for x in names], (kinds[p] * len(KINDS) if p >= 0 else 0) + kinds[i]


def content_labels(page: Page, text: str) -> np.ndarray:
    """1 for every element most of whose characters are in lines of ``text`` (each line is used as often as it is there)."""
    left = Counter(" ".join(line.split()) for line in text.split("\n"))
    good, all_ = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for i, t in enumerate(page.text):
        all_[i] = len(t)
        if t and left[t] > 0:
            left[t] -= 1
            good[i] = len(t)
    for i in range(len(page.tag) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        all_[page.parent[i]] += all_[i]
    return (2 * good > all_).astype(np.int64)


class Model:
    """Weights of the elements' features and of the parent-child pairs."""

    def __init__(self, weights: np.ndarray, bonds: np.ndarray):
        self.weights, self.bonds = weights, bonds

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Per page the content marginal of each element."""
        if not pages:
            return []
        p = Field(pages).marginals(self.weights, self.bonds)[0][:, 1]
        return np.split(p, np.cumsum([len(page.tag) for page in pages])[:-1])


def fit_pages(pairs: list[tuple[str, str]], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Maximum likelihood with a ridge penalty: gradient steps scaled by a running mean of squares."""
    pages = [Page(h) for h, _ in pairs]
    field = Field(pages)
    y = np.concatenate([content_labels(p, t) for p, (_, t) in zip(pages, pairs)]) if pages else np.zeros(0, np.int64)
    weights, bonds = np.zeros(WIDTH), np.zeros((EDGES, 2, 2))
    seen = np.bincount(field.feature, y[field.owner], WIDTH)
    child = np.flatnonzero(field.parent >= 0)
    seen_pairs = np.zeros((EDGES, 2, 2))
    np.add.at(seen_pairs, (field.edge[child], y[field.parent[child]], y[child]), 1.0)
    first, second = [np.zeros(WIDTH), np.zeros_like(bonds)], [np.zeros(WIDTH), np.zeros_like(bonds)]
    for step in range(1, steps + 1):
        p, pair = field.marginals(weights, bonds)
        expected = np.bincount(field.feature, p[field.owner, 1], WIDTH)
        expected_pairs = np.zeros_like(bonds)
        np.add.at(expected_pairs, field.edge[child], pair[child])
        for k, (x, g) in enumerate(((weights, seen - expected - ridge * weights), (bonds, seen_pairs - expected_pairs - ridge * bonds))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            x += rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8) / (1 + 3 * step / steps)
    return Model(weights, bonds)


def fit(labelled: DataFrame, html: str = "html", text: str = "text", max_pages: int = FIT_PAGES) -> Model:
    """Learn from labelled pages: their html and main text.  At most ``max_pages`` of them, chosen by a hash of the html, reach
    the driver; rows with a null in either column are ignored."""
    rows = labelled.where(F.col(html).isNotNull() & F.col(text).isNotNull()).select(F.col(html).alias("h"), F.col(text).alias("t"))
    chosen = rows.orderBy(F.xxhash64("h"), "h", "t").limit(max_pages).collect()
    return fit_pages([(r["h"], r["t"]) for r in chosen])


def main_text(html: Column, model: Model, least: float = 0.5) -> Column:
    """The text of the elements whose content marginal is at least ``least``: each block's white space turned into one blank
    and trimmed, blocks in page order joined by a line feed.  Null and empty pages, and pages without content, give an empty text."""
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            out, held, n = [], [], 0
            for source in pages:
                page = Page(source or "")
                if held and n + len(page.tag) > _BATCH_NODES:
                    out += _texts(held, model, least)
                    held, n = [], 0
                held.append(page)
                n += len(page.tag)
            yield pd.Series(out + _texts(held, model, least), dtype=object)

    return extract(html)


def _texts(pages: list[Page], model: Model, least: float) -> list[str]:
    return ["\n".join(t for t, p in zip(page.text, content) if t and p >= least)
            for page, content in zip(pages, model.content(pages))]


def extract_main_text(pages: DataFrame, output: str, model: Model, html: str = "html", least: float = 0.5) -> DataFrame:
    """``pages`` with the main text of each page in the column ``output``; all rows and other columns are kept."""
    return pages.withColumn(output, main_text(F.col(html), model, least))


def default_model(spark: SparkSession) -> Model:
    """Learned from this package's hand-written labelled pages."""
    return fit(spark.createDataFrame(labelled_pages(), "html string, text string"))


def digest(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = extract_main_text(pages.select("page_id", "url", "html"), "text", default_model(pages.sparkSession))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
