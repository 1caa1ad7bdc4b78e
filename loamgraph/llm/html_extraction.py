"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

1. Parsing.  One pass over the tags, linear in the page whatever is in it, builds the tree: void elements have no children, script and
   style hold raw text, comments and declarations go, paragraphs, list items, table cells and options
   end where the next begins, a stray end tag is ignored, what is open at the end is closed there.
2. Features of each element: kind of tag, depth, length and density of its subtree's text, share of text
   in links, punctuation, children, place among its siblings and their mean text, and
   its class, id and role tokens hashed to TOKENS indicator columns.
3. Training.  The labels come from pages that use article or main: nodes inside are content, nodes
   outside are not (nodes around it have none).  The trees see neither these two tags nor which
   of the tags nav, header, footer and aside are around a node, so they learn shape and tokens.
   At most TRAIN_PAGES pages (those with the smallest hash of the url and html) are used.
4. Decoding.  A node's log-odds are weighted by its own text.  From the leaves up, a subtree is taken as
   a whole or left to its children, whichever is worth more; so no node is taken inside one that is
   left out as a whole, nor left out inside one that is taken.

Text of taken subtrees comes out in order, a line for each block, entities resolved.  Null and
empty pages, and pages without text, give an empty text and no node.  Without any page to learn from every
node counts as content.  Whole pages are read; rows that repeat give equal rows; an empty table
gives an empty result; columns besides page_id and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm._spark import named

TRAIN_PAGES = 400
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
TOKENS = 64
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template svg math iframe object textarea select".split())
_RAW_END = {t: re.compile(f"</{t}\\s*>", re.I) for t in _RAW}
_HIDDEN = frozenset(["head", "title"])
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"li", "dd", "dt"}
#: A new one of the first ends an open one of the second, up to the nearest of the third.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset(["html", "body", "table", "td", "th", "button"])
#: Tags that the trees may know; the rest share one number.
_KINDS = {t: i + 1 for i, t in enumerate("a b i em strong span br p div ul ol li h1 h2 h3 h4 h5 h6 table tr td th pre code blockquote figure img form input button section body html".split())}
_TRUE = frozenset(["article", "main"])
COLUMNS = 16 + TOKENS


@dataclass
class Tree:
    """Elements in document order, so that a subtree is the range from an element to its end; texts are
    (element, text) in order."""

    tag: list[str]
    parent: list[int]
    depth: list[int]
    end: list[int]
    attributes: list[str]
    text_of: list[int]
    texts: list[str]


class Tags:
    """Ends of tags.  A tag ends at the first ">" outside quotes; a quote without a partner is a letter like any
    other, and a "<" whose tag never ends is text.  Every place is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.dead: set[int] = set()  # quotes from which no end is reached
        self.near = (0, -1)  # a range without special letters, but for its end

    def special(self, at: int) -> int:
        if not self.near[0] <= at <= self.near[1]:
            m = _SPECIAL.search(self.page, at)
            self.near = (at, m.start() if m else len(self.page))
        return self.near[1]

    def end(self, at: int) -> int:
        page, seen = self.page, []
        while at <= self.last[">"]:
            i = self.special(at)
            if i >= len(page):
                break
            if page[i] == ">":
                return i
            if i in self.dead:
                break
            seen.append(i)
            at = i + 1 if i >= self.last[page[i]] else page.find(page[i], i + 1) + 1
        self.dead.update(seen)
        return -1


class Open:
    """The open elements, and where in the stack each name is."""

    def __init__(self):
        self.node, self.name = [0], ["#root"]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, name: str) -> None:
        self.where.setdefault(name, []).append(len(self.name))
        if name in _BLOCK:
            self.blocks.append(len(self.name))
        self.node.append(node)
        self.name.append(name)

    def last(self, names) -> int:
        """Place of the innermost of the names, 0 for none."""
        return max((self.where[x][-1] for x in names if self.where.get(x)), default=0)

    def close_to(self, place: int, end: list[int], now: int) -> None:
        while len(self.name) > place:
            name = self.name.pop()
            self.where[name].pop()
            if name in _BLOCK:
                self.blocks.pop()
            end[self.node.pop()] = now


def parse(page: str) -> Tree:
    tag, parent, depth, end, attributes, at_node, texts = ["#root"], [-1], [0], [0], [""], [], []
    stack, tags = Open(), Tags(page)
    position, size = 0, len(page)

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            at_node.append(stack.node[-1])
            texts.append(piece)

    begin = 0  # of the text not yet given out
    while True:
        at = page.find("<", position)
        if at < 0:
            text(page[begin:])
            break
        m = None
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            stop = stop + 3 if stop >= 0 else size
        elif page.startswith("<![CDATA[", at):
            stop = page.find("]]>", at)
            stop = stop + 3 if stop >= 0 else size
        elif page[at + 1 : at + 2] in ("!", "?"):
            stop = page.find(">", at) + 1 if tags.last[">"] > at else 0
        elif m := _OPEN.match(page, at):
            stop = tags.end(m.end()) + 1
        else:
            stop = 0
        if not stop:
            position = at + 1
            continue
        text(page[begin:at])
        begin = position = stop
        if m is None:
            continue
        name, now = m.group(2).lower(), len(tag)
        if m.group(1):
            place = stack.last((name,))
            if place and (name in _BLOCK or not stack.blocks or place > stack.blocks[-1]):
                stack.close_to(place, end, now)
            continue
        if name in _CLOSES_P:
            place = stack.last(("p",))
            if place > stack.last(_SCOPE):
                stack.close_to(place, end, now)
        if name in _ENDS:
            ended, until = _ENDS[name]
            while (place := stack.last(ended)) > stack.last(until):
                stack.close_to(place, end, now)
                if name != "tr" or stack.name[-1] not in ended:
                    break
        if name in _RAW:
            found = _RAW_END[name].search(page, position)
            begin = position = found.end() if found else size
            continue
        tag.append(name)
        parent.append(stack.node[-1])
        depth.append(len(stack.name))
        end.append(now + 1)
        attributes.append(page[m.end() : stop - 1])
        if name not in _VOID:
            stack.push(now, name)
    stack.close_to(1, end, len(tag))
    end[0] = len(tag)
    return Tree(tag, parent, depth, end, attributes, at_node, texts)


def up(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums over subtrees of whole numbers."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[:-1]


def down(flags: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True in the subtrees of all flagged nodes."""
    mark = np.zeros(len(flags) + 1, np.int64)
    np.add.at(mark, np.flatnonzero(flags), 1)
    np.add.at(mark, end[flags], -1)
    return np.cumsum(mark[:-1]) > 0


def features(t: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, COLUMNS) features and characters of each node's own text."""
    n = len(t.tag)
    parent, depth, end = np.array(t.parent), np.array(t.depth), np.array(t.end)
    own, marks = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, x in zip(t.text_of, t.texts, strict=True):
        own[i] += len(x)
        marks[i] += x.count(",") + x.count(".") + x.count(";")
    hidden = down(np.array([x in _HIDDEN for x in t.tag]), end)
    link = down(np.array([x == "a" for x in t.tag]), end)
    own[hidden] = 0
    text, links, stops = (up(v, end) for v in (own, own * link, marks * ~hidden))
    nodes = end - np.arange(n)
    inside = parent[1:]
    children = np.bincount(inside, minlength=n)
    kind = np.array([_KINDS.get(x, 0) for x in t.tag])
    place = np.zeros(n)
    seen = np.zeros(n, np.int64)
    for i, p in enumerate(t.parent[1:], 1):
        place[i] = seen[p]
        seen[p] += 1
    over = np.maximum(parent, 0)
    sibling_text = np.bincount(inside, weights=text[1:], minlength=n) / np.maximum(children, 1)
    pair = inside * 64 + kind[1:]
    unique, at = np.unique(pair, return_inverse=True)
    same = np.ones(n)
    same[1:] = np.bincount(at)[at] / children[inside] if n > 1 else same[1:]
    x = np.zeros((n, COLUMNS))
    cols = [
        kind, depth, np.log1p(text), np.log1p(own), text / nodes, links / np.maximum(text, 1), stops / np.maximum(text, 1) * 100, children, np.log1p(nodes),
        place / np.maximum(children[over], 1), children[over], same, np.log1p(sibling_text[over]), (text + 1) / (sibling_text[over] + 1), text / np.maximum(text[0], 1), kind[over],
    ]
    for j, c in enumerate(cols):
        x[:, j] = c
    for i, a in enumerate(t.attributes):
        if a:
            for m in _NAMES.finditer(a):
                for w in _WORD.findall((m.group(1) or m.group(2) or m.group(3) or "").lower()):
                    x[i, 16 + zlib.crc32(w.encode()) % TOKENS] = 1
    return x, own


def training_labels(t: Tree) -> np.ndarray:
    """1 inside article or main, 0 elsewhere, -1 for what surrounds these and on pages without."""
    end = np.array(t.end)
    inside = down(np.array([x in _TRUE for x in t.tag]), end)
    if not inside.any():
        return np.full(len(end), -1)
    around = (up(inside.astype(np.int64), end) > 0) & ~inside
    hidden = down(np.array([x in _HIDDEN for x in t.tag]), end)
    out = inside.astype(int)
    out[around | hidden] = -1
    out[0] = -1
    return out


class Boosted:
    """Gradient-boosted trees of one depth for log loss, over quantile bins."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.bias, self.feature, self.cut, self.leaf = 0.0, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        z = np.full(n, self.bias)
        features, cuts, leaves = [], [], []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, int)
            feature, cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-9)
                local = node - first
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    at = local * (len(e) + 1) + binned[:, j]
                    gs = np.bincount(at, weights=g, minlength=many * (len(e) + 1)).reshape(many, -1).cumsum(1)
                    hs = np.bincount(at, weights=h, minlength=many * (len(e) + 1)).reshape(many, -1).cumsum(1)
                    gl, hl = gs[:, :-1], hs[:, :-1]
                    gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    gain[(hl < 1) | (hr < 1)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(many), top]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + many][better] = j
                    cut[first : first + many][better] = e[top[better]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            local = node - (2**self.depth - 1)
            leaf = -self.rate * np.bincount(local, weights=g, minlength=2**self.depth) / (np.bincount(local, weights=h, minlength=2**self.depth) + 1)
            z += leaf[local]
            features.append(feature)
            cuts.append(cut)
            leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.array(features), np.array(cuts), np.array(leaves)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - (2**self.depth - 1)]
        return z


def decode(t: Tree, score: np.ndarray, own: np.ndarray) -> np.ndarray:
    """True for each node that is in a taken subtree; the best consistent choice.  Worths are whole millionths,
    so that their sums are exact."""
    end = np.array(t.end)
    whole = up(np.rint(score * np.log1p(own) * 1e6).astype(np.int64), end).tolist()
    below = [0] * len(whole)
    take = np.zeros(len(whole), bool)
    for i in range(len(whole) - 1, 0, -1):
        best = max(below[i], 0)
        if whole[i] > best:
            take[i], best = True, whole[i]
        below[t.parent[i]] += best
    return down(take, end)


def text_out(t: Tree, inside: np.ndarray) -> str:
    """The taken text in order; a block begins a new line."""
    block = {}
    for i, name in enumerate(t.tag):
        block[i] = i if name in _BLOCK or i == 0 else block[t.parent[i]]
    lines: list[str] = []
    last = None
    for i, x in zip(t.text_of, t.texts, strict=True):
        if inside[i]:
            if block[i] != last:
                lines.append("")
                last = block[i]
            lines[-1] += x
    lines = [_SPACE.sub(" ", entities.unescape(x)).strip() for x in lines]
    return "\n".join(x for x in lines if x)


def _training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [np.zeros((0, COLUMNS))], [np.zeros(0)]
    for page in pages:
        t = parse(page)
        y = training_labels(t)
        x, _ = features(t)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    return np.concatenate(xs), np.concatenate(ys)


def _training_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = _training_rows(batch.column("html").to_pylist())
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), COLUMNS).cast(pa.list_(pa.float64())), pa.array(y.astype(float))]
        yield pa.RecordBatch.from_arrays(cols, names=["x", "y"])


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Boosted | None:
    """The trees, or None where no page says what is content."""
    d = named(pages, "html").select(F.col("html").cast("string").alias("html")).where("html is not null and html rlike '(?i)<(article|main)[ >]'")
    # only hashes are sorted; the pages of the smallest are then read
    keys = d.select(F.xxhash64("html").alias("k")).distinct().orderBy("k").limit(train_pages)
    sample = d.withColumn("k", F.xxhash64("html")).join(F.broadcast(keys), "k").dropDuplicates(["k"]).select("html")
    rows = sample.mapInArrow(_training_batches, "x array<double>, y double").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("x").to_pylist())
    y = rows.column("y").to_numpy()
    order = np.lexsort((y, *x.T))
    return Boosted().fit(x[order], y[order])


def _extract_batches(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = extract_all(part.column("html").to_pylist(), model)
                cols = [part.column(key), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "text", "nodes", "content_nodes"])

    return run


def extract_all(pages: list[str | None], model: Boosted | None) -> list[tuple[str, int, int]]:
    """Main text, nodes and taken nodes of each page, with one run of the trees over all nodes."""
    parsed = [None if not p else parse(p) for p in pages]
    parts = [None if t is None else features(t) for t in parsed]
    some = [f[0] for f in parts if f is not None]
    scores = model.margin(np.concatenate(some)) if some and model is not None else None
    out, at = [], 0
    for t, f in zip(parsed, parts, strict=True):
        if t is None:
            out.append(("", 0, 0))
            continue
        x, own = f
        score = scores[at : at + len(x)] if scores is not None else np.ones(len(x))
        at += len(x)
        if not own.any():
            out.append(("", len(t.tag) - 1, 0))
            continue
        inside = decode(t, score, own)
        inside &= ~down(np.array([name in _HIDDEN for name in t.tag]), np.array(t.end))
        out.append((text_out(t, inside), len(t.tag) - 1, int(inside.sum())))
    return out


def main_text(pages: DataFrame, key: str = "page_id", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(page_id, text, nodes, content_nodes) of every page; see the module for all cases."""
    # a few thousand numbers, whatever the data
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages, train_pages))
    d = named(pages, key, "html").select(key, F.col("html").cast("string").alias("html"))
    return d.mapInArrow(_extract_batches(key, shared), f"`{key}` {dict(d.dtypes)[key]}, text string, nodes int, content_nodes int")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_html_extraction": op5_html_extraction}
ORACLE: dict[str, str] = {}
