"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each block-level node of a page gets features (see ``dom``): its tag and its parent's, depth, place
among its siblings and their number, text, link and punctuation density of its subtree, words in
its class, id and role, and in its ancestors'. Boosted trees give the chance that a node belongs to
the article or holds it. Hierarchical decoding then takes the most likely choice of nodes in which
no descendant of a dropped node is kept.

No page is labelled. The trees learn from about ``TRAIN_PAGES`` pages, twice as many at most, taken by a
hash of id and page, in which markup tells the article apart (``article``, ``main``): nodes inside and around it are
kept, all others not. Of each such page variants are made, in which the telling tags are replaced
by plain ones, with and without class names, and menus, notices, adverts, forms, sidebars and
reader comments with texts of other pages are put in, also inside the article. So the trees also
know pages that do not say where their article is. Where no page has such markup, pages are read
by a few fixed trees' worth of prior: the share of text outside links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches_of
from .dom import FEATURES, Page, best_choice

#: Most pages that the trees learn from.
TRAIN_PAGES = 400
VARIANTS = 4
BINS = 32
ROUNDS = 60
DEPTH = 4
RATE = 0.2


@dataclass(frozen=True)
class Trees:
    """Complete binary trees over binned features: (rounds x inner nodes), (rounds x leaves)."""

    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def chance(self, rows: np.ndarray) -> np.ndarray:
        binned = _binned(rows, self.edges)
        out = np.full(len(rows), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[np.arange(len(rows)), feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-out))


def _binned(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], rows[:, k]) for k in range(rows.shape[1])], axis=1).astype(np.int64)


def boost(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Gradient boosting with logistic loss, second-order leaves and histogram splits."""
    count, width = rows.shape
    edges = np.stack([np.quantile(rows[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(width)])
    binned = _binned(rows, edges)
    mean = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(count, start)
    inner = 2**DEPTH - 1
    feature, cut = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), BINS)
    leaf = np.zeros((rounds, inner + 1))
    flat = binned + np.arange(width) * BINS
    for turn in range(rounds):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = labels - chance, np.maximum(chance * (1 - chance), 1e-6)
        at = np.zeros(count, np.int64)
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            place = ((at - first)[:, None] * (width * BINS) + flat).ravel()
            g = np.bincount(place, np.repeat(slope, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
            h = np.bincount(place, np.repeat(bend, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)
            gain = g**2 / (h + 1) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + 1) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + 1)
            gain[(h < 3) | (h[:, :, -1:] - h < 3)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            some = gain.reshape(nodes, -1).max(axis=1) > 1e-9
            feature[turn, first : first + nodes] = best // BINS
            cut[turn, first : first + nodes] = np.where(some, best % BINS, BINS)
            at = 2 * at + 1 + (binned[np.arange(count), feature[turn][at]] > cut[turn][at])
        g, h = (np.bincount(at - inner, x, inner + 1) for x in (slope, bend))
        leaf[turn] = RATE * g / (h + 1)
        score += leaf[turn][at - inner]
    return Trees(edges, feature, cut, leaf, start)


# --- training rows -----------------------------------------------------------------------

_ARTICLE = re.compile(r"<(article|main)\b([^>]*)>(.*?)</\1\s*>", re.S | re.I)
_KINDS = ("nav", "footer", "header", "aside")
#: Noise that variants get: how it is called, and how it is written around texts.
_NOISE = (
    ("comments", "<section{0}><h3>{1}</h3><div><p>{2}</p></div><div><p>{3}</p></div></section>"),
    ("comment-list", "<ol{0}><li><p>{2}</p></li><li><p>{3}</p></li></ol>"),
    ("cookie-notice", "<div{0}><p>{2}</p><a href='#'>{1}</a></div>"),
    ("advert", "<div{0}>{2}</div>"),
    ("ad banner", "<div{0}><p><a href='#'>{3}</a></p></div>"),
    ("sidebar", "<aside{0}><h4>{1}</h4><ul><li><a href='#'>{1}</a></li><li><a href='#'>{4}</a></li></ul></aside>"),
    ("related", "<div{0}><h3>{1}</h3><ul><li><a href='#'>{4}</a></li><li><a href='#'>{1}</a></li></ul></div>"),
    ("newsletter", "<form{0}><label>{1}</label><p>{2}</p><input></form>"),
    ("share social", "<div{0}><a href='#'>{1}</a> <a href='#'>{4}</a></div>"),
    ("site-header", "<header{0}><div>{1}</div><p>{4}</p></header>"),
    ("breadcrumb", "<div{0}><a href='#'>{1}</a> / <a href='#'>{4}</a></div>"),
)


def _variant(html: str, donors: list[str], random: np.random.Generator) -> str | None:
    """A page with marked nodes: data-keep is 1 for the article and 0 for what is put in."""
    match = _ARTICLE.search(html)
    if not match:
        return None
    named = random.random() < 0.6

    def noise() -> str:
        name, form = _NOISE[random.integers(len(_NOISE))]
        texts = [donors[k] for k in random.integers(len(donors), size=3)]
        short = " ".join(texts[2].split()[:4])
        attribute = (f' class="{name}"' if named or random.random() < 0.5 else "") + ' data-keep="0"'
        out = form.format(attribute, " ".join(texts[0].split()[:3]), texts[0][: int(random.integers(40, 600))], texts[1][:200], short)
        return out if named else re.sub(r"<(/?)(aside|header|form|section)\b", r"<\1div", out)

    pick = random.integers(4)
    tag = ("article", "div", "section", "main")[pick]
    words = ("post-content", "entry", "article-body", "story", "content")
    attribute = f' class="{words[random.integers(len(words))]}"' if random.random() < 0.5 else ""
    body = match.group(3)
    if random.random() < 0.4:
        body += noise()
    if random.random() < 0.3:
        # Between two paragraphs, where the page has them.
        cut = body.find("<p", len(body) // 2)
        body = body if cut < 0 else body[:cut] + noise() + body[cut:]
    before, after = html[: match.start()], html[match.end() :]
    for _ in range(int(random.integers(3))):
        before += noise()
    for _ in range(int(random.integers(4))):
        cut = after.lower().find("<footer")
        after = noise() + after if cut < 0 or random.random() < 0.5 else after[:cut] + noise() + after[cut:]
    if random.random() < 0.5:
        for kind in _KINDS:
            given = f' class="{kind}"' if named else ""
            before, after = (re.sub(rf"<{kind}\b", f"<div{given}", x) for x in (before, after))
            before, after = (x.replace(f"</{kind}>", "</div>") for x in (before, after))
    wrapped = f'<{tag}{attribute} data-keep="1">{body}</{tag}>'
    if random.random() < 0.4:
        wrapped = f'<div data-keep="1">{wrapped}{noise() if random.random() < 0.5 else ""}</div>'
    return before + wrapped + after


def _labels(page: Page) -> np.ndarray:
    """Marks are handed down; what holds a kept node is kept; the rest is not."""
    nodes = page.nodes
    out = np.array([n.label for n in nodes])
    for k in range(1, len(nodes)):
        if out[k] < 0:
            out[k] = out[nodes[k].parent]
    out = np.maximum(out, 0)
    for k in range(len(nodes) - 1, 0, -1):
        if out[k] and nodes[k].parent >= 0 and nodes[nodes[k].parent].label != 0:
            out[nodes[k].parent] = 1
    return out


def training_rows(pages: list[str], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of variants of the pages that tell their article."""
    random = np.random.default_rng(seed)
    read = [(html, Page(html)) for html in pages if _ARTICLE.search(html)]
    donors = [t for _, p in read for _, t in p.blocks if len(t) > 60] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    rows, labels = [np.zeros((0, FEATURES))], [np.zeros(0)]
    for html, _ in read:
        for k in range(VARIANTS):
            marked = _ARTICLE.sub(lambda m: f'<{m.group(1)}{m.group(2)} data-keep="1">{m.group(3)}</{m.group(1)}>', html, count=1) if not k else _variant(html, donors, random)
            page = Page(marked)
            rows.append(page.features())
            labels.append(_labels(page))
    return np.concatenate(rows), np.concatenate(labels)


def _prior() -> Trees:
    """For want of any page to learn from: keep what is mostly text outside links."""
    edges = np.tile(np.linspace(0, 1, BINS + 1)[1:-1], (FEATURES, 1))
    feature, cut, leaf = np.full((1, 2**DEPTH - 1), 10), np.full((1, 2**DEPTH - 1), BINS), np.zeros((1, 2**DEPTH))
    cut[0, 0] = BINS // 2
    leaf[0] = np.repeat([2.0, -2.0], 2 ** (DEPTH - 1))
    return Trees(edges, feature, cut, leaf, 0.0)


def fit(pages: DataFrame) -> Trees:
    """Learn from about ``TRAIN_PAGES`` of ``pages`` (id, html), chosen by hash of id and page."""
    told = pages.where(F.col("html").rlike("(?i)<(article|main)\\b"))
    count = told.count()
    every = max(1, -(-count // TRAIN_PAGES))
    code = F.xxhash64("id", "html", F.lit("train"))
    # Equal pages teach once, and the limit makes the expected number a bound.
    some = told.where(F.pmod(code, F.lit(every)) == 0).select("html").distinct().limit(2 * TRAIN_PAGES)
    if count and some.isEmpty():
        some = told.orderBy(code, "html").select("html").limit(1)

    def rows(batches):
        for batch in batches:
            for part in batches_of(batch, "html"):
                pages = part.column("html").to_pylist()
                x, y = training_rows(pages, sum(map(len, pages)) % 2**32)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.astype(np.float64).tobytes()], pa.binary())], ["x", "y"])

    found = some.repartition(4, F.xxhash64("html")).sortWithinPartitions("html").mapInArrow(rows, "x binary, y binary").collect()
    x = np.concatenate([np.zeros((0, FEATURES)), *(np.frombuffer(r["x"]).reshape(-1, FEATURES) for r in found)])
    y = np.concatenate([np.zeros(0), *(np.frombuffer(r["y"]) for r in found)])
    if not len(x) or y.min() == y.max():
        return _prior()
    order = np.lexsort((*x.T, y))  # parts come in any order
    return boost(x[order], y[order])


def main_text(page: Page, chance: np.ndarray) -> str:
    kept = best_choice(np.array([n.parent for n in page.nodes]), chance)
    return "\n\n".join(text for node, text in page.blocks if kept[node])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for each row: the main text of the whole page.

    Blocks are trimmed, white space in them is one space, and they are joined by two line breaks in
    page order. Null and empty pages have the empty text. Repeated rows are each returned; ids may
    be null. Other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    trees = fit(rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch, "html"):
                read_pages = [Page(h) for h in part.column("html").to_pylist()]
                sizes = [len(p.nodes) for p in read_pages]
                chance = trees.chance(np.concatenate([p.features() for p in read_pages]))
                ends = np.cumsum([0, *sizes])
                texts = [main_text(p, chance[a:b]) for p, a, b in zip(read_pages, ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["id", "url", "text", "n_chars"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(read, f"id {id_type}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
