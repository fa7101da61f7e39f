"""Blocks and block-level nodes of a web page, with features of each node."""

from __future__ import annotations

import html as entities
import re

import numpy as np

# HTML elements by what they do to the flow of text.
BLOCK = (
    "html body div section article main header footer nav aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center hr dialog menu"
).split()
# A head is not among the skipped: its end tag may be left out, and what it holds is skipped by itself.
# Skipped is what a browser does not show as text, and the controls of forms.
SKIPPED = "script style noscript template svg iframe title textarea select button canvas audio video".split()
VOID = "hr br img input meta link area base col embed source track wbr".split()
CLOSED_BY_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ()}
#: Words in class, id and role values that tell what a node is for.
NOISE_WORDS = (
    "ad ads adv advert advertisement sponsor sponsored promo banner nav navigation navbar menu breadcrumb breadcrumbs sidebar side rail "
    "widget footer foot header masthead topbar cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup "
    "login search form comment comments reply replies discussion disqus respond social share sharing follow related recommended more "
    "pagination pager toolbar copyright legal skip meta tags byline"
).split()
CONTENT_WORDS = "article content main post entry body story text prose page maincontent articlebody postbody".split()

_BLOCK_AT = {t: k + 1 for k, t in enumerate(BLOCK)}
_SKIPPED = frozenset(SKIPPED)
_VOID = frozenset(VOID)
_NOISE, _CONTENT = frozenset(NOISE_WORDS), frozenset(CONTENT_WORDS)
_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?/])")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
FEATURES = 30


class _Tags:
    """The tags of a page in order, read once from left to right, as a browser's tokenizer reads them.

    A quoted value ends at its quote alone. A tag whose quote is never closed ends at the next ``>``;
    a tag that nothing ends is text. What is known to be missing ahead is looked for once only, so
    the time follows the length of the page.
    """

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self._missing: set[str] = set()

    def _find(self, what: str, at: int) -> int:
        if what in self._missing:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self._missing.add(what)
        return found

    def __iter__(self):
        """``(begin, end, slash, name, attributes)``; of comments and the like the name is None."""
        at = 0
        while match := _START.search(self.html, at):
            begin, at = match.start(), match.end()
            name = match.group(2)
            if name is None:
                if match.group() == "<!--":
                    close = self._find("-->", at)
                    at = len(self.html) if close < 0 else close + 3
                elif begin < self.last:
                    at = self.html.find(">", at) + 1
                else:
                    continue
                yield begin, at, "", None, ()
                continue
            if begin > self.last:
                return
            end, attributes = self._attributes(at)
            if end < 0:
                end, attributes = self.html.find(">", at) + 1, []
            yield begin, end, match.group(1), name.lower(), attributes
            at = end

    def _attributes(self, at: int) -> tuple[int, list[tuple[str, str]]]:
        """Where the tag ends and its attributes; -1 if a quote in it is never closed."""
        html, found = self.html, []
        while True:
            at = _GAP.match(html, at).end()
            if at >= len(html):
                return -1, []
            if html[at] == ">":
                return at + 1, found
            name = _NAME.match(html, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ("'", '"') and quote:
                    close = self._find(quote, at + 1)
                    if close < 0:
                        return -1, []
                    value, at = html[at + 1 : close], close + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare.group(), bare.end()
            found.append((name.group().lower(), value))


class Node:
    __slots__ = ("tag", "parent", "depth", "noise", "content", "label", "own", "linked", "blocks", "children", "sibling", "begin")

    def __init__(self, tag: str, parent: int, depth: int, begin: int):
        self.tag, self.parent, self.depth, self.begin = tag, parent, depth, begin
        self.noise = self.content = 0
        self.label = -1
        self.own = self.linked = self.blocks = self.children = self.sibling = 0


class Page:
    """Nodes in document order (the root first), and blocks as (node, text) in page order."""

    def __init__(self, html: str):
        self.nodes = [Node("html", -1, 0, 0)]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        stack, held, linked, links, at = [0], [], 0, 0, 0
        nodes = self.nodes
        # Where in the stack the open elements of each tag are.
        where: dict[str, list[int]] = {}
        skipping, depth_skipped = "", 0
        opened: list[str] = []
        opened_count: dict[str, int] = {}
        last_end: dict[str, int] = {}

        def flush():
            nonlocal linked
            if held:
                text = _SPACE.sub(" ", entities.unescape("".join(held))).strip(" ")
                held.clear()
                if text:
                    node = nodes[stack[-1]]
                    node.own += len(text)
                    node.linked += min(linked, len(text))
                    node.blocks += 1
                    self.blocks.append((stack[-1], text))
            linked = 0

        def close(k: int) -> None:
            """Close the open elements from place ``k`` of the stack on."""
            while len(stack) > k:
                where[nodes[stack.pop()].tag].pop()

        for begin, end_at, slash, name, attributes in _Tags(html):
            if begin < at:
                continue
            if begin > at and not skipping:
                held.append(html[at:begin])
                if links:
                    linked += begin - at
            at = end_at
            if name is None:
                continue
            if skipping:
                if name == skipping:
                    if slash:
                        depth_skipped -= 1
                    elif name not in ("button", "select"):  # these hold none of their kind
                        depth_skipped += 1
                    if not depth_skipped:
                        skipping = ""
                    continue
                if name not in _BLOCK_AT or name in _VOID:
                    continue
                if not slash:
                    opened.append(name)
                    opened_count[name] = opened_count.get(name, 0) + 1
                    continue
                if opened_count.get(name):
                    while True:
                        last = opened.pop()
                        opened_count[last] -= 1
                        if last == name:
                            break
                    continue
                if not where.get(name):
                    continue
                # The close of the block that holds a skipped element ends both.
                skipping = ""
            if name in _SKIPPED:
                if slash or html[end_at - 2 : end_at] == "/>":
                    continue
                if name in ("script", "style", "textarea", "title"):
                    # Raw text: tags inside are not tags.
                    if last_end.get(name, at) >= at:
                        found = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                        last_end[name] = found.start() if found else -1
                        at = found.end() if found else len(html)
                    else:
                        at = len(html)
                else:
                    if name not in last_end:
                        last_end[name] = max((m.start() for m in re.finditer(rf"</{name}(?![a-z0-9:-])", html, re.I)), default=-1)
                    # Of an element that nothing ends only the tag is left out, not the rest of the page.
                    if last_end[name] >= at:
                        skipping, depth_skipped = name, 1
                        opened.clear()
                        opened_count.clear()
                continue
            if name == "br":
                held.append(" ")
                continue
            if name not in _BLOCK_AT:
                if name == "a":
                    links = 0 if slash else 1
                elif name == "img":
                    held.append(" ")
                continue
            flush()
            if slash:
                if where.get(name):
                    close(where[name][-1])
                    links = 0
                continue
            # Any block ends an open paragraph; list and table parts end their like.
            if nodes[stack[-1]].tag == "p":
                close(len(stack) - 1)
                links = 0
            bounds = CLOSED_BY_SAME.get(name)
            if bounds is not None:
                like = next((pair for pair in (("dt", "dd"), ("td", "th")) if name in pair), (name,))
                nearest, bound = (max((where[t][-1] for t in tags if where.get(t)), default=0) for tags in (like, bounds))
                if nearest > bound:
                    close(nearest)
            if name in ("html", "body") and len(stack) == 1:
                self._attributes(nodes[0], attributes)
                continue
            if name in _VOID:
                continue
            parent = nodes[stack[-1]]
            node = Node(name, stack[-1], parent.depth + 1, begin)
            node.sibling = parent.children
            parent.children += 1
            self._attributes(node, attributes)
            where.setdefault(name, []).append(len(stack))
            stack.append(len(nodes))
            nodes.append(node)
        if not skipping and at < len(html):
            held.append(html[at:])
        flush()

    @staticmethod
    def _attributes(node: Node, attributes: list[tuple[str, str]]) -> None:
        for name, value in attributes:
            if name == "data-keep":
                node.label = int(value == "1")
                continue
            if name not in ("class", "id", "role"):
                continue
            for token in _TOKEN.findall(value):
                token = token.lower()
                node.noise += token in _NOISE
                node.content += token in _CONTENT

    def features(self) -> np.ndarray:
        """One row of ``FEATURES`` numbers a node."""
        nodes = self.nodes
        count = len(nodes)
        parent = np.array([n.parent for n in nodes])
        own = np.array([n.own for n in nodes], float)
        linked = np.array([n.linked for n in nodes], float)
        blocks = np.array([n.blocks for n in nodes], float)
        dots = np.zeros(count)
        for k, text in self.blocks:
            dots[k] += text.count(".") + text.count(",")
        noise = np.array([n.noise for n in nodes], float)
        content = np.array([n.content for n in nodes], float)
        tag = np.array([_BLOCK_AT[n.tag] for n in nodes])
        paragraph = np.where(tag == _BLOCK_AT["p"], own, 0.0)
        total = {name: x.copy() for name, x in (("own", own), ("linked", linked), ("blocks", blocks), ("dots", dots), ("p", paragraph), ("noise", noise))}
        size = np.ones(count)
        for k in range(count - 1, 0, -1):  # children come after their parents
            p = parent[k]
            size[p] += size[k]
            for x in total.values():
                x[p] += x[k]
        above_noise, above_content, flags = np.zeros(count), np.zeros(count), np.zeros((count, 4))
        names = [_BLOCK_AT[t] for t in ("article", "main", "nav", "footer", "aside", "form", "header", "li")]
        for k in range(1, count):
            p = parent[k]
            above_noise[k] = above_noise[p] + noise[p]
            above_content[k] = above_content[p] + content[p]
            flags[k] = flags[p]
            if tag[p] in names[:2]:
                flags[k, 0] = 1
            elif tag[p] in names[2:7]:
                flags[k, 1] = 1
            elif tag[p] == names[7]:
                flags[k, 2] = 1
        up = np.maximum(parent, 0)
        whole = max(total["own"][0], 1.0)
        sisters = np.array([nodes[p].children if p >= 0 else 1 for p in parent], float)
        text = np.maximum(total["own"], 1.0)
        depth = np.array([n.depth for n in nodes], float)
        begin = np.array([n.begin for n in nodes], float)
        same = np.zeros(count)
        kinds: dict[tuple[int, int], int] = {}
        for k in range(count):
            key = (int(parent[k]), int(tag[k]))
            kinds[key] = kinds.get(key, 0) + 1
        for k in range(count):
            same[k] = kinds[int(parent[k]), int(tag[k])]
        return np.column_stack([
            tag, tag[up], depth, np.array([n.sibling for n in nodes], float), sisters, same,
            np.log1p(total["own"]), np.log1p(own), total["own"] / whole, total["own"] / np.maximum(total["own"][up], 1.0),
            total["linked"] / text, linked / np.maximum(own, 1.0), total["dots"] / text, dots / np.maximum(own, 1.0),
            np.log1p(total["blocks"]), total["own"] / np.maximum(total["blocks"], 1.0), total["p"] / text, np.log1p(size), text / size,
            np.minimum(noise, 3), np.minimum(content, 3), np.minimum(above_noise, 4), np.minimum(above_content, 4), np.minimum(total["noise"] - noise, 4),
            flags[:, 0], flags[:, 1], flags[:, 2], begin / max(begin[-1], 1.0), total["own"][up] / whole, np.log1p(total["own"][up]),
        ])


def best_choice(parent: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Which nodes to keep: most likely of all choices in which a dropped node keeps no descendant.

    Nodes are in document order, the root (parent -1) first.
    """
    yes, no = np.log(np.clip(chance, 1e-6, 1)), np.log(np.clip(1 - chance, 1e-6, 1))
    drop, keep = no.copy(), yes.copy()
    for k in range(len(parent) - 1, 0, -1):
        drop[parent[k]] += drop[k]
        keep[parent[k]] += max(keep[k], drop[k])
    kept = keep > drop
    for k in range(1, len(parent)):
        kept[k] &= kept[parent[k]]
    return kept
