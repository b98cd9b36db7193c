"""Main text of web pages by wrapper induction.

Pages of one host are made by the same program, so their DOM trees differ where the content is. Every
host gets a template from a bounded sample of its pages, the ``SAMPLE_PAGES`` with the least hashes of
their html. The trees of the sample, repeated siblings folded, are aligned by simple tree matching: the template
starts as the first tree, each further tree is matched to it node by node, and what finds no partner is added, up to
``TEMPLATE_NODES``. Near copies of one page count as one page.

Over the aligned sample each template node gets its figures: words of different texts, words in links, blocks, pages. From
these the host's content is found: from the root the search goes down into the child with most of the words that vary and are no
links, as long as no other child is content as well (``RIVAL``) and the child is no block of text itself. The node where it ends
is the content slot of the host. Outside of it all is template: menus, headers, notices, adverts and footers, whether their text varies or not.
Inside, nodes whose words are mostly links go, and, where no article or main element says that they are content, those
with one text on most pages.

Every page, sampled or not, is then matched to its host's template, and the blocks below its content slot are kept in page order. Elements,
roles and class words break ties: parts that they name are no content wherever they stand (but not an element that holds the
page's content, ``_lift``), and an article or main element is the content where a page has one, which sets
the slot's border on such pages. A page without its host's slot has what these names leave. A page of nothing but template keeps that.

Pages are shuffled once, by host, and meet their host's template at the head of their group; a host
with more pages than ``GROUP_PAGES`` and a 50 000th of the table is dealt over several groups, each
with the template. Groups are streamed, so none is held in memory, and no result depends on the dealing. A sample is read page by page, and of
each page only figures are kept.

Defined cases: null html has the empty text, a null url the empty host; broken and cut-off markup is
read as far as it goes, however deep or long (all walks are loops); equal rows are each returned; a host
with fewer than ``LEAST_VOICES`` different pages has no constant nodes; of a host with long pages only (over
``SAMPLE_CHARS``) the shortest are sampled; other columns are not read; no rows, no result rows.
"""

from __future__ import annotations

import html as references
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle
from .url_reputation import host_of

#: Pages of a host that its template is made from, and the length up to which they are taken by hash.
SAMPLE_PAGES = 24
SAMPLE_CHARS = 1_000_000
#: Sampled pages that are longer, where a host has no others.
LONG_PAGES = 2
#: Nodes of a template.
TEMPLATE_NODES = 5000
#: A node is constant when its commonest text stands on this share of the different pages that have it,
SAME_SHARE = 0.6
#: and on this many of them.
LEAST_VOICES = 3
#: Pages are different unless all their slots share this share of their words.
COPY_SHARE = 0.8
#: Numbers kept of a sampled page to know its copies.
SKETCH = 4096
#: The content has this share of the words of the node above it, and a node with this share of the content's words is content too.
DOMINANT, RIVAL = 0.5, 0.2
#: Nodes with this share of their words in links are lists of links.
LINKS = 0.6
#: Repeated rows of siblings up to this long are folded.
PERIOD = 8
#: Cells of an alignment's table that are kept at once.
CELLS = 4_000_000
#: Least pages of a group that pages are dealt by.
GROUP_PAGES = 256

# Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An open element that a start tag of the same kind ends.
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select menu".split())
ASIDE = frozenset("nav footer aside form script style noscript template iframe svg math button select textarea dialog head title menu object canvas audio video".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner sidebar sidebars side nav navbar navigation menu menus breadcrumb"
    " breadcrumbs footer topbar cookie cookies consent gdpr notice notices notification alert comment comments disqus respond reply replies share sharing"
    " social related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager widget toolbar skip form search".split()
)
#: Beginnings of class words that mean the same.
ASIDE_STARTS = ("comment", "sidebar", "advert", "sponsor", "cookie", "newsletter", "breadcrumb", "footer", "navbar", "navig", "menu", "promo", "banner", "popup")
#: These are a page's header only outside of its content.
HEADER_WORDS = frozenset(("header", "masthead"))
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of text: what stands in them, in broken markup too, is a part of what stands around them.
TEXTUAL = HEADINGS | frozenset("p li dt dd blockquote pre".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|$)|</([a-zA-Z][^\s>]*)[^>]*(?:>|$)|<[!?/][^>]*(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


class Node:
    """An element. ``soft``: only a form or class words mark it: "" if not, else "named" (nothing but listed words) or "hint"."""

    __slots__ = ("label", "tag", "aside", "soft", "parent", "children", "blocks", "shape", "size")

    def __init__(self, label: str, tag: str, aside: bool = False, soft: str = "", parent: Node | None = None):
        self.label, self.tag, self.aside, self.soft, self.parent = label, tag, aside, soft, parent
        self.children: list[Node] = []
        self.blocks: list[int] = []
        self.shape = self.size = 0


class Page:
    """Blocks of text of a page, the element that holds each, and all elements, parents first."""

    def __init__(self, html: str):
        self.root = Node("#", "#")
        self.nodes = [self.root]
        self.blocks: list[str] = []
        self.links: list[int] = []  # characters of each block that stand in links
        self.owner: list[Node] = []
        self._open = [self.root]
        self._tags: Counter[str] = Counter()  # of the open elements
        self._parse(html)

    def _parse(self, html: str) -> None:
        open_, tags = self._open, self._tags
        text: list[str] = []
        linked: list[str] = []
        in_link = False

        def say(part: str) -> None:
            text.append(part)
            if in_link:
                linked.append(part)

        def end_block() -> None:
            if text:
                found = " ".join(references.unescape("".join(text)).split())
                if found:
                    open_[-1].blocks.append(len(self.blocks))
                    self.blocks.append(found)
                    self.links.append(min(len(found), len(" ".join("".join(linked).split()))))
                    self.owner.append(open_[-1])
                text.clear()
                linked.clear()

        def close(to: int) -> None:
            end_block()
            tags.subtract(n.tag for n in open_[to:])
            del open_[to:]

        at, size = 0, len(html)
        while at < size:
            found = _TOKEN.search(html, at)
            if found is None:
                say(html[at:])
                break
            if found.start() > at:
                say(html[at : found.start()])
            at = found.end()
            start, attributes, end = found.groups()
            if start:
                tag = start.lower()
                if tag in RAW:
                    stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                    at = stop.end() if stop else size
                    text.append(" ")
                elif tag == "br":
                    text.append(" ")
                elif tag in INLINE:
                    in_link = in_link or tag == "a"
                    if attributes and _is_aside(tag, attributes):  # an inline advert or the like is a block of its own
                        end_block()
                        self._enter(tag, attributes)
                elif tag in VOID:
                    if tag == "hr":
                        end_block()
                else:
                    end_block()
                    if tag in CLOSES_P and tags["p"] > 0:
                        for k in range(len(open_) - 1, 0, -1):
                            if open_[k].tag == "p":
                                close(k)
                                break
                            if open_[k].tag in ("td", "th", "button", "object"):
                                break
                    ended = SAME_LEVEL.get(tag, ())
                    if any(tags[t] > 0 for t in ended):
                        for k in range(len(open_) - 1, 0, -1):
                            if open_[k].tag in ended:
                                close(k)
                            elif open_[k].tag in SCOPES:
                                break
                    self._enter(tag, attributes)
            elif end:
                tag = end.lower()
                in_link = in_link and tag != "a"
                if tag == "br":
                    text.append(" ")
                if tags[tag] > 0:
                    close(next(k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == tag))
        end_block()

    def _enter(self, tag: str, attributes: str) -> None:
        label, aside, header, soft = _label(tag, attributes)
        if header and not any(self._tags[t] > 0 for t in CONTENT):
            aside, soft = True, "" if tag == "header" else soft or "hint"
        node = Node(label, tag, aside, soft if aside else "", self._open[-1])
        self._open[-1].children.append(node)
        self._open.append(node)
        self._tags[tag] += 1
        self.nodes.append(node)


_labels: dict[tuple[str, str], tuple[str, bool, bool, str]] = {}


def _attributes(attributes: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}


def _label(tag: str, attributes: str) -> tuple[str, bool, bool, str]:
    """Element with its class and id words; whether they say that it isn't content; whether it is a header; how soft the mark is."""
    if (found := _labels.get((tag, attributes))) is None:
        values = _attributes(attributes)
        words = re.sub(r"[0-9]+", "", f"{values.get('class', '')} {values.get('id', '')}").strip()
        header = tag == "header" or bool({w.lower() for w in _WORDS.findall(words)} & HEADER_WORDS)
        found = (f"{tag}.{words}" if words else tag), _is_aside(tag, attributes), header, _softness(tag, attributes)
        if len(_labels) > 20_000:
            _labels.clear()
        _labels[tag, attributes] = found
    return found


def _is_hidden(values: dict[str, str]) -> bool:
    """Hidden, or of a role that isn't content."""
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true" or values.get("role", "").lower() in ASIDE_ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none", values.get("style", ""), re.I))


def _place_words(values: dict[str, str]) -> set[str]:
    return {w.lower() for w in _WORDS.findall(f"{values.get('class', '')} {values.get('id', '')}")}


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    values = _attributes(attributes)
    if _is_hidden(values):
        return True
    if tag in CONTENT:
        return False
    words = _place_words(values)
    return bool(words & ASIDE_WORDS) or any(w.startswith(ASIDE_STARTS) for w in words)


def _softness(tag: str, attributes: str) -> str:
    """Of a mark: "" if the element, its role or hiding says so, "named" if all its words are listed, "hint" for other words and forms."""
    values = _attributes(attributes or "")
    if tag in ASIDE and tag != "form" or _is_hidden(values):
        return ""
    return "named" if tag != "form" and _place_words(values) <= ASIDE_WORDS else "hint"


def _lift(page: Page) -> None:
    """Takes soft marks from elements that hold the page's content, not a part beside it.

    These are elements with over half of the page's text that are forms or have other words than the
    listed ones; what stands around a main element; what stands around the largest article, where no
    article is free and it is longer than what is; and, where nothing is left, the outermost marks
    until something is.
    """
    nodes = page.nodes
    if not any(n.soft for n in nodes):
        return
    hard: dict[Node, bool] = {}
    for n in nodes:
        hard[n] = n.aside and not n.soft or n.parent is not None and hard[n.parent]
    texts = {n: 0 if hard[n] else sum(len(page.blocks[b]) for b in n.blocks) for n in nodes}
    for n in nodes:
        n.size = texts[n]
    for n in reversed(nodes[1:]):
        n.parent.size += n.size
    for n in nodes:
        if n.soft == "hint" and 2 * n.size > page.root.size:
            n.aside, n.soft = False, ""
    own = dict(texts)  # text of an element without what marks inside it drop
    for n in reversed(nodes[1:]):
        if n.aside:
            own[n] = 0
        own[n.parent] += own[n]
    named = [n for n in nodes if n.tag in CONTENT and own[n]]
    held = [n for n in named if n.tag == "main"]
    if named and not held and not any(_kept(page)[1]):
        largest = max(named, key=own.__getitem__)
        held = [largest] if own[largest] > own[page.root] else []
    seen: set[Node] = set()
    for n in held:
        while n is not None and n not in seen:
            seen.add(n)
            if n.soft:
                n.aside, n.soft = False, ""
            n = n.parent
    marks: dict[Node, int] = {}
    for n in nodes:
        marks[n] = n.aside + (marks[n.parent] if n.parent is not None else 0)
    fewest = min((marks[n] for n in page.owner if not hard[n]), default=0)
    for n in nodes:
        if n.aside and not hard[n] and marks[n] <= fewest:
            n.aside, n.soft = False, ""


def _kept(page: Page) -> tuple[list[bool], list[bool]]:
    """Of every block: whether no element above marks it as something else, and whether it is so inside a content element."""
    place: dict[Node, tuple[bool, bool]] = {}
    for n in page.nodes:
        aside, content = place[n.parent] if n.parent is not None else (False, False)
        place[n] = aside or n.aside, content or n.tag in CONTENT
    free = [not place[n][0] for n in page.owner]
    return free, [f and place[n][1] for f, n in zip(free, page.owner)]


def folded_siblings(shapes: list[int]) -> tuple[list[int], list[int]]:
    """Siblings with repeated rows of up to ``PERIOD`` taken once, and the place of each sibling in that list.

    A row ends where the siblings before it are the same again: a, b, a, b, a, b is a, b, whatever its length.
    """
    out: list[int] = []
    place: list[int] = []
    at = 0
    while at < len(shapes):
        for wide in range(1, min(PERIOD, len(out)) + 1):
            row = out[-wide:]
            if shapes[at : at + wide] == row:
                while shapes[at : at + wide] == row:
                    place += range(len(out) - wide, len(out))
                    at += wide
                break
        else:
            place.append(len(out))
            out.append(shapes[at])
            at += 1
    return out, place


class Shapes:
    """Folded trees by number: a label and the numbers of the children, repeated rows of equal siblings taken once."""

    def __init__(self) -> None:
        self._known: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []

    def fold(self, page: Page) -> None:
        for n in reversed(page.nodes):
            key = (n.label, tuple(folded_siblings([c.shape for c in n.children])[0]) if n.children else ())
            if (found := self._known.get(key)) is None:
                found = self._known[key] = len(self.labels)
                self.labels.append(n.label)
                self.kids.append(key[1])
            n.shape = found


class Template:
    """A tree that grows by the pages added to it; ``constant`` maps a node to the digest of its text.

    ``content`` is the node of the host's content slot (0, the root, if it has none), ``side`` are nodes that are no content.
    """

    def __init__(self) -> None:
        self.labels = ["#"]
        self.children: list[list[int]] = [[]]
        self.constant: dict[int, str] = {}
        self.content = 0
        self.side: set[int] = set()
        self.forget()

    def forget(self) -> None:
        self.shapes = Shapes()
        self._scores: dict[tuple[int, int], int] = {}
        self._partners: dict[tuple[int, int], list[int]] = {}

    def _weights(self, child: int, others: list[int]) -> np.ndarray:
        label = self.shapes.labels[child]
        return np.array([self._scores[child, o] if self.labels[o] == label else 0 for o in others], np.int64)

    def _rows(self, mine, others: list[int]) -> Iterator[np.ndarray]:
        """Rows of the table of best matches: of the first i of ``mine`` with the first j of ``others``, in order."""
        weights: dict[int, np.ndarray] = {}
        last = np.zeros(len(others) + 1, np.int64)
        yield last
        for child in mine:
            if (own := weights.get(child)) is None:
                own = weights[child] = self._weights(child, others)
            row = last.copy()
            np.maximum(row[1:], np.where(own > 0, last[:-1] + own, 0), out=row[1:])
            last = np.maximum.accumulate(row)
            yield last

    def _best(self, mine, others: list[int]) -> int:
        if len(mine) * len(others) > 64:
            for last in self._rows(mine, others):
                pass
            return int(last[-1])
        last = [0] * (len(others) + 1)
        for child in mine:
            row, label = [0], self.shapes.labels[child]
            for j, other in enumerate(others):
                best = last[j + 1] if last[j + 1] > row[j] else row[j]
                if self.labels[other] == label and last[j] + self._scores[child, other] > best:
                    best = last[j] + self._scores[child, other]
                row.append(best)
            last = row
        return last[-1]

    def _align(self, mine, others: list[int]) -> list[int]:
        """The partner of each of ``mine``, or -1, in a best match. Long lists are halved, so that the table stays small."""
        if len(mine) * len(others) > CELLS and len(mine) > 1:
            half = len(mine) // 2
            for upper in self._rows(mine[:half], others):
                pass
            for lower in self._rows(mine[half:][::-1], others[::-1]):
                pass
            cut = int((upper + lower[::-1]).argmax())
            return self._align(mine[:half], others[:cut]) + self._align(mine[half:], others[cut:])
        table = [row.tolist() for row in self._rows(mine, others)]
        found = [-1] * len(mine)
        i, j = len(mine), len(others)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found[i] = others[j]
        return found

    def _score(self, shape: int, node: int) -> None:
        """Simple tree matching: size of the largest match of two trees that keeps order and parents."""
        scores, labels = self._scores, self.shapes.labels
        open_ = [(shape, node)]
        while open_:
            s, t = open_[-1]
            if (s, t) in scores:
                open_.pop()
                continue
            pairs = {(c, o) for c in set(self.shapes.kids[s]) for o in self.children[t] if labels[c] == self.labels[o]}
            if missing := [p for p in pairs if p not in scores]:
                open_ += missing
            else:
                scores[s, t] = 1 + (self._best(self.shapes.kids[s], self.children[t]) if pairs else 0)
                open_.pop()

    def partners(self, shape: int, node: int) -> list[int]:
        """The template node of each folded child, or -1."""
        if (found := self._partners.get((shape, node))) is None:
            mine, theirs = self.shapes.kids[shape], self.children[node]
            for child in set(mine):
                for other in theirs:
                    if self.labels[other] == self.shapes.labels[child]:
                        self._score(child, other)
            found = self._partners[shape, node] = self._align(mine, theirs)
        return found

    def places(self, page: Page, grow: bool = False) -> dict[Node, int]:
        """Template node of every element that has one; with ``grow`` the others are added to the template."""
        if len(self.shapes.labels) > 200_000:
            self.forget()
        self.shapes.fold(page)
        out = {page.root: 0}
        for n in page.nodes:
            if (own := out.get(n)) is None or not n.children:
                continue
            found = self.partners(n.shape, own)
            if grow and -1 in found and len(self.labels) < TEMPLATE_NODES:
                found = self._added(n.shape, own, found)
            for child, k in zip(n.children, folded_siblings([c.shape for c in n.children])[1]):
                if found[k] >= 0:
                    out[child] = found[k]
        if grow:
            self._scores, self._partners = {}, {}
        return out

    def _added(self, shape: int, node: int, found: list[int]) -> list[int]:
        """New template children for those without a partner, each before the next one's partner."""
        found = list(found)
        order = self.children[node]
        place = {other: j for j, other in enumerate(order)}
        before: dict[int, list[int]] = {}
        after = len(order)
        for k in range(len(found) - 1, -1, -1):
            if found[k] >= 0:
                after = place[found[k]]
            else:
                found[k] = len(self.labels)
                self.labels.append(self.shapes.labels[self.shapes.kids[shape][k]])
                self.children.append([])
                before.setdefault(after, []).append(found[k])
        self.children[node] = [x for j in range(len(order) + 1) for x in (*reversed(before.get(j, ())), *order[j : j + 1])]
        self._partners[shape, node] = found
        return found

    def dumps(self) -> bytes:
        return zlib.compress(json.dumps([self.labels, self.children, list(self.constant.items()), self.content, sorted(self.side)]).encode())

    @classmethod
    def loads(cls, data: bytes) -> Template:
        out = cls()
        out.labels, out.children, constant, out.content, side = json.loads(zlib.decompress(data))
        out.constant, out.side = dict(map(tuple, constant)), set(side)
        return out


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _said(page: Page, places: dict[Node, int]) -> dict[int, list[int]]:
    """Blocks of a page by template node."""
    out: dict[int, list[int]] = {}
    for b, owner in enumerate(page.owner):
        if (node := places.get(owner)) is not None:
            out.setdefault(node, []).append(b)
    return out


def _sketch(texts: dict[int, str]) -> dict[int, frozenset[bytes]]:
    """By node, the least hashes of its words, each as often as it stands there; ``SKETCH`` in all, eight a node at least."""
    most = max(8, SKETCH // max(len(texts), 1))
    out = {}
    for node, text in texts.items():
        times: Counter[str] = Counter()
        hashes = []
        for word in text.split():
            times[word] += 1
            hashes.append(blake2b(f"{times[word]} {word}".encode("utf-8", "surrogatepass"), digest_size=8).digest())
        out[node] = frozenset(nsmallest(most, hashes))
    return out


def _are_copies(one: dict[int, frozenset[bytes]], other: dict[int, frozenset[bytes]]) -> bool:
    """Whether all nodes of two pages share ``COPY_SHARE`` of their words, by the least hashes of both."""
    if one.keys() != other.keys():
        return False
    for node, mine in one.items():
        theirs = other[node]
        least = nsmallest(max(len(mine), len(theirs)), mine | theirs)
        if sum(h in mine and h in theirs for h in least) < COPY_SHARE / (2 - COPY_SHARE) * len(least):
            return False
    return True


class Figures:
    """What the aligned sample says of a template node: its different texts, words, words in links, pages, and how often names call it aside."""

    __slots__ = ("texts", "words", "links", "pages", "marked", "seen")

    def __init__(self) -> None:
        self.texts: Counter[str] = Counter()
        self.words = self.links = 0.0
        self.pages = self.marked = self.seen = 0


def induce(pages: Iterable[str | None]) -> Template:
    """The template of some pages of one host."""
    template = Template()
    figures: dict[int, Figures] = {}
    known: list[dict[int, frozenset[bytes]]] = []
    for html in pages:
        page = Page(html or "")
        _lift(page)
        places = template.places(page, True)
        near: dict[Node, int] = {}  # a full template has no place for some elements: their text is that of the next one above
        for element in page.nodes:
            near[element] = places.get(element, near[element.parent] if element.parent is not None else 0)
        said = _said(page, near)
        texts = {node: "\n".join(page.blocks[b] for b in blocks) for node, blocks in said.items()}
        sketch = _sketch(texts)
        if not texts or any(_are_copies(sketch, other) for other in known):
            continue
        known.append(sketch)
        for element, node in places.items():
            own = figures.setdefault(node, Figures())
            own.seen += 1
            own.marked += element.aside
        for node, blocks in said.items():
            own = figures[node]
            own.pages += 1
            digest = _digest(texts[node])
            own.texts[digest] += 1
            if own.texts[digest] == 1:  # a text that stands on many pages counts once
                for b in blocks:
                    words = len(page.blocks[b].split())
                    own.words += words
                    own.links += words * page.links[b] / len(page.blocks[b])
    _judge(template, figures)
    template.forget()
    return template


def _tag(label: str) -> str:
    return label.split(".", 1)[0]


def _judge(template: Template, figures: dict[int, Figures]) -> None:
    """Finds the content slot and the side nodes of a template from the figures of its nodes."""
    n = len(template.labels)
    parent = [0] * n
    for node, kids in enumerate(template.children):
        for kid in kids:
            parent[kid] = node
    words, links = [0.0] * n, [0.0] * n
    aside = [False] * n
    for node, own in figures.items():
        words[node], links[node] = own.words, own.links
        aside[node] = node > 0 and 2 * own.marked > own.seen
    for node in range(n - 1, 0, -1):  # parents have lower numbers
        if aside[node]:
            words[node] = links[node] = 0.0
        words[parent[node]] += words[node]
        links[parent[node]] += links[node]
    plain = [w - k for w, k in zip(words, links)]
    direct = [0.0] * n  # of a node itself, in none of its children
    for node, own in figures.items():
        direct[node] = own.words - own.links

    at = 0
    while True:
        kids = [k for k in template.children[at] if not aside[k]]
        best = max(kids, key=plain.__getitem__, default=None)
        if best is None or not template.children[best] or _tag(template.labels[best]) in TEXTUAL or plain[best] <= 0 or plain[best] < DOMINANT * plain[at]:
            break
        others = [k for k in kids if k != best]
        if direct[at] >= RIVAL * plain[best] or any(plain[k] >= RIVAL * plain[best] or _tag(template.labels[k]) in HEADINGS and plain[k] > 0 for k in others):
            break
        at = best
    template.content = at
    named = False  # whether the slot is one that names call content, or lies in one
    node = at
    while node and not named:
        named, node = _tag(template.labels[node]) in CONTENT, parent[node]
    for node in range(1, n):
        own = figures.get(node)
        if own is None:
            continue
        if words[node] and links[node] >= LINKS * words[node] and template.children[node]:
            template.side.add(node)
        if own.texts and not named:
            ((text, times),) = own.texts.most_common(1)
            if times >= LEAST_VOICES and times >= SAME_SHARE * own.texts.total():
                template.constant[node] = text


def chosen_blocks(page: Page, template: Template) -> tuple[list[int], bool]:
    """The content's blocks of a page, and whether the template chose them (else names alone)."""
    _lift(page)
    free, inside = _kept(page)
    places = template.places(page)
    slot: dict[Node, bool] = {}
    out: dict[Node, bool] = {}
    for element in page.nodes:
        node = places.get(element)
        slot[element] = node == template.content or element.parent is not None and slot[element.parent]
        dropped = element.parent is not None and out[element.parent]
        out[element] = dropped or node in template.side and node != template.content
    same = {
        node
        for node, blocks in _said(page, places).items()
        if node in template.constant and template.constant[node] == _digest("\n".join(page.blocks[b] for b in blocks))
    }
    in_slot = [b for b, owner in enumerate(page.owner) if free[b] and slot[owner] and not out[owner]]
    own = [b for b in in_slot if places.get(page.owner[b]) not in same]
    if any(inside):
        # An article or main element sets the border; link lists and the like go where they have names.
        named = [b for b, yes in enumerate(inside) if yes]
        return named, set(named) <= set(in_slot)
    if own or in_slot:
        return own or in_slot, True
    return [b for b, yes in enumerate(free) if yes], False


def main_text(html: str | None, template: Template) -> str:
    """The content of a page, by its host's template."""
    page = Page(html or "")
    return " ".join(page.blocks[b] for b in chosen_blocks(page, template)[0])


def extract(pages: list[str | None]) -> list[str]:
    """Main text of each of some pages of one host, the template made from all of them."""
    template = induce(pages)
    return [main_text(html, template) for html in pages]


def host_templates(pages: DataFrame) -> DataFrame:
    """(host, template) of every host of rows (host, html), made from a bounded sample of its pages; host is a number."""

    def induced(key: tuple, table: pa.Table) -> pa.Table:
        template = induce(html.as_py() for html in sorted(table.column("html"), key=lambda x: _digest(x.as_py())))
        return pa.table({"host": pa.array([key[0].as_py()], pa.int64()), "template": pa.array([template.dumps()], pa.binary())})

    rows = pages.select("host", "html", F.length("html").alias("size")).filter("html is not null")
    mixed = rows.withColumn("mix", F.xxhash64("html"))
    # Pages up to the limit by hash, then longer ones by length. Map tasks keep no more than the sample of each host; a host of
    # many pages is ranked in 64 parts first.
    order = [F.greatest(F.col("size"), F.lit(SAMPLE_CHARS)), F.col("mix")]
    part, whole = Window.partitionBy("host", F.pmod("mix", F.lit(64))).orderBy(*order), Window.partitionBy("host").orderBy(*order)
    some = mixed.select("host", "mix", "size").distinct().withColumn("n", F.row_number().over(part)).filter(F.col("n") <= SAMPLE_PAGES)
    ranked = some.withColumn("n", F.row_number().over(whole)).filter((F.col("n") <= LONG_PAGES) | (F.col("size") <= SAMPLE_CHARS) & (F.col("n") <= SAMPLE_PAGES))
    sample = mixed.join(ranked.select("host", "mix"), ["host", "mix"]).groupBy("host", "mix").agg(F.first("html").alias("html"))
    return sample.select("host", "html").groupBy("host").applyInArrow(induced, "host long, template binary")


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url and the main text of each page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template()
        rows: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            types = (pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "url", "text"])

        for batch in batches:
            columns = [batch.column(c) for c in ("template", "page_id", "url", "html")]
            for at in range(batch.num_rows):
                own, *page = (c[at].as_py() for c in columns)
                if own is not None:
                    template = Template.loads(own)
                    continue
                rows.append((page[0], page[1], main_text(page[2], template)))
                size += len(rows[-1][2])
                if len(rows) >= 2000 or size > 8_000_000:
                    yield done()
                    rows, size = [], 0
        if rows:
            yield done()

    keyed = pages.select(
        F.xxhash64(host_of(F.col("url"))).alias("host"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")
    )
    counts = settle(keyed.groupBy("host").agg(F.count("*").alias("n")), "host-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    group = max(GROUP_PAGES, total // 50_000)
    # At most 50 000 hosts have more pages than a 50 000th of all; two numbers each.
    large = F.broadcast(counts.filter(F.col("n") > group).select("host", F.ceil(F.col("n") / group).cast("int").alias("groups")))
    templates = settle(host_templates(keyed), "templates").join(large, "host", "left")
    heads = templates.select(
        "host", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("deal"), "template",
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"),
    )
    dealt = keyed.withColumn("row", F.monotonically_increasing_id()).join(large, "host", "left")
    deal = F.coalesce(F.pmod(F.col("row"), F.col("groups")).cast("int"), F.lit(0))
    bodies = dealt.select("host", deal.alias("deal"), F.lit(None).cast("binary").alias("template"), "page_id", "url", "html")
    met = heads.union(bodies).repartition("host", "deal").sortWithinPartitions("host", "deal", F.col("template").isNull())
    return met.mapInArrow(each, "page_id long, url string, text string")
