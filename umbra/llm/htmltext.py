"""HTML extraction with wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a tree of block elements and text blocks (inline markup is part of a text block). ``fold`` turns it into an
expression: neighbours of one kind, and runs of two or three kinds that repeat, become repeated groups. ``align`` merges
two expressions: elements are matched in order, an unmatched one becomes optional, texts that differ become a text slot,
equal ones stay constant. Aligning the pages of a host one after another gives its wrapper. It tells, for each place, how
much of the text there varies, how much is the template's (the same on at least three different pages), how much is in
links, and whether the place repeats within a page.

Extraction reads the article element (or main, or elements that say so by role or property). The wrapper decides

* which of several articles is the page's: one that doesn't repeat; those at places that repeat beside it, or inside it,
  are readers' comments, and go with what encloses nothing else;
* whether an element whose class or id only suggests that it isn't the article ("share-price", "related-work") goes: it
  does where its text is mostly the template's or in links, and stays where it is a slot of plain text;
* where the text is on pages without an article element: in the lowest element that holds all text that varies, isn't in
  links and isn't named as something else. There, the template's texts and places made of links are dropped too.

Menus, headers and footers of the page, sidebars, forms, notices, adverts and comments that say so by element, role, or
a class or id that says nothing else, go on any page. A form that holds an article or most of the page is no form.

Scale: wrappers are inferred in the tasks that read the pages, one for each host and task, and merged in steps (64
neighbouring tasks, 4,096, all), so a host with a third of all pages neither meets in one task nor is sampled. The pages
then meet their wrappers by host; a host with more than HOT buckets of pages is dealt over as many buckets as it fills,
and executors get 12 bytes for each such host, of which there are at most one for each HOT buckets of input. In a wrapper
equal neighbours are one item, and an element with over MOST different items is generalised to one repeated item of each
kind, aligned by kind. No kind is left out, so a wrapper grows with the different labels of its host's pages.

Defined cases: a null or empty page gives an empty text; a page without any article gives what its wrapper holds, or
empty; a null url is a host of its own; character references are decoded once; white space inside a block becomes one
blank; blocks are joined by one line break; unclosed, wrongly closed and cut-off elements are closed where the next
block begins; elements may be nested to any depth. Repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import html
import pickle
import re
import sys
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, saved, text_bytes

MOST = 64
BUCKET_BYTES = 16 << 20
#: Buckets that a host's pages fill before they are dealt over several, and tasks whose wrappers are merged at a time.
HOT, MERGED = 2, 64
#: What pages are made of is only limited by their length. Calls between Python functions don't use the C stack.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000_000))

# Elements by kind, and words that name what isn't the article.
RAW = frozenset("script style noscript template svg math canvas iframe object embed audio video textarea select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr output picture q ruby rp rt s samp small source span strike strong sub sup time tt u var wbr".split())
LISTED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table menu select article main section body div".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu head fieldset".split())
ARTICLE = frozenset("article main".split())
WORDS = frozenset(
    "navig sponsor advert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead banner ad ads advert adverts advertisement adsense promo promotion sponsor sponsored "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments respond responses reply replies disqus pagination pager widget toolbar copyright disclaimer skip complementary contentinfo".split()
)
#: Words that say nothing of their own beside such a word.
NEUTRAL = frozenset("box list container wrapper wrap section block area bar item items content link links main top bottom left right site page global primary secondary inner outer row col unit slot text form button buttons icon icons title head body posts articles stories news panel zone the and of us by on".split())
#: Words that a paragraph or quotation may have without being one of those.
MILD = frozenset("notice notices alert share sharing search related skip header banner reply respond responses disclaimer".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote figure figcaption table dt dd td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Beginnings of such words in compounds, and words that begin so but name articles.
STEMS = ("comment", "sidebar", "cookie", "newsletter", "breadcrumb", "advert", "navig", "sponsor", "pagination", "disqus")
PLAIN = frozenset("commentary navigator".split())
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
BODY = frozenset(("role=main", "itemprop=articlebody"))
HUMP = re.compile("(?<=[a-z])(?=[A-Z])")

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z", re.S)


# ---- pages as trees


#: Whether an element is something else than the article: no, perhaps (the wrapper decides), or surely.
NO, MAYBE, SURE = range(3)


def suggests(mark: str, name: str) -> int:
    """What a class or id says; what an element merely has or lacks doesn't name it."""
    if mark.startswith(("has-", "with-", "no-", "without-", "is-", "js-", "has_", "no_")):
        return NO
    words = {w for w in re.split("[^a-z]+", mark) if w}
    if any(w.startswith(STEMS) and w not in PLAIN for w in words):
        return SURE
    listed = words & WORDS
    if not listed:
        return NO
    return SURE if not words - WORDS - NEUTRAL and not (name in LEAVES and listed <= MILD) else MAYBE


class Text(str):
    """A text block and how many of its characters are in links."""

    links = 0


class Node:
    """A block element: its label (name and what class, id, role and property say) and its children, nodes or texts."""

    __slots__ = ("label", "name", "kids", "outside", "article")

    def __init__(self, name: str, attributes: str = "", inside: bool = False):
        self.name, self.kids = name, []
        marks = set()
        outside = SURE if name in OUTSIDE or name == "header" and not inside else NO
        for key, *values in ATTRIBUTE.findall(attributes) if attributes else ():
            key = key.lower()
            for x in HUMP.sub("-", "".join(values)).lower().split():
                marks.add(f"{key}={re.sub('[0-9]+', '', x)}")
                if key in ("class", "id"):
                    outside = max(outside, suggests(x, name))
                elif key == "role" and x in ROLES:
                    outside = SURE
        self.label = ".".join([name, *sorted(marks)])
        self.article = name in ARTICLE or bool(marks & BODY)
        if name in ("html", "body") or self.article and not any(w in self.label for w in ("comment", "related", "promo", "=ad", "=reply")):
            outside = NO
        self.outside = SURE if attributes and HIDDEN.search(attributes) else outside


def clean(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def parse(page: str) -> Node:
    """The tree of a page; its root stands for the document."""
    root = Node("#page")
    stack, at = [root], 0
    held: list[str] = []
    linked: list[str] = []
    in_link = False
    #: Where on the stack elements of a name are, and articles.
    opened: dict[str, list[int]] = {}
    articles: list[int] = []

    def flush():
        if held:
            if text := clean(held):
                made = Text(text)
                if linked:
                    made.links = min(len(clean(linked)), len(text))
                stack[-1].kids.append(made)
            held.clear()
            linked.clear()

    def close(k: int) -> None:
        """Closes all elements from the k-th on."""
        for x in reversed(stack[k:]):
            opened[x.name].pop()
        del stack[k:]
        while articles and articles[-1] >= k:
            articles.pop()

    def keep(part: str) -> None:
        held.append(part)
        if in_link:
            linked.append(part)

    while m := TAG.search(page, at):
        if m.start() > at:
            keep(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/") and name not in VOID:
                end = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in INLINE:
            if name == "br":
                keep(" ")
            elif name == "a":
                in_link = not closing
            continue
        flush()
        if closing:
            if opened.get(name):
                k = opened[name][-1]
                # A stray end of a paragraph or item doesn't end what encloses its article.
                if name in ("article", "main", "body", "html") or not (articles and articles[-1] > k):
                    close(k)
            continue
        if stack[-1].name == "p":
            close(len(stack) - 1)
        if name in LISTED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in LISTED[name]:
                    close(k)
                    break
                if stack[k].name in LISTS:
                    break
        if name in VOID:
            continue
        node = Node(name, attributes, bool(articles))
        stack[-1].kids.append(node)
        if not attributes.endswith("/"):
            opened.setdefault(name, []).append(len(stack))
            if node.article:
                articles.append(len(stack))
            stack.append(node)
    keep(CUT.sub("", page[at:]))
    flush()
    return root


# ---- wrappers


class Item:
    """Part of a wrapper. kind: an element's label, '#text', or '#group' with its items' kinds. pages: the least hashes of
    up to CONSTANT_FROM different pages that have it; seen: how many. A text is constant (text) or a slot (None).
    mass, links: characters of its texts, and those in links. many: it repeats on a page."""

    __slots__ = ("kind", "pages", "many", "text", "mass", "links", "items")

    def __init__(self, kind, text=None, mass=0, links=0, items=(), pages=(), many=False):
        self.kind, self.pages, self.many, self.text, self.mass, self.links, self.items = kind, pages, many, text, mass, links, list(items)

    @property
    def seen(self) -> int:
        return len(self.pages)

    def __repr__(self) -> str:
        inner = repr(self.text) if self.kind == "#text" else f"{self.kind}({', '.join(map(repr, self.items))})"
        return inner + "+" * self.many


def packed(item: Item) -> bytes:
    """An item as a flat list, from its end, so that depth doesn't matter."""
    out, todo = [], [item]
    while todo:
        x = todo.pop()
        out.append((x.kind, x.pages, x.many, x.text, x.mass, x.links, len(x.items)))
        todo += x.items
    return pickle.dumps(out)


def unpacked(data: bytes) -> Item:
    done: list[Item] = []
    for kind, pages, many, text, mass, links, n in reversed(pickle.loads(data)):
        items = done[len(done) - n :] if n else []
        del done[len(done) - n :]
        done.append(Item(kind, text, mass, links, items, pages, many))
    return done[0]


def fold(node: Node, pages: tuple = ()) -> Item:
    """A page's tree as an expression; pages: the hash of the page."""
    items = [Item("#text", _short(x), len(x), x.links, pages=pages) if isinstance(x, str) else fold(x, pages) for x in node.kids]
    return Item(node.label, items=collapsed(items), pages=pages)


def _both(a: tuple, b: tuple) -> tuple:
    """The least CONSTANT_FROM hashes of two lots of pages."""
    return a if a == b else tuple(sorted({*a, *b})[:CONSTANT_FROM])


def _short(text: str) -> str | int:
    """Constants are kept as they are or, if long, as a hash: a wrapper doesn't hold articles."""
    return text if len(text) <= 80 else xxhash.xxh3_64_intdigest(text.encode())


def merge(a: Item, b: Item, together: bool) -> Item:
    """together: both are on one page (a repetition)."""
    out = Item(a.kind, pages=_both(a.pages, b.pages))
    out.many = together or a.many or b.many
    out.mass, out.links = a.mass + b.mass, a.links + b.links
    out.text = a.text if a.text == b.text else None
    out.items = aligned(a.items, b.items, together) if a.items or b.items else []
    return out


def collapsed(items: list[Item]) -> list[Item]:
    """Repeated neighbours, then repeated runs of two or three kinds, as repeated groups."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].kind == x.kind:
            out[-1] = merge(out[-1], x, True)
        else:
            out.append(x)
    for width in (2, 3):
        k = 0
        while k + 2 * width <= len(out):
            if [x.kind for x in out[k : k + width]] == [x.kind for x in out[k + width : k + 2 * width]]:
                group = [merge(a, b, True) for a, b in zip(out[k : k + width], out[k + width : k + 2 * width], strict=True)]
                n = 2
                while [x.kind for x in out[k + n * width : k + (n + 1) * width]] == [x.kind for x in group]:
                    group = [merge(a, b, True) for a, b in zip(group, out[k + n * width : k + (n + 1) * width], strict=True)]
                    n += 1
                item = Item(("#group", *(x.kind for x in group)), items=group)
                for x in group:
                    item.pages = _both(item.pages, x.pages)
                item.many = True
                out[k : k + n * width] = [item]
            k += 1
    return list(generalised(out).values()) if len(out) > MOST else out


def generalised(items: list[Item]) -> dict:
    """One repeated item of each kind, of as many kinds as there are."""
    by: dict = {}
    for x in items:
        by[x.kind] = merge(by[x.kind], x, True) if x.kind in by else x
    return by


def aligned(a: list[Item], b: list[Item], together: bool) -> list[Item]:
    """Items in order by a longest common run of kinds, or by kind alone where there are many; what only one has stays as
    it is, seen on fewer pages."""
    if [x.kind for x in a] == [x.kind for x in b]:
        return [merge(x, y, together) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    if max(n, m) > MOST:
        one, two = generalised(a), generalised(b)
        return [merge(x, two[k], together) if k in two else x for k, x in one.items()] + [x for k, x in two.items() if k not in one]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].kind == b[j].kind else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i].kind == b[j].kind:
            out.append(merge(a[i], b[j], together))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return collapsed([*out, *a[i:], *b[j:]])


#: Different pages that it takes to call a text constant.
CONSTANT_FROM = 3


class Wrapper:
    """A host's expression and up to CONSTANT_FROM hashes of different pages."""

    def __init__(self, item: Item, pages: frozenset):
        self.item, self.pages = item, pages

    @classmethod
    def of(cls, tree: Node) -> Wrapper:
        page = xxhash.xxh3_64_intdigest("\n".join(texts(tree, False) or texts(tree)).encode())
        return cls(fold(tree, (page,)), frozenset([page]))

    def with_(self, other: Wrapper) -> Wrapper:
        return Wrapper(aligned([self.item], [other.item], False)[0], frozenset(sorted(self.pages | other.pages)[:CONSTANT_FROM]))

    def dumps(self) -> bytes:
        return pickle.dumps((packed(self.item), self.pages))

    @classmethod
    def loads(cls, data: bytes) -> Wrapper:
        item, pages = pickle.loads(data)
        return cls(unpacked(item), pages)


class Evidence:
    """What a wrapper tells of places. A place is a path of labels, numbered: ``kids[place, label]``, 0 is the page.
    plain, fixed, links: characters of texts that vary, are the template's, are in links (of either)."""

    def __init__(self, wrapper: Wrapper):
        self.kids: dict[tuple[int, str], int] = {}
        self.plain, self.fixed, self.links, self.many, self.parent, self.labels = [0], [0], [0], [False], [0], [wrapper.item.kind]
        self.constants: set[tuple] = set()
        todo = [(0, x, False) for x in wrapper.item.items]
        while todo:
            place, item, many = todo.pop()
            if item.kind == "#text":
                fixed = item.text is not None and item.seen >= CONSTANT_FROM and len(wrapper.pages) >= CONSTANT_FROM
                if fixed:
                    self.constants.add((place, item.text))
                self.links[place] += item.links
                (self.fixed if fixed else self.plain)[place] += item.mass
            elif isinstance(item.kind, tuple):
                todo += [(place, x, True) for x in item.items]
            else:
                here = self.kids.get((place, item.kind))
                if here is None:
                    here = self.kids[place, item.kind] = len(self.plain)
                    for some, first in ((self.plain, 0), (self.fixed, 0), (self.links, 0), (self.many, False), (self.parent, place), (self.labels, item.kind)):
                        some.append(first)
                self.many[here] |= many or item.many
                todo += [(here, x, False) for x in item.items]
        for k in range(len(self.plain) - 1, 0, -1):  # a parent stands before its children
            for some in (self.plain, self.fixed, self.links):
                some[self.parent[k]] += some[k]

    def goes(self, place: int, node: Node) -> bool:
        """Whether an element that is perhaps something else is: mostly the template's, or mostly links."""
        if place < 0:
            inside = texts(node)
            return 2 * sum([x.links for x in inside]) > sum([len(x) for x in inside])
        mass = self.plain[place] + self.fixed[place]
        return 2 * self.fixed[place] > mass or 2 * self.links[place] > mass

    def varies(self, place: int) -> int:
        return max(0, self.plain[place] - self.links[place])


# ---- extraction


def texts(node: Node, outside: bool = True) -> list[Text]:
    """All texts in order, or those of elements that don't name themselves as not the article."""
    out: list[Text] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif outside or not x.outside:
            todo += reversed(x.kids)
    return out


#: Elements that no article is looked for in.
CLOSED = frozenset("head nav aside footer dialog menu button".split())


class Reading:
    """The main text of one page, by the evidence of its host."""

    def __init__(self, tree: Node, evidence: Evidence | None):
        self.tree = tree
        self.by = evidence or Evidence(Wrapper.of(tree))
        self.all = sum([len(x) for x in texts(tree)])
        self.dropped: set[int] = set()

    def place(self, place: int, node: Node) -> int:
        return self.by.kids.get((place, node.label), -1) if place >= 0 else -1

    def out(self, node: Node, place: int) -> bool:
        if node.outside == SURE and not (node.name == "form" and 2 * sum([len(x) for x in texts(node)]) > self.all):
            return True
        return node.outside == MAYBE and self.by.goes(place, node)

    def articles(self, closed: bool) -> list[tuple[Node, int, tuple]]:
        """Article elements in page order, with their places and enclosing elements (innermost first, linked)."""
        found, todo = [], [(self.tree, 0, ())]
        while todo:
            node, place, above = todo.pop()
            if node.article and above:
                found.append((node, place, above))
            inner = [(x, self.place(place, x), (node, above)) for x in node.kids if not isinstance(x, str) and not (self.out(x, self.place(place, x)) if closed else x.name in CLOSED or x.outside == SURE and x.article)]
            todo += reversed(inner)
        return found

    def comments(self, found: list[tuple[Node, int, tuple]]) -> None:
        """Drops articles that are readers' comments: those inside an article with text of its own, and those that
        repeat beside one that doesn't."""
        own = [x for x in found if x[0].name == "article"]
        inside = {id(n) for n, _, above in own if self.enclosing(above, {id(x[0]) for x in own})}
        single = [x for x in own if id(x[0]) not in inside and not (x[1] >= 0 and self.by.many[x[1]])]
        first = max(single, key=lambda x: (self.by.varies(x[1]) if x[1] >= 0 else 0, sum([len(t) for t in texts(x[0])])), default=None)
        others = {id(n) for n, place, _ in own if id(n) in inside or first and n is not first[0] and place >= 0 and self.by.many[place]}
        for n, _, above in own:
            if id(n) in others and not (id(n) in inside and not self.has_more(self.enclosing(above, {id(x[0]) for x in own}), others)):
                self.dropped.add(id(self.whole(n, above, others)))

    @staticmethod
    def enclosing(above: tuple, wanted: set[int]) -> Node | None:
        while above:
            node, above = above
            if id(node) in wanted:
                return node
        return None

    @staticmethod
    def has_more(node: Node, others: set[int]) -> bool:
        """Whether an element has text beside headings and the given articles."""
        todo = list(node.kids)
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                return True
            if id(x) not in others and x.name not in HEADINGS and x.outside != SURE:
                todo += x.kids
        return False

    def whole(self, node: Node, above: tuple, others: set[int]) -> Node:
        """The largest element around a comment that holds nothing but comments and headings."""
        while above and above[0] is not self.tree and not above[0].article and not self.has_more(above[0], others):
            node, above = above
        return node

    def heart(self) -> list[tuple[Node, int]]:
        """The lowest elements, of one place, that hold all text that varies and is nothing else."""
        by = self.by
        below: dict[int, list[int]] = {}
        varies = [by.varies(k) for k in range(len(by.plain))]
        for (place, _), k in by.kids.items():
            below.setdefault(place, []).append(k)
        named = [False] * len(varies)
        for k in range(1, len(varies)):
            name, *marks = by.labels[k].split(".")
            named[k] = named[by.parent[k]] or name in OUTSIDE - {"form"} or name == "header" or name not in ("html", "body") and any([suggests(x.partition("=")[2], name) == SURE for x in marks])
        mine = [0 if n else v for v, n in zip(varies, named, strict=True)]
        for k in range(len(mine) - 1, 0, -1):  # what is named as something else holds nothing
            if named[k] and not named[by.parent[k]]:
                above = by.parent[k]
                while True:
                    mine[above] -= varies[k]
                    if not above:
                        break
                    above = by.parent[above]
        place, path = 0, []
        while (full := [k for k in below.get(place, ()) if mine[k] > 0 and not by.many[k] and by.labels[k].split(".")[0] not in LEAVES]) and len(full) == 1 and mine[full[0]] >= mine[place]:
            place = full[0]
            path.append(by.labels[place])
        nodes = [(self.tree, 0)]
        for label in path:
            nodes = [(x, self.place(p, x)) for n, p in nodes for x in n.kids if not isinstance(x, str) and x.label == label and not self.out(x, self.place(p, x))] or nodes
        return nodes

    def text(self) -> str:
        found = self.articles(True) or self.articles(False)
        if found:
            self.comments(found)
            outer = {id(n) for n, _, _ in found}
            roots = [(n, place) for n, place, above in found if id(n) not in self.dropped and not self.enclosing(above, outer)]
            return "\n".join(self.taken(roots, False))
        roots = self.heart()
        return "\n".join(self.taken(roots, True) or self.taken(roots, False))

    def taken(self, roots: list[tuple[Node, int]], template: bool) -> list[str]:
        """Texts below the roots; with ``template``, without what the wrapper has as constant or as places of links."""
        out: list[str] = []
        todo: list = list(reversed(roots))
        while todo:
            node, place = todo.pop()
            if place is None:  # a text
                out.append(node)
                continue
            inner: list = []
            for x in node.kids:
                if isinstance(x, str):
                    if not (template and (place, _short(x)) in self.by.constants):
                        inner.append((x, None))
                    continue
                k = self.place(place, x)
                if id(x) not in self.dropped and not self.out(x, k) and not (template and k >= 0 and x.name not in LEAVES and 5 * self.by.links[k] > 4 * (self.by.plain[k] + self.by.fixed[k]) > 0):
                    inner.append((x, k))
            todo += reversed(inner)
        return out


def extract(tree: Node, wrapper: Wrapper | None, evidence: Evidence | None = None) -> str:
    """The main text of a page, by its host's wrapper or by the page alone."""
    return Reading(tree, evidence or (Evidence(wrapper) if wrapper else None)).text()


# ---- on tables


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of a task's pages, with their bytes."""
    #: Wrappers of 1, 2, 4 ... pages, so that a large one isn't built anew for each page.
    found: dict[str, list[tuple[int, Wrapper]]] = {}
    size: dict[str, int] = {}

    def add(some: list, made: Wrapper) -> None:
        n = 1
        while some and some[-1][0] == n:
            made, n = some.pop()[1].with_(made), 2 * n
        some.append((n, made))

    def whole(some: list) -> Wrapper:
        made = some[-1][1]
        for _, x in reversed(some[:-1]):
            made = x.with_(made)
        return made

    def out():
        task = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [pa.array(size.keys(), pa.string()), pa.array([task] * len(size), pa.int32()), pa.array([whole(found[x]).dumps() if x in found else None for x in size], pa.binary()), pa.array(size.values(), pa.int64())],
            ["host", "task", "wrapper", "bytes"],
        )

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            size[host] = size.get(host, 0) + len(page or "")
            if page:
                add(found.setdefault(host, []), Wrapper.of(parse(page)))
        if len(size) > 20_000:
            yield out()
            found.clear()
            size.clear()
    if size:
        yield out()


def _merged(table: pa.Table) -> pa.Table:
    out = None
    for x in sorted(filter(None, table.column("wrapper").to_pylist())):  # in an order that doesn't depend on when tasks end
        made = Wrapper.loads(x)
        out = made if out is None else out.with_(made)
    size = sum(table.column("bytes").to_pylist())
    return pa.table([table.column("host").slice(0, 1), table.column("task").slice(0, 1), pa.array([out and out.dumps()], pa.binary()), pa.array([size], pa.int64())], names=["host", "task", "wrapper", "bytes"])


def wrappers(pages: DataFrame, *, url_col="url", html_col="html") -> DataFrame:
    """host, wrapper (as bytes; null without a page) and bytes of all hosts of the pages."""
    kind = "host string, task int, wrapper binary, bytes long"
    rows = pages.select(F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    out = rows.mapInArrow(_infer, kind)
    for tasks in (MERGED, MERGED * MERGED, None):
        out = out.withColumn("task", F.floor(F.col("task") / tasks).cast("int") * tasks if tasks else F.lit(0)).groupBy("host", "task").applyInArrow(_merged, kind)
    return out.select("host", "wrapper", "bytes")


class Deal:
    """Which buckets a host's pages go to: one, or as many as they fill."""

    def __init__(self, hot: list[tuple[str, int]], buckets: int, bucket_bytes: int):
        made = sorted((xxhash.xxh3_64_intdigest(h), -(-n // bucket_bytes)) for h, n in hot)
        self.hosts, self.salts = np.array([x[0] for x in made], np.uint64), np.array([x[1] for x in made], np.int32)
        self.buckets = buckets

    def width(self, host: str) -> int:
        key = xxhash.xxh3_64_intdigest(host)
        k = int(np.searchsorted(self.hosts, np.uint64(key))) if len(self.hosts) else 0
        return int(self.salts[k]) if k < len(self.hosts) and int(self.hosts[k]) == key else 1

    def all(self, host: str) -> list[int]:
        first = xxhash.xxh32_intdigest(host)
        return sorted({(first + s) % self.buckets for s in range(self.width(host))})

    def of(self, host: str, page) -> int:
        return (xxhash.xxh32_intdigest(host) + xxhash.xxh32_intdigest(repr(page)) % self.width(host)) % self.buckets


def _bucketed(deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = [host_of(x) for x in batch.column(1).to_pylist()]
            # Rows of one id are told apart by their pages, so that they don't gather.
            keys = zip(hosts, batch.column(0).to_pylist(), [xxhash.xxh32_intdigest(x or b"") for x in batch.column(2).cast(pa.binary()).to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([deal.value.of(h, (i, x)) for h, i, x in keys], pa.int32()), pa.array(hosts, pa.string()), *batch.columns], ["bucket", "host", *batch.schema.names])

    return run


def _spread(deal):
    """Wrappers to each bucket that may have pages of their host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, wrapper in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                for some in (x for x in [deal.value.all(host)] if wrapper):
                    for at in range(0, len(some), 256):
                        part = some[at : at + 256]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([host] * len(part), pa.string()), pa.array([wrapper] * len(part), pa.binary())], ["bucket", "host", "wrapper"])

    return run


def _extract(left: pa.Table, right: pa.Table) -> pa.Table:
    lean()
    known = dict(zip(right.column("host").to_pylist(), right.column("wrapper").to_pylist(), strict=True)) if right.num_rows else {}
    made: dict[str, Evidence | None] = {}
    out = []
    for host, page in zip(left.column("host").to_pylist(), left.column("html").to_pylist(), strict=True):
        if host not in made:
            made[host] = Evidence(Wrapper.loads(known[host])) if host in known else None
        out.append(Reading(parse(page), made[host]).text() if page else "")
    return pa.table([left.column("page_id"), left.column("url"), left.column("host"), pa.array(out, pa.string())], names=["page_id", "url", "host", "text"])


def main_text(pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """page_id, url, host and text (the main text, empty if none) of each page."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    buckets = pieces(text_bytes(rows, "html"), bucket_bytes)
    found = saved(wrappers(pages, url_col=url_col, html_col=html_col), "wrappers")
    hot = [(r.host, r.bytes) for r in found.where(F.col("bytes") > HOT * bucket_bytes).select("host", "bytes").collect()]
    deal = pages.sparkSession.sparkContext.broadcast(Deal(hot, buckets, bucket_bytes))
    dealt = rows.mapInArrow(_bucketed(deal), f"bucket int, host string, page_id {kind}, url string, html string")
    spread = found.mapInArrow(_spread(deal), "bucket int, host string, wrapper binary")
    grouped = lambda df: df.repartitionById(buckets, "bucket").groupBy("bucket")
    return grouped(dealt).cogroup(grouped(spread)).applyInArrow(_extract, f"page_id {kind}, url string, host string, text string")
