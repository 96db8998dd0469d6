"""HTML extraction by wrapper induction.

Pages become trees of block elements; inline markup dissolves into the text of its block. All pages of a host are
aligned, and a wrapper is induced from what lies at each place over all of them:

1. A page's structure is its tree without texts, neighbouring elements of one label folded into one. The structures
   of a host are aligned with its most frequent one by simple tree matching (Yang 1991): elements of equal labels
   match if their parents do, in order, so that most elements match. What matches has the same place; the rest is
   placed by its label under its parent's place.
2. Text and link lengths are summed over all pages by host and place. From the root on, the place that holds most of
   its parent's text is followed while there is one: the last one is the host's content. Headings and paragraphs
   beside the way there belong to it; places that are mostly links on most pages do not.
3. Blocks whose text is constant, the same at one place on at least ``MIN_PAGES`` pages and on ``MIN_SHARE`` of the
   host's, are template, whatever the other pages have there; the varying slots are content. Constancy is told for
   each block and not for a folded run, by places that count siblings of one label from the first or the last.

Copies of a page are one page in all counts, so they are no evidence for each other. Sums are exact, and hosts of any
size are counted alike. Within the content, what HTML or names of classes call something else (navigation, forms,
adverts, reader comments, ...) is left out; hosts with fewer than ``MIN_PAGES`` different pages, without such a place,
or pages without it, rest on these names and on article elements alone.

Null and empty html give an empty text; pages without a host have no wrapper; equal pages give equal rows; elements
may be nested to any depth; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import map_arrow, pick, slices, texts
from meshwork.plans.staging import drop, stage

MIN_PAGES, MIN_SHARE = 3, 0.5
#: A place that holds this share of its parent's text, links aside, holds the content; from this share of links on it
#: is a menu; places of less than the last share of a host's text can't lead to the content.
DOMINANT, LINKED, SLIGHT = 0.6, 0.6, 0.01

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head noscript template select button".split())
RAW = frozenset("script style textarea title iframe noembed xmp svg math object canvas video audio".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("head nav footer aside form dialog menu search noscript template select button".split())
CLASSES = frozenset("nav navbar navigation menu masthead footer sidebar ad ads advert adverts advertisement advertising adslot promo sponsor sponsored cookie cookies consent notice notices alert popup modal newsletter subscribe share sharing social breadcrumb breadcrumbs comment comments respond disqus related recommended widget toolbar pagination pager login signup".split())
#: These names are left out only outside an article, where they are the page's own.
OUTER = frozenset("header banner side search".split())
#: A class or id is such a name alone, or after a word for where it is and before words for what holds it.
WHERE = frozenset("site page main global top bottom left right primary secondary".split())
HOLDERS = WHERE | frozenset("area bar block body box btn button buttons col column container content count form group heading icon icons inner item items label link links list outer overlay panel posts row section slot text title toggle unit wrap wrapper".split())
ROLES = frozenset("navigation contentinfo complementary search form dialog alert alertdialog menu menubar banner".split())
#: Articles of these names are none.
TEASERS = frozenset("comment comments ad ads related promo".split())
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = frozenset("ul ol dl table tbody thead tfoot div section article body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|<[!?][^>]*+>|<[/a-zA-Z!?][^>]*+\Z", re.S)
#: Names of attributes are read whole, so that neither other names nor words of values count.
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Elements that may hold the content, and ends of the way to it.
CONTAINERS = frozenset("html body div section center td tr tbody table main article".split())
ARTICLES = ("article", "main")
TEXT = "#"


class Tree:
    """Elements and text blocks of a page in page order, by position; a block's ``text`` is its text."""

    def __init__(self) -> None:
        self.tag, self.label, self.parent = ["root"], ["root"], [-1]
        self.text: list[str | None] = [None]
        self.links = [0]
        self.out, self.doubt = [False], [False]  # outside any article by HTML; by names alone

    def add(self, tag: str, label: str, parent: int, text: str | None = None, links: int = 0, out: bool = False, doubt: bool = False) -> int:
        self.tag.append(tag)
        self.label.append(label)
        self.parent.append(parent)
        self.text.append(text)
        self.links.append(links)
        self.out.append(out or self.out[parent])
        self.doubt.append(doubt)
        return len(self.tag) - 1

    def blocks(self) -> list[int]:
        return [i for i, t in enumerate(self.text) if t is not None]

    def sums(self, values: list[int]) -> list[int]:
        """Sum of each position's value and those below."""
        total = list(values)
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        return total


def _named(value: str, wanted: frozenset[str]) -> bool:
    """Whether a class or id holds one of the wanted names as a whole token."""
    for token in value.split():
        parts = [x.lower() for x in _NAME.findall(token)]
        while parts and parts[0] in WHERE:
            parts = parts[1:]
        if parts and parts[0] in wanted and all(x in HOLDERS or x in CLASSES or x in OUTER for x in parts[1:]):
            return True
    return False


@lru_cache(maxsize=4096)
def _attributes(tag: str, raw: str) -> tuple[str, bool, bool, bool, bool]:
    """Label of an element, whether it is outside any article, or so unless inside one; both by HTML, and by names alone."""
    held: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        held.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = [x.lower() for key in held if key in ("class", "id") for x in _NAME.findall(held[key])]
    label, said = f"{tag}.{'.'.join(names)}", f"{held.get('class', '')} {held.get('id', '')}"
    role = held.get("role", "").lower()
    hidden = "hidden" in held or held.get("aria-hidden", "").lower() == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
    if tag in KEPT:
        return label, hidden, False, tag == "article" and _named(said, TEASERS), False
    return label, tag in OUTSIDE or hidden or role in ROLES - {"banner"}, tag == "header" or role == "banner", _named(said, CLASSES), _named(said, OUTER)


class _Open:
    """An open element: its position and the text run that is open in it."""

    __slots__ = ("at", "links", "run", "tag")

    def __init__(self, at: int, tag: str) -> None:
        self.at, self.tag, self.run, self.links = at, tag, [], 0


def _close_run(tree: Tree, element: _Open) -> None:
    if element.run:
        text = " ".join(entities.unescape("".join(element.run)).split())
        if text:
            tree.add(TEXT, TEXT, element.at, text, min(element.links, len(text)))
        element.run, element.links = [], 0


def parse(page: str) -> Tree:
    """The tree of block elements; text runs are blocks. Scripts, styles and embedded objects are left out."""
    tree = Tree()
    stack, at, depth, link = [_Open(0, "root")], 0, 0, 0

    def close(upto: int) -> int:
        articles = 0
        while len(stack) > upto:
            gone = stack.pop()
            _close_run(tree, gone)
            articles += gone.tag in ARTICLES and not tree.out[gone.at]
        return articles

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].run.append(page[at : m.start()])
            stack[-1].links += (m.start() - at) if link else 0
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in RAW:
            if not m[1]:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            stack[-1].run.append(" ")
            continue
        if tag not in BLOCKS:
            link = (0 if m[1] else 1) if tag == "a" else link
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    depth -= close(i)
                    break
            else:
                _close_run(tree, stack[-1])
            continue
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    depth -= close(i)
                    break
                if stack[i].tag in STOPS:
                    break
        if stack[-1].tag == "p":
            close(len(stack) - 1)
        _close_run(tree, stack[-1])
        if tag == "hr":
            continue
        label, out, outer, named, named_outer = _attributes(tag, m[3])
        new = tree.add(tag, label, stack[-1].at, None, 0, out or outer and not depth, named or named_outer and not depth)
        depth += tag in ARTICLES and not tree.out[new]
        stack.append(_Open(new, tag))
    stack[-1].run.append(page[at:])
    close(0)
    return tree


def _own_chars(tree: Tree) -> list[int]:
    return [0 if t is None or out else len(t) for t, out in zip(tree.text, tree.out, strict=True)]


def named_content(tree: Tree) -> list[bool]:
    """Which positions HTML and names leave in.

    What only its names call outside stays if it holds most of the page's text, or its only article.
    """
    chars = tree.sums(_own_chars(tree))
    near = [-1] * len(tree.tag)  # closest article or doubtful element from here up
    inside, sure = [0] * len(tree.tag), 0
    for i in range(1, len(near)):
        above = near[tree.parent[i]]
        article = tree.tag[i] in ARTICLES
        near[i] = i if article or tree.doubt[i] else above
        if article and not tree.doubt[i] and not tree.out[i] and chars[i]:
            if above < 0:
                sure += 1
            elif tree.doubt[above]:
                inside[above] += 1
    kept = [True] * len(near)
    for i in range(1, len(near)):
        goes = tree.doubt[i] and 2 * chars[i] <= chars[0] and not (not sure and tree.tag[i] != "article" and inside[i] == 1)
        kept[i] = kept[tree.parent[i]] and not tree.out[i] and not goes
    return kept


def in_articles(tree: Tree, kept: list[bool]) -> list[bool]:
    """Of what is kept, what is in a kept article; all of it if there is none."""
    inside = [False] * len(kept)
    for i in range(1, len(kept)):
        inside[i] = inside[tree.parent[i]] or kept[i] and tree.tag[i] in ARTICLES
    both = [k and x for k, x in zip(kept, inside, strict=True)]
    return both if any(both[i] for i in tree.blocks()) else kept


def by_names(tree: Tree) -> list[bool]:
    """Positions that may be content by names alone: the articles of a page, or else all but lists that are mostly links."""
    kept = named_content(tree)
    found = in_articles(tree, kept)
    if found is not kept:
        return found
    own = [len(t) if t is not None and k else 0 for t, k in zip(tree.text, kept, strict=True)]
    chars, count = tree.sums(own), tree.sums([int(x > 0) for x in own])
    links = tree.sums([n if x else 0 for n, x in zip(tree.links, own, strict=True)])
    for i in range(1, len(kept)):
        menu = tree.tag[i] in ("ul", "ol") and count[i] >= 3 and links[i] >= 0.7 * chars[i]
        kept[i] = kept[i] and kept[tree.parent[i]] and not menu
    return kept


# --- places


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big")


@lru_cache(maxsize=1 << 16)
def _word(label: str) -> int:
    return _hash(label.encode("utf-8", "surrogatepass"))


def _mix(h: int, x: int) -> int:
    h = ((h ^ x) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


def _signed(numbers: list[int]) -> np.ndarray:
    return np.array(numbers, np.uint64).view(np.int64)


def keyed(tree: Tree) -> list[tuple[int, list[int]]]:
    """Each block that HTML leaves in, in page order, and its keys: its text with each way to tell its place.

    Siblings of one label are told apart from the first on, from the last on, and with the block's own element the
    other way round; neighbouring blocks with one path of labels also by their distance from either end of their
    run. So what is constant before, after or between siblings of its own label is found, however many these are.
    """
    n = len(tree.tag)
    total: dict[tuple[int, str], int] = {}
    order = [0] * n
    for i in range(1, n):
        sibling = (tree.parent[i], tree.label[i])
        order[i] = total.get(sibling, 0)
        total[sibling] = order[i] + 1
    path, first, last, up, down = ([1] * n for _ in range(5))
    rows = []
    for i in range(1, n):
        above, label = tree.parent[i], tree.label[i]
        word, a, b = _word(label), 2 * order[i], 2 * (total[above, label] - order[i]) - 1
        if tree.text[i] is None:
            path[i], head, tail = _mix(path[above], word), _mix(first[above], word), _mix(last[above], word)
            first[i], last[i], up[i], down[i] = _mix(head, a), _mix(tail, b), _mix(head, b), _mix(tail, a)
        elif not tree.out[i]:
            rows.append((path[above], i, [_mix(first[above], a), _mix(last[above], b), _mix(up[above], a), _mix(down[above], b)]))
    out = []
    for where, run in groupby(rows, lambda r: r[0]):
        own = list(run)
        for k, (_, i, places) in enumerate(own):
            said = _hash(tree.text[i].encode("utf-8", "surrogatepass"))
            places += [_mix(where, 2 * k), _mix(where, 2 * (len(own) - k) - 1)]
            out.append((i, [_mix(_mix(said, kind), place) for kind, place in enumerate(places)]))
    return out


def structure(tree: Tree) -> tuple[list[int], list[str], list[int]]:
    """A page's folded tree: where each position goes, and label and parent of each folded element, in page order.

    Neighbours of one label are one element; below several elements that became one, all of one label do.
    """
    kids: list[list[int]] = [[] for _ in tree.tag]
    for i in range(1, len(kids)):
        kids[tree.parent[i]].append(i)
    goes, labels, parents = [0] * len(kids), [], []
    todo = [([0], -1)]
    while todo:
        members, above = todo.pop()
        me = len(labels)
        labels.append(tree.label[members[0]])
        parents.append(above)
        for i in members:
            goes[i] = me
        if len(members) == 1:
            groups = [list(g) for _, g in groupby(kids[members[0]], lambda i: tree.label[i])]
        else:
            by: dict[str, list[int]] = {}
            for i in members:
                for k in kids[i]:
                    by.setdefault(tree.label[k], []).append(k)
            groups = list(by.values())
        todo += [(g, me) for g in reversed(groups)]
    return goes, labels, parents


def written(labels: list[str], parents: list[int]) -> str:
    return "\n".join(f"{p} {x}" for x, p in zip(labels, parents, strict=True))


@lru_cache(maxsize=256)
def _read(said: str) -> tuple[list[str], list[int], list[list[int]], list[int]]:
    """Labels, parents, children and sizes of a written structure."""
    rows = [line.split(" ", 1) for line in said.split("\n")]
    labels, parents = [x for _, x in rows], [int(p) for p, _ in rows]
    kids: list[list[int]] = [[] for _ in rows]
    sizes = [1] * len(rows)
    for i in range(len(rows) - 1, 0, -1):
        sizes[parents[i]] += sizes[i]
    for i in range(1, len(rows)):
        kids[parents[i]].append(i)
    return labels, parents, kids, sizes


def _matching(left: list[int], right: list[int], weight) -> list[tuple[int, int]]:  # noqa: ANN001
    """The ordered matching of two lists of children of most weight, by dynamic programming, as index pairs."""
    table = np.zeros((len(left) + 1, len(right) + 1), np.int64)
    gains = np.array([[weight(x, y) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    for i in range(len(left)):
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + gains[i]))
    i, j, found = len(left), len(right), []
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def match(said: str, reference: str) -> list[int]:
    """The element of the reference that each element of a structure matches, or -1, by simple tree matching."""
    (la, _, ka, sa), (lb, _, kb, sb) = _read(said), _read(reference)
    kinds: dict[tuple, int] = {}

    def classes(labels: list[str], kids: list[list[int]]) -> list[int]:
        """Equal trees get equal numbers."""
        out = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            out[i] = kinds.setdefault((labels[i], tuple(out[k] for k in kids[i])), len(kinds))
        return out

    ca, cb = classes(la, ka), classes(lb, kb)
    known: dict[tuple[int, int], int] = {}

    def weight(x: int, y: int) -> int:
        if ca[x] == cb[y]:
            return sa[x]
        return known[ca[x], cb[y]] if la[x] == lb[y] else 0

    def ends(x: int, y: int) -> tuple[int, int]:
        """How many children are equal trees from the first on, and from the last on: these match."""
        left, right = ka[x], kb[y]
        low = min(len(left), len(right))
        a = next((i for i in range(low) if ca[left[i]] != cb[right[i]]), low)
        b = next((i for i in range(low - a) if ca[left[-1 - i]] != cb[right[-1 - i]]), low - a)
        return a, b

    def inner(x: int, y: int) -> tuple[list[int], list[int], int]:
        a, b = ends(x, y)
        left, right = ka[x][a : len(ka[x]) - b], kb[y][a : len(kb[y]) - b]
        return left, right, sum(sa[k] for k in ka[x][:a]) + sum(sa[k] for k in ka[x][len(ka[x]) - b :])

    todo = [(0, 0)]
    while todo:
        x, y = todo[-1]
        if la[x] != lb[y] or ca[x] == cb[y] or (ca[x], cb[y]) in known:
            todo.pop()
            continue
        left, right, same = inner(x, y)
        open_ = [(p, q) for p in left for q in right if la[p] == lb[q] and ca[p] != cb[q] and (ca[p], cb[q]) not in known]
        if open_:
            todo += open_
            continue
        known[ca[x], cb[y]] = 1 + same + sum(weight(left[i], right[j]) for i, j in _matching(left, right, weight))
        todo.pop()

    out = [-1] * len(la)
    pairs = [(0, 0)]
    while pairs:
        x, y = pairs.pop()
        if ca[x] == cb[y]:
            out[x : x + sa[x]] = range(y, y + sb[y])
            continue
        out[x] = y
        a, b = ends(x, y)
        left, right, _ = inner(x, y)
        pairs += list(zip(ka[x][:a], kb[y][:a], strict=True)) + list(zip(ka[x][len(ka[x]) - b :], kb[y][len(kb[y]) - b :], strict=True))
        pairs += [(left[i], right[j]) for i, j in _matching(left, right, weight)]
    return out


def places(said: str, reference: str) -> list[int]:
    """The place of each element of a structure among those of its host."""
    labels, parents, _, _ = _read(said)
    out: list[int] = []
    for i, r in enumerate(match(said, reference)):
        out.append(_mix(17, r) if r >= 0 else _mix(out[parents[i]], _word(labels[i])))
    return out


def _tag(label: str) -> str:
    return label.partition(".")[0]


# --- wrappers


class Wrapper:
    """What a host's pages have in common: where the content is, which places are menus, and constant blocks."""

    def __init__(self, written_wrapper: str) -> None:
        place, menus, constants, self.reference = written_wrapper.split("|", 3)
        self.place = int(place) & 0xFFFFFFFFFFFFFFFF if place else None
        self.menus = {int(x) & 0xFFFFFFFFFFFFFFFF for x in menus.split(",") if x}
        self.constants = {int(x) & 0xFFFFFFFFFFFFFFFF for x in constants.split(",") if x}
        self.known: dict[str, list[bool] | None] = {}

    def content(self, said: str) -> list[bool] | None:
        """Which elements of a structure are content; none if it lacks the place where the host has it."""
        if said not in self.known:
            if len(self.known) >= 1024:
                self.known.clear()
            self.known[said] = self._content(said)
        return self.known[said]

    def _content(self, said: str) -> list[bool] | None:
        labels, parents, _, _ = _read(said)
        own = places(said, self.reference)
        if self.place is None or self.place not in own:
            return None
        n = len(own)
        inside, way, heading = [False] * n, [False] * n, [False] * n
        for i in range(n - 1, -1, -1):
            way[i] |= own[i] == self.place
            heading[i] |= _tag(labels[i]) in ("h1", "h2")
            if i:
                way[parents[i]] |= way[i]
                heading[parents[i]] |= heading[i]
        for i in range(1, n):
            above = parents[i]
            beside = way[above] and not way[i] and own[above] != self.place and (heading[i] or _tag(labels[i]) in ("p", "h3", "h4", "h5", "h6"))
            inside[i] = (inside[above] or own[i] == self.place or beside) and own[i] not in self.menus
        return inside


@lru_cache(maxsize=64)
def _load(written_wrapper: str) -> Wrapper:
    return Wrapper(written_wrapper)


def extract(page: str, wrapper: Wrapper | None = None, names: bool = True) -> str:
    """Main text of one page: its blocks, joined by an empty line. Without ``names`` only the wrapper decides, if there is one."""
    tree = parse(page)
    kept, blocks = None, tree.blocks()
    if wrapper:
        goes, labels, parents = structure(tree)
        if content := wrapper.content(written(labels, parents)):
            kept = [content[g] for g in goes]
            if names:
                kept = [a and b for a, b in zip(kept, named_content(tree), strict=True)]
                kept = in_articles(tree, kept)
            if not any(kept[i] for i in blocks):
                kept = None
    if kept is None:
        kept = by_names(tree) if names or not wrapper else [True] * len(tree.tag)
    constants = wrapper.constants if wrapper else None
    if constants:
        gone = {i for i, keys in keyed(tree) if not constants.isdisjoint(keys)}
        blocks = [i for i in blocks if i not in gone]
    return "\n\n".join(tree.text[i] for i in blocks if kept[i])


#: The key that every page has once, and what marks the key of a structure's element.
PAGE, ELEMENT = 0, 7


def _element(shape: int, i: int) -> int:
    return _mix(_mix(ELEMENT, shape), i)


FACTS = "host bigint, page bigint, keys array<bigint>, chars array<int>, links array<int>, shape bigint, said string"


def facts(rows: DataFrame) -> DataFrame:
    """Of each page, keys of its constant candidates and of its structure's elements with their lengths of text.

    A structure is written once a task, in a row of its own. Equal pages of a host have rows of equal ``page``.
    """
    names = [x.split(" ")[0] for x in FACTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in slices(batches):
            out = []
            for host, page in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                tree = parse(page)
                goes, labels, parents = structure(tree)
                said = written(labels, parents)
                shape = _word(said)
                chars, links = [0] * len(labels), [0] * len(labels)
                for i in tree.blocks():
                    chars[goes[i]] += len(tree.text[i])
                    links[goes[i]] += tree.links[i]
                for i in range(len(labels) - 1, 0, -1):
                    chars[parents[i]] += chars[i]
                    links[parents[i]] += links[i]
                blocks = keyed(tree)
                same = shape
                for _, keys in blocks:
                    same = _mix(same, keys[0])
                constant = sorted({PAGE}.union(*(keys for _, keys in blocks)))
                full = [i for i, n in enumerate(chars) if n]
                keys = _signed(constant + [_element(shape, i) for i in full]).tolist()
                none = [0] * len(constant)
                shown = int(_signed([shape])[0])
                out.append((host, int(_signed([same])[0]), keys, none + [min(chars[i], 2**31 - 1) for i in full], none + [min(links[i], 2**31 - 1) for i in full], shown, None))
                if (host, shape) not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add((host, shape))
                    out.append((host, int(_signed([_element(shape, 0)])[0]), [], [], [], shown, said))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.where("host is not null and html is not null").select("host", "html").mapInArrow(run, FACTS).dropDuplicates(["host", "page"])


def _aligned(shapes: DataFrame) -> DataFrame:
    """(host, key, place, above, tag) of each element of each structure, rows (host, shape, said, reference)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=64):
            for host, shape, said, reference in zip(*(c.to_pylist() for c in part.columns), strict=True):
                labels, parents, _, _ = _read(said)
                own = places(said, reference)
                shape &= 0xFFFFFFFFFFFFFFFF
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(own), host)),
                    pa.array(_signed([_element(shape, i) for i in range(len(own))])),
                    pa.array(_signed(own)),
                    pa.array(_signed([own[p] if p >= 0 else 0 for p in parents])),
                    pa.array([_tag(x) for x in labels]),
                ], ["host", "key", "place", "above", "tag"])

    return shapes.mapInArrow(run, "host bigint, key bigint, place bigint, above bigint, tag string")


def content_place(found: list[tuple[int, int, str, int]]) -> int | None:
    """Follow the place with most of the text, links aside, among places (place, above, tag, text); none if it is the root."""
    by: dict[int, list[tuple[int, int, str]]] = {}
    for place, above, tag, text in found:
        by.setdefault(above, []).append((text, place, tag))
    (total, at, tag), way = max(by[0]), 0
    while tag not in ARTICLES and at in by:
        text, place, tag = max(by[at])
        if tag not in CONTAINERS or text < DOMINANT * total:
            break
        total, at, way = text, place, way + (tag not in ("html", "body"))
    return at if way else None


def _content_places(places_of_hosts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [content_place([(p["place"], p["above"], p["tag"], p["text"]) for p in own]) for own in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["_h", "content"])

    return places_of_hosts.mapInArrow(run, "_h bigint, content bigint")


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host with enough pages, as :class:`Wrapper` reads it; hosts are the hashes in column ``host``.

    Counts are sums by host and key, so a large host is spread like many small ones. What meets at a host is its
    reference, its menus, its constant blocks (at most twice the blocks of a page) and places that hold at least
    ``SLIGHT`` of its text.
    """
    found = stage(facts(pages), "facts")
    exploded = found.where("said is null").select("host", F.explode(F.arrays_zip("keys", "chars", "links")).alias("x")).select("host", "x.*")
    counts = exploded.groupBy("host", F.col("keys").alias("key")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    counts = stage(counts.where((F.col("n") >= MIN_PAGES) | (F.col("chars") > 0)), "counts", narrow=True)
    sizes = stage(counts.where((F.col("key") == PAGE) & (F.col("chars") == 0)).select(F.col("host").alias("_h"), F.col("n").alias("pages")), "sizes", narrow=True)

    at_host = lambda df: df.join(sizes, F.col("host") == F.col("_h")).drop("_h")
    popular = at_host(found.where("said is null").groupBy("host", "shape").agg(F.count("*").alias("n")))
    shapes = found.where("said is not null").select("host", "shape", "said")
    shapes = stage(popular.join(shapes, ["host", "shape"]).select("host", "shape", "said", "n"), "shapes")
    reference = stage(shapes.groupBy(F.col("host").alias("_h")).agg(F.max_by("said", F.struct("n", F.length("said"), "shape")).alias("reference")), "references", narrow=True)
    aligned = _aligned(shapes.join(reference, F.col("host") == F.col("_h")).select("host", "shape", "said", "reference"))
    sums = aligned.join(counts.where("chars > 0"), ["host", "key"]).groupBy("host", "place", "above", "tag").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")])
    sums = stage(sums.withColumn("text", F.col("chars") - F.col("links")), "places", narrow=True)

    whole = sums.where("above = 0").groupBy(F.col("host").alias("_w")).agg(F.max("text").alias("total"))
    heavy = sums.join(whole, F.col("host") == F.col("_w")).where((F.col("above") == 0) | (F.col("text") > SLIGHT * F.col("total")))
    content = _content_places(heavy.groupBy("host").agg(F.collect_list(F.struct("place", "above", "tag", "text")).alias("all")))
    enough = F.col("n") >= MIN_SHARE * F.col("pages")
    listed = F.col("tag").isin("ul", "ol", "div", "section", "table", "td", "tr", "tbody", "dl", "menu", "nav", "aside", "footer", "header")
    menus = at_host(sums.where(listed & (F.col("links") >= LINKED * F.col("chars")) & (F.col("n") >= MIN_PAGES))).where(enough)
    constants = at_host(counts.where((F.col("chars") == 0) & (F.col("key") != PAGE))).where(enough)
    listing = lambda df, c, name: df.groupBy(F.col("host").alias(f"_{name}")).agg(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(name))
    out = reference.withColumnRenamed("_h", "host")
    for part, key in ((content, "_h"), (listing(menus, "place", "menus"), "_menus"), (listing(constants, "key", "constants"), "_constants")):
        out = out.join(part, F.col("host") == F.col(key), "left").drop(key)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = stage(out.select("host", F.concat_ws("|", blank("content"), blank("menus"), blank("constants"), "reference").alias("wrapper")), "wrappers", narrow=True)
    for done in (found, counts, sizes, shapes, reference, sums):
        drop(done)
    return out


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", names: bool = True) -> DataFrame:
    """Per page: page_id, url, text, n_chars, and whether a wrapper was used.

    Wrappers reach the pages by an equality join on the host: Spark broadcasts them below its size limit, and
    beyond it joins by sorting, where adaptive execution splits a hot host.
    """
    rows = pick(pages, page_id=page_id, url=url, html=html)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = rows.withColumn("host", F.when(host != "", F.xxhash64(host)))
    wrappers = induce(rows).withColumnRenamed("host", "_host")
    both = rows.join(wrappers, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "wrapper")
    kind = both.schema["page_id"].dataType.simpleString()

    def step(part: pa.RecordBatch) -> dict:
        made = [extract(p, _load(w) if w else None, names) if p else "" for p, w in zip(texts(part.column(2)), part.column(3).to_pylist(), strict=True)]
        return {"page_id": part.column(0), "url": part.column(1), "text": pa.array(made, pa.string()), "n_chars": pa.array([len(x) for x in made], pa.int64()), "wrapped": part.column(3).is_valid()}

    return map_arrow(both, f"page_id {kind}, url string, text string, n_chars bigint, wrapped boolean", step)
