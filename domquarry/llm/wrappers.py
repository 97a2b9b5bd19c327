"""Main text of web pages by wrappers: union-free regular expressions per host.

A page becomes a stream of block tags and text; its skeleton is that stream as a
tree, with runs of equal siblings folded into repeated groups.  Skeletons of one
host are aligned one after another: what matches stays, what only one side has
becomes an optional group, what repeats becomes a repeated group.  Texts are tokens as
well: aligned texts that differ become a slot, texts that are equal everywhere stay
the wrapper's own, and both remember how much text there was.  The result is the
host's wrapper, a regular expression without unions.  Its content region is the
article element, else the main element, else the deepest container that holds
all of the text that is not left out; navigation, headers and footers of the page, sidebars, notices,
adverts, forms, comments and the like are left out by tag and by class, id or
role.  A mark by class, id or role is no more than a sign: where the wrapper shows
that the marked element has the host's articles or most of its text, it is kept.
A page gives the text that it puts into the slots of the region: all text of its nodes at the
region's place, without the texts that are the wrapper's own (the same words in the same
place on every page of a host that has ``MIN_PAGES`` different ones at least).

Skeletons are counted per task before they are shuffled, and a host's distinct
skeletons are merged in a tree, ``FAN_IN`` at a time, so a hot host is no single task's.  Pages are
read at every depth.  Wrappers have block elements ``MAX_DEPTH`` deep at most, and
below them article, main and marked elements, ``MAX_DEPTH`` more at most; the text
of all others below counts to the node above them.

Results for odd input: null or empty html gives an empty text; text without any
markup is the page's text; a null or odd url belongs to the host ""; a page
whose text at the region's place is missing, empty or a small share of its text is
read by a wrapper of its own (see ``text_by``); repeated rows give a row each; an empty table gives no row.
"""

from __future__ import annotations

import html as entities
import json
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domquarry.llm.common import save

MAX_DEPTH = 48
#: Skeletons of one host that a task merges, about.
FAN_IN = 256
#: Different pages of a host from which a text that all of them have is the wrapper's own.
MIN_PAGES = 5
#: The mark of a slot: texts in this place differ.
SLOT = "*"

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset(
    "head nav header footer aside form menu dialog button select input label fieldset datalist object canvas svg "
    "audio video map search".split()) | RAW
#: Start tags that end an open element of these names, up to the nearest of the last set.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
          "option": "option", "optgroup": "option optgroup", "thead": "tr td th tbody thead tfoot",
          "tbody": "tr td th tbody thead tfoot", "tfoot": "tr td th tbody thead tfoot"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
SCOPES = frozenset("ul ol dl table select html body div article section main aside td th".split())
P_ENDS = BLOCKS - frozenset("br option optgroup caption td th tr tbody thead tfoot head html body title dd dt li".split())
#: Blocks of text: a region is their container, never one of them.
TEXT_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd table thead tbody tfoot tr td th caption pre blockquote "
    "figure figcaption address details summary".split())
#: Words of class, id or role that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices alert newsletter subscribe subscription signup sidebar sidebars side widget widgets menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies share "
    "sharing social related recommended recommendations login modal popup overlay toolbar pagination pager skip "
    "complementary contentinfo search adsbygoogle copyright gdpr".split())
HEADER_WORDS = frozenset("header topbar".split())
#: Words that may stand beside a mark in one name: "share-bar" is a mark, "social-sciences" and "no-sidebar" are not.
BESIDE = HEADER_WORDS | frozenset(
    "area bar block blocks body bottom box boxes btn button buttons card cards col column container content cta "
    "desktop element entry fixed float floating foot form global group head icon icons inner item items left link "
    "links list lists lower main message middle mobile module news outer page pages panel post posts primary region "
    "right row secondary section sections site slot sticky sub tag tags text title tool tools top unit units upper "
    "wp wrap wrapper".split())
#: Marks that are none inside an article, unless with another mark: notes and columns of the article itself.
OUTSIDE_ONLY = frozenset("notice notices alert side search".split())
#: Share of the text (of an article, or of all) above which a marked element is kept.
KEPT_SHARE = 0.6
#: Least share of the text not left out that an article or main element holds as a
#: page's region, and least share of a page's text that marks may leave.
LEAST_SHARE, LEAST_LEFT = 0.5, 0.1
#: Inside an article these are not judged by their id, which names a place in it.
UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: The end of a marked element's key.
SIGN = "!"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes)\b"
    r"(?>[^>\"']+|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|[^<]+|<", re.S | re.I)
#: An attribute's name and value (in quotes or not), or a quoted string without a name.
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?|\"[^\"]*\"|'[^']*'")
MARKING = frozenset("class id role itemprop".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def host_of(url: Column) -> Column:
    """The host in lower case, "" where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


class Page:
    """Block elements of a page in document order, with the text among them.

    ``parent``, ``key`` (tag and words, ``SIGN`` at the end of a marked one's),
    ``out`` (left out by tag or hidden) per node;
    ``text``: (node, string) in order, where a block's start and end is a space."""

    def __init__(self, html: str | None):
        self.parent, self.key, self.out, self.text = [-1], [""], [False], []
        self.article = [False]  # whether the node is an article or inside one
        self.stored, self.level = [0], [0]  # the nearest node in the skeleton, itself or above, and its depth
        stack = [("", 0)]  # open elements: name, node; -1 in what is left out among inline elements
        for m in TOKEN.finditer(html or ""):
            token, node = m[0], stack[-1][1]
            if token[0] != "<" or token == "<":
                if node >= 0:
                    self.text.append((node, token))
                continue
            name = m["name"] or m["name2"]
            if not name:
                continue
            name = name.lower()
            block = name in BLOCKS
            if m["end"] or m["end2"]:
                self._end(stack, name, block)
                node = stack[-1][1]
            else:
                self._implied_ends(stack, name)
                node = stack[-1][1]
                if name not in VOID:
                    if block:
                        stack.append((name, self._open(node, name, m["attrs"] or "")))
                    elif name in LEFT_OUT:
                        stack.append((name, -1))
                    else:
                        stack.append((name, self._inline(node, name, m["attrs"] or "")))
            if block and node >= 0:
                self.text.append((node, " "))

    @staticmethod
    def _end(stack: list, name: str, block: bool) -> None:
        """Closes the nearest open element of that name; an inline one only up to the nearest block."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if not block and stack[i][0] in BLOCKS:
                return

    @staticmethod
    def _implied_ends(stack: list, name: str) -> None:
        ends = CLOSES.get(name)
        if name in P_ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
        elif ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    at = i
                    while at > 1 and stack[at - 1][0] in ends:
                        at -= 1
                    del stack[at:]
                    break
                if stack[i][0] in SCOPES - ends:
                    break

    @staticmethod
    def _marks(name: str, attrs: str, article: bool) -> tuple[str, bool, bool, bool]:
        """Key words of an element's attributes, whether it is hidden, whether a
        word marks it, and whether one calls it a header."""
        words, hidden, signs, header = [], False, set(), False
        for kind, value in ATTRIBUTE.findall(attrs):
            kind = kind.lower()
            if kind == "hidden":
                hidden = True
            elif kind in MARKING:
                judged = kind != "id" or not (article and name in UNNAMED)
                for one in value.strip("\"'").split():
                    of_one = WORDS.findall(CAMEL.sub(" ", one).lower())
                    words += of_one
                    if judged and all(w in MARKED or w in BESIDE or len(w) == 1 for w in of_one):
                        signs |= MARKED.intersection(of_one)
                        header |= not HEADER_WORDS.isdisjoint(of_one)
        if article and signs <= OUTSIDE_ONLY:
            signs = set()
        free = name in ("html", "body", "article", "main")
        return ".".join(sorted(set(words))), hidden and not free, bool(signs) and not free, header and not free

    def _open(self, parent: int, name: str, attrs: str) -> int:
        if parent < 0:
            return -1
        article = self.article[parent]
        marks, out, marked, header = self._marks(name, attrs, article) if attrs else ("", False, False, False)
        if name == "header":  # the heading block of an article is part of it
            out |= not article
        else:
            out |= name in LEFT_OUT
            marked |= header and not article
        return self._node(parent, name, marks, out, marked)

    def _node(self, parent: int, name: str, marks: str, out: bool, marked: bool) -> int:
        i, level = len(self.parent), self.level[parent] + 1
        stored = level <= MAX_DEPTH or level <= 2 * MAX_DEPTH and (marked or name in ("article", "main"))
        self.parent.append(parent)
        self.key.append((f"{name}.{marks}" if marks else name) + (SIGN if marked else ""))
        self.out.append(out)
        self.article.append(self.article[parent] or name == "article")
        self.stored.append(i if stored else self.stored[parent])
        self.level.append(level if stored else level - 1)
        return i

    def _inline(self, parent: int, name: str, attrs: str) -> int:
        """Where an inline element's text belongs: only a marked one is a node of its own."""
        if parent < 0 or not attrs:
            return parent
        words, hidden, marked, _ = self._marks(name, attrs, self.article[parent])
        if hidden or not marked:
            return -1 if hidden else parent
        return self._node(parent, name, words, False, True)

    def skeleton(self) -> list:
        """[key, least, most, characters, children, text]: see ``fold``; ``text`` is the hash of the node's own
        text, "" without one."""
        gone = [False] * len(self.key)
        for i in range(1, len(gone)):
            gone[i] = self.out[i] or gone[self.parent[i]]
        size = [0] * len(self.key)
        for node, text in self.text:
            if node >= 0 and not gone[node]:
                size[self.stored[node]] += 0 if text.isspace() else len(text)
        nodes = [[k, 1, 1, n, [], t] for k, n, t in zip(self.key, size, self.own_texts(gone))]
        for i in range(1, len(nodes)):
            if not gone[i] and self.stored[i] == i:
                nodes[self.stored[self.parent[i]]][4].append(nodes[i])
        for node in reversed(nodes):  # children stand after their parent
            node[4] = fold(node[4])
        return nodes[0]

    def own_texts(self, gone: list[bool]) -> list[str]:
        """The hash of the text that stands in each node itself, white space aside; "" where there is none."""
        parts: list[list[str]] = [[] for _ in self.key]
        for node, text in self.text:
            if node >= 0 and not gone[node] and not text.isspace():
                parts[self.stored[node]].append(text)
        return [blake2b(" ".join(" ".join(p).split()).encode("utf-8", "replace"), digest_size=8).hexdigest() if p else ""
                for p in parts]

    def places(self) -> list[tuple]:
        """The keys from the root to each node, as in the skeleton; a node that is
        not in it has none."""
        place = [()] * len(self.key)
        for i in range(1, len(self.key)):
            place[i] = (*place[self.stored[self.parent[i]]], self.key[i]) if self.stored[i] == i else None
        return place

    def gone(self, place: list[tuple], keep: list | None) -> list[bool]:
        """Whether a node is left out; marked ones at a place of ``keep`` are not, None: none is."""
        kept, gone = {tuple(r) for r in keep or ()}, [False] * len(self.key)
        for i in range(1, len(self.key)):
            gone[i] = gone[self.parent[i]] or self.out[i] or (
                keep is not None and self.key[i][-1] == SIGN and place[self.stored[i]] not in kept)
        return gone

    def texts(self, region: dict) -> str | None:
        """The text of the nodes at one of the places (see ``region_of``); None if
        there are none."""
        place = self.places()
        inside = self.inside(region, place, self.gone(place, region["keep"]))
        return self.joined(inside) if any(inside) else None

    def inside(self, region: dict, place: list[tuple], gone: list[bool]) -> list[bool]:
        paths, inside = {tuple(r) for r in region["places"]}, [False] * len(self.key)
        for i in range(len(self.key)):
            inside[i] = not gone[i] and (i > 0 and inside[self.parent[i]] or place[i] in paths)
        return inside

    def slots(self, inside: list[bool], region: dict, place: list[tuple]) -> list[bool]:
        """``inside`` without the nodes whose text is the wrapper's own."""
        fixed = {(tuple(path), text) for path, text in region.get("fixed", ())}
        if not fixed:
            return inside
        left_out = [not x for x in inside]
        own = self.own_texts(left_out)
        kept = [x and (place[self.stored[i]], own[self.stored[i]]) not in fixed for i, x in enumerate(inside)]
        return kept if self.amount(kept) else inside

    def amount(self, wanted: list[bool]) -> int:
        return sum(len(t) for node, t in self.text if node >= 0 and wanted[node] and not t.isspace())

    def joined(self, inside: list[bool]) -> str:
        # the end of a block counts to its parent: outside the region it only ends the text there
        parts = [t if node >= 0 and inside[node] else " " for node, t in self.text
                 if node >= 0 and (inside[node] or t == " ")]
        return " ".join(entities.unescape("".join(parts)).split())

    def text_by(self, region: dict | None) -> str:
        """The page's text by its host's region, or by its own where there is none,
        where the marks leave under ``LEAST_LEFT`` of the text, or where the region
        has no text or under ``LEAST_SHARE`` of what the marks leave; all that they
        leave if its own region has no more."""
        place = self.places()
        everything = self.amount([not x for x in self.gone(place, None)])
        for last in (False, True):
            if last:
                region = region_of(self.skeleton())
            elif not region:
                continue
            gone = self.gone(place, region["keep"])
            inside = self.inside(region, place, gone)
            left, there = self.amount([not x for x in gone]), self.amount(inside)
            if there and there >= LEAST_SHARE * left and (last or left >= LEAST_LEFT * everything):
                return self.joined(self.slots(inside, region, place))
        return self.joined([not x for x in gone])


def merge(a: list, b: list) -> list:
    """Two nodes of one key as one: text adds up, children are aligned."""
    return [a[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], align(a[4], b[4]), a[5] if a[5] == b[5] else SLOT]


def alike(a: list, b: list) -> bool:
    """Whether two nodes can be repeats of one: of one key, and, but for blocks of text, with text or
    children of their own where the other has them."""
    return a[0] == b[0] != "()" and (a[0].split(".")[0].rstrip(SIGN) in TEXT_BLOCKS or (
        bool(a[4]), bool(a[5])) == (bool(b[4]), bool(b[5])))


def fold(nodes: list) -> list:
    """Repeats side by side become one repeated node; repeats of a few nodes in
    turn become a repeated group (key "()")."""
    out: list = []
    for node in nodes:
        if out and alike(out[-1], node):
            out[-1] = merge(out[-1], node)
            out[-1][2] = 2
        else:
            out.append(node)
    for width in (2, 3, 4):
        i = 0
        while i + 2 * width <= len(out):
            group, j = out[i:i + width], i + width
            while len(out) - j >= width and all(map(alike, group, out[j:j + width])):
                group = [merge(x, y) for x, y in zip(group, out[j:j + width])]
                j += width
            if j > i + width:
                out[i:j] = [["()", 1, 2, 0, group, ""]]
            i += 1
    return out


def align(a: list, b: list) -> list:
    """Siblings of two skeletons as one list: the longest common subsequence of
    keys matches, the rest becomes optional."""
    if [n[0] for n in a] == [n[0] for n in b]:
        return [merge(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], 0, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], 0, *b[j][2:]])
            j += 1
    return fold(out)


def shape(node: list) -> list:
    """A skeleton without its amounts of text."""
    return [*node[:3], 0, [shape(c) for c in node[4]]]


def amounts(node: list) -> list[int]:
    return [node[3], *(x for c in node[4] for x in amounts(c))]


def own_texts(node: list) -> list[str]:
    return [node[5], *(x for c in node[4] for x in own_texts(c))]


def filled(node: list, numbers, texts=None) -> list:
    """``shape`` with amounts and texts again, from iterators; slots without ``texts``."""
    n, text = next(numbers), next(texts) if texts else SLOT
    return [*node[:3], n, [filled(c, numbers, texts) for c in node[4]], text]


def expression(node: list, fixed: bool = False) -> str:
    """The wrapper as text: <tag ...>, # for text (a slot; = for the wrapper's own, with ``fixed``),
    ? for optional, + for repeated."""
    text = "" if not node[3] else "=" if fixed and node[5] != SLOT else "#"
    inner = text + " ".join(expression(c, fixed) for c in node[4])
    body = f"({inner})" if node[0] == "()" else f"<{node[0]}>{inner}</>" if node[0] else inner
    return body + ("+" if node[2] > 1 else "") + ("?" if node[1] == 0 else "")


def fixed_texts(wrapper: list) -> list:
    """[keys from the root, text] of the texts that every page has in the same place."""
    found, todo = [], [(wrapper, ())]
    while todo:
        node, path = todo.pop()
        if node[5] not in ("", SLOT):
            found.append([list(path), node[5]])
        todo += [(c, path if c[0] == "()" else (*path, c[0])) for c in node[4] if c[1]]
    return sorted(found)


def region_of(wrapper: list, least: float = LEAST_SHARE) -> dict:
    """``places`` of the content region and of marked elements to ``keep``, each a
    list of keys from the root.  Articles with less than ``least`` of the text that
    is not left out are no region."""
    nodes, up, place = [wrapper], [-1], [()]
    for i, node in enumerate(nodes):  # grows as it goes: children stand after their parent
        for child in node[4]:
            nodes.append(child)
            up.append(i)
            place.append(place[i] if child[0] == "()" else (*place[i], child[0]))
    signed = [n[0][-1:] == SIGN for n in nodes]

    def totals(left_out):
        sums = [0 if gone else n[3] for n, gone in zip(nodes, left_out)]
        for i in range(len(nodes) - 1, 0, -1):
            sums[up[i]] += 0 if left_out[i] else sums[i]
        return sums

    def inherited(of_one):
        flags = list(of_one)
        for i in range(1, len(nodes)):
            flags[i] = flags[i] or flags[up[i]]
        return flags

    everything = totals([False] * len(nodes))
    in_marked = inherited(signed)

    def outermost(name, marked):
        named = [n[0].split(".")[0] == name for n in nodes]
        over = inherited(named)
        return [i for i in range(1, len(nodes)) if named[i] and not over[up[i]] and everything[i]
                and in_marked[i] == marked]

    def kept_with(chosen):
        """Places of marked elements to keep for a region, and the text that is then left."""
        tops = set(chosen or [0])
        scope = inherited([i in tops for i in range(len(nodes))])
        most = KEPT_SHARE * sum(everything[i] for i in tops)
        keep = {place[i] for i in range(len(nodes)) if signed[i] and scope[i] and everything[i] > most}
        for i in chosen:
            while i > 0:
                if signed[i]:
                    keep.add(place[i])
                i = up[i]
        return keep, totals(inherited([s and place[i] not in keep for i, s in enumerate(signed)]))

    for marked in (False, True):
        for name in ("article", "main"):
            chosen = outermost(name, marked)
            if chosen:
                keep, kept = kept_with(chosen)
                chosen = [i for i in chosen if kept[i]]
                if chosen and sum(kept[i] for i in chosen) >= (LEAST_SHARE if marked else least) * kept[0]:
                    return {"places": [list(p) for p in dict.fromkeys(place[i] for i in chosen)],
                            "keep": sorted(map(list, keep))}
    keep, kept = kept_with([])
    found = {"keep": sorted(map(list, keep))}
    at = 0
    while True:  # a step leaves no text behind but what is left out
        step = [i for i in range(at + 1, len(nodes)) if up[i] == at and kept[i]]
        if nodes[at][3] or len(step) != 1 or nodes[step[0]][0].split(".")[0] in TEXT_BLOCKS:
            return {"places": [list(place[at])], **found}
        at = step[0]


class _Sums(dict):
    """(host, shape) -> amounts, texts (a slot where they differ), pages, and hashes of different pages, as
    many as ``MIN_PAGES``; all added up."""

    def add(self, key, numbers: list, texts: list, pages: int, kinds: list) -> None:
        old = self.get(key)
        self[key] = (numbers, texts, pages, kinds) if old is None else (
            [x + y for x, y in zip(old[0], numbers)], [x if x == y else SLOT for x, y in zip(old[1], texts)],
            old[2] + pages, _kinds(old[3] + kinds))


def _kinds(hashes: list[str]) -> list[str]:
    return sorted(set(hashes))[:MIN_PAGES]


WRAPPED = "host string, shape string, amounts array<bigint>, texts array<string>, pages long, kinds array<string>"


def _rows(found: _Sums) -> pa.Table:
    columns = list(zip(*((*k, *v) for k, v in found.items()))) or [()] * 6
    types = pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)],
                    ["host", "shape", "amounts", "texts", "pages", "kinds"])


def _skeletons(batches):
    """The rows of a task's pages, added up."""
    found = _Sums()
    for batch in batches:
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            page = Page(html.as_py())
            tree = page.skeleton()
            kind = blake2b("".join(t for _, t in page.text).encode("utf-8", "replace"), digest_size=8).hexdigest()
            found.add((host, json.dumps(shape(tree))), amounts(tree), own_texts(tree), 1, [kind])
            if len(found) >= 2000:
                yield from _rows(found).to_batches()
                found = _Sums()
    yield from _rows(found).to_batches()


def _merged(table: pa.Table) -> pa.Table:
    """One wrapper of a group's skeletons, the most frequent first."""
    sums, host = _Sums(), table["host"][0].as_py()
    for text, *values in zip(*(table[c].to_pylist() for c in ("shape", "amounts", "texts", "pages", "kinds"))):
        sums.add((host, text), *values)
    wrapper, total, different = None, 0, []
    for (_, text), (numbers, texts, pages, kinds) in sorted(sums.items(), key=lambda x: (-x[1][2], x[0])):
        tree = filled(json.loads(text), iter(numbers), iter(texts))
        wrapper, total, different = merge(wrapper, tree) if wrapper else tree, total + pages, _kinds(different + kinds)
    return _rows(_Sums({(host, json.dumps(shape(wrapper))): (amounts(wrapper), own_texts(wrapper), total, different)}))


def _regions(batches):
    for batch in batches:
        out = []
        for host, text, numbers, texts, pages, kinds in zip(*(c.to_pylist() for c in batch.columns)):
            wrapper = filled(json.loads(text), iter(numbers), iter(texts))
            many = len(kinds) >= MIN_PAGES
            region = region_of(wrapper, 0) | {"fixed": fixed_texts(wrapper) if many else []}
            out.append((host, expression(wrapper, many), json.dumps(region), pages))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["host", "wrapper", "region", "pages"])


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, region, pages: one wrapper per host, from all its pages."""
    some = save(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_skeletons, WRAPPED), "skeletons")
    while True:
        # groups of some FAN_IN skeletons of a host, until every host is one group
        count = some.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = count.agg(F.max("n")).first()[0] or 0
        dealt = some.join(count, "host").withColumn("part", F.pmod(F.xxhash64("shape"), F.ceil(F.col("n") / FAN_IN)))
        some = save(dealt.drop("n").groupBy("host", "part").applyInArrow(_merged, WRAPPED), "merged")
        if most <= FAN_IN:
            return some.mapInArrow(_regions, "host string, wrapper string, region string, pages long")


def _read(batches):
    for batch in batches:
        texts = []
        for html, region in zip(batch.column("html").to_pylist(), batch.column("region").to_pylist()):
            texts.append(Page(html).text_by(json.loads(region) if region else None))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars per row of ``pages`` (page_id, url, html)."""
    rules = save(wrappers(pages), "wrappers").select("host", "region")
    asked = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return asked.join(rules, "host", "left").select("page_id", "url", "html", "region").mapInArrow(_read, schema)
