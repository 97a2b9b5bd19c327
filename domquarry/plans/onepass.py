"""All selectors of a template at once: one automaton over the elements of a page.

A selector is a chain of steps.  The steps of all selectors get one bit each in a
whole number, a chain's steps next to each other, and a page is read once in document
order.  The bits of a node say which steps end at it:

    from the parent's bits (child), the bits of all open elements (descendant), those of
    the previous sibling (``+``) or of all earlier ones (``~``), each shifted by one step,
    and only where the node passes the step's own test.

So the work of a page grows with its elements and with the steps that can be under way
there, not with elements times selectors: steps are found through the node's tag, id, classes
and attribute names.  ``:has`` and paths inside tests are node sets, computed backwards
(last step first) once per page when a node asks for them; positions after other tests number the
survivors under each parent.  Nothing here needs a node's list of ancestors.

Selectors that walk up (``ancestor``, ``parent``, ``preceding-sibling``) raise ``SelectorError``;
the joins of ``plans.compile`` take them.  Tests mean what they mean there.
"""

from __future__ import annotations

import re

from ..functions.htmltree import parse_page
from .ast import Chain, Compound, SelectorError, SelectorList
from .compile import _Flags, _by_position, _needs_flags, _uses_position

_BLANK = " \t\n\x0b\f\r"
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]?")

# Axes by where the bits before a step are read.
_FROM_PARENT, _FROM_OPEN, _FROM_PREVIOUS, _FROM_EARLIER, _FROM_SELF = range(5)
_SOURCES = {
    "child": (_FROM_PARENT,), "desc": (_FROM_OPEN,), "desc-or-self": (_FROM_OPEN, _FROM_SELF), "self": (_FROM_SELF,),
    "adjacent": (_FROM_PREVIOUS,), "sibling": (_FROM_EARLIER,), "following-sibling": (_FROM_EARLIER,),
}
_ANYWHERE, _AT_ROOT = ("desc", "desc-or-self", "self"), ("child", "root-child")


class Page:
    """The elements of one page, by node id (0 is the document)."""

    def __init__(self, html: str | None):
        rec = parse_page(html)
        self.n = len(rec["node_id"])
        self.tag, self.parent, self.ids = rec["tag"], rec["parent_id"], rec["elem_id"]
        self.classes, self.attrs = rec["classes"], [dict(a) for a in rec["attrs"]]
        self.own, self.html, self.doc_text = rec["own_text"], html or "", rec["doc_text"][0]
        self.text_span = list(zip(rec["text_start"], rec["text_end"]))
        self.html_span = list(zip(rec["html_start"], rec["html_end"]))
        self.ordinal, self.n_sib = rec["ordinal"], rec["n_sib"]
        self.type_ordinal, self.type_count = rec["type_ordinal"], rec["type_count"]
        self._sets: dict = {}

    def text(self, i: int) -> str:
        start, end = self.text_span[i]
        return self.doc_text[start:end]

    def outer_html(self, i: int) -> str:
        start, end = self.html_span[i]
        return self.html[start:end]

    def nodes_of(self, owner, make) -> set:
        """The node set that ``owner`` (a test or selector) stands for on this page."""
        if id(owner) not in self._sets:
            self._sets[id(owner)] = make(self)
        return self._sets[id(owner)]


# -- tests on one node: (page, node, position, last) -> bool ----------------------

def _nth_test(kind: str, a: int, b: int):
    def holds(page, i, pos, last):
        if kind == "child":
            at = page.ordinal[i]
        elif kind == "last-child":
            at = page.n_sib[i] - page.ordinal[i] + 1
        elif kind == "type":
            at = page.type_ordinal[i]
        else:
            at = page.type_count[i] - page.type_ordinal[i] + 1
        return at == b if a == 0 else (at - b) % abs(a) == 0 and (at - b) / a >= 0
    return holds


def _attr_test(name: str, op: str | None, val: str | None):
    tests = {
        None: lambda v: v is not None,
        "=": lambda v: v is not None and v == val,
        "!=": lambda v: v is None or v != val,
        "^=": lambda v: bool(val) and v is not None and v.startswith(val),
        "$=": lambda v: bool(val) and v is not None and v.endswith(val),
        "*=": lambda v: bool(val) and v is not None and val in v,
        "~=": lambda v: v is not None and val in _BLANKS.split(v.strip(" ")),
        "|=": lambda v: v is not None and (v == val or v.startswith(val + "-")),
    }
    if op not in tests:
        raise SelectorError(f"unsupported attribute operator {op}")
    test = tests[op]
    return lambda page, i, pos, last: test(page.attrs[i].get(name))


class _Expression:
    """An XPath expression as functions (page, node, position, last) -> value; a value
    that is not there is None, as null is in the joins."""

    def __init__(self, tag: str | None, flags: dict):
        self.tag, self.flags = tag, flags

    def bool(self, e):
        value, kind = self.eval(e)
        if kind == "num":
            position = self._position
            return lambda p, i, pos, last: value(p, i, pos, last) == position(p, i, pos, last)
        if kind == "attr":
            return lambda *at: value(*at) is not None
        return lambda *at: bool(value(*at))

    def _position(self, page, i, pos, last):
        return float(pos if pos is not None else page.type_ordinal[i] if self.tag else page.ordinal[i])

    def _last(self, page, i, pos, last):
        return float(last if last is not None else page.type_count[i] if self.tag else page.n_sib[i])

    def str(self, e):
        value, kind = self.eval(e)
        if kind == "num":
            def text(*at):
                v = value(*at)
                return "" if v is None else re.sub(r"\.0$", "", repr(v))
            return text
        if kind == "bool":
            return lambda *at: "true" if value(*at) else "false"
        return lambda *at: value(*at) or ""

    def num(self, e):
        value, kind = self.eval(e)
        if kind == "num":
            return value

        def number(*at):
            v = value(*at)
            if isinstance(v, bool):
                return float(v)
            v = (v or "").strip(_BLANK)
            return float(v.rstrip("dDfF")) if _NUMBER.fullmatch(v) else None
        return number

    def eval(self, e):
        op = e[0]
        if op == "str":
            return (lambda *at: e[1]), "str"
        if op == "num":
            number = float(e[1])
            return (lambda *at: number), "num"
        if op == "attr":
            return (lambda p, i, pos, last: p.attrs[i].get(e[1])), "attr"
        if op == "own":
            return (lambda p, i, pos, last: p.own[i]), "str"
        if op == "ctx":
            return (lambda p, i, pos, last: p.text(i)), "str"
        if op == "flag":
            sel = self.flags[e[1]]
            return (lambda p, i, pos, last: i in p.nodes_of(sel, sel)), "bool"
        if op in ("and", "or"):
            a, b = self.bool(e[1]), self.bool(e[2])
            return ((lambda *at: a(*at) and b(*at)) if op == "and" else (lambda *at: a(*at) or b(*at))), "bool"
        if op == "arith":
            a, b, sign = self.num(e[2]), self.num(e[3]), 1 if e[1] == "+" else -1

            def total(*at):
                x, y = a(*at), b(*at)
                return None if x is None or y is None else x + sign * y
            return total, "num"
        if op == "cmp":
            return self._compared(e), "bool"
        if op == "fn":
            return self._function(e[1], e[2:], e)
        raise SelectorError(f"unsupported XPath expression {e!r}")

    def _compared(self, e):
        _, cmp, left, right = e
        (a, ka), (b, kb) = self.eval(left), self.eval(right)
        if cmp in ("<", "<=", ">", ">=") or "num" in (ka, kb):
            a, b = self.num(left), self.num(right)
        elif "bool" in (ka, kb) and ka != kb:
            raise SelectorError(f"a truth value compared with a text: {e!r}")
        test = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y,
                "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[cmp]

        def holds(*at):
            x, y = a(*at), b(*at)
            return x is not None and y is not None and test(x, y)
        return holds

    def _function(self, name: str, args: tuple, e):
        if name in ("position", "last"):
            return (self._position if name == "position" else self._last), "num"
        if name in ("true", "false"):
            return (lambda *at: name == "true"), "bool"
        if name == "not":
            inner = self.bool(args[0])
            return (lambda *at: not inner(*at)), "bool"
        if name in ("normalize-space", "string-length", "string"):
            source = self.str(args[0]) if args else (lambda p, i, pos, last: p.text(i))
            if name == "string":
                return source, "str"
            if name == "string-length":
                return (lambda *at: float(len(source(*at)))), "num"
            return (lambda *at: _BLANKS.sub(" ", source(*at)).strip(" ")), "str"
        if name in ("contains", "starts-with", "ends-with"):
            a, b = self.str(args[0]), self.str(args[1])
            return {"contains": lambda *at: b(*at) in a(*at), "starts-with": lambda *at: a(*at).startswith(b(*at)),
                    "ends-with": lambda *at: a(*at).endswith(b(*at))}[name], "bool"
        if name == "concat":
            parts = [self.str(a) for a in args]
            return (lambda *at: "".join(p(*at) for p in parts)), "str"
        if name == "translate":
            source, old, new = self.str(args[0]), e[3][1], e[4][1]
            table: dict = {}
            for k, ch in enumerate(old):
                table.setdefault(ord(ch), new[k] if k < len(new) else None)
            return (lambda *at: source(*at).translate(table)), "str"
        if name == "lower-case":
            source = self.str(args[0])
            return (lambda *at: source(*at).lower()), "str"
        raise SelectorError(f"unsupported XPath expression {e!r}")


def _node_test(comp: Compound, flags: dict):
    """Every test of a compound on one node, its tag included."""
    tests = []
    if comp.tag:
        tests.append(lambda p, i, pos, last: p.tag[i] == comp.tag)
    for pred in comp.preds:
        kind, *args = pred
        if kind == "id":
            tests.append(lambda p, i, pos, last, v=args[0]: p.ids[i] == v)
        elif kind == "class":
            tests.append(lambda p, i, pos, last, v=args[0]: v in p.classes[i])
        elif kind == "attr":
            tests.append(_attr_test(*args))
        elif kind == "nth":
            tests.append(_nth_test(*args))
        elif kind == "only":
            tests.append(lambda p, i, pos, last, child=args[0] == "child":
                         (p.n_sib[i] if child else p.type_count[i]) == 1)
        elif kind == "empty":
            tests.append(lambda p, i, pos, last: p.text_span[i][0] == p.text_span[i][1] and p.html_span[i][1] > 0)
        elif kind in ("not", "not_any"):
            inner = [_node_test(c, flags) for c in (args if kind == "not" else args[0])]
            tests.append(lambda p, i, pos, last, inner=inner: not any(t(p, i, None, None) for t in inner))
        elif kind == "contains":
            tests.append(lambda p, i, pos, last, v=args[0]: v in p.text(i))
        elif kind == "xpr":
            tests.append(_Expression(comp.tag, flags).bool(args[0]))
        elif kind == "has":
            tests.append(lambda p, i, pos, last, s=_Holders(args[0]): i in p.nodes_of(s, s))
        elif kind == "flag":
            tests.append(lambda p, i, pos, last, s=flags[args[0]]: i in p.nodes_of(s, s))
        else:
            raise SelectorError(f"unsupported predicate {pred!r}")
    return lambda p, i, pos, last: all(t(p, i, pos, last) for t in tests)


class _Test:
    """A compound on a page: ``holds(page, node)``."""

    def __init__(self, comp: Compound):
        flags = {}
        if _needs_flags(comp):
            found = _Flags()
            comp = found.compound(comp)
            flags = {name: _Holders(sel) for name, sel in found.selections}
        first, *later = _by_position(comp.preds)
        self.first = _node_test(Compound(comp.tag, first), flags)
        # [p][k]: the position counts what is left under each parent
        self.later = [(_node_test(Compound(None, part[:1]), flags), _node_test(Compound(None, part[1:]), flags))
                      for part in later]

    def holds(self, page: Page, i: int) -> bool:
        if self.later:
            return i in page.nodes_of(self, self.members)
        return self.first(page, i, None, None)

    def members(self, page: Page) -> set:
        alive = [i for i in range(1, page.n) if self.first(page, i, None, None)]
        for position, rest in self.later:
            under: dict = {}
            for i in alive:
                under.setdefault(page.parent[i], []).append(i)
            alive = [i for kids in under.values() for k, i in enumerate(kids, 1)
                     if position(page, i, float(k), float(len(kids))) and rest(page, i, None, None)]
        return set(alive)


class _Holders:
    """The nodes from which a relative selector finds something: its steps, last first,
    each a set of nodes of the page.  Called with a page."""

    def __init__(self, sel: SelectorList):
        self.chains = [[(s.axis, _Test(s.test)) for s in chain.steps] for chain in sel.chains]
        for chain in sel.chains:
            for s in chain.steps:
                counted = any(p[0] == "xpr" and _uses_position(p[1]) for p in s.test.preds)
                if s.anc_index is not None or s.axis not in _BACK or s.axis == "ancestor" and counted:
                    raise SelectorError(f"axis {s.axis} is not read in one pass")

    def __call__(self, page: Page) -> set:
        out: set = set()
        for steps in self.chains:
            reached: set | range = range(1, page.n)
            for axis, test in reversed(steps):
                reached = _BACK[axis](page, {i for i in reached if i and test.holds(page, i)})
            out |= reached
        return out


def _above(page: Page, found: set) -> set:
    out: set = set()
    for i in found:
        up = page.parent[i]
        while up and up not in out:
            out.add(up)
            up = page.parent[up]
    return out


def _below(page: Page, found: set) -> set:
    out: set = set()
    for i in range(1, page.n):  # document order: parents first
        if page.parent[i] in found or page.parent[i] in out:
            out.add(i)
    return out


def _beside(page: Page, found: set, wanted) -> set:
    places: dict = {}
    for i in found:
        places.setdefault(page.parent[i], []).append(page.ordinal[i])
    bounds = {p: (min(at), max(at), set(at)) for p, at in places.items()}
    return {i for i in range(1, page.n) if page.parent[i] in bounds and wanted(page.ordinal[i], *bounds[page.parent[i]])}


#: From the nodes that a step found back to the nodes that it can have come from.
_BACK = {
    "child": lambda page, found: {page.parent[i] for i in found},
    "desc": _above,
    "desc-or-self": lambda page, found: found | _above(page, found),
    "self": lambda page, found: found,
    "parent": lambda page, found: {i for i in range(1, page.n) if page.parent[i] in found},
    "ancestor": _below,
    "adjacent": lambda page, found: _beside(page, found, lambda o, lo, hi, at: o + 1 in at),
    "sibling": lambda page, found: _beside(page, found, lambda o, lo, hi, at: o < hi),
    "following-sibling": lambda page, found: _beside(page, found, lambda o, lo, hi, at: o < hi),
    "preceding-sibling": lambda page, found: _beside(page, found, lambda o, lo, hi, at: o > lo),
}


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Automaton:
    """``rules`` is ``[(key, SelectorList)]``; ``run(page)`` gives the nodes of each key that
    matches, in document order."""

    def __init__(self, rules: list):
        self.tests, self.last = [], {}
        self.anywhere = self.at_root = 0
        self.source = [0] * 5  # by source: the bits whose next step reads it
        self.by_tag, self.any_tag = {}, 0
        self.by_word, self.by_no_word = {}, 0
        for key, sel in rules:
            for chain in sel.chains:
                self._add(key, chain)
        self.ends = sum(1 << b for b in self.last)

    def _add(self, key, chain: Chain) -> None:
        for k, step in enumerate(chain.steps):
            bit = len(self.tests)
            if step.anc_index is not None or (k and step.axis not in _SOURCES):
                raise SelectorError(f"axis {step.axis} is not read in one pass")
            if k:
                for source in _SOURCES[step.axis]:
                    self.source[source] |= 1 << (bit - 1)
            elif step.axis in _ANYWHERE:
                self.anywhere |= 1 << bit
            elif step.axis in _AT_ROOT:
                self.at_root |= 1 << bit
            else:
                raise SelectorError(f"axis {step.axis} cannot start a page-level selector")
            self.tests.append(_Test(step.test))
            self._index(bit, step.test)
        self.last[len(self.tests) - 1] = key

    def _index(self, bit: int, comp: Compound) -> None:
        """What a node must show before the test is worth a try: its tag and one word."""
        if comp.tag:
            self.by_tag[comp.tag] = self.by_tag.get(comp.tag, 0) | 1 << bit
        else:
            self.any_tag |= 1 << bit
        word = next(((p[0], p[1]) for p in comp.preds if p[0] in ("id", "class")
                     or p[0] == "attr" and p[2] != "!="), None)
        if word is None:
            self.by_no_word |= 1 << bit
        else:
            self.by_word[word] = self.by_word.get(word, 0) | 1 << bit

    def _worth(self, page: Page, i: int) -> int:
        words, get = self.by_no_word, self.by_word.get
        if self.by_word:
            if page.ids[i] is not None:
                words |= get(("id", page.ids[i]), 0)
            for c in page.classes[i]:
                words |= get(("class", c), 0)
            for a in page.attrs[i]:
                words |= get(("attr", a), 0)
        return words & (self.any_tag | self.by_tag.get(page.tag[i], 0))

    def _passing(self, page: Page, i: int, steps: int) -> int:
        return sum(1 << b for b in _bits(steps) if self.tests[b].holds(page, i))

    def run(self, page: Page) -> dict:
        n = page.n
        at, open_, earlier, previous = [0] * n, [0] * n, [0] * n, [0] * n
        on_child, on_open, on_previous, on_earlier, on_self = self.source
        found: dict = {}
        for i in range(1, n):
            up = page.parent[i]
            worth = self._worth(page, i)
            reach = self.anywhere | (0 if up else self.at_root)
            reach |= ((at[up] & on_child) | (open_[up] & on_open) | (previous[up] & on_previous)
                      | (earlier[up] & on_earlier)) << 1
            here = self._passing(page, i, reach & worth)
            more = here
            while more and on_self:
                more = self._passing(page, i, ((more & on_self) << 1) & worth & ~here)
                here |= more
            at[i], open_[i] = here, open_[up] | here
            previous[up], earlier[up] = here, earlier[up] | here
            for b in _bits(here & self.ends):
                nodes = found.setdefault(self.last[b], [])
                if not nodes or nodes[-1] != i:
                    nodes.append(i)
        return found


def reads_in_one_pass(sel: SelectorList) -> bool:
    try:
        Automaton([("", sel)])
    except SelectorError:
        return False
    return True
