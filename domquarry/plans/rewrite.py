"""Looser forms of a parsed selector.

Every rung is a transform of the selector's steps, not of its text: positions
are dropped, class and id tests become substring tests, or only the last steps
are kept.  The results are ``SelectorList`` values that the planner takes like
parsed selectors; ``source`` is a readable form of them.
"""

from __future__ import annotations

from .ast import Chain, Compound, SelectorError, SelectorList, Step
from .css import parse_css

_SIGN = {"child": ">", "adjacent": "+", "sibling": "~"}


def _text_of(c: Compound) -> str:
    out = c.tag or ""
    for p in c.preds:
        if p[0] == "class":
            out += f".{p[1]}"
        elif p[0] == "id":
            out += f"#{p[1]}"
        elif p[0] == "attr":
            out += f"[{p[1]}]" if p[2] is None else f'[{p[1]}{p[2]}"{p[3]}"]'
        elif p[0] == "nth" and p[1] == "child" and p[2] == 0:
            out += f":nth-child({p[3]})"
        else:
            out += f":{p[0]}{p[1:]!r}"
    return out or "*"


def source_of(steps: list[Step]) -> str:
    parts = []
    for i, s in enumerate(steps):
        if s.axis in _SIGN:
            parts.append(_SIGN[s.axis])
        parts.append(_text_of(s.test))
    return " ".join(parts)


def _selector(steps: list[Step]) -> SelectorList:
    first = Step("desc", steps[0].test)
    steps = [first, *steps[1:]]
    return SelectorList([Chain(steps)], source_of(steps))


def _one(tag: str | None, *preds) -> SelectorList:
    return _selector([Step("desc", Compound(tag, list(preds)))])


def _steps(selector: str) -> list[Step] | None:
    """The steps of a selector of one alternative; None for any other input."""
    try:
        parsed = parse_css(selector)
    except SelectorError:
        return None
    return parsed.chains[0].steps if len(parsed.chains) == 1 else None


def _is_position(p) -> bool:
    return p[0] == "nth" and p[1] == "child" and p[2] == 0


def _named(c: Compound) -> list[str]:
    """Class and id names of a compound, else its tag."""
    return [p[1] for p in c.preds if p[0] in ("class", "id")] or ([c.tag] if c.tag else [])


def without_positions(selector: str) -> list[SelectorList]:
    """``:nth-child(k)`` tests dropped, so that a selector recorded on one
    item matches its siblings.  A last step that was nothing but a position goes;
    if one step is left of a child chain, its last two steps stay, as a
    descendant pair.  Empty if nothing changes."""
    steps = _steps(selector)
    if not steps or not any(_is_position(p) for s in steps for p in s.test.preds):
        return []
    loose = [Step(s.axis, Compound(s.test.tag, [p for p in s.test.preds if not _is_position(p)])) for s in steps]
    kept = list(loose)
    while len(kept) > 1 and not kept[-1].test.tag and not kept[-1].test.preds:
        kept.pop()
    if len(kept) == 1 and len(steps) > 1:
        last = loose[-1].test
        if last.tag or last.preds:
            kept = [loose[-2], Step("desc", last)]
    return [_selector(kept)]


def variants(selector: str) -> list[SelectorList]:
    """Substring, tagged and word tests in place of one class or id; a bare
    tag with a class, an id or inside ``div`` or ``main``; of several steps the
    last one, the last two, and any element whose class holds the last name."""
    steps = _steps(selector)
    if not steps:
        return []
    last = steps[-1].test
    if len(steps) > 1:
        name = "".join(_named(last))
        by_class = [_one(None, ("attr", "class", "*=", name))] if name else []
        return [_selector(steps[-1:]), _selector(steps[-2:]), *by_class]
    if last.tag and not last.preds:
        inside = [[Step("desc", Compound(t)), Step("desc", Compound(last.tag))] for t in ("div", "main")]
        return [_one(last.tag, ("attr", "class", None, None)), _one(last.tag, ("attr", "id", None, None)),
                *map(_selector, inside)]
    if last.tag or len(last.preds) != 1 or last.preds[0][0] not in ("class", "id"):
        return []
    kind, name = last.preds[0]
    out = [_one(None, ("attr", kind, "*=", name)), _one("div", (kind, name)), _one(None, ("attr", kind, "~=", name))]
    if kind == "class":
        stem = name.split("-")[0] if "-" in name else name[:5]
        out += [_one("div", ("attr", "class", "*=", name)), _one(None, ("attr", "class", "*=", stem))]
    return out


def same_structure(selector: str) -> list[SelectorList]:
    """The same steps with class tests as substring tests; of a child chain
    also its last two names as ancestor and descendant, by class and by tag."""
    steps = _steps(selector)
    if not steps:
        return []

    def loose(c: Compound) -> Compound:
        return Compound(c.tag, [("attr", "class", "*=", p[1]) if p[0] == "class" else p for p in c.preds])

    out = [_selector([Step(s.axis, loose(s.test)) for s in steps])]
    if any(s.axis == "child" for s in steps[1:]):
        names = ["".join(_named(s.test)) for s in steps[-2:]]
        if all(names):
            for make in (lambda n: Compound(None, [("attr", "class", "*=", n)]), lambda n: Compound(n.lower())):
                out.append(_selector([Step("desc", make(n)) for n in names]))
    return out


def class_substrings(selector: str) -> list[SelectorList]:
    """A compound of classes alone, every class as a substring test."""
    steps = _steps(selector)
    if not steps or len(steps) > 1 or steps[0].test.tag or not steps[0].test.preds:
        return []
    if any(p[0] != "class" for p in steps[0].test.preds):
        return []
    return [_one(None, *[("attr", "class", "*=", p[1]) for p in steps[0].test.preds])]


def with_own_text(pattern: str) -> SelectorList:
    """Elements whose own text contains ``pattern``, whatever its characters."""
    test = ("xpr", ("fn", "contains", ("own",), ("str", pattern)))
    return SelectorList([Chain([Step("desc", Compound(None, [test]))])], f"own text contains {pattern!r}")
