"""Selector AST shared by the CSS and XPath front ends.

A selector list is a union of chains; a chain is a list of steps; a step is an
axis (how it relates to the previous step) plus a compound test on one node.
The compiler (``plans.compile``) turns this into joins over the node table.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class SelectorError(ValueError):
    """Raised at plan-build time for selectors outside the supported grammar."""


@dataclass
class Compound:
    tag: str | None = None              # None or '*' = any element
    preds: list = field(default_factory=list)
    # preds items (tuples):
    #   ('id', v) ('class', c) ('attr', name, op, value)  op in None,'=','^=','$=','*=','~=','|=','!='
    #   ('nth', kind, a, b)   kind in child,last-child,type,last-type
    #   ('not', Compound)     ('contains', text)   ('has', SelectorList)
    #   ('xpr', expr)         XPath predicate expression tree (see plans.xpath)
    #   ('flag', name)        a boolean column that the planner has joined in


@dataclass
class Step:
    axis: str            # 'desc' 'child' 'adjacent' 'sibling' 'self' 'parent' 'ancestor'
    #                      'following-sibling' 'preceding-sibling' 'desc-or-self'
    test: Compound
    anc_index: int | None = None   # for ancestor axis with a positional [k]


@dataclass
class Chain:
    steps: list
    output: str = "node"           # 'node', 'own_text' (XPath text()), 'attr'
    attr_name: str | None = None   # for output == 'attr'


@dataclass
class SelectorList:
    chains: list
    source: str = ""

    def uses_full_text(self) -> bool:
        return any(_compound_needs_text(s.test) for c in self.chains for s in c.steps)


def _compound_needs_text(c: Compound) -> bool:
    for p in c.preds:
        if p[0] == "contains":
            return True
        if p[0] == "not" and _compound_needs_text(p[1]):
            return True
        if p[0] == "not_any" and any(_compound_needs_text(x) for x in p[1]):
            return True
        if p[0] == "has" and p[1].uses_full_text():
            return True
        if p[0] == "xpr" and _expr_needs_text(p[1]):
            return True
    return False


def _expr_needs_text(e) -> bool:
    if isinstance(e, tuple):
        if e[0] == "ctx":
            return True
        # these default to the context node's string value
        if e[0] == "fn" and e[1] in ("normalize-space", "string-length", "string") and len(e) == 2:
            return True
        return any(_expr_needs_text(x) for x in e[1:])
    return False
