"""Selector AST -> DataFrame plan over the node table.

Every plan returns ``(page_id, scope_id, node_id)``: the matched element and
the scope it was matched in (``0`` = the whole page, else a container node).

Axis to join mapping (all equi-joins, no theta or cross joins):

* descendant  -- ``explode(path) AS anc`` on the candidates, join the state on
  ``(page_id, anc)``;
* child       -- join on ``(page_id, parent_id)``;
* ``+`` / ``~`` / siblings -- join on ``(page_id, parent_id)`` (+ ordinal);
* parent / ancestor -- the state's own parent id / exploded path;
* ``:has()``  -- left-semi join with the relative selector scoped to the node;
* ``:not(:has())`` and relative paths inside ``and`` / ``or`` / ``not()`` or a
  comparison -- the same selection, joined back as a boolean column;
* XPath positions after other predicates -- the survivors of those predicates
  are numbered under their parent;
* ``:contains()`` and XPath ``.`` -- full text via the page text (one join).

Compound tests (tag, id, class, attribute, positions, ``:not``) are plain
Column predicates and stay inside whole-stage codegen.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ast import Chain, Compound, SelectorError, SelectorList, _compound_needs_text
from .css import parse_css
from .xpath import parse_xpath

log = logging.getLogger(__name__)

_KEYS = ["page_id", "scope_id", "node_id"]
_CAND_COLS = ["page_id", "node_id", "parent_id", "ordinal", "path"]


# ---------------------------------------------------------------------------
# E5: selector kind detection
# ---------------------------------------------------------------------------

def is_xpath(selector: str, selector_type: str | None = "css") -> bool:
    s = selector or ""
    return (selector_type == "xpath" or s.startswith("xpath:") or s.startswith("//")
            or "normalize-space" in s or s.startswith("./"))


def normalise_xpath(selector: str) -> str:
    expr = selector[6:] if selector.startswith("xpath:") else selector
    if "normalize-space" in expr and not expr.startswith("//") and not expr.startswith("./"):
        expr = "//" + expr.lstrip("/")
    return expr


def parse_selector(selector: str, selector_type: str | None = "css", relative: bool = False) -> SelectorList:
    """E5: auto-detect CSS vs XPath and parse."""
    if is_xpath(selector, selector_type):
        return parse_xpath(normalise_xpath(selector))
    return parse_css(selector, relative=relative)


# ---------------------------------------------------------------------------
# Column predicates
# ---------------------------------------------------------------------------

def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _position(kind: str) -> Column:
    if kind == "child":
        return F.col("ordinal")
    if kind == "last-child":
        return F.col("n_sib") - F.col("ordinal") + 1
    if kind == "type":
        return F.col("type_ordinal")
    return F.col("type_count") - F.col("type_ordinal") + 1


def _nth(pos: Column, a: int, b: int) -> Column:
    if a == 0:
        return pos == b
    # pos = a*n + b for some n >= 0
    diff = pos - b
    return (F.pmod(diff, F.lit(abs(a))) == 0) & ((diff / a) >= 0)


def _attr_pred(name: str, op: str | None, val: str | None) -> Column:
    v = F.col("attrs")[name]
    if op is None:
        return v.isNotNull()
    if op == "=":
        return v == val
    if op == "!=":
        return v.isNull() | (v != val)
    if op == "^=":
        return v.startswith(val) & F.lit(val != "")
    if op == "$=":
        return v.endswith(val) & F.lit(val != "")
    if op == "*=":
        return v.contains(val) & F.lit(val != "")
    if op == "~=":
        return F.array_contains(F.split(F.trim(v), r"\s+"), val)
    if op == "|=":
        return (v == val) | v.startswith(val + "-")
    raise SelectorError(f"unsupported attribute operator {op}")


def full_text_col() -> Column:
    """Full text of a node; valid on candidates joined with ``docs``."""
    return F.coalesce("short_text", F.expr("substring(doc_text, text_start + 1, text_end - text_start)"))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


class _XPathEval:
    """XPath predicate expression -> (Column, kind)."""

    def __init__(self, tag: str | None, pos: Column | None = None, last: Column | None = None):
        self.tag = tag
        self.pos_col, self.last_col = pos, last

    def bool(self, e) -> Column:
        c, kind = self.eval(e)
        if kind == "bool":
            return _false_if_null(c)
        if kind == "num":
            return _false_if_null(self._pos() == c)
        if kind == "attr":
            return c.isNotNull()
        return _false_if_null(F.length(c) > 0)

    def _pos(self):
        if self.pos_col is not None:
            return self.pos_col
        return F.col("type_ordinal") if self.tag else F.col("ordinal")

    def _last(self):
        if self.last_col is not None:
            return self.last_col
        return F.col("type_count") if self.tag else F.col("n_sib")

    def str(self, e) -> Column:
        c, kind = self.eval(e)
        if kind == "num":
            return F.regexp_replace(c.cast("string"), r"\.0$", "")
        if kind == "bool":
            return F.when(c, F.lit("true")).otherwise(F.lit("false"))
        return F.coalesce(c, F.lit(""))

    def num(self, e) -> Column:
        c, kind = self.eval(e)
        if kind == "num":
            return c
        return c.try_cast("double")

    def eval(self, e):
        op = e[0]
        if op == "str":
            return F.lit(e[1]), "str"
        if op == "num":
            return F.lit(float(e[1])), "num"
        if op == "attr":
            return F.col("attrs")[e[1]], "attr"
        if op == "own":
            return F.col("own_text"), "str"
        if op == "flag":
            return _false_if_null(F.col(e[1])), "bool"
        if op == "ctx":
            return full_text_col(), "str"
        if op == "and":
            return self.bool(e[1]) & self.bool(e[2]), "bool"
        if op == "or":
            return self.bool(e[1]) | self.bool(e[2]), "bool"
        if op == "arith":
            a, b = self.num(e[2]), self.num(e[3])
            return (a + b if e[1] == "+" else a - b), "num"
        if op == "cmp":
            _, cmp, a, b = e
            ka, kb = self.eval(a)[1], self.eval(b)[1]
            if cmp in ("<", "<=", ">", ">=") or "num" in (ka, kb):
                x, y = self.num(a), self.num(b)
            else:
                x, y = self.eval(a)[0], self.eval(b)[0]
            res = {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[cmp]
            return _false_if_null(res), "bool"
        if op == "fn":
            name, args = e[1], e[2:]
            if name == "position":
                return self._pos().cast("double"), "num"
            if name == "last":
                return self._last().cast("double"), "num"
            if name == "not":
                return ~self.bool(args[0]), "bool"
            if name == "true":
                return F.lit(True), "bool"
            if name == "false":
                return F.lit(False), "bool"
            if name == "contains":
                return F.instr(self.str(args[0]), self.str(args[1])) > 0, "bool"
            if name == "starts-with":
                return self.str(args[0]).startswith(self.str(args[1])), "bool"
            if name == "ends-with":
                return self.str(args[0]).endswith(self.str(args[1])), "bool"
            if name == "normalize-space":
                src = self.str(args[0]) if args else full_text_col()
                return normalize_space(src), "str"
            if name == "string-length":
                src = self.str(args[0]) if args else full_text_col()
                return F.length(src).cast("double"), "num"
            if name == "string":
                return (self.str(args[0]) if args else full_text_col()), "str"
            if name == "concat":
                return F.concat(*[self.str(a) for a in args]), "str"
            if name == "translate":
                return F.translate(self.str(args[0]), e[3][1], e[4][1]), "str"
            if name == "lower-case":
                return F.lower(self.str(args[0])), "str"
        raise SelectorError(f"unsupported XPath expression {e!r}")


def _uses_position(e) -> bool:
    if isinstance(e, tuple):
        if e[0] == "fn" and e[1] in ("position", "last"):
            return True
        return any(_uses_position(x) for x in e[1:])
    return False


def split_positional(comp: Compound) -> tuple[Compound, list]:
    """Positional XPath predicates of a step, apart from the others (on
    reverse axes positions count along the axis, not among siblings)."""
    pos = [p for p in comp.preds if p[0] == "xpr" and _uses_position(p[1])]
    rest = [p for p in comp.preds if not (p[0] == "xpr" and _uses_position(p[1]))]
    return Compound(comp.tag, rest), pos


def _has_path(e) -> bool:
    return isinstance(e, tuple) and (e[0] == "path" or any(_has_path(x) for x in e[1:]))


def _needs_flags(comp: Compound) -> bool:
    """Does a test of the compound select other nodes (beside a plain ``:has``)."""
    for p in comp.preds:
        if p[0] == "xpr" and _has_path(p[1]):
            return True
        inner = [p[1]] if p[0] == "not" else p[1] if p[0] == "not_any" else []
        if any(_needs_flags(c) or any(q[0] == "has" for q in c.preds) for c in inner):
            return True
    return False


def _by_position(preds: list) -> list[list]:
    """Predicates cut before each positional XPath predicate that follows
    another predicate: its positions count the survivors of those before it."""
    parts: list[list] = [[]]
    for i, p in enumerate(preds):
        if i and p[0] == "xpr" and _uses_position(p[1]):
            parts.append([])
        parts[-1].append(p)
    return parts


class _Flags:
    """Replaces selections inside tests by flag columns and lists them."""

    def __init__(self):
        self.selections: list[tuple[str, SelectorList]] = []

    def _flag(self, sel: SelectorList) -> str:
        name = f"_flag{len(self.selections)}"
        self.selections.append((name, sel))
        return name

    def compound(self, c: Compound, top: bool = True) -> Compound:
        out = []
        for p in c.preds:
            if p[0] == "xpr" and _has_path(p[1]):
                out.append(("xpr", self.expr(p[1])))
            elif p[0] == "has" and not top:
                out.append(("flag", self._flag(p[1])))
            elif p[0] == "not":
                out.append(("not", self.compound(p[1], False)))
            elif p[0] == "not_any":
                out.append(("not_any", [self.compound(x, False) for x in p[1]]))
            else:
                out.append(p)
        return Compound(c.tag, out)

    def expr(self, e):
        if not isinstance(e, tuple) or not _has_path(e):
            return e
        if e[0] == "path":
            return ("flag", self._flag(e[1]))
        if e[0] in ("and", "or") or e[0] == "fn" and e[1] == "not":
            return tuple(self.expr(x) for x in e)
        if e[0] == "cmp" and (e[2][0] == "path") != (e[3][0] == "path"):
            # some node of the path compares so: the comparison moves into the path's last step
            path, other, left = (e[2], e[3], True) if e[2][0] == "path" else (e[3], e[2], False)
            if not _has_path(other) and other[0] in ("str", "num"):
                chain = path[1].chains[0]
                last = chain.steps[-1]
                value = ("attr", chain.attr_name) if chain.output == "attr" else ("ctx",)
                test = ("cmp", e[1], value, other) if left else ("cmp", e[1], other, value)
                step = type(last)(last.axis, Compound(last.test.tag, [*last.test.preds, ("xpr", test)]), last.anc_index)
                return ("flag", self._flag(SelectorList([Chain([*chain.steps[:-1], step])], path[1].source)))
        raise SelectorError(f"a path cannot stand here: {e!r}")


def compound_predicate(comp: Compound) -> Column:
    """Column predicate for everything in a compound except ``:has``."""
    conds = []
    if comp.tag:
        conds.append(F.col("tag") == comp.tag)
    for p in comp.preds:
        kind = p[0]
        if kind == "id":
            conds.append(_false_if_null(F.col("elem_id") == p[1]))
        elif kind == "class":
            conds.append(F.array_contains(F.col("classes"), p[1]))
        elif kind == "attr":
            conds.append(_false_if_null(_attr_pred(p[1], p[2], p[3])))
        elif kind == "nth":
            conds.append(_nth(_position(p[1]), p[2], p[3]))
        elif kind == "only":
            conds.append((F.col("n_sib") if p[1] == "child" else F.col("type_count")) == 1)
        elif kind == "empty":
            conds.append((F.col("text_end") == F.col("text_start")) & (F.col("html_end") > 0))
        elif kind == "not":
            conds.append(~_false_if_null(compound_predicate(p[1])))
        elif kind == "not_any":
            conds.append(~reduce(lambda a, b: a | b, [_false_if_null(compound_predicate(c)) for c in p[1]]))
        elif kind == "contains":
            conds.append(_false_if_null(full_text_col().contains(p[1])))
        elif kind == "xpr":
            conds.append(_XPathEval(comp.tag).bool(p[1]))
        elif kind == "has":
            continue
        elif kind == "flag":
            conds.append(_false_if_null(F.col(p[1])))
        else:
            raise SelectorError(f"unsupported predicate {p!r}")
    return reduce(lambda a, b: a & b, conds, F.lit(True))


# ---------------------------------------------------------------------------
# Planner
# ---------------------------------------------------------------------------

class Planner:
    """Builds selection plans against one ``Dom``."""

    def __init__(self, dom):
        self.dom = dom

    # -- candidates for one compound ------------------------------------------
    def candidates(self, comp: Compound) -> DataFrame:
        nodes = self.dom.nodes
        if _compound_needs_text(comp):
            base = nodes.where(F.col("tag") == comp.tag) if comp.tag else nodes
            base = base.join(self.dom.docs.select("page_id", "doc_text"), "page_id")
        else:
            base = nodes
        parts = _by_position(comp.preds)
        cand = self._passing(base, Compound(comp.tag, parts[0]))
        siblings = Window.partitionBy("page_id", "parent_id")
        for position, *rest in parts[1:]:
            # [p][k]: number what is left under each parent (a page's siblings), then test on
            cand = (cand.withColumn("_pos", F.row_number().over(siblings.orderBy("node_id")).cast("double"))
                    .withColumn("_last", F.count(F.lit(1)).over(siblings).cast("double")))
            cand = cand.where(_XPathEval(None, F.col("_pos"), F.col("_last")).bool(position[1])).drop("_pos", "_last")
            cand = self._passing(cand, Compound(None, rest))
        return cand.select(*_CAND_COLS)

    def _passing(self, base: DataFrame, comp: Compound) -> DataFrame:
        """Rows of ``base`` that pass the compound's tests, all columns kept."""
        if _needs_flags(comp):
            # the tests on the node itself come first: only their survivors scope the selections
            own = [p for p in comp.preds if not _needs_flags(Compound(None, [p]))]
            base = base.where(compound_predicate(Compound(comp.tag, own)))
            flags = _Flags()
            comp = flags.compound(comp)
            for name, sel in flags.selections:
                scope = base.select("page_id", F.col("node_id").alias("scope_id"))
                hits = self.select(sel, scope=scope).select("page_id", F.col("scope_id").alias("node_id")).distinct()
                base = base.join(hits.withColumn(name, F.lit(True)), ["page_id", "node_id"], "left")
            cand = base.where(compound_predicate(comp)).drop(*[n for n, _ in flags.selections])
        else:
            cand = base.where(compound_predicate(comp))
        for p in comp.preds:
            if p[0] == "has":
                scope = cand.select("page_id", F.col("node_id").alias("scope_id"))
                hits = self.select(p[1], scope=scope).select("page_id", F.col("scope_id").alias("node_id"))
                cand = cand.join(hits, ["page_id", "node_id"], "left_semi")
        return cand

    # -- steps ------------------------------------------------------------------
    def _node_attrs(self, state: DataFrame, *cols: str) -> DataFrame:
        info = self.dom.nodes.select("page_id", F.col("node_id").alias("s_node"), *cols)
        return state.withColumnRenamed("node_id", "s_node").join(info, ["page_id", "s_node"])

    def _advance(self, state: DataFrame | None, step, cand: DataFrame) -> DataFrame:
        axis = step.axis
        if state is None:  # document scope
            if axis in ("desc", "desc-or-self", "self"):
                out = cand
            elif axis in ("child", "root-child"):
                out = cand.where(F.col("parent_id") == 0)
            else:
                raise SelectorError(f"axis {axis} cannot start a page-level selector")
            return out.select("page_id", F.lit(0).alias("scope_id"), "node_id")

        if axis == "root-child":
            roots = cand.where(F.col("parent_id") == 0).select("page_id", "node_id")
            return state.select("page_id", "scope_id").distinct().join(roots, "page_id").select(*_KEYS)
        if axis == "desc":
            pairs = cand.select("page_id", "node_id", F.explode("path").alias("anc"))
            st = state.select("page_id", "scope_id", F.col("node_id").alias("anc"))
            return pairs.join(st, ["page_id", "anc"]).select(*_KEYS).dropDuplicates(_KEYS)
        if axis == "desc-or-self":
            desc = self._advance(state, type(step)("desc", step.test), cand)
            me = self._advance(state, type(step)("self", step.test), cand)
            return desc.unionByName(me).dropDuplicates(_KEYS)
        if axis == "child":
            st = state.select("page_id", "scope_id", F.col("node_id").alias("parent_id"))
            return cand.join(st, ["page_id", "parent_id"]).select(*_KEYS)
        if axis == "self":
            return cand.select("page_id", "node_id").join(state.select(*_KEYS), ["page_id", "node_id"]).select(*_KEYS)
        if axis == "parent":
            st = self._node_attrs(state, F.col("parent_id").alias("node_id"))
            return cand.select("page_id", "node_id").join(st.select(*_KEYS), ["page_id", "node_id"]).select(*_KEYS)
        if axis in ("adjacent", "sibling", "following-sibling", "preceding-sibling"):
            st = self._node_attrs(state, "parent_id", F.col("ordinal").alias("s_ord"))
            st = st.select("page_id", "scope_id", "parent_id", "s_ord")
            joined = cand.join(st, ["page_id", "parent_id"])
            if axis == "adjacent":
                joined = joined.where(F.col("ordinal") == F.col("s_ord") + 1)
            elif axis == "preceding-sibling":
                joined = joined.where(F.col("ordinal") < F.col("s_ord"))
            else:
                joined = joined.where(F.col("ordinal") > F.col("s_ord"))
            out = joined.select(*_KEYS)
            return out if axis == "adjacent" else out.dropDuplicates(_KEYS)
        if axis == "ancestor":
            st = self._node_attrs(state, "path")
            st = st.select("page_id", "scope_id", "s_node", F.posexplode("path").alias("pos", "node_id"),
                           F.size("path").alias("n"))
            hit = st.join(cand.select("page_id", "node_id"), ["page_id", "node_id"])
            _, pos_preds = split_positional(step.test)
            if step.anc_index is not None or pos_preds:
                # position on a reverse axis: 1 = the nearest matching ancestor
                w = Window.partitionBy("page_id", "scope_id", "s_node")
                hit = (hit.withColumn("_axis_pos", F.row_number().over(w.orderBy(F.col("pos").desc())))
                       .withColumn("_axis_last", F.count(F.lit(1)).over(w)))
                if step.anc_index is not None:
                    hit = hit.where(F.col("_axis_pos") == step.anc_index)
                if pos_preds:
                    info = self.dom.nodes.select("page_id", "node_id", "tag", "elem_id", "classes", "attrs",
                                                 "own_text")
                    hit = hit.join(info, ["page_id", "node_id"])
                ev = _XPathEval(step.test.tag, F.col("_axis_pos").cast("double"), F.col("_axis_last").cast("double"))
                for p in pos_preds:
                    hit = hit.where(ev.bool(p[1]))
            return hit.select(*_KEYS).dropDuplicates(_KEYS)
        raise SelectorError(f"unsupported axis {axis}")

    def _chain(self, chain: Chain, scope: DataFrame | None) -> DataFrame:
        state = None
        if scope is not None:
            state = scope.select("page_id", "scope_id", F.col("scope_id").alias("node_id"))
        for step in chain.steps:
            test = split_positional(step.test)[0] if step.axis == "ancestor" else step.test
            cand = self.candidates(test)
            state = self._advance(state, step, cand)
        return state

    def select(self, sel, scope: DataFrame | None = None, selector_type: str = "css") -> DataFrame:
        """All matches of a selector (list): ``(page_id, scope_id, node_id)``.

        ``scope`` is ``(page_id, scope_id)``; a scoped CSS selector may start
        with a combinator (``> h3``).
        """
        if isinstance(sel, str):
            sel = parse_selector(sel, selector_type, relative=scope is not None)
        parts = [self._chain(ch, scope) for ch in sel.chains]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.dropDuplicates(_KEYS) if len(parts) > 1 else out

    def select_many(self, named: list, scope: DataFrame | None = None) -> DataFrame:
        """Several selectors at once: ``named`` is ``[(key, SelectorList)]``;
        output ``(page_id, scope_id, node_id, key)``.

        Single-step selectors without joins of their own (the usual
        ``h3`` / ``.title`` / ``a[href^='mailto:']`` of a template) share ONE
        scan of the node table: each row gets the array of keys whose
        predicate it passes, exploded, and one scope join follows.  Other
        selectors get their own plan and are unioned in."""
        simple, rest = {}, []
        for key, sel in named:
            ok = len(sel.chains) == 1 and len(sel.chains[0].steps) == 1
            if ok:
                step = sel.chains[0].steps[0]
                ok = (step.axis in ("desc", "child") and not _compound_needs_text(step.test)
                      and not any(p[0] == "has" for p in step.test.preds) and not _needs_flags(step.test)
                      and len(_by_position(step.test.preds)) == 1)
            if ok:
                simple.setdefault(step.axis, []).append((key, compound_predicate(step.test)))
            else:
                rest.append((key, sel))
        parts = []
        for axis, preds in simple.items():
            keys = F.array_compact(F.array(*[F.when(pred, F.lit(k)) for k, pred in preds]))
            any_pred = reduce(lambda a, b: a | b, [_false_if_null(pred) for _, pred in preds])
            cand = (self.dom.nodes.where(any_pred)
                    .select(*_CAND_COLS, F.explode(keys).alias("key")))
            if scope is None:
                if axis == "child":
                    cand = cand.where(F.col("parent_id") == 0)
                parts.append(cand.select("page_id", F.lit(0).alias("scope_id"), "node_id", "key"))
            elif axis == "desc":
                pairs = cand.select("page_id", "node_id", "key", F.explode("path").alias("anc"))
                st = scope.select("page_id", F.col("scope_id").alias("anc"), "scope_id")
                parts.append(pairs.join(st, ["page_id", "anc"]).select(*_KEYS, "key"))
            else:
                st = scope.select("page_id", F.col("scope_id").alias("parent_id"), "scope_id")
                parts.append(cand.join(st, ["page_id", "parent_id"]).select(*_KEYS, "key"))
        for key, sel in rest:
            parts.append(self.select(sel, scope=scope).withColumn("key", F.lit(key)))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def select_first(self, alternatives, scope: DataFrame | None = None,
                     selector_type: str = "css", min_count: int = 1) -> DataFrame:
        """Ordered alternatives, first with >= ``min_count`` matches wins,
        decided per (page, scope).  Output adds ``priority``."""
        return self.select_ranked([(a, min_count) for a in alternatives], scope, selector_type)

    def select_ranked(self, rungs: list, scope: DataFrame | None = None, selector_type: str = "css") -> DataFrame:
        """Ordered ``(selector, min_count)`` rungs; per (page, scope) the first with
        enough matches wins.  All rungs run as one batched plan; output adds
        ``priority`` (the rung's place).  A rung that does not compile is skipped
        with a log line."""
        named, least = [], {}
        for prio, (alt, min_count) in enumerate(rungs):
            try:
                sel = alt if isinstance(alt, SelectorList) else parse_selector(
                    alt, selector_type, relative=scope is not None)
                check_compiles(sel)
            except SelectorError as exc:
                log.warning("selector %d of %d skipped: %s", prio + 1, len(rungs), exc)
                continue
            named.append((str(prio), sel))
            least[prio] = min_count
        if not named:
            raise SelectorError(f"no usable selector in {[a for a, _ in rungs]!r}")
        allm = (self.select_many(named, scope=scope)
                .select(*_KEYS, F.col("key").cast("int").alias("priority")))
        # a node matched by two chains of one alternative counts once
        allm = allm.dropDuplicates(_KEYS + ["priority"])
        # windows over (page, scope): they run on the node table's page
        # partitioning (no exchange) and, unlike joining the matches back to
        # an aggregate of themselves, keep the plan linear in the rungs
        if max(least.values()) > 1:
            n = F.count(F.lit(1)).over(Window.partitionBy("page_id", "scope_id", "priority"))
            need = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])[F.col("priority")]
            allm = allm.withColumn("_n", n).where(F.col("_n") >= need).drop("_n")
        best = F.min("priority").over(Window.partitionBy("page_id", "scope_id"))
        return allm.withColumn("_best", best).where(F.col("priority") == F.col("_best")).drop("_best")


def check_compiles(sel: SelectorList) -> None:
    """Raise ``SelectorError`` now (at plan-build time) if any test of the
    selector is outside the supported grammar."""
    for ch in sel.chains:
        for step in ch.steps:
            flags = _Flags()
            test = flags.compound(step.test)
            compound_predicate(test)
            for p in test.preds:
                if p[0] == "has":
                    check_compiles(p[1])
            for _, inner in flags.selections:
                check_compiles(inner)


def chain_output(sel: SelectorList) -> tuple[str, str | None]:
    c = sel.chains[0]
    return c.output, c.attr_name
