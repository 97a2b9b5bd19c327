"""Ordered fallback ladders.

A ladder is an ordered list of selector alternatives; per page (or per
container) the first alternative with a match wins.  Each ladder runs as one
``select_first`` plan -- the alternatives' matches are unioned with their
priority and reduced by a grouped ``min`` -- so there is no loop over pages
and no per-page Python.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import fallback_xpaths, map_generic_selector, semantic_xpaths
from ..plans.ast import SelectorError
from ..plans.compile import Planner, check_compiles, is_xpath, normalise_xpath, parse_selector
from ..session import materialize
from ..plans.css import split_top_level
from ..plans.rewrite import class_substrings, same_structure, variants, with_own_text, without_positions
from .detect import DIRECTORY_CONTENT_XPATHS, DIRECTORY_PATTERNS, LAST_RESORT_SELECTORS


log = logging.getLogger(__name__)


def element_ladder(element: dict, expected_patterns: list[str] | None = None,
                   smart: bool = True) -> list:
    """E6 strategies for a page-level element, flattened in order:
    1. the selector as given (E5 auto-detect); 2. semantic XPaths by label
    (E8); 3. content patterns (E9, when given); 4. structure match (E10),
    generalised (E11) and variant (E12) selectors; 5. the selector as CSS."""
    sel = element.get("selector") or ""
    st = element.get("selector_type") or "css"
    xpath = is_xpath(sel, st)
    alts = [normalise_xpath(sel) if xpath else sel]
    if smart:
        alts += semantic_xpaths(element.get("label", ""))
        alts += [with_own_text(p) for p in expected_patterns or []]
        if not xpath:
            alts += same_structure(sel) + without_positions(sel) + variants(sel)
    seen, out = set(), []
    for a in alts:
        name = a if isinstance(a, str) else a.source
        if name and name not in seen:
            seen.add(name)
            out.append(a)
    return out


def find_with_fallback(planner: Planner, element: dict, expected_patterns: list[str] | None = None,
                       smart: bool = True) -> DataFrame:
    """Matches of the first ladder rung with a result, per page; adds
    ``priority`` (the rung)."""
    return planner.select_first(element_ladder(element, expected_patterns, smart))


#: Elements whose ladder rungs one plan holds.
LADDER_GROUP = 8


def element_rungs(element: dict) -> list[tuple]:
    """E6 below the literal selector, as (alternative, matches it needs on a page)."""
    return [(alt, 1) for alt in element_ladder(element)[1:]]


def container_rungs(element: dict) -> list[tuple]:
    """C2 below the literal selector: looser forms of it (E13, E11, E12), directory
    detection (E18: three matches at least), then last-resort layouts (E20: more than five)."""
    _, after = container_ladder(element.get("selector") or "", element.get("selector_type") or "css")
    rungs = [*after[:-1], (DIRECTORY_PATTERNS + DIRECTORY_CONTENT_XPATHS, 3), after[-1]]
    return [(alt, least) for alts, least in rungs for alt in alts]


def select_with_fallback(dom, planner: Planner, specs: list, wanted: DataFrame, smart: bool = True,
                         rungs_of=element_rungs) -> DataFrame:
    """E6 (C2 with ``container_rungs``) for many elements at once: ``(page_id, scope_id, node_id, key)``.

    ``specs`` is ``[(key, element, parsed selector or None)]``; ``wanted(page_id,
    key)`` says which element is asked of which page.  All literal selectors run
    as one batched plan; their ladders run only for (page, element) pairs without
    a match, on those pages, a bounded group of elements per plan; the first rung
    with a match wins."""
    literal = [(k, sel) for k, _, sel in specs if sel is not None]
    empty = wanted.select("page_id", F.lit(0).alias("scope_id"), F.lit(0).alias("node_id"), "key").where(F.lit(False))
    found = planner.select_many(literal).join(wanted, ["page_id", "key"], "left_semi") if literal else empty
    if not smart:
        return found
    found = materialize(found.select("page_id", "scope_id", "node_id", "key"))
    missing = materialize(wanted.join(found.select("page_id", "key").distinct(), ["page_id", "key"], "left_anti"))
    asked = {r[0] for r in missing.select("key").distinct().collect()}  # keys of the template configuration
    rungs = []
    for k, element, sel in specs:
        if k in asked:
            for prio, (alt, least) in enumerate(rungs_of(element)):
                try:
                    parsed = parse_selector(alt) if isinstance(alt, str) else alt
                    check_compiles(parsed)
                except SelectorError as exc:
                    log.warning("rung %d of %s skipped: %s", prio, element.get("label"), exc)
                    continue
                rungs.append((k, f"{prio}:{least}|{k}", parsed))
    keys = sorted({k for k, _, _ in rungs})
    for i in range(0, len(keys), LADDER_GROUP):
        group = set(keys[i:i + LADDER_GROUP])
        todo = missing.where(F.col("key").isin(*group))
        part = Planner(dom.restrict(todo.select("page_id"))).select_many(
            [(rung, sel) for k, rung, sel in rungs if k in group])
        part = part.select("page_id", "scope_id", "node_id", F.split("key", "[:|]", 3).alias("_k")).select(
            "page_id", "scope_id", "node_id", F.col("_k")[0].cast("int").alias("_rung"),
            F.col("_k")[1].cast("int").alias("_least"), F.col("_k")[2].alias("key")).distinct()
        part = materialize(part.join(todo, ["page_id", "key"], "left_semi"))
        part = part.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("page_id", "key", "_rung"))).where(
            "_n >= _least")
        best = F.min("_rung").over(Window.partitionBy("page_id", "key"))
        part = part.withColumn("_best", best).where("_rung = _best").select("page_id", "scope_id", "node_id", "key")
        found = found.unionByName(materialize(part))
    return found


def container_ladder(selector: str, selector_type: str = "css", smart_detection: bool = False) -> list[tuple]:
    """C2 rungs as ``(alternatives, min_count)``: directory detection
    first when ``smart_detection``; then the template selector is tried by
    ``find_containers``; class-substring (E13), generalised (E11), variant
    (E12) and last-resort layouts (E20, > 5 matches) follow."""
    rungs = []
    if smart_detection:
        rungs.append((DIRECTORY_PATTERNS + DIRECTORY_CONTENT_XPATHS, 3))
    after = []
    if selector_type == "css" and not is_xpath(selector, selector_type):
        looser = class_substrings(selector) + without_positions(selector) + variants(selector)
        after += [([a], 1) for a in looser]
    after.append((LAST_RESORT_SELECTORS, 6))
    return rungs, after


def sub_element_ladder(sub: dict, context: str = "directory") -> list[str]:
    """The label-mapped selector list (E14, its alternatives in order),
    the original selector, then the scoped fallback XPaths (E15) for
    name / email / phone / title / position labels."""
    sel = sub.get("selector") or ""
    mapped = map_generic_selector(sub.get("label", ""), sel, context)
    alts = [a.strip() for a in split_top_level(mapped) if a.strip()] if not mapped.startswith("xpath:") \
        else [mapped[6:]]
    if sel and sel not in alts:
        alts.append(sel)
    lab = (sub.get("label") or "").lower()
    if any(k in lab for k in ("name", "email", "phone", "title", "position")):
        alts += fallback_xpaths(lab, sub.get("element_type") or "text")
    return alts


def resolve_sub_element(dom, planner: Planner, containers: DataFrame, sub: dict,
                        context: str = "directory", max_fraction: float = 0.8) -> DataFrame:
    """C3 as a plan: per container, the first of the label-mapped selectors
    (E14) or the original selector with a match; containers still without a
    match try the scoped fallback XPaths (E15) in order, keeping a rung only
    when its candidates pass validation (E16).  Returns ``(page_id,
    scope_id, node_id, priority)``."""
    from .detect import validate_candidates

    scope = containers.select("page_id", F.col("container_id").alias("scope_id"))
    alts = sub_element_ladder(sub, context)
    lab = (sub.get("label") or "").lower()
    et = sub.get("element_type") or "text"
    fb = fallback_xpaths(lab, et) if any(k in lab for k in ("name", "email", "phone", "title", "position")) else []
    head = [a for a in alts if a not in fb]
    # stage boundaries: the fallback rungs only run for containers the head
    # rungs left empty -- usually none, then nothing more is planned
    first = materialize(planner.select_first(head, scope=scope))
    todo = materialize(scope.join(first.select("page_id", "scope_id").distinct(), ["page_id", "scope_id"],
                                  "left_anti"))
    if not fb or todo.isEmpty():
        return first
    # all rungs as one batched plan; validated per rung, the first valid one wins
    named = []
    for i, xp in enumerate(fb):
        try:
            parsed = parse_selector(xp, relative=True)
            check_compiles(parsed)
        except SelectorError as exc:
            log.warning("rule skipped: %s", exc)
            continue
        named.append((str(len(head) + i), parsed))
    if not named:
        return first
    cands = planner.select_many(named, scope=todo).select(
        "page_id", "scope_id", "node_id", F.col("key").cast("int").alias("priority")).distinct()
    rest = validate_candidates(dom, cands, lab, et, max_fraction, by=("page_id", "scope_id", "priority")).select(
        "page_id", "scope_id", "node_id", "priority")
    best = F.min("priority").over(Window.partitionBy("page_id", "scope_id"))
    rest = rest.withColumn("_b", best).where(F.col("priority") == F.col("_b")).drop("_b")
    return first.unionByName(rest)
