"""Page-level extraction and counting in the scan itself (X1, E2-E12, A1, A2, W7-W9 without a node table).

``extract_pages`` reads every page once, in an Arrow pass over the page table, runs the automaton
of all selectors of a template on it (``plans.onepass``) and emits the values that the template asks for,
and nothing else: no node rows are shuffled or kept, and there is no window or join after it.  An element
that a page lacks goes through its ladder (E6) on that page at once, by a second automaton that
holds the rungs of all elements.  Elements with a selector or rung that walks up
the tree are extracted over the node table by ``extract_elements``.

Results for odd input: a null or empty html has no element, so required elements are errors there; a page
that is in the table twice gives its rows twice; an empty table gives no row; further columns
of the pages are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import urljoin
from ..plans.ast import SelectorError, SelectorList
from ..plans.compile import chain_output, check_compiles, parse_selector
from ..plans.onepass import Automaton, Page, reads_in_one_pass
from .extract import extract_elements, is_location_element
from .fallback import element_ladder
from .nodes import build_dom
from .pagescan import over_pages

log = logging.getLogger(__name__)

_BLANK = " \t\n\x0b\f\r"
_FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("element", pa.int32()), ("value_ord", pa.int32()),
                    ("value", pa.string()), ("node_id", pa.int32())])
_FOUND_DDL = "page_id BIGINT, url STRING, element INT, value_ord INT, value STRING, node_id INT"
EXTRACTED = ["page_id", "url", "label", "value_ord", "value", "node_id", "error"]


def _reader(spec: dict) -> Callable:
    """The value of a node, as ``operators.values`` reads it (links are resolved later)."""
    if spec["output"] == "own_text":
        return lambda page, i: page.own[i].strip(_BLANK)
    if spec["output"] == "attr":
        return lambda page, i: page.attrs[i].get(spec["attr_name"]) or ""
    kind = spec["element_type"]
    if kind == "html":
        return lambda page, i: page.outer_html(i)
    if kind in ("link", "attribute"):
        name = "href" if kind == "link" else spec["attribute_name"] or "value"
        return lambda page, i: page.attrs[i].get(name) or ""
    return lambda page, i: page.text(i).strip(_BLANK)


def _parsed(selector, selector_type: str, on_bad: str, label: str) -> SelectorList | None:
    try:
        sel = parse_selector(selector, selector_type) if isinstance(selector, str) else selector
        check_compiles(sel)
    except SelectorError as exc:
        if on_bad != "empty":
            raise
        log.warning("selector of %s skipped: %s", label, exc)
        return None
    return sel


def extract_pages(pages: DataFrame, elements: list[dict], on_bad_selector: str = "empty", resolve_links: bool = False,
                  smart: bool = True) -> DataFrame:
    """X1 for all page-level ``elements``: ``(page_id, url, label, value_ord, value, node_id, error)``.

    A row is a value (``error`` null; single elements have ``value_ord`` 1, multiple ones keep document
    order) or a required element that its page lacks (``value`` null).  Location-like elements are
    never errors."""
    wanted, joined = [], []
    for el in elements:
        if el.get("is_container"):
            continue
        sel = _parsed(el["selector"], el.get("selector_type") or "css", on_bad_selector, el["label"])
        rungs = [_parsed(alt, "css", "empty", el["label"]) for alt in element_ladder(el)[1:]] if smart else []
        rungs = [r for r in rungs if r is not None]
        if all(reads_in_one_pass(s) for s in [sel, *rungs] if s is not None):
            wanted.append((el, sel, rungs))
        else:
            joined.append(el)
    parts = [_in_one_pass(pages, wanted, resolve_links)] if wanted else []
    if joined:
        parts.append(_over_nodes(pages, joined, on_bad_selector, resolve_links, smart))
    if not parts:
        return pages.sparkSession.createDataFrame(
            [], "page_id BIGINT, url STRING, label STRING, value_ord INT, value STRING, node_id INT, error STRING")
    return reduce(DataFrame.unionByName, parts)


def _missing(el: dict) -> str | None:
    """The error of a page without the element, null where it may be missing."""
    if not el.get("is_required", True) or is_location_element(el["label"], el.get("selector")):
        return None
    return f"Failed to extract {el['label']}: Required element not found: {el['selector']}"


def _in_one_pass(pages: DataFrame, wanted: list, resolve_links: bool) -> DataFrame:
    literal = Automaton([(k, sel) for k, (_, sel, _) in enumerate(wanted) if sel is not None])
    ladder = Automaton([((k, rung), sel) for k, (_, _, rungs) in enumerate(wanted) for rung, sel in enumerate(rungs)])
    readers, many, needed, links = [], [], [], []
    for el, sel, _ in wanted:
        output, attr_name = chain_output(sel) if sel is not None else ("node", None)
        kind = (el.get("element_type") or "text").lower()
        readers.append(_reader({"output": output, "attr_name": attr_name, "element_type": kind,
                                "attribute_name": el.get("attribute_name")}))
        many.append(bool(el.get("is_multiple")))
        needed.append(_missing(el) is not None)
        links.append(resolve_links and output == "node" and kind == "link")
    has_rungs = {k for k, (_, _, rungs) in enumerate(wanted) if rungs}

    def rows_of(page_id, url, html):
        page = Page(html)
        found = literal.run(page)
        if any(k not in found for k in has_rungs):
            first: dict = {}
            hits = ladder.run(page)
            for k, rung in sorted(hits):
                first.setdefault(k, hits[k, rung])
            found = first | found
        for k, reader in enumerate(readers):
            nodes = found.get(k, ())
            for place, i in enumerate(nodes if many[k] else nodes[:1], 1):
                yield page_id, url, k, place, reader(page, i), i
            if not nodes and needed[k]:
                yield page_id, url, k, None, None, None

    found = over_pages(pages, rows_of, _FOUND, _FOUND_DDL)

    def of_element(values):
        return F.array(*[F.lit(v).cast("string") for v in values])[F.col("element")]

    value = F.col("value")
    if any(links):
        value = F.when(F.array(*[F.lit(x) for x in links])[F.col("element")], urljoin(F.col("url"), value)).otherwise(value)
    return found.select(
        "page_id", "url", of_element(el["label"] for el, _, _ in wanted).alias("label"), "value_ord", value.alias("value"),
        "node_id", F.when(F.col("node_id").isNull(), of_element(_missing(el) for el, _, _ in wanted)).alias("error")
    ).select(*EXTRACTED)


def _over_nodes(pages: DataFrame, elements: list[dict], on_bad: str, resolve_links: bool, smart: bool) -> DataFrame:
    dom = build_dom(pages)
    values, errors = extract_elements(dom, elements, None, on_bad, resolve_links, smart)
    rows = values.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
    return rows.join(dom.docs.select("page_id", "url"), "page_id").select(*EXTRACTED)
