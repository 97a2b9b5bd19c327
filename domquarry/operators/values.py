"""Value projections of matched nodes.

``node_values`` turns matches ``(page_id, scope_id, node_id, ...)`` into
``value`` strings:

* ``text``      trimmed full text (P1); ``text_mode='own'`` uses own text only;
* ``html``      outer HTML, a slice of ``pages.html`` (P2);
* ``link``      raw ``href`` or ``''`` (P3), or resolved against the page URL
                with ``resolve_links=True`` (P4);
* ``attribute`` the named attribute (default ``value``) or ``''`` (P5).

Full text is cut from the page text only for nodes whose text is long; the node
rows carry the others' (``short_text``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import urljoin
from ..plans.compile import full_text_col

_WS_TRIM = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(c, _WS_TRIM, "")


def node_values(dom, matched: DataFrame, element_type: str = "text", attribute_name: str | None = None,
                text_mode: str = "full", resolve_links: bool = False, trim: bool = True) -> DataFrame:
    """Add ``value`` to ``matched``; all other columns are kept."""
    et = (element_type or "text").lower()
    cols = ["page_id", "node_id", "own_text", "text_start", "text_end", "attrs", "html_start", "html_end", "tag",
            "short_text"]
    info = dom.nodes.select(*cols)
    m = matched.join(info, ["page_id", "node_id"])
    keep = matched.columns
    if et == "html":
        html = dom.pages.select("page_id", "html")
        m = m.join(html, "page_id")
        value = F.expr("substring(html, html_start + 1, html_end - html_start)")
    elif et == "link":
        href = F.coalesce(F.col("attrs")["href"], F.lit(""))
        if resolve_links:
            m = m.join(dom.docs.select("page_id", F.col("url").alias("_base")), "page_id")
            value = urljoin(F.col("_base"), href)
        else:
            value = href
    elif et == "attribute":
        value = F.coalesce(F.col("attrs")[attribute_name or "value"], F.lit(""))
    else:  # text and anything unknown
        if text_mode == "own":
            value = F.col("own_text")
        else:
            # long texts are slices of the page text (docs share the node table's
            # page_id partitioning, so this join needs no exchange)
            m = m.join(dom.docs.select("page_id", "doc_text"), "page_id", "left")
            value = full_text_col()
    out = m.withColumn("value", value)
    if trim and et == "text":
        out = out.withColumn("value", strip(F.col("value")))
    return out.select(*keep, "value")


def chain_values(dom, matched: DataFrame, output: str, attr_name: str | None, element_type: str,
                 attribute_name: str | None, resolve_links: bool = False) -> DataFrame:
    """Honour XPath ``text()`` / ``@attr`` final steps, else ``node_values``."""
    if output == "own_text":
        return node_values(dom, matched, "text", text_mode="own")
    if output == "attr":
        return node_values(dom, matched, "attribute", attribute_name=attr_name, trim=False)
    return node_values(dom, matched, element_type, attribute_name, resolve_links=resolve_links)


def page_title(dom, planner) -> DataFrame:
    """``<title>`` text, else the first ``<h1>``, else ``'Unknown'``."""
    t = node_values(dom, planner.select("title"), "text").withColumn("prio", F.lit(0))
    h = node_values(dom, planner.select("h1"), "text").withColumn("prio", F.lit(1))
    cand = t.unionByName(h).where(F.col("value") != "")
    best = (cand.groupBy("page_id")
            .agg(F.min_by(F.col("value"), F.struct("prio", "node_id")).alias("page_title")))
    return (dom.docs.select("page_id").join(best, "page_id", "left")
            .select("page_id", F.coalesce("page_title", F.lit("Unknown")).alias("page_title")))


def _value_expr(spec: dict) -> Column:
    output = spec.get("output", "node")
    et = (spec.get("element_type") or "text").lower()
    if output == "own_text":
        return strip(F.col("own_text"))
    if output == "attr":
        return F.coalesce(F.col("attrs")[spec.get("attr_name")], F.lit(""))
    if et == "html":
        return F.expr("substring(html, html_start + 1, html_end - html_start)")
    if et == "link":
        href = F.coalesce(F.col("attrs")["href"], F.lit(""))
        return urljoin(F.col("_base"), href) if spec.get("resolve_links") else href
    if et == "attribute":
        return F.coalesce(F.col("attrs")[spec.get("attribute_name") or "value"], F.lit(""))
    return strip(full_text_col())


def keyed_values(dom, matched: DataFrame, specs: dict) -> DataFrame:
    """``node_values`` for many selectors at once: ``matched`` carries a
    ``key`` column and ``specs[key]`` says how to read the value (element
    type, attribute, link resolution, XPath output).  One join with the node
    table and one with the page rows serve every key."""
    keep = matched.columns
    info = dom.nodes.select("page_id", "node_id", "own_text", "text_start", "text_end", "attrs",
                            "html_start", "html_end", "tag", "short_text")
    m = matched.join(info, ["page_id", "node_id"])
    kinds = {(s.get("element_type") or "text").lower() for s in specs.values() if s.get("output", "node") == "node"}
    docs = dom.docs.select("page_id", F.col("url").alias("_base"), "doc_text")
    m = m.join(docs, "page_id", "left")
    if "html" in kinds:
        m = m.join(dom.pages.select("page_id", "html"), "page_id", "left")
    value = None
    for key, spec in specs.items():
        e = _value_expr(spec)
        value = F.when(F.col("key") == key, e) if value is None else value.when(F.col("key") == key, e)
    return m.withColumn("value", value).select(*keep, "value")
