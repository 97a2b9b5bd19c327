"""Page-level element extraction (P6, P7, P8, E5-E9) and the wide pivot.

``extract_elements`` returns two long tables:

* ``values(page_id, label, value_ord, value)`` -- one row per value; single
  elements have ``value_ord = 1``, multiple elements keep document order;
* ``errors(page_id, label, error)`` -- a missing required element fails its
  page, unless it is location-like (then the value is NULL, no error).
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ast import SelectorError
from ..plans.compile import Planner, chain_output, check_compiles, parse_selector
from .fallback import select_with_fallback
from .values import keyed_values

log = logging.getLogger(__name__)

VALUES_SCHEMA = "page_id BIGINT, label STRING, value_ord INT, value STRING, node_id INT"
ERRORS_SCHEMA = "page_id BIGINT, label STRING, error STRING"

# City names that mark a selector as location-specific.
LOCATION_CITIES = ["Riyadh", "Dubai", "London", "New York"]


def is_location_element(label: str, selector: str) -> bool:
    lab = (label or "").lower()
    sel = selector or ""
    return ("location" in lab or "city" in lab or "normalize-space" in sel.lower()
            or any(c in sel for c in LOCATION_CITIES))


def extract_elements(dom, elements: list[dict], planner: Planner | None = None,
                     on_bad_selector: str = "empty", resolve_links: bool = False, smart: bool = True):
    """All page-level elements of a template in one batched plan: the
    selectors share one scan of the node table (``select_many``), values are
    read in one pass (``keyed_values``) and ordered by one per-page window.
    ``smart`` sends pages where an element is not found through its fallback
    ladder (E6)."""
    planner = planner or Planner(dom)
    spark = dom.nodes.sparkSession
    named, specs, labels = [], {}, {}
    for i, el in enumerate(elements):
        if el.get("is_container"):
            continue
        key = f"e{i}"
        try:
            sel = parse_selector(el["selector"], el.get("selector_type") or "css")
            check_compiles(sel)
        except SelectorError as exc:
            if on_bad_selector != "empty":
                raise
            log.warning("selector of %s skipped: %s", el["label"], exc)
            sel = None
        output, attr_name = chain_output(sel) if sel else ("node", None)
        named.append((key, el, sel))
        specs[key] = {"element_type": el.get("element_type") or "text", "attribute_name": el.get("attribute_name"),
                      "output": output, "attr_name": attr_name, "resolve_links": resolve_links}
        labels[key] = (el["label"], bool(el.get("is_multiple")))
    if named:
        keys = F.explode(F.array(*[F.lit(k) for k, _, _ in named])).alias("key")
        m = select_with_fallback(dom, planner, named, dom.docs.select("page_id", keys), smart)
        v = keyed_values(dom, m, specs).where(F.col("value").isNotNull())
        multi = [k for k, (_, mult) in labels.items() if mult]
        w = Window.partitionBy("page_id", "key").orderBy("node_id")
        v = v.withColumn("value_ord", F.row_number().over(w))
        v = v.where(F.col("key").isin(multi) | (F.col("value_ord") == 1)) if multi else v.where("value_ord = 1")
        label_of = F.create_map(*[x for k, (lab, _) in labels.items() for x in (F.lit(k), F.lit(lab))])
        values = v.select("page_id", label_of[F.col("key")].alias("label"), F.col("value_ord").cast("int"),
                          "value", "node_id")
    else:
        values = spark.createDataFrame([], VALUES_SCHEMA)
    errs = []
    pages = dom.pages.select("page_id")
    for el in elements:
        if el.get("is_container"):
            continue
        label = el["label"]
        if el.get("is_required", True) and not is_location_element(label, el.get("selector")):
            have = values.where(F.col("label") == label).select("page_id")
            missing = pages.join(have, "page_id", "left_anti")
            errs.append(missing.select("page_id", F.lit(label).alias("label"),
                                       F.lit(f"Failed to extract {label}: Required element not found: "
                                             f"{el['selector']}").alias("error")))
    errors = reduce(DataFrame.unionByName, errs) if errs else spark.createDataFrame([], ERRORS_SCHEMA)
    return values, errors
