"""Containers.

A container element matches repeating nodes (cards); each match becomes a
record whose fields are its sub-elements, matched *inside* the card (scoped
selection, E3).  Records are kept long:

``fields(page_id, container_id, container_index, label, value_ord, value)``

and folded to ``MAP<STRING, ARRAY<STRING>>`` or pivoted only at the edge.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ast import SelectorError
from ..plans.compile import Planner, chain_output, parse_selector
from ..plans.css import split_top_level
from .values import keyed_values, node_values

log = logging.getLogger(__name__)

FIELDS_SCHEMA = ("page_id BIGINT, container_id INT, container_index INT, label STRING, "
                 "value_ord INT, value STRING")

# Label words that make a container field multi-valued.
MULTI_VALUE_WORDS = ["sector", "practice", "area", "expertise"]
# Label words that mark a link sub-element as the profile link (C4).
PROFILE_LINK_WORDS = ["profile", "link", "url", "page"]


def is_multi_valued(label: str) -> bool:
    lab = (label or "").lower()
    return any(w in lab for w in MULTI_VALUE_WORDS)


def index_containers(matched: DataFrame) -> DataFrame:
    """0-based ``container_index`` in document order, per page.  Persisted:
    every sub-element scopes its selection to this small set."""
    w = Window.partitionBy("page_id").orderBy("node_id")
    return matched.select("page_id", F.col("node_id").alias("container_id"),
                          (F.row_number().over(w) - 1).alias("container_index"))


def find_containers(planner: Planner, selector: str, selector_type: str = "css",
                    ladder: list[tuple[list[str], int]] | None = None,
                    after: list[tuple[list[str], int]] | None = None,
                    use_find_similar: bool = False) -> DataFrame:
    """Container nodes.  ``ladder`` / ``after`` (C2, E13, E18, E20) are
    ordered ``(alternatives, min_count)`` rungs tried before / after the
    template selector; per page, the first rung with enough matches wins.
    ``use_find_similar`` replaces a page's matches by the nodes similar to its
    first match (E21), where there are any."""
    if use_find_similar:
        from .detect import similar_nodes

        found = find_containers(planner, selector, selector_type, ladder, after)
        first = found.where("container_index = 0").select("page_id", F.col("container_id").alias("example_id"))
        similar = similar_nodes(planner.dom, first).select("page_id", F.col("node_id").alias("container_id")).distinct()
        own = found.join(similar.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "container_id")
        return index_containers(similar.unionByName(own).withColumnRenamed("container_id", "node_id"))
    if not ladder and not after:
        return index_containers(planner.select(selector, selector_type=selector_type))
    rungs = [*(ladder or []), ([selector], 1), *(after or [])]
    flat = [(alt, min_count) for alts, min_count in rungs for alt in alts]
    return index_containers(planner.select_ranked(flat, selector_type=selector_type).select(
        "page_id", "scope_id", "node_id").distinct())


def container_fields(dom, planner: Planner, containers: DataFrame, sub_elements: list[dict],
                     first_alternative: bool = False, multi_value_rule: bool = True,
                     on_bad_selector: str = "empty") -> DataFrame:
    """One row per (container, label, value).

    All sub-elements are matched in one batched plan (``select_many``) and
    read in one values pass; per (container, label) the first match in
    document order is kept, or all non-blank matches for multi-valued labels
    (P9)."""
    spark = dom.nodes.sparkSession
    scope = containers.select("page_id", F.col("container_id").alias("scope_id"))
    named, specs, parts = [], {}, []
    for i, sub in enumerate(sub_elements):
        key = f"{i}:{sub['label']}"
        selector = (sub.get("selector") or "").strip()
        spec = {"element_type": sub.get("element_type") or "text", "attribute_name": sub.get("attribute_name"),
                "resolve_links": True, "multi": multi_value_rule and is_multi_valued(sub["label"])}
        try:
            if selector == "":  # P13: the container itself
                parts.append(containers.select("page_id", F.col("container_id").alias("scope_id"),
                                               F.col("container_id").alias("node_id"), F.lit(key).alias("key")))
            elif first_alternative and len([a for a in split_top_level(selector) if a.strip()]) > 1:
                alts = [a.strip() for a in split_top_level(selector) if a.strip()]
                parts.append(planner.select_first(alts, scope=scope).drop("priority")
                             .withColumn("key", F.lit(key)))
            else:
                sel = parse_selector(selector, sub.get("selector_type") or "css", relative=True)
                spec["output"], spec["attr_name"] = chain_output(sel)
                named.append((key, sel))
        except SelectorError as exc:
            if on_bad_selector == "empty":
                log.warning("sub-element %s skipped: %s", sub["label"], exc)
                continue
            raise
        specs[key] = spec
    if named:
        parts.append(planner.select_many(named, scope=scope))
    if not parts:
        return spark.createDataFrame([], FIELDS_SCHEMA)
    matched = reduce(DataFrame.unionByName, parts)
    v = keyed_values(dom, matched, specs).withColumnRenamed("scope_id", "container_id")
    multi_keys = [k for k, sp in specs.items() if sp["multi"]]
    is_multi = F.col("key").isin(multi_keys) if multi_keys else F.lit(False)
    v = v.where(F.col("value").isNotNull() & ~(is_multi & (F.col("value") == "")))
    w = Window.partitionBy("page_id", "container_id", "key").orderBy("node_id")
    v = v.withColumn("value_ord", F.row_number().over(w)).where(is_multi | (F.col("value_ord") == 1))
    label = F.regexp_extract("key", r"^\d+:(.*)$", 1)
    return v.join(containers, ["page_id", "container_id"]).select(
        "page_id", "container_id", "container_index", label.alias("label"), "value_ord", "value")


def container_text_fallback(dom, containers: DataFrame, fields: DataFrame) -> DataFrame:
    """A container without any field gets its text as field ``text``."""
    empty = containers.join(fields.select("page_id", "container_id").distinct(),
                            ["page_id", "container_id"], "left_anti")
    txt = node_values(dom, empty.select("page_id", "container_id", "container_index",
                                        F.col("container_id").alias("node_id")), "text")
    return fields.unionByName(txt.select("page_id", "container_id", "container_index",
                                         F.lit("text").alias("label"), F.lit(1).alias("value_ord"), "value"))


def profile_link_pick(dom, planner: Planner, containers: DataFrame, fields: DataFrame,
                      sub_elements: list[dict], follow_links: bool = False,
                      marker: str = "/lawyer/") -> DataFrame:
    """C4: ``(page_id, container_id, profile_link)``.

    Priority: the last link sub-element with a value whose label has profile/link/url/page;
    else the first link sub-element with a value when ``follow_links``; else the first ``a``
    in the card whose href holds ``marker``."""
    link_labels = [s["label"] for s in sub_elements if (s.get("element_type") or "text") == "link"]
    named = [l for l in link_labels if any(w in l.lower() for w in PROFILE_LINK_WORDS)]
    cands = []
    order = {l: i for i, l in enumerate(link_labels)}
    if named:
        cands.append(fields.where(F.col("label").isin(named) & (F.col("value") != ""))
                     .select("page_id", "container_id", F.lit(0).alias("prio"),
                             (-F.element_at(F.create_map(*[x for l in named for x in (F.lit(l), F.lit(order[l]))]),
                                            F.col("label"))).alias("sub"), "value"))
    if follow_links and link_labels:
        cands.append(fields.where(F.col("label").isin(link_labels) & (F.col("value") != ""))
                     .select("page_id", "container_id", F.lit(1).alias("prio"),
                             F.element_at(F.create_map(*[x for l in link_labels
                                                         for x in (F.lit(l), F.lit(order[l]))]),
                                          F.col("label")).alias("sub"), "value"))
    scope = containers.select("page_id", F.col("container_id").alias("scope_id"))
    anchors = planner.select(f"a[href*='{marker}']", scope=scope)
    av = node_values(dom, anchors, "link", resolve_links=True).withColumnRenamed("scope_id", "container_id")
    cands.append(av.select("page_id", "container_id", F.lit(2).alias("prio"), F.col("node_id").alias("sub"),
                           "value"))
    allc = reduce(DataFrame.unionByName, cands)
    return (allc.groupBy("page_id", "container_id")
            .agg(F.min_by("value", F.struct("prio", "sub")).alias("profile_link")))


def records(fields: DataFrame) -> DataFrame:
    """Fold long fields into one row per container with a
    ``MAP<STRING, ARRAY<STRING>>`` (labels in any order, values in order)."""
    per_label = (fields.groupBy("page_id", "container_id", "container_index", "label")
                 .agg(F.array_sort(F.collect_list(F.struct("value_ord", "value"))).alias("vs")))
    per_label = per_label.withColumn("vs", F.transform("vs", lambda s: s["value"]))
    return (per_label.groupBy("page_id", "container_id", "container_index")
            .agg(F.map_from_entries(F.collect_list(F.struct("label", "vs"))).alias("fields")))


def main_page_containers(templates: DataFrame) -> DataFrame:
    """Per template, the container elements that are *not* subpage
    containers (T3) -- the ones extracted from the main page only."""
    from .analyze import is_subpage_container
    el = F.filter("elements", lambda e: F.coalesce(e["is_container"], F.lit(False)) & ~is_subpage_container(e))
    return templates.select("name", F.explode(el).alias("element"))
