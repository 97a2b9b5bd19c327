"""Subpages: follow links from records to other pages and merge (J1-J3, J5,
J7, J9-J11, P10, P11).

"Fetch the linked page" is an equi-join of the record's resolved link with
``pages.url`` (Catalyst/AQE picks broadcast or sort-merge; the link column can
be skewed -- one hub page linked from a third of all records -- which AQE's
skew-join split handles).  Subpage values are extracted with the same planner
as any page and joined back by ``subpage_id``.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import map_generic_selector
from ..functions.urls import strip_fragment
from ..plans.ast import SelectorError
from ..plans.compile import Planner
from ..plans.css import split_top_level
from ..session import materialize
from .values import node_values

log = logging.getLogger(__name__)

SUB_FIELDS_SCHEMA = "subpage_id BIGINT, label STRING, value_ord INT, value STRING, n_matches BIGINT"


def page_lookup(dom) -> DataFrame:
    """``(_link, page_id)``: one page per URL, without its fragment: of several
    page rows with html the lowest page_id."""
    docs = dom.docs.where("doc_text IS NOT NULL").select("page_id", strip_fragment(F.col("url")).alias("_link"))
    return docs.groupBy("_link").agg(F.min("page_id").alias("page_id"))


def follow_links(records: DataFrame, pages: DataFrame, link_col: str = "profile_link",
                 normalise: bool = True) -> DataFrame:
    """Left join records to pages by URL; adds ``subpage_id`` (NULL when
    no page has that URL -- the record is then kept as is)."""
    key = strip_fragment(F.col(link_col)) if normalise else F.col(link_col)
    target = pages.select(F.col("page_id").alias("subpage_id"),
                          (strip_fragment(F.col("url")) if normalise else F.col("url")).alias("_link"))
    # a URL can occur on several page rows: keep one page per URL (lowest id)
    target = target.groupBy("_link").agg(F.min("subpage_id").alias("subpage_id"))
    return records.withColumn("_link", key).join(target, "_link", "left").drop("_link")


def discover_link(fields_map: Column, profile_link: Column, keys_in_order: list[str]) -> Column:
    """``_profile_link`` else the first http value whose key has
    link/url/href (template key order)."""
    cands = [F.when(F.lit(any(w in k.lower() for w in ("link", "url", "href"))) &
                    F.get(fields_map[k], 0).startswith("http"), F.get(fields_map[k], 0)) for k in keys_in_order]
    return F.coalesce(profile_link, *cands) if cands else profile_link


def subpage_values(dom, planner: Planner, subpage_ids: DataFrame, elements: list[dict],
                   context: str = "profile", map_selectors: bool = True, cap: int | None = None) -> DataFrame:
    """Values of ``elements`` on the linked pages (P10 text rule):

    every match is trimmed; blanks and the word ``none`` are dropped; a label
    with more than one raw match is a list, with one match a scalar
    (``n_matches`` tells which); a label with nothing left is absent.  With
    ``cap`` only the first ``cap`` raw matches are used (P11)."""
    spark = dom.nodes.sparkSession
    ids = subpage_ids.select(F.col("subpage_id").alias("page_id")).where(F.col("page_id").isNotNull()).distinct()
    # select on the linked pages only, not on the whole page set; the id list
    # is written once so each selector's scan does not re-run its lineage
    dom = dom.restrict(materialize(ids))
    planner = Planner(dom)
    parts = []
    for el in elements:
        label = el["label"]
        selector = el.get("selector") or ""
        if map_selectors:
            selector = map_generic_selector(label, selector, context)
        alts = [a.strip() for a in split_top_level(selector) if a.strip()]
        try:  # E7: alternatives in order, the first one with a match wins
            m = planner.select_first(alts or [selector]).drop("priority")
        except SelectorError as exc:
            log.warning("subpage element %s skipped: %s", label, exc)
            continue
        if cap:
            w = Window.partitionBy("page_id").orderBy("node_id")
            m = m.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")
        v = node_values(dom, m, "text")
        n = v.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_matches"))
        v = v.where((F.col("value") != "") & (F.lower(F.col("value")) != "none"))
        w = Window.partitionBy("page_id").orderBy("node_id")
        v = v.withColumn("value_ord", F.row_number().over(w)).join(n, "page_id")
        parts.append(v.select(F.col("page_id").alias("subpage_id"), F.lit(label).alias("label"),
                              "value_ord", "value", "n_matches"))
    if not parts:
        return spark.createDataFrame([], SUB_FIELDS_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def overlay(record_fields: DataFrame, linked: DataFrame, sub_fields: DataFrame, sub_labels: list[str],
            key: list[str]) -> DataFrame:
    """Subpage fields overwrite record fields.

    ``record_fields(key..., label, value_ord, value)``; ``linked(key...,
    subpage_id)``.  For records whose page was found, every label of the
    subpage template is replaced by the subpage value (an absent subpage value
    removes the record's); records without a page are unchanged."""
    found = linked.where(F.col("subpage_id").isNotNull()).select(*key, "subpage_id")
    drop = (record_fields.join(found.select(*key), key, "left_semi")
            .where(F.col("label").isin(sub_labels)))
    kept = record_fields.join(drop.select(*key, "label").distinct(), key + ["label"], "left_anti")
    new = found.join(sub_fields, "subpage_id").select(*key, "label", "value_ord", "value")
    return kept.select(*key, "label", "value_ord", "value").unionByName(new)


def link_queue(records: DataFrame, link_col: str = "profile_link", by: str | None = None) -> DataFrame:
    """Distinct links (of each template, if ``by`` names that column), first
    container index kept, status ``pending`` (grouped aggregate: map-side
    combined, no window over a hot link)."""
    keys = [by] if by else []
    return (records.where(F.col(link_col).isNotNull() & (F.col(link_col) != ""))
            .groupBy(*keys, F.col(link_col).alias("url"))
            .agg(F.min("container_index").alias("container_index"))
            .withColumn("status", F.lit("pending")))


def process_queue(queue: DataFrame, pages: DataFrame, sub_fields_for: callable) -> tuple[DataFrame, DataFrame]:
    """The queue with its outcome, and the extracted rows.

    Each link is ``completed`` or ``failed`` (``No data extracted``, also where no
    stored page has that URL); ``error`` with the message where the extraction
    itself cannot be planned.  The rows carry ``profile_link`` and
    ``container_index`` of their link."""
    linked = materialize(follow_links(queue, pages, "url"))
    links = linked.select("url", "container_index", "subpage_id")
    try:
        fields = materialize(sub_fields_for(linked))
    except SelectorError as exc:
        none = linked.sparkSession.createDataFrame([], SUB_FIELDS_SCHEMA)
        rows = linked.select("subpage_id", F.col("url").alias("profile_link"), "container_index").join(none, "subpage_id")
        return links.withColumns({"status": F.lit("error"), "error": F.lit(str(exc))}), rows
    have = fields.select("subpage_id").distinct().withColumn("_has", F.lit(True))
    done = F.col("_has").isNotNull()
    outcome = links.join(have, "subpage_id", "left").select(
        *links.columns, F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(~done, "No data extracted").alias("error"))
    rows = linked.where("subpage_id IS NOT NULL").select(
        "subpage_id", F.col("url").alias("profile_link"), "container_index").join(fields, "subpage_id")
    return outcome, rows


def eligible_links(queue: DataFrame, url_pattern: str | None = None, max_subpages: int | None = None,
                   by: str = "template_id", order: tuple = ("container_index", "url")) -> DataFrame:
    """Links whose URL matches the pattern, at most ``max_subpages`` per
    template (column ``by``) in queue order.  Columns ``subpage_url_pattern`` and
    ``max_subpages`` of the queue hold for their own rows; without a limit all
    links stay.  Spark keeps the first rows of each group before the shuffle
    where the limit is a number."""
    q = queue
    if url_pattern:
        q = q.where(F.col("url").rlike(url_pattern))
    if "subpage_url_pattern" in queue.columns:
        q = q.where("subpage_url_pattern IS NULL OR url RLIKE subpage_url_pattern")
    w = Window.partitionBy(by).orderBy(*order)
    if max_subpages is not None:
        q = q.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_subpages).drop("_k")
    if "max_subpages" in queue.columns:
        free = q.where("max_subpages IS NULL")
        held = q.where("max_subpages IS NOT NULL").withColumn("_k", F.row_number().over(w))
        q = free.unionByName(held.where("_k <= max_subpages").drop("_k"))
    return q


def main_containers(dom, planner: Planner) -> DataFrame:
    """The main containers of each page, by the first pattern with a match."""
    from .containers import index_containers
    from .detect import SUBPAGE_MAIN_PATTERNS

    return index_containers(planner.select_first(SUBPAGE_MAIN_PATTERNS).select("page_id", "node_id").distinct())


def subpage_records_from_containers(dom, planner: Planner, containers: DataFrame | None = None,
                                    elements: list[dict] | None = None, marker: str = "/lawyer/") -> DataFrame:
    """Per main container (by default those of E19), its first link with
    ``marker`` among its links to ``marker`` pages, else among all its links, and
    what ``elements`` give on that page: ``(page_id, container_id,
    container_index, profile_link, subpage_id, fields, error)``.  ``error`` is ``No
    profile link found`` or, where ``elements`` are given, ``No data extracted``."""
    if containers is None:
        containers = materialize(main_containers(dom, planner))
    scope = containers.select("page_id", F.col("container_id").alias("scope_id"))
    anchors = planner.select("a", scope=scope)
    v = node_values(dom, anchors, "link", resolve_links=True).withColumnRenamed("scope_id", "container_id")
    v = v.where(F.col("value").contains(marker))
    first = v.groupBy("page_id", "container_id").agg(F.min_by("value", "node_id").alias("profile_link"))
    out = containers.join(first, ["page_id", "container_id"], "left")
    no_link = F.col("profile_link").isNull()
    if not elements:
        return out.withColumn("error", F.when(no_link, F.lit("No profile link found")))
    linked = materialize(follow_links(out, dom.docs, "profile_link"))
    values = subpage_values(dom, planner, linked, elements)
    per_label = values.groupBy("subpage_id", "label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("value_ord", "value"))), lambda s: s["value"]).alias("v"))
    folded = per_label.groupBy("subpage_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("label", "v")))).alias("fields"))
    return linked.join(folded, "subpage_id", "left").withColumn("error", F.when(
        no_link, F.lit("No profile link found")).when(F.col("fields").isNull(), F.lit("No data extracted")))


def directory_merge(main: DataFrame, sub: DataFrame) -> DataFrame:
    """One row per main record with its name, position, sector, email and
    profile link, and under ``subinfo`` the education and credentials of the first
    subpage record of the same index (null without either).

    ``main(page_id, container_index, label, value_ord, value, profile_link)`` and
    ``sub(page_id, container_index, record_no, label, value_ord, value)`` are long."""
    def one(name):
        return F.min_by(F.when(F.col("label") == name, F.col("value")), F.when(
            F.col("label") == name, F.col("value_ord"))).alias(name)

    base = main.groupBy("page_id", "container_index").agg(
        *[one(n) for n in ("name", "position", "sector", "email")], F.min("profile_link").alias("profile_link"))
    first = sub.groupBy("page_id", "container_index").agg(F.min("record_no").alias("record_no"))
    own = sub.join(first, ["page_id", "container_index", "record_no"]).where(F.col("label").isin("education", "creds"))
    lists = own.groupBy("page_id", "container_index", "label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("value_ord", "value"))), lambda s: s["value"]).alias("v"))
    info = lists.groupBy("page_id", "container_index").agg(
        F.max(F.when(F.col("label") == "education", F.col("v"))).alias("education"),
        F.max(F.when(F.col("label") == "creds", F.col("v"))).alias("credentials"))
    sub_info = F.when(F.col("education").isNotNull() | F.col("credentials").isNotNull(),
                      F.struct("education", "credentials"))
    return base.join(info, ["page_id", "container_index"], "left").select(
        *base.columns, sub_info.alias("subinfo"))
