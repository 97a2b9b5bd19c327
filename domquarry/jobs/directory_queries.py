"""Round-trip queries (oracle kind RT): pages rendered in Spark from
``supplier`` / ``nation`` / ``region``, extracted back with templates, compared
with plain SQL on the source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import render
from ..operators.containers import (container_fields, container_text_fallback, find_containers,
                                    profile_link_pick)
from ..operators.nodes import build_dom
from ..operators.subpages import directory_merge as merge_directory
from ..operators.subpages import (follow_links, link_queue, overlay, process_queue,
                                  subpage_records_from_containers, subpage_values)
from ..session import materialize
from .common import cached_dom, table

PER_PAGE = 4

CARD_SUBS = [
    {"label": "name", "selector": "h3"},
    {"label": "position", "selector": "span.position"},
    {"label": "email", "selector": "a[href^='mailto:']"},
    {"label": "profile_link", "selector": "a.profile", "element_type": "link"},
    {"label": "sectors", "selector": "span.sector"},
]
PROFILE_ELEMENTS = [
    {"label": "education", "selector": "ul.education li"},
    {"label": "admissions", "selector": "ul.admissions li"},
]


def rendered_pages(spark, sf_dir, overlap=0, trailing=0):
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    d = render.directory_pages(supplier, nation, PER_PAGE, overlap, trailing)
    p = render.profile_pages(supplier, nation, region)
    return d.select("page_id", "url", "html").unionByName(p)


def rendered_dom(spark, sf_dir, overlap=0, trailing=0):
    return cached_dom((spark.sparkContext.applicationId, sf_dir, "directories", overlap, trailing),
                      lambda: build_dom(rendered_pages(spark, sf_dir, overlap, trailing)))


def _cards(spark, sf_dir, overlap=0, trailing=0):
    dom, planner = rendered_dom(spark, sf_dir, overlap, trailing)
    # stage boundaries: containers and their fields feed several branches
    containers = materialize(find_containers(planner, "div.profile-card"))
    fields = materialize(container_fields(dom, planner, containers, CARD_SUBS))
    return dom, planner, containers, fields


def _pivot_cards(fields):
    one = lambda l: F.max(F.when(F.col("label") == l, F.col("value")))
    return (fields.groupBy("page_id", "container_id", "container_index").agg(
        one("name").alias("name"), one("position").alias("position"), one("email").alias("email"),
        one("profile_link").alias("profile_link"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("label") == "sectors", F.struct("value_ord", "value")))), lambda s: s["value"]),
            "|").alias("sectors")))


def directory_cards(spark, sf_dir):
    """C1 + E3 + P4 + P9: one record per card, sub-elements scoped to it."""
    dom, planner, containers, fields = _cards(spark, sf_dir)
    wide = _pivot_cards(fields)
    return (wide.join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", F.col("container_index").cast("bigint").alias("container_index"), "name",
                    "position", "email", "profile_link", "sectors"))


_SUPPLIERS = """
WITH s AS (
  SELECT s.*, n.n_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS rnk
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)"""
_POSITION = ("CASE WHEN s_acctbal >= 5000 THEN 'Partner' WHEN s_acctbal >= 0 THEN 'Associate' "
             "ELSE 'Counsel' END")
_SECTORS = ("CASE WHEN s_suppkey % 2 = 0 THEN 'Sector ' || (s_suppkey % 7) || '|Sector ' || (s_suppkey % 5 + 10) "
            "ELSE 'Sector ' || (s_suppkey % 7) END")

DIRECTORY_CARDS_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1) AS url,
       CAST(rnk % {PER_PAGE} AS BIGINT) AS container_index, s_name AS name, {_POSITION} AS position,
       lower(replace(s_name, '#', '.')) || '@dir.example' AS email,
       'https://dir.example/lawyer/' || s_suppkey AS profile_link, {_SECTORS} AS sectors
FROM s
"""


def _with_profiles(spark, sf_dir):
    dom, planner, containers, fields = _cards(spark, sf_dir)
    links = materialize(profile_link_pick(dom, planner, containers, fields, CARD_SUBS))
    recs = containers.join(links, ["page_id", "container_id"], "left")
    linked = materialize(follow_links(recs, dom.docs, "profile_link"))
    sub = materialize(subpage_values(dom, planner, linked, PROFILE_ELEMENTS))
    key = ["page_id", "container_id", "container_index"]
    merged = overlay(fields, linked.select(*key, "subpage_id"), sub, [e["label"] for e in PROFILE_ELEMENTS], key)
    return dom, merged.join(links, ["page_id", "container_id"], "left")


def _joined(label):
    return F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("label") == label, F.struct("value_ord", "value")))), lambda s: s["value"]), "|")


def directory_profiles(spark, sf_dir):
    """C4 + J1 + J3 + P10 + E7: cards joined to their profile pages by URL;
    profile fields overlay the card; missing pages leave the card as is."""
    dom, merged = _with_profiles(spark, sf_dir)
    out = merged.groupBy("page_id", "container_id", "profile_link").agg(
        F.max(F.when(F.col("label") == "name", F.col("value"))).alias("name"),
        F.when(F.count(F.when(F.col("label") == "education", 1)) > 0, _joined("education")).alias("education"),
        F.when(F.count(F.when(F.col("label") == "admissions", 1)) > 0, _joined("admissions")).alias("admissions"))
    return out.select("profile_link", "name", "education", "admissions")


DIRECTORY_PROFILES_SQL = """
SELECT 'https://dir.example/lawyer/' || s_suppkey AS profile_link, s_name AS name,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'University of ' || n_name || '|' || r_name || ' Law School' END
         AS education,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'Bar of ' || n_name END AS admissions
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def directory_merge(spark, sf_dir):
    """Fixed projection (name, position, sector, email, profile_link) +
    ``subinfo`` struct {education, credentials} only when non-empty."""
    dom, planner, containers, fields = _cards(spark, sf_dir)
    links = materialize(profile_link_pick(dom, planner, containers, fields, CARD_SUBS))
    recs = containers.join(links, ["page_id", "container_id"], "left")
    linked = materialize(follow_links(recs, dom.docs, "profile_link"))
    sub = materialize(subpage_values(dom, planner, linked, PROFILE_ELEMENTS))
    sector = fields.where("label = 'sectors'").groupBy("page_id", "container_index").agg(_joined("sectors").alias("value"))
    main = fields.where("label <> 'sectors'").select("page_id", "container_index", "label", "value_ord", "value").unionByName(
        sector.select("page_id", "container_index", F.lit("sector").alias("label"), F.lit(1).alias("value_ord"), "value"))
    main = main.join(recs.select("page_id", "container_index", "profile_link"), ["page_id", "container_index"])
    subs = linked.join(sub, "subpage_id").select(
        "page_id", "container_index", F.lit(0).alias("record_no"),
        F.when(F.col("label") == "admissions", "creds").otherwise(F.col("label")).alias("label"), "value_ord", "value")
    out = merge_directory(main, subs)
    return out.select("name", "position", "sector", "email", "profile_link",
                      F.array_join("subinfo.education", "|").alias("subinfo_education"),
                      F.array_join("subinfo.credentials", "|").alias("subinfo_credentials"))


DIRECTORY_MERGE_SQL = f"""
SELECT s_name AS name, {_POSITION} AS position, {_SECTORS} AS sector,
       lower(replace(s_name, '#', '.')) || '@dir.example' AS email,
       'https://dir.example/lawyer/' || s_suppkey AS profile_link,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'University of ' || n_name || '|' || r_name || ' Law School' END
         AS subinfo_education,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'Bar of ' || n_name END AS subinfo_credentials
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def subpage_link_status(spark, sf_dir):
    """J7 + J9 + J10: per card the first ``/lawyer/`` link; the distinct link
    queue; each link completed (page found, data) or failed."""
    dom, planner = rendered_dom(spark, sf_dir)
    containers = find_containers(planner, "div.profile-card")
    main = subpage_records_from_containers(dom, planner, containers)
    queue = link_queue(main)

    def fields_for(linked):
        return subpage_values(dom, planner, linked, PROFILE_ELEMENTS)

    done, _ = process_queue(queue, dom.docs, fields_for)
    return done.select("url", F.col("container_index").cast("bigint").alias("container_index"), "status", "error")


SUBPAGE_LINK_STATUS_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/lawyer/' || s_suppkey AS url, CAST(rnk % {PER_PAGE} AS BIGINT) AS container_index,
       CASE WHEN s_suppkey % 10 = 3 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN s_suppkey % 10 = 3 THEN 'No data extracted' END AS error
FROM s
"""


def subpage_container_rows(spark, sf_dir):
    """E19 + J7 + J10: the main containers of the listings by the first pattern
    with a match, each with its profile link, what the linked page gives, and the
    error where there is no link or no data."""
    dom, planner = rendered_dom(spark, sf_dir)
    listing = dom.docs.where(F.col("url").rlike(r"/people\?page=")).select("page_id")
    cards = materialize(find_containers(planner, "div.profile-card, div.directory").join(listing, "page_id", "left_semi"))
    rows = subpage_records_from_containers(dom, planner, cards, PROFILE_ELEMENTS)
    name = F.array_join(F.col("fields")["education"], "|")
    return rows.join(dom.docs.select("page_id", "url"), "page_id").select(
        "url", F.col("container_index").cast("bigint").alias("container_index"), "profile_link",
        name.alias("education"), "error")


SUBPAGE_CONTAINER_ROWS_SQL = f"""{_SUPPLIERS},
r AS (
  SELECT s.*, 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1) AS url,
         rnk % {PER_PAGE} AS i, r_name FROM s JOIN nation USING (n_name) JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT url, i + 1 AS container_index, s_suppkey, n_name, r_name FROM r
      UNION ALL SELECT url, 0, s_suppkey, n_name, r_name FROM r WHERE i = 0)
SELECT url, CAST(container_index AS BIGINT) AS container_index,
       'https://dir.example/lawyer/' || s_suppkey AS profile_link,
       CASE WHEN s_suppkey % 10 <> 3 THEN 'University of ' || n_name || '|' || r_name || ' Law School' END AS education,
       CASE WHEN s_suppkey % 10 = 3 THEN 'No data extracted' END AS error
FROM b
"""


def card_text_fallback(spark, sf_dir):
    """C5 + C6: a template whose sub-elements match nothing gives each card
    its text as the only field."""
    dom, planner = rendered_dom(spark, sf_dir)
    containers = find_containers(planner, "div.profile-card")
    subs = [{"label": "phone", "selector": "a[href^='tel:']"}, {"label": "bad", "selector": "div[["}]
    fields = container_fields(dom, planner, containers, subs)
    full = container_text_fallback(dom, containers, fields)
    return (full.join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", F.col("container_index").cast("bigint").alias("container_index"), "label", "value"))


CARD_TEXT_FALLBACK_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1) AS url,
       CAST(rnk % {PER_PAGE} AS BIGINT) AS container_index, 'text' AS label,
       s_name || {_POSITION} || lower(replace(s_name, '#', '.')) || '@dir.example' || 'View profile' ||
       replace({_SECTORS}, '|', '') AS value
FROM s
"""
