"""Queries on pages in a column layout (rendered from ``supplier``): rules that
the profile-card listings never reach decide here (E8-E11, E13, E15, E19, E20,
E21, E26, A1-A3, W6-W9, P8, J2, S3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.predicates import attribute_name_of, profile_link_selector, template_element_type_of
from ..operators import render
from ..operators.containers import container_fields, find_containers, records
from ..operators.detect import (container_count, directory_context, first_rule, page_detection, similar_nodes,
                                SUBPAGE_MAIN_PATTERNS)
from ..operators.extract import extract_elements
from ..operators.fallback import container_ladder, element_ladder, find_with_fallback, resolve_sub_element
from ..operators.nodes import build_dom
from ..operators.paginate import working_parameter
from ..operators.subpages import discover_link, follow_links, main_containers
from ..operators.values import node_values
from ..session import checkpoint_dir
from ..sources.templates import read_templates, template_catalog
from .common import cached_dom, table
from .directory_queries import PER_PAGE, _POSITION, _SUPPLIERS, rendered_dom

def grid_dom(spark, sf_dir):
    return cached_dom((spark.sparkContext.applicationId, sf_dir, "grids"),
                      lambda: build_dom(render.grid_pages(table(spark, sf_dir, "supplier"))))


_GRID = """
WITH k AS (SELECT s_suppkey // 20 AS block, s_suppkey % 20 >= 12 AS second, s_suppkey, s_name FROM supplier),
g AS (SELECT block, second, count(*) AS n, 'https://grid.example/s/' || block || CASE WHEN second THEN '?offset=20' ELSE '' END
        AS url FROM k GROUP BY block, second)"""


def _with_url(df, dom):
    return df.join(dom.docs.select("page_id", "url"), "page_id")


def grid_detection(spark, sf_dir):
    """Counts, load-more selector, next link, plugin mark."""
    dom, planner = grid_dom(spark, sf_dir)
    d = _with_url(page_detection(dom.pages), dom)
    return d.select("url", F.col("profile_count").cast("bigint").alias("profile_count"),
                    F.col("container_count").cast("bigint").alias("container_count"), "load_more_selector",
                    "has_load_more_button", "has_next_link", "is_grid_plugin")


GRID_DETECTION_SQL = f"""{_GRID}
SELECT url, n AS profile_count, CASE WHEN n > 5 THEN n ELSE 0 END AS container_count,
       CASE WHEN NOT second AND block % 2 = 0 THEN 'button[class*="load"]' END AS load_more_selector,
       NOT second AND block % 2 = 0 AS has_load_more_button, NOT second AND block % 2 = 1 AS has_next_link,
       block % 3 = 0 AS is_grid_plugin
FROM g
"""


def grid_containers(spark, sf_dir):
    """E20 in C2: a container selector that matches nothing, found by the
    last-resort layouts on pages with more than 5 columns."""
    dom, planner = grid_dom(spark, sf_dir)
    before, after = container_ladder(".missing-card")
    c = find_containers(planner, ".missing-card", ladder=before, after=after)
    n = c.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_containers"))
    return _with_url(n, dom).select("url", "n_containers")


GRID_CONTAINERS_SQL = f"""{_GRID}
SELECT url, n AS n_containers FROM g WHERE n > 5
"""


def grid_main_containers(spark, sf_dir):
    """The main containers of a page and the pattern that gave them."""
    dom, planner = grid_dom(spark, sf_dir)
    n = main_containers(dom, planner).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_containers"))
    rule = first_rule(dom, planner, SUBPAGE_MAIN_PATTERNS, 1, "pattern").select("page_id", "pattern")
    return _with_url(n.join(rule, "page_id"), dom).select("url", "pattern", "n_containers")


GRID_MAIN_CONTAINERS_SQL = f"""{_GRID}
SELECT url, '.people-list .wp-block-column' AS pattern, n AS n_containers FROM g
"""


def grid_emails(spark, sf_dir):
    """C3 with E15 and E16: no mapped e-mail selector matches in a column; a
    scoped fallback XPath finds two candidates, one of them valid."""
    dom, planner = grid_dom(spark, sf_dir)
    cols = find_containers(planner, ".wp-block-column")
    m = resolve_sub_element(dom, planner, cols, {"label": "email", "selector": "u"})
    return _with_url(node_values(dom, m, "text"), dom).select("url", F.col("value").alias("email"))


GRID_EMAILS_SQL = f"""{_GRID}
SELECT url, lower(replace(s_name, '#', '.')) || '@dir.example' AS email FROM k JOIN g USING (block, second)
"""


def grid_parameter(spark, sf_dir):
    """W6 (A3): the page parameter whose test page has other content."""
    dom, planner = grid_dom(spark, sf_dir)
    first = dom.docs.where("url NOT LIKE '%offset%'").select("page_id", "url")
    w = working_parameter(dom, first, container_count(dom, planner))
    return _with_url(w, dom).select("url", "param")


GRID_PARAMETER_SQL = f"""{_GRID}
SELECT a.url, 'offset' AS param FROM g a JOIN g b USING (block)
WHERE NOT a.second AND b.second AND b.n > 5 AND b.n <> CASE WHEN a.n > 5 THEN a.n ELSE 0 END
"""


def grid_similar(spark, sf_dir):
    """A name in the first column is alone under its parent; names of other
    columns stand under parents of the same class."""
    dom, planner = grid_dom(spark, sf_dir)
    ex = planner.select(".wp-block-column:first-child > strong").select("page_id", F.col("node_id").alias("example_id"))
    s = similar_nodes(dom, ex).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_similar"),
                                                      F.min("strategy").cast("bigint").alias("strategy"))
    return _with_url(s, dom).select("url", "n_similar", "strategy")


GRID_SIMILAR_SQL = f"""{_GRID}
SELECT url, n AS n_similar, CAST(1 AS BIGINT) AS strategy FROM g WHERE n > 1
"""


def grid_context(spark, sf_dir):
    """No directory URL; the number of similar columns decides."""
    dom, planner = grid_dom(spark, sf_dir)
    ex = planner.select(".wp-block-column:first-child").select("page_id", F.col("node_id").alias("example_id"))
    return _with_url(directory_context(dom, planner, ex), dom).select("url", "is_directory_context")


GRID_CONTEXT_SQL = f"""{_GRID}
SELECT url, n >= 3 AS is_directory_context FROM g
"""


def grid_missing(spark, sf_dir):
    """A required element that a third of the pages lack, and a
    location-like one that never fails a page."""
    dom, planner = grid_dom(spark, sf_dir)
    _, errors = extract_elements(dom, [{"label": "control", "selector": "button, a.next"},
                                       {"label": "city", "selector": "u.city"}], planner, smart=False)
    return _with_url(errors, dom).select("url", "label", "error")


GRID_MISSING_SQL = f"""{_GRID}
SELECT url, 'control' AS label, 'Failed to extract control: Required element not found: button, a.next' AS error
FROM g WHERE second
"""

def grid_element_types(spark, sf_dir):
    """E24 + E25: what a template element for each control would read, and the
    selector that a link suggests."""
    dom, planner = grid_dom(spark, sf_dir)
    m = planner.select("img, input, button, a.next").join(
        dom.nodes.select("page_id", "node_id", "tag", "attrs"), ["page_id", "node_id"])
    href = F.col("attrs")["href"]
    rows = m.select("page_id", "tag", template_element_type_of(F.col("tag")).alias("element_type"),
                    attribute_name_of(F.col("tag")).alias("attribute"),
                    F.col("attrs")[F.coalesce(attribute_name_of(F.col("tag")), F.lit(""))].alias("value"),
                    F.when(F.col("tag") == "a", profile_link_selector(href)).alias("link_selector"))
    return _with_url(rows, dom).select("url", "tag", "element_type", "attribute", "value", "link_selector")


GRID_ELEMENT_TYPES_SQL = f"""{_GRID}
SELECT url, 'img' AS tag, 'attribute' AS element_type, 'src' AS attribute, '/logo.png' AS value, NULL AS link_selector FROM g
UNION ALL SELECT url, 'input', 'attribute', 'value', 'q', NULL FROM g
UNION ALL SELECT url, 'button', 'text', NULL, NULL, NULL FROM g WHERE NOT second AND block % 2 = 0
UNION ALL SELECT url, 'a', 'link', NULL, NULL, 'a[href]' FROM g WHERE NOT second AND block % 2 = 1
"""

# element of each rung: (rung, element, expected patterns, what the winner is)
_RUNGS = [
    ("E8", {"label": "work email", "selector": ".no-such-mail"}, None),
    ("E9", {"label": "bio", "selector": ".no-such-bio"}, ["it's elsewhere", "Works in"]),
    ("E10", {"label": "rank", "selector": "div.profile > .pos"}, None),
    ("E11", {"label": "heading", "selector": "div.profile-card:nth-child(99) > h3"}, None),
]


def ladder_rungs(spark, sf_dir):
    """Elements whose own selector matches nothing, each found
    by another rung of the ladder; values and the rung that won."""
    dom, planner = rendered_dom(spark, sf_dir)
    out = None
    for name, element, patterns in _RUNGS:
        ladder = element_ladder(element, patterns)
        m = find_with_fallback(planner, element, patterns)
        names = F.create_map(*[x for i, a in enumerate(ladder) for x in (
            F.lit(i), F.lit(a if isinstance(a, str) else a.source))])
        v = node_values(dom, m, "text").select(F.lit(name).alias("rung"), names[F.col("priority")].alias("rule"), "value")
        out = v if out is None else out.unionByName(v)
    return out


LADDER_RUNGS_SQL = f"""{_SUPPLIERS}
SELECT 'E8' AS rung, '//a[contains(@href, ''mailto:'')]' AS rule,
       lower(replace(s_name, '#', '.')) || '@dir.example' AS value FROM s
UNION ALL SELECT 'E9', 'own text contains ''Works in''', 'Works in ' || r_name || '.'
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 10 <> 3
UNION ALL SELECT 'E10', 'div[class*="profile"] > [class*="pos"]', {_POSITION} FROM s
UNION ALL SELECT 'E11', 'div.profile-card > h3', s_name FROM s
"""


def class_substring_cards(spark, sf_dir):
    """E13 in C2: ``.profile.card`` is no class pair of the cards, its parts are
    substrings of their class."""
    dom, planner = rendered_dom(spark, sf_dir)
    before, after = container_ladder(".profile.card")
    c = find_containers(planner, ".profile.card", ladder=before, after=after)
    n = c.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_containers"))
    return _with_url(n, dom).select("url", "n_containers")


CLASS_SUBSTRING_CARDS_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey),
p AS (SELECT s_nationkey, unnest(range(1, CAST(ceil(n / {PER_PAGE}.0) AS BIGINT) + 1)) AS page_no, n FROM c)
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || page_no AS url,
       least({PER_PAGE}, n - {PER_PAGE} * (page_no - 1)) AS n_containers FROM p
"""


def discovered_links(spark, sf_dir):
    """J2 + J1: records without a picked link take the first http value of a
    field named like a link, in template order, and are joined to their page."""
    dom, planner = rendered_dom(spark, sf_dir)
    cards = find_containers(planner, "div.profile-card")
    fields = container_fields(dom, planner, cards, [
        {"label": "site_url", "selector": "h3"}, {"label": "home_link", "selector": "a.profile", "element_type": "link"},
        {"label": "mail_link", "selector": "a[href^='mailto:']", "element_type": "link"}])
    link = discover_link(F.col("fields"), F.lit(None).cast("string"), ["site_url", "home_link", "mail_link"])
    linked = follow_links(records(fields).withColumn("profile_link", link), dom.docs)
    return linked.select("profile_link", F.col("subpage_id").isNotNull().alias("has_page"))


DISCOVERED_LINKS_SQL = """
SELECT 'https://dir.example/lawyer/' || s_suppkey AS profile_link, s_suppkey % 10 <> 3 AS has_page
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def template_files(spark, sf_dir):
    """S2 + S3: template files (one per nation, every seventh cut short) written
    as JSON, read as rows and listed."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/templates/{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation")
    doc = F.concat(F.lit('{"name":"'), "n_name", F.lit('","url":"https://t.example/'), F.col("n_nationkey").cast("string"),
                   F.lit('","elements":['), F.array_join(F.transform(
                       F.sequence(F.lit(0), F.col("n_regionkey")), lambda i: F.concat(
                           F.lit('{"label":"e'), i.cast("string"), F.lit('","selector":"p"}'))), ","), F.lit("]}"))
    text = F.when(F.col("n_nationkey") % 7 == 0, F.substring(doc, 1, 20)).otherwise(doc)
    # one file per template, as the folder of a template library has them
    n.select(F.col("n_nationkey").alias("k"), text.alias("value")).repartition("k").write.partitionBy("k").text(folder)
    return template_catalog(read_templates(spark, f"{folder}/*")).select(
        "name", F.col("n_elements").cast("bigint").alias("n_elements"), "error")


TEMPLATE_FILES_SQL = """
SELECT CASE WHEN n_nationkey % 7 <> 0 THEN n_name END AS name,
       CASE WHEN n_nationkey % 7 <> 0 THEN CAST(n_regionkey + 1 AS BIGINT) END AS n_elements,
       CASE WHEN n_nationkey % 7 = 0 THEN 'unreadable template' END AS error
FROM nation
"""
