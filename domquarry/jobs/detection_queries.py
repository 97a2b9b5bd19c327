"""Detection, similarity and suggestion queries (RX on ``pages``, RT on
rendered directories)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import element_type_of, link_target, node_role
from ..operators.containers import find_containers
from ..operators.detect import (directory_containers, page_detection, similar_nodes, suggest_relative, suggest_selectors,
                                suggest_xpath)
from ..plans.compile import parse_selector
from ..session import materialize
from .common import page_dom, table
from .directory_queries import PER_PAGE, _SUPPLIERS, rendered_dom

_LISTING = r"/nation/\d+/people\?page=\d+$"


def page_detection_query(spark, sf_dir):
    """A1, A2, W7, W8, W9 on every page."""
    d = page_detection(table(spark, sf_dir, "pages"))
    return d.select("page_id", F.col("profile_count").cast("bigint").alias("profile_count"),
                    F.col("container_count").cast("bigint").alias("container_count"), "load_more_selector",
                    "has_load_more_button", "has_next_link", "is_grid_plugin")


PAGE_DETECTION_SQL = """
SELECT page_id,
  CAST(0 AS BIGINT) + CAST(len(regexp_extract_all(html, 'class="[^"]*people[^"]*"[^>]*>\\s*<strong')) AS BIGINT)
    AS profile_count,
  CASE WHEN len(regexp_extract_all(html, 'class="[^"]*(card|item)')) > 5
       THEN CAST(len(regexp_extract_all(html, 'class="[^"]*(card|item)')) AS BIGINT) ELSE CAST(0 AS BIGINT) END
    AS container_count,
  CAST(NULL AS VARCHAR) AS load_more_selector,
  regexp_matches(html, '<(a|button)[^>]*>[^<]*(Load More|Show More|View More)')
    OR regexp_matches(html, 'class="[^"]*(load-more|show-more|view-more)') OR html LIKE '%data-load-more%'
    AS has_load_more_button,
  regexp_matches(html, '<a[^>]*>[^<]*(Next|&gt;)') OR regexp_matches(html, 'class="[^"]*(next|page-next|pagination)')
    AS has_next_link,
  regexp_matches(html, 'class="[^"]*(wp-grid-builder|wpgb-template|wpgb-grid|wpgb-facet)') OR html LIKE '%data-grid%'
    AS is_grid_plugin
FROM pages
"""


def directory_detection(spark, sf_dir):
    """E18 on directory listings: the first pattern with >= 3 matches."""
    dom, planner = rendered_dom(spark, sf_dir)
    d = directory_containers(dom, planner)
    return (d.join(dom.docs.select("page_id", "url"), "page_id").where(F.col("url").rlike(_LISTING))
            .select("url", "pattern", F.col("n_matches").cast("bigint").alias("n_matches")))


DIRECTORY_DETECTION_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey),
p AS (
  SELECT s_nationkey, unnest(range(1, CAST(ceil(n / {PER_PAGE}.0) AS BIGINT) + 1)) AS page_no, n FROM c),
k AS (SELECT s_nationkey, page_no, least({PER_PAGE}, n - {PER_PAGE} * (page_no - 1)) AS cards FROM p)
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || page_no AS url,
       CASE WHEN cards >= 3 THEN '.profile-card' WHEN cards = 2 THEN '[class*=''profile'']'
            ELSE '//*[.//a[contains(@href, ''/lawyer/'')]]' END AS pattern,
       CAST(CASE WHEN cards >= 3 THEN cards ELSE 4 END AS BIGINT) AS n_matches
FROM k
"""


def similar_nav_items(spark, sf_dir):
    """Nodes similar to the first nav item of each page."""
    dom, planner = page_dom(spark, sf_dir)
    ex = planner.select("nav li:first-child").select("page_id", F.col("node_id").alias("example_id"))
    sim = similar_nodes(dom, ex)
    return sim.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_similar"),
                                      F.min("strategy").cast("bigint").alias("strategy"))


SIMILAR_NAV_ITEMS_SQL = """
SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS n_similar, CAST(1 AS BIGINT) AS strategy
FROM pages WHERE len(regexp_extract_all(html, '<li>')) > 1
"""


def card_selector_suggestions(spark, sf_dir):
    """Suggested selectors for every card and every card heading."""
    dom, planner = rendered_dom(spark, sf_dir)
    targets = planner.select("div.profile-card").unionByName(planner.select("div.profile-card > h3"))
    sug = suggest_selectors(dom, targets)
    info = dom.nodes.select("page_id", "node_id", "tag")
    return (sug.join(info, ["page_id", "node_id"]).join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", "tag", "selector"))


CARD_SELECTOR_SUGGESTIONS_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1) AS url,
       'div' AS tag, 'div.profile-card' AS selector FROM s
UNION ALL
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1),
       'h3', 'html > body:nth-child(2) > div:nth-child(1) > div:nth-child(' || (rnk % {PER_PAGE} + 1)
       || ') > h3:nth-child(1)' FROM s
"""


def card_relative_selectors(spark, sf_dir):
    """E22 relative to the card, and as XPath: name, position, profile link and
    first sector of every card."""
    dom, planner = rendered_dom(spark, sf_dir)
    cards = materialize(find_containers(planner, "div.profile-card"))
    scope = cards.select("page_id", F.col("container_id").alias("scope_id"))
    kinds = [("name", "h3"), ("position", "span.position"), ("profile", "a.profile"), ("sector", "span.sector:first-child")]
    m = materialize(planner.select_many([(k, parse_selector(s)) for k, s in kinds], scope=scope)).withColumnRenamed(
        "scope_id", "container_id")
    rel = suggest_relative(dom, m).join(suggest_xpath(dom, m), ["page_id", "node_id"])
    return (m.join(rel, ["page_id", "container_id", "node_id"]).join(cards, ["page_id", "container_id"])
            .join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", F.col("container_index").cast("bigint").alias("container_index"), F.col("key").alias("kind"),
                    "selector", "xpath"))


CARD_RELATIVE_SELECTORS_SQL = f"""{_SUPPLIERS},
c AS (SELECT s_suppkey, rnk % {PER_PAGE} AS i, 'https://dir.example/nation/' || s_nationkey || '/people?page=' ||
             (rnk // {PER_PAGE} + 1) AS url, '/html[1]/body[1]/div[1]/div[' || (rnk % {PER_PAGE} + 1) || ']' AS x FROM s)
SELECT url, CAST(i AS BIGINT) AS container_index, 'name' AS kind, 'h3' AS selector, x || '/h3[1]' AS xpath FROM c
UNION ALL SELECT url, i, 'position', 'span.position', x || '/span[1]' FROM c
UNION ALL SELECT url, i, 'profile', 'a.profile', x || '/a[1]' FROM c
UNION ALL SELECT url, i, 'sector', CASE WHEN s_suppkey % 2 = 0 THEN '> div:nth-child(5) > span:nth-child(1)'
                                        ELSE 'span.sector' END, x || '/div[1]/span[1]' FROM c
"""


def node_roles(spark, sf_dir):
    """E24 + E25 + E27: role, element type and link target of every card
    element and next link on the directory listings."""
    dom, planner = rendered_dom(spark, sf_dir)
    listing = dom.docs.where(F.col("url").rlike(_LISTING)).select("page_id")
    m = planner.select("div.profile-card a, div.profile-card span, div.profile-card h3, a.next")
    n = dom.nodes.select("page_id", "node_id", "tag", "attrs", "own_text")
    rows = m.join(listing, "page_id", "left_semi").join(n, ["page_id", "node_id"])
    text = F.trim(F.col("own_text"))
    rows = rows.select("tag", node_role(F.col("tag"), F.col("attrs")["href"], text).alias("role"),
                       element_type_of(F.col("tag"), text).alias("element_type"),
                       link_target(F.col("tag"), F.col("attrs")).alias("target"))
    return rows.groupBy("tag", "role", "element_type").agg(F.count(F.lit(1)).alias("n"),
                                                          F.count("target").alias("n_targets"))


NODE_ROLES_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n, CAST(ceil(count(*) / {PER_PAGE}.0) AS BIGINT) AS p
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey),
s AS (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'a' AS tag, 'email' AS role, 'link' AS element_type, count(*) AS n, count(*) AS n_targets FROM s
UNION ALL SELECT 'a', 'profile_link', 'link', count(*), count(*) FROM s
UNION ALL SELECT 'a', NULL, 'link', CAST(sum(p - 1) AS BIGINT), CAST(sum(p - 1) AS BIGINT) FROM c HAVING sum(p - 1) > 0
UNION ALL SELECT 'span', 'job_title', 'text', count(*), 0 FROM s
UNION ALL SELECT 'span', NULL, 'text', count(*) + count(*) FILTER (WHERE s_suppkey % 2 = 0), 0 FROM s
UNION ALL SELECT 'h3', NULL, 'text', count(*), 0 FROM s
"""
