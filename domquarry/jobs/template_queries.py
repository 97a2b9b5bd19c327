"""Template-library queries (oracle kind TV): a template per ``part`` row,
audited with the template rules; the oracle derives the same answers from
``p_partkey`` in plain ``CASE`` SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.analyze import audit, is_subpage_container, repair_sublinks
from ..operators.library import template_library
from ..operators.paginate import filter_combinations
from ..sources.templates import template_violations
from .common import table


def _library(spark, sf_dir):
    return template_library(table(spark, sf_dir, "part"))


def template_audit(spark, sf_dir):
    """T1, T2, T3, T5, T6, T7, T8 for every template."""
    a = audit(_library(spark, sf_dir))
    return a.select("name", "is_directory", "needs_subpages",
                    F.col("n_subpage_containers").cast("bigint").alias("n_subpage_containers"),
                    "has_pagination", "pagination_location",
                    F.col("n_non_navigation_actions").cast("bigint").alias("n_non_navigation_actions"), "features")


_K = """
WITH t AS (
  SELECT p_partkey AS k, p_brand, p_size, 'tpl-' || p_partkey AS name,
         p_partkey % 29 <> 0 AS e,
         p_partkey % 29 <> 0 AND p_partkey % 3 = 0 AS container,
         p_partkey % 29 <> 0 AND p_partkey % 12 = 0 AS details,
         p_partkey % 29 <> 0 AND p_partkey % 5 = 1 AS tags
  FROM part),
f AS (
  SELECT *,
    container OR tags OR (e AND k % 17 <> 0 AND k % 4 = 2) OR k % 9 = 0 AS is_directory,
    (e AND k % 8 = 0) OR (container AND k % 4 = 0) OR details OR k % 9 = 0 AS needs_subpages,
    CAST((container AND (k % 4 = 0 OR k % 6 = 0))::INT + details::INT AS BIGINT) AS n_subpage_containers,
    k % 9 = 0 OR k % 14 = 0 AS has_sublink
  FROM t)"""

TEMPLATE_AUDIT_SQL = f"""{_K}
SELECT name, is_directory, needs_subpages, n_subpage_containers,
       k % 6 IN (2, 4) AS has_pagination,
       CASE WHEN k % 14 = 0 THEN 'subpage' ELSE 'main_page' END AS pagination_location,
       CAST((k % 4 = 1)::INT + (k % 14 = 0)::INT + (k % 31 = 0 AND NOT is_directory)::INT AS BIGINT)
         AS n_non_navigation_actions,
       concat_ws(', ',
         CASE WHEN e AND k % 8 = 0 THEN 'Enhanced Data Extraction' END,
         CASE WHEN container AND k % 6 = 0 THEN 'Subpage Navigation' END,
         CASE WHEN k % 4 = 1 OR k % 9 = 0 OR k % 14 = 0 OR k % 31 = 0 THEN 'Action-based Navigation' END,
         CASE WHEN k % 6 IN (2, 4, 5) THEN 'Pagination Support' END) AS features
FROM f
"""


def template_violations_query(spark, sf_dir):
    """Rule violations (errors) and warnings, one row each."""
    return template_violations(_library(spark, sf_dir))


TEMPLATE_VIOLATIONS_SQL = f"""{_K}
SELECT name, 'error' AS level, 'Invalid URL format' AS message FROM f WHERE k % 11 = 0
UNION ALL SELECT name, 'error', 'selector_type must be one of css, xpath: regex' FROM f WHERE e AND k % 19 = 0
UNION ALL SELECT name, 'error', 'element_type must be one of text, attribute, html, link, container, composite: image'
  FROM f WHERE e AND k % 23 = 0
UNION ALL SELECT name, 'error', 'action_type must be one of click, scroll, hover, wait, infinite_scroll: swipe'
  FROM f WHERE k % 31 = 0
UNION ALL SELECT name, 'error', 'output_format must be one of json, csv, excel: xml' FROM f WHERE k % 13 = 0
UNION ALL SELECT name, 'warning', 'No elements defined' FROM f WHERE NOT e
UNION ALL SELECT name, 'warning', 'Element has empty selector: product' FROM f WHERE e AND k % 17 = 0
"""


def template_repair(spark, sf_dir):
    """T4 + P17: sublink repair of every template."""
    fixed = repair_sublinks(_library(spark, sf_dir))
    el = F.col("elements")
    return fixed.select(
        "name", "enable_subpage_scraping", "subpage_url_pattern",
        F.size(F.filter(el, lambda e: F.coalesce(e["follow_links"], F.lit(False)))).cast("bigint")
        .alias("n_follow_links"),
        F.aggregate(el, F.lit(0), lambda acc, e: acc + F.size(F.coalesce(e["subpage_elements"], F.array())))
        .cast("bigint").alias("n_subpage_elements"))


TEMPLATE_REPAIR_SQL = f"""{_K}
SELECT name, has_sublink AS enable_subpage_scraping,
       CASE WHEN k % 9 = 0 THEN 'https://shop.example/lawyer/*' END AS subpage_url_pattern,
       CASE WHEN has_sublink THEN n_subpage_containers
            ELSE CAST((container AND k % 6 = 0)::INT AS BIGINT) END AS n_follow_links,
       CAST((e AND k % 8 = 0)::INT
            + CASE WHEN has_sublink AND container AND (k % 4 = 0 OR k % 6 = 0)
                   THEN 1 + (k % 5 = 0)::INT + (k % 7 = 0)::INT + (k % 4 = 0)::INT ELSE 0 END
            + CASE WHEN has_sublink AND details THEN 1 ELSE 0 END AS BIGINT) AS n_subpage_elements
FROM f
"""


def filter_combos(spark, sf_dir):
    """Cartesian product of each template's filter values."""
    c = filter_combinations(_library(spark, sf_dir), key="name")
    return c.select("name", F.col("combo_no").cast("bigint").alias("combo_no"), "combo_key")


FILTER_COMBOS_SQL = """
SELECT 'tpl-' || p_partkey AS name, CAST(0 AS BIGINT) AS combo_no,
       'brand_' || p_brand || '_size_' || p_size AS combo_key FROM part WHERE p_partkey % 10 = 0
UNION ALL
SELECT 'tpl-' || p_partkey, CAST(1 AS BIGINT), 'brand_Brand#99_size_' || p_size FROM part WHERE p_partkey % 10 = 0
UNION ALL
SELECT 'tpl-' || p_partkey, CAST(0 AS BIGINT), '' FROM part WHERE p_partkey % 10 NOT IN (0, 5)
"""


def subpage_containers(spark, sf_dir):
    """T3 per element: which elements of each template are subpage containers."""
    lib = _library(spark, sf_dir)
    return (lib.select("name", F.posexplode("elements").alias("pos", "e"))
            .select("name", F.col("pos").cast("bigint").alias("element_pos"), F.col("e.label").alias("label"),
                    is_subpage_container(F.col("e")).alias("is_subpage_container")))


SUBPAGE_CONTAINERS_SQL = f"""{_K},
els AS (
  SELECT name, 0 AS element_pos, 'product' AS label, FALSE AS is_subpage_container FROM f WHERE e
  UNION ALL
  SELECT name, 1, CASE WHEN k % 2 = 0 THEN 'people container' ELSE 'cards' END,
         k % 4 = 0 OR k % 6 = 0 FROM f WHERE container
  UNION ALL
  SELECT name, 2, 'profile details', TRUE FROM f WHERE details
  UNION ALL
  SELECT name, 1 + container::INT + details::INT, 'tags', FALSE FROM f WHERE tags)
SELECT name, CAST(element_pos AS BIGINT) AS element_pos, label, is_subpage_container FROM els
"""
