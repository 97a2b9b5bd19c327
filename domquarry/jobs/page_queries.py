"""Queries over the ``pages`` table, checked by regex SQL (oracle kind RX)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.onepass import extract_pages
from ..operators.pagescan import count_matches
from ..operators.values import page_title
from ..plans.compile import parse_selector
from ..sources.templates import normalise_template
from .common import page_dom, sql_decode, sql_strip, table

# The flagship template: title and h1 (single), nav links (multiple).
FLAGSHIP_TEMPLATE = normalise_template({
    "name": "page summary",
    "url": "https://example.com/",
    "elements": [
        {"label": "title", "selector": "title"},
        {"label": "h1", "selector": "h1"},
        {"label": "links", "selector": "nav li a", "element_type": "link", "is_multiple": True},
    ],
})


def page_summary(spark, sf_dir):
    """S1 -> E1 -> E2 -> P1/P3/P6/P7: title, h1 and number of nav links."""
    return page_summaries(table(spark, sf_dir, "pages"))


def page_summaries(pages):
    """The flagship template on ``pages``, one row per page."""
    per_page = extract_pages(pages, FLAGSHIP_TEMPLATE["elements"]).groupBy("page_id").agg(
        F.max(F.when(F.col("label") == "title", F.col("value"))).alias("title"),
        F.max(F.when(F.col("label") == "h1", F.col("value"))).alias("h1"),
        F.count(F.when((F.col("label") == "links") & F.col("error").isNull(), 1)).alias("n_links"))
    return (pages.select("page_id", "url").join(per_page, "page_id", "left")
            .select("page_id", "url", "title", "h1", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")))


PAGE_SUMMARY_SQL = f"""
SELECT page_id, url,
       {sql_strip(sql_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
       {sql_strip(sql_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS h1,
       CAST(len(regexp_extract_all(html, '<li><a href="[^"]*">')) AS BIGINT) AS n_links
FROM pages
"""


def _multi(spark, sf_dir, selector, element_type="text", resolve=False, selector_type="css"):
    el = {"label": "v", "selector": selector, "selector_type": selector_type, "element_type": element_type,
          "is_multiple": True}
    values = extract_pages(table(spark, sf_dir, "pages"), [el], resolve_links=resolve).where("error IS NULL")
    return values.select("page_id", F.col("value_ord").cast("bigint").alias("value_ord"), "value")


def _single(spark, sf_dir, selector, element_type="text", attribute_name=None, selector_type="css"):
    el = {"label": "v", "selector": selector, "selector_type": selector_type, "element_type": element_type,
          "attribute_name": attribute_name}
    values = extract_pages(table(spark, sf_dir, "pages"), [el]).where("error IS NULL")
    return values.select("page_id", "value")


def nav_links(spark, sf_dir):
    """P3 + P6: raw hrefs of ``nav li a`` in document order."""
    return _multi(spark, sf_dir, "nav li a", "link")


_NAV_HREFS = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)"
NAV_LINKS_SQL = f"""
SELECT page_id, CAST(generate_subscripts({_NAV_HREFS}, 1) AS BIGINT) AS value_ord,
       unnest({_NAV_HREFS}) AS value
FROM pages
"""


def nav_links_resolved(spark, sf_dir):
    """Hrefs resolved against the page URL (``urljoin``)."""
    return _multi(spark, sf_dir, "nav > ul > li > a", "link", resolve=True)


NAV_LINKS_RESOLVED_SQL = f"""
SELECT page_id, CAST(generate_subscripts({_NAV_HREFS}, 1) AS BIGINT) AS value_ord,
       regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || unnest({_NAV_HREFS}) AS value
FROM pages
"""


def xpath_nav_hrefs(spark, sf_dir):
    """XPath with an ``@href`` final step."""
    return _multi(spark, sf_dir, "//nav//li/a/@href", "text", selector_type="xpath")


XPATH_NAV_HREFS_SQL = NAV_LINKS_SQL


def _article_parts(filter_sql: str = "TRUE") -> str:
    return f"""
WITH a AS (
  SELECT page_id, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>') AS parts
  FROM pages),
p AS (
  SELECT page_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS k FROM a)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS BIGINT) AS value_ord,
       {sql_strip(sql_decode("regexp_replace(split_part(part, '</p>', 1), '<[^>]*>', '', 'g')"))} AS value
FROM p WHERE {filter_sql}
"""


def article_paragraphs(spark, sf_dir):
    """P1 over broken markup: full text of every ``article p`` (unclosed ``p``
    end at the next ``p``; the unclosed ``b`` inside stays in its ``p``)."""
    return _multi(spark, sf_dir, "article p")


ARTICLE_PARAGRAPHS_SQL = _article_parts()


def bold_leads(spark, sf_dir):
    """E2 child step: ``article > p > b`` text (the ``b`` is never closed)."""
    return _multi(spark, sf_dir, "article > p > b")


BOLD_LEADS_SQL = _article_parts("part LIKE '<b>%'")


def ad_text(spark, sf_dir):
    """Class selector, single value: ``div.ad``."""
    return _single(spark, sf_dir, "div.ad")


AD_TEXT_SQL = f"""
SELECT page_id, {sql_strip(sql_decode("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))} AS value
FROM pages
"""


def footer_text(spark, sf_dir):
    """Entities decoded in text: ``footer``."""
    return _single(spark, sf_dir, "body > footer")


FOOTER_TEXT_SQL = f"""
SELECT page_id, {sql_strip(sql_decode("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)"))} AS value
FROM pages
"""


def ad_html(spark, sf_dir):
    """Outer HTML of ``div.ad`` as written in the source."""
    return _single(spark, sf_dir, "div.ad", "html")


AD_HTML_SQL = """
SELECT page_id, regexp_extract(html, '(?s)(<div class="ad">.*?</div>)', 1) AS value FROM pages
"""


def page_language(spark, sf_dir):
    """P5: attribute value (``lang`` of ``html``)."""
    return _single(spark, sf_dir, "html", "attribute", "lang")


PAGE_LANGUAGE_SQL = """
SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS value FROM pages
"""


def second_nav_item(spark, sf_dir):
    """Positional pseudo-class: ``nav li:nth-child(2) a``."""
    return _single(spark, sf_dir, "nav li:nth-child(2) a", "link")


SECOND_NAV_ITEM_SQL = f"SELECT page_id, {_NAV_HREFS}[2] AS value FROM pages WHERE len({_NAV_HREFS}) >= 2"


def last_nav_item(spark, sf_dir):
    """``:last-child`` with a child step: ``li:last-child > a``."""
    return _single(spark, sf_dir, "li:last-child > a", "link")


LAST_NAV_ITEM_SQL = f"SELECT page_id, {_NAV_HREFS}[-1] AS value FROM pages WHERE len({_NAV_HREFS}) >= 1"


def xpath_heading_text(spark, sf_dir):
    """``//article/h1/text()`` (own text)."""
    return _single(spark, sf_dir, "//article/h1/text()", selector_type="xpath")


XPATH_HEADING_TEXT_SQL = f"""
SELECT page_id, {sql_strip(sql_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS value FROM pages
"""


def title_or_heading(spark, sf_dir):
    """``<title>``, else the first ``<h1>``, else ``Unknown``."""
    dom, planner = page_dom(spark, sf_dir)
    return page_title(dom, planner)


TITLE_OR_HEADING_SQL = f"""
SELECT page_id, coalesce(
  nullif({sql_strip(sql_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}, ''),
  nullif({sql_strip(sql_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))}, ''),
  'Unknown') AS page_title
FROM pages
"""


def required_missing(spark, sf_dir):
    """Required elements missing on a page become error rows (a
    location-like element would give NULL instead)."""
    els = [{"label": "lead", "selector": "article p > b", "is_required": True},
           {"label": "city", "selector": "span.city", "is_required": True},
           {"label": "table", "selector": "table", "is_required": False}]
    return extract_pages(table(spark, sf_dir, "pages"), els).where("error IS NOT NULL").select("page_id", "label", "error")


REQUIRED_MISSING_SQL = """
SELECT page_id, 'lead' AS label,
       'Failed to extract lead: Required element not found: article p > b' AS error
FROM pages WHERE html NOT LIKE '%<b>%'
"""


def paragraph_counts(spark, sf_dir):
    """A6-style count per page: number of ``article > p`` and of ``b``."""
    pages = table(spark, sf_dir, "pages")
    per_page = count_matches(pages, [parse_selector(s) for s in ("article > p", "p b")]).groupBy("page_id").agg(
        F.sum(F.when(F.col("key") == 0, F.col("n"))).alias("n_paragraphs"),
        F.sum(F.when(F.col("key") == 1, F.col("n"))).alias("n_bold"))
    return pages.select("page_id").join(per_page, "page_id", "left").fillna(0, ["n_paragraphs", "n_bold"])


PARAGRAPH_COUNTS_SQL = """
SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS n_paragraphs,
       CAST(len(regexp_extract_all(html, '<b>')) AS BIGINT) AS n_bold
FROM pages
"""
