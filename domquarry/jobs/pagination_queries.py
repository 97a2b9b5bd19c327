"""Pagination queries: stop rules and accumulation (oracle kinds WN and RT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.containers import container_fields, find_containers
from ..operators.paginate import (append_accumulate, count_stability_stop, distinct_accumulate,
                                  empty_streak_stop, end_selector_stop, next_selector_stop,
                                  page_url_sequence, walk_pages, walked_pages)
from ..session import materialize
from .common import table
from .directory_queries import rendered_dom


def _event_pages(spark, sf_dir):
    """Users as crawls, days since the user's first event as page numbers
    (1-based, contiguous: days without events are empty pages), event types
    as items."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    first = ev.groupBy("user_id").agg(F.min(F.date_trunc("day", "ts")).alias("d0"))
    e = ev.join(first, "user_id").select(
        F.col("user_id").alias("crawl_id"),
        (F.datediff(F.date_trunc("day", "ts"), F.col("d0")) + 1).alias("page_no"),
        F.col("event_type").alias("item"))
    pages = (e.groupBy("crawl_id").agg(F.max("page_no").alias("n"))
             .select("crawl_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_no")))
    # the walk reads both from several branches: written once, read back
    return materialize(e), materialize(pages)


def event_walk(spark, sf_dir):
    """W1 + U2: stop after 3 pages without a new item."""
    items, pages = _event_pages(spark, sf_dir)
    walk = materialize(walk_pages(pages))  # the walk order, once
    stops = materialize(empty_streak_stop(items, pages, k=3, walk=walk))
    walked = walked_pages(stops, pages, walk=walk)
    got = distinct_accumulate(items, walked).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n_items"))
    return (stops.join(got, "crawl_id", "left")
            .select(F.col("crawl_id").alias("user_id"), F.col("stop_page").cast("bigint").alias("stop_page"),
                    F.col("pages_walked").cast("bigint").alias("pages_walked"),
                    F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items")))


_EVENT_DAYS = """
WITH e AS (
  SELECT user_id, event_type AS item,
         CAST(date_diff('day', min(date_trunc('day', ts)) OVER (PARTITION BY user_id), date_trunc('day', ts))
              AS BIGINT) + 1 AS page_no
  FROM events),
pages AS (SELECT user_id, unnest(range(1, max(page_no) + 1)) AS page_no FROM e GROUP BY user_id),
fs AS (SELECT user_id, item, min(page_no) AS first_page FROM e GROUP BY user_id, item)"""

EVENT_WALK_SQL = f"""{_EVENT_DAYS},
pn AS (
  SELECT p.user_id, p.page_no, count(fs.item) AS n_new
  FROM pages p LEFT JOIN fs ON fs.user_id = p.user_id AND fs.first_page = p.page_no
  GROUP BY p.user_id, p.page_no),
st AS (
  SELECT *, page_no - coalesce(max(CASE WHEN n_new > 0 THEN page_no END)
            OVER (PARTITION BY user_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
            AS streak
  FROM pn),
stop AS (
  SELECT user_id, min(CASE WHEN streak >= 3 THEN page_no END) AS stop_page, max(page_no) AS last_page
  FROM st GROUP BY user_id)
SELECT user_id, CAST(stop_page AS BIGINT) AS stop_page,
       CAST(coalesce(stop_page, last_page) AS BIGINT) AS pages_walked,
       (SELECT count(*) FROM fs WHERE fs.user_id = stop.user_id
          AND fs.first_page <= coalesce(stop.stop_page, stop.last_page)) AS n_items
FROM stop
"""


def event_scroll(spark, sf_dir):
    """Count-stability stop; snapshot k = distinct event types seen up to
    day k (day 0 = the first day); stop after 3 snapshots without growth;
    skip when the first count is 0."""
    items, pages = _event_pages(spark, sf_dir)
    fs = items.groupBy("crawl_id", "item").agg(F.min("page_no").alias("first_page"))
    grown = fs.groupBy("crawl_id", "first_page").agg(F.count(F.lit(1)).alias("k"))
    snaps = (pages.join(grown.withColumnRenamed("first_page", "page_no"), ["crawl_id", "page_no"], "left")
             .fillna(0, ["k"]))
    from pyspark.sql import Window
    w = Window.partitionBy("crawl_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    snaps = snaps.select("crawl_id", (F.col("page_no") - 1).alias("snap_no"), F.sum("k").over(w).alias("n"))
    out = count_stability_stop(snaps)
    return out.select(F.col("crawl_id").alias("user_id"), F.col("scrolls").cast("bigint").alias("scrolls"),
                      F.col("final_count").cast("bigint").alias("final_count"))


EVENT_SCROLL_SQL = f"""{_EVENT_DAYS},
snaps AS (
  SELECT p.user_id, p.page_no - 1 AS snap_no,
         (SELECT count(*) FROM fs WHERE fs.user_id = p.user_id AND fs.first_page <= p.page_no) AS n
  FROM pages p),
g AS (
  SELECT *, n > coalesce(max(n) OVER (PARTITION BY user_id ORDER BY snap_no
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS grew
  FROM snaps),
s AS (
  SELECT *, snap_no - max(CASE WHEN grew THEN snap_no END)
            OVER (PARTITION BY user_id ORDER BY snap_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak
  FROM g),
stop AS (
  SELECT user_id, min(CASE WHEN snap_no > 0 AND streak >= 3 THEN snap_no END) AS stop_snap,
         max(snap_no) AS last_snap
  FROM s GROUP BY user_id)
SELECT s.user_id, CAST(max(s.snap_no) AS BIGINT) AS scrolls, CAST(max(s.n) AS BIGINT) AS final_count
FROM s JOIN stop USING (user_id)
WHERE s.snap_no <= coalesce(stop.stop_snap, stop.last_snap)
GROUP BY s.user_id
"""

OVERLAP, TRAILING = 1, 3


def _listing(dom):
    """Listing pages: page_id, crawl_id (the nation), page_no."""
    url_re = r"/nation/(\d+)/people\?page=(\d+)$"
    return materialize(dom.docs.select(
        "page_id", F.regexp_extract("url", url_re, 1).cast("bigint").alias("crawl_id"),
        F.regexp_extract("url", url_re, 2).cast("int").alias("page_no")).where(F.col("url").rlike(url_re)))


def listing_limits(spark, sf_dir):
    """W3 variants + W4: pages that each nation's walk takes by the next link,
    with a limit of 2 pages, and until a page shows an end condition (a card of a
    supplier whose key ends in 7)."""
    dom, planner = rendered_dom(spark, sf_dir, OVERLAP, TRAILING)
    listing = _listing(dom)
    pages = listing.select("crawl_id", "page_no")
    has_next = materialize(planner.select("a.next").join(listing, "page_id").select("crawl_id", "page_no"))
    has_end = materialize(planner.select("a.profile[href$='7']").join(listing, "page_id").select("crawl_id", "page_no"))

    def counted(walk, name):
        return walk.groupBy("crawl_id").agg(F.count(F.lit(1)).alias(name))

    return (counted(next_selector_stop(pages, has_next), "by_next")
            .join(counted(next_selector_stop(pages, has_next, max_pages=2), "by_limit"), "crawl_id")
            .join(counted(end_selector_stop(pages, has_end), "by_end"), "crawl_id")
            .withColumnRenamed("crawl_id", "nation_key"))


LISTING_LIMITS_SQL = f"""
WITH s AS (
  SELECT s.s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s.s_nationkey ORDER BY s_suppkey) - 1 AS r
  FROM supplier s JOIN nation ON s.s_nationkey = n_nationkey),
c AS (SELECT s_nationkey, CAST(ceil(count(*) / 4.0) AS BIGINT) AS p,
             min(CASE WHEN s_suppkey % 10 = 7 THEN r // 4 + 1 END) AS e FROM s GROUP BY s_nationkey)
SELECT CAST(s_nationkey AS BIGINT) AS nation_key, p + {TRAILING} AS by_next, CAST(2 AS BIGINT) AS by_limit,
       coalesce(e, p + {TRAILING}) AS by_end
FROM c
"""


def listing_walk(spark, sf_dir):
    """W3 + W4 + W1 + U1 + U2 over paginated directory listings: the last
    card of a page repeats on the next, and 3 trailing pages bring nothing
    new.  Per nation: pages walked by the next-link rule, the empty-streak
    stop page, items appended (duplicates kept) and distinct items."""
    dom, planner = rendered_dom(spark, sf_dir, OVERLAP, TRAILING)
    listing = _listing(dom)
    containers = find_containers(planner, "div.profile-card")
    fields = container_fields(dom, planner, containers, [{"label": "name", "selector": "h3"}])
    # stage boundary: the walks below read items and pages from several branches
    items = materialize(fields.join(listing, "page_id").select(
        "crawl_id", "page_no", F.col("container_index").alias("idx"), F.col("value").alias("item")))
    pages = listing.select("crawl_id", "page_no")
    has_next = materialize(planner.select("a.next").join(listing, "page_id").select("crawl_id", "page_no"))
    walked = materialize(next_selector_stop(pages, has_next))
    stops = empty_streak_stop(items, pages, k=3, walk=materialize(walk_pages(pages)))
    appended = append_accumulate(items, walked).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n_appended"))
    distinct = distinct_accumulate(items, walked).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n_distinct"))
    n_walked = walked.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("pages_walked"))
    return (n_walked.join(stops.select("crawl_id", "stop_page"), "crawl_id", "left")
            .join(appended, "crawl_id", "left").join(distinct, "crawl_id", "left")
            .select(F.col("crawl_id").alias("nation_key"), F.col("pages_walked").cast("bigint").alias("pages_walked"),
                    F.col("stop_page").cast("bigint").alias("stop_page"),
                    F.col("n_appended").cast("bigint").alias("n_appended"),
                    F.col("n_distinct").cast("bigint").alias("n_distinct")))


LISTING_WALK_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n, CAST(ceil(count(*) / 4.0) AS BIGINT) AS p
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey)
SELECT CAST(s_nationkey AS BIGINT) AS nation_key, p + {TRAILING} AS pages_walked, p + {TRAILING} AS stop_page,
       CAST(n + (p - 1) * {OVERLAP} + {TRAILING} * (n - 4 * (p - 1)) AS BIGINT) AS n_appended,
       CAST(n AS BIGINT) AS n_distinct
FROM c
"""


def url_page_sequence(spark, sf_dir):
    """W5 + P15: the URLs of the first 200 pages under each URL pattern, built
    by rewriting one query parameter of every page URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    seq = page_url_sequence(pages, n=200)
    return seq.select("page_id", "param", F.col("page_no").cast("bigint").alias("page_no"), "page_url")


URL_PAGE_SEQUENCE_SQL = """
WITH pat AS (
  SELECT * FROM (VALUES ('offset', 20, 0), ('page', 1, 1), ('skip', 20, 0), ('start', 20, 0), ('from', 20, 0))
    AS t(param, step, start)),
u AS (
  SELECT page_id, url,
         regexp_extract(url, '^([^?#]*)', 1) AS head,
         regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q,
         regexp_extract(url, '(#.*)$', 1) AS frag
  FROM pages),
s AS (
  SELECT u.*, pat.param, i + 1 AS page_no, CAST(pat.start + i * pat.step AS VARCHAR) AS v
  FROM u, pat, range(0, 200) r(i))
SELECT page_id, param, CAST(page_no AS BIGINT) AS page_no,
       head || '?' || CASE
         WHEN q = '' THEN param || '=' || v
         WHEN regexp_matches('&' || q, '&' || param || '=') THEN
           substr(regexp_replace('&' || q, '&' || param || '=[^&]*', '&' || param || '=' || v), 2)
         ELSE q || '&' || param || '=' || v END || frag AS page_url
FROM s
"""
