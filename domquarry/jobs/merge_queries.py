"""Merge and incremental queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators.containers import container_fields, find_containers, profile_link_pick
from ..operators.merge import (incremental_containers, incremental_delta, merge_related, pages_to_rows,
                               unified_profiles)
from ..operators.paginate import next_selector_stop
from ..operators.subpages import follow_links, link_queue, process_queue, subpage_records_from_containers, \
    subpage_values
from ..session import materialize
from .common import table
from .directory_queries import (CARD_SUBS, DIRECTORY_PROFILES_SQL, PER_PAGE, PROFILE_ELEMENTS, _SUPPLIERS,
                                _POSITION, rendered_dom)
from .pagination_queries import OVERLAP, TRAILING, _listing


def _lists(spark, sf_dir, main_label):
    """Card records (main list) + records from the linked profile pages
    (subpage list, keyed by card index and profile link), as one long
    ``lists`` table."""
    dom, planner = rendered_dom(spark, sf_dir)
    containers = materialize(find_containers(planner, "div.profile-card"))
    fields = materialize(container_fields(dom, planner, containers, CARD_SUBS))
    links = materialize(profile_link_pick(dom, planner, containers, fields, CARD_SUBS))
    recs = containers.join(links, ["page_id", "container_id"], "left")
    linked = materialize(follow_links(recs, dom.docs, "profile_link"))
    sub = materialize(subpage_values(dom, planner, linked, PROFILE_ELEMENTS))
    main = (fields.join(links, ["page_id", "container_id"], "left")
            .select("page_id", F.lit(main_label).alias("list_label"), F.lit(0).alias("list_order"),
                    F.col("container_index").alias("record_index"),
                    F.coalesce("profile_link", F.lit("")).alias("profile_link"), F.col("label").alias("key"),
                    "value_ord", "value"))
    subl = (linked.join(sub, "subpage_id")
            .select("page_id", F.lit("subpage education").alias("list_label"), F.lit(1).alias("list_order"),
                    F.col("container_index").alias("record_index"),
                    F.coalesce("profile_link", F.lit("")).alias("profile_link"), F.col("label").alias("key"),
                    "value_ord", "value"))
    # the merge reads this table from several branches: materialise it once
    return dom, materialize(main.unionByName(subl))


def _joined(key):
    return F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("key") == key, F.struct("value_ord", "value")))), lambda s: s["value"]), "|")


def _opt(key):
    return F.when(F.count(F.when(F.col("key") == key, 1)) > 0, _joined(key))


def merge_related_lists(spark, sf_dir):
    """Card list + subpage list merged by profile link OR index."""
    _, lists = _lists(spark, sf_dir, "people")
    merged = merge_related(lists)
    return (merged.groupBy("page_id", "list_label", "record_index", "profile_link")
            .agg(F.max(F.when(F.col("key") == "name", F.col("value"))).alias("name"),
                 _opt("education").alias("education"), _opt("admissions").alias("admissions"))
            .select("profile_link", "name", "education", "admissions"))


MERGE_RELATED_LISTS_SQL = DIRECTORY_PROFILES_SQL


def unified_profile_rows(spark, sf_dir):
    """The ``main container`` list as spine with the core columns and
    the subpage fields of the same index."""
    _, lists = _lists(spark, sf_dir, "main container")
    prof, _ = unified_profiles(lists)
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return (prof.groupBy("page_id", "record_index")
            .agg(one("name").alias("name"), one("position").alias("position"), one("sector").alias("sector"),
                 one("email").alias("email"), one("phone").alias("phone"), one("profile_link").alias("profile_link"),
                 _opt("sectors").alias("sectors"), _opt("education").alias("education"),
                 _opt("admissions").alias("admissions"))
            .drop("page_id", "record_index"))


UNIFIED_PROFILE_ROWS_SQL = f"""
SELECT s_name AS name, {_POSITION} AS position, '' AS sector,
       lower(replace(s_name, '#', '.')) || '@dir.example' AS email, '' AS phone,
       'https://dir.example/lawyer/' || s_suppkey AS profile_link,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Sector ' || (s_suppkey % 7) || '|Sector ' || (s_suppkey % 5 + 10)
            ELSE 'Sector ' || (s_suppkey % 7) END AS sectors,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'University of ' || n_name || '|' || r_name || ' Law School' END
         AS education,
       CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE 'Bar of ' || n_name END AS admissions
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def unified_metadata(spark, sf_dir):
    """A5: total profiles, spine list and subpage sources per page."""
    dom, lists = _lists(spark, sf_dir, "main container")
    _, meta = unified_profiles(lists)
    return (meta.join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", F.col("total_profiles").cast("bigint").alias("total_profiles"), "main_container_source",
                    F.array_join("subpage_sources", ",").alias("subpage_sources")))


UNIFIED_METADATA_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey),
p AS (
  SELECT s_nationkey, unnest(range(1, CAST(ceil(n / {PER_PAGE}.0) AS BIGINT) + 1)) AS page_no, n FROM c),
k AS (
  SELECT s_nationkey, page_no, least({PER_PAGE}, n - {PER_PAGE} * (page_no - 1)) AS cards,
         (SELECT count(*) FROM (
            SELECT s_suppkey, row_number() OVER (PARTITION BY s2.s_nationkey ORDER BY s_suppkey) - 1 AS r
            FROM supplier s2 JOIN nation ON s2.s_nationkey = n_nationkey WHERE s2.s_nationkey = p.s_nationkey) x
          WHERE x.r // {PER_PAGE} + 1 = p.page_no AND x.s_suppkey % 10 <> 3) AS with_profile
  FROM p)
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || page_no AS url,
       CAST(cards AS BIGINT) AS total_profiles, 'main container' AS main_container_source,
       CASE WHEN with_profile > 0 THEN 'subpage education' ELSE '' END AS subpage_sources
FROM k
"""


def incremental_items(spark, sf_dir):
    """U4: events held before 2024-01-15 are the existing state; per (user,
    event type) only the events beyond that count are new."""
    ev = table(spark, sf_dir, "events")
    cur = ev.select(F.col("user_id").alias("crawl_id"), F.col("event_type").alias("label"),
                    F.lit(True).alias("is_list"), F.struct("ts", "event_id").alias("seq"), "event_id")
    existing = (ev.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
                .groupBy(F.col("user_id").alias("crawl_id"), F.col("event_type").alias("label"))
                .agg(F.count(F.lit(1)).alias("n")))
    d = incremental_delta(existing, cur)
    return d.select(F.col("crawl_id").alias("user_id"), F.col("label").alias("event_type"), "event_id")


INCREMENTAL_ITEMS_SQL = """
WITH r AS (
  SELECT user_id, event_type, event_id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS pos FROM events),
e AS (
  SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2)
SELECT r.user_id, r.event_type, r.event_id FROM r LEFT JOIN e USING (user_id, event_type)
WHERE r.pos > coalesce(e.n, 0)
"""


def incremental_subpages(spark, sf_dir):
    """U5 + J7 + J10: subpage statuses for cards beyond the 2 already held
    on each listing page."""
    dom, planner = rendered_dom(spark, sf_dir)
    held = dom.docs.select("page_id", F.lit(2).alias("n"))
    containers = incremental_containers(find_containers(planner, "div.profile-card"), held)
    main = subpage_records_from_containers(dom, planner, containers)
    done, _ = process_queue(link_queue(main), dom.docs, lambda linked: subpage_values(dom, planner, linked,
                                                                                      PROFILE_ELEMENTS))
    return done.select("url", F.col("container_index").cast("bigint").alias("container_index"), "status")


INCREMENTAL_SUBPAGES_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/lawyer/' || s_suppkey AS url, CAST(rnk % {PER_PAGE} AS BIGINT) AS container_index,
       CASE WHEN s_suppkey % 10 = 3 THEN 'failed' ELSE 'completed' END AS status
FROM s WHERE rnk % {PER_PAGE} >= 2
"""


def listing_rows(spark, sf_dir):
    """U7 (+W3): every card name of every walked listing page as a row with
    its source page."""
    dom, planner = rendered_dom(spark, sf_dir, OVERLAP, TRAILING)
    listing = _listing(dom)
    containers = find_containers(planner, "div.profile-card")
    fields = container_fields(dom, planner, containers, [{"label": "name", "selector": "h3"}])
    items = materialize(fields.join(listing, "page_id").select(
        "crawl_id", "page_no", "label", F.lit(True).alias("is_list"), F.col("value").alias("item")))
    has_next = materialize(planner.select("a.next").join(listing, "page_id").select("crawl_id", "page_no"))
    walked = next_selector_stop(listing.select("crawl_id", "page_no"), has_next)
    rows = pages_to_rows(items.join(walked, ["crawl_id", "page_no"], "left_semi"))
    return rows.select(F.col("crawl_id").alias("nation_key"), F.col("_source_page").cast("bigint").alias("source_page"),
                       "field", "value")


LISTING_ROWS_SQL = f"""
WITH s AS (
  SELECT s.s_nationkey, s_name, row_number() OVER (PARTITION BY s.s_nationkey ORDER BY s_suppkey) - 1 AS r,
         count(*) OVER (PARTITION BY s.s_nationkey) AS n
  FROM supplier s JOIN nation ON s.s_nationkey = n_nationkey),
t AS (SELECT *, CAST(ceil(n / 4.0) AS BIGINT) AS p, r // 4 + 1 AS pg FROM s)
SELECT CAST(s_nationkey AS BIGINT) AS nation_key, CAST(pg AS BIGINT) AS source_page, 'name' AS field, s_name AS value
FROM t
UNION ALL
SELECT s_nationkey, pg + 1, 'name', s_name FROM t WHERE r % 4 = 3 AND pg < p
UNION ALL
SELECT s_nationkey, p + unnest(range(1, {TRAILING} + 1)), 'name', s_name FROM t WHERE pg = p
"""
