"""Fallback ladders, label mapping, validation, predicates and small URL
rules (E6-E17, C2, C3, J11, P16, U3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.predicates import is_common_junk, is_valid_name, is_valid_position
from ..functions.urls import directory_url_from_profile
from ..operators.containers import find_containers
from ..operators.detect import validate_candidates
from ..operators.fallback import element_ladder, find_with_fallback, resolve_sub_element
from ..operators.merge import merge_initial_paginated
from ..operators.subpages import eligible_links, link_queue, subpage_records_from_containers
from ..operators.values import node_values
from ..session import materialize
from .common import page_dom, table
from .directory_queries import PER_PAGE, _POSITION, _SECTORS, _SUPPLIERS, rendered_dom
from .page_queries import ARTICLE_PARAGRAPHS_SQL


def fallback_card_text(spark, sf_dir):
    """E6 + E8 + E10 + E11 + E12: ``.card-name`` is absent; the ladder falls
    through the semantic and structure rungs to the variant
    ``[class*="card"]`` on the listings."""
    dom, planner = rendered_dom(spark, sf_dir)
    el = {"label": "person name", "selector": ".card-name"}
    ladder = element_ladder(el)
    m = find_with_fallback(planner, el)
    v = node_values(dom, m, "text")
    names = F.create_map(*[x for i, a in enumerate(ladder) for x in (F.lit(i), F.lit(a if isinstance(a, str) else a.source))])
    return (v.join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", names[F.col("priority")].alias("rule"), "value"))


FALLBACK_CARD_TEXT_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1) AS url,
       '[class*="card"]' AS rule,
       s_name || {_POSITION} || lower(replace(s_name, '#', '.')) || '@dir.example' || 'View profile' ||
       replace({_SECTORS}, '|', '') AS value
FROM s
"""


def mapped_card_fields(spark, sf_dir):
    """C3 + E14 + E7 (+E15/E16): generic sub-element selectors (``strong``,
    ``span``, ``a``) mapped by label to rule lists; first alternative with a
    match inside each card wins; validated fallback XPaths would follow."""
    dom, planner = rendered_dom(spark, sf_dir)
    cont = find_containers(planner, "div.profile-card")
    scope = cont.select("page_id", F.col("container_id").alias("scope_id"))
    out = None
    for label, sel in (("name", "strong"), ("title", "span"), ("email", "a")):
        m = resolve_sub_element(dom, planner, cont, {"label": label, "selector": sel})
        v = node_values(dom, m, "text")
        v = (v.groupBy("page_id", "scope_id").agg(F.min_by("value", "node_id").alias(label))
             .withColumnRenamed("scope_id", "container_id"))
        out = v if out is None else out.join(v, ["page_id", "container_id"], "full")
    return (out.join(cont, ["page_id", "container_id"]).join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", F.col("container_index").cast("bigint").alias("container_index"), "name", "title",
                    "email"))


MAPPED_CARD_FIELDS_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1) AS url,
       CAST(rnk % {PER_PAGE} AS BIGINT) AS container_index, s_name AS name, {_POSITION} AS title,
       lower(replace(s_name, '#', '.')) || '@dir.example' AS email
FROM s
"""


def validated_emails(spark, sf_dir):
    """All links of a card as email candidates; valid ones kept when
    0 < valid <= 80 % of the candidates."""
    dom, planner = rendered_dom(spark, sf_dir)
    cont = find_containers(planner, "div.profile-card")
    scope = cont.select("page_id", F.col("container_id").alias("scope_id"))
    cands = planner.select("a", scope=scope)
    ok = validate_candidates(dom, cands, "email", "text")
    return (ok.join(cont.withColumnRenamed("container_id", "scope_id"), ["page_id", "scope_id"])
            .join(dom.docs.select("page_id", "url"), "page_id")
            .select("url", F.col("container_index").cast("bigint").alias("container_index"),
                    F.col("value").alias("email")))


VALIDATED_EMAILS_SQL = f"""{_SUPPLIERS}
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || (rnk // {PER_PAGE} + 1) AS url,
       CAST(rnk % {PER_PAGE} AS BIGINT) AS container_index,
       lower(replace(s_name, '#', '.')) || '@dir.example' AS email
FROM s
"""


def text_predicates(spark, sf_dir):
    """E17 on every article paragraph: name-like, position-like, junk."""
    dom, planner = page_dom(spark, sf_dir)
    v = node_values(dom, planner.select("article p"), "text")
    t = F.col("value")
    return v.groupBy("page_id").agg(
        F.count(F.when(is_valid_name(t), 1)).alias("n_name_like"),
        F.count(F.when(is_valid_position(t), 1)).alias("n_position_like"),
        F.count(F.when(is_common_junk(t), 1)).alias("n_junk"))


def _any_sql(col, words):
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def _text_predicates_sql():
    from ..functions.predicates import JUNK_PHRASES, NAME_STOP_WORDS, POSITION_WORDS
    name = (f"length(value) BETWEEN 3 AND 60 AND contains(value, ' ') "
            f"AND substr(value, 1, 1) = upper(substr(value, 1, 1)) AND substr(value, 1, 1) <> lower(substr(value, 1, 1)) "
            f"AND NOT {_any_sql('value', NAME_STOP_WORDS)}")
    pos = f"length(value) BETWEEN 3 AND 100 AND ({_any_sql('value', POSITION_WORDS)} OR NOT {_any_sql('value', JUNK_PHRASES)})"
    return f"""
WITH v AS ({ARTICLE_PARAGRAPHS_SQL})
SELECT page_id, count(*) FILTER (WHERE {name}) AS n_name_like,
       count(*) FILTER (WHERE {pos}) AS n_position_like,
       count(*) FILTER (WHERE {_any_sql('value', JUNK_PHRASES)}) AS n_junk
FROM v GROUP BY page_id
"""


TEXT_PREDICATES_SQL = _text_predicates_sql()


def initial_paginated_merge(spark, sf_dir):
    """Day-1 items (initial page) + every day's items (pagination, which
    re-reads day 1): lists extend -- distinct and appended counts."""
    ev = table(spark, sf_dir, "events")
    first = ev.groupBy("user_id").agg(F.min(F.to_date("ts")).alias("d0"))
    e = ev.join(first, "user_id").select(F.col("user_id").alias("crawl_id"), F.lit("types").alias("label"),
                                         F.lit(True).alias("is_list"), F.struct("ts", "event_id").alias("seq"),
                                         F.col("event_type").alias("value"), (F.to_date("ts") == F.col("d0")).alias("d1"))
    initial = e.where("d1").drop("d1")
    pag = e.drop("d1")
    distinct = merge_initial_paginated(initial, pag, distinct=True).groupBy("crawl_id").count()
    append = merge_initial_paginated(initial, pag, distinct=False).groupBy("crawl_id").count()
    return (distinct.withColumnRenamed("count", "n_distinct").join(append.withColumnRenamed("count", "n_append"),
                                                                   "crawl_id")
            .select(F.col("crawl_id").alias("user_id"), "n_distinct", "n_append"))


INITIAL_PAGINATED_MERGE_SQL = """
WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS d0 FROM events GROUP BY user_id)
SELECT e.user_id, count(DISTINCT event_type) AS n_distinct,
       count(*) + count(*) FILTER (WHERE CAST(ts AS DATE) = d0) AS n_append
FROM events e JOIN f USING (user_id) GROUP BY e.user_id
"""


def directory_urls(spark, sf_dir):
    """The directory URL of every rendered page (profile URLs map to
    ``<host>/people/``, other URLs are kept)."""
    dom, _ = rendered_dom(spark, sf_dir)
    return dom.docs.select("url", directory_url_from_profile(F.col("url")).alias("directory_url"))


DIRECTORY_URLS_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey),
p AS (SELECT s_nationkey, unnest(range(1, CAST(ceil(n / {PER_PAGE}.0) AS BIGINT) + 1)) AS page_no FROM c)
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || page_no AS url,
       'https://dir.example/nation/' || s_nationkey || '/people?page=' || page_no AS directory_url FROM p
UNION ALL
SELECT 'https://dir.example/lawyer/' || s_suppkey, 'https://dir.example/people/'
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_suppkey % 10 <> 3
"""


def eligible_subpage_links(spark, sf_dir):
    """J9 + J11: each nation's queue of distinct profile links, filtered by a
    URL pattern, at most 3 per nation (queue order: container index, URL)."""
    dom, planner = rendered_dom(spark, sf_dir)
    cont = find_containers(planner, "div.profile-card")
    nation = dom.docs.select("page_id", F.regexp_extract("url", r"/nation/(\d+)/", 1).alias("template_id"))
    q = link_queue(subpage_records_from_containers(dom, planner, cont).join(nation, "page_id"), by="template_id")
    e = eligible_links(q, r"/lawyer/[0-9]*[05]$", 3)
    return e.select("url", F.col("container_index").cast("bigint").alias("container_index"), "status")


ELIGIBLE_SUBPAGE_LINKS_SQL = f"""{_SUPPLIERS}
SELECT url, container_index, 'pending' AS status FROM (
  SELECT 'https://dir.example/lawyer/' || s_suppkey AS url, CAST(rnk % {PER_PAGE} AS BIGINT) AS container_index
  FROM s WHERE regexp_matches(CAST(s_suppkey AS VARCHAR), '[05]$')
  QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY container_index, url) <= 3)
"""


def ladder_containers(spark, sf_dir):
    """C7 + C2 (E18 first, then the template selector, E13, E11, E12, E20):
    the template's main-page container (not its subpage container) found by
    the smart ladder, since its own selector matches nothing."""
    import json
    from ..operators.containers import main_page_containers
    from ..operators.fallback import container_ladder
    from ..sources.templates import templates_from_json
    dom, planner = rendered_dom(spark, sf_dir)
    doc = json.dumps({"name": "directory", "url": "https://dir.example/", "elements": [
        {"label": "people", "selector": ".lawyer-tile", "is_container": True,
         "sub_elements": [{"label": "name", "selector": "h3"}]},
        {"label": "education container", "selector": ".edu", "is_container": True,
         "sub_elements": [{"label": "education", "selector": "li"}]}]})
    tpl = templates_from_json(spark.createDataFrame([(doc,)], "json string"))
    # template configuration (one row per container element) -> plan
    main = [r["element"]["selector"] for r in main_page_containers(tpl).collect()]
    before, after = container_ladder(main[0], smart_detection=True)
    c = find_containers(planner, main[0], ladder=before, after=after)
    return (c.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_containers"))
            .join(dom.docs.select("page_id", "url"), "page_id").where(F.col("url").rlike(r"/people\?page="))
            .select("url", "n_containers"))


LADDER_CONTAINERS_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey),
p AS (SELECT s_nationkey, unnest(range(1, CAST(ceil(n / {PER_PAGE}.0) AS BIGINT) + 1)) AS page_no, n FROM c),
k AS (SELECT s_nationkey, page_no, least({PER_PAGE}, n - {PER_PAGE} * (page_no - 1)) AS cards FROM p)
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || page_no AS url,
       CAST(CASE WHEN cards >= 3 THEN cards ELSE 4 END AS BIGINT) AS n_containers
FROM k
"""


def first_education(spark, sf_dir):
    """P11 + P13: subpage values capped to the first match (cap=1), and a
    card sub-element with an empty selector reading the card itself."""
    from ..operators.containers import container_fields
    from ..operators.subpages import follow_links, subpage_values
    dom, planner = rendered_dom(spark, sf_dir)
    cont = materialize(find_containers(planner, "div.profile-card"))
    fields = materialize(container_fields(dom, planner, cont, [
        {"label": "card", "selector": ""},
        {"label": "profile_link", "selector": "a.profile", "element_type": "link"}]))
    links = fields.where(F.col("label") == "profile_link").select("page_id", "container_id",
                                                                 F.col("value").alias("profile_link"))
    card = fields.where(F.col("label") == "card").select("page_id", "container_id", F.col("value").alias("card"))
    linked = materialize(follow_links(links, dom.docs, "profile_link"))
    sub = subpage_values(dom, planner, linked, [{"label": "education", "selector": "ul.education li"}], cap=1)
    return (linked.join(card, ["page_id", "container_id"]).join(sub, "subpage_id", "left")
            .select("profile_link", F.length("card").cast("bigint").alias("card_chars"),
                    F.col("value").alias("education")))


FIRST_EDUCATION_SQL = f"""
SELECT 'https://dir.example/lawyer/' || s_suppkey AS profile_link,
       CAST(length(s_name || {_POSITION} || lower(replace(s_name, '#', '.')) || '@dir.example' || 'View profile' ||
                   replace({_SECTORS}, '|', '')) AS BIGINT) AS card_chars,
       CASE WHEN s_suppkey % 10 <> 3 THEN 'University of ' || n_name END AS education
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


def action_profile_join(spark, sf_dir):
    """Cards whose profile link contains one of the template's action
    target URLs (a target for every supplier), as an equi-join of the link's substrings."""
    from ..operators.merge import action_subpage_join
    dom, planner = rendered_dom(spark, sf_dir)
    cont = find_containers(planner, "div.profile-card")
    scope = cont.select("page_id", F.col("container_id").alias("scope_id"))
    links = (node_values(dom, planner.select("a.profile", scope=scope), "link", resolve_links=True)
             .select("page_id", F.col("scope_id").alias("container_id"), F.lit("profile").alias("key"), "value"))
    acts = (table(spark, sf_dir, "supplier")
            .select(F.concat(F.lit("open "), F.col("s_suppkey").cast("string")).alias("label"),
                    F.concat(F.lit("https://dir.example/lawyer/"), F.col("s_suppkey").cast("string"))
                    .alias("target_url")))
    j = action_subpage_join(links, acts)
    return j.select("subpage_url", "action_label")


ACTION_PROFILE_JOIN_SQL = """
WITH r AS (SELECT s_suppkey AS rk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT s_suppkey AS tk FROM supplier),
m AS (
  SELECT rk, 'open ' || tk AS label, 'https://dir.example/lawyer/' || tk AS url
  FROM r JOIN t ON starts_with(CAST(rk AS VARCHAR), CAST(tk AS VARCHAR)))
SELECT arg_min(url, label) AS subpage_url, min(label) AS action_label FROM m GROUP BY rk
"""


def directory_context_cards(spark, sf_dir):
    """E26 (+E21): the first card of every listing page is in a directory
    context (directory URL, or at least 3 similar nodes)."""
    from ..operators.detect import directory_context
    dom, planner = rendered_dom(spark, sf_dir)
    ex = planner.select("div.profile-card:first-child").select("page_id", F.col("node_id").alias("example_id"))
    d = directory_context(dom, planner, ex)
    return d.join(dom.docs.select("page_id", "url"), "page_id").select("url", "is_directory_context")


DIRECTORY_CONTEXT_CARDS_SQL = f"""
WITH c AS (
  SELECT s_nationkey, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey),
p AS (SELECT s_nationkey, unnest(range(1, CAST(ceil(n / {PER_PAGE}.0) AS BIGINT) + 1)) AS page_no FROM c)
SELECT 'https://dir.example/nation/' || s_nationkey || '/people?page=' || page_no AS url, TRUE AS is_directory_context
FROM p
"""
