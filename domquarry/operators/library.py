"""A template library generated in Spark from a relational table (TV oracles).

One template per ``part`` row; which elements, actions, pagination, filters
and defects a template has is decided by ``k = p_partkey`` modulo small
numbers, so the expected analysis results follow from ``k`` in plain SQL and
the library grows with the table (thousands of templates at sf0.1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.templates import ACTION, ELEMENT, FILTER, PAGINATION, SUB_ELEMENT, SUBPAGE_ELEMENT, with_defaults


def _sub(label, selector) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(selector).alias("selector"),
                    F.lit(None).cast("string").alias("element_type"), F.lit(None).cast("string").alias("attribute_name"),
                    F.lit(None).cast("boolean").alias("is_required"))


def _element(label: Column, selector: Column, selector_type: Column = None, element_type: Column = None,
             is_multiple=None, is_container=None, sub_elements: Column = None, follow_links: Column = None,
             subpage_elements: Column = None) -> Column:
    none_s, none_b = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return F.struct(
        label.alias("label"), selector.alias("selector"),
        (selector_type if selector_type is not None else none_s).alias("selector_type"),
        (element_type if element_type is not None else none_s).alias("element_type"),
        none_s.alias("attribute_name"),
        (F.lit(is_multiple) if is_multiple is not None else none_b).alias("is_multiple"),
        none_b.alias("is_required"),
        (F.lit(is_container) if is_container is not None else none_b).alias("is_container"),
        none_b.alias("use_find_similar"),
        (sub_elements if sub_elements is not None else F.lit(None).cast(f"array<{SUB_ELEMENT.simpleString()}>"))
        .alias("sub_elements"),
        (follow_links if follow_links is not None else none_b).alias("follow_links"),
        (subpage_elements if subpage_elements is not None
         else F.lit(None).cast(f"array<{SUBPAGE_ELEMENT.simpleString()}>")).alias("subpage_elements"),
    ).cast(ELEMENT)


def _action(label, selector, action_type, target_url: Column | None = None) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(selector).alias("selector"),
                    F.lit(action_type).alias("action_type"), F.lit(None).cast("double").alias("wait_after"),
                    (target_url if target_url is not None else F.lit(None).cast("string")).alias("target_url"),
                    F.lit(None).cast("boolean").alias("repeat_until_missing"),
                    F.lit(None).cast("boolean").alias("repeat_until_no_change"),
                    F.lit(None).cast("int").alias("max_repeats")).cast(ACTION)


def _when_list(cond: Column, item: Column, dtype) -> Column:
    return F.when(cond, F.array(item)).otherwise(F.array().cast(f"array<{dtype.simpleString()}>"))


def template_library(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    brand = F.replace(F.lower(F.col("p_brand")), F.lit("#"), F.lit(""))
    product = _element(
        F.lit("product"),
        F.when(k % 17 == 0, F.lit("")).when(k % 4 == 2, F.lit("div.product-grid h1")).otherwise(F.lit("h1.product-name")),
        selector_type=F.when(k % 19 == 0, F.lit("regex")).otherwise(F.lit("css")),
        element_type=F.when(k % 23 == 0, F.lit("image")).otherwise(F.lit("text")),
        subpage_elements=F.when(k % 8 == 0, F.array(
            _element(F.lit("spec"), F.lit("table.spec td")).dropFields("subpage_elements").cast(SUBPAGE_ELEMENT))))
    subs = F.concat(
        F.array(_sub("name", "h3")),
        _when_list(k % 5 == 0, _sub("title", "span.title"), SUB_ELEMENT),
        _when_list(k % 7 == 0, _sub("email", "a[href^='mailto:']"), SUB_ELEMENT),
        _when_list(k % 4 == 0, _sub("education", "ul.education li"), SUB_ELEMENT))
    container = _element(
        F.when(k % 2 == 0, F.lit("people container")).otherwise(F.lit("cards")),
        F.when(k % 2 == 0, F.lit("div.people-list > div")).otherwise(F.lit(".profile-card")),
        is_container=True, sub_elements=subs, follow_links=(k % 6 == 0))
    details = _element(F.lit("profile details"), F.lit(".bio"), is_container=True,
                       sub_elements=F.array(_sub("bio", "p")))
    tags = _element(F.lit("tags"), F.lit("ul.tags li"), is_multiple=True)
    elements = F.when(k % 29 == 0, F.array().cast(f"array<{ELEMENT.simpleString()}>")).otherwise(F.concat(
        F.array(product),
        _when_list(k % 3 == 0, container, ELEMENT),
        _when_list(k % 12 == 0, details, ELEMENT),
        _when_list(k % 5 == 1, tags, ELEMENT)))
    actions = F.concat(
        _when_list(k % 4 == 1, _action("next_page", "a.next", "click"), ACTION),
        _when_list(k % 9 == 0, _action("profile_link", "a.lawyer", "click",
                                       F.concat(F.lit("https://shop.example/lawyer/"), k.cast("string"))), ACTION),
        _when_list(k % 14 == 0, _action("open sublink", "a.more", "click"), ACTION),
        _when_list(k % 31 == 0, _action("swipe", "div", "swipe"), ACTION))
    none_s = F.lit(None).cast("string")
    pagination = (
        F.when(k % 6 == 2, F.struct(F.lit("button").alias("pattern_type"), F.lit("a.next").alias("next_selector"),
                                    none_s.alias("load_more_selector"), none_s.alias("page_selector"),
                                    F.lit(None).cast("double").alias("scroll_pause_time"),
                                    F.col("p_size").alias("max_pages"), none_s.alias("end_condition_selector")))
        .when(k % 6 == 4, F.struct(F.lit("infinite_scroll").alias("pattern_type"), none_s, none_s, none_s,
                                   F.lit(None).cast("double"), F.lit(None).cast("int"), none_s).cast(PAGINATION))
        .when(k % 6 == 5, F.struct(F.lit("numbered").alias("pattern_type"), none_s, none_s, none_s,
                                   F.lit(None).cast("double"), F.lit(None).cast("int"), none_s).cast(PAGINATION))
        .cast(PAGINATION))

    def flt(label, values):
        return F.struct(F.lit(label).alias("filter_label"), F.lit(f"select#{label}").alias("filter_selector"),
                        values.alias("filter_values"), F.lit(None).cast("string").alias("filter_type"),
                        F.lit(None).cast("double").alias("wait_after_change")).cast(FILTER)

    filters = (F.when(k % 10 == 0, F.array(flt("brand", F.array(F.col("p_brand"), F.lit("Brand#99"))),
                                           flt("size", F.array(F.col("p_size").cast("string")))))
               .when(k % 10 == 5, F.array(flt("color", F.array().cast("array<string>"))))
               .otherwise(F.array().cast(f"array<{FILTER.simpleString()}>")))
    url = F.when(k % 11 == 0, F.lit("not a url")).otherwise(
        F.concat(F.lit("https://shop.example/"), brand, F.lit("/"), k.cast("string")))
    fmt = (F.when(k % 13 == 0, F.lit("xml")).when(k % 13 == 1, F.lit("csv")).when(k % 13 == 2, F.lit("excel"))
           .otherwise(F.lit("json")))
    t = part.select(
        F.concat(F.lit("tpl-"), k.cast("string")).alias("name"), F.col("p_name").alias("description"),
        F.lit(None).cast("string").alias("version"), F.lit(None).cast("timestamp").alias("created_at"),
        url.alias("url"), elements.alias("elements"), actions.alias("actions"), filters.alias("filters"),
        pagination.alias("pagination"), F.lit(None).cast("struct<type:string,selector:string>").alias("scroll_config"),
        F.lit(None).cast("boolean").alias("enable_subpage_scraping"),
        F.lit(None).cast("string").alias("subpage_url_pattern"), F.lit(None).cast("int").alias("max_subpages"),
        fmt.alias("output_format"), k.alias("template_key"))
    return with_defaults(t)
