"""Template audit (T1-T8, P17): rules over a table of templates.

Each rule is a Column expression over one template row (higher-order
functions on ``elements`` / ``actions``), so a library of any size is
classified in one narrow projection -- no joins, no shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions.urls import subpage_pattern_from_target
from ..sources.templates import SUB_ELEMENT, SUBPAGE_ELEMENT

# Keyword lists of the template rules.
DIRECTORY_SELECTOR_WORDS = ["people", "list", "grid"]
DIRECTORY_SUB_WORDS = ["link", "profile", "email"]
PERSON_SUB_WORDS = ["name", "title", "position", "email", "phone"]
SUBPAGE_SUB_WORDS = ["education", "cred"]
SUBPAGE_CONTAINER_WORDS = ["subpage", "sublink", "subcon", "education", "credential", "experience", "bio", "profile"]
SUBPAGE_CONTAINER_SUB_WORDS = ["education", "credential", "admission", "bar", "experience", "bio", "creds"]
NAVIGATION_SELECTOR_WORDS = ["strong", "name", "link", "profile", "lawyer"]
GENERIC_ACTION_SELECTORS = ["a", "button", "span", "div"]


def _has_any(s: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(s, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _subs(e: Column) -> Column:
    return F.coalesce(e["sub_elements"], F.array())


def profile_action(a: Column) -> Column:
    """Action label has ``link`` and its target URL ``/lawyer/`` (null-safe)."""
    return _has_any(a["label"], ["link"]) & F.coalesce(a["target_url"].contains("/lawyer/"), F.lit(False))


def is_directory_template(t: Column = None) -> Column:
    """Any of six indicators."""
    el, ac = F.col("elements"), F.col("actions")
    return (
        F.exists(el, lambda e: F.coalesce(e["is_container"], F.lit(False)))
        | F.exists(el, lambda e: F.coalesce(e["is_multiple"], F.lit(False)))
        | F.exists(el, lambda e: _has_any(e["selector"], DIRECTORY_SELECTOR_WORDS))
        | F.exists(el, lambda e: F.exists(_subs(e), lambda s: _has_any(s["label"], DIRECTORY_SUB_WORDS)))
        | F.exists(ac, profile_action)
        | F.exists(el, lambda e: F.size(F.filter(_subs(e), lambda s: _has_any(s["label"], PERSON_SUB_WORDS))) >= 2)
    )


def needs_subpage_data() -> Column:
    """Any of four indicators."""
    el, ac = F.col("elements"), F.col("actions")
    return (
        F.exists(el, lambda e: F.size(F.coalesce(e["subpage_elements"], F.array())) > 0)
        | F.exists(el, lambda e: F.exists(_subs(e), lambda s: _has_any(s["label"], SUBPAGE_SUB_WORDS)))
        | (F.size(F.filter(el, lambda e: F.coalesce(e["is_container"], F.lit(False)))) >= 2)
        | F.exists(ac, profile_action)
    )


def is_subpage_container(e: Column) -> Column:
    """T3 for one element."""
    return (_has_any(e["label"], SUBPAGE_CONTAINER_WORDS)
            | F.exists(_subs(e), lambda s: _has_any(s["label"], SUBPAGE_CONTAINER_SUB_WORDS))
            | F.coalesce(e["follow_links"], F.lit(False)))


def has_pagination() -> Column:
    """T5: a selector is set; infinite scroll also accepts scroll settings."""
    p = F.col("pagination")
    selectors = p["next_selector"].isNotNull() & (p["next_selector"] != "") | \
        p["load_more_selector"].isNotNull() & (p["load_more_selector"] != "") | \
        p["page_selector"].isNotNull() & (p["page_selector"] != "")
    scroll = (p["scroll_pause_time"].isNotNull() | p["max_pages"].isNotNull()
              | p["end_condition_selector"].isNotNull())
    return F.when(p.isNull(), F.lit(False)).when(
        p["pattern_type"] == "infinite_scroll", F.coalesce(selectors, F.lit(False)) | scroll
    ).otherwise(F.coalesce(selectors, F.lit(False)))


def is_sublink_action(a: Column) -> Column:
    return _has_any(a["label"], ["sublink"]) | F.coalesce(a["selector"].contains("lawyer"), F.lit(False))


def pagination_location() -> Column:
    """``subpage`` when a sublink action exists, else ``main_page``."""
    return F.when(F.exists("actions", lambda a: _has_any(a["label"], ["sublink"])), F.lit("subpage")) \
        .otherwise(F.lit("main_page"))


def non_navigation_actions() -> Column:
    """Actions that remain after dropping profile clicks (and bare
    generic selectors on directory templates)."""
    directory = is_directory_template()
    return F.filter("actions", lambda a: ~((a["action_type"] == "click")
                                           & _has_any(a["selector"], NAVIGATION_SELECTOR_WORDS))
                    & ~(directory & a["selector"].isin(GENERIC_ACTION_SELECTORS)))


def feature_summary() -> Column:
    """Feature names, one per element that has them, then the
    template-level ones."""
    el = F.col("elements")
    per_el = F.flatten(F.transform(el, lambda e: F.array_compact(F.array(
        F.when(F.coalesce(e["follow_links"], F.lit(False)), F.lit("Subpage Navigation")),
        F.when(F.size(F.coalesce(e["subpage_elements"], F.array())) > 0, F.lit("Enhanced Data Extraction"))))))
    tail = F.array_compact(F.array(
        F.when(F.size("actions") > 0, F.lit("Action-based Navigation")),
        F.when(F.col("pagination").isNotNull(), F.lit("Pagination Support"))))
    return F.concat(per_el, tail)


def repair_sublinks(templates: DataFrame) -> DataFrame:
    """T4 (+P17): with a sublink action, enable subpage scraping, fill the URL
    pattern from the first sublink target holding ``/lawyer/``, and mark
    subpage containers ``follow_links`` with ``subpage_elements`` copied from
    their sub-elements where unset."""
    sub_actions = F.filter("actions", is_sublink_action)
    has = F.size(sub_actions) > 0
    pattern = F.try_element_at(F.filter(F.transform(sub_actions, lambda a: subpage_pattern_from_target(a["target_url"])),
                                    lambda p: p.isNotNull()), F.lit(1))
    fixed_el = F.transform("elements", lambda e: F.when(has & is_subpage_container(e), e.withField(
        "follow_links", F.lit(True)).withField(
        "subpage_elements", F.when(F.size(F.coalesce(e["subpage_elements"], F.array())) > 0, e["subpage_elements"])
        .otherwise(F.transform(_subs(e), lambda s: F.struct(
            s["label"].alias("label"), s["selector"].alias("selector"), F.lit("css").alias("selector_type"),
            s["element_type"].alias("element_type"), s["attribute_name"].alias("attribute_name"),
            F.lit(False).alias("is_multiple"), s["is_required"].alias("is_required"),
            F.lit(False).alias("is_container"), F.lit(False).alias("use_find_similar"),
            F.array().cast(T.ArrayType(SUB_ELEMENT)).alias("sub_elements"),
            F.lit(False).alias("follow_links")).cast(SUBPAGE_ELEMENT))))).otherwise(e))
    return (templates
            .withColumn("enable_subpage_scraping", F.col("enable_subpage_scraping") | has)
            .withColumn("subpage_url_pattern", F.when(has & F.col("subpage_url_pattern").isNull(), pattern)
                        .otherwise(F.col("subpage_url_pattern")))
            .withColumn("elements", fixed_el))


def audit(templates: DataFrame, key: str = "name") -> DataFrame:
    """T1-T3, T5-T8 for every template in one projection."""
    return templates.select(
        key,
        is_directory_template().alias("is_directory"),
        needs_subpage_data().alias("needs_subpages"),
        F.size(F.filter("elements", is_subpage_container)).alias("n_subpage_containers"),
        has_pagination().alias("has_pagination"),
        pagination_location().alias("pagination_location"),
        F.size(non_navigation_actions()).alias("n_non_navigation_actions"),
        F.array_join(feature_summary(), ", ").alias("features"),
    )
