"""Detection and counting over rule tables.

Each rule table is an ordered list of selectors; "first rule with enough
matches, per page" is one ``select_first`` plan (a union of the rules'
matches tagged with their priority, a grouped ``min(priority)`` and a
semi-join) -- never a loop over pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import candidate_is_valid, is_directory_url, is_generic_class
from ..plans.compile import Planner, parse_selector
from ..session import materialize
from .pagescan import count_matches
from .values import node_values

# Selectors whose largest match count is the profile count (A1).
PROFILE_COUNT_SELECTORS = [
    ".people-list strong",
    ".wp-grid-builder .wpgb-card",
    ".people-list .wp-block-column",
    "[class*=\"people\"] strong",
    ".wpgb-grid-archivePeople > div",
]
# Container-count selectors, first with more than 5 matches (A2).
CONTAINER_COUNT_SELECTORS = [
    ".people-list strong",
    "[class*=\"people\"] strong",
    ".wpgb-grid > div",
    ".directory-item",
    "[class*=\"card\"]",
    "[class*=\"item\"]",
]
# Load-more controls, first with a match wins.
LOAD_MORE_SELECTORS = [
    ".wpgb-pagination-facet button",
    ".wpgb-pagination-facet a",
    "button[class*=\"load\"]",
    "button[class*=\"more\"]",
    "a[class*=\"load\"]",
    "a[class*=\"more\"]",
    "[class*=\"load-more\"]",
    "[class*=\"show-more\"]",
    ".load-more",
    ".show-more",
    ".view-more",
]
# Load-more buttons by text or class.
LOAD_MORE_BUTTONS = [
    "button:contains(\"Load More\")",
    "button:contains(\"Show More\")",
    "button:contains(\"View More\")",
    "a:contains(\"Load More\")",
    "a:contains(\"Show More\")",
    ".load-more",
    ".show-more",
    ".view-more",
    "[data-load-more]",
]
# Next-page controls.
NEXT_LINK_SELECTORS = [
    "a:contains(\"Next\")",
    "a:contains(\">\")",
    ".pagination a:last-child",
    ".next",
    ".page-next",
]
# Grid-plugin indicators.
GRID_PLUGIN_INDICATORS = [
    ".wp-grid-builder",
    ".wpgb-template",
    ".wpgb-grid",
    ".wpgb-facet",
    "[data-grid]",
]
# Directory container patterns, first with at least 3 matches.
DIRECTORY_PATTERNS = [
    "*[data-wpgb-filter-item] .wp-block-column",
    "div.wp-block-column:has(a[href*='/lawyer/'])",
    ".wp-grid-builder .wp-block-column",
    "div.wp-block-column",
    "[class*='wp-block-column']",
    ".people.loading",
    ".people-card",
    ".lawyer-card",
    ".attorney-card",
    ".profile-card",
    "[class*='people']",
    "[class*='lawyer']",
    "[class*='attorney']",
    "[class*='profile']",
    ".directory-item",
    ".staff-member",
]
DIRECTORY_CONTENT_XPATHS = [
    "//*[.//a[contains(@href, '/lawyer/')]]",
    "//*[contains(@class, 'column') and .//a[contains(@href, '/lawyer/')]]",
    "//*[contains(@class, 'card') and contains(., 'Partner')]",
    "//*[contains(@class, 'item') and .//a[contains(@href, '/lawyer/')]]",
    "//*[contains(., '@') and contains(., 'Partner')]//ancestor::*[2]",
    "//*[contains(., 'J.D.') or contains(., 'University')]//ancestor::*[position()<=3 and @class]",
]
# Attributes a selector suggestion may use, in order.
SUGGEST_ATTRS = ["data-testid", "data-test", "data-cy", "aria-label"]
# Main containers for subpage extraction, first non-empty.
SUBPAGE_MAIN_PATTERNS = [
    ".people.loading",
    ".wp-grid-builder .wpgb-card",
    ".people-list .wp-block-column",
    "[class*='people']",
    ".wpgb-grid-archivePeople > div",
]
# Last-resort layout selectors, accepted above 5 matches.
LAST_RESORT_SELECTORS = [
    ".wp-grid-builder.wpgb-template.wpgb-grid-archivePeople div.wp-block-column",
    ".people-list div.wp-block-column",
    "[class*=\"people\"] div.wp-block-column",
    "[class*=\"grid\"] div.wp-block-column",
    "div.wp-block-column",
]


#: The rule tables that ``page_detection`` asks, by the column they give.
PAGE_RULES = {
    "profile_count": PROFILE_COUNT_SELECTORS,
    "container_count": CONTAINER_COUNT_SELECTORS,
    "load_more_selector": LOAD_MORE_SELECTORS,
    "has_load_more_button": LOAD_MORE_BUTTONS,
    "has_next_link": NEXT_LINK_SELECTORS,
    "is_grid_plugin": GRID_PLUGIN_INDICATORS,
}


def rule_counts(planner: Planner, tables: dict[str, list[str]]) -> DataFrame:
    """``(page_id, rules, prio, rule, n)``: matches of every rule of every table
    on every page where it has some.  Each distinct selector is matched once, all
    in one batched plan; a rule that does not compile is an error."""
    distinct = sorted({sel for rules in tables.values() for sel in rules})
    key = {sel: str(i) for i, sel in enumerate(distinct)}
    matched = planner.select_many([(key[sel], parse_selector(sel)) for sel in distinct])
    n = matched.dropDuplicates(["page_id", "node_id", "key"]).groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("n"))
    # configuration: one row per (table, rule)
    owners = planner.dom.nodes.sparkSession.createDataFrame(
        [(key[sel], name, prio, sel) for name, rules in tables.items() for prio, sel in enumerate(rules)],
        "key string, rules string, prio int, rule string")
    return n.join(owners, "key").drop("key")


def rule_counts_of_pages(pages: DataFrame, tables: dict[str, list[str]]) -> DataFrame:
    """``rule_counts`` in one pass over ``pages``, without a node table."""
    distinct = sorted({sel for rules in tables.values() for sel in rules})
    counts = count_matches(pages, [parse_selector(sel) for sel in distinct])
    owners = F.array(*[F.array(*[F.struct(F.lit(name).alias("rules"), F.lit(rules.index(sel)).alias("prio"))
                                 for name, rules in tables.items() if sel in rules]) for sel in distinct])
    return counts.select("page_id", "n", F.array(*[F.lit(sel) for sel in distinct])[F.col("key")].alias("rule"),
                         F.inline(owners[F.col("key")]))


def _detected(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """The columns of ``PAGE_RULES`` per page, one grouped aggregate."""
    def of(name):
        return F.col("rules") == name

    def some(name):
        return F.coalesce(F.max(F.when(of(name), True)), F.lit(False)).alias(name)

    several = of("container_count") & (F.col("n") > 5)
    first = of("load_more_selector")
    per_page = counts.groupBy("page_id").agg(
        F.max(F.when(of("profile_count"), F.col("n"))).alias("profile_count"),
        F.min_by(F.when(several, F.col("n")), F.when(several, F.col("prio"))).alias("container_count"),
        F.min_by(F.when(first, F.col("rule")), F.when(first, F.col("prio"))).alias("load_more_selector"),
        some("has_load_more_button"), some("has_next_link"), some("is_grid_plugin"))
    return pages.select("page_id").join(per_page, "page_id", "left").fillna(
        0, ["profile_count", "container_count"]).fillna(
        False, ["has_load_more_button", "has_next_link", "is_grid_plugin"])


def profile_count(dom, planner: Planner) -> DataFrame:
    """A1: largest match count over the profile selectors, 0 when none."""
    rules = {k: v for k, v in PAGE_RULES.items() if k == "profile_count"}
    return _detected(dom.docs, rule_counts(planner, rules)).select("page_id", "profile_count")


def container_count(dom, planner: Planner) -> DataFrame:
    """A2: count of the first selector with more than 5 matches, else 0."""
    rules = {k: v for k, v in PAGE_RULES.items() if k == "container_count"}
    return _detected(dom.docs, rule_counts(planner, rules)).select("page_id", "container_count")


def different_content(current: DataFrame, test: DataFrame) -> DataFrame:
    """A3: ``(key, container_count)`` pairs joined on ``key``: the test page
    differs if its count is > 0 and not equal to the current one."""
    return (current.withColumnRenamed("container_count", "current_count")
            .join(test.withColumnRenamed("container_count", "test_count"), "key")
            .withColumn("different", (F.col("test_count") > 0) & (F.col("test_count") != F.col("current_count"))))


def first_rule(dom, planner: Planner, rules: list[str], min_count: int = 1, name: str = "rule") -> DataFrame:
    """``(page_id, <name>, n_matches)`` for the first rule with at least
    ``min_count`` matches on each page (pages without one are absent)."""
    m = planner.select_first(rules, min_count=min_count)
    picked = m.groupBy("page_id", "priority").agg(F.count(F.lit(1)).alias("n_matches"))
    names = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(i), F.lit(r))])
    return picked.select("page_id", names[F.col("priority")].alias(name), "n_matches")


def page_detection(pages: DataFrame) -> DataFrame:
    """A1, A2, W7, W8, W9 for every page: all rules in one pass."""
    return _detected(pages, rule_counts_of_pages(pages, PAGE_RULES)).select("page_id", *PAGE_RULES)


def directory_containers(dom, planner: Planner) -> DataFrame:
    """CSS patterns, then content XPaths; first with >= 3 matches."""
    return first_rule(dom, planner, DIRECTORY_PATTERNS + DIRECTORY_CONTENT_XPATHS, 3, "pattern")


def validate_candidates(dom, candidates: DataFrame, label: str, element_type: str = "text",
                        max_fraction: float = 0.8, by: tuple = ("page_id", "scope_id")) -> DataFrame:
    """Keep the valid candidates of a group (``by``: page and scope, or a
    rung of them) only if 0 < valid <= ``max_fraction`` of its candidates."""
    v = node_values(dom, candidates, "text")
    # the href from the same node rows: the candidate plan is read once
    attrs = dom.nodes.select("page_id", "node_id", F.col("attrs")["href"].alias("href"))
    both = v.join(attrs, ["page_id", "node_id"])
    both = both.withColumn("ok", candidate_is_valid(label, element_type, F.col("value"), F.col("href")))
    # counts by a window on the group: the candidate plan is read once
    w = Window.partitionBy(*by)
    both = both.withColumns({"_n": F.count(F.lit(1)).over(w), "_ok": F.count(F.when(F.col("ok"), 1)).over(w)})
    return both.where(F.col("ok") & (F.col("_ok") <= F.col("_n") * max_fraction)).drop("_n", "_ok")


# What marks a card or profile, first that holds the example and another node of its tag.
SIMILAR_NAME_TAGS = ["strong", "h2", "h3"]
SIMILAR_CONTACT_HREFS, SIMILAR_CONTACT_WORDS = ["mailto", "tel"], ["email", "phone"]
SIMILAR_ROLE_WORDS = ["title", "position", "role"]
SIMILAR_CLASS_WORDS = ["card", "item", "profile", "person", "lawyer", "attorney", "member"]
SIMILAR_TITLE_WORDS = ["partner", "associate", "counsel", "attorney", "lawyer", "director"]
SIMILAR_NAME_PATTERN = r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)+"


def similar_nodes(dom, examples: DataFrame) -> DataFrame:
    """Nodes similar to each example ``(page_id, example_id)``.

    Strategies in order, first with more than one match per example:
    1. same parent and tag, else same tag under parents with all specific (non-generic)
    classes of the example's parent; 2. same tag and at least one shared specific
    class, if 2..99 such nodes; 3. same tag and child-tag sets
    overlapping by more than half; 4. same tag and a pattern of cards: a name, contact or
    role inside, else a word of a card's class; 5. same tag and a job title in the text, else a
    text that starts like a name.  Each runs only
    for the examples that the ones before left open, as an equi-join on
    ``(page_id, parent_id, tag)`` / ``(page_id, class)`` / ``(page_id, tag)`` /
    ``(page_id, tag, pattern)``."""
    n = dom.nodes.select("page_id", "node_id", "parent_id", "tag", "classes", "attrs", "path")
    left = materialize(examples.select("page_id", "example_id").distinct().join(
        n.drop("attrs", "path").withColumnRenamed("node_id", "example_id"), ["page_id", "example_id"]))
    strategies = [(1, _by_parent), (1, _by_parent_class), (2, _by_class), (3, _by_children), (4, _by_pattern),
                  (5, lambda nodes, ex: _by_text(dom, nodes, ex))]
    key, parts = ["page_id", "example_id"], []
    for number, strategy in strategies:
        found = materialize(strategy(n, left).select(*key, "node_id").distinct())
        enough = found.groupBy(*key).count().where("count > 1").select(*key)
        parts.append(found.join(enough, key, "left_semi").withColumn("strategy", F.lit(number)))
        left = materialize(left.join(enough, key, "left_anti"))
        if left.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_parent(n: DataFrame, ex: DataFrame) -> DataFrame:
    return ex.select("page_id", "example_id", "parent_id", "tag").join(n, ["page_id", "parent_id", "tag"])


def _by_class(n: DataFrame, ex: DataFrame, most: int = 99) -> DataFrame:
    """Nodes that share a specific class, for examples with 2 to ``most`` of them."""
    own = ex.select("page_id", "example_id", "tag", F.explode("classes").alias("cls")).where(
        ~is_generic_class(F.col("cls")))
    # counted per class first: a class of very many nodes is dropped before pairs are made
    classes = n.select("page_id", "node_id", "tag", F.explode("classes").alias("cls"))
    size = classes.groupBy("page_id", "tag", "cls").agg(F.countDistinct("node_id").alias("k"))
    wide = own.join(size.where(F.col("k") > most), ["page_id", "tag", "cls"]).select("page_id", "example_id").distinct()
    own = own.join(wide, ["page_id", "example_id"], "left_anti")
    pairs = own.join(classes, ["page_id", "tag", "cls"]).select("page_id", "example_id", "node_id").distinct()
    few = pairs.groupBy("page_id", "example_id").count().where(F.col("count").between(2, most))
    return pairs.join(few, ["page_id", "example_id"], "left_semi")


def _by_children(n: DataFrame, ex: DataFrame) -> DataFrame:
    kids = (n.groupBy("page_id", F.col("parent_id").alias("node_id"))
            .agg(F.sort_array(F.collect_set("tag")).alias("kids")))  # bounded by the number of tag names
    own = ex.select("page_id", "example_id", "tag").join(
        kids.withColumnRenamed("node_id", "example_id"), ["page_id", "example_id"])
    # nodes by their child-tag set: sets are compared, not nodes
    sets = n.select("page_id", "node_id", "tag").join(kids.withColumnRenamed("kids", "nkids"), ["page_id", "node_id"])
    pairs = own.select("page_id", "tag", "kids").distinct().join(
        sets.select("page_id", "tag", "nkids").distinct(), ["page_id", "tag"])
    overlap = F.size(F.array_intersect("kids", "nkids")) / F.greatest(F.size("kids"), F.size("nkids"))
    alike = pairs.where(overlap > 0.5)
    return own.join(alike, ["page_id", "tag", "kids"]).join(sets, ["page_id", "tag", "nkids"])


def _by_parent_class(n: DataFrame, ex: DataFrame) -> DataFrame:
    """Nodes of the example's tag under parents that have all specific classes of its parent."""
    parents = n.select("page_id", F.col("node_id").alias("parent_id"), F.filter(
        "classes", lambda c: ~is_generic_class(c)).alias("pcls")).where(F.size("pcls") > 0)
    own = ex.select("page_id", "example_id", "tag", "parent_id").join(parents, ["page_id", "parent_id"]).select(
        "page_id", "example_id", "tag", F.col("pcls").alias("need"), F.col("pcls")[0].alias("cls"))
    alike = parents.select("page_id", "parent_id", "pcls", F.explode("pcls").alias("cls"))
    alike = own.join(alike, ["page_id", "cls"]).where(F.size(F.array_except("need", "pcls")) == 0)
    return alike.select("page_id", "example_id", "tag", "parent_id").join(
        n.select("page_id", "parent_id", "tag", "node_id"), ["page_id", "parent_id", "tag"])


def _by_first_pattern(held: DataFrame, ex: DataFrame) -> DataFrame:
    """``held(page_id, node_id, tag, pattern)``: the nodes of the first pattern that holds the example
    and another node."""
    size = held.groupBy("page_id", "tag", "pattern").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    own = ex.select("page_id", "example_id", "tag").join(
        held.withColumnRenamed("node_id", "example_id"), ["page_id", "example_id", "tag"])
    first = own.join(size, ["page_id", "tag", "pattern"]).groupBy("page_id", "example_id", "tag").agg(
        F.min("pattern").alias("pattern"))
    return first.join(held, ["page_id", "tag", "pattern"])


def _any_in(column, words: list[str]):
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(column.contains(w), F.lit(False))
    return out


def _by_pattern(n: DataFrame, ex: DataFrame) -> DataFrame:
    n = n.join(ex.select("page_id").distinct(), "page_id", "left_semi")
    cls, href = F.col("attrs")["class"], F.col("attrs")["href"]
    inside = [F.col("tag").isin(SIMILAR_NAME_TAGS) | _any_in(cls, ["name"]),
              ((F.col("tag") == "a") & _any_in(href, SIMILAR_CONTACT_HREFS)) | _any_in(cls, SIMILAR_CONTACT_WORDS),
              _any_in(cls, SIMILAR_ROLE_WORDS)]
    # what a node has inside: its descendants' marks, once per ancestor and mark
    marks = n.select("page_id", "node_id", "path", F.explode(F.array(*[
        F.when(x, F.lit(i)) for i, x in enumerate(inside)])).alias("pattern")).where("pattern IS NOT NULL")
    over = marks.select("page_id", "pattern", F.col("node_id").alias("_from"), F.explode("path").alias("node_id")).where(
        "node_id <> _from").select("page_id", "node_id", "pattern").distinct()
    has = n.select("page_id", "node_id", "tag").join(over, ["page_id", "node_id"])
    own = n.select("page_id", "node_id", "tag", F.explode(F.array(*[
        F.when(_any_in(cls, [w]), F.lit(len(inside) + i)) for i, w in enumerate(SIMILAR_CLASS_WORDS)])).alias("pattern"))
    return _by_first_pattern(has.unionByName(own.where("pattern IS NOT NULL")), ex)


def _by_text(dom, n: DataFrame, ex: DataFrame) -> DataFrame:
    same = n.select("page_id", "node_id", "tag").join(ex.select("page_id", "tag").distinct(), ["page_id", "tag"], "left_semi")
    text = node_values(dom, same.select("page_id", "node_id", F.col("tag").alias("_of")), "text")
    tests = [_any_in(F.lower("value"), SIMILAR_TITLE_WORDS), F.trim("value").rlike(SIMILAR_NAME_PATTERN)]
    held = text.select("page_id", "node_id", F.col("_of").alias("tag"), F.explode(F.array(*[
        F.when(t, F.lit(i)) for i, t in enumerate(tests)])).alias("pattern")).where("pattern IS NOT NULL")
    return _by_first_pattern(held, ex)


def suggest_selectors(dom, targets: DataFrame, max_matches: int = 50) -> DataFrame:
    """A selector for each target ``(page_id, node_id)``: ``#id`` when
    the id is unique on the page; else ``tag.cls...`` over its specific
    classes when that matches fewer than 10 nodes; else a test/aria attribute
    (``tag[attr="v"]``, fewer than ``max_matches`` nodes); else, for links and
    buttons, their text (under 50 characters); else the ``:nth-child`` path from
    the root (always unique)."""
    n = dom.nodes.select("page_id", "node_id", "tag", "elem_id", "classes", "attrs", "ordinal", "path", "short_text")
    t = targets.select("page_id", "node_id").join(n, ["page_id", "node_id"])
    ids = n.where(F.col("elem_id").isNotNull()).groupBy("page_id", "elem_id").count()
    t = t.join(ids.withColumnRenamed("count", "id_count"), ["page_id", "elem_id"], "left")
    t = t.withColumn("spec", F.array_sort(F.filter("classes", lambda c: ~is_generic_class(c))))
    # nodes of the same tag holding all the target's specific classes:
    # equi-join on (page, tag, class), count classes matched per node
    cand = (t.select("page_id", F.col("node_id").alias("target_id"), "tag", F.size("spec").alias("k"),
                     F.explode("spec").alias("cls")))
    nc = n.select("page_id", "node_id", "tag", F.explode("classes").alias("cls"))
    hits = (cand.join(nc, ["page_id", "tag", "cls"]).groupBy("page_id", "target_id", "node_id", "k").count()
            .where(F.col("count") == F.col("k")))
    cls_count = hits.groupBy("page_id", "target_id").agg(F.count(F.lit(1)).alias("cls_count"))
    t = t.join(cls_count.withColumnRenamed("target_id", "node_id"), ["page_id", "node_id"], "left")
    # test / accessibility attributes: tag[attr="v"] when under 50 nodes share it
    attr_rows = []
    for a in SUGGEST_ATTRS:
        attr_rows.append(n.select("page_id", "node_id", "tag", F.lit(a).alias("attr"),
                                  F.col("attrs")[a].alias("aval")).where(F.col("aval").isNotNull()))
    av = attr_rows[0]
    for r in attr_rows[1:]:
        av = av.unionByName(r)
    av_counts = av.groupBy("page_id", "tag", "attr", "aval").agg(F.count(F.lit(1)).alias("acount"))
    tav = (t.select("page_id", "node_id").join(av, ["page_id", "node_id"]).join(av_counts, ["page_id", "tag", "attr", "aval"])
           .where(F.col("acount") < max_matches)
           .groupBy("page_id", "node_id").agg(F.min_by(F.concat(F.col("tag"), F.lit("["), F.col("attr"), F.lit('="'),
                                                                 F.col("aval"), F.lit('"]')),
                                                        F.struct("acount", "attr")).alias("attr_sel")))
    t = t.join(tav, ["page_id", "node_id"], "left")
    # nth-child path: ancestors' (tag, ordinal) in order
    anc = (t.select("page_id", "node_id", F.posexplode("path").alias("pos", "anc_id"))
           .join(n.select("page_id", F.col("node_id").alias("anc_id"), F.col("tag").alias("atag"),
                          F.col("ordinal").alias("aord")), ["page_id", "anc_id"]))
    steps = anc.groupBy("page_id", "node_id").agg(F.array_sort(F.collect_list(F.struct(
        "pos", F.when(F.col("pos") == 0, F.col("atag"))
        .otherwise(F.concat(F.col("atag"), F.lit(":nth-child("), F.col("aord").cast("string"), F.lit(")")))
        .alias("step")))).alias("steps"))
    t = t.join(steps, ["page_id", "node_id"], "left")
    own_step = F.concat(F.col("tag"), F.lit(":nth-child("), F.col("ordinal").cast("string"), F.lit(")"))
    path_sel = F.array_join(F.concat(F.coalesce(F.transform("steps", lambda s: s["step"]), F.array()),
                                     F.array(own_step)), " > ")
    text = F.trim(F.coalesce("short_text", F.lit("")))
    by_text = F.when(F.col("tag").isin("a", "button") & F.length(text).between(1, 49) & ~text.contains('"'),
                     F.concat("tag", F.lit(':contains("'), text, F.lit('")')))
    cls_sel = F.concat(F.col("tag"), F.array_join(F.transform("spec", lambda c: F.concat(F.lit("."), c)), ""))
    return t.select(
        "page_id", "node_id",
        F.when(F.col("id_count") == 1, F.concat(F.lit("#"), F.col("elem_id")))
        .when((F.col("cls_count") > 0) & (F.col("cls_count") < 10) & (F.col("cls_count") < max_matches), cls_sel)
        .when(F.col("attr_sel").isNotNull(), F.col("attr_sel"))
        .when(by_text.isNotNull(), by_text)
        .otherwise(path_sel).alias("selector"))


def suggest_relative(dom, targets: DataFrame) -> DataFrame:
    """E22 inside a container: a selector for each target ``(page_id,
    container_id, node_id)`` that hits it alone among the container's nodes:
    ``tag.class`` over one specific class, else the tag, else the ``:nth-child``
    path that starts below the container."""
    n = dom.nodes.select("page_id", "node_id", "tag", "classes", "ordinal", "path")
    key = ["page_id", "container_id"]
    t = materialize(targets.select(*key, "node_id").distinct().join(n, ["page_id", "node_id"]))
    inside = n.select("page_id", "node_id", "tag", "classes", F.explode("path").alias("container_id")).join(
        t.select(*key).distinct(), key)
    tags = inside.groupBy(*key, "tag").agg(F.count(F.lit(1)).alias("tag_n"))
    classes = inside.select(*key, "tag", F.explode("classes").alias("cls")).groupBy(*key, "tag", "cls").agg(
        F.count(F.lit(1)).alias("cls_n"))
    own = t.select(*key, "node_id", "tag", F.explode("classes").alias("cls")).where(~is_generic_class(F.col("cls")))
    alone = own.join(classes.where("cls_n = 1"), [*key, "tag", "cls"]).groupBy(*key, "node_id").agg(
        F.min("cls").alias("cls"))
    # the steps below the container: its place in the target's ancestors, and what follows
    below = F.slice("path", F.array_position("path", F.col("container_id")).cast("int") + 1, F.size("path"))
    anc = t.select(*key, "node_id", F.posexplode(F.concat(below, F.array("node_id"))).alias("pos", "step_id"))
    steps = anc.join(n.select("page_id", F.col("node_id").alias("step_id"), F.col("tag").alias("stag"),
                              F.col("ordinal").alias("sord")), ["page_id", "step_id"])
    step = F.concat(F.col("stag"), F.lit(":nth-child("), F.col("sord").cast("string"), F.lit(")"))
    paths = steps.groupBy(*key, "node_id").agg(F.concat(F.lit("> "), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", step.alias("s")))), lambda x: x["s"]), " > ")).alias("path_sel"))
    out = t.join(tags, [*key, "tag"]).join(alone, [*key, "node_id"], "left").join(paths, [*key, "node_id"])
    return out.select(*key, "node_id", F.when(F.col("cls").isNotNull(), F.concat("tag", F.lit("."), "cls")).when(
        F.col("tag_n") == 1, F.col("tag")).otherwise(F.col("path_sel")).alias("selector"))


def suggest_xpath(dom, targets: DataFrame) -> DataFrame:
    """E22 as XPath: the positional path from the root of each target ``(page_id, node_id)``."""
    n = dom.nodes.select("page_id", "node_id", "tag", "type_ordinal", "path")
    t = targets.select("page_id", "node_id").distinct().join(n.select("page_id", "node_id", "path"), ["page_id", "node_id"])
    anc = t.select("page_id", "node_id", F.posexplode(F.concat("path", F.array("node_id"))).alias("pos", "step_id"))
    steps = anc.join(n.select("page_id", F.col("node_id").alias("step_id"), "tag", "type_ordinal"), ["page_id", "step_id"])
    step = F.concat(F.lit("/"), "tag", F.lit("["), F.col("type_ordinal").cast("string"), F.lit("]"))
    return steps.groupBy("page_id", "node_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", step.alias("s")))), lambda x: x["s"]), "").alias("xpath"))


def directory_context(dom, planner: Planner, examples: DataFrame) -> DataFrame:
    """Directory URL, else at least 3 similar nodes to the example."""
    # only examples off directory URLs need the similarity search
    here = materialize(examples.join(dom.docs.select("page_id", "url"), "page_id"))
    open_ = here.where(~F.coalesce(is_directory_url(F.col("url")), F.lit(False))).select("page_id", "example_id")
    sim = similar_nodes(dom, open_).groupBy("page_id", "example_id").count()
    return (here.join(sim, ["page_id", "example_id"], "left")
            .select("page_id", "example_id",
                    (is_directory_url(F.col("url")) | (F.coalesce(F.col("count"), F.lit(0)) >= 3))
                    .alias("is_directory_context")))
