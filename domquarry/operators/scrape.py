"""The full scrape job over many templates and pages.

``scrape(dom, planner, templates)`` runs every template on the page its URL
names (or on a batch of URLs, S8), walks the listing where the template
paginates (W1/W3/W4, U1), extracts page-level elements through the fallback
ladder (E6), builds a record per container (C1, C5, C6, P9, P13), follows the
records' links and overlays what their pages say (J1, J3, J11), merges related
lists (J4), and returns one row per (template, url):

``template_name, url, scraped_at, success, data MAP<STRING, ARRAY<STRING>>,
records ARRAY<STRUCT<container, index, source_page, fields MAP<STRING,
ARRAY<STRING>>, error>>, errors ARRAY<STRING>, metadata
STRUCT<elements_found, actions_executed, page_title, final_url>``

``scrape_tables`` gives the same as two tables, the records with a row each: a crawl
with a large share of all records never meets in one row there.

A selector (of an element, a container or a pagination control) that cannot be
planned gives ``Unsupported selector: ...`` among the result's errors.

Selectors are collected from the templates only (configuration): thousands of
templates share one batched plan per distinct selector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import strip_fragment
from ..plans.ast import SelectorError
from ..plans.compile import Planner, chain_output, check_compiles, parse_selector
from ..session import materialize
from .containers import MULTI_VALUE_WORDS, PROFILE_LINK_WORDS
from .extract import LOCATION_CITIES
from .detect import similar_nodes
from .fallback import container_rungs, resolve_sub_element, select_with_fallback, sub_element_ladder
from .merge import merge_related
from .paginate import crawl_pages
from .subpages import eligible_links, follow_links, page_lookup, subpage_values
from .values import keyed_values, node_values, page_title

RESULT_COLUMNS = ["template_name", "url", "scraped_at", "success", "data", "records", "errors", "metadata"]
RECORD_FIELDS = {"container": "string", "index": "int", "source_page": "int", "fields": "map<string,array<string>>",
                 "error": "string"}
RECORD_TYPE = f"array<struct<{','.join(f'{k}:{t}' for k, t in RECORD_FIELDS.items())}>>"
_FIELD_SCHEMA = ("crawl_id bigint, list_label string, record_index int, key string, value_ord int, value string")


def _is_location(label: F.Column, selector: F.Column) -> F.Column:
    label, selector = F.coalesce(label, F.lit("")), F.coalesce(selector, F.lit(""))
    lab = F.lower(label)
    out = lab.contains("location") | lab.contains("city") | F.lower(selector).contains("normalize-space")
    for c in LOCATION_CITIES:
        out = out | selector.contains(c)
    return out


def _has_word(column: F.Column, words: list[str]) -> F.Column:
    out = F.lit(False)
    for w in words:
        out = out | F.lower(column).contains(w)
    return out


def _parsed(selector: str | None, selector_type: str | None, relative: bool):
    """The compiled selector, or None where the grammar does not hold it."""
    try:
        sel = parse_selector(selector or "", selector_type or "css", relative=relative)
        check_compiles(sel)
        return sel
    except SelectorError:
        return None


def template_keys(templates: DataFrame) -> DataFrame:
    """``templates`` with template_id (equal templates share one, equal names do not)."""
    content = F.to_json(F.struct("elements", "actions", "pagination", "subpage_url_pattern", "max_subpages"))
    return templates.withColumn("template_id", F.xxhash64("name", "url", content)).dropDuplicates(["template_id"])


def scrape(dom, planner: Planner, templates: DataFrame, urls: DataFrame | None = None,
           smart: bool = True) -> DataFrame:
    """Run templates (``TEMPLATE_SCHEMA`` rows, defaults filled) on ``dom``.

    ``urls(template_name, url)`` overrides the template URL (S8 batch: one
    result per row, also where a URL is asked twice; with a column ``position`` the
    results carry it).  URLs are compared without their fragment; of
    several page rows of one URL the lowest page_id counts.  A URL without a
    page, or whose page has no html, gives ``success = false`` and the error
    ``Failed to fetch page``.  ``smart`` turns the fallback ladders on."""
    results, records = scrape_tables(dom, planner, templates, urls, smart)
    record = F.struct(*[F.col(c) for c in RECORD_FIELDS])
    ordered = F.array_sort(F.collect_list(F.struct("list_order", "index", F.to_json(record).alias("r"))))
    folded = records.groupBy("crawl_id").agg(F.transform(
        ordered, lambda s: F.from_json(s["r"], RECORD_TYPE[6:-1])).alias("records"))
    out = results.join(folded, "crawl_id", "left").withColumn(
        "records", F.coalesce("records", F.array().cast(RECORD_TYPE)))
    return out.select(*(["position"] if "position" in results.columns else []), *RESULT_COLUMNS)


def scrape_tables(dom, planner: Planner, templates: DataFrame, urls: DataFrame | None = None,
                  smart: bool = True) -> tuple[DataFrame, DataFrame]:
    """What ``scrape`` gives as ``results(crawl_id, ...)`` without records and ``records(crawl_id,
    list_order, container, index, source_page, fields, error)``, a row per record."""
    tmpl = materialize(template_keys(templates))
    named = tmpl.select("template_id", F.col("name").alias("template_name"), "url")
    if urls is not None:
        named = named.drop("url").join(urls.select("template_name", "url").distinct(), "template_name")
    crawls = named.distinct().withColumn("crawl_id", F.xxhash64("template_id", "url"))
    start = materialize(crawls.withColumn("_link", strip_fragment(F.col("url"))).join(
        page_lookup(dom), "_link", "left").drop("_link"))
    walked = materialize(crawl_pages(dom, planner, tmpl, start))

    els = tmpl.select("template_id", F.posexplode("elements").alias("el_pos", "e")).select(
        "template_id", "el_pos", "e.*")
    data, missing = _page_elements(dom, planner, els.where(~F.col("is_container")), walked, smart)
    records = materialize(_records(dom, planner, tmpl, els.where("is_container"), walked, smart))
    n_records = records.groupBy("crawl_id").agg(F.countDistinct("container").cast("int").alias("n_containers"))

    problems = missing.unionByName(_unsupported(tmpl, els, walked))
    errors = problems.groupBy("crawl_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("el_pos", "error"))), lambda s: s["error"]).alias("errors"))
    n_actions = tmpl.select("template_id", F.size("actions").alias("actions_executed"))
    out = (start.join(data, "crawl_id", "left").join(n_records, "crawl_id", "left").join(errors, "crawl_id", "left")
           .join(page_title(dom, planner), "page_id", "left").join(n_actions, "template_id"))
    fetch_err = F.when(F.col("page_id").isNull(), F.array(F.concat(F.lit("Failed to fetch page: "), F.col("url"))))
    errs = F.coalesce(fetch_err, F.col("errors"), F.array().cast("array<string>"))
    n_found = F.coalesce(F.col("n_found"), F.lit(0)) + F.coalesce(F.col("n_containers"), F.lit(0))
    results = out.select(
        "crawl_id", "template_name", "url", F.current_timestamp().alias("scraped_at"), (F.size(errs) == 0).alias("success"),
        F.coalesce(F.col("data"), F.create_map().cast("map<string,array<string>>")).alias("data"), errs.alias("errors"),
        F.struct(n_found.cast("int").alias("elements_found"), F.col("actions_executed"),
                 F.col("page_title"), F.col("url").alias("final_url")).alias("metadata"))
    if urls is not None:  # a result for every row that asks
        results = results.join(urls.select("template_name", "url", *[c for c in ("position",) if c in urls.columns]),
                               ["template_name", "url"])
    return results, records


def _unsupported(tmpl: DataFrame, els: DataFrame, walked: DataFrame) -> DataFrame:
    """(crawl_id, el_pos, error) for selectors of elements, containers and pagination controls that cannot be planned."""
    controls = tmpl.select("template_id", F.explode(F.array(*[
        F.col(f"pagination.{c}") for c in ("next_selector", "load_more_selector", "end_condition_selector")])).alias("selector"))
    asked = els.select("template_id", "el_pos", "selector", "selector_type").unionByName(controls.select(
        "template_id", F.lit(1 << 30).alias("el_pos"), "selector", F.lit("css").alias("selector_type")))
    asked = asked.where(F.coalesce(F.trim("selector"), F.lit("")) != "").distinct()
    # template configuration
    bad = [(s, t) for s, t in asked.select("selector", "selector_type").distinct().collect() if not _parsed(s, t, False)]
    known = tmpl.sparkSession.createDataFrame(bad, "selector string, selector_type string")
    return walked.where("page_no = 1").join(asked.join(known, ["selector", "selector_type"]), "template_id").select(
        "crawl_id", "el_pos", F.concat(F.lit("Unsupported selector: "), "selector").alias("error"))


def _page_elements(dom, planner: Planner, simple: DataFrame, walked: DataFrame,
                   smart: bool) -> tuple[DataFrame, DataFrame]:
    """(crawl_id, data, n_found) and the required elements without a value
    (crawl_id, el_pos, error).  Of two elements of one label the later one counts."""
    spark = dom.nodes.sparkSession
    fields = ["label", "selector", "selector_type", "element_type", "attribute_name"]
    rows = simple.select(*fields).distinct().collect()  # template configuration
    specs, readers = [], {}
    for i, r in enumerate(rows):
        sel = _parsed(r["selector"], r["selector_type"], False)
        specs.append((f"s{i}", r.asDict(), sel))
        output, attr = chain_output(sel) if sel else ("node", None)
        readers[f"s{i}"] = {"element_type": r["element_type"], "attribute_name": r["attribute_name"],
                            "output": output, "attr_name": attr}
    empty_map = "crawl_id bigint, data map<string,array<string>>, n_found int"
    if not specs:
        return spark.createDataFrame([], empty_map), spark.createDataFrame([], "crawl_id bigint, el_pos int, error string")
    keys = spark.createDataFrame([(k, *[e[f] for f in fields]) for k, e, _ in specs],
                                 "key string, " + ", ".join(f"{f} string" for f in fields))
    on = [F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")) for f in fields]
    asked = simple.alias("a").join(keys.alias("b"), on).select(
        "a.template_id", "a.el_pos", "a.label", "a.selector", "a.is_multiple", "a.is_required", "b.key")
    runs = walked.join(asked, "template_id")
    matched = select_with_fallback(dom, planner, specs, runs.select("page_id", "key").distinct(), smart)
    v = keyed_values(dom, matched, readers).where(F.col("value").isNotNull())
    w = Window.partitionBy("page_id", "key").orderBy("node_id")
    v = v.withColumn("value_ord", F.row_number().over(w)).select("page_id", "key", "value_ord", "value")
    v = materialize(runs.join(v, ["page_id", "key"]).where(F.col("is_multiple") | (F.col("value_ord") == 1)))

    last = asked.groupBy("template_id", "label").agg(F.max("el_pos").alias("el_pos"))
    own = v.join(last, ["template_id", "label", "el_pos"], "left_semi")
    # Lists of later pages are appended, a scalar is the first page's
    first = own.where(~F.col("is_multiple")).groupBy("crawl_id", "label").agg(
        F.min(F.struct("page_no", "value_ord")).alias("_first"))
    own = own.join(first, ["crawl_id", "label"], "left").where(F.col("is_multiple") | (
        F.struct("page_no", "value_ord") == F.col("_first")))
    per_label = own.groupBy("crawl_id", "label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("page_no", "value_ord", "value"))), lambda s: s["value"]).alias("v"))
    data = per_label.groupBy("crawl_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "v")))).alias("data"),
        F.count(F.lit(1)).cast("int").alias("n_found"))

    need = asked.where(F.col("is_required") & ~_is_location(F.col("label"), F.col("selector")))
    missing = (walked.where("page_no = 1").join(need, "template_id")
               .join(v.select("crawl_id", "page_no", "el_pos"), ["crawl_id", "page_no", "el_pos"], "left_anti")
               .select("crawl_id", "el_pos", F.concat(
                   F.lit("Failed to extract "), "label", F.lit(": Required element not found: "),
                   F.coalesce("selector", F.lit(""))).alias("error")))
    return data, missing


def _container_nodes(dom, planner: Planner, conts: DataFrame, walked: DataFrame, smart: bool) -> DataFrame:
    """The nodes of every container element on every walked page: its selector's, else (C2) those of
    the first rung of its ladder with enough; with ``use_find_similar`` the nodes similar to the first (E21)."""
    spec_columns = ["selector", "selector_type", "use_find_similar"]
    rows = conts.select(*spec_columns).distinct().collect()  # template configuration
    keys = dom.nodes.sparkSession.createDataFrame([(f"c{i}", *r) for i, r in enumerate(rows)],
                                                  "key string, selector string, selector_type string, use_find_similar boolean")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in spec_columns]
    owners = conts.alias("a").join(keys.alias("b"), same).select(
        "a.template_id", "a.el_pos", "a.label", "a.sub_elements", "b.key")
    owned = materialize(walked.select("template_id", "crawl_id", "page_id", "page_no").join(owners, "template_id"))
    specs = [(f"c{i}", r.asDict(), _parsed(r["selector"], r["selector_type"], False)) for i, r in enumerate(rows)]
    found = select_with_fallback(dom, planner, specs, owned.select("page_id", "key").distinct(), smart, container_rungs)
    found = found.select("page_id", "key", "node_id").distinct()
    similar = [f"c{i}" for i, r in enumerate(rows) if r["use_find_similar"]]
    if similar:
        found = materialize(found)
        first = found.where(F.col("key").isin(similar)).groupBy("page_id", "key").agg(F.min("node_id").alias("example_id"))
        alike = similar_nodes(dom, first.select("page_id", "example_id")).select("page_id", "example_id", "node_id")
        # lists of one page and selector: those alike where there are any, else its own
        alike = first.join(alike, ["page_id", "example_id"]).groupBy("page_id", "key").agg(F.collect_set("node_id").alias("_alike"))
        own = found.groupBy("page_id", "key").agg(F.collect_list("node_id").alias("_own"))
        found = materialize(own.join(materialize(alike), ["page_id", "key"], "left").select(
            "page_id", "key", F.explode(F.coalesce("_alike", "_own")).alias("node_id")))
    return found.join(owned, ["page_id", "key"])


def _records(dom, planner: Planner, tmpl: DataFrame, conts: DataFrame, walked: DataFrame, smart: bool) -> DataFrame:
    """crawl_id, list_order, container, index, source_page, fields, error: every matched container is
    a record, also one without a field (it gets its text, C5) or with a sub-element that
    cannot be matched (its ``error`` says so, C6)."""
    if conts.isEmpty():
        return dom.nodes.sparkSession.createDataFrame(
            [], f"crawl_id bigint, list_order int, {', '.join(f'{k} {t}' for k, t in RECORD_FIELDS.items())}")
    cm = materialize(_container_nodes(dom, planner, conts, walked, smart))
    # records of a list are numbered over all walked pages, in page order: inside each page, after the
    # records of the pages before (a row per page)
    per_page = cm.groupBy("crawl_id", "el_pos", "page_no").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("crawl_id", "el_pos").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    per_page = per_page.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    w = Window.partitionBy("crawl_id", "el_pos", "page_no").orderBy("node_id")
    cards = cm.withColumn("_k", F.row_number().over(w) - 1).join(per_page, ["crawl_id", "el_pos", "page_no"])
    cards = materialize(cards.select(
        "template_id", "crawl_id", "page_id", "page_no", F.col("node_id").alias("container_id"), "el_pos",
        F.col("label").alias("list_label"), (F.col("_before") + F.col("_k")).cast("int").alias("record_index"), "sub_elements"))
    fields, failed = _container_fields(dom, planner, cards, smart)
    fields = materialize(fields)
    fields = materialize(_with_subpages(dom, planner, tmpl, conts, cards, fields))

    # No field at all -> the container's text
    bare = cards.join(fields.select("crawl_id", "list_label", "record_index").distinct(),
                      ["crawl_id", "list_label", "record_index"], "left_anti")
    text = node_values(dom, bare.select("page_id", F.col("container_id").alias("node_id"), "crawl_id", "list_label",
                                        "record_index"), "text")
    fields = fields.unionByName(text.select("crawl_id", "list_label", "record_index", F.lit("text").alias("key"),
                                            F.lit(1).alias("value_ord"), "value"))
    lists = materialize(_merged_lists(dom, planner, conts, cards, materialize(fields)))
    per_key = lists.groupBy("crawl_id", "list_label", "list_order", "record_index", "key").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("value_ord", "value"))), lambda s: s["value"]).alias("v"))
    maps = per_key.groupBy("crawl_id", "list_label", "list_order", "record_index").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("key", "v")))).alias("fields"))
    pages = cards.select("crawl_id", "list_label", "record_index", F.col("page_no").alias("source_page"), "container_id")
    rows = maps.join(pages, ["crawl_id", "list_label", "record_index"]).join(
        failed, ["crawl_id", "list_label", "record_index"], "left")
    return rows.select("crawl_id", "list_order", F.col("list_label").alias("container"), F.col("record_index").alias("index"),
                       F.col("source_page").cast("int").alias("source_page"), "fields", "error")


def _container_fields(dom, planner: Planner, cards: DataFrame, smart: bool) -> tuple[DataFrame, DataFrame]:
    """Field values per record, and the records with sub-elements that cannot be
    matched (error).  ``smart``: a sub-element without a value goes through its
    label's selectors and the validated fallback rules (C3: E14, E15, E16)."""
    spark = dom.nodes.sparkSession
    subs = cards.select("crawl_id", "page_id", "container_id", "list_label", "record_index",
                        F.posexplode("sub_elements").alias("sub_pos", "s")).select(
        "*", F.col("s.label").alias("sub_label"), F.trim(F.coalesce("s.selector", F.lit(""))).alias("sub_selector"),
        F.col("s.element_type").alias("sub_type"), F.col("s.attribute_name").alias("sub_attr")).drop("s")
    subs = materialize(subs)
    # distinct sub selectors come from the template rows that own a matched container
    rows = subs.select("sub_selector", "sub_type", "sub_attr").distinct().collect()
    parsed = {sel: _parsed(sel, "css", True) for sel in {r[0] for r in rows} if sel}
    key_of = {sel: f"u{i}" for i, sel in enumerate(sorted(s for s, p in parsed.items() if p))}
    bad = sorted(s for s, p in parsed.items() if not p)
    scope = cards.select("page_id", F.col("container_id").alias("scope_id")).distinct()
    # An empty selector is the container itself
    own = scope.select("page_id", "scope_id", F.col("scope_id").alias("node_id"), F.lit("").alias("sub_selector"))
    if key_of:
        keys = spark.createDataFrame([(k, s) for s, k in key_of.items()], "key string, sub_selector string")
        found = planner.select_many([(k, parsed[s]) for s, k in key_of.items()], scope=scope).join(keys, "key")
        own = own.unionByName(found.select("page_id", "scope_id", "node_id", "sub_selector"))
    j = subs.join(own.withColumnRenamed("scope_id", "container_id"), ["page_id", "container_id", "sub_selector"])
    readers = {}
    for sel, kind, attr in rows:
        if sel in bad:
            continue
        output, name = chain_output(parsed[sel]) if sel else ("node", None)
        readers[f"{key_of.get(sel, '')}|{kind}|{attr or ''}"] = {
            "element_type": kind, "attribute_name": attr, "output": output, "attr_name": name, "resolve_links": True}
    names = spark.createDataFrame([(s, k) for s, k in [("", ""), *key_of.items()]], "sub_selector string, _k string")
    j = j.join(names, "sub_selector").withColumn("key", F.concat_ws(
        "|", "_k", "sub_type", F.coalesce("sub_attr", F.lit(""))))
    v = keyed_values(dom, j, readers).where(F.col("value").isNotNull()) if readers else j.withColumn(
        "value", F.lit(None).cast("string")).limit(0)
    multi = _has_word(F.col("sub_label"), MULTI_VALUE_WORDS)
    w = Window.partitionBy("crawl_id", "list_label", "record_index", "sub_label").orderBy("sub_pos", "node_id")
    v = v.where(~(multi & (F.col("value") == ""))).withColumn("value_ord", F.row_number().over(w))
    fields = v.where(multi | (F.col("value_ord") == 1)).select(
        "crawl_id", "list_label", "record_index", F.col("sub_label").alias("key"), "value_ord", "value")
    if smart:
        fields = materialize(fields)
        fields = fields.unionByName(_by_label(dom, planner, subs, fields))
    failed = subs.where(F.col("sub_selector").isin(bad)) if bad else subs.limit(0)
    failed = failed.groupBy("crawl_id", "list_label", "record_index").agg(F.concat(
        F.lit("Unsupported selector: "), F.array_join(F.array_sort(F.collect_set("sub_selector")), ", ")).alias("error"))
    return fields, failed


def _by_label(dom, planner: Planner, subs: DataFrame, fields: DataFrame) -> DataFrame:
    """C3 for sub-elements that their own selector left without a value: the first
    value that the label's rules give inside the container."""
    key = ["crawl_id", "list_label", "record_index"]
    out = fields.limit(0)
    have = fields.withColumnRenamed("key", "sub_label").select(*key, "sub_label").distinct()
    todo = materialize(subs.where("sub_selector <> ''").join(have, [*key, "sub_label"], "left_anti"))
    # template configuration: one row per distinct sub-element
    for label, selector, kind, attr in todo.select("sub_label", "sub_selector", "sub_type", "sub_attr").distinct().collect():
        sub = {"label": label, "selector": selector, "element_type": kind}
        if not [a for a in sub_element_ladder(sub) if a != selector]:
            continue
        own = todo.where((F.col("sub_label") == label) & (F.col("sub_selector") == selector) & (F.col("sub_type") == kind)
                         & F.col("sub_attr").eqNullSafe(F.lit(attr)))
        found = resolve_sub_element(dom, planner, own.select("page_id", "container_id").distinct(), sub)
        values = node_values(dom, found.select("page_id", F.col("scope_id").alias("container_id"), "node_id"), kind, attr,
                             resolve_links=True)
        first = values.where("value <> ''").groupBy("page_id", "container_id").agg(
            F.min_by("value", "node_id").alias("value"))
        out = out.unionByName(own.join(first, ["page_id", "container_id"]).select(
            *key, F.lit(label).alias("key"), F.lit(1).alias("value_ord"), "value"))
    return out


def _with_subpages(dom, planner: Planner, tmpl: DataFrame, conts: DataFrame, cards: DataFrame,
                   fields: DataFrame) -> DataFrame:
    """The pages that records link to, their elements over the records' fields."""
    wanted = tmpl.where("enable_subpage_scraping").select("template_id", "subpage_url_pattern", "max_subpages")
    subs = conts.join(wanted.select("template_id"), "template_id", "left_semi").where(
        F.coalesce("follow_links", F.lit(True))).select(
        "template_id", "label", F.explode("subpage_elements").alias("s")).select(
        "template_id", F.col("label").alias("list_label"), "s.label", "s.selector")
    rows = subs.select("label", "selector").distinct().collect()  # template configuration
    if not rows:
        return fields
    follows = F.coalesce("follow_links", F.lit(True))  # unsaid: the template's enable_subpage_scraping decides
    asking = conts.where(follows & (F.size("subpage_elements") > 0)).select("template_id", "el_pos", "follow_links")
    links = profile_links(dom, planner, cards.join(asking, ["template_id", "el_pos"]), fields)
    links = links.withColumnRenamed("profile_link", "url")
    queue = cards.join(wanted, "template_id").join(links, ["crawl_id", "list_label", "record_index"]).select(
        "template_id", "crawl_id", "list_label", "record_index", "url", "subpage_url_pattern", "max_subpages")
    linked = materialize(follow_links(eligible_links(queue, order=("record_index", "url")), dom.docs, "url").where(
        "subpage_id IS NOT NULL"))
    elements = [{"label": f"{i}", "selector": r["selector"]} for i, r in enumerate(rows)]
    names = dom.nodes.sparkSession.createDataFrame(
        [(str(i), r["label"], r["selector"]) for i, r in enumerate(rows)], "_e string, label string, selector string")
    values = subpage_values(dom, planner, linked, elements, map_selectors=False).withColumnRenamed("label", "_e")
    own = linked.select("template_id", "crawl_id", "list_label", "record_index", "subpage_id").join(
        subs, ["template_id", "list_label"])
    new = own.join(names, (own["label"] == names["label"]) & own["selector"].eqNullSafe(names["selector"])).select(
        own["crawl_id"], own["list_label"], own["record_index"], own["subpage_id"], own["label"].alias("key"), "_e")
    drop = new.select("crawl_id", "list_label", "record_index", "key").distinct()
    kept = fields.join(drop, ["crawl_id", "list_label", "record_index", "key"], "left_anti")
    return kept.unionByName(new.join(values, ["subpage_id", "_e"]).select(
        "crawl_id", "list_label", "record_index", "key", "value_ord", "value"))


def profile_links(dom, planner: Planner, cards: DataFrame, fields: DataFrame, marker: str | None = "/lawyer/") -> DataFrame:
    """C4: (crawl_id, list_label, record_index, profile_link): the last link sub-element with a value
    whose label has profile/link/url/page; else, where the element's ``follow_links`` is set, the first
    link sub-element with a value; else the first ``a`` of the container whose href holds ``marker``."""
    key = ["crawl_id", "list_label", "record_index"]
    subs = cards.select(*key, "follow_links", F.posexplode("sub_elements").alias("sub", "s")).where("s.element_type = 'link'")
    subs = subs.select(*key, "follow_links", "sub", F.col("s.label").alias("key"))
    named = _has_word(F.col("key"), PROFILE_LINK_WORDS)
    values = fields.where(F.col("value").startswith("http")).groupBy(*key, "key").agg(
        F.min_by("value", "value_ord").alias("value"))
    hits = subs.join(values, [*key, "key"]).where(named | F.coalesce("follow_links", F.lit(False))).select(
        *key, F.when(named, 0).otherwise(1).alias("rank"), F.when(named, -F.col("sub")).otherwise(F.col("sub")).alias("at"), "value")
    if marker:
        hits = materialize(hits)
        bare = cards.join(hits.select(*key).distinct(), key, "left_anti")
        found = planner.select(f"a[href*='{marker}']", scope=bare.select(
            "page_id", F.col("container_id").alias("scope_id")).distinct())
        found = node_values(dom, found, "link", resolve_links=True).withColumnRenamed("scope_id", "container_id")
        hits = hits.unionByName(bare.select(*key, "page_id", "container_id").join(found, ["page_id", "container_id"]).select(
            *key, F.lit(2).alias("rank"), F.col("node_id").alias("at"), "value"))
    return hits.groupBy(*key).agg(F.min_by("value", F.struct("rank", "at")).alias("profile_link"))


def _merged_lists(dom, planner: Planner, conts: DataFrame, cards: DataFrame, fields: DataFrame) -> DataFrame:
    """Lists of one crawl merged where one is a main list and one a subpage list."""
    order = cards.groupBy("crawl_id", "list_label").agg(F.min("el_pos").alias("list_order"))
    said = conts.select("template_id", "el_pos", "follow_links")
    link = profile_links(dom, planner, cards.join(said, ["template_id", "el_pos"]), fields, None)
    lists = fields.join(order, ["crawl_id", "list_label"]).join(
        link, ["crawl_id", "list_label", "record_index"], "left").withColumn(
        "profile_link", F.coalesce("profile_link", F.lit(""))).withColumnRenamed("crawl_id", "page_id")
    # read from many branches below
    return merge_related(materialize(lists)).withColumnRenamed("page_id", "crawl_id")


def item_totals(results: DataFrame) -> DataFrame:
    """Per result, list lengths summed over labels (scalars count 1)."""
    return results.select("template_name", "url", (F.aggregate(
        F.map_values("data"), F.lit(0), lambda acc, v: acc + F.size(v)) + F.size("records")).alias("items"))


def _numbered(prefix: F.Column, values: F.Column) -> F.Column:
    """Columns of a list: one value is ``prefix``, several are ``prefix_1 .. prefix_n``, none is ``prefix = ''``."""
    many = F.transform(values, lambda v, i: F.struct(
        F.concat(prefix, F.lit("_"), (i + 1).cast("string")).alias("column"), v.alias("value")))
    one = F.array(F.struct(prefix.alias("column"), F.coalesce(F.get(values, 0), F.lit("")).alias("value")))
    return F.when(F.size(values) > 1, many).otherwise(one)


def flatten(results: DataFrame) -> DataFrame:
    """P14 per result, long form: ``(template_name, url, column, value)``.

    A list of one value gives ``label``; a list of n gives ``label_1 ..
    label_n``; an empty list gives ``label = ''``; container records give
    ``<container>_<i>_<field>`` (i from 1, several values of a field numbered
    the same way) and ``<container>_<i>_error``; ``actions_executed`` is dropped."""
    d = results.select("template_name", "url", F.explode("data").alias("label", "vs")).where(
        F.col("label") != "actions_executed")
    pairs = d.select("template_name", "url", F.inline(_numbered(F.col("label"), F.col("vs"))))
    r = results.select("template_name", "url", F.explode("records").alias("r"))
    stem = F.concat(F.col("r.container"), F.lit("_"), (F.col("r.index") + 1).cast("string"), F.lit("_"))
    f = r.select("template_name", "url", stem.alias("stem"), F.explode("r.fields").alias("field", "vs"))
    fields = f.select("template_name", "url", F.inline(_numbered(F.concat("stem", "field"), F.col("vs"))))
    failed = r.where("r.error IS NOT NULL").select(
        "template_name", "url", F.concat(stem, F.lit("error")).alias("column"), F.col("r.error").alias("value"))
    return pairs.unionByName(fields).unionByName(failed)
