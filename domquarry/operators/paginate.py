"""Pagination as window / aggregate work.

The reference walks pages one at a time and stops on streaks.  Here the walk
is computed declaratively over all pages of a crawl at once:

* items are first reduced to ``first_seen(crawl, item) = min(page_no)`` -- a
  grouped aggregate, combined map-side, so a hot crawl never lands whole in
  one task;
* only page-level rows (one per page: "did it bring something new?") go
  through the per-crawl window that finds the stop page.

Inputs are long tables: ``items(crawl_id, page_no, item[, idx])`` and
``pages(crawl_id, page_no)`` (pages that exist, with or without items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..functions.urls import query_param_number, set_query_param, without_query_param

# Streaks that end a walk.  How many pages a walk may take is a
# parameter of each function (``max_pages``); by default there is no limit.
URL_EMPTY_STREAK = 3
LOAD_MORE_FAILURES = 3
GRID_EMPTY_STREAK = 5
AUTO_SCROLL_STABLE = 3
# URL pagination parameters, tried in this order.
URL_PATTERNS = [
    {"param": "offset", "step": 20, "start": 0},
    {"param": "page", "step": 1, "start": 1},
    {"param": "skip", "step": 20, "start": 0},
    {"param": "start", "step": 20, "start": 0},
    {"param": "from", "step": 20, "start": 0},
]


def first_seen(items: DataFrame, crawl: str = "crawl_id") -> DataFrame:
    """U2 core: the first page (and position on it) where each item appears."""
    key = F.struct("page_no", F.coalesce(F.col("idx"), F.lit(0)).alias("idx")) if "idx" in items.columns \
        else F.struct("page_no", F.lit(0).alias("idx"))
    return (items.groupBy(crawl, "item").agg(F.min(key).alias("first"))
            .select(crawl, "item", F.col("first.page_no").alias("first_page"), F.col("first.idx").alias("first_idx")))


def _walk_bounds(pages: DataFrame, crawl: str) -> DataFrame:
    """Per crawl: ``start`` (first page) and ``gap`` (first missing page after
    it) -- a missing page ends the walk.  Grouped aggregates and an anti-join
    on ``page_no + 1``: no per-crawl window, so a crawl holding a third of all
    pages is still split over many tasks."""
    p = pages.select(crawl, "page_no").distinct()
    nxt = p.select(crawl, (F.col("page_no") + 1).alias("page_no"))
    holes = nxt.join(p, [crawl, "page_no"], "left_anti")
    start = p.groupBy(crawl).agg(F.min("page_no").alias("start"))
    gaps = holes.join(start, crawl).where(F.col("page_no") > F.col("start")) \
        .groupBy(crawl).agg(F.min("page_no").alias("gap"))
    return start.join(gaps, crawl, "left")


def _walk(pages: DataFrame, crawl: str, max_pages: int | None = None) -> DataFrame:
    """Walked-order pages ``(crawl, page_no, walk_no)``: contiguous from the
    first page, at most ``max_pages`` if that is given."""
    b = _walk_bounds(pages, crawl)
    p = pages.select(crawl, "page_no").distinct().join(b, crawl)
    p = p.where((F.col("page_no") >= F.col("start")) & (F.col("page_no") < F.col("gap")))
    p = p.withColumn("walk_no", F.col("page_no") - F.col("start") + 1)
    if max_pages is not None:
        p = p.where(F.col("walk_no") <= max_pages)
    return p.select(crawl, "page_no", "walk_no")


def walk_pages(pages: DataFrame, max_pages: int | None = None, crawl: str = "crawl_id") -> DataFrame:
    """Public form of the walk order: ``(crawl, page_no, walk_no)``; compute
    it once and pass it to ``empty_streak_stop`` / ``walked_pages``."""
    return _walk(pages, crawl, max_pages)


def empty_streak_stop(items: DataFrame, pages: DataFrame, k: int = URL_EMPTY_STREAK,
                      max_pages: int | None = None, crawl: str = "crawl_id",
                      walk: DataFrame | None = None) -> DataFrame:
    """Walk pages in order; stop after ``k`` consecutive pages without a
    new item (that page is still walked); at most ``max_pages`` pages if given;
    a missing page ends the walk.  Returns one row per crawl: ``stop_page`` (page that
    completed the streak, NULL if none), ``pages_walked``, ``last_page``.

    Windowless: each empty page ``q`` votes for ``q .. q+k-1``; a page with
    ``k`` votes (and at least ``k`` pages walked) ends a streak -- an explode
    and a grouped count, combined map-side."""
    fs = first_seen(items, crawl)
    new_per_page = fs.groupBy(crawl, F.col("first_page").alias("page_no")).agg(F.count(F.lit(1)).alias("n_new"))
    w = _walk(pages, crawl, max_pages) if walk is None else walk if max_pages is None else walk.where(
        F.col("walk_no") <= max_pages)
    empty = w.join(new_per_page, [crawl, "page_no"], "left_anti")
    votes = (empty.select(crawl, "walk_no", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
             .select(crawl, (F.col("walk_no") + F.col("j")).alias("walk_no"))
             .groupBy(crawl, "walk_no").count().where((F.col("count") == k) & (F.col("walk_no") >= k)))
    stop = (votes.join(w, [crawl, "walk_no"])
            .groupBy(crawl).agg(F.min(F.struct("walk_no", "page_no")).alias("s")))
    n = w.groupBy(crawl).agg(F.max("walk_no").alias("_n"), F.max("page_no").alias("last_page"))
    return (n.join(stop, crawl, "left")
            .select(crawl, F.col("s.page_no").alias("stop_page"),
                    F.coalesce(F.col("s.walk_no"), F.col("_n")).alias("pages_walked"), "last_page"))


def walked_pages(stops: DataFrame, pages: DataFrame, crawl: str = "crawl_id",
                 walk: DataFrame | None = None) -> DataFrame:
    """Pages inside the walk: ``(crawl, page_no)``."""
    w = walk if walk is not None else _walk(pages, crawl)
    return (w.join(stops.select(crawl, "pages_walked"), crawl)
            .where(F.col("walk_no") <= F.col("pages_walked")).select(crawl, "page_no"))


def distinct_accumulate(items: DataFrame, walked: DataFrame, crawl: str = "crawl_id") -> DataFrame:
    """Each item once, in first-seen order, from walked pages only."""
    fs = first_seen(items.join(walked, [crawl, "page_no"], "left_semi"), crawl)
    return fs


def append_accumulate(items: DataFrame, walked: DataFrame, crawl: str = "crawl_id") -> DataFrame:
    """All items of walked pages, duplicates kept (``page_no`` carried)."""
    return items.join(walked, [crawl, "page_no"], "left_semi")


def count_stability_stop(snapshots: DataFrame, stable: int = AUTO_SCROLL_STABLE, max_snaps: int | None = None,
                         crawl: str = "crawl_id") -> DataFrame:
    """``snapshots(crawl, snap_no, n)``, snap 0 is the initial count.

    Skip the crawl if the initial count is 0; else take snapshots (at most
    ``max_snaps`` if given) and stop once the count has not grown for
    ``stable`` snapshots in a row.  Returns ``(crawl, scrolls, final_count)``.

    Windowless: the first snapshot with each count is found by an aggregate on
    (crawl, n); a snapshot grows if its count is above all earlier ones, which
    a running maximum over those few distinct counts tells."""
    if max_snaps is not None:
        snapshots = snapshots.where(F.col("snap_no") <= max_snaps)
    # one row per distinct count of a crawl, not per snapshot
    firsts = snapshots.groupBy(crawl, "n").agg(F.min("snap_no").alias("snap_no"))
    w = Window.partitionBy(crawl).orderBy("snap_no", "n").rowsBetween(Window.unboundedPreceding, -1)
    grew = firsts.withColumn("_before", F.max("n").over(w)).where(F.col("n") > F.coalesce("_before", F.lit(-1)))
    last = snapshots.groupBy(crawl).agg(F.max("snap_no").alias("last_snap"),
                                        F.max(F.when(F.col("snap_no") == 0, F.col("n"))).alias("initial"))
    nxt = F.lead("snap_no").over(Window.partitionBy(crawl).orderBy("snap_no"))
    gaps = grew.withColumn("_next", nxt).where(
        (F.col("_next").isNull()) | (F.col("_next") - F.col("snap_no") > stable))
    quiet = gaps.groupBy(crawl).agg(F.min("snap_no").alias("_quiet"))
    out = last.where(F.col("initial") > 0).join(quiet, crawl).withColumn(
        "scrolls", F.least(F.col("_quiet") + stable, F.col("last_snap")))
    upto = grew.join(out.select(crawl, "scrolls"), crawl).where(F.col("snap_no") <= F.col("scrolls"))
    return upto.groupBy(crawl, "scrolls").agg(F.max("n").alias("final_count"))


def next_selector_stop(pages: DataFrame, has_next: DataFrame, max_pages: int | None = None,
                       crawl: str = "crawl_id") -> DataFrame:
    """W3 (``button``, ``load_more``) + W4: continue while the page has the
    control; at most ``max_pages`` pages if given.  ``has_next(crawl, page_no)``
    lists pages with the control.  Returns the walked ``(crawl, page_no)``; the
    first page without the control is the last one walked (grouped ``min``)."""
    w = _walk(pages, crawl, max_pages)
    no_next = w.join(has_next.select(crawl, "page_no").distinct(), [crawl, "page_no"], "left_anti")
    return _through_first(w, no_next, crawl)


def end_selector_stop(pages: DataFrame, has_end: DataFrame, max_pages: int | None = None,
                      crawl: str = "crawl_id") -> DataFrame:
    """W3 (``infinite_scroll``) + W4: continue until a page shows the end
    condition; that page is the last one walked.  ``has_end(crawl, page_no)``
    lists the pages that show it."""
    w = _walk(pages, crawl, max_pages)
    return _through_first(w, w.join(has_end.select(crawl, "page_no").distinct(), [crawl, "page_no"], "left_semi"), crawl)


def _through_first(walk: DataFrame, stops: DataFrame, crawl: str) -> DataFrame:
    """Pages of ``walk`` up to and with the first of ``stops`` (all of them without one)."""
    last = stops.groupBy(crawl).agg(F.min("walk_no").alias("_last"))
    return (walk.join(last, crawl, "left").where(F.col("walk_no") <= F.coalesce("_last", F.col("walk_no")))
            .select(crawl, "page_no"))


def crawl_pages(dom, planner, templates: DataFrame, start: DataFrame) -> DataFrame:
    """Pages that each crawl of ``start(template_id, crawl_id, url, page_id)``
    walks: ``(template_id, crawl_id, page_id, page_no)``, page 1 is the start.

    A template with ``pagination`` goes on to the stored pages whose URL differs
    in one page parameter only (the first of ``URL_PATTERNS`` under which page 2
    exists), in order, without gaps: while the page shows ``next_selector`` or
    ``load_more_selector``, until it shows ``end_condition_selector``, and at
    most ``max_pages`` pages -- whichever of these the template sets."""
    from ..plans.ast import SelectorError
    from ..plans.compile import check_compiles, parse_selector

    first = start.where("page_id IS NOT NULL").select("template_id", "crawl_id", "page_id", F.lit(1).alias("page_no"))
    paged = templates.where("pagination IS NOT NULL").select("template_id", "pagination.*")
    crawls = materialize(start.where("page_id IS NOT NULL").join(paged, "template_id").select(
        "template_id", "crawl_id", "url", "max_pages", F.col("end_condition_selector").alias("end_selector"),
        F.when(F.col("pattern_type") == "load_more", F.col("load_more_selector"))
        .otherwise(F.col("next_selector")).alias("next_selector")))
    if crawls.isEmpty():
        return first

    def with_places(df: DataFrame) -> DataFrame:
        places = F.array(*[F.struct(
            F.lit(i).alias("pattern_no"), F.lit(p["step"]).alias("step"),
            without_query_param(F.col("url"), p["param"]).alias("listing"),
            F.coalesce(query_param_number(F.col("url"), p["param"]), F.lit(p["start"])).alias("at"))
            for i, p in enumerate(URL_PATTERNS)])
        return df.select("*", F.explode(places).alias("_p")).select("*", "_p.*").drop("_p")

    docs = with_places(dom.docs.where("doc_text IS NOT NULL").select("page_id", "url")).select(
        "pattern_no", "listing", F.col("at").alias("to"), "page_id")
    reached = materialize(with_places(crawls).join(docs, ["pattern_no", "listing"]).where(
        (F.col("to") >= F.col("at")) & ((F.col("to") - F.col("at")) % F.col("step") == 0)).select(
        "template_id", "crawl_id", "pattern_no", "page_id", (((F.col("to") - F.col("at")) / F.col("step")) + 1).cast(
            "int").alias("page_no")))
    pattern = reached.where("page_no = 2").groupBy("crawl_id").agg(F.min("pattern_no").alias("pattern_no"))
    # several page rows of one URL: the lowest page_id
    pages = materialize(reached.join(pattern, ["crawl_id", "pattern_no"]).groupBy(
        "template_id", "crawl_id", "page_no").agg(F.min("page_id").alias("page_id")))
    walk = _walk(pages, "crawl_id").join(crawls.drop("url", "template_id"), "crawl_id").where(
        F.col("max_pages").isNull() | (F.col("walk_no") <= F.col("max_pages"))).join(
        pages, ["crawl_id", "page_no"])
    marks = []
    specs = {r[0] for r in crawls.select(F.explode(F.array("next_selector", "end_selector"))).distinct().collect() if r[0]}
    for selector in sorted(specs):  # template configuration
        try:
            parsed = parse_selector(selector)
            check_compiles(parsed)
        except SelectorError:
            continue
        marks.append((selector, parsed))
    # a control that cannot be looked for is not there: the walk ends on its first page
    known = F.col("next_selector").isin([m for m, _ in marks]) if marks else F.lit(False)
    stops = walk.where(F.col("next_selector").isNotNull() & ~known).select("crawl_id", "walk_no")
    if marks:
        shown = planner.select_many(marks).select("page_id", F.col("key").alias("selector")).distinct()
        stops = stops.unionByName(walk.where(known).join(shown.withColumnRenamed("selector", "next_selector"),
                                       ["page_id", "next_selector"], "left_anti").select("crawl_id", "walk_no"))
        stops = stops.unionByName(walk.join(shown.withColumnRenamed("selector", "end_selector"),
                                            ["page_id", "end_selector"], "left_semi").select("crawl_id", "walk_no"))
    last = stops.groupBy("crawl_id").agg(F.min("walk_no").alias("_last"))
    more = walk.join(last, "crawl_id", "left").where(
        (F.col("walk_no") <= F.coalesce("_last", F.col("walk_no"))) & (F.col("page_no") > 1))
    return first.unionByName(more.select("template_id", "crawl_id", "page_id", "page_no"))


def page_url_sequence(base: DataFrame, n: int, url_col: str = "url") -> DataFrame:
    """W5 + P15: for each base URL and each URL pattern, the page URLs of the
    first ``n`` pages (``param = start + i * step``)."""
    pats = F.array(*[F.struct(F.lit(p["param"]).alias("param"), F.lit(p["step"]).alias("step"),
                              F.lit(p["start"]).alias("start"), F.lit(i).alias("pattern_no"))
                     for i, p in enumerate(URL_PATTERNS)])
    b = base.select("*", F.explode(pats).alias("pat")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
                                                                 .alias("i"))
    value = F.col("pat.start") + F.col("i") * F.col("pat.step")
    out = b.withColumn("page_url", _set_param_dynamic(F.col(url_col), F.col("pat.param"), value))
    return out.select(*base.columns, F.col("pat.param").alias("param"), F.col("pat.pattern_no").alias("pattern_no"),
                      (F.col("i") + 1).alias("page_no"), value.alias("param_value"), "page_url")


def _set_param_dynamic(url: Column, name: Column, value: Column) -> Column:
    # parameter name varies per row: build the expression per known name
    out = None
    for p in URL_PATTERNS:
        e = set_query_param(url, p["param"], value)
        out = F.when(name == p["param"], e) if out is None else out.when(name == p["param"], e)
    return out


def filter_combinations(filters: DataFrame, key: str = "template") -> DataFrame:
    """Cartesian product of each template's filter values; the key is
    ``label_value`` joined by ``_``; no filters give one empty combination.

    Runs as array functions inside one row per template (the product of a
    template's own filter lists), so no join of unrelated rows happens."""
    lists = F.transform(F.col("filters"), lambda f: F.transform(
        F.coalesce(f["filter_values"], F.array().cast("array<string>")),
        lambda v: F.struct(f["filter_label"].alias("label"), v.alias("value"))))
    start = F.array(F.array().cast("array<struct<label:string,value:string>>"))
    combos = F.aggregate(lists, start, lambda acc, lst: F.flatten(
        F.transform(acc, lambda c: F.transform(lst, lambda x: F.concat(c, F.array(x))))))
    return (filters.select(key, F.posexplode(combos).alias("combo_no", "combo"))
            .select(key, "combo_no", F.array_join(F.transform("combo", lambda x: F.concat(x["label"], F.lit("_"),
                                                                                         x["value"])), "_")
                    .alias("combo_key"), "combo"))


def working_parameter(dom, base: DataFrame, container_counts: DataFrame) -> DataFrame:
    """Per base URL, the first URL pattern whose test page (parameter set
    to its step) exists and has different content (A3: container count > 0
    and unlike the base page's).  ``base(page_id, url)``;
    ``container_counts(page_id, container_count)`` is A2 over the same pages.
    Returns ``(page_id, param)``; no row when no pattern works."""
    tests = None
    for i, p in enumerate(URL_PATTERNS):
        t = base.select("page_id", F.lit(i).alias("pattern_no"), F.lit(p["param"]).alias("param"),
                        set_query_param(F.col("url"), p["param"], F.lit(p["step"])).alias("test_url"))
        tests = t if tests is None else tests.unionByName(t)
    cur = container_counts.select("page_id", F.col("container_count").alias("current_count"))
    test_pages = dom.docs.select(F.col("page_id").alias("test_id"), F.col("url").alias("test_url"))
    tc = container_counts.select(F.col("page_id").alias("test_id"), F.col("container_count").alias("test_count"))
    from .detect import different_content

    found = tests.join(test_pages, "test_url").join(tc, "test_id").withColumn("key", F.struct("page_id", "pattern_no"))
    base_counts = found.join(cur, "page_id").select("key", F.col("current_count").alias("container_count"))
    differs = different_content(base_counts, found.select("key", F.col("test_count").alias("container_count"))).where(
        "different").select("key")
    ok = found.join(differs, "key", "left_semi")
    return ok.groupBy("page_id").agg(F.min_by("param", "pattern_no").alias("param"))
