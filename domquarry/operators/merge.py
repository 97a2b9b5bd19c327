"""Merges and incremental operators.

Record lists are long tables:

``lists(page_id, list_label, list_order, record_index, profile_link, key, value_ord, value)``

one row per (record, field value); ``list_order`` is the template order of
the lists.  Fields whose key starts with ``_`` are internal and never merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .rank import row_number_within

# Keys that mark a main list / a subpage list.
MAIN_KEYS = ["name", "Position", "title"]
SUBPAGE_KEYS = ["education", "credential", "admission", "bar"]
# The core columns of a unified profile.
CORE_COLUMNS = ["name", "position", "sector", "email", "phone", "profile_link"]

def classify_lists(lists: DataFrame) -> DataFrame:
    """J4 classification from each list's first record and its label:
    ``main`` / ``subpage`` / ``other`` per (page, list); one aggregate."""
    def first_has(words):
        return F.coalesce(F.bool_or((F.col("record_index") == 0) & F.col("key").isin(words)), F.lit(False))

    c = lists.groupBy("page_id", "list_label", "list_order").agg(
        first_has(MAIN_KEYS).alias("main"), first_has(SUBPAGE_KEYS).alias("sub"))
    low = F.lower("list_label")
    return c.select("page_id", "list_label", "list_order", F.when(F.col("main") & ~F.col("sub"), "main")
                    .when(F.col("sub") | low.contains("subpage") | low.contains("second"), "subpage")
                    .otherwise("other").alias("kind"))


def merge_related(lists: DataFrame) -> DataFrame:
    """Merge subpage lists into main lists by profile link OR index.

    Each subpage record stands under two anchors, its link and its index, and so does each main
    record: the OR-join is one equi-join on (page, kind of anchor, anchor).  Under an anchor only
    the last record per key is kept (list order, then record index), by an aggregate that is combined
    before the shuffle; a second one picks, per main record and key, the later of what
    both anchors give, or the record's own value.  ``education`` / ``credential`` lists
    merge flat; others nest under ``<clean label>_details.<key>``.  Pages without both kinds
    keep their lists unchanged; subpage lists are dropped where a merge ran."""
    kinds = classify_lists(lists)
    both = kinds.groupBy("page_id").agg(
        (F.bool_or(F.col("kind") == "main") & F.bool_or(F.col("kind") == "subpage")).alias("both"))
    kinds = materialize(kinds.join(both, "page_id"))  # one row per list
    cols = ["page_id", "list_label", "list_order", "record_index", "profile_link", "key", "value_ord", "value"]
    here = lists.select(*cols).join(kinds, ["page_id", "list_label", "list_order"])
    takes_part = F.col("both") & (F.col("kind") != "other")
    unchanged = here.where(~takes_part).select(*cols)
    low = F.lower("list_label")
    clean = F.trim(F.replace(F.replace("list_label", F.lit("container"), F.lit("")), F.lit("second"), F.lit("")))
    nested = (F.col("kind") == "subpage") & ~(low.contains("education") | low.contains("credential"))
    merged_key = F.when(nested, F.concat(clean, F.lit("_details."), "key")).otherwise(F.col("key"))
    # a field of a record with all its values
    rec = ["page_id", "list_label", "list_order", "record_index", "profile_link"]
    fields = materialize(here.where(takes_part).select(*rec, "kind", F.col("key").startswith("_").alias("internal"),
                                                       merged_key.alias("key"), "value_ord", "value")
                         .groupBy(*rec, "kind", "internal", "key").agg(
                             F.collect_list(F.struct("value_ord", "value")).alias("vs")))
    link, index = F.col("profile_link"), F.col("record_index").cast("string")
    anchors = F.filter(F.array(F.struct(F.lit("link").alias("by"), link.alias("at")),
                               F.struct(F.lit("index").alias("by"), index.alias("at"))),
                       lambda x: (x["at"] != "") & x["at"].isNotNull())
    given = (fields.where("kind = 'subpage' AND NOT internal").withColumn("x", F.explode(anchors))
             .groupBy("page_id", "x.by", "x.at", "key")
             .agg(F.max(F.struct(F.col("list_order").alias("o"), F.col("record_index").alias("i"), "vs")).alias("last")))
    main = fields.where("kind = 'main'")
    asked = main.select(*rec).distinct().withColumn("x", F.explode(anchors)).select(*rec, "x.by", "x.at")
    taken = asked.join(given, ["page_id", "by", "at"]).select(*rec, "key", F.struct(
        F.lit(1).alias("given"), F.col("last.o").alias("o"), F.col("last.i").alias("i"), F.col("last.vs").alias("vs")).alias("v"))
    own = main.select(*rec, "key", F.struct(F.lit(0).alias("given"), F.lit(None).cast("int").alias("o"),
                                            F.lit(None).cast("int").alias("i"), "vs").alias("v"))
    merged = own.unionByName(taken).groupBy(*rec, "key").agg(F.max("v").alias("v"))
    return unchanged.unionByName(merged.select(*rec, "key", F.inline("v.vs")).select(*cols))


def unified_profiles(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J6 + A5: the list whose label has both ``main`` and ``container`` is
    the spine; each record gets the core columns (default ``''``), its other
    fields, and the fields of the first record with the same index in every
    other list.  Returns ``(profiles_long, metadata)``."""
    low = F.lower("list_label")
    is_main = low.contains("main") & low.contains("container")
    spine_label = (lists.where(is_main).groupBy("page_id")
                   .agg(F.min_by("list_label", "list_order").alias("main_label")))
    spine = (lists.join(spine_label, "page_id").where(F.col("list_label") == F.col("main_label")))
    recs = spine.select("page_id", "record_index", "profile_link").distinct()
    own = spine.where(~F.col("key").startswith("_")).select("page_id", "record_index", "key", "value_ord", "value")
    core = recs.select("page_id", "record_index", F.explode(F.array(*[F.lit(c) for c in CORE_COLUMNS])).alias("key"))
    core_vals = (core.join(own, ["page_id", "record_index", "key"], "left")
                 .select("page_id", "record_index", "key", F.coalesce("value_ord", F.lit(1)).alias("value_ord"),
                         F.when(F.col("key") == "profile_link", F.coalesce("value", F.lit("")))
                         .otherwise(F.coalesce("value", F.lit(""))).alias("value")))
    links = recs.select("page_id", "record_index", F.lit("profile_link").alias("key"), F.lit(1).alias("value_ord"),
                        F.coalesce("profile_link", F.lit("")).alias("value"))
    core_vals = core_vals.where(F.col("key") != "profile_link").unionByName(links)
    others = own.where(~F.col("key").isin(CORE_COLUMNS))
    subs = (lists.join(spine_label, "page_id").where(F.col("list_label") != F.col("main_label"))
            .where(~F.col("key").startswith("_"))
            .select("page_id", "list_label", "list_order", "record_index", "key", "value_ord", "value"))
    prof = core_vals.unionByName(others)
    incoming = subs.join(recs.select("page_id", "record_index"), ["page_id", "record_index"], "left_semi")
    w = Window.partitionBy("page_id", "record_index", "key")
    incoming = (incoming.withColumn("_last", F.max("list_order").over(w))
                .where(F.col("list_order") == F.col("_last")).select("page_id", "record_index", "key", "value_ord",
                                                                       "value"))
    prof = prof.join(incoming.select("page_id", "record_index", "key").distinct(),
                     ["page_id", "record_index", "key"], "left_anti").unionByName(incoming)
    meta = (spine_label.join(recs.groupBy("page_id").agg(F.count(F.lit(1)).alias("total_profiles")), "page_id")
            .join(lists.join(spine_label, "page_id").where(F.col("list_label") != F.col("main_label"))
                  .groupBy("page_id").agg(F.array_sort(F.collect_set("list_label")).alias("subpage_sources")),
                  "page_id", "left")
            .select("page_id", "total_profiles", F.col("main_label").alias("main_container_source"),
                    F.coalesce("subpage_sources", F.array().cast("array<string>")).alias("subpage_sources")))
    return prof, meta


#: Targets are found by the characters they end with: as many as the largest of these that fits.
ANCHOR_LENGTHS = [1, 2, 4, 8, 16, 32]


def action_subpage_join(records: DataFrame, actions: DataFrame) -> DataFrame:
    """A record value containing an action's target URL picks that URL.

    ``records(page_id, container_id, key, value)``, ``actions(label,
    target_url)``, any number of them.  Every distinct value is cut into its pieces of the anchor lengths,
    six at most for each of its characters however many lengths targets have.  Pieces that some target
    ends with say where, and for which target lengths, a target may end; those stretches of the value are
    joined to the targets as a whole.  So the work follows the length of the values, and neither records
    nor pieces are ever paired with all actions.  Returns ``(page_id, container_id, subpage_url,
    action_label)`` with the first action (by label) per record; null and empty targets and values pick nothing."""
    targets = actions.where("target_url IS NOT NULL AND target_url <> ''").select("label", "target_url")
    length = F.length("target_url")
    size = F.array_max(F.filter(F.array(*[F.lit(n) for n in ANCHOR_LENGTHS]), lambda n: n <= length))
    ends = targets.select(size.alias("_size"), F.expr("right(target_url, 32)").alias("_end"), length.alias("_length")).select(
        "_size", F.expr("right(_end, _size)").alias("anchor"), "_length")
    ends = materialize(ends.groupBy("anchor").agg(F.collect_set("_length").alias("lengths")))  # at most the lengths there are
    sizes = sorted(r[0] for r in ends.select(F.length("anchor")).distinct().collect())  # six at most
    texts = materialize(records.where("value <> ''").select("value").distinct().withColumn(
        "_text", F.monotonically_increasing_id()))

    def pieces(n):
        return F.when(F.length("value") >= n, F.transform(
            F.sequence(F.lit(n), F.length("value")),
            lambda i: F.struct(i.alias("stop"), F.substring(F.col("value"), i - n + 1, F.lit(n)).alias("anchor"))))

    none = F.array().cast("array<struct<stop:int,anchor:string>>")
    parts = F.flatten(F.array(none, *[F.coalesce(pieces(n), none) for n in sizes]))
    cut = texts.select("_text", F.explode(parts).alias("p")).select("_text", "p.stop", "p.anchor")
    places = cut.join(ends, "anchor").groupBy("_text").agg(
        F.collect_list(F.struct("stop", "lengths")).alias("places"))  # as many as a value has pieces
    may = texts.join(places, "_text").select("value", F.explode("places").alias("p")).select(
        "value", "p.stop", F.explode("p.lengths").alias("n")).where("n <= stop")
    found = may.select("value", F.substring(F.col("value"), F.col("stop") - F.col("n") + 1, F.col("n")).alias("target_url"))
    hits = found.join(targets, "target_url").groupBy("value").agg(
        F.min(F.struct("label", "target_url")).alias("a"))
    return (records.select("page_id", "container_id", "value").join(hits, "value").groupBy("page_id", "container_id")
            .agg(F.min("a").alias("a"))
            .select("page_id", "container_id", F.col("a.target_url").alias("subpage_url"),
                    F.col("a.label").alias("action_label")))


def with_action_subpages(records: DataFrame, joined: DataFrame) -> DataFrame:
    """The long ``records`` and, for those that an action's target picked, a
    field ``subpage_<label>`` and ``_subpage_url`` with that URL."""
    picked = joined.where("subpage_url IS NOT NULL")
    marks = F.array(F.struct(F.concat(F.lit("subpage_"), "action_label").alias("key"), F.col("subpage_url").alias("value")),
                    F.struct(F.lit("_subpage_url").alias("key"), F.col("subpage_url").alias("value")))
    new = picked.select("page_id", "container_id", F.inline(marks))
    return records.select("page_id", "container_id", "key", "value").unionByName(new)


def merge_initial_paginated(initial: DataFrame, paginated: DataFrame, distinct: bool = True) -> DataFrame:
    """``(crawl_id, label, is_list, seq, value)`` from the initial page and
    from pagination.  Lists extend (initial first; ``distinct`` keeps the
    first occurrence only), scalars are replaced by the later source."""
    src = (initial.withColumn("_src", F.lit(0)).unionByName(paginated.withColumn("_src", F.lit(1))))
    lists = src.where("is_list")
    if distinct:
        # the first occurrence, by an aggregate that is combined before the shuffle
        lists = (lists.groupBy("crawl_id", "label", "value").agg(F.min(F.struct("_src", "seq")).alias("f"))
                 .select("crawl_id", "label", F.lit(True).alias("is_list"), "f.seq", "value", "f._src"))
    scal = (src.where(~F.col("is_list")).groupBy("crawl_id", "label")
            .agg(F.max_by(F.struct("seq", "value"), F.struct("_src", "seq")).alias("v"))
            .select("crawl_id", "label", F.lit(False).alias("is_list"), "v.seq", "v.value", F.lit(1).alias("_src")))
    return lists.unionByName(scal)


def incremental_delta(existing_counts: DataFrame, current: DataFrame) -> DataFrame:
    """U4: items beyond the count already held, per (crawl, label); scalars
    only when the label is new.  ``existing_counts(crawl_id, label, n)``;
    ``current(crawl_id, label, is_list, seq, value)``."""
    cur = row_number_within(current, ["crawl_id", "label"], "seq", "_pos")
    j = cur.join(existing_counts, ["crawl_id", "label"], "left")
    return (j.where((F.col("is_list") & (F.col("_pos") > F.coalesce("n", F.lit(0))))
                    | (~F.col("is_list") & F.col("n").isNull()))
            .drop("_pos", "n"))


def incremental_containers(records: DataFrame, existing: DataFrame, by: str = "page_id") -> DataFrame:
    """Only containers with ``container_index`` at or above the count
    already held, ``existing(by, n)``; all of them where none is held."""
    held = existing.select(by, F.col("n").alias("_n"))
    return records.join(held, by, "left").where(F.col("container_index") >= F.coalesce("_n", F.lit(0))).drop("_n")


def pages_to_rows(page_values: DataFrame) -> DataFrame:
    """``(crawl_id, page_no, label, is_list, item)`` -> one row per list
    item with ``_source_page`` (``field = label``); scalars give no row."""
    return page_values.where("is_list").select("crawl_id", F.col("page_no").alias("_source_page"), F.col("label").alias("field"),
                              F.col("item").alias("value"))
