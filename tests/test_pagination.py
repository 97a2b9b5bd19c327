"""Stop rules and accumulation on small literal tables."""

from domquarry.operators.paginate import (append_accumulate, count_stability_stop, distinct_accumulate,
                                          empty_streak_stop, filter_combinations, next_selector_stop,
                                          walked_pages)


def _items(spark, rows):
    return spark.createDataFrame(rows, "crawl_id long, page_no int, item string")


def _pages(spark, n, crawl=1):
    return spark.createDataFrame([(crawl, p) for p in range(1, n + 1)], "crawl_id long, page_no int")


def test_empty_streak_includes_the_completing_page(spark):
    items = _items(spark, [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "b"), (1, 5, "a"), (1, 6, "c")])
    s = empty_streak_stop(items, _pages(spark, 6), k=3).collect()[0]
    assert s["stop_page"] == 5 and s["pages_walked"] == 5
    walked = walked_pages(empty_streak_stop(items, _pages(spark, 6), k=3), _pages(spark, 6))
    assert distinct_accumulate(items, walked).count() == 2          # c (page 6) is never reached
    assert append_accumulate(items, walked).count() == 5             # duplicates kept


def test_missing_page_ends_walk(spark):
    items = _items(spark, [(1, 1, "a"), (1, 2, "b"), (1, 4, "c")])
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "crawl_id long, page_no int")
    s = empty_streak_stop(items, pages, k=3).collect()[0]
    assert s["stop_page"] is None and s["pages_walked"] == 2


def test_count_stability(spark):
    snaps = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (1, 2, 7), (1, 3, 7), (1, 4, 7), (1, 5, 9),
                                   (2, 0, 0), (2, 1, 4)], "crawl_id long, snap_no int, n int")
    got = {r["crawl_id"]: (r["scrolls"], r["final_count"]) for r in count_stability_stop(snaps).collect()}
    assert got == {1: (4, 7)}  # crawl 2 starts at 0 and is skipped


def test_next_selector_and_cap(spark):
    has_next = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "crawl_id long, page_no int")
    w = next_selector_stop(_pages(spark, 5), has_next)
    assert sorted(r["page_no"] for r in w.collect()) == [1, 2, 3, 4]
    w = next_selector_stop(_pages(spark, 5), has_next, max_pages=2)
    assert sorted(r["page_no"] for r in w.collect()) == [1, 2]


def test_filter_combinations(spark):
    df = spark.createDataFrame(
        [("t", [("brand", "s", ["A", "B"], "select", 2.0), ("size", "s", ["1"], "select", 2.0)]), ("u", [])],
        "template string, filters array<struct<filter_label:string,filter_selector:string,"
        "filter_values:array<string>,filter_type:string,wait_after_change:double>>")
    got = sorted((r["template"], r["combo_key"]) for r in filter_combinations(df).collect())
    assert got == [("t", "brand_A_size_1"), ("t", "brand_B_size_1"), ("u", "")]


def test_row_number_within_hot_group(spark):
    from domquarry.operators.rank import row_number_within
    df = spark.range(0, 500).selectExpr("CASE WHEN id % 10 < 7 THEN 1 ELSE id % 10 END AS g", "id")
    got = row_number_within(df, "g", "id").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["id"], r["rn"]))
    for g, rows in by.items():
        rows.sort()
        assert [rn for _, rn in rows] == list(range(1, len(rows) + 1))
