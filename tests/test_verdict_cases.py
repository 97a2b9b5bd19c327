"""Cases that lost or misread data before: positions after tests, relative
paths, records without fields, equal labels and URLs, null pages, limits."""

import json

import pytest
from pyspark.sql import functions as F

from domquarry.functions.urls import set_query_param, urljoin
from domquarry.operators.containers import find_containers
from domquarry.operators.merge import (action_subpage_join, incremental_containers, merge_initial_paginated,
                                       pages_to_rows, with_action_subpages)
from domquarry.operators.paginate import end_selector_stop, next_selector_stop
from domquarry.operators.scrape import flatten, scrape
from domquarry.operators.subpages import (directory_merge, eligible_links, link_queue, process_queue,
                                          subpage_records_from_containers, subpage_values)
from domquarry.operators.values import node_values
from domquarry.plans.ast import SelectorError
from domquarry.plans.compile import check_compiles, parse_selector
from domquarry.sources.sinks import export_results, write_results
from domquarry.sources.templates import templates_from_json

HTML = ("<div id=a><a>x</a><a href=u>y</a><a href=v>z</a></div><div id=b><p>t</p></div>"
        "<div id=c><span class=k>yes</span><p><a href=w>q</a></p></div>")


@pytest.mark.parametrize("selector,want", [
    ("//a[@href][1]", ["y", "q"]),
    ("//div/a[@href][last()]", ["z"]),
    ("//a[position()=2][@href]", ["y"]),
    ("//a[@href][1][@href='u']", ["y"]),
    ("//div[not(.//a)]", ["t"]),
    ("//div[.//a and .//span]", ["yesq"]),
    ("//div[.//span = 'yes']", ["yesq"]),
    ("//div[not(.//span) and p]", ["t"]),
    ("//div[p/a/@href = 'w']", ["yesq"]),
    ("div:not(:has(a))", ["t"]),
    ("div:not(:has(span)):has(a)", ["xyz"]),
    ("div:not(:has(a), #c)", ["t"]),
])
def test_selectors(dom_of, selector, want):
    dom, planner = dom_of([(1, "https://x/", HTML)])
    rows = node_values(dom, planner.select(selector), "text").orderBy("node_id").collect()
    assert [r["value"] for r in rows] == want


@pytest.mark.parametrize("selector", ["//div[contains(.//a, 'x')]", "//div[count(.//a) > 1]", "//a[.//b = .//c]"])
def test_what_the_grammar_lacks_raises(spark, selector):
    with pytest.raises(SelectorError):
        check_compiles(parse_selector(selector))


def test_urls(spark):
    deep = "https://h/a/b/c/d/e/f/g/h/p"
    cases = {"../" * 8 + "z": "https://h/z", "./x/./y/../w/": "https://h/a/b/c/d/e/f/g/h/x/w/",
             "../..": "https://h/a/b/c/d/e/f/", ".well-known": "https://h/a/b/c/d/e/f/g/h/.well-known"}
    df = spark.createDataFrame([(k,) for k in cases], "ref string")
    got = {r[0]: r[1] for r in df.select("ref", urljoin(F.lit(deep), F.col("ref"))).collect()}
    assert got == cases
    params = {"https://h/p?a=1&a=1&offset=0": "https://h/p?a=1&a=1&offset=20",
              "https://h/p?q=a%20b+c&x=": "https://h/p?q=a+b+c&offset=20",
              "https://h/p?offset=1&b=%7E*&offset=2#f": "https://h/p?offset=20&b=~%2A#f",
              "https://h/p?bad=%zz": "https://h/p?bad=%25zz&offset=20", "https://h/p": "https://h/p?offset=20"}
    df = spark.createDataFrame([(k,) for k in params], "u string")
    got = {r[0]: r[1] for r in df.select("u", set_query_param(F.col("u"), "offset", F.lit(20))).collect()}
    assert got == params


def templates(spark, *docs):
    return templates_from_json(spark.createDataFrame([(json.dumps(d),) for d in docs], "json string"))


LIST = {"label": "people", "selector": "li", "is_container": True, "sub_elements": [
    {"label": "name", "selector": "b"}, {"label": "all", "selector": ""}, {"label": "odd", "selector": "i[["}]}


def test_scrape_keeps_every_record_and_result(spark, dom_of, tmp_path):
    page = "<title>T</title><h1>H</h1><ul><li><b>Ann</b></li><li></li></ul>"
    dom, planner = dom_of([(1, "https://x/p#top", page), (2, "https://x/p", page), (3, "https://x/null", None)])
    same = [{"label": "v", "selector": "title"}, {"label": "v", "selector": "h1"}]
    t = templates(spark, {"name": "n", "url": "https://x/p", "elements": [*same, LIST]},
                  {"name": "n", "url": "https://x/null", "elements": [{"label": "v", "selector": "title"}]},
                  {"name": "bare", "url": "https://x/p", "elements": [
                      {"label": "rows", "selector": "li", "is_container": True, "sub_elements": []}]})
    res = scrape(dom, planner, t).collect()
    assert len(res) == 3  # equal names and URLs do not mix or multiply
    by = {(r["template_name"], r["url"]): r for r in res}
    first = by["n", "https://x/p"]
    assert first["data"] == {"v": ["H"]} and first["success"]
    records = [(r["index"], r["fields"], r["error"]) for r in first["records"]]
    assert records == [(0, {"name": ["Ann"], "all": ["Ann"]}, "Unsupported selector: i[["),
                       (1, {"all": [""]}, "Unsupported selector: i[[")]
    assert by["n", "https://x/null"]["errors"] == ["Failed to fetch page: https://x/null"]
    bare = by["bare", "https://x/p"]
    assert [r["fields"] for r in bare["records"]] == [{"text": ["Ann"]}, {"text": [""]}]
    frame = scrape(dom, planner, t)
    cells = {(r["template_name"], r["url"], r["column"]): r["value"] for r in flatten(frame).collect()}
    assert cells["n", "https://x/p", "people_1_name"] == "Ann"
    assert cells["n", "https://x/p", "people_2_error"].startswith("Unsupported")
    back = spark.read.option("header", True).csv(write_results(frame, str(tmp_path / "c"), "csv"))
    assert back.count() == 3 and "people_1_name" in back.columns
    assert "/roster_" in export_results(frame, str(tmp_path), "Roster")


def test_pages_with_an_error_status(spark):
    from domquarry.operators.nodes import build_dom
    from domquarry.plans.compile import Planner

    pages = spark.createDataFrame([(1, "https://x/a", "<title>ok</title>", 200), (2, "https://x/b", "<title>gone</title>", 404),
                                   (3, "https://x/c", "<title>old</title>", None)], "page_id long, url string, html string, status int")
    dom = build_dom(pages, min_partitions=2, num_partitions=2)
    t = templates(spark, *[{"name": n, "url": f"https://x/{n}", "elements": [{"label": "t", "selector": "title"}]} for n in "abc"])
    got = {r["template_name"]: (r["success"], r["data"].get("t")) for r in scrape(dom, Planner(dom), t).collect()}
    assert got == {"a": (True, ["ok"]), "b": (False, None), "c": (True, ["old"])}


def test_scrape_walks_pages_and_follows_links(spark, dom_of):
    def listing(k, more):
        return (f"<ul><li><b>P{k}</b><a href='/p/{k}'>profile</a></li></ul>" + ("<a class=next>n</a>" if more else ""))

    pages = [(i, f"https://x/l?page={i}", listing(i, i < 3)) for i in range(1, 5)]
    pages += [(10 + i, f"https://x/p/{i}", f"<p class=bio>Bio {i}</p>") for i in (1, 3)]
    dom, planner = dom_of(pages)
    people = {"label": "people", "selector": "li", "is_container": True, "sub_elements": [
        {"label": "name", "selector": "b"}, {"label": "profile", "selector": "a", "element_type": "link"}],
        "subpage_elements": [{"label": "bio", "selector": "p.bio"}]}
    base = {"url": "https://x/l?page=1", "enable_subpage_scraping": True, "elements": [people]}
    go_on = {"pattern_type": "button", "next_selector": "a.next"}
    t = templates(spark, base | {"name": "all", "pagination": go_on},
                  base | {"name": "two", "pagination": go_on | {"max_pages": 2}, "max_subpages": 0},
                  base | {"name": "one"})
    got = {r["template_name"]: [(x["source_page"], x["fields"].get("name"), x["fields"].get("bio")) for x in r["records"]]
           for r in scrape(dom, planner, t).collect()}
    assert got == {"all": [(1, ["P1"], ["Bio 1"]), (2, ["P2"], None), (3, ["P3"], ["Bio 3"])],
                   "two": [(1, ["P1"], None), (2, ["P2"], None)], "one": [(1, ["P1"], ["Bio 1"])]}


def test_scrape_finds_by_label_what_a_selector_misses(spark, dom_of):
    dom, planner = dom_of([(1, "https://x/p", "<div class=c><h3>Ann Lee</h3><i>ann@x.org</i><em>write @ us</em></div>"
                            "<div class=c><b class=who>Bob</b></div>")])
    cards = {"label": "cards", "selector": "div.c", "is_container": True, "sub_elements": [
        {"label": "name", "selector": "b.who"}, {"label": "email", "selector": "u"}]}
    t = templates(spark, {"name": "n", "url": "https://x/p", "elements": [cards]})
    got = [r["fields"] for r in scrape(dom, planner, t).first()["records"]]
    assert got == [{"name": ["Ann Lee"], "email": ["ann@x.org"]}, {"name": ["Bob"]}]
    plain = [r["fields"] for r in scrape(dom, planner, t, smart=False).first()["records"]]
    assert plain == [{"text": ["Ann Leeann@x.orgwrite @ us"]}, {"name": ["Bob"]}]


def test_walks_have_no_limit_of_their_own(spark):
    pages = spark.range(1, 251).selectExpr("1L AS crawl_id", "CAST(id AS int) AS page_no")
    assert next_selector_stop(pages, pages).count() == 250
    assert next_selector_stop(pages, pages, max_pages=10).count() == 10
    assert end_selector_stop(pages, pages.where("page_no = 120 OR page_no = 130")).count() == 120
    assert end_selector_stop(pages, pages.limit(0)).count() == 250


def test_links_per_template_and_queue(spark, dom_of):
    q = spark.createDataFrame([(t, f"u{i}", i) for t in "ab" for i in range(5)], "template_id string, url string, container_index int")
    assert eligible_links(q, max_subpages=2).count() == 4 and eligible_links(q, "[13]$").count() == 4
    own = q.withColumn("max_subpages", F.when(F.col("template_id") == "a", 1)).withColumn("subpage_url_pattern", F.lit("u[0-3]"))
    assert eligible_links(own).groupBy("template_id").count().orderBy("template_id").collect() == [("a", 1), ("b", 4)]
    dom, planner = dom_of([(1, "https://x/l", "<div class=card><a href='/lawyer/1'>a</a></div><div class=card>none</div>"
                            "<div class=card><a href='/lawyer/2'>b</a></div><div class=card><a href='/lawyer/9'>c</a></div>"),
                           (2, "https://x/lawyer/1", "<ul class=education><li>U</li></ul>"), (3, "https://x/lawyer/2", "<p>no</p>")])
    cards = find_containers(planner, ".card")
    els = [{"label": "education", "selector": ".education li"}]
    rows = {r["container_index"]: (r["fields"], r["error"]) for r in subpage_records_from_containers(dom, planner, cards, els).collect()}
    assert rows == {0: ({"education": ["U"]}, None), 1: (None, "No profile link found"), 2: (None, "No data extracted"),
                    3: (None, "No data extracted")}
    queue = link_queue(subpage_records_from_containers(dom, planner, cards))
    done, found = process_queue(queue, dom.docs, lambda linked: subpage_values(dom, planner, linked, els))
    assert {r["url"][-1]: r["status"] for r in done.collect()} == {"1": "completed", "2": "failed", "9": "failed"}
    assert [(r["profile_link"], r["container_index"], r["value"]) for r in found.collect()] == [("https://x/lawyer/1", 0, "U")]

    def broken(linked):
        raise SelectorError("cannot")

    assert {r["status"] for r in process_queue(queue, dom.docs, broken)[0].collect()} == {"error"}


def test_find_similar(dom_of):
    dom, planner = dom_of([(1, "https://x/", "<ul><li class=first>a</li><li>b</li><li>c</li></ul><p>d</p>")])
    assert find_containers(planner, "li.first").count() == 1
    assert find_containers(planner, "li.first", use_find_similar=True).count() == 3


def test_merges(spark):
    acts = spark.range(0, 12_000).selectExpr("concat('a', id) AS label", "concat('https://d/', id, '/') AS target_url")
    recs = spark.createDataFrame([(1, 0, "k", "see https://d/77/ now"), (1, 1, "k", "none")],
                                 "page_id long, container_id int, key string, value string")
    joined = action_subpage_join(recs, acts)
    assert [tuple(r) for r in joined.collect()] == [(1, 0, "https://d/77/", "a77")]
    keys = {(r["container_id"], r["key"]) for r in with_action_subpages(recs, joined).collect()}
    assert keys == {(0, "k"), (1, "k"), (0, "subpage_a77"), (0, "_subpage_url")}
    rows = spark.createDataFrame([(1, 0), (1, 3), (2, 0)], "page_id long, container_index int")
    held = spark.createDataFrame([(1, 2)], "page_id long, n int")
    assert sorted(map(tuple, incremental_containers(rows, held).collect())) == [(1, 3), (2, 0)]
    vals = spark.createDataFrame([(1, 1, "l", True, "x"), (1, 1, "s", False, "y")],
                                 "crawl_id long, page_no int, label string, is_list boolean, item string")
    assert [r["value"] for r in pages_to_rows(vals).collect()] == ["x"]
    first = spark.createDataFrame([(1, "l", True, 1, "x"), (1, "s", False, 1, "old")],
                                  "crawl_id long, label string, is_list boolean, seq int, value string")
    later = spark.createDataFrame([(1, "l", True, 1, "x"), (1, "l", True, 2, "y"), (1, "s", False, 2, "new")], first.schema)
    got = sorted((r["label"], r["value"]) for r in merge_initial_paginated(first, later).collect())
    assert got == [("l", "x"), ("l", "y"), ("s", "new")]


def test_directory_merge(spark):
    main = spark.createDataFrame([(1, 0, "name", 1, "Ann", "l"), (1, 1, "name", 1, "Bob", None)],
                                 "page_id long, container_index int, label string, value_ord int, value string, profile_link string")
    sub = spark.createDataFrame([(1, 0, 0, "education", 1, "U"), (1, 0, 1, "education", 1, "second record"), (1, 0, 0, "x", 1, "z")],
                                "page_id long, container_index int, record_no int, label string, value_ord int, value string")
    got = {r["name"]: r["subinfo"] and r["subinfo"].asDict() for r in directory_merge(main, sub).collect()}
    assert got == {"Ann": {"education": ["U"], "credentials": None}, "Bob": None}


def test_deep_and_null_pages(dom_of):
    dom, planner = dom_of([(1, "https://x/a", "<b>x" * 4000), (2, "https://x/b", None)])
    assert planner.select("b").count() == 4000
    assert dom.nodes.agg(F.max(F.size("path"))).first()[0] <= 512
    assert {r["page_id"]: r["doc_text"] is None for r in dom.docs.collect()} == {1: False, 2: True}


def people(n, tag="div", cls="card", extra=""):
    return "".join(f"<{tag} class='{cls}'><b>P{k}</b>{extra.format(k)}</{tag}>" for k in range(n))


NAMES = [{"label": "name", "selector": "b"}]


def test_scrape_containers_go_through_the_ladder(spark, dom_of):
    from domquarry.plans.compile import Planner

    pages = {"literal": people(2), "variant": people(3, cls="team-cards big"), "position": people(4, tag="li", cls="row"),
             "directory": people(3, cls="lawyer-card"), "last": "<section>" + people(6, cls="wp-block-column") + "</section>",
             "similar": "<ul>" + people(3, tag="li", cls="one") + "</ul>", "none": "<p>nothing here</p>"}
    selectors = {"literal": "div.card", "variant": ".team-card", "position": "li.row:nth-child(9)", "directory": "div.gone",
                 "last": "div.away", "similar": "li:first-child", "none": "div.absent"}
    dom, _ = dom_of([(i, f"https://x/{k}", f"<main>{h}</main>") for i, (k, h) in enumerate(pages.items())])
    t = templates(spark, *[{"name": k, "url": f"https://x/{k}", "elements": [
        {"label": "people", "selector": s, "is_container": True, "use_find_similar": k == "similar", "sub_elements": NAMES}]}
        for k, s in selectors.items()])
    got = {r["template_name"]: [x["fields"]["name"][0] for x in r["records"]] for r in scrape(dom, Planner(dom), t).collect()}
    sizes = {"literal": 2, "variant": 3, "position": 4, "directory": 3, "last": 6, "similar": 3, "none": 0}
    assert got == {k: [f"P{i}" for i in range(n)] for k, n in sizes.items()}
    plain = {r["template_name"]: len(r["records"]) for r in scrape(dom, Planner(dom), t, smart=False).collect()}
    assert plain == {k: n if k in ("literal", "similar") else 0 for k, n in sizes.items()}


def test_selectors_that_cannot_be_planned_are_errors(spark, dom_of):
    from domquarry.plans.compile import Planner

    dom, _ = dom_of([(i, f"https://x/l?page={i}", people(1) + "<a class=next>n</a>") for i in (1, 2, 3)])
    cards = {"label": "people", "selector": "div.card", "is_container": True, "sub_elements": NAMES}
    base = {"url": "https://x/l?page=1"}
    t = templates(spark, base | {"name": "container", "elements": [cards | {"selector": "div:frobnicate("}]},
                  base | {"name": "element", "elements": [cards, {"label": "t", "selector": "h1[[", "is_required": False}]},
                  base | {"name": "next", "elements": [cards], "pagination": {
                      "pattern_type": "button", "next_selector": "a:frobnicate("}},
                  base | {"name": "good", "elements": [cards], "pagination": {"pattern_type": "button", "next_selector": "a.next"}})
    got = {r["template_name"]: (r["success"], r["errors"], len(r["records"])) for r in scrape(dom, Planner(dom), t).collect()}
    assert got == {"container": (False, ["Unsupported selector: div:frobnicate("], 0),
                   "element": (False, ["Unsupported selector: h1[["], 1),
                   "next": (False, ["Unsupported selector: a:frobnicate("], 1), "good": (True, [], 3)}


def test_which_link_a_record_follows(spark, dom_of):
    from domquarry.plans.compile import Planner

    card = ("<div class=card><a class=blog href='/a-blog'>b</a><a class=me href='/lawyer/1'>m</a>"
            "<a class=other href='/other'>o</a></div>")
    dom, _ = dom_of([(1, "https://x/p", card)] + [
        (i, f"https://x{u}", f"<i class=edu>{u}</i>") for i, u in ((2, "/a-blog"), (3, "/lawyer/1"), (4, "/other"))])

    def link(label, cls):
        return {"label": label, "selector": f"a.{cls}", "element_type": "link"}

    def template(name, subs, **more):
        return {"name": name, "url": "https://x/p", "enable_subpage_scraping": True, "elements": [{
            "label": "people", "selector": "div.card", "is_container": True, "sub_elements": subs,
            "subpage_elements": [{"label": "education", "selector": "i.edu"}]} | more]}

    named = [link("page_blog", "blog"), link("profile_link", "me")]
    t = templates(spark, template("last named", named), template("refused", named, follow_links=False),
                  template("first of all", [link("x", "other"), link("y", "blog")], follow_links=True),
                  template("named first", [link("x", "other"), link("page_blog", "blog")], follow_links=True),
                  template("unsaid", [link("x", "other")]),
                  template("text only", [{"label": "profile", "selector": "a.other"}]))
    got = {r["template_name"]: r["records"][0]["fields"].get("education") for r in scrape(dom, Planner(dom), t).collect()}
    assert got == {"last named": ["/lawyer/1"], "refused": None, "first of all": ["/other"], "named first": ["/a-blog"],
                   "unsaid": ["/lawyer/1"], "text only": ["/lawyer/1"]}


def test_batch_keeps_positions_and_repeated_urls(spark, dom_of):
    from domquarry.operators.scrape import scrape_tables
    from domquarry.plans.compile import Planner

    dom, _ = dom_of([(1, "https://x/a", people(2)), (2, "https://x/b", people(1))])
    t = templates(spark, {"name": "n", "url": "https://x/a", "elements": [
        {"label": "people", "selector": "div.card", "is_container": True, "sub_elements": NAMES}]})
    asked = ["https://x/b", "https://x/a", "https://x/none", "https://x/b"]
    urls = spark.createDataFrame([("n", u, i) for i, u in enumerate(asked)], "template_name string, url string, position int")
    got = scrape(dom, Planner(dom), t, urls).orderBy("position").collect()
    assert [(r["position"], r["url"], len(r["records"])) for r in got] == [
        (0, asked[0], 1), (1, asked[1], 2), (2, asked[2], 0), (3, asked[3], 1)]
    assert len(scrape(dom, Planner(dom), t, urls.drop("position")).collect()) == 4
    results, records = scrape_tables(dom, Planner(dom), t, urls)
    assert results.count() == 4 and "records" not in results.columns
    assert sorted((r["index"], r["fields"]["name"][0]) for r in records.collect()) == [(0, "P0"), (0, "P0"), (1, "P1")]
