"""The one-pass automaton against a brute-force walk and against the joins over the node table."""

import random

from domquarry.operators.extract import extract_elements
from domquarry.operators.onepass import extract_pages
from domquarry.operators.pagescan import count_matches
from domquarry.plans.compile import parse_selector
from domquarry.plans.onepass import Automaton, Page, reads_in_one_pass
from test_selector_bruteforce import _brute, _nodes, _random_html, _random_selector

SELECTORS = [
    "div", "div p", "div > p", "div + p", "div ~ span", "p:nth-child(2n+1)", "*:last-child", "li:nth-last-of-type(1)",
    "div:has(> p)", "div:has(p.x + span)", "div:not(:has(a))", "p, span.x", "[data-k]", "[data-k='v'] > *", ".x.y",
    "[class*='x']", "[class~='y']", "[class!='x y']", "a:contains('t')", ":only-child", "span:empty", "#one", "div:not(.x, .y)",
    "//div/p", "//div//p[2]", "//p[contains(., 't')][2]", "//*[@class and not(@data-k)]", "//div[.//a]", "//div[p or span]",
    "//ul/li[position()<last()]", "//div[a/@class='x']", "//li/text()", "//*[string-length(normalize-space(.)) > 3]",
    "//p[following-sibling::span]", "//p[preceding-sibling::div]", "//div/following-sibling::p", "xpath:/html/body/div",
    "//a[ancestor::ul]", "//a[../span]", "//*[starts-with(@class, 'x')]", "//p[translate(@class, 'xy', 'ab')='a']",
    "//*[concat(@class, '!') = 'z!']",
]


def _pages(seed, n=25):
    rng = random.Random(seed)
    odd = ["", "<p>", "<html><body><div id=one class=' x  y '><p>t<p class=x>t t<span></span></div>", "text only",
           "<div><p class=x>a</p><span>s</span></div><ul><li>t<li>u</ul><div><a class=x>q</a></div>"]
    return [(i, f"https://t/{i}", "<html><body>" + _random_html(rng) + "</body></html>") for i in range(n)] + [
        (n + k, f"https://t/{n + k}", html) for k, html in enumerate(odd)] + [(n + len(odd), None, None)]


def test_automaton_matches_brute_force():
    rng = random.Random(11)
    selectors = [_random_selector(rng) for _ in range(60)]
    automaton = Automaton([(s, parse_selector(s)) for s in selectors])
    for _, _, html in _pages(11):
        found, nodes = automaton.run(Page(html)), _nodes(html or "")
        for s in selectors:
            assert found.get(s, []) == sorted(_brute(nodes, s)), s


def test_automaton_matches_the_joins(dom_of):
    pages = _pages(5, 12)
    dom, planner = dom_of(pages)
    parsed = [(s, parse_selector(s)) for s in SELECTORS]
    assert [s for s, sel in parsed if not reads_in_one_pass(sel)] == []
    automaton = Automaton(parsed)
    got = {(k, pid, i) for pid, _, html in pages for k, nodes in automaton.run(Page(html)).items() for i in nodes}
    want = {(r["key"], r["page_id"], r["node_id"]) for r in planner.select_many(parsed).distinct().collect()}
    assert got - want == set() and want - got == set()
    assert {k for k, _, _ in got} >= set(SELECTORS) - {"//p[preceding-sibling::div]", "//*[concat(@class, '!') = 'z!']"}


def test_walks_up_are_left_to_the_joins():
    for s in ("//p/ancestor::div[1]", "//p/..", "//p/preceding-sibling::*"):
        assert not reads_in_one_pass(parse_selector(s))


def test_deep_nesting_and_long_pages():
    page = Page("<div>" * 3000 + "<p>x</p>" * 2000)
    assert len(Automaton([("p", parse_selector("div div > p"))]).run(page)["p"]) == 2000


ELEMENTS = [
    {"label": "heading", "selector": "h1"},
    {"label": "person name", "selector": "h6.missing"},              # found by a rung of its label
    {"label": "links", "selector": "a", "element_type": "link", "is_multiple": True},
    {"label": "card html", "selector": "div.x", "element_type": "html", "is_required": False},
    {"label": "office location", "selector": "span.none"},           # never an error
    {"label": "own", "selector": "//p/text()", "selector_type": "xpath", "is_multiple": True, "is_required": False},
    {"label": "kind", "selector": "//div/@data-k", "is_required": False},
    {"label": "value", "selector": "div[data-k]", "element_type": "attribute", "attribute_name": "data-k", "is_required": False},
    {"label": "above", "selector": "//b/ancestor::div[1]", "is_required": False},  # over the node table
    {"label": "bad", "selector": "div:frobnicate(", "is_required": False},
    {"label": "box", "selector": "div", "is_container": True},
]
HTML = [
    "<html><body><h1> A </h1><div class='x y' data-k='v'>t <b>bold</b><a href='/p?q=1'>l</a></div><p>one<p>two <i>x</i></body>",
    "<html><body><h2 class='full-name'>Ann</h2><div>no link</div></body></html>",
    "<h1></h1><a>no href</a><a href='#z'>z</a>",
    "",
]


def test_extraction_matches_the_joins(pages_df):
    from domquarry.operators.nodes import build_dom

    rows = [(i, f"https://h.example/d/{i}", h) for i, h in enumerate(HTML)] + [(9, "https://h.example/", None)]
    pages = pages_df(rows)
    got = extract_pages(pages, ELEMENTS, resolve_links=True)
    assert got.columns == ["page_id", "url", "label", "value_ord", "value", "node_id", "error"]
    got = got.collect()
    values, errors = extract_elements(build_dom(pages), ELEMENTS, resolve_links=True)
    key = ("page_id", "label", "value_ord", "value", "node_id")
    assert sorted(tuple(r[c] for c in key) for r in got if r["error"] is None) == sorted(
        tuple(r[c] for c in key) for r in values.collect())
    assert sorted((r["page_id"], r["label"], r["error"]) for r in got if r["error"]) == sorted(
        (r["page_id"], r["label"], r["error"]) for r in errors.collect())
    assert (1, "person name", "Ann") in {(r["page_id"], r["label"], r["value"]) for r in got}


def test_extraction_on_odd_tables(spark, pages_df):
    empty = pages_df([])
    assert extract_pages(empty, ELEMENTS[:1]).collect() == [] and extract_pages(empty, []).collect() == []
    more = spark.sql("SELECT 1L AS page_id, 'https://x/' AS url, '<h1>a</h1>' AS html, 404 AS status, 'b' AS label, 1 AS value")
    more = more.unionByName(more.withColumn("status", more["status"] - 204))
    rows = extract_pages(more, ELEMENTS[:1]).collect()
    assert sorted((r["value"] or "", r["error"] is None) for r in rows) == [("", False), ("a", True)]


def test_counts_in_the_scan_need_no_shuffle(pages_df):
    pages = pages_df([(1, "u", "<p>a<p>b<b>c</b>"), (2, "u", None)]).coalesce(1)
    counts = count_matches(pages, [parse_selector("p"), parse_selector("p b"), parse_selector("p, b")])
    assert sorted(map(tuple, counts.collect())) == [(1, 0, 2), (1, 1, 1), (1, 2, 3)]
