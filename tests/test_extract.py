"""Extraction, containers and merges (shapes of the reference's tests)."""

from pyspark.sql import functions as F

from domquarry.operators.containers import container_fields, find_containers, records
from domquarry.operators.extract import extract_elements, is_location_element
from tests.test_selectors import HTML


def test_element_types(dom_of):
    dom, planner = dom_of([(1, "https://x.com/dir/people", HTML)])
    els = [
        {"label": "name", "selector": "h3"},
        {"label": "names", "selector": "h3", "is_multiple": True},
        {"label": "link", "selector": "a.profile", "element_type": "link"},
        {"label": "cls", "selector": "ul", "element_type": "attribute", "attribute_name": "class"},
        {"label": "val", "selector": "ul", "element_type": "attribute"},
        {"label": "html", "selector": "li", "element_type": "html"},
    ]
    values, errors = extract_elements(dom, els, planner)
    got = {(r["label"], r["value_ord"]): r["value"] for r in values.collect()}
    assert got[("name", 1)] == "Ann Lee"
    assert [got[("names", i)] for i in (1, 2, 3)] == ["Ann Lee", "Bob Stone", "Not a card"]
    assert got[("link", 1)] == "/lawyer/1"  # page-level links stay raw
    assert got[("cls", 1)] == "education"
    assert got[("val", 1)] == ""
    assert got[("html", 1)] == "<li>First</li>"
    assert errors.count() == 0


def test_required_and_location_rule(dom_of):
    dom, planner = dom_of([(1, "https://x.com/p", HTML)])
    els = [{"label": "phone", "selector": "a[href^='tel:']", "is_required": True},
           {"label": "office location", "selector": ".office", "is_required": True},
           {"label": "fax", "selector": ".fax", "is_required": False}]
    _, errors = extract_elements(dom, els, planner)
    rows = errors.collect()
    assert [r["label"] for r in rows] == ["phone"]
    assert is_location_element("city", "x") and is_location_element("x", "//p[normalize-space()='Dubai']")


def test_containers(dom_of):
    dom, planner = dom_of([(1, "https://x.com/dir/people", HTML)])
    cont = find_containers(planner, ".profile-card")
    subs = [{"label": "name", "selector": "h3"},
            {"label": "email", "selector": "a[href^='mailto:']"},
            {"label": "profile_link", "selector": "a.profile", "element_type": "link"}]
    fields = container_fields(dom, planner, cont, subs)
    recs = {r["container_index"]: r["fields"] for r in records(fields).collect()}
    assert recs[0]["name"] == ["Ann Lee"] and recs[0]["email"] == ["ann@x.com"]
    assert recs[0]["profile_link"] == ["https://x.com/lawyer/1"]  # resolved in containers
    assert "email" not in recs[1]  # a missing sub-element is NULL / absent
    assert recs[1]["profile_link"] == ["https://x.com/lawyer/2"]


def test_merge_related_by_link_or_index(spark):
    from domquarry.operators.merge import merge_related
    rows = [
        (1, "people", 0, 0, "https://x/l/1", "name", 1, "Ann"),
        (1, "people", 0, 1, "https://x/l/2", "name", 1, "Bob"),
        (1, "education container", 1, 0, "https://x/l/1", "education", 1, "MIT"),
        (1, "education container", 1, 5, "", "education", 1, "Yale"),
        (1, "second bio", 2, 1, "", "bio", 1, "Bob bio"),
    ]
    lists = spark.createDataFrame(rows, "page_id long, list_label string, list_order int, record_index int, "
                                        "profile_link string, key string, value_ord int, value string")
    out = merge_related(lists)
    got = {(r["record_index"], r["key"]): r["value"] for r in out.collect()}
    assert got[(0, "education")] == "MIT"          # matched by link
    assert got[(1, "bio_details.bio")] == "Bob bio"  # matched by index, nested
    assert (1, "education") not in got
    assert {r["list_label"] for r in out.collect()} == {"people"}  # subpage lists dropped


def test_flatten(spark):
    from domquarry.operators.scrape import RECORD_TYPE, flatten
    res = spark.createDataFrame(
        [("t", "u", {"tags": ["a", "b", "c"], "title": ["T"], "empty": [], "actions_executed": ["1"]})],
        "template_name string, url string, data map<string,array<string>>").withColumn(
        "records", F.array().cast(RECORD_TYPE))
    got = {r["column"]: r["value"] for r in flatten(res).collect()}
    assert got == {"tags_1": "a", "tags_2": "b", "tags_3": "c", "title": "T", "empty": ""}


def test_nested_containers_duplicate_ids_and_null_html(dom_of):
    html = ('<div class="card" id="dup"><h3>Outer</h3>'
            '<div class="card" id="dup"><h3>Inner</h3></div></div>')
    dom, planner = dom_of([(1, "https://x/a", html), (2, "https://x/b", None)])
    # duplicate ids: both elements match
    assert planner.select("#dup").count() == 2
    cont = find_containers(planner, ".card")
    fields = container_fields(dom, planner, cont, [{"label": "name", "selector": "> h3"},
                                                  {"label": "all", "selector": "h3", "element_type": "text"}])
    recs = {r["container_index"]: r["fields"] for r in records(fields).collect()}
    assert recs[0]["name"] == ["Outer"] and recs[1]["name"] == ["Inner"]   # child step stays in its card
    assert recs[0]["all"] == ["Outer"]                                      # first match in document order
    # a page with NULL html has no nodes; a required element fails it
    values, errors = extract_elements(dom, [{"label": "t", "selector": "h3"}], planner)
    assert {r["page_id"] for r in errors.collect()} == {2}
    assert dom.nodes.where("page_id = 2").count() == 0
