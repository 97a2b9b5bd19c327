"""Templates as data: defaults, validation, audit rules."""

import json

from pyspark.sql import functions as F

from domquarry.operators.analyze import audit, repair_sublinks
from domquarry.sources.templates import (normalise_template, read_templates, template_catalog,
                                         template_violations, templates_from_json)

ROSTER = {
    "name": "Roster", "url": "https://chess.test/club/players",
    "elements": [{"label": "rows", "selector": "tr.player", "is_container": True,
                  "sub_elements": [{"label": "who", "selector": "td.who"}, {"label": "rating", "selector": "td.elo"},
                                   {"label": "card", "selector": "td.who a", "element_type": "link"}]}],
    "actions": [{"label": "sublink", "selector": "td a", "target_url": "https://chess.test/lawyer/7"}],
    "pagination": {"pattern_type": "button", "next_selector": "a.more-rows", "max_pages": 3},
}


def test_defaults():
    t = normalise_template({"name": "n", "url": "https://a.b/", "elements": [{"label": "x", "selector": "h1"}],
                            "scroll_config": {"type": "infinite_scroll", "selector": ".more"}})
    e = t["elements"][0]
    assert e["selector_type"] == "css" and e["element_type"] == "text" and e["is_required"] is True
    assert t["pagination"]["pattern_type"] == "infinite_scroll" and t["pagination"]["scroll_pause_time"] == 2.0
    assert t["output_format"] == "json"


def test_violations(spark):
    bad = {"name": "bad", "url": "example.com",
           "elements": [{"label": "a", "selector": "", "selector_type": "regex", "element_type": "image"}],
           "actions": [{"label": "x", "selector": "y", "action_type": "swipe"}], "output_format": "xml"}
    t = templates_from_json(spark.createDataFrame([(json.dumps(bad),), (json.dumps(ROSTER),)], "json string"))
    v = {(r["name"], r["level"], r["message"]) for r in template_violations(t).collect()}
    msgs = {m for n, _, m in v if n == "bad"}
    assert "Invalid URL format" in msgs
    assert "selector_type must be one of css, xpath: regex" in msgs
    assert "element_type must be one of text, attribute, html, link, container, composite: image" in msgs
    assert "action_type must be one of click, scroll, hover, wait, infinite_scroll: swipe" in msgs
    assert "output_format must be one of json, csv, excel: xml" in msgs
    assert ("bad", "warning", "Element has empty selector: a") in v
    assert not any(n == "Roster" for n, _, _ in v)


def test_audit_and_repair(spark):
    t = templates_from_json(spark.createDataFrame([(json.dumps(ROSTER),)], "json string"))
    a = audit(t).collect()[0]
    # the sublink action targets a /lawyer/ page: directory and subpage indicators both fire
    assert a["is_directory"] and a["needs_subpages"] and a["has_pagination"]
    assert a["pagination_location"] == "subpage"
    r = repair_sublinks(t).collect()[0]
    assert r["enable_subpage_scraping"] is True
    assert r["subpage_url_pattern"] == "https://chess.test/lawyer/*"


def test_catalog(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(ROSTER))
    (tmp_path / "a.json").write_text("{not json")
    cat = template_catalog(read_templates(spark, str(tmp_path))).collect()
    assert [r["file"] for r in cat] == ["a.json", "b.json"]
    assert cat[0]["error"] == "unreadable template" and cat[1]["n_elements"] == 1
