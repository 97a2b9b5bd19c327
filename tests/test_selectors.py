"""Selector grammar and matching through the node table."""

import pytest

from domquarry.operators.values import node_values
from domquarry.plans.ast import SelectorError
from domquarry.plans.compile import is_xpath, normalise_xpath
from domquarry.plans.css import parse_css, split_top_level
from domquarry.plans.xpath import parse_xpath

HTML = """<html><body>
<div class="people-list" id="list">
  <div class="profile-card"><h3>Ann Lee</h3><span class="position">Partner</span>
    <a href="mailto:ann@x.com">ann@x.com</a><a class="profile" href="/lawyer/1">Profile</a></div>
  <div class="profile-card"><h3>Bob Stone</h3><span class="position">Associate</span>
    <a class="profile" href="/lawyer/2">Profile</a></div>
  <div class="other"><h3>Not a card</h3></div>
</div>
<ul class="education"><li>First</li><li>Second</li><li>Third</li></ul>
</body></html>"""


def _texts(dom, planner, sel, **kw):
    m = planner.select(sel, **kw)
    return sorted(r["value"] for r in node_values(dom, m, "text").collect())


def test_css_parse_errors():
    with pytest.raises(SelectorError):
        parse_css("div::before")
    with pytest.raises(SelectorError):
        parse_css("")
    assert split_top_level("a:has(b, c), d") == ["a:has(b, c)", " d"]


def test_xpath_detection():
    assert is_xpath("//div") and is_xpath("xpath:.//a") and is_xpath("normalize-space(x)")
    assert not is_xpath("div.a")
    assert normalise_xpath("xpath://a") == "//a"
    assert normalise_xpath("h1[normalize-space()]") == "//h1[normalize-space()]"
    with pytest.raises(SelectorError):
        parse_xpath("//div[")


def test_css_combinators_and_pseudos(dom_of):
    dom, planner = dom_of([(1, "https://x.com/people", HTML)])
    assert _texts(dom, planner, "div.profile-card > h3") == ["Ann Lee", "Bob Stone"]
    assert _texts(dom, planner, ".people-list h3") == ["Ann Lee", "Bob Stone", "Not a card"]
    assert _texts(dom, planner, "h3 + span") == ["Associate", "Partner"]
    assert _texts(dom, planner, "ul.education li:nth-of-type(n+2)") == ["Second", "Third"]
    assert _texts(dom, planner, "li:first-child") == ["First"]
    assert _texts(dom, planner, "li:last-child") == ["Third"]
    assert _texts(dom, planner, "a[href^='mailto:']") == ["ann@x.com"]
    assert _texts(dom, planner, "div:has(a[href*='/lawyer/']) > h3") == ["Ann Lee", "Bob Stone"]
    assert _texts(dom, planner, "div:not(.profile-card) > h3") == ["Not a card"]
    assert _texts(dom, planner, "span:contains('Partner')") == ["Partner"]
    assert _texts(dom, planner, "#list > .other h3, li:last-child") == ["Not a card", "Third"]


def test_xpath_matching(dom_of):
    dom, planner = dom_of([(1, "https://x.com/people", HTML)])
    assert _texts(dom, planner, "//div[contains(@class,'profile-card')]/h3") == ["Ann Lee", "Bob Stone"]
    assert _texts(dom, planner, "//li[2]") == ["Second"]
    assert _texts(dom, planner, "//h3[normalize-space()='Bob Stone']") == ["Bob Stone"]
    assert _texts(dom, planner, "//a[starts-with(@href,'/lawyer/')]/ancestor::div[1]/h3") == ["Ann Lee", "Bob Stone"]
    assert _texts(dom, planner, "//span[text()='Partner']/../h3") == ["Ann Lee"]
    assert _texts(dom, planner, "//li[position()>1 and string-length(.)>5]") == ["Second"]


def test_scoped_selection_and_first_match(dom_of):
    from pyspark.sql import functions as F
    dom, planner = dom_of([(1, "https://x.com/people", HTML)])
    cards = planner.select("div.profile-card").select("page_id", F.col("node_id").alias("scope_id"))
    hits = planner.select("a[href^='mailto:']", scope=cards).count()
    assert hits == 1
    first = planner.select_first(["a[href^='tel:']", "a.profile", "a"], scope=cards)
    assert sorted(r["priority"] for r in first.collect()) == [1, 1]


def test_ancestor_positions(dom_of):
    html = '<div class="a"><section><div class="b"><p><span>x</span></p></div></section></div>'
    dom, planner = dom_of([(1, "https://x/", html)])

    def tags(sel):
        m = planner.select(sel).select("page_id", "node_id")
        n = dom.nodes.select("page_id", "node_id", "tag", "classes")
        return sorted((r["tag"], tuple(r["classes"])) for r in m.join(n, ["page_id", "node_id"]).collect())

    assert tags("//span/ancestor::*[1]") == [("p", ())]
    assert tags("//span/ancestor::div[1]") == [("div", ("b",))]
    assert tags("//span/ancestor::*[position()<=3 and @class]") == [("div", ("b",))]
    assert tags("//span/ancestor::*[position()=last()]") == [("div", ("a",))]  # the root element
