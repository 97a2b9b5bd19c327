"""Pages on which a region or a mark could take text of the article away."""

from domquarry.llm import wrappers
from test_pages import HEAD, text_of


def test_region_keeps_all_blocks_without_an_article():
    body = "<h1>Head</h1>" + "<p>A paragraph of the story, long enough.</p>" * 6 + "<ul><li>one<li>two</ul><blockquote>said</blockquote>"
    want = "Head" + " A paragraph of the story, long enough." * 6 + " one two said"
    assert text_of(HEAD + f"<header>Site</header><div class=content>{body}</div><footer>f</footer>") == want
    parts = f"<div class=wrap><div class=part1>{'first ' * 13}</div><div class=part2>{'second ' * 6}</div></div>"
    assert text_of(HEAD + parts) == " ".join(["first"] * 13 + ["second"] * 6)
    place = wrappers.region_of(wrappers.Page(HEAD + f"<div class=content>{body}</div>").skeleton())
    assert place["places"][0][-1] == "div.content"


def test_attribute_names_only():
    for attrs in ('style="overflow: hidden"', "style='visibility: hidden'", 'title="The hidden cost"', 'data-x = "a hidden class=ad"',
                  "title='x' data-hidden", 'data-class="ad" alt=hidden', "href=/a?hidden", 'title="id=ad" "hidden"'):
        assert text_of(f"<div {attrs}><p>kept</p></div>") == "kept", attrs
    for attrs in ("hidden", 'title="x" hidden', 'HIDDEN=""', "class = 'ad'", "a=b id=sidebar", 'title="x"class="ad"', "x hidden/"):
        assert text_of(f"<div><p>kept</p><div {attrs}>gone</div></div>") == "kept", attrs


def test_marks_are_no_more_than_signs():
    story = "<h1>Head</h1>" + "<p>A paragraph of the story.</p>" * 5
    want = "Head" + " A paragraph of the story." * 5
    for name in ("content has-sidebar", "no-sidebar", "with-ads", "side-by-side", "notice", "widget", "sidebar main"):
        for inner in (f"<article>{story}</article>", f"<main>{story}</main>", story):
            assert text_of(HEAD + f"<nav>n</nav><div class='{name}'>{inner}</div><div class=cookie-bar>c</div>") == want, name
    assert text_of(f"<x-page class=widget><div class=widget-body>{story}</div></x-page>") == want
    inside = ("<section id=related-work><p>Work</p></section><h2 id=search-algorithms>Search</h2><h2 id=comments>On it</h2>"
              "<div class=social-sciences>Sciences</div><div class='side-by-side'>Two</div><div class=notice>Note</div>")
    assert text_of(f"<article>{story}{inside}</article>") == want + " Work Search On it Sciences Two Note"
    gone = ("<div class=related-posts><article>card</article></div><div id=comments>c</div><div class='ad-slot'>b</div>"
            "<span class=share-bar>s</span><div class=social-links>l</div>")
    assert text_of(f"<article>{story}</article>{gone}") == text_of(f"<article>{story}{gone}</article>") == want
    assert text_of(f"<div class=post>{story}{gone.replace('article', 'b')}</div>") == want


def test_pages_of_another_template(spark):
    story = "<h1>Head</h1>" + "<p>A paragraph of the story.</p>" * 5
    want = "Head" + " A paragraph of the story." * 5
    pages = [f"<article>{story}</article><div>more</div>"] * 5 + [
        f"<article></article><div class=body>{story}</div>",
        f"<article><div class=ad>Buy</div></article><div class=body>{story}</div>",
        f"<article>Teaser</article><div class=body>{story}</div>",
        f"<article>Teaser</article><main>{story}</main>",
        f"<div class=widget>{story}</div>"]
    df = spark.createDataFrame([(i, f"https://h.example/{i}", HEAD + p) for i, p in enumerate(pages)],
                               "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == [want] * 5 + [want] * 2 + [
        "Teaser " + want, want, want]
    assert text_of(HEAD + pages[7]) == "Teaser " + want


def test_marks_at_every_depth():
    story = "<h1>Head</h1>" + "<p>A paragraph of the story.</p>" * 5
    want = "Head" + " A paragraph of the story." * 5
    gone = "<nav>n</nav><header>h</header><div class=ad>b</div><div id=comments>c</div><footer>f</footer><p hidden>x</p>"
    n = wrappers.MAX_DEPTH
    for deep in ("<div>" * (n + 5), "<table><tr><td><div>" * n, "<font>" * (n + 5), "<div><span>" * 4 * n):
        assert text_of(HEAD + deep + gone + story) == want
        assert text_of(HEAD + deep + f"<div>other</div><article>{story}</article>{gone}") == want
        assert text_of(HEAD + deep + f"<div>other</div><div class=widget><main>{story}</main></div>{gone}") == want
        assert text_of(HEAD + deep + f"<div class=widget>{story}</div>{gone}") == want
    marked = wrappers.Page("<div class=widget>" * 4 * n + "<article>" * 4 * n + story)
    assert marked.text_by(None) == want
