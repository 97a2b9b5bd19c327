"""Tree building on broken markup (pure Python, no Spark)."""

from domquarry.functions.htmltree import parse_page


def _tree(html):
    r = parse_page(html)
    text = r["doc_text"][0]
    out = []
    for i in range(1, len(r["node_id"])):
        out.append((r["tag"][i], r["parent_id"][i], text[r["text_start"][i]:r["text_end"][i]]))
    return r, out


def test_unclosed_p_and_b():
    r, t = _tree("<article><p><b>Lead<br><p>Second</p></article>")
    tags = [x[0] for x in t]
    assert tags == ["article", "p", "b", "br", "p"]
    # the unclosed b ends with its p; the second p is a sibling of the first
    assert t[1][1] == t[4][1] == 1
    assert t[2][2] == "Lead"
    assert t[4][2] == "Second"


def test_li_closes_li_and_void_tags():
    r, t = _tree("<ul><li>a<li>b<img src=x><li>c</ul>")
    lis = [x for x in t if x[0] == "li"]
    assert [x[2] for x in lis] == ["a", "b", "c"]
    assert all(x[1] == 1 for x in lis)
    img = [i for i, x in enumerate(t) if x[0] == "img"][0]
    assert r["n_sib"][img + 1] == 1


def test_script_text_is_raw_and_excluded():
    r, t = _tree('<head><script>var t="</p>";</script></head><body><p>x</p></body>')
    assert r["doc_text"][0] == "x"
    assert [x[0] for x in t] == ["head", "script", "body", "p"]


def test_entities_and_uppercase_and_attrs():
    r, t = _tree('<DIV CLASS="a  b" data-x="&amp;&quot;">Tom &amp; Jerry &copy;</DIV>')
    assert t[0][0] == "div"
    assert r["classes"][1] == ["a", "b"]
    assert dict(r["attrs"][1])["data-x"] == '&"'
    assert t[0][2] == "Tom & Jerry ©"


def test_outer_html_offsets():
    html = '<div id="a"><span>x</span></div>'
    r = parse_page(html)
    i = r["tag"].index("span")
    assert html[r["html_start"][i]:r["html_end"][i]] == "<span>x</span>"
    assert html[r["html_start"][1]:r["html_end"][1]] == html


def test_empty_and_stray_end_tags():
    r = parse_page("")
    assert r["tag"] == ["#document"]
    r, t = _tree("</div><p>a</span></p>")
    assert [x[0] for x in t] == ["p"]


def test_positions():
    r = parse_page("<ul><li>a</li><b>x</b><li>b</li></ul>")
    lis = [i for i, tg in enumerate(r["tag"]) if tg == "li"]
    assert [r["ordinal"][i] for i in lis] == [1, 3]
    assert [r["type_ordinal"][i] for i in lis] == [1, 2]
    assert all(r["type_count"][i] == 2 for i in lis)
    assert r["path"][lis[0]] == [1]
