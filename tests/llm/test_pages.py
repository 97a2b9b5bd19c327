"""Wrappers and WARC archives: planted pages, exact round trips, damage."""

import base64
import hashlib
import io
import random

import pytest

from domquarry.llm import warc, wrappers

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"


def page(article, more=""):
    return (HEAD + "<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>"
            f"<article>{article}</article>{more}<footer>&copy; host</footer></body></html>")


def text_of(html):
    p = wrappers.Page(html)
    return p.texts(wrappers.region_of(p.skeleton()))


@pytest.mark.parametrize("article,want", [
    ("<h1>Head &amp; line</h1><p>One<br>two <b>bo</b>ld</p><p>Three", "Head & line One two bold Three"),
    ("<h1>A</h1><p><b>open<br><p>next</p><div class=ad>Buy!</div><p>last &lt;tag&gt; &copy &#233;</p>",
     "A open next last <tag> © é"),
    ("<p>x</p><form><label>Mail</label><input></form><aside>side</aside><!-- <p>no</p> --><p>y</p>", "x y"),
    ("<p>a</p><ul><li>one<li>two</ul><table><tr><td>c<td>d</table>", "a one two c d"),
    ("<p>a < b and 5 <6</p><p title=\"a>b\">q</p><script>if (a<b) '</div>'</script>z", "a < b and 5 <6 q z"),
    ("<p>main</p><section class='comments'><p>first!</p></section>", "main"),
    ("<header><h1>Title</h1></header><div class='entry-header'>By me</div><p>x</p><footer>tags</footer>", "Title By me x"),
    ("<p>a\n \t b c</p><span hidden>no</span><span class=\"share-bar\">tweet</span>", "a b c"),
])
def test_article(article, want):
    assert text_of(page(article)) == want


def test_other_layouts():
    body = "".join(f"<p>Paragraph {i} of the story with some words in it.</p>" for i in range(6))
    want = " ".join(f"Paragraph {i} of the story with some words in it." for i in range(6))
    assert text_of(HEAD + f"<header>Site</header><div id=wrap><div class=sidebar>links</div><div class=post>{body}</div>"
                   "<div id=comments><p>nice</p></div></div>") == want
    assert text_of(HEAD + f"<main>{body}</main><div>other</div>") == want
    assert text_of(HEAD + f"<div class='page-header'>Site name</div><div class=text>{body}</div>") == want
    assert text_of("no markup at all &amp; more") == "no markup at all & more"
    assert text_of("") == "" and text_of(None) == ""
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert text_of(deep) == "deep"
    assert text_of("<p>" + "<b>x" * 2000) == "x" * 2000


def test_alignment():
    a = wrappers.Page("<article><h1>t</h1><p>1</p><p>2</p></article>").skeleton()
    b = wrappers.Page("<article><h1>t</h1><h2>s</h2><p>1</p></article>").skeleton()
    both = wrappers.merge(a, b)
    assert wrappers.expression(both) == "<article><h1>#</> <h2>#</>? <p>#</>+</>"
    turns = wrappers.Page("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>").skeleton()
    assert wrappers.expression(turns) == "<dl>(<dt>#</> <dd>#</>)+</>"
    assert wrappers.amounts(wrappers.filled(wrappers.shape(both), iter(wrappers.amounts(both)))) == wrappers.amounts(both)


def test_main_text(spark):
    rows = [(i, f"https://h{i % 3}.example/{i}", page(f"<h1>T{i}</h1>" + "<p>x</p>" * (i % 5))) for i in range(40)]
    # a bare page: its host's wrapper tells where the story is
    story = "".join(f"<div class=box><div class=story><p>{w}</p></div><div class=x>{w}</div></div>" for w in ("long " * 30,))
    rows += [(100, "https://s.example/1", HEAD + story), (101, "https://s.example/2", HEAD + story),
             (102, None, None), (103, "not a url", ""), (None, "https://h0.example/9", page("<p>null id</p>")),
             (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, text int")
    got = wrappers.main_text(df.repartition(4)).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    for i in range(40):
        assert by_id[i].text == " ".join([f"T{i}"] + ["x"] * (i % 5)) and by_id[i].n_chars == len(by_id[i].text)
    assert by_id[102].text == by_id[103].text == "" and by_id[None].text == "null id"
    found = {r.host: r.wrapper for r in wrappers.wrappers(df).collect()}
    assert "<article><h1>#</>? <p>#</>+?</>" in found["h0.example"]
    assert wrappers.main_text(df.limit(0)).count() == 0


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_archives(spark, min_bytes):
    rng = random.Random(0)
    rows = [(i, f"http://a.example/{i} \n?é", "<p>" + "".join(rng.choices("abc é\r\n", k=rng.randint(0, 300)))) for i in range(200)]
    rows += [(300 + i, None, rows[5][2]) for i in range(30)] + [(1, "u", rows[5][2])]
    rows += [(400, "u", None), (401, "u", ""), (402, "u", ""), (5, rows[5][1], rows[5][2]), (None, "u", rows[6][2]),
             (None, None, "nobody else"), (500, "u", "\r\n\r\n" * 10), (501, "u", "\r\n\r\n" * 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    got = warc.round_trip(df.repartition(3), min_bytes).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        data = (h or "").encode()
        first[data] = min(first.get(data, (True, 0)), (i is None, i or 0))
    used, want = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (h or "").encode()
        own = len(data) < min_bytes or data not in used
        used.add(data)
        want.append((i, len(data), sha(data), "response" if own else "revisit", None if own else first[data][1]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_format():
    records = [warc.record(i, i, f"http://x/{i}", b"<p>some page text %d</p>" % i * 5, None) for i in range(900)]
    out = io.BytesIO()
    assert warc.write_archive(out, records) == 900
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.DICT_MAGIC
    for step in (1, 7, 1 << 20):
        if step > 1 or len(data) < 1 << 20:
            assert list(warc.read_archive(io.BytesIO(data), step)) == records
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))
    few = io.BytesIO()
    warc.write_archive(few, records[:2])
    assert list(warc.read_archive(io.BytesIO(few.getvalue()))) == records[:2]
    assert list(warc.read_archive(io.BytesIO(b""))) == []


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/9.9", 1), lambda r: r[:-1], lambda r: r + b"x",
    lambda r: r.replace(b"WARC-Date", b"WARC-Dote", 1), lambda r: r.replace(b"page", b"pag3", 2),
    lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1)])
def test_bad_records(change):
    good = warc.record(1, 1, "http://x/", b"<p>page</p>", None)
    assert warc.parse(good)["payload_bytes"] == 11
    with pytest.raises(ValueError):
        warc.parse(change(good))
