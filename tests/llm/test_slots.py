"""Texts as tokens of a wrapper: what every page of a host has in one place is the wrapper's own."""

import itertools
import random

from domquarry.llm import wrappers


def _pages(n, more=""):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(10**6)}"
    out = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(word() for _ in range(30))}</p>" for _ in range(rng.randint(2, 4)))
        out.append((f"<html><body><div>The Daily Thing, since 1901</div><div><h1>{word()}</h1>{body}{more}</div>"
                    "<div>Printed on paper by the same people</div></body></html>", i))
    return out


def _texts(spark, rows, host="https://h.example/"):
    pages = spark.createDataFrame([(i, f"{host}{i}", html) for html, i in rows], "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.main_text(pages).collect()}


def test_unmarked_lines_of_a_host_are_left_out_by_its_wrapper(spark):
    rows = _pages(20)
    got = _texts(spark, rows)
    for html, i in rows:
        alone = wrappers.Page(html).text_by(None)
        assert alone.startswith("The Daily Thing") and alone.endswith("same people")
        assert got[i] == alone.removeprefix("The Daily Thing, since 1901 ").removesuffix(" Printed on paper by the same people")
    few = _pages(wrappers.MIN_PAGES - 1)  # too few pages to tell
    assert all("Daily" in t for t in _texts(spark, few).values())


def test_copies_keep_their_text_and_optional_texts_stay(spark):
    same = [(_pages(1)[0][0], i) for i in range(9)]
    assert set(_texts(spark, same).values()) == {wrappers.Page(same[0][0]).text_by(None)}
    rows = _pages(12)
    rows = [(html.replace("</h1>", "</h1><h2>In short</h2>") if i % 2 else html, i) for html, i in rows]
    got = _texts(spark, rows)
    assert all(("In short" in got[i]) == bool(i % 2) for _, i in rows)


def test_hot_host_is_merged_in_a_tree(spark, monkeypatch):
    rows = [(html.replace("</h1>", "</h1>" + "".join(f"<h{2 + (i >> k & 1)}>s{i}</h{2 + (i >> k & 1)}><hr>" for k in range(5))), i)
            for html, i in _pages(32)]
    whole = _texts(spark, rows)
    monkeypatch.setattr(wrappers, "FAN_IN", 4)
    assert _texts(spark, rows) == whole
    assert all("Daily" not in t and "same people" not in t for t in whole.values())


def _aligned(a, b):
    """The longest common subsequence of two key lists, by trying all."""
    for n in range(min(len(a), len(b)), -1, -1):
        for one in itertools.combinations(a, n):
            if one in itertools.combinations(b, n):
                return n


def test_alignment_matches_as_much_as_any(spark):
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([[rng.choice("abcd"), 1, 1, 1, [], rng.choice("xy")] for _ in range(rng.randint(0, 6))] for _ in range(2))
        keys = [n[0] for n in a], [n[0] for n in b]
        if any(x == y for k in keys for x, y in zip(k, k[1:])):
            continue
        fold, wrappers.fold = wrappers.fold, lambda nodes: nodes
        try:
            out = wrappers.align(a, b)
        finally:
            wrappers.fold = fold
        both = [n for n in out if n[1]]
        assert len(both) == _aligned(*keys) and len(out) == len(a) + len(b) - len(both)
        for own in keys:  # the expression matches both lists: they are what is left when optional nodes go
            at = iter(n[0] for n in out)
            assert all(k in at for k in own)
        assert all(n[3] == 2 and n[5] in ("x", "y", wrappers.SLOT) for n in both)
