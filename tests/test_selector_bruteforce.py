"""The join-based selector plans against a brute-force matcher.

Random small pages (seeded) and random selectors from the grammar's core
(tags, classes, attributes, ``:nth-child``, ``:first-child``, descendant,
child and ``+`` combinators, ``:not``, ``:has``); every selector runs once
over all pages in Spark and is compared with a direct walk of the parsed
tree in Python.
"""

import random

from domquarry.functions.htmltree import parse_page

TAGS = ["div", "p", "span", "ul", "li", "a"]
CLASSES = ["x", "y", "z"]


def _random_html(rng, depth=0):
    parts = []
    for _ in range(rng.randint(1, 3 if depth < 3 else 1)):
        tag = rng.choice(TAGS)
        cls = rng.sample(CLASSES, rng.randint(0, 2))
        attrs = (f' class="{" ".join(cls)}"' if cls else "") + (' data-k="v"' if rng.random() < 0.2 else "")
        inner = _random_html(rng, depth + 1) if depth < 3 and rng.random() < 0.7 else "t"
        # p and li auto-close rules would reshape the tree: keep them closed
        parts.append(f"<{tag}{attrs}>{inner}</{tag}>")
    return "".join(parts)


def _random_compound(rng):
    s = rng.choice(TAGS + ["*"])
    r = rng.random()
    if r < 0.3:
        s += "." + rng.choice(CLASSES)
    elif r < 0.4:
        s += "[data-k]"
    elif r < 0.55:
        s += rng.choice([":first-child", ":last-child", ":nth-child(2)", ":nth-child(odd)"])
    elif r < 0.62:
        s += ":not(." + rng.choice(CLASSES) + ")"
    elif r < 0.68:
        s += ":has(> " + rng.choice(TAGS) + ")"
    return s


def _random_selector(rng):
    s = _random_compound(rng)
    for _ in range(rng.randint(0, 2)):
        s += rng.choice([" ", " > ", " + "]) + _random_compound(rng)
    return s


# -- brute force -------------------------------------------------------------

def _nodes(html):
    r = parse_page(html)
    out = []
    for i in range(1, len(r["node_id"])):
        out.append({"id": i, "parent": r["parent_id"][i], "tag": r["tag"][i], "classes": set(r["classes"][i]),
                    "attrs": dict(r["attrs"][i]), "ordinal": r["ordinal"][i], "n_sib": r["n_sib"][i],
                    "path": r["path"][i]})
    return {n["id"]: n for n in out}


def _compound_ok(n, comp, nodes):
    import re
    m = re.match(r"^([a-z*]+)(.*)$", comp)
    tag, rest = m.group(1), m.group(2)
    if tag != "*" and n["tag"] != tag:
        return False
    if rest.startswith("."):
        return rest[1:] in n["classes"]
    if rest == "[data-k]":
        return "data-k" in n["attrs"]
    if rest == ":first-child":
        return n["ordinal"] == 1
    if rest == ":last-child":
        return n["ordinal"] == n["n_sib"]
    if rest == ":nth-child(2)":
        return n["ordinal"] == 2
    if rest == ":nth-child(odd)":
        return n["ordinal"] % 2 == 1
    if rest.startswith(":not(."):
        return rest[6:-1] not in n["classes"]
    if rest.startswith(":has(> "):
        t = rest[7:-1]
        return any(c["parent"] == n["id"] and c["tag"] == t for c in nodes.values())
    return rest == ""


def _brute(nodes, selector):
    import re
    tokens = re.split(r"( > | \+ | )", selector)
    comps, combs = tokens[0::2], tokens[1::2]
    cur = {i for i, n in nodes.items() if _compound_ok(n, comps[0], nodes)}
    for comb, comp in zip(combs, comps[1:]):
        nxt = set()
        for i, n in nodes.items():
            if not _compound_ok(n, comp, nodes):
                continue
            if comb == " " and any(a in cur for a in n["path"]):
                nxt.add(i)
            elif comb == " > " and n["parent"] in cur:
                nxt.add(i)
            elif comb == " + " and any(nodes[j]["parent"] == n["parent"] and nodes[j]["ordinal"] == n["ordinal"] - 1
                                       for j in cur):
                nxt.add(i)
        cur = nxt
    return cur


def test_selectors_match_brute_force(dom_of):
    rng = random.Random(7)
    pages = [(i, f"https://t/{i}", "<html><body>" + _random_html(rng) + "</body></html>") for i in range(25)]
    dom, planner = dom_of(pages)
    parsed = {pid: _nodes(h) for pid, _, h in pages}
    for _ in range(14):
        sel = _random_selector(rng)
        got = {(r["page_id"], r["node_id"]) for r in planner.select(sel).select("page_id", "node_id").collect()}
        want = {(pid, i) for pid, nodes in parsed.items() for i in _brute(nodes, sel)}
        assert got == want, sel
