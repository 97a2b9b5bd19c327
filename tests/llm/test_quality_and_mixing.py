"""Quality rules against plain Python, mixing against its targets."""

import random
import re
from collections import Counter

from domquarry.llm import mixing, quality

WORD = re.compile("[^\x20\x09-\x0D]+")
_RNG = random.Random(0)
PROSE = [" ".join(f"w{_RNG.randrange(10**6)}" for _ in range(14)) + ", and so on." for _ in range(20)]


def base(text):
    words = WORD.findall(text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_base_measures_and_odd_input(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "a", "a b", "a b a b a b", "x\n\nx\nx\r", "été 日本 🙂 #*$", "a\x0bb\x0cc\x1cd e", "\n".join(PROSE), "w " * 3000]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 90))).replace(" a ", "\n") for _ in range(60)]
    rows = [(i, t, "clash", True) for i, t in enumerate(texts)] + [(0, texts[9], "again", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean")
    got = quality.judged(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.text
        assert not (r.base_failed and r.kept)
    assert quality.judged(docs.limit(0)).count() == 0
    assert quality.kept_documents(docs).columns == docs.columns


def test_line_rules(spark):
    good = "\n".join(PROSE[:8])
    noise = {
        "symbols": " ".join(w + "***" for w in PROSE[11].split()),
        "shouting": " ".join(w.upper() + "!!" for w in PROSE[12].split()),
        "menu": "Home | News | Sport | Weather | Contact |",
        "notice": "Please accept cookies.",
        "run on": " ".join(f"v{i}" for i in range(120)),
    }
    rows = [("clean", good), *((k, good + "\n" + v) for k, v in noise.items()),
            ("mostly noise", "\n".join([PROSE[13]] + [f"{i} " + noise["symbols"] for i in range(9)] + [good[:300]]))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert got["clean"].kept and got["clean"].cleaned == good
    for name in noise:
        assert got[name].cleaned == good, name
        assert got[name].kept == (name != "run on"), name  # 120 of 270 words are more than may go
    assert not got["mostly noise"].kept
    kept = quality.kept_documents(docs.selectExpr("doc_id", "text", "0L AS n_chars", "'c' AS cleaned"))
    assert {r.doc_id: (r.text, r.n_chars, r.cleaned) for r in kept.collect()} == {
        k: (good, len(good), "c") for k in got if k not in ("run on", "mostly noise")}


def test_clean_lines_of_all_scripts_and_with_words_like_notices_stay(spark):
    rng = random.Random(8)
    marks = {"Hindi": "\u0964", "Urdu": "\u06d4", "Amharic": "\u1362", "Armenian": "\u0589", "Burmese": "\u104b", "Khmer": "\u17d4",
             "Chinese": "\u3002", "full width": "\uff01", "Japanese": "\uff1f"}
    rows = [(k, " ".join(f"\u0915{rng.randrange(10**6)}" + (m if i % 12 == 11 else "") for i in range(240))) for k, m in marks.items()]
    lines = ["Their design in wood, and the catalog in print, say more.", "You read more in winter than we do in summer.",
             "To sign in ink was the custom, to log in the forest was not.", "We read morella."]
    rows += [(f"line {i}", "\n".join([*PROSE[:8], x])) for i, x in enumerate(lines)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, text in rows:
        assert got[name].kept and got[name].cleaned == text, name


def test_notices_at_word_boundaries(spark):
    notices = ["All rights reserved.", "\u00a9 All Rights Reserved", "Click here to read more...", "Sign in | Log in", "Privacy policy",
               "Subscribe to our news, share this!"]
    rows = [(x, "\n".join([*PROSE[:8], x])) for x in notices]
    got = quality.judged(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r.kept and r.cleaned == "\n".join(PROSE[:8]) for r in got)


def test_fit_comes_as_near_as_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        sizes = rng.sample(range(0, 30), rng.randint(1, 5))
        counts = [rng.randint(0, 4) for _ in sizes]
        total = sum(s * c for s, c in zip(sizes, counts))
        budget = rng.randint(0, total + 5)
        taken = mixing.fit(sizes, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts))
        sums = {0}
        for s, c, t in zip(sizes, counts, [c * budget // total if total and budget <= total else 0 for c in counts]):
            sums = {x + s * k for x in sums for k in range(t, c + 1)}  # what the proportional part leaves open
        got = sum(s * t for s, t in zip(sizes, taken))
        assert abs(min(budget, total) - got) <= min(abs(min(budget, total) - x) for x in sums)


def test_targets(spark):
    sizes = {"a": 100, "b": 1, "c": 300, "é": 2, "Z": 50, None: 40, "": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r for r in mixing.targets(df).collect()}
    order = ["", "Z", "a", "b", "c", "é", None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    assert {s: r.weight for s, r in got.items()} == weight
    want, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = left / sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 3.0 * sizes[s] if s in capped else share * weight[s] for s in sizes}
    assert all(abs(got[s].target - want[s]) < 1e-9 for s in sizes)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", None, "c"])) for i in range(800)]
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "x y", "c"), *[(7, "same text here", "a")] * 5]
    docs = spark.createDataFrame([(*r, "clash") for r in rows],
                                 "doc_id long, text string, source string, size string")
    first, again = (sorted(map(tuple, mixing.mix(d).drop("text").collect()), key=str)
                    for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(rows)
    by_source = {}
    for r in mixing.mix(docs).collect():
        assert r.size == len((r.text or "").split()) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        by_source.setdefault(r.source, []).append(r)
    for rs in by_source.values():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert abs(sum(r.taken for r in rs) - rs[0].target) < 1
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for rs in by_source.values() for r in rs)
    assert mixing.mix(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(empty).collect()] == [0, 0]
