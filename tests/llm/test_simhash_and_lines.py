"""SimHash groups and repeated line runs against brute force."""

import random

import pytest
import xxhash

from domquarry.llm import linededup, simhash
from domquarry.llm.components import components


def naive_fingerprint(text, k=3):
    import re

    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(ids, fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return [best.get(find(i)) for i in range(len(fps))]


def test_fingerprints():
    for text in [None, "", " \n", "One", "one TWO", "one two three", "É ÉÉ é\x1cx a b", "a b c a b c a b c d " * 50]:
        assert simhash.fingerprint(text) == naive_fingerprint(text)


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(1, 150))
        rows.append((i, " ".join(words)))
        for j in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + 10 * i + j, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (4999, "  "), (None, rows[0][1]), (None, None), (rows[3][0], rows[3][1]), (None, "alone here now")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"segments": 3, "tile": 4}, {"segments": 4, "tile": 2}])
def test_near_duplicates(spark, options):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, cell int")
    got = simhash.near_duplicates(docs, **options).collect()
    fps = [naive_fingerprint(t) for _, t in rows]
    want = naive_components([d for d, _ in rows], fps)
    key = str
    assert sorted(map(tuple, got), key=key) == sorted(
        [(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, want)], key=key)
    stay = simhash.one_of_each(docs, **options)
    assert stay.columns == docs.columns
    groups = {}
    for (d, _), f, c in zip(rows, fps, want):
        groups.setdefault(c, []).append(d)
    assert sorted((r.doc_id for r in stay.collect()), key=str) == sorted(groups, key=str)


def test_links_reach_every_pair(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:150]:
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    fps = sorted(fps)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = naive_components(fps, fps)
    for options in ({"segments": 1, "tile": 7}, {"segments": 5}, {}):
        got = {r.fp % (1 << 64): r.root for r in simhash.groups(rows, **options).collect()}
        assert len(set(zip(want, (got[f] for f in fps)))) == len(set(want)) == len(set(got.values()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.one_of_each(docs).count() == 0
    assert linededup.without_later_copies(docs).count() == 0 and linededup.cleaned_documents(docs).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(50)] + [(900, 900)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root


def naive_lines(rows, min_words):
    """Texts without lines of runs that stand earlier, by trying every run."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    spoken = {i: [(k, x) for k, x in enumerate((rows[i][1] or "").split("\n")) if x.strip(" \t\n\x0b\f\r")] for i in order}
    seen, gone = set(), {i: set() for i in order}
    places = [(i, s) for i in order for s in range(len(spoken[i]))]
    for i, s in places:
        run = []
        for e in range(s, len(spoken[i])):
            run.append(spoken[i][e][1])
            if tuple(run) not in seen:
                continue
            if sum(len(x.split()) for x in run) >= min_words:
                gone[i] |= {k for k, _ in spoken[i][s:e + 1]}
        for e in range(s, len(spoken[i])):
            seen.add(tuple(x for _, x in spoken[i][s:e + 1]))
    return gone


@pytest.mark.parametrize("min_words", [1, 4, 9, 50])
def test_repeated_runs(spark, min_words):
    rng = random.Random(min_words)
    lines = ["a", "b c", "d e f", "g h i j k", "", " ", "l", "m n"] + [f"only {i} here" for i in range(6)]
    passage = [f"passage line {i} of seven words" for i in range(12)]
    rows = []
    for i in range(60):
        body = rng.choices(lines, k=rng.randint(0, 12))
        if rng.random() < 0.4:
            at, a = rng.randint(0, len(body)), rng.randint(0, 6)
            body[at:at] = passage[a:a + rng.randint(1, 12)]
        rows.append((i, "\n".join(body)))
    rows += [(100, None), (101, ""), (5, rows[5][1]), (None, rows[20][1]), (103, "\n".join(passage * 2)), (104, rows[30][1])]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows],
                                 "doc_id long, text string, no string, n_deleted int").coalesce(1)
    got = linededup.without_later_copies(docs, min_words).collect()
    gone = naive_lines(rows, min_words)
    want = [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone[i]))
            for i, (d, t) in enumerate(rows)]
    assert sorted([(r.doc_id, r.text, r.n_deleted) for r in got], key=str) == sorted(want, key=str)
    clean = linededup.cleaned_documents(docs.withColumnRenamed("no", "n_lines"), min_words)
    assert clean.columns == ["doc_id", "text", "n_lines", "n_deleted"]
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=str) == sorted(
        [(d, t) for d, t, n in want if not n or t.strip()], key=str)
