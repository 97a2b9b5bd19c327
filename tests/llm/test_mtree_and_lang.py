"""Top-k search against all scores, language scores against all segmentations."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from domquarry.llm import langid, mtree


def brute(rows, k, every):
    good = []
    for vec_id, e in rows:
        if vec_id is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        good.append((vec_id, [math.floor(256 * x) for x in e]))
    out = set()
    for q, x in {(i, tuple(x)) for i, x in good if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(x) == len(y))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("options", [{}, {"tree_points": 16, "page": 4, "task_queries": 3, "block": 2}])
def test_top_k(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([0.1, 1, 3])]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + 10 * i, rows[10][1]) for i in range(20)]
    rows += [(400, None), (410, [0.5, None, 1.0, 1.0, 1.0, 1.0]), (420, [float("nan")] * 6), (430, [float("inf")] * 6),
             (None, rows[1][1]), (440, [1.0, 2.0]), (450, [2.0, 1.0]), (460, []), (470, []), (30, rows[30][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, tree string")
    got = mtree.nearest_rows(df, every=10, **options).collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 10) and len(got) == len({tuple(r) for r in got})
    assert mtree.nearest_rows(df.limit(0)).count() == 0


def test_stored_distances_save_work():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 4))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-20, 20, (4000, 4))).astype(np.int64)
    x = np.unique(x, axis=0)
    space = mtree.Space(int((x * x).sum(axis=1).max()))
    pages = mtree.build(space.points(x), 32)
    assert all(len(p["rows"]) <= 32 for p in pages)
    leaves = np.concatenate([p["rows"] for p in pages if p["leaf"]])
    assert sorted(leaves) == list(range(len(x)))
    rows = [{"page": i, "leaf": p["leaf"], "n": len(p["rows"]), "vectors": x[p["rows"]].astype("<i4").tobytes(),
             "child": p["child"].astype("<i4").tobytes(), "radius": p["radius"].astype("<f8").tobytes(),
             "parent": p["parent"].astype("<f8").tobytes(), "ids": [[int(r)] for r in p["rows"]],
             "router": x[0].tolist()} for i, p in enumerate(pages)]
    tree = mtree.Tree(rows, space, 4)
    for q in range(0, len(x), 97):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(len(x)) if i != q)[:5]
        assert tree.search(q, x[q], 5, math.inf) == [(-s, i) for s, i in want]
    assert tree.computed < 0.5 * len(x) * len(range(0, len(x), 97))


VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    with open(VOCABULARY, "rb") as f:
        return langid.Vocabulary(f.read())


def test_forward_sums_all_segmentations(vocabulary):
    rng = np.random.default_rng(0)
    table = np.log(rng.dirichlet(np.ones(vocabulary.size) * 0.5, 3).T + 1e-12)
    model = langid.Model(vocabulary, table)

    def total(text):
        """Probability of ``text`` by recursion over its first piece."""
        if not text:
            return np.ones(3)
        out = np.zeros(3)
        for n in range(1, len(text) + 1):
            if text[:n] in vocabulary.ids:
                out += np.exp(table[vocabulary.ids[text[:n]]]) * total(text[n:])
        if text[0] not in vocabulary.ids:
            out += np.exp(table[vocabulary.bytes[list(text[0].encode())]].sum(axis=0)) * total(text[1:])
        return out

    words = ["the", "a", "straße", "word", "ꙮx", "añb", "the", "𐍈"]
    assert np.allclose(model.words(words), np.log([total("▁" + w) for w in words]))
    long = model.words(["ab" * 3000])
    assert np.isfinite(long).all()


def test_letter_words():
    assert langid.letter_words("It's 3 x² AND_so Éa") == ["it", "s", "x²", "and", "so", "éa"]
    assert langid.letter_words("²³ 123 !_") == [] and langid.letter_words(None) == []


def test_identified(spark):
    rng = random.Random(0)
    words = {"en": "the of and house water light under", "de": "der und haus wasser licht unter straße",
             "fr": "les des maison eau lumière sous être"}
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=12)), lang, "x")
            for i, lang in enumerate(rng.choices(list(words), k=300))]
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "123 ²", "de", "x"), (None, "the house", "en", "x"),
             (1003, "und das wasser", None, "x"), (5, rows[5][1], rows[5][2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identified(docs, VOCABULARY).collect()
    assert len(got) == len(rows)
    import zlib
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "en", "de"]
    assert all(by_id[i] == lang for i, _, lang, _ in rows[:300])
    nothing = langid.identified(docs.filter("lang IS NULL"), VOCABULARY).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identified(docs.limit(0), VOCABULARY).count() == 0
