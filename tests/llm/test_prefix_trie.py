"""The prefix trie of rebuilt conversations against a dictionary of prefixes."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from domquarry.llm import prefixtrie

ROWS = "conv_id long, turn long, role string, text string"


def _rebuilt(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            conv[c].append((turn is not None, turn or 0, tie, role, text))
    out = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        lender = c - int(math.fmod(c, 5))
        out[c] = [t[3:] for t in sorted(conv.get(lender, []))[:h]] + [t[3:] for t in sorted(own)[h:]]
    return out


def _trie(rows):
    whole = _rebuilt(rows)
    members, kids, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
            if d:
                kids[tuple(whole[c][:d - 1])].add(tuple(whole[c][:d]))
        ends[tuple(whole[c])].append(c)
    leaves, saved, out = defaultdict(int), defaultdict(int), set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        if p:
            saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode())
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
        out.add((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p],
                 hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return out


def _run(spark, rows, schema=ROWS):
    got = [tuple(r) for r in prefixtrie.trie(spark.createDataFrame(rows, schema)).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def _conversations(seed, n, longest):
    """Few different turns, so prefixes are shared at every depth; gaps in the ids, repeated turns and rows."""
    rng, rows = np.random.default_rng(seed), []
    for c in rng.permutation(2 * n)[:n]:
        for t in range(int(rng.integers(1, longest))):
            word = "\u00e9" * int(rng.integers(0, 3))
            rows.append((int(c), int(t), str(rng.choice(["user", "bot"])), word if rng.random() < .9 else None))
    rows += [rows[0], rows[1], (rows[2][0], None, None, "first"), (None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("block, run, fan_in, piece", [(64, 8192, 64, 256), (3, 7, 2, 2), (1, 4, 3, 1)])
def test_equals_dictionary_of_prefixes(spark, monkeypatch, block, run, fan_in, piece):
    for name, value in (("BLOCK", block), ("RUN", run), ("FAN_IN", fan_in), ("PIECE", piece), ("HOP", 2)):
        monkeypatch.setattr(prefixtrie, name, value)
    rows = _conversations(block, 150, 12)
    # one conversation that many hold, and one of many turns
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(10)]
    rows += [(2000 + c, t, "bot", "la" * (t % 3)) for c in (0, 5, 10) for t in range(150 + c % 10)]
    assert _run(spark, rows) == _trie(rows)


def test_no_turns_negative_ids_and_extra_columns(spark):
    rows = [(-7, 0, "user", "a"), (-5, 0, "user", "a"), (0, 0, "", ""), (1, 0, None, None), (4, 1, "x", "y")]
    assert _run(spark, rows) == _trie(rows)
    wide = [(*r, 5, "k") for r in rows]
    assert _run(spark, wide, ROWS + ", depth int, key string") == _trie(rows)
    assert _run(spark, []) == set()
    assert _run(spark, [(None, 1, "a", "b")]) == set()


def test_role_and_text_are_told_apart(spark):
    rows = [(0, t, "ab", "c") for t in range(9)] + [(5, t, "a", "bc") for t in range(9)]
    assert _run(spark, rows) == _trie(rows)


def test_merging_runs_equals_one_run():
    rng = np.random.default_rng(2)
    strings = sorted(b"".join(bytes([x]) * 16 for x in rng.integers(0, 2, int(rng.integers(0, 7)))) for _ in range(300))

    def fresh(part):
        return [((0, 0, 0), s, list(range(10)), {len(s) >> 4: [1, c, 0, 0, 0, [], [c], False, False]}) for c, s in part]

    rows = list(enumerate(strings))
    whole = prefixtrie.Forest()
    assert whole.merge(fresh(rows), 0, True) == []
    cut = prefixtrie.Forest()
    left = []
    for k in range(0, 300, 17):
        left += cut.merge(fresh(rows[k:k + 17]), k, False)
    cut.merge(left, 999, True)
    plain = lambda forest: sorted((n[0], n[1], *n[2:7]) for n in forest.nodes)
    assert plain(whole) == plain(cut)
