"""The pipeline's rows against plain Python, stage by stage, on the smallest table."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from domquarry.llm import quality
from tests.llm.test_quality_and_mixing import base
from tests.llm.test_simhash_and_lines import naive_components, naive_fingerprint, naive_lines

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def notice_words(words):
    """Words of notices, phrase by phrase from the left."""
    bare, total = [re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in words], 0
    for size in (2, 3):
        phrases, at = {tuple(p.split()) for p in quality.NOTICES if len(p.split()) == size}, 0
        while at <= len(bare) - size:
            hit = tuple(bare[at:at + size]) in phrases
            total, at = total + size * hit, at + (size if hit else 1)
    return total


def line_fails(line):
    words = WORD.findall(line)
    n, symbols = len(words), sum(c in "#*$%&|<>" for c in line)
    doubled = sum("!!" in w or "??" in w for w in words)
    links = sum(w in quality.SEPARATORS for w in words)
    return n > 0 and (symbols >= 3 and symbols > 0.3 * n or doubled > 0.3 * n
                      or n >= 100 and not any(c in quality.SENTENCE_MARKS for c in line) or links >= 2 and links * 4 >= n
                      or n <= 25 and 2 * notice_words(words) >= n)


def cleaned(text):
    """The text that quality rules leave, None if they reject it."""
    good = [x for x in (text or "").split("\n") if not line_fails(x)]
    n = len(WORD.findall(text or ""))
    lost = n - sum(len(WORD.findall(x)) for x in good)
    return None if base(text)[-1] or lost > 0.3 * n else "\n".join(good)


def texts(df):
    return sorted((r.doc_id, r.text, r.n_chars) for r in df.collect())


def with_copies(spark, folder):
    """The smallest table and, of six long documents, copies on one line, with and without a few more words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = [r for r in docs.orderBy("doc_id").collect() if len(WORD.findall(r.text)) > 300][:6]
    rows = [(k + r.doc_id, " ".join(r.text.split()) + more, r.lang, r.source, 0) for r in long
            for k, more in ((10_000, ""), (20_000, " At the very end."))]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")


def test_run_is_what_plain_python_gives(spark, tmp_path):
    SF = str(tmp_path)
    with_copies(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}

    docs = stages["quality_rules"](spark, docs, SF)
    rows = {i: c for i, t in rows.items() if (c := cleaned(t)) is not None}
    assert texts(docs) == sorted((i, t, len(t)) for i, t in rows.items())

    docs = stages["line_dedup"](spark, docs, SF)
    ordered = sorted(rows.items())
    gone = naive_lines(ordered, 50)
    left = {}
    for k, (i, t) in enumerate(ordered):
        new = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[k])
        if not gone[k] or WORD.search(new):
            left[i] = new
    assert texts(docs) == sorted((i, t, len(t)) for i, t in left.items()) and any(gone.values())

    docs = stages["near_dedup"](spark, docs, SF)
    ids = sorted(left)
    groups = naive_components(ids, [naive_fingerprint(left[i]) for i in ids])
    kept = {i: left[i] for i, g in zip(ids, groups) if g == i}
    assert texts(docs) == sorted((i, t, len(t)) for i, t in kept.items()) and len(kept) < len(left)

    docs = stages["mixing_sources"](spark, docs, SF)
    times = Counter(r.doc_id for r in docs.collect())
    assert set(times) <= set(kept) and max(times.values()) <= 3
    size = {i: len(WORD.findall(t)) for i, t in kept.items()}
    by_source = {}
    for i in kept:
        by_source.setdefault(source[i], []).append(i)
    weights = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(by_source))}
    total, capped = sum(size.values()), {}
    while True:
        share = (total - sum(capped.values())) / sum(w for s, w in weights.items() if s not in capped)
        over = {s: 3 * sum(size[i] for i in ids) for s, ids in by_source.items()
                if s not in capped and share * weights[s] > 3 * sum(size[i] for i in ids)}
        if not over:
            break
        capped |= over
    for s, own in by_source.items():
        target = capped.get(s, share * weights[s])
        smallest = min(size[i] for i in own)
        assert abs(sum(times[i] * size[i] for i in own) - target) <= max(1, smallest)

    packed = corpus_pipeline.run(spark, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, n in times.items():
        data = np.asarray([*t.encode(kept[i], add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(data), 4096)):
            part = data[at:at + 4096]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1])
        assert sum(n for _, n in own) <= 4096
    assert len(places) <= 1.02 * sum(r.length for r in packed) / 4096 + 1
