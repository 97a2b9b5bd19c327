"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

Words of a length are points: how often each letter stands in them.  One replaced
letter moves a word by a squared distance of exactly two inside its length, one
inserted or deleted letter by exactly one into the next length.  So

* words are dealt into **tiles** by their length and the counts of a few common
  letters (more letters the more words there are), some 500 words each;
* a tile meets only the tiles of its own and the next length whose counts an edit
  can reach: a few dozen neighbours, found by an equi-join on the counts;
* for each pair of tiles one **NumPy product** of the count matrices gives all squared
  distances (|a|² + |b|² - 2ab); pairs at two or less stay, and of these the edits
  are verified letter by letter (anagrams and the like fall out).

A word's links are counted and its best one found inside each pair of tiles, then
merged by an aggregate, so links never leave their task one by one.  Comparing
tiles is exact; it grows with the pairs of words of like counts.

Counting: occurrences are aggregated before the shuffle, so a word that is everywhere
costs no task more than its share.  Ids and texts may be null (a null id reads as the
empty string, a null text has no words), rows may repeat (each counts); an empty table
gives no rows; extra columns do not matter.  Ties for a word's form go to the smallest
word in code-point order.  Words may be of any length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domquarry.llm.common import save

MIN_LENGTH = 7
MIN_COUNT = 2
DROP_ONE_IN = 31  # runs whose hash this divides lose a letter
FORM_RATIO = 10  # a word's form is at least so many times as frequent
TILE = 512  # words of a tile, about
FLUSH = 1 << 18  # distinct words a counting task holds before it passes them on

#: Words are of a-z and U+00C0..U+00FF: one byte each in Latin-1, so 26 + 64 columns of counts.
_COLUMN = np.full(256, -1, np.int64)
_COLUMN[97:123] = range(26)
_COLUMN[192:256] = range(26, 90)
N_LETTERS = 90


COUNTED = "word string, n long"
_COUNT_COLUMNS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_RUN = re.compile(f"[a-z\u00C0-\u00FF]{{{MIN_LENGTH},}}")  # shorter runs give no word
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each text, with the lost letters, counted over the texts of a task."""
    held: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        out = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
        held.clear()
        return pa.RecordBatch.from_arrays(out, schema=_COUNT_COLUMNS)

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not text.is_valid:
                continue
            runs = _RUN.findall(text.as_buffer().to_pybytes().translate(_LOWER).decode())
            start = zlib.crc32(f"{name}:".encode())
            losing = [w for w in set(runs) if not zlib.crc32(w.encode(), start) % DROP_ONE_IN]
            held.update(runs)
            here = Counter(runs) if losing else {}
            for word in losing:
                at = zlib.crc32(word.encode(), start) % len(word)
                held[word] -= here[word]
                if len(word) > MIN_LENGTH:
                    held[word[:at] + word[at + 1:]] += here[word]
            if len(held) > FLUSH:
                yield flushed()
    yield flushed()


def word_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> word, n: the words and how often each stands in the texts."""
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string"))
    return (narrow.mapInArrow(_counted, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= MIN_COUNT))


def key_letters(words: DataFrame) -> list[str]:
    """The letters whose counts deal words into tiles, the most frequent first: one more for
    each fourfold number of words.  At most 90 rows reach the driver."""
    n = max(1, round(math.log(max(words.count(), 1) / (4 * TILE), 4)))
    letters = (words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter")
               .agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "letter").limit(n))
    return [row["letter"] for row in letters.collect()]


def _key(letters: list[str]) -> Column:
    """Length and letter counts, as one array."""
    word = F.col("word")
    return F.array(F.length(word), *[F.length(word) - F.length(F.replace(word, F.lit(x))) for x in letters])


def steps(n: int) -> list[list[int]]:
    """What an edit can do to a key of ``n`` letter counts: of each step and its reverse one is
    listed.  The first entry is the change of length."""

    def moved(length: int, **to: int) -> list[int]:
        out = [length] + [0] * n
        for sign, i in to.items():
            out[1 + i] += 1 if sign == "up" else -1
        return out

    same = [moved(0)] + [moved(0, up=i) for i in range(n)] + [moved(0, up=i, down=j) for i in range(n) for j in range(i)]
    return same + [moved(1)] + [moved(1, up=i) for i in range(n)]


def tiles(words: DataFrame, letters: list[str]) -> DataFrame:
    """``words`` -> key, part, words, ns: tiles of some ``TILE`` words of equal keys, sorted and joined
    without a mark between them, as they are of one length.
    A key of many words has many parts, dealt by the words' hashes; the letters of a tile are
    bounded as well."""
    keyed = words.select("word", "n", _key(letters).alias("key"))
    room = F.greatest(F.col("c") / TILE, F.col("c") * F.col("key")[0] / (TILE * 256))
    parts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).select("key", F.ceil(room).alias("parts"))
    dealt = keyed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")))
    tile = dealt.groupBy("key", "part").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("t"))
    return tile.select("key", "part", F.array_join("t.word", "").alias("words"), F.col("t.n").alias("ns"))


def tile_pairs(tile: DataFrame, letters: list[str]) -> DataFrame:
    """Every two tiles between which an edit can lead, once; a tile also meets itself."""
    step = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps(len(letters))]))
    visits = tile.select("key", "part", "words", "ns", step.alias("step"))
    visits = visits.select(F.zip_with("key", "step", lambda a, b: a + b).alias("key"), F.col("part").alias("part_a"),
                           F.col("words").alias("words_a"), F.col("ns").alias("ns_a"),
                           (~F.exists("step", lambda x: x != 0)).alias("own"))
    pairs = visits.filter(~F.exists("key", lambda x: x < 0)).join(tile, "key")
    return pairs.filter("NOT own OR part_a <= part").select(
        "words_a", "ns_a", "words", "ns", (F.col("own") & (F.col("part_a") == F.col("part"))).alias("itself"))


def _letters_of(data: bytes, n: int) -> np.ndarray:
    """``n`` joined words of one length -> a row of Latin-1 bytes each."""
    data = np.frombuffer(data, np.uint8)
    data = data[data != 0xC3]  # in UTF-8, U+00C0..U+00FF are this byte and one 64 below
    return np.where(data < 0x80, data, data + 0x40).astype(np.uint8).reshape(n, -1)


def _words_of(letters: np.ndarray) -> list[str]:
    text, length = letters.tobytes().decode("latin-1"), letters.shape[1]
    return [text[k:k + length] for k in range(0, len(text), length)]


def _factors(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right factors of the distances |a|² + |b|² - 2ab: rows (a, |a|², 1) and (-2b, 1, |b|²)."""
    rows, length = letters.shape
    cells = np.arange(rows)[:, None] * N_LETTERS + _COLUMN[letters]
    counts = np.bincount(cells.ravel(), minlength=rows * N_LETTERS).reshape(rows, N_LETTERS)
    # all sums must stay whole numbers: 24 bits in float32, 53 in float64
    counts = counts.astype(np.float32 if length < 2048 else np.float64)
    norm, one = (counts * counts).sum(axis=1, keepdims=True), np.ones((rows, 1), counts.dtype)
    return np.hstack([counts, norm, one]), np.hstack([-2 * counts, one, norm])


def _tile(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = _letters_of(data, n)
    return (letters, *_factors(letters))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` and ``b`` (equal numbers) that are one edit apart; ``b`` is of the same length or one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    length = a.shape[1]
    ahead, behind = a != b[:, :-1], a != b[:, 1:]
    head = np.where(ahead.any(axis=1), ahead.argmax(axis=1), length)  # equal letters from the left
    tail = np.where(behind.any(axis=1), behind[:, ::-1].argmax(axis=1), length)  # and from the right
    return head + tail >= length


def near_pairs(a: tuple, b: tuple, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles' words one edit apart; inside one tile each pair once."""
    (a, left, _), (b, _, right) = a, b
    used = left.any(axis=0) | right.any(axis=0)  # a few of the letters
    distance = left[:, used] @ right[:, used].T
    hits = np.flatnonzero(distance == (2 if a.shape[1] == b.shape[1] else 1))
    i, j = np.divmod(hits, len(b))
    if itself:
        i, j = i[i < j], j[i < j]
    room = max(1, (1 << 22) // a.shape[1])  # pairs whose letters are compared at once
    near = [one_edit(a[i[k:k + room]], b[j[k:k + room]]) for k in range(0, len(i), room)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    return i[near], j[near]


def _best(i: np.ndarray, j: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word i: how many links, and its link j of largest n (the smallest j among equals)."""
    order = np.lexsort((j, -ns[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    return i[first], np.diff(np.r_[first, len(i)]), j[first]


LINKS = "word string, n_near long, near string, near_n long"
_LINK_COLUMNS = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tile = lru_cache(maxsize=32)(_tile)
    for batch in batches:
        out = [[], [], [], []]
        for row in range(batch.num_rows):
            ns_a, ns_b = (batch.column(c)[row].values.to_numpy() for c in (1, 3))
            a, b = (tile(batch.column(c)[row].as_buffer().to_pybytes(), len(ns)) for c, ns in ((0, ns_a), (2, ns_b)))
            i, j = near_pairs(a, b, batch.column(4)[row].as_py())
            if not len(i):
                continue
            for own, far, x, y, ns in ((a[0], b[0], i, j, ns_b), (b[0], a[0], j, i, ns_a)):
                word, count, best = _best(x, y, ns)
                out[0] += _words_of(own[word])
                out[1].append(count)
                out[2] += _words_of(far[best])
                out[3].append(ns[best])
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0]), pa.array(np.concatenate(out[1])), pa.array(out[2]), pa.array(np.concatenate(out[3]))],
                schema=_LINK_COLUMNS)


def links(words: DataFrame) -> DataFrame:
    """``words`` (word, n) -> word, n_near, near, near_n for every word with a near one: how many
    there are, and the most frequent of them."""
    letters = key_letters(words)
    if not letters:
        return words.sparkSession.createDataFrame([], LINKS)
    found = tile_pairs(save(tiles(words, letters), "tiles"), letters).mapInArrow(_linked, LINKS)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def variants(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> word, n, n_near, form, form_n, root."""
    words = save(word_counts(docs), "words")
    near = links(words)
    is_form = F.col("near_n") >= FORM_RATIO * F.col("n")
    formed = save(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "formed")
    # counts grow tenfold along a chain, so it ends; pointers double until none moves
    up, moving = save(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots"), True
    while moving:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        up = save(up.join(far, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        up, moving = up.drop("moved"), not up.filter("moved").isEmpty()
    return formed.join(up, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
