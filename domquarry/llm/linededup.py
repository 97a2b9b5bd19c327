"""Repeated line runs, by a suffix array over line ids.

Lines with a word are the symbols of a text.  A run of lines repeats if the
same lines stand together somewhere before (in an earlier document, by doc_id
and then by row, or earlier in the same text) and have at least ``min_words``
words.  The lines of every later copy are deleted; the first copy stays.

The suffixes are ranked by distributed prefix doubling: rank 0 orders suffixes
by their first line, and each round orders pairs (rank of 2^k lines, rank of
the next 2^k lines).  Ranks of classes with one member are dropped, so only what
repeats is carried on.  A longest-common-prefix interval of depth f holds the
suffixes that share f lines, told apart by the ranks of their first and last
2^k of these lines.  Every repeated run is the union of its shortest parts
with ``min_words`` words (one from each start and one to each end), so the
intervals at those depths reveal every maximal repeated run.  A line has a word
or more, hence no part is longer than ``min_words`` lines and the number of
rounds has a fixed bound.  So ranks stand for the sorted suffixes: no list of all
suffixes is sorted to the end, and intervals are looked up at the depths that count
instead of being read off computed prefix lengths.

Built-in functions only.  Documents are split at line ends, never cut.  Equal
lines are counted before they are shuffled, and joins on line ids are joins
that Spark splits when a key is hot.  Runs with over a thousandth of all parts (fewer than
a thousand runs, so they are broadcast) are looked up without a shuffle.

Results for odd input: a null text has no line and stays null; blank lines are
no symbols and stay; repeated rows are copies of each other, the first by row
stays; a null doc_id comes first; an empty table gives no row; columns with the
names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domquarry.llm.common import SPACE_CLASS, let, save, shield, words

MIN_WORDS = 50
#: A run with more than one in so many of all parts is frequent: fewer runs than this can be.
FREQUENT = 1000


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """Classes in the order of ``keys`` with ``rank``: a long that keeps the order."""
    ordered = classes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return save(ordered.select(*keys, F.monotonically_increasing_id().alias("rank")), "ranks")


def _symbols(rows: DataFrame) -> DataFrame:
    """_row, doc_id, no (line number), at (number among lines with a word), n
    (words) and the line's id, two hashes, per line with a word."""
    spoken = F.filter(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("no"))),
        lambda x: ~x["line"].rlike(f"^{SPACE_CLASS}*$"))
    parts = F.transform(spoken, lambda x: F.struct(
        x["no"].alias("no"), F.size(words(x["line"])).alias("n"), F.xxhash64(x["line"]).alias("h1"),
        F.xxhash64(F.lit(1), x["line"]).alias("h2")))
    return rows.select("_row", "doc_id", F.posexplode(parts).alias("at", "x")).select("_row", "doc_id", "at", "x.*")


def _runs(symbols: DataFrame, min_words: int) -> DataFrame:
    """Stretches of lines that all occur twice or more, with ``min_words`` words:
    _row, doc_id, first, ranks, and the lines' no and words before and after."""
    twice = symbols.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    ranks = _ranked(twice, ["h1", "h2"])
    known = symbols.join(ranks, ["h1", "h2"]).select("_row", "doc_id", "at", "no", "n", "rank")
    w = Window.partitionBy("_row").orderBy("at")
    stretch = known.withColumns({"stretch": F.col("at") - F.row_number().over(w), "upto": F.sum("n").over(w)})
    line = F.struct("at", "no", "rank", (F.col("upto") - F.col("n")).alias("before"), "upto")
    runs = stretch.groupBy("_row", "stretch").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(line)).alias("lines"), F.sum("n").alias("n"))

    def field(name):
        return F.transform("lines", lambda x: x[name])

    return runs.filter(F.col("n") >= min_words).select(
        "_row", "doc_id", F.col("lines")[0]["at"].alias("first"), field("no").alias("no"),
        field("rank").alias("ranks"), _parts(field("before"), field("upto"), min_words).alias("parts"))


def _parts(before: Column, upto: Column, min_words: int) -> Column:
    """The shortest parts with ``min_words`` words, from each start and to each
    end, as start * base + length (``_start_of`` and ``_length_of``)."""
    def code(start, f):
        return start.cast("long") * (min_words + 1) + f

    def both(b):
        def with_ends(u):
            n = F.size(u)
            fore = F.transform(b, lambda x, i: let(F.lit(1) + F.size(F.filter(
                F.slice(u, i + 1, F.lit(min_words)), lambda e: e < x + min_words)),
                lambda f: F.when(i + f <= n, code(i, f))))
            back = F.transform(u, lambda x, i: let(F.lit(1) + F.size(F.filter(
                F.slice(b, F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words))),
                lambda s: s > x - min_words)), lambda f: F.when(i + 1 >= f, code(i + 1 - f, f))))
            return F.array_distinct(F.filter(F.concat(fore, back), lambda p: p.isNotNull()))

        return let(upto, with_ends)

    return let(before, both)


def _length_of(part: Column, min_words: int) -> Column:
    return (part % (min_words + 1)).cast("int")


def _start_of(part: Column, min_words: int) -> Column:
    return F.floor(part / (min_words + 1)).cast("int")


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``rows`` (_row unique, doc_id, text; saved) -> _row, no: the numbers of
    the lines (array, from 0) that are part of a later copy."""
    symbols = save(_symbols(rows), "symbols")
    level = save(_runs(symbols, min_words), "runs")
    found, k = None, 0
    while True:
        size = 1 << k
        part = level.select("_row", "doc_id", "first", "no", "ranks", F.explode("parts").alias("p")).withColumns(
            {"start": _start_of(F.col("p"), min_words), "f": _length_of(F.col("p"), min_words)})
        part = part.filter((F.col("f") >= size) & (F.col("f") < 2 * size))
        keyed = part.select(
            "_row", "doc_id", F.slice("no", F.col("start") + 1, F.col("f")).alias("no"), "f",
            (F.col("first") + F.col("start")).alias("at"), F.get("ranks", F.col("start")).alias("a"),
            F.get("ranks", F.col("start") + F.col("f") - size).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
        found = keyed if found is None else found.unionByName(keyed)
        longer = level.filter(F.exists("parts", lambda p: _length_of(p, min_words) >= 2 * size))
        if longer.isEmpty():
            break
        level, k = save(_doubled(longer, size), "doubled"), k + 1
    found = save(found, "parts")
    place, run = F.struct("doc_id", "_row", "at"), ["f", "a", "b"]
    intervals = found.groupBy(*run).agg(F.min(place).alias("place"), F.count("*").alias("c"))
    intervals = save(intervals.filter("c > 1"), "intervals")
    frequent = F.col("c") * FREQUENT > found.count()
    hot, cold = F.broadcast(intervals.filter(frequent).drop("c")), intervals.filter(~frequent).drop("c")
    # rows of frequent runs stay where they are; a shuffle by run moves the others only
    later = found.join(hot, run).unionByName(found.join(hot, run, "left_anti").join(cold, run))
    later = later.filter(place > F.col("place"))
    return later.select("_row", F.explode("no").alias("no")).groupBy("_row").agg(F.collect_set("no").alias("no"))


def _doubled(level: DataFrame, size: int) -> DataFrame:
    """Ranks of twice as many lines: of pairs of ranks, null where the pair occurs once."""
    def pair(a, i):
        # without a partner: a key of its own, below all ranks, so that no task gets them all
        b = F.get("ranks", i + size)
        lone = a.isNull() | b.isNull()
        return F.struct(F.when(lone, -1 - F.col("_row")).otherwise(a).alias("a"),
                        F.when(lone, -1 - i).otherwise(b).alias("b"))

    pairs = level.select("_row", "first", F.posexplode(F.transform("ranks", pair)).alias("i", "p")).select(
        "_row", "first", "i", "p.*")
    twice = pairs.filter("a >= 0").groupBy("a", "b").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    ranked = pairs.join(_ranked(twice, ["a", "b"]), ["a", "b"], "left")
    by_run = ranked.groupBy("_row", "first").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "rank"))), lambda x: x["rank"]).alias("ranks"))
    return level.drop("ranks").join(by_run, ["_row", "first"])


def without_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_lines, n_deleted (long) and the text without the lines of later copies."""
    shielded, restore = shield(docs.drop("n_lines", "n_deleted"), ["_row", "_gone"])
    rows = save(shielded.withColumn("_row", F.monotonically_increasing_id()), "documents")
    gone = repeated_lines(rows.select("_row", "doc_id", "text"), min_words).withColumnRenamed("no", "_gone")
    lines = F.split("text", "\n")

    def kept(parts):
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
        return F.array_join(F.transform(left, lambda i: parts[i]), "\n")

    whole = F.col("_gone").isNull()
    made = rows.join(gone, "_row", "left").withColumns({
        "n_lines": F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
        "n_deleted": F.when(whole, F.lit(0)).otherwise(F.size("_gone")).cast("long"),
        "text": F.when(whole, F.col("text")).otherwise(let(lines, kept))})
    return restore(made, "n_lines", "n_deleted")


def cleaned_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies, with the columns of ``docs``;
    ``n_chars``, if there, is the new text's.  A document that lost lines and has
    no word left was a copy as a whole and goes."""
    shielded, restore = shield(docs, ["n_lines", "n_deleted"])
    out = without_later_copies(shielded, min_words)
    whole = F.col("n_deleted") == 0
    out = out.filter(whole | ~F.col("text").rlike(f"^{SPACE_CLASS}*$"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return restore(out)
