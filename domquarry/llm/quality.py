"""Quality rules, line first.

Every line of a text is judged by itself; lines that fail are removed, and a
document that loses too much of its text that way is rejected.  A document is
also rejected by two rules on the whole text (``base_failed``).  All of it is
built-in Spark functions over one row: no shuffle and no Python.

Rules of a line (a line without words passes):

* punctuation: at least ``MIN_MARKS`` symbols ``#*$%&|<>`` and more than
  ``SYMBOL_SHARE`` a word; or doubled marks (``!!``, ``??``) after more than
  ``DOUBLED_SHARE`` of its words; or at least ``RUN_ON_WORDS`` words without
  any sentence mark of any script;
* navigation: at least two separators (``|``, ``»``, ``›``, ``•``, ``·`` as a
  word of their own) and one to every ``LINK_WORDS`` words or more;
* boilerplate: at most ``NOTICE_WORDS`` words, at least half of which are the words
  of ``NOTICES``, whole words in a row (case and punctuation around words aside).

Results for odd input: a null or empty text has no words, fails the base rules
and is not kept; repeated rows are judged row by row; columns of the same names
as the results are replaced; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domquarry.llm.common import let, shield, words

SYMBOLS = "#*$%&|<>"
MIN_MARKS, SYMBOL_SHARE, DOUBLED_SHARE, RUN_ON_WORDS, LINK_WORDS, NOTICE_WORDS = 3, 0.3, 0.3, 100, 4, 25
MIN_WORDS, REPEAT_PERCENT, LOST_SHARE = 50, 50, 0.3
SEPARATORS = ("|", "»", "›", "•", "·")

# Marks that end sentences and clauses, by Unicode's property of sentence terminals,
# with the colon, semicolon and ellipsis of the scripts that have them.
SENTENCE_MARKS = (".!?…:;\u0589\u061b\u061d\u061e\u061f\u06d4\u0700\u0701\u0702\u07f9\u0837\u0839\u083d\u083e\u0964\u0965"
                  "\u104a\u104b\u1362\u1364\u1365\u1366\u1367\u1368\u166e\u1735\u1736\u17d4\u17d5\u1803\u1809\u1944\u1945"
                  "\u1aa8\u1aa9\u1aaa\u1aab\u1b5a\u1b5b\u1b5e\u1b5f\u1c3b\u1c3c\u1c7e\u1c7f\u203c\u203d\u2047\u2048\u2049"
                  "\u2e2e\u3002\ua4ff\ua60e\ua60f\ua6f3\ua6f7\ua876\ua877\ua8ce\ua8cf\ua92f\ua9c8\ua9c9\uaa5d\uaa5e\uaa5f"
                  "\uaaf0\uaaf1\uabeb\ufe52\ufe56\ufe57\uff01\uff0e\uff1a\uff1b\uff1f\uff61")

#: Phrases of page furniture, in lower case; of two or three words.
NOTICES = ("all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use",
           "terms of service", "enable javascript", "click here", "sign in", "log in", "subscribe to our",
           "read more", "lorem ipsum", "skip to content", "back to top", "share this")


def count_of(text: Column, marks: str) -> Column:
    """How many characters of ``text`` are one of ``marks``."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def notice_words(line_words: Column) -> Column:
    """How many of a line's words belong to ``NOTICES``."""
    bare = F.transform(line_words, lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    spaced = F.concat(F.lit("  "), F.array_join(bare, "  "), F.lit("  "))  # so neighbours share no blank
    total = F.lit(0)
    for k, phrases in NOTICE_PATTERNS.items():
        total = total + k * F.regexp_count(spaced, F.lit(phrases))
    return total


#: Number of words -> pattern of the notices of so many, for words set apart by two blanks.
NOTICE_PATTERNS = {k: " (?:" + "|".join(p.replace(" ", "  ") for p in NOTICES if len(p.split()) == k) + ") "
                   for k in sorted({len(p.split()) for p in NOTICES})}


def line_fails(line: Column, line_words: Column) -> Column:
    """The three rules, for a line and the array of its words."""
    n = F.size(line_words)
    symbols = count_of(line, SYMBOLS)
    doubled = F.size(F.filter(line_words, lambda w: w.contains("!!") | w.contains("??")))
    links = F.size(F.filter(line_words, lambda w: w.isin(*SEPARATORS)))
    # notices are counted in short lines that may have one
    held = F.lit(False)
    for first in sorted({p.split()[0] for p in NOTICES}):
        held = held | F.lower(line).contains(first)
    notice = F.when((n <= NOTICE_WORDS) & held, 2 * notice_words(line_words) >= n).otherwise(False)
    punctuation = (((symbols >= MIN_MARKS) & (symbols > SYMBOL_SHARE * n)) | (doubled > DOUBLED_SHARE * n)
                   | ((n >= RUN_ON_WORDS) & (F.length(F.translate(line, SENTENCE_MARKS, "")) == F.length(line))))
    navigation = (links >= 2) & (links * LINK_WORDS >= n)
    return (n > 0) & (punctuation | navigation | notice)


def repeated_words(all_words: Column, window: int = 3) -> Column:
    """Words that stand in a window of ``window`` words found twice or more.

    A text whose windows all differ has none.  Else windows are sorted with
    their places; neighbours that are equal mark both places; a marked place covers
    ``window`` words, or as many as there are up to the next marked place."""
    def windows(w):
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (window - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.concat_ws(" ", x, *[w[i + k] for k in range(1, window)]))

    def following(a):
        return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))

    def marked(s):
        pairs = F.zip_with(s, following(s), lambda a, b: F.when(a["text"] == b["text"], F.array(a["at"], b["at"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def covered(places):
        steps = F.zip_with(places, following(places),
                           lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def count(texts):
        placed = F.sort_array(F.transform(texts, lambda x, i: F.struct(x.alias("text"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(texts)) == F.size(texts), F.lit(0).cast("long")).otherwise(
            let(placed, lambda s: let(marked(s), covered)))

    return let(windows(all_words), count)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed, kept (boolean) and cleaned (the text
    without the lines that fail, line ends kept)."""
    def long(c):
        return c.cast("long")

    def measures(lines):
        all_words = F.flatten(F.transform(lines, lambda x: x["w"]))
        spoken = F.filter(lines, lambda x: F.size(x["w"]) > 0)
        good = F.filter(lines, lambda x: ~line_fails(x["line"], x["w"]))

        def with_words(w):
            return F.struct(
                long(F.size(w)).alias("n_words"),
                long(F.aggregate(w, F.lit(0), lambda t, x: t + F.length(x))).alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"))

        texts = F.transform(spoken, lambda x: x["line"])
        return F.struct(
            let(all_words, with_words).alias("words"),
            let(texts, lambda t: long(F.size(t) - F.size(F.array_distinct(t)))).alias("n_dup_lines"),
            let(good, lambda g: F.struct(
                long(F.aggregate(g, F.lit(0), lambda t, x: t + F.size(x["w"]))).alias("n_left"),
                F.array_join(F.transform(g, lambda x: x["line"]), "\n").alias("cleaned"))).alias("good"))

    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(whole, "\n"), lambda x: F.struct(x.alias("line"), words(x).alias("w")))
    # a generator's row is computed once, whatever is filtered or selected from it
    m = docs.withColumn("_m", F.explode(F.array(let(lines, measures))))
    n = F.col("_m.words.n_words")
    base_failed = (n < MIN_WORDS) | (100 * F.col("_m.words.n_repeat_words") > REPEAT_PERCENT * n)
    lost = n - F.col("_m.good.n_left")
    return m.withColumns({
        "n_words": n, "word_chars": F.col("_m.words.word_chars"), "n_symbols": long(count_of(whole, SYMBOLS)),
        "n_dup_lines": F.col("_m.n_dup_lines"), "n_repeat_words": F.col("_m.words.n_repeat_words"),
        "base_failed": base_failed, "kept": ~base_failed & ~(lost > LOST_SHARE * n),
        "cleaned": F.col("_m.good.cleaned")}).drop("_m")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, without the lines that fail, with the
    columns of ``docs``; ``n_chars``, if there, is the new text's."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    shielded, restore = shield(docs, made)
    out = judged(shielded).filter("kept").withColumn("text", F.col("cleaned"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return restore(out)
