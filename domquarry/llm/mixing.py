"""Mixing sources to target weights by subset-sum budget fitting.

Sources share the total number of words by weight.  A target is at most
``max_repeats`` times its source's size; what is above goes to the others by
weight, until none is above.  A source's documents are taken whole: every
document floor(target / source size) times, and once more for a choice of
documents that fits the remaining budget.  The choice is made per length:
documents are counted by their exact number of words, the budget is first
spread in proportion over the lengths, and bounded-knapsack dynamic programming
over the counts left fills what rounding left over.  Which documents of a length are
taken follows from a seeded hash, so reruns agree.

Results for odd input: a null text has size 0 and is taken 0 words; a null
source is a source of its own, the last one; repeated rows count and are
taken one by one; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domquarry.llm.common import n_words, save, shield

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 17
#: Words of budget that the dynamic programme fills; the rest is spread by count.
PROGRAMME_WORDS = 4096
#: The seeded hash's leading bits, by which documents of one source and length are split.
BUCKET_BITS = 10


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> the same with weight and target, per source.

    Only sums over the sources reach the driver, one row a round."""
    spark = sizes.sparkSession
    ordered = sizes.select("source", "source_size").orderBy(F.col("source").asc_nulls_last())
    indexed = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], weights[x[1] % len(weights)]))
    sources = save(spark.createDataFrame(indexed, "source string, source_size long, weight long"), "sources")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    share, capped = (total / weight if weight else 0.0), -1
    limit = F.lit(max_repeats) * F.col("source_size")
    while True:
        over = limit < F.lit(share) * F.col("weight")
        n, held, open_weight = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n == capped or not open_weight:
            break
        share, capped = (total - held) / open_weight, n
    return sources.withColumn("target", F.least(limit.cast("double"), F.lit(float(share)) * F.col("weight")))


def fit(sizes: list[int], counts: list[int], budget: int, programme: int = PROGRAMME_WORDS) -> list[int]:
    """How many of ``counts[i]`` documents of ``sizes[i]`` words to take, so that
    the words come as near to ``budget`` as the choice made here allows."""
    total = sum(s * c for s, c in zip(sizes, counts))
    if budget <= 0 or not total:
        return [0] * len(sizes)
    budget = min(budget, total)
    taken = [c * budget // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, taken))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for i in order:  # what one round of the programme need not see
        if sizes[i]:
            more = min(counts[i] - taken[i], max(0, left - programme) // sizes[i])
            taken[i] += more
            left -= more * sizes[i]
    spare = [i for i in order if sizes[i] and counts[i] > taken[i]]
    if not left or not spare:
        return taken
    width = 2 * left  # a sum above the budget may come nearer
    mask, sums, steps = (1 << (width + 1)) - 1, 1, []
    for i in spare:
        rest, k = min(counts[i] - taken[i], width // sizes[i]), 1
        while rest and not sums >> left & 1:
            k = min(k, rest)
            grown = (sums | sums << (k * sizes[i])) & mask
            if grown != sums:
                steps.append((i, k, sums))
                sums = grown
            rest, k = rest - k, 2 * k
    below = (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = sums >> left
    above = left + (above & -above).bit_length() - 1 if above else width + left + 1
    at = below if left - below <= above - left else above
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= k * sizes[i]
    return taken


def mix(docs: DataFrame, size=None, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED,
        programme: int = PROGRAMME_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, source and any more) with size, source_size,
    target and taken, all of the row's source; taken is the words the mix
    takes of the row, repeats counted.  ``size`` is a long column, by default
    the text's number of words.  A column of ``docs`` with one of these names is replaced."""
    made = ["size", "source_size", "target", "taken"]
    mark = F.xxhash64(F.lit(seed), "doc_id", "text")
    base = docs.drop(*(set(made) - {"source"})).withColumns({
        "size": n_words(F.col("text")) if size is None else size, "_mark": mark,
        "_bucket": F.shiftrightunsigned(mark, 64 - BUCKET_BITS)})
    # whole rows are counted, so a hot source or length costs a row per task and bucket
    counts = save(base.groupBy("source", "size", "_bucket").agg(F.count("*").alias("_n")), "counts")
    lengths = counts.groupBy("source", "size").agg(F.sum("_n").alias("_c"))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("_c")).alias("source_size"))
    wanted = targets(sizes, weights, max_repeats)

    def choose(key, table):
        n, target = table["source_size"][0].as_py(), table["target"][0].as_py()
        repeats = int(target // n) if n else 0
        budget = round(target - repeats * n)
        extra = fit(table["size"].to_pylist(), table["_c"].to_pylist(), budget, programme)
        return table.append_column("_repeats", pa.array(np.full(len(table), repeats, np.int64))).append_column(
            "_extra", pa.array(extra, pa.int64()))

    # one group holds one row per length that occurs in the source
    by_length = lengths.alias("l").join(wanted.drop("weight").alias("w"),
                                        F.col("l.source").eqNullSafe(F.col("w.source")))
    columns = by_length.select("l.*", "source_size", "target")
    chosen = save(columns.groupBy("source").applyInArrow(
        choose, "source string, size long, _c long, source_size long, target double, _repeats long, _extra long"),
        "chosen")
    before = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    plan = earlier.alias("a").join(
        chosen.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    ).select("a.source", "a.size", "a._bucket", "source_size", "target", "_repeats",
             F.greatest(F.lit(0), F.least("_n", F.col("_extra") - F.col("_before"))).alias("_take"))
    joined = base.alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))
        & (F.col("d._bucket") == F.col("p._bucket")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "_bucket").orderBy("_mark", "doc_id"))
    rows = joined.select("d.*", "source_size", "target", "_repeats", "_take").withColumn("_rank", rank)
    taken = F.col("size") * (F.col("_repeats") + (F.col("_rank") <= F.col("_take")).cast("long"))
    return rows.withColumn("taken", taken).select(
        *[c for c in docs.columns if c not in made], *made)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs``, each row as often as it is taken, with the
    columns of ``docs``.  Rows without words take nothing and are left out."""
    shielded, restore = shield(docs, ["size", "source_size", "target", "taken"])
    rows = mix(shielded, **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return restore(rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))))
