"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint is the bitwise majority of its shingles' 64-bit
hashes.  Distinct fingerprints are grouped into cells by the population counts
of a few segments of their bits: two fingerprints within the radius have counts
that differ by no more than the radius in sum.  Cells are cut into tiles of
bounded size, tile pairs of cells further apart are skipped, and every other
pair of tiles is compared in full by numpy exclusive-or and bit counts.  A tile
pair returns a spanning forest of its links, not all of them, and the
components of those links are the groups.

Every fingerprint is compared with every other whose counts are near, so the
links are exact.  The work grows faster than the input (by pairs of
fingerprints), with a factor that more segments make smaller; the number of
segments follows the number of fingerprints and changes no result.

Results for odd input: a text that is null, empty or without words has
fingerprint zero and is linked like any other; repeated rows share a group; a
null doc_id never becomes a component_id while the group has another; an empty
table gives no row.
"""

from __future__ import annotations

from itertools import islice, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domquarry.llm.common import save, shield
from domquarry.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Most fingerprints of a tile, nearly (cells are split by hash).
TILE = 512
#: Fewest fingerprints that an average cell should have before more segments pay.
CELL = 64
SEGMENTS = (1, 2, 3, 4, 5, 6, 8)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer."""
    # bytes: lower() changes A-Z only, split() knows the six ASCII blanks only
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter(
        [b" ".join(words)])
    total, n = np.zeros(64, np.int64), 0
    while hashes := [xxhash.xxh64_intdigest(g, seed) for g in islice(grams, 1 << 16)]:
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text and any more) -> all but text, and fp (long, the
    fingerprint's bits)."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "fp")]
    names = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), np.uint64,
                              batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(fps.view(np.int64))],
                                             [*names, "fp"])

    schema = docs.select(*names).schema.add("fp", "long")
    return docs.select(*names, "text").mapInArrow(run, schema)


def segments_for(n: int) -> int:
    """Segments whose cells hold ``CELL`` of ``n`` random fingerprints on
    average: about (201 / m) ** (m / 2) cells are in use with m segments."""
    return max(m for m in SEGMENTS if m == 1 or n / (201 / m) ** (m / 2) >= CELL)


def segment_counts(fp, m: int):
    """Population counts of ``m`` segments of the bits, as an array column."""
    edges = [64 * i // m for i in range(m + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]
    signed = [x - (1 << 64) if x >> 63 else x for x in masks]
    return F.array(*[F.bit_count(fp.bitwiseAND(F.lit(x).cast("long"))).cast("int") for x in signed])


def offsets_within(m: int, radius: int) -> list[list[int]]:
    """One of each two opposite count differences with absolute sum up to
    ``radius``, and zero."""
    steps = range(-radius, radius + 1)
    return [list(d) for d in product(steps, repeat=m) if sum(map(abs, d)) <= radius and (d >= (0,) * m)]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what (i, j) connect."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def tile_links(radius: int):
    """Compares the two tiles of each row (binary columns x, y; ``same`` if
    they are one) and returns links a, b between fingerprints."""
    def run(batches):
        for batch in batches:
            found = []
            for x, y, same in zip(batch.column("x"), batch.column("y"), batch.column("same").to_pylist()):
                u, v = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                near = np.bitwise_count(u[:, None] ^ v[None, :]) <= radius
                if same:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if len(i):
                    all_fps = u if same else np.concatenate([u, v])
                    a, b = forest(i, j if same else j + len(u), len(all_fps))
                    found.append(np.stack([all_fps[a], all_fps[b]]))
            if found:
                a, b = np.concatenate(found, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def pack_tile(key, tile):
    data = tile["fp"].to_numpy().astype("<i8").tobytes()
    return pa.table({"cell": tile["cell"][:1], "part": tile["part"][:1], "tile": pa.array([data], pa.binary())})


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, segments: int | None = None) -> DataFrame:
    """``distinct`` (fp, no two rows alike, saved) -> a, b: links that connect
    all fingerprints that differ in at most ``radius`` bits."""
    m = segments or segments_for(distinct.count())
    celled = distinct.select("fp", segment_counts(F.col("fp"), m).alias("cell"))
    parts = save(celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "cells")
    cut = celled.join(parts, "cell").select("fp", "cell", F.pmod(F.hash("fp"), "parts").alias("part"))
    tiles = save(cut.groupBy("cell", "part").applyInArrow(
        pack_tile, "cell array<int>, part int, tile binary"), "tiles")
    steps = F.array(*[F.array(*map(F.lit, d)) for d in offsets_within(m, radius)])
    near = tiles.select("cell", "part", "tile", F.explode(steps).alias("step"))
    other = F.zip_with("cell", "step", lambda c, s: c + s)
    near = near.select(F.col("cell").alias("from"), F.col("part").alias("from_part"), F.col("tile").alias("x"),
                       other.alias("cell"))
    # a cell of many tiles is many keys
    near = near.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.col("from") == F.col("cell")
    near = near.filter(~own | (F.col("from_part") <= F.col("part")))
    pairs = near.join(tiles.withColumnRenamed("tile", "y"), ["cell", "part"])
    return pairs.select("x", "y", (own & (F.col("from_part") == F.col("part"))).alias("same")).mapInArrow(
        tile_links(radius), "a long, b long")


def groups(distinct: DataFrame, radius: int = RADIUS, **options) -> DataFrame:
    """``distinct`` (fp, no two rows alike, and any more; saved) with root: a
    fingerprint that stands for the group."""
    linked = components(save(links(distinct.select("fp"), radius, **options), "links"))
    return distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id
    among all that links lead to) per row of ``docs``."""
    rows = save(fingerprints(docs.select("doc_id", "text"), shingle), "rows")
    distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    of_fp = groups(distinct, radius, **options)
    smallest = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = of_fp.join(smallest, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **options) -> DataFrame:
    """The rows of ``docs`` that stay when of each group the row of the
    smallest doc_id does; nulls count as largest, of equal doc_ids the text
    with the smaller hash stays, and of repeated rows any one."""
    shielded, restore = shield(docs, ["_id", "_mark", "_own"])
    mark = F.xxhash64("text")
    rows = fingerprints(docs.select("doc_id", "text", mark.alias("_mark")), shingle)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_mark")
    distinct = save(rows.groupBy("fp").agg(F.min(order).alias("best")), "fingerprints")
    best = groups(distinct, radius, **options).groupBy("root").agg(F.min("best").alias("best"))
    keep = best.select(F.col("best.doc_id").alias("_id"), F.col("best._mark").alias("_own"))
    stay = shielded.withColumn("_mark", mark).join(
        keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_own")), "left_semi")
    return restore(stay.dropDuplicates(["doc_id", "_mark"]))
