"""Exact top-k inner-product search by M-trees.

Vectors become points of a metric space in which the nearest point is the one
of the highest inner product: a coordinate sqrt(M - |x|^2) is added, M being
the largest squared norm, and a query gets 0 there; then the squared distance
is |q|^2 + M - 2 q.x.  Points are dealt to trees by their nearest pivot (pivots
come from a bounded sample, which only shapes the trees).  A tree is a set of
pages.  An inner page's entry has a routing point, the covering radius of its
child page and its distance to the page's own routing point; a leaf page's
entry has a vector, the ids that have it and that distance.

A query first searches the tree where its own vector is, which gives a bound;
then every tree whose root the bound does not exclude.  Search in a tree is
best first: pages wait in a heap by the least distance that their radius
allows, and an entry whose stored distance already excludes it is passed over
without computing anything.  Scores are exact integers.

Queries are sent to trees, trees are never copied to all queries, and a tree
that many queries visit is read by several tasks.

Vectors with a component beyond 2^26 in magnitude (after the factor 256) are in no
tree: blocks of them are scored against blocks of queries, and as queries against
all vectors, in integers of any length.

Results for odd input: vectors that are null, or hold a null or a non-finite
component, or one of 2^63 or more (where the SQL fails), and rows without id, take
no part; a score beyond 2^63 - 1 counts as that;
only vectors of one length are compared; a candidate with the query's own id is
the query's own; other repeated rows count one by one; equal queries (id and
vector) are one query; an empty table gives no row.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domquarry.llm.common import save

K = 5
EVERY = 50
LIMIT = 1 << 26
#: Most points of a tree, nearly; entries of a page; most pivots; queries that
#: one task searches in a tree; queries and roots of a block.
TREE_POINTS, PAGE, PIVOTS, TASK_QUERIES, BLOCK = 16_384, 128, 1024, 20_000, 2048
#: Room for rounding in comparisons of distances.
SLACK = 1e-7


def quantised(embedding: Column) -> Column:
    """floor(256 x) per component as int, or null where the vector takes no part."""
    scaled = F.transform(embedding, lambda x: F.floor(256 * F.when(
        F.abs(x.cast("double")) < LIMIT // 256, x.cast("double"))).cast("int"))
    return F.when(F.forall(scaled, lambda x: x.isNotNull()), scaled)


def wide(embedding: Column) -> Column:
    """floor(256 x) per component as long, of the vectors that ``quantised`` has as
    null for their size alone; null for all others."""
    scaled = F.transform(embedding, lambda x: F.floor(256 * F.when(
        F.abs(x.cast("double")) < float(1 << 55), x.cast("double"))))
    return F.when(quantised(embedding).isNull() & F.forall(scaled, lambda x: x.isNotNull()), scaled)


def vector_rows(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


class Space:
    """Distances of the metric space with largest squared norm ``m``."""

    def __init__(self, m: int):
        self.m = m

    def points(self, x: np.ndarray) -> np.ndarray:
        """Vectors with the added coordinate, as floats."""
        rest = np.maximum(self.m - (x * x).sum(axis=1), 0)
        return np.concatenate([x.astype(float), np.sqrt(rest.astype(float))[:, None]], axis=1)

    def of_score(self, norm: int, score):
        """Distance of a query of squared norm ``norm`` to a point of that score."""
        return np.sqrt(np.maximum(norm + self.m - 2.0 * score, 0))


def distances(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - p) ** 2).sum(axis=1))


def build(points: np.ndarray, page: int = PAGE) -> list[dict]:
    """Pages of a tree; page 0 is the root.  A leaf names rows of ``points``."""
    pages: list[dict] = [{}]
    todo = [(0, np.arange(len(points)), points[0])]
    while todo:
        number, rows, router = todo.pop()
        if len(rows) <= page:
            pages[number] = {"leaf": True, "rows": rows, "child": np.zeros(0, np.int64),
                             "radius": np.zeros(len(rows)), "parent": distances(points[rows], router)}
            continue
        picks = rows[np.linspace(0, len(rows) - 1, min(page, -(-len(rows) // page) + 1)).astype(int)]
        away = np.stack([distances(points[rows], points[p]) for p in picks])
        nearest = away.argmin(axis=0)
        if np.bincount(nearest, minlength=len(picks)).max() == len(rows):  # all next to one pick
            nearest = np.arange(len(rows)) * len(picks) // len(rows)
        used = np.unique(nearest)
        first = len(pages)
        pages += [{} for _ in used]
        for k, g in enumerate(used):
            todo.append((first + k, rows[nearest == g], points[picks[g]]))
        pages[number] = {"leaf": False, "rows": picks[used], "child": first + np.arange(len(used)),
                         "radius": np.array([away[g][nearest == g].max() for g in used]),
                         "parent": distances(points[picks[used]], router)}
    return pages


def _tree_pages(m_of: dict[int, int], page: int):
    """Builds one tree: its pages as rows; row ``page`` 0 has the tree's reach."""
    def run(key, table):
        table = table.combine_chunks()
        x = vector_rows(table["v"].chunk(0)) if table.num_rows else np.zeros((0, 0), np.int64)
        points = Space(m_of[key[0].as_py()]).points(x)
        ids, out = table["ids"].to_pylist(), []
        for number, p in enumerate(build(points, page)):
            out.append({
                "dim": key[0].as_py(), "tree": key[1].as_py(), "page": number, "leaf": p["leaf"],
                "vectors": x[p["rows"]].astype("<i4").tobytes(), "n": len(p["rows"]),
                "child": p["child"].astype("<i4").tobytes(), "radius": p["radius"].astype("<f8").tobytes(),
                "parent": p["parent"].astype("<f8").tobytes(), "ids": [ids[r] for r in p["rows"]] if p["leaf"] else [],
                "router": x[0].tolist() if number == 0 else [],
                "reach": float(distances(points, points[0]).max()) if number == 0 else 0.0})
        return pa.Table.from_pylist(out, schema=PAGE_ARROW)

    return run


PAGE_SCHEMA = ("dim int, tree long, page int, leaf boolean, vectors binary, n int, child binary, radius binary, "
               "parent binary, ids array<array<bigint>>, router array<int>, reach double")
PAGE_ARROW = pa.schema([
    ("dim", pa.int32()), ("tree", pa.int64()), ("page", pa.int32()), ("leaf", pa.bool_()), ("vectors", pa.binary()),
    ("n", pa.int32()), ("child", pa.binary()), ("radius", pa.binary()), ("parent", pa.binary()),
    ("ids", pa.list_(pa.list_(pa.int64()))), ("router", pa.list_(pa.int32())), ("reach", pa.float64())])


class Tree:
    """A tree's pages, ready to search."""

    def __init__(self, pages: list[dict], space: Space, dim: int):
        self.space, self.pages = space, {}
        for p in pages:
            self.pages[p["page"]] = p | {
                "vectors": np.frombuffer(p["vectors"], "<i4").astype(np.int64).reshape(p["n"], dim),
                "child": np.frombuffer(p["child"], "<i4"), "radius": np.frombuffer(p["radius"], "<f8"),
                "parent": np.frombuffer(p["parent"], "<f8")}
        self.computed = 0  # distances computed, for the tests

    def search(self, query_id: int, q: np.ndarray, k: int, bound: float) -> list[tuple[int, int]]:
        """The best (score, id) of other ids than ``query_id``, at most ``k``,
        of those no further than ``bound``; ties to the smaller id."""
        norm, best = int(q @ q), []
        root = self.pages[0]
        at = float(self.space.of_score(norm, int(np.asarray(root["router"], np.int64) @ q)))
        heap = [(0.0, 0, at)]
        while heap:
            least, number, to_router = heapq.heappop(heap)
            if least > bound + SLACK * (1 + bound):
                break
            p = self.pages[number]
            # the triangle inequality by stored distances: nothing is computed for these
            near = np.flatnonzero(np.abs(to_router - p["parent"]) - p["radius"] <= bound + SLACK * (1 + bound))
            if not len(near):
                continue
            scores = p["vectors"][near] @ q
            away = self.space.of_score(norm, scores)
            self.computed += len(near)
            if p["leaf"]:
                for i in near[away <= bound + SLACK * (1 + bound)].tolist():
                    score = int(p["vectors"][i] @ q)
                    best += [(-score, vec_id) for vec_id in p["ids"][i] if vec_id != query_id]
                if len(best) >= k:
                    best = sorted(best)[:k]
                    bound = min(bound, float(self.space.of_score(norm, -best[-1][0])))
            else:
                lowest = np.maximum(away - p["radius"][near], 0)
                for i in np.flatnonzero(lowest <= bound + SLACK * (1 + bound)).tolist():
                    heapq.heappush(heap, (float(lowest[i]), int(p["child"][near[i]]), float(away[i])))
        return [(-s, v) for s, v in sorted(best)[:k]]


RESULT_SCHEMA = "query_id long, q array<int>, vec_id long, score long"
RESULT_ARROW = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.int32())), ("vec_id", pa.int64()),
                          ("score", pa.int64())])


def _search_task(m_of: dict[int, int], k: int):
    def run(key, pages, queries):
        out = []
        if pages.num_rows:
            dim = key[0].as_py()
            tree = Tree(pages.to_pylist(), Space(m_of[dim]), dim)
            for query_id, q, bound in zip(*(queries[c].to_pylist() for c in ("query_id", "q", "bound"))):
                for score, vec_id in tree.search(query_id, np.asarray(q, np.int64), k, bound):
                    out.append({"query_id": query_id, "q": q, "vec_id": vec_id, "score": score})
        return pa.Table.from_pylist(out, schema=RESULT_ARROW)

    return run


def _visit(pages: DataFrame, visits: DataFrame, m_of: dict[int, int], k: int, task_queries: int) -> DataFrame:
    """Results of ``visits`` (dim, tree, query_id, q, bound; saved) in the trees that they name."""
    parts = visits.groupBy("dim", "tree").agg(F.ceil(F.count("*") / task_queries).cast("int").alias("parts"))
    asked = visits.join(parts, ["dim", "tree"]).withColumn("part", F.pmod(F.hash("query_id"), "parts"))
    held = pages.join(parts, ["dim", "tree"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["dim", "tree", "part"]
    return held.groupBy(*keys).cogroup(asked.select(*keys, "query_id", "q", "bound").groupBy(*keys)).applyInArrow(
        _search_task(m_of, k), RESULT_SCHEMA)


def distinct_vectors(vectors: DataFrame, k: int = K) -> DataFrame:
    """``vectors`` (vec_id, v) -> v, dim, ids: the k + 1 smallest different ids of
    each vector, each as often as it has rows with it, k times at most; in steps so
    that a vector of very many rows is no single task's."""
    def smallest(c):
        return F.slice(F.sort_array(c), 1, k + 1).alias("ids")

    copies = vectors.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    part = copies.withColumn("part", F.pmod(F.hash("vec_id"), F.lit(64))).groupBy("v", "part").agg(
        smallest(F.collect_list(F.struct("vec_id", "n"))))
    return part.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids")))).select(
        "v", F.size("v").alias("dim"),
        F.flatten(F.transform("ids", lambda x: F.array_repeat(x["vec_id"], x["n"]))).alias("ids"))


WIDE_SCHEMA = "query_id long, q array<bigint>, vec_id long, score long"
WIDE_ARROW = pa.schema([("query_id", pa.int64()), ("q", pa.list_(pa.int64())), ("vec_id", pa.int64()),
                        ("score", pa.int64())])
MOST = (1 << 63) - 1


def _score_block(k: int):
    """The ``k`` best of a block of vectors for each query of a block."""
    def run(key, queries, vectors):
        out = []
        if queries.num_rows and vectors.num_rows:
            held, ids = vectors["v"].to_pylist(), vectors["ids"].to_pylist()
            x = np.array(held, object).reshape(len(held), key[0].as_py())
            for query_id, q in zip(queries["query_id"].to_pylist(), queries["q"].to_pylist()):
                scores = (x * np.array(q, object)).sum(axis=1).tolist() if q else [0] * len(held)
                best = heapq.nsmallest(k, ((-min(max(s, -MOST), MOST), i) for s, of_one in zip(scores, ids)
                                           for i in of_one if i != query_id))
                out += [{"query_id": query_id, "q": q, "vec_id": i, "score": -s} for s, i in best]
        return pa.Table.from_pylist(out, schema=WIDE_ARROW)

    return run


def scored(vectors: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """query_id, q, vec_id, score: at least the ``k`` best of ``vectors`` (vec_id, v)
    for each of ``queries`` (query_id, q), by all scores, block by block."""
    points = save(distinct_vectors(vectors, k), "scored-vectors")
    asked = save(queries.distinct().withColumn("dim", F.size("q")), "scored-queries")
    n_points, n_asked = (-(-max(1, df.count()) // block) for df in (points, asked))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    points = points.withColumn("pb", F.pmod(F.hash("v"), F.lit(n_points)).cast("int")).withColumn("qb", every(n_asked))
    asked = asked.withColumn("qb", F.pmod(F.hash("query_id"), F.lit(n_asked)).cast("int")).withColumn(
        "pb", every(n_points))
    return asked.groupBy("dim", "qb", "pb").cogroup(points.groupBy("dim", "qb", "pb")).applyInArrow(
        _score_block(k), WIDE_SCHEMA)


def _nearest_pivot(pivots: dict[int, np.ndarray], m_of: dict[int, int], names: list[str]):
    """Adds ``cell``, the nearest pivot's number, to rows with ``v`` and ``dim``."""
    def run(batches):
        spaces = {d: Space(m).points(pivots[d]) for d, m in m_of.items()}
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = Space(m_of[d]).points(vector_rows(batch.column("v").take(pa.array(at))))
                p = spaces[d]
                cell[at] = ((p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(cell)], [*names, "cell"])

    return run


def _open_trees(m_of: dict[int, int]):
    """Rows of a query block and a root block -> the trees that a query must visit."""
    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                routers = np.asarray([r["router"] for r in row["roots"]], np.int64).reshape(len(row["roots"]), row["dim"])
                reach = np.asarray([r["reach"] for r in row["roots"]])
                trees = [r["tree"] for r in row["roots"]]
                space = Space(m_of[row["dim"]])
                for query in row["queries"]:
                    q, bound = np.asarray(query["q"], np.int64), query["bound"]
                    away = space.of_score(int(q @ q), routers @ q)
                    for i in np.flatnonzero(away - reach <= bound + SLACK * (1 + bound)).tolist():
                        if trees[i] != query["home"]:
                            out.append({"dim": row["dim"], "tree": trees[i], "query_id": query["query_id"],
                                        "q": query["q"], "bound": bound})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("dim", pa.int32()), ("tree", pa.int64()), ("query_id", pa.int64()), ("q", pa.list_(pa.int32())),
                ("bound", pa.float64())]))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, tree_points: int = TREE_POINTS, page: int = PAGE,
          task_queries: int = TASK_QUERIES, block: int = BLOCK, more: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query.

    ``vectors`` has vec_id (long) and v (array<int>), ``queries`` query_id and
    q; nulls take no part.  A query's vector need not be among the vectors.
    ``more``: scores of the queries with other vectors (query_id, q, vec_id, score)."""
    spark = vectors.sparkSession
    points = save(distinct_vectors(vectors.filter("vec_id IS NOT NULL AND v IS NOT NULL"), k), "vectors")
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x.cast("long") * x)
    facts = points.groupBy("dim").agg(F.max(squares).alias("m"), F.count("*").alias("n")).collect()  # a row per length
    m_of, pivots = {r["dim"]: r["m"] for r in facts}, {}
    if not m_of:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for r in facts:
        some = points.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64("v"), "v").limit(
            min(PIVOTS, -(-r["n"] // tree_points)))
        found = [x["v"] for x in some.select("v").collect()]
        pivots[r["dim"]] = np.asarray(found, np.int64).reshape(len(found), r["dim"])

    def in_cells(df):
        return df.mapInArrow(_nearest_pivot(pivots, m_of, df.columns),
                             T.StructType([*df.schema.fields, T.StructField("cell", T.LongType())]))

    celled = save(in_cells(points), "cells")
    parts = save(celled.groupBy("dim", "cell").agg(
        F.ceil(F.count("*") / tree_points).cast("long").alias("parts")), "parts")
    # a tree's number: its cell, and a part of it where the cell is too large for one tree
    number = F.col("cell") * (1 << 40) + F.pmod(F.xxhash64("v"), "parts")
    trees = celled.join(parts, ["dim", "cell"]).select("dim", number.alias("tree"), "v", "ids")
    pages = save(trees.groupBy("dim", "tree").applyInArrow(_tree_pages(m_of, page), PAGE_SCHEMA), "pages")

    asked = queries.filter("query_id IS NOT NULL AND q IS NOT NULL").select("query_id", "q").distinct()
    asked = asked.withColumn("dim", F.size("q")).filter(F.col("dim").isin(*m_of))
    homes = in_cells(asked.withColumnRenamed("q", "v")).join(parts, ["dim", "cell"], "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1).cast("long"))).select(
        "dim", number.alias("tree"), "query_id", F.col("v").alias("q"), F.lit(float("inf")).alias("bound"))
    homes = save(homes, "queries")
    first = save(_visit(pages, homes, m_of, k, task_queries), "first")
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda t, x: t + x.cast("long") * x).cast("double")
    kth = first.groupBy("query_id", "q").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    m_col = F.element_at(F.create_map(*[F.lit(x) for kv in m_of.items() for x in kv]), F.col("dim")).cast("double")
    bounded = homes.drop("bound").join(kth, ["query_id", "q"], "left").withColumn("bound", F.coalesce(
        F.sqrt(F.greatest(norm + m_col - 2 * F.col("kth").cast("double"), F.lit(0.0))), F.lit(float("inf"))))
    # blocks of queries against blocks of roots; every pair of blocks is a row of its own
    roots = pages.filter("page = 0").select("dim", F.struct("tree", "router", "reach").alias("r"))
    n_roots, n_queries = max(1, roots.count()), max(1, homes.count())
    root_blocks, query_blocks = -(-n_roots // block), -(-n_queries // block)
    rb = roots.groupBy("dim", F.pmod(F.hash("r.tree"), F.lit(root_blocks)).alias("rb")).agg(
        F.collect_list("r").alias("roots"))
    qb = bounded.groupBy("dim", F.pmod(F.hash("query_id"), F.lit(query_blocks)).alias("qb")).agg(F.collect_list(
        F.struct("query_id", "q", "bound", F.col("tree").alias("home"))).alias("queries"))
    pairs = qb.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(root_blocks - 1)))).join(rb, ["dim", "rb"])
    visits = save(pairs.select("dim", "queries", "roots").mapInArrow(
        _open_trees(m_of), "dim int, tree long, query_id long, q array<int>, bound double"), "visits")
    found = first.unionByName(_visit(pages, visits, m_of, k, task_queries))
    return best_of(found if more is None else found.unionByName(more), k)


def best_of(found: DataFrame, k: int) -> DataFrame:
    # a query's k best by two sorted slices: of each tree's results only k come here
    best = found.groupBy("query_id", "q").agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("i", "b")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.s")).alias("score"))


def nearest_rows(embeddings: DataFrame, k: int = K, every: int = EVERY, **options) -> DataFrame:
    """``embeddings`` (vec_id, embedding): rows whose vec_id is divisible by
    ``every`` against all rows."""
    vec_id, e = F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")
    rows = embeddings.select(vec_id, quantised(e).alias("v"))

    def asked(df):
        return df.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    far = save(embeddings.select(vec_id, wide(e).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL"), "wide")
    if far.isEmpty():
        return top_k(rows, asked(rows), k, **options)
    block = options.get("block", BLOCK)
    long_rows = rows.filter("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("v", F.col("v").cast("array<bigint>"))
    more = scored(far, asked(long_rows), k, block).withColumn("q", F.col("q").cast("array<int>"))
    of_far = scored(long_rows.unionByName(far), asked(far), k, block)
    return top_k(rows, asked(rows), k, more=more, **options).unionByName(best_of(of_far, k))
