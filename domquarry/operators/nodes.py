"""Pages -> node table, in one Arrow-batched Python pass per partition.

``build_dom(pages)`` returns a ``Dom``:

* ``nodes``  -- one row per element (schema below), document order = node_id;
* ``docs``   -- one row per page: ``page_id, url, doc_text`` (all text, in order;
  null where the page has no html);
* ``pages``  -- the input (``page_id, url`` and ``html`` for outer-HTML values).

The full text of a node is ``substring(doc_text, text_start + 1, text_end -
text_start)`` and its outer HTML ``substring(html, html_start + 1, html_end -
html_start)``: offsets keep the table linear in page size instead of storing
the text once per ancestor.  ``short_text`` is the full text of a node where it is
short (a bounded number of characters per node), so the page text is cut only for
the few long ones.  ``path`` lists the ancestor node ids (root first),
so "is a descendant of" becomes an equi-join on ``(page_id, node_id)`` after
``explode(path)`` -- this spreads even a single huge page over many tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.htmltree import parse_page

NODE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("n_sib", T.IntegerType()),
    T.StructField("type_ordinal", T.IntegerType()),
    T.StructField("type_count", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("elem_id", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("own_text", T.StringType()),
    T.StructField("text_start", T.IntegerType()),
    T.StructField("text_end", T.IntegerType()),
    T.StructField("html_start", T.IntegerType()),
    T.StructField("html_end", T.IntegerType()),
    T.StructField("path", T.ArrayType(T.IntegerType())),
    T.StructField("doc_text", T.StringType()),
    T.StructField("short_text", T.StringType()),
    T.StructField("url", T.StringType()),
])

_ARROW_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()),
    ("depth", pa.int32()), ("ordinal", pa.int32()), ("n_sib", pa.int32()),
    ("type_ordinal", pa.int32()), ("type_count", pa.int32()), ("tag", pa.string()),
    ("elem_id", pa.string()), ("classes", pa.list_(pa.string())),
    ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()),
    ("text_start", pa.int32()), ("text_end", pa.int32()), ("html_start", pa.int32()),
    ("html_end", pa.int32()), ("path", pa.list_(pa.int32())), ("doc_text", pa.string()), ("short_text", pa.string()),
    ("url", pa.string()),
])
_FIELDS = [f.name for f in _ARROW_SCHEMA][1:-1]
# Flush an output batch once this many nodes are buffered (bounded task memory).
_FLUSH_NODES = 50_000
# HTML per partition of the node table, whose rows take two to three times as much in a shuffle.
HTML_PER_PARTITION = 16 << 20


def _tokenise_batches(batches):
    cols = {name: [] for name in _ARROW_SCHEMA.names}

    def flush():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(cols[n], type=_ARROW_SCHEMA.field(n).type) for n in _ARROW_SCHEMA.names],
            schema=_ARROW_SCHEMA)
        for v in cols.values():
            v.clear()
        return batch

    for batch in batches:
        ids = batch.column("page_id").to_pylist()
        htmls = batch.column("html").to_pylist()
        urls = batch.column("url").to_pylist()
        for pid, html, url in zip(ids, htmls, urls):
            rec = parse_page(html)
            if html is None:  # the page keeps its row, without text
                rec["doc_text"] = [None]
            n = len(rec["node_id"])
            cols["page_id"].extend([pid] * n)
            for name in _FIELDS:
                cols[name].extend(rec[name])
            cols["url"].append(url)
            cols["url"].extend([None] * (n - 1))
            if len(cols["page_id"]) >= _FLUSH_NODES:
                yield flush()
    if cols["page_id"]:
        yield flush()


class Dom:
    """Node table plus the per-page text it indexes into."""

    def __init__(self, raw: DataFrame, pages: DataFrame):
        self.raw = raw
        self.pages = pages
        self.nodes = raw.where(F.col("node_id") > 0).drop("doc_text", "url")
        # one row per page: its text and URL, on the node table's partitioning
        self.docs = raw.where(F.col("node_id") == 0).select("page_id", "url", "doc_text")

    def unpersist(self):
        self.raw.unpersist()

    def restrict(self, page_ids: DataFrame) -> "Dom":
        """The same node table limited to ``page_ids(page_id)`` (a semi-join
        that keeps the page partitioning): selectors then touch only those
        pages, e.g. the linked subpages of a directory."""
        return Dom(self.raw.join(page_ids.select("page_id").distinct(), "page_id", "left_semi"), self.pages)


def fetched_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with null html where a ``status`` outside 200 to 299 says that the page was not fetched."""
    if "status" not in pages.columns:
        return pages
    fetched = F.col("status").isNull() | F.col("status").between(200, 299)
    return pages.withColumn("html", F.when(fetched, F.col("html")))


def spread(src: DataFrame, min_partitions: int | None = None) -> tuple[DataFrame, int]:
    """``src`` dealt over the cluster's cores where its scan has fewer splits, and its number of splits."""
    target = min_partitions or src.sparkSession.sparkContext.defaultParallelism
    splits = src.rdd.getNumPartitions()  # planning only: a bare scan has no exchange to run
    return (src.repartition(target), target) if splits < target else (src, splits)


def build_dom(pages: DataFrame, persist: bool = True, min_partitions: int | None = None,
              num_partitions: int | None = None) -> Dom:
    """Tokenise ``pages(page_id, html, ...)`` into a ``Dom``.

    Where ``pages`` has a ``status`` column, only pages with a status of 200 to
    299 (or none) have html; the others keep their row, as pages that could not be
    fetched.

    The node table is hash-partitioned by ``page_id`` once.  Every later step
    is per page -- selector joins on ``(page_id, node_id)``, per-page
    aggregates and windows, the page-text join -- so with
    ``spark.sql.requireAllClusterKeysForCoPartition=false`` (``session.get_spark``,
    ``session.engine_defaults``) they all run on this partitioning without
    another exchange.  A page is also the unit the
    tokeniser handles in one task, so a ``page_id`` partition is bounded by
    the largest page, not by the data size.

    The scan is split further (round robin, before tokenising) only when it
    yields fewer partitions than the cluster has cores; at scale the file
    splits already give the parallelism.
    """
    pages = fetched_pages(pages)
    rows = pages.select("page_id", "html", "url")
    src, splits = spread(rows, min_partitions)
    # node partitions are sized by the HTML itself, not by the session's shuffle setting: splits
    # count file bytes, of which compressed HTML and its nodes are many times as much
    n = num_partitions
    if n is None:
        html = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        n = max(splits, -(-html // HTML_PER_PARTITION))
    raw = src.mapInArrow(_tokenise_batches, NODE_SCHEMA).repartition(n, "page_id")
    if persist:
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    return Dom(raw, pages)
