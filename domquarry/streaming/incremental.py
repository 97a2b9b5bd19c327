"""Structured Streaming versions of the incremental operators.

* R1 ``stream_extract``: newly arrived pages are tokenised and extracted in
  ``foreachBatch`` (selector self-joins are batch plans over each
  micro-batch) and written to an ``EpochTable``, in which a batch that is run
  again counts once;
* R2 ``stream_distinct_items``: cross-batch item de-duplication with
  ``dropDuplicates`` (``dropDuplicatesWithinWatermark`` when an event-time
  column is given);
* R3 ``stream_empty_streak``: the empty-streak stop rule (W1).  Items of a crawl are
  dealt over ``SHARDS`` shards; a streaming aggregation keeps, in the RocksDB store, an entry per
  item of a shard (the first day it was seen) and one per day of a shard (how many rows it has had).
  A trigger reads and writes the entries of the items and days it sees, nothing else, in
  the store's own code without a call to Python per key, and passes them on; ``walked`` puts
  them together and applies the rule.  Entries are keyed by item and day too, so a crawl with a third
  of all rows is spread over many tasks, and late pages (a day before the latest one already
  seen) are folded in exactly.

Every stream runs under a checkpoint folder inside ``spark.checkpoint.dir``
so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .epochs import EpochTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session for streams with the RocksDB state store; the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def stream_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def read_stream(spark: SparkSession, path_glob: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path_glob)


def stream_extract(spark: SparkSession, pages_glob: str, extract_fn, out_dir: str,
                   pages_schema: str = "page_id BIGINT, url STRING, html STRING", max_files: int | None = None) -> str:
    """``extract_fn(pages_batch_df)`` runs per micro-batch and returns the
    output DataFrame, or ``(output, dom)``; the output becomes the batch's epoch of the
    ``EpochTable`` in ``out_dir`` and the batch's node table is released afterwards,
    so a long-running stream does not accumulate cached batches."""
    stream = read_stream(spark, pages_glob, pages_schema, max_files)

    def run(batch: DataFrame, batch_id: int):
        res = extract_fn(batch)
        out, dom = res if isinstance(res, tuple) else (res, None)
        try:
            EpochTable(spark, out_dir).write(out, batch_id)
        finally:
            if dom is not None:
                dom.unpersist()

    q = (stream.writeStream.foreachBatch(run).option("checkpointLocation", out_dir + "_ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


def stream_distinct_items(spark: SparkSession, events_glob: str, schema, keys: list[str], out_dir: str,
                          event_time: str | None = None, delay: str = "1 hour") -> str:
    """R2: each item once across all micro-batches."""
    s = read_stream(spark, events_glob, schema)
    if event_time:
        s = s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    else:
        s = s.dropDuplicates(keys)
    q = (s.select(*keys).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", out_dir + "_ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


SHARDS = 32  # shards over which the items of a crawl are dealt
SEEN = "crawl_id LONG, shard INT, item STRING, on_day LONG, first_day LONG, n LONG"


def stream_empty_streak(items: DataFrame, out_dir: str) -> str:
    """R3 on a streaming ``items(crawl_id LONG, day LONG, item STRING)`` frame of a ``stream_session``;
    items without a crawl, day or name are no items.  Read the result with ``walked``."""
    spark = items.sparkSession
    items = items.where("crawl_id IS NOT NULL AND day IS NOT NULL AND item IS NOT NULL").select(
        "crawl_id", F.pmod(F.xxhash64("item"), F.lit(SHARDS)).cast("int").alias("shard"), "day", "item")
    # a row counts twice: for its item and for its day
    both = F.array(F.struct("item", F.lit(None).cast("long").alias("on_day")),
                   F.struct(F.lit(None).cast("string").alias("item"), F.col("day").alias("on_day")))
    seen = (items.select("crawl_id", "shard", "day", F.inline(both)).groupBy("crawl_id", "shard", "item", "on_day")
            .agg(F.min("day").alias("first_day"), F.count(F.lit(1)).alias("n")))
    q = (seen.writeStream.foreachBatch(lambda batch, epoch: EpochTable(spark, out_dir).write(batch, epoch))
         .option("checkpointLocation", out_dir + "_ckpt").outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    return out_dir


def walked(spark: SparkSession, out_dir: str, k: int = 3, max_pages: int | None = None) -> DataFrame:
    """What ``stream_empty_streak`` has come to: crawl_id, stop_page (of the first ``k`` pages in a row without a
    new item, else null), pages_walked, n_items, late_pages, triggers.  The earliest first day of an item counts;
    late are the rows of a trigger with a day before the latest that their shard had seen in triggers before."""
    rows = EpochTable(spark, out_dir).read(SEEN)
    # n grows from epoch to epoch: what an epoch adds to a day is the difference
    added = F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("crawl_id", "shard", "on_day").orderBy("epoch")), F.lit(0))
    top = F.max("on_day").over(Window.partitionBy("crawl_id", "shard").orderBy("epoch").rangeBetween(
        Window.unboundedPreceding, -1))
    counters = rows.where("on_day IS NOT NULL").withColumns({"added": added, "top": top}).groupBy("crawl_id", "shard").agg(
        F.max("on_day").alias("max_day"), F.sum(F.when(F.col("on_day") < F.col("top"), F.col("added")).otherwise(0)).alias(
            "late_pages"), F.count_distinct("epoch").alias("triggers"))
    crawls = counters.groupBy("crawl_id").agg(F.max("max_day").alias("max_day"), F.sum("late_pages").alias("late_pages"),
                                              F.max("triggers").alias("triggers"))
    firsts = rows.where("item IS NOT NULL").groupBy("crawl_id", "item").agg(F.min("first_day").alias("day"))
    days = firsts.groupBy("crawl_id", "day").agg(F.count(F.lit(1)).alias("n"))
    # a row per crawl and day with news: no more than the days of the span
    by_day = Window.partitionBy("crawl_id").orderBy("day")
    days = days.join(crawls, "crawl_id").select(
        "*", F.min("day").over(Window.partitionBy("crawl_id")).alias("day0"), F.lead("day").over(by_day).alias("next"))
    page, span = F.col("day") - F.col("day0") + 1, F.col("max_day") - F.col("day0") + 1
    pages = F.least(span, F.lit(max_pages)) if max_pages is not None else span
    stop = page + k
    days = days.withColumns({"page": page, "pages": pages}).withColumn("stop", F.when(
        (stop < F.coalesce(F.col("next") - F.col("day0") + 1, span + 1)) & (stop <= F.col("pages")), stop))
    days = days.withColumn("stop", F.min("stop").over(Window.partitionBy("crawl_id")))
    return days.groupBy("crawl_id").agg(
        F.min("stop").alias("stop_page"), F.min(F.coalesce("stop", "pages")).alias("pages_walked"),
        F.sum(F.when(F.col("page") <= F.coalesce("stop", "pages"), F.col("n")).otherwise(0)).alias("n_items"),
        F.min("late_pages").alias("late_pages"), F.min("triggers").alias("triggers"))
