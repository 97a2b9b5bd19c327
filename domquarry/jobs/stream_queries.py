"""Streaming queries (R1-R3), each run to completion with availableNow into a
fresh folder under ``spark.checkpoint.dir`` and read back; oracles are the
batch SQL of the same operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import read_table
from ..streaming.epochs import EpochTable
from ..streaming.incremental import read_stream, stream_distinct_items, stream_empty_streak, stream_extract, \
    stream_folder, stream_session, walked
from .page_queries import PAGE_SUMMARY_SQL, page_summaries

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

#: Files in which a table arrives at a stream, and files of a trigger.
FILES, FILES_PER_TRIGGER = 6, 2


def arriving(spark, sf_dir, name):
    """The stand-in for files that arrive one by one: the table's rows, dealt over ``FILES`` files at least."""
    folder, rows = stream_folder(spark, f"arriving-{name}"), read_table(spark, sf_dir, name)
    rows.repartition(max(FILES, rows.rdd.getNumPartitions())).write.parquet(folder)
    return folder


SUMMARY = "page_id BIGINT, url STRING, title STRING, h1 STRING, n_links BIGINT"


def stream_page_summary(spark, sf_dir):
    """Pages arriving over several triggers, extracted per micro-batch into an epoch table."""
    out = stream_folder(spark, "page-summary")
    stream_extract(spark, arriving(spark, sf_dir, "pages"), page_summaries, out, max_files=FILES_PER_TRIGGER)
    return EpochTable(spark, out).read(SUMMARY).drop("epoch")


STREAM_PAGE_SUMMARY_SQL = PAGE_SUMMARY_SQL


def stream_event_types(spark, sf_dir):
    """R2: (user, event type) pairs, each emitted once across batches."""
    out = stream_folder(spark, "event-types")
    # no event time: state is one entry per distinct item, so a late or repeated event changes nothing
    stream_distinct_items(spark, f"{sf_dir.rstrip('/')}/events*.parquet", EVENTS_SCHEMA,
                          ["user_id", "event_type"], out)
    return spark.read.parquet(out)


STREAM_EVENT_TYPES_SQL = "SELECT DISTINCT user_id, event_type FROM events"


def stream_event_walk(spark, sf_dir):
    """The empty-streak stop rule (k=3) over several triggers with late days, from keyed state."""
    own = stream_session(spark)
    ev = read_stream(own, arriving(spark, sf_dir, "events"), EVENTS_SCHEMA, FILES_PER_TRIGGER)
    items = ev.select(F.col("user_id").alias("crawl_id"),
                      (F.unix_date(F.to_date("ts"))).cast("long").alias("day"), F.col("event_type").alias("item"))
    out = stream_empty_streak(items, stream_folder(spark, "event-walk"))
    return walked(spark, out, k=3).select(F.col("crawl_id").alias("user_id"), "stop_page", "pages_walked", "n_items")


from .pagination_queries import EVENT_WALK_SQL  # noqa: E402

STREAM_EVENT_WALK_SQL = EVENT_WALK_SQL
