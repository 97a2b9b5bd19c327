"""Items of a stream that runs over many triggers and a long span of event time."""

import os
from datetime import datetime, timedelta

from domquarry.jobs import stream_queries
from domquarry.streaming import incremental


def test_items_once_whatever_the_span(spark, tmp_path, monkeypatch):
    days = [[("a", 1, 0)], [("b", 2, 100)], [("c", 3, 200)], [("a", 1, 300), ("d", 4, 1), ("b", 2, 90)], [("a", 1, 400)]]
    for i, rows in enumerate(days):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame([(n, datetime(2024, 1, 1) + timedelta(days=d), u, t, 0.0, "{}")
                               for n, (t, u, d) in enumerate(rows)], stream_queries.EVENTS_SCHEMA).coalesce(1).write.parquet(part)
        os.utime(part, (1_700_000_000 + i * 60,) * 2)
        os.symlink(part, str(tmp_path / f"events{i}.parquet"))
        for name in os.listdir(part):
            os.utime(os.path.join(part, name), (1_700_000_000 + i * 60,) * 2)
    read = incremental.read_stream
    monkeypatch.setattr(incremental, "read_stream", lambda s, path, schema: read(s, path, schema, max_files=1))
    got = [tuple(r) for r in stream_queries.stream_event_types(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
