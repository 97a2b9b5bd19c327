"""Streams over several triggers: replayed batches count once, the stop rule from keyed state."""

import glob
import os
import random

import pytest

from domquarry.streaming import epochs, incremental
from domquarry.streaming.epochs import EpochTable

PAGES = "page_id BIGINT, url STRING, html STRING"
ROW = "a BIGINT"


def _rows(table, schema=ROW):
    return sorted((r.epoch, r.a) for r in table.read(schema).collect())


def test_an_epoch_counts_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(epochs, "FOLD", 2)
    table = EpochTable(spark, str(tmp_path / "t"))
    assert _rows(table) == [] and table.committed() == {}
    for n in range(5):
        table.write(spark.createDataFrame([(10 * n,), (10 * n + 1,)], ROW), n)
    want = [(n, 10 * n + d) for n in range(5) for d in (0, 1)]
    assert _rows(table) == want
    table.write(spark.createDataFrame([(40,), (41,)], ROW), 4)  # run again, as after a lost commit
    table.write(spark.createDataFrame([(20,), (21,), (22,)], ROW), 2)  # an epoch that has been folded
    assert _rows(EpochTable(spark, str(tmp_path / "t"))) == sorted([*want, (2, 22)])
    assert len(glob.glob(str(tmp_path / "t/data/epoch-*"))) == 5
    # rows that were written but never named by a manifest
    spark.createDataFrame([(99,)], ROW).write.parquet(str(tmp_path / "t/data/epoch-000000007-abc"))
    assert _rows(table) == sorted([*want, (2, 22)])
    table.write(spark.createDataFrame([], ROW), 5)
    assert _rows(table) == sorted([*want, (2, 22)])


def test_replayed_batch_of_extraction(spark, tmp_path):
    for n in range(4):
        spark.createDataFrame([(10 * n + k, f"u{n}{k}", f"<p>{n}{k}</p>") for k in range(3)], PAGES).coalesce(1).write.parquet(
            str(tmp_path / f"in/pages{n}.parquet"))
    out, source = str(tmp_path / "out"), str(tmp_path / "in/pages*.parquet")

    def run():
        incremental.stream_extract(spark, source, lambda b: b.selectExpr("page_id AS a"), out, max_files=1)
        return _rows(EpochTable(spark, out))

    first = run()
    assert sorted(a for _, a in first) == sorted(10 * n + k for n in range(4) for k in range(3))
    assert len({e for e, _ in first}) == 4
    # the stream dies after its sink has written and before Spark notes the batch as done
    last = max(glob.glob(f"{out}_ckpt/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(last)
    if os.path.exists(crc := os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        os.remove(crc)
    assert run() == first


def _stopped(items, k, max_pages=None):
    """(stop_page, pages_walked, n_items) of one crawl's (day, item) pairs."""
    first = {}
    for day, item in items:
        first[item] = min(day, first.get(item, day))
    day0, n_pages = min(first.values()), max(d for d, _ in items) - min(first.values()) + 1
    n_pages = min(n_pages, max_pages or n_pages)
    streak, walked, stop = 0, n_pages, None
    for page in range(1, n_pages + 1):
        streak = 0 if day0 + page - 1 in first.values() else streak + 1
        if streak == k:
            stop = walked = page
            break
    return stop, walked, sum(d - day0 < walked for d in first.values())


@pytest.mark.parametrize("k, max_pages", [(3, None), (2, 6)])
def test_stop_rule_over_triggers_with_late_days(spark, tmp_path, k, max_pages):
    rng = random.Random(k)
    rows = [(c, rng.choice([1, 2, 3, 9, 10, 14, 20, 21]) + c, f"i{rng.randrange(4 + 8 * c)}") for c in range(4) for _ in range(30)]
    rows += [(7, 5, "only")] * 3
    rng.shuffle(rows)
    schema = "crawl_id LONG, day LONG, item STRING"
    for n in range(5):
        part = [*rows[n::5], (None, 1, "x"), (3, None, "x"), (3, 1, None)]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"items{n}.parquet"))
    own = incremental.stream_session(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    items = incremental.read_stream(own, str(tmp_path / "items*.parquet"), schema, max_files=1)
    out = incremental.stream_empty_streak(items, str(tmp_path / "out"))
    got = {r.crawl_id: r for r in incremental.walked(spark, out, k, max_pages).collect()}
    want = {c: _stopped([(d, i) for x, d, i in rows if x == c], k, max_pages) for c in (0, 1, 2, 3, 7)}
    assert {c: (r.stop_page, r.pages_walked, r.n_items) for c, r in got.items()} == want
    assert max(r.triggers for r in got.values()) > 2 and any(r.late_pages for r in got.values())
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_stop_rule_of_many_crawls_without_a_call_per_key(spark, tmp_path):
    """Thousands of keys a trigger: the state is the store's own aggregation; counters as by a row-wise model."""
    rng = random.Random(5)
    schema, triggers = "crawl_id LONG, day LONG, item STRING", 3
    parts = [[(c, rng.choice([1, 2, 6, 7, 12]), f"i{rng.randrange(4)}") for c in range(1500) for _ in range(rng.randrange(4))]
             for _ in range(triggers)]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part := str(tmp_path / f"items{n}.parquet"))
        for name in os.listdir(part):
            os.utime(os.path.join(part, name), (1_700_000_000 + n * 60,) * 2)
    items = incremental.read_stream(incremental.stream_session(spark), str(tmp_path / "items*.parquet"), schema, max_files=1)
    out = incremental.stream_empty_streak(items, str(tmp_path / "out"))
    named = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{out}_ckpt/state/0/_metadata/*"))
    assert "stateStoreSave" in named and "InPandas" not in named
    got = {r.crawl_id: tuple(r)[1:] for r in incremental.walked(spark, out).collect()}
    names = spark.createDataFrame([(f"i{k}",) for k in range(4)], "item STRING")
    shard = {r.item: r.s for r in names.selectExpr("item", f"pmod(xxhash64(item), {incremental.SHARDS}) AS s").collect()}
    want = {}
    for c in {c for rows in parts for c, _, _ in rows}:
        late, top, seen = 0, {}, {}
        for rows in parts:
            own = [(d, shard[i]) for x, d, i in rows if x == c]
            late += sum(d < top.get(s, d) for d, s in own)
            for s in {s for _, s in own}:
                top[s] = max([top.get(s, 0), *(d for d, x in own if x == s)])
                seen[s] = seen.get(s, 0) + 1
        want[c] = (*_stopped([(d, i) for rows in parts for x, d, i in rows if x == c], 3), late, max(seen.values()))
    assert got == want
