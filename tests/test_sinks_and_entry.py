"""Sinks and the driver contract."""

import json
import os

import pytest

from domquarry.sources.sinks import output_name, read_wide, write_results, write_wide


def _results(spark):
    return spark.sql("""SELECT 'People' AS template_name, 'https://x/p' AS url,
        TIMESTAMP '2024-01-02 03:04:05' AS scraped_at, false AS success,
        map('title', array('Café'), 'tags', array('a', 'b')) AS data,
        array(named_struct('container', 'cards', 'index', 0, 'source_page', 1,
              'fields', map('name', array('Ann'), 'areas', array('x', 'y')), 'error', CAST(NULL AS STRING))) AS records,
        array('boom') AS errors,
        named_struct('elements_found', 2, 'actions_executed', 0, 'page_title', 'T', 'final_url', 'https://x/p')
          AS metadata""")


def test_json_csv_workbook(spark, tmp_path):
    res = _results(spark)
    p = write_results(res, str(tmp_path / "j"), "JSON")
    row = json.loads(open([os.path.join(p, f) for f in os.listdir(p) if f.endswith(".json")][0],
                          encoding="utf-8").readline())
    assert list(row)[:4] == ["template_name", "url", "scraped_at", "success"]
    assert row["data"]["title"] == ["Café"] and row["scraped_at"].startswith("2024-01-02T03:04:05")
    p = write_results(res, str(tmp_path / "c"), "csv")
    csv = spark.read.option("header", True).csv(p).collect()[0]
    assert csv["tags_1"] == "a" and csv["tags_2"] == "b" and csv["title"] == "Café"
    assert csv["cards_1_name"] == "Ann" and csv["cards_1_areas_2"] == "y"
    p = write_results(res, str(tmp_path / "x"), "excel")
    assert sorted(os.listdir(p)) == ["errors", "metadata", "scraped_data"]
    meta = spark.read.option("header", True).csv(p + "/metadata").collect()[0]
    assert meta["scraped_at"] == "2024-01-02 03:04:05"
    with pytest.raises(ValueError):
        write_results(res, str(tmp_path / "z"), "xml")


def test_output_name():
    from datetime import datetime
    assert output_name("My Template", datetime(2024, 1, 2, 3, 4, 5)) == "my template_20240102_030405"


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"page_id", "url", "title", "h1", "n_links"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_wide_export_read_back_beyond_the_readers_columns(spark, tmp_path):
    """More columns than Spark's CSV reader takes; quotes, commas and empty cells as it reads them."""
    odd = ['a "b"', '"', '""', ',",', "", " x ", "\\", "é, \t'", "a\\\"b"]
    res = _results(spark).where("false").select("template_name", "url", "data", "records").unionByName(spark.createDataFrame([
        ("T", "u", {"odd": odd}, []), ("T, \"2\"", "v", {"odd": ["one"], "none": []}, []), ("T3", "w", {}, []),
        ("T4", None, {"x": ["y"]}, [])], "template_name string, url string, data map<string,array<string>>, records "
        "array<struct<container:string,index:int,source_page:int,fields:map<string,array<string>>,error:string>>").repartition(3))
    write_wide(res, p := str(tmp_path / "narrow"))
    rows, cells = read_wide(spark, p)
    plain = spark.read.option("header", True).option("escape", '"').csv(p).collect()
    key = repr
    assert sorted(map(tuple, rows.collect()), key=key) == sorted([(r.template_name, r.url) for r in plain], key=key)
    want = [(r.template_name, r.url, c, v) for r in plain for c, v in r.asDict().items()
            if c not in ("template_name", "url") and v is not None]
    assert sorted(map(tuple, cells.collect()), key=key) == sorted(want, key=key) and len(want) >= len(odd)
    wide = spark.range(2).selectExpr("concat('W', id) AS template_name", "'u' AS url", "map('v', transform("
                                     "sequence(1, 20000 + 1000 * cast(id AS int)), i -> concat(i, '\"'))) AS data").crossJoin(
        res.select("records").where("template_name = 'T3'"))
    write_wide(wide, p := str(tmp_path / "wide"))
    rows, cells = read_wide(spark, p)
    assert rows.count() == 2 and cells.groupBy("template_name").count().orderBy("count").collect() == [("W0", 20000), ("W1", 21000)]
    assert cells.where("value <> concat(substring(column, 3), '\"')").count() == 0


def test_workbook_of_a_wide_list(spark, monkeypatch):
    """The workbook's sheets read back where the data has more columns than Spark's CSV reader takes."""
    from pyspark.sql import functions as F

    from domquarry.jobs import scrape_queries
    res = _results(spark).withColumn("data", F.expr("map('v', transform(sequence(1, 20500), i -> concat('x', i)))"))
    monkeypatch.setattr(scrape_queries, "_nation_results", lambda spark, sf_dir: res)
    got = {r["sheet"]: r["count"] for r in scrape_queries.workbook_export_roundtrip(spark, "").groupBy("sheet").count().collect()}
    assert got == {"scraped_data": 20503, "metadata": 3, "errors": 1}
