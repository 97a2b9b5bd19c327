"""Result sinks (S5, S6, S7): one call, ``write_results(results, path, fmt)``.

* ``json``  -- the result envelope, fixed column order, ISO timestamps,
  non-ASCII kept (S5);
* ``csv``   -- flattened columns (P14) with a header, UTF-8, quotes doubled inside
  quoted cells; empty data is an error (S6);
* ``excel`` -- re-aimed as three datasets under one path: ``scraped_data``,
  ``metadata`` and ``errors`` (the last only when there are errors) (S7).

Formats are case-insensitive; anything else is rejected.  Output folders
are named ``<lower-cased template name>_<yyyyMMdd_HHmmss>``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import row_number_within
from ..operators.scrape import RESULT_COLUMNS, flatten
from ..session import materialize

FORMATS = ("json", "csv", "excel")


def output_name(template_name: str, when: datetime | None = None) -> str:
    ts = (when or datetime.now()).strftime("%Y%m%d_%H%M%S")
    return f"{template_name.lower()}_{ts}"


def _envelope(results: DataFrame) -> DataFrame:
    return results.select(*RESULT_COLUMNS).withColumn(
        "scraped_at", F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _quoted(c: Column) -> Column:
    """A CSV cell: quotes doubled inside quotes; nothing for null."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def write_wide(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flattened results as CSV with a header, one line per result, also for a result
    without data.  The columns are the distinct flattened names (labels times list positions, as wide as
    the longest list).

    Names are a table with their places, numbered where they lie; the cells of a result are joined
    to it and stay sparse until its line is put together: each cell after as many commas as places
    lie between it and the one before.  So neither names nor cells pass the driver, and the width costs
    commas only.  The header is the first line of every file, as Spark's readers expect."""
    cells = materialize(flatten(results))
    names = materialize(row_number_within(cells.select("column").distinct(), [], "column", "_at"))
    width = names.count()
    if not width:
        raise ValueError("No data to export")
    key = ["template_name", "url"]
    placed = cells.join(names, "column").groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("_at", "value"))).alias("c"))
    # a result that is there twice has its cells twice
    once = F.filter("c", lambda x, i: (i == 0) | (x["_at"] != F.get("c", i - 1)["_at"]))
    placed = placed.withColumn("c", once)
    commas = F.transform("c", lambda x, i: F.concat(F.repeat(F.lit(","), (x["_at"] - F.when(
        i == 0, F.lit(0)).otherwise(F.get("c", i - 1)["_at"])).cast("int")), _quoted(x["value"])))
    last = F.element_at("c", -1)["_at"]
    placed = placed.select(*key, F.concat(F.array_join(commas, ""), F.repeat(F.lit(","), (width - last).cast("int"))).alias("t"))
    tail = F.coalesce("t", F.repeat(F.lit(","), F.lit(width)))
    lines = materialize(results.select(*key).join(placed, key, "left").select(
        F.concat(_quoted(F.col("template_name")), F.lit(","), _quoted(F.col("url")), tail).alias("value")))
    files = max(lines.rdd.getNumPartitions(), 1)
    header = names.agg(F.sort_array(F.collect_list(F.struct("_at", "column"))).alias("c")).select(
        F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("_file"), F.lit(False).alias("_data"),
        F.concat(F.lit('"template_name","url",'), F.array_join(F.transform("c", lambda x: _quoted(x["column"])), ",")).alias("value"))
    rows = lines.select(F.spark_partition_id().alias("_file"), F.lit(True).alias("_data"), "value")
    (header.unionByName(rows).repartitionById(files, F.col("_file")).sortWithinPartitions("_data").select("value")
     .write.mode(mode).text(path))


def read_wide(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_wide`` wrote: its lines ``(template_name, url)``, and their cells ``(template_name, url, column,
    value)``.  An empty cell is none, as to Spark's CSV reader.

    A table as wide as the longest list is read as rows, not as columns: every cell becomes a row with its place
    in the line, and the header's cells are the table of names to join.  So the plan does not grow with
    the width, and the reader's limit of 20,480 columns does not apply."""
    file = F.col("_metadata")
    lines = materialize(spark.read.option("lineSep", "\n").text(path).select(
        F.monotonically_increasing_id().alias("line"), file["file_path"].alias("file"),
        (file["file_block_start"] == 0).alias("_begins"), "value"))
    # the first line of each file; one of them names the columns
    heads = lines.where("_begins").groupBy("file").agg(F.min("line").alias("line"))
    data = lines.join(heads, "line", "left_anti")
    names = _placed(lines.join(heads.agg(F.min("line").alias("line")), "line")).select("_at", F.col("value").alias("column"))
    cells = materialize(_placed(data))
    one = lambda k: F.max(F.when(F.col("_at") == k, F.col("value")))
    keys = cells.where("_at < 2").groupBy("line").agg(one(0).alias("template_name"), one(1).alias("url"))
    rows = data.select("line").join(keys, "line", "left")
    long = cells.where("_at > 1").join(names, "_at").join(rows, "line")
    return rows.drop("line"), long.select("template_name", "url", "column", "value")


def _placed(lines: DataFrame) -> DataFrame:
    """The cells of lines in which all cells that are not empty are quoted: (line, _at, value).  Between quotes lie
    texts, outside of them commas; a text that is cut by no comma has a doubled quote there."""
    pieces = lines.select("line", F.posexplode(F.split("value", '"')).alias("_p", "_piece"))
    inside = F.col("_p") % 2 == 1
    at = F.sum(F.when(inside, 0).otherwise(F.length("_piece"))).over(Window.partitionBy("line").orderBy("_p").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    parts = pieces.withColumn("_at", at).where(inside).groupBy("line", "_at").agg(
        F.sort_array(F.collect_list(F.struct("_p", "_piece"))).alias("_c"))
    return parts.select("line", "_at", F.array_join("_c._piece", '"').alias("value")).where("value <> ''")


def write_results(results: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    f = (fmt or "").lower()
    if f not in FORMATS:
        raise ValueError(f"Unsupported export format: {fmt}")
    if f == "json":
        _envelope(results).write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif f == "csv":
        write_wide(results, path, mode)
    else:
        write_workbook(results, path, mode)
    return path


def export_results(results: DataFrame, folder: str, template_name: str, fmt: str = "json",
                   when: datetime | None = None) -> str:
    """Write under ``folder`` in a folder named by template and time; returns its path."""
    return write_results(results, f"{folder.rstrip('/')}/{output_name(template_name, when)}", fmt)


def write_workbook(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``scraped_data`` / ``metadata`` / ``errors`` datasets."""
    write_wide(results, f"{path}/scraped_data", mode)
    meta = results.select(
        F.col("template_name").alias("name"), "url",
        F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"), "success",
        F.col("metadata.elements_found").alias("elements_found"),
        F.col("metadata.actions_executed").alias("actions_executed"))
    meta.write.mode(mode).option("header", True).csv(f"{path}/metadata")
    errs = results.select("template_name", "url", F.explode("errors").alias("error"))
    if errs.limit(1).count() > 0:  # the sheet exists only when there are errors
        errs.write.mode(mode).option("header", True).csv(f"{path}/errors")
