"""End-to-end scrape queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.scrape import RECORD_TYPE, flatten, item_totals, scrape
from ..session import checkpoint_dir
from ..sources.sinks import export_results, read_wide
from ..sources.templates import templates_from_json
from .common import page_dom, sql_decode, sql_strip, table
from .directory_queries import _POSITION, _SECTORS, PER_PAGE, rendered_dom


def nation_templates(nation):
    """One directory template per nation (JSON built in Spark): title, a
    headline required on even nations (absent on the page, so those runs fail), a
    list of cards whose links are followed, and a second list on the same cards
    whose only field every other card lacks.  The listing goes on while it shows a
    next link.  Nations with key % 5 = 4 point at a page that does not exist."""
    n = F.col("n_nationkey")
    url = F.concat(F.lit("https://dir.example/nation/"), n.cast("string"), F.lit("/people?page="),
                   F.when(n % 5 == 4, F.lit("0")).otherwise(F.lit("1")))
    doc = F.concat(
        F.lit('{"name":"nation-'), n.cast("string"), F.lit('","url":"'), url,
        F.lit('","enable_subpage_scraping":true,"pagination":{"pattern_type":"button","next_selector":"a.next"},'
              '"elements":[{"label":"title","selector":"title"},{"label":"headline","selector":"h1",'
              '"is_required":'), F.when(n % 2 == 0, F.lit("true")).otherwise(F.lit("false")),
        F.lit('},{"label":"cards","selector":"div.profile-card","is_container":true,"sub_elements":['
              '{"label":"name","selector":"h3"},{"label":"position","selector":"span.position"},'
              '{"label":"profile","selector":"a.profile","element_type":"link"}],"subpage_elements":['
              '{"label":"education","selector":"ul.education li"},{"label":"admissions","selector":"ul.admissions li"}]},'
              '{"label":"extras","selector":"div.profile-card","is_container":true,"sub_elements":['
              '{"label":"extra","selector":"span.sector + span.sector"},{"label":"broken","selector":"b[["}]}]}'))
    return templates_from_json(nation.select(doc.alias("json")))


def _nation_results(spark, sf_dir):
    dom, planner = rendered_dom(spark, sf_dir)
    return scrape(dom, planner, nation_templates(table(spark, sf_dir, "nation")))


def scrape_directories(spark, sf_dir):
    """X2 (+A4): every nation template run on all pages of its listing."""
    res = _nation_results(spark, sf_dir)
    first_name = F.get(F.get("records", 0)["fields"]["name"], 0)
    return res.select("template_name", "url", "success", F.size("errors").cast("bigint").alias("n_errors"),
                      F.col("metadata.page_title").alias("page_title"),
                      F.col("metadata.elements_found").cast("bigint").alias("elements_found"),
                      F.size("records").cast("bigint").alias("n_records"), first_name.alias("first_name"))


_NATIONS = """
WITH c AS (
  SELECT n_nationkey, n_name, count(s_suppkey) AS ns, min(s_suppkey) AS k0
  FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name),
f AS (SELECT *, n_nationkey % 5 <> 4 AND ns > 0 AS fetched, 'nation-' || n_nationkey AS template_name,
             'https://dir.example/nation/' || n_nationkey || '/people?page=' ||
               CASE WHEN n_nationkey % 5 = 4 THEN '0' ELSE '1' END AS url FROM c)"""

SCRAPE_DIRECTORIES_SQL = f"""{_NATIONS}
SELECT template_name, url, fetched AND n_nationkey % 2 <> 0 AS success,
       CAST(CASE WHEN NOT fetched OR n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_errors,
       CASE WHEN fetched THEN 'People · ' || n_name || ' · page 1' END AS page_title,
       CAST(CASE WHEN fetched THEN 3 ELSE 0 END AS BIGINT) AS elements_found,
       CAST(CASE WHEN fetched THEN 2 * ns ELSE 0 END AS BIGINT) AS n_records,
       CASE WHEN fetched THEN (SELECT s_name FROM supplier WHERE s_suppkey = k0) END AS first_name
FROM f
"""


def _record_rows(results):
    """Every field of every record, one row each."""
    r = results.select("template_name", F.explode("records").alias("r"))
    return r.select("template_name", F.col("r.container").alias("container"),
                    F.col("r.index").cast("bigint").alias("record_index"),
                    F.col("r.source_page").cast("bigint").alias("source_page"), F.col("r.error").alias("error"),
                    F.explode("r.fields").alias("field", "vs")).withColumn("value", F.array_join("vs", "|")).drop("vs")


def scrape_records(spark, sf_dir):
    """X2 with W3, C1, C5, C6, J1, J3: every field of every record of all
    listing pages, profile pages merged."""
    return _record_rows(_nation_results(spark, sf_dir))


_RECORDS = f"""
WITH s AS (
  SELECT s.*, n.n_name, r_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS rnk,
         'nation-' || s_nationkey AS template_name
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region ON n_regionkey = r_regionkey),
q AS (
  SELECT template_name, 'cards' AS container, rnk, NULL AS error, s_nationkey, unnest([
           {{'field': 'name', 'vs': [s_name]}}, {{'field': 'position', 'vs': [{_POSITION}]}},
           {{'field': 'profile', 'vs': ['https://dir.example/lawyer/' || s_suppkey]}},
           {{'field': CASE WHEN s_suppkey % 10 <> 3 THEN 'education' END,
             'vs': ['University of ' || n_name, r_name || ' Law School']}},
           {{'field': CASE WHEN s_suppkey % 10 <> 3 THEN 'admissions' END, 'vs': ['Bar of ' || n_name]}}]) AS f FROM s
  UNION ALL
  SELECT template_name, 'extras', rnk, 'Unsupported selector: b[[', s_nationkey,
         CASE WHEN s_suppkey % 2 = 0 THEN {{'field': 'extra', 'vs': ['Sector ' || (s_suppkey % 5 + 10)]}}
         ELSE {{'field': 'text', 'vs': [s_name || {_POSITION} || lower(replace(s_name, '#', '.')) || '@dir.example' ||
                                        'View profile' || replace({_SECTORS}, '|', '')]}} END FROM s),
rec AS (
  SELECT template_name, container, CAST(rnk AS BIGINT) AS record_index, CAST(rnk // {PER_PAGE} + 1 AS BIGINT) AS source_page,
         error, f.field AS field, f.vs AS vs FROM q WHERE s_nationkey % 5 <> 4 AND f.field IS NOT NULL)"""

SCRAPE_RECORDS_SQL = f"""{_RECORDS}
SELECT template_name, container, record_index, source_page, error, field, array_to_string(vs, '|') AS value FROM rec
"""


def _summary_template(spark):
    doc = ('{"name":"summary","url":"https://example.com/","elements":[{"label":"title","selector":"title"},'
           '{"label":"links","selector":"nav li a","element_type":"link","is_multiple":true}]}')
    return templates_from_json(spark.createDataFrame([(doc,)], "json string"))


def flatten_page_results(spark, sf_dir):
    """S8 + X2 + P14: one template over every page URL (batch), results
    flattened to table columns (``links_1 .. links_n``)."""
    dom, planner = page_dom(spark, sf_dir)
    urls = table(spark, sf_dir, "pages").select(F.lit("summary").alias("template_name"), "url")
    res = scrape(dom, planner, _summary_template(spark), urls=urls)
    return flatten(res).select("url", "column", "value")


_HREFS = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)"
FLATTEN_PAGE_RESULTS_SQL = f"""
SELECT url, 'title' AS column,
       {sql_strip(sql_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS value FROM pages
UNION ALL
SELECT url, 'links', {_HREFS}[1] FROM pages WHERE len({_HREFS}) = 1
UNION ALL
SELECT url, 'links_' || generate_subscripts({_HREFS}, 1), unnest({_HREFS}) FROM pages WHERE len({_HREFS}) > 1
"""


def result_item_totals(spark, sf_dir):
    """Items per result (list lengths summed, records counted)."""
    return item_totals(_nation_results(spark, sf_dir)).select(
        "template_name", F.col("items").cast("bigint").alias("items"))


RESULT_ITEM_TOTALS_SQL = f"""{_NATIONS}
SELECT template_name, CAST(CASE WHEN fetched THEN 1 + 2 * ns ELSE 0 END AS BIGINT) AS items FROM f
"""


def _exported(spark, sf_dir, fmt):
    folder = f"{checkpoint_dir(spark).rstrip('/')}/exports/{uuid.uuid4().hex}"
    return export_results(_nation_results(spark, sf_dir), folder, "Nations", fmt)


def json_export_roundtrip(spark, sf_dir):
    """Scrape results written through the JSON sink and read back: every
    field of every record, every page-level value, and one row per error."""
    back = spark.read.schema(
        f"template_name string, url string, success boolean, data map<string,array<string>>, records {RECORD_TYPE}, "
        "errors array<string>").json(_exported(spark, sf_dir, "JSON"))
    data = back.select("template_name", F.explode("data").alias("field", "vs")).select(
        "template_name", F.lit("data").alias("container"), "field", F.array_join("vs", "|").alias("value"))
    errors = back.select("template_name", F.lit("errors").alias("container"), F.lit("error").alias("field"),
                         F.explode("errors").alias("value"))
    records = _record_rows(back).select("template_name", "container", F.concat(
        F.col("record_index").cast("string"), F.lit(" "), "field").alias("field"), "value")
    return data.unionByName(errors).unionByName(records)


_TITLE = "'People · ' || n_name || ' · page 1'"
_ERROR = """CASE WHEN NOT fetched THEN 'Failed to fetch page: ' || url
                 ELSE 'Failed to extract headline: Required element not found: h1' END"""

JSON_EXPORT_ROUNDTRIP_SQL = f"""{_RECORDS},{_NATIONS.replace("WITH ", "", 1)}
SELECT template_name, container, record_index || ' ' || field AS field, array_to_string(vs, '|') AS value FROM rec
UNION ALL SELECT template_name, 'data', 'title', {_TITLE} FROM f WHERE fetched
UNION ALL SELECT template_name, 'errors', 'error', {_ERROR} FROM f WHERE NOT fetched OR n_nationkey % 2 = 0
"""


def _long(table):
    """A table with a header as rows (template_name, url, column, value); null cells give none."""
    names = [c for c in table.columns if c not in ("template_name", "url")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in names])
    return table.select("template_name", "url", F.inline(cells)).where("value IS NOT NULL")


def csv_export_roundtrip(spark, sf_dir):
    """S6 (+P14): scrape results flattened into CSV columns and read back, every
    cell; results without data have a row too."""
    rows, cells = read_wide(spark, _exported(spark, sf_dir, "csv"))
    return cells.unionByName(rows.withColumns({"column": F.lit("(row)"), "value": F.lit("1")}))


_CELLS = f"""{_RECORDS},{_NATIONS.replace("WITH ", "", 1)},
cell AS (
  SELECT template_name, container || '_' || (record_index + 1) || '_' || field ||
           CASE WHEN len(vs) > 1 THEN '_' || generate_subscripts(vs, 1) ELSE '' END AS "column", unnest(vs) AS value FROM rec
  UNION ALL SELECT DISTINCT template_name, container || '_' || (record_index + 1) || '_error', error FROM rec
  WHERE error IS NOT NULL
  UNION ALL SELECT template_name, 'title', {_TITLE} FROM f WHERE fetched)"""

CSV_EXPORT_ROUNDTRIP_SQL = f"""{_CELLS}
SELECT cell.template_name, url, "column", value FROM cell JOIN f USING (template_name)
UNION ALL SELECT template_name, url, '(row)', '1' FROM f
"""


def workbook_export_roundtrip(spark, sf_dir):
    """The three datasets of the workbook sink, read back, every cell."""
    path = _exported(spark, sf_dir, "excel")

    def table_of(name, key="template_name"):
        t = spark.read.option("header", True).option("escape", "\"").csv(f"{path}/{name}").withColumnRenamed(key, "template_name")
        return _long(t.drop("scraped_at"))

    def sheet(name, cells):
        return cells.select(F.lit(name).alias("sheet"), "template_name", "column", "value")

    # the sheet of the data is as wide as the longest list, the others have a few columns
    return sheet("scraped_data", read_wide(spark, f"{path}/scraped_data")[1]).unionByName(
        sheet("metadata", table_of("metadata", "name"))).unionByName(sheet("errors", table_of("errors")))


WORKBOOK_EXPORT_ROUNDTRIP_SQL = f"""{_CELLS}
SELECT 'scraped_data' AS sheet, template_name, "column", value FROM cell
UNION ALL
SELECT 'metadata', template_name, unnest(['success', 'elements_found', 'actions_executed']),
       unnest([CASE WHEN fetched AND n_nationkey % 2 <> 0 THEN 'true' ELSE 'false' END,
               CASE WHEN fetched THEN '3' ELSE '0' END, '0']) FROM f
UNION ALL
SELECT 'errors', template_name, 'error', {_ERROR} FROM f WHERE NOT fetched OR n_nationkey % 2 = 0
"""
