"""Templates as data.

A template is one JSON document.  ``TEMPLATE_SCHEMA`` is its explicit Spark
schema; ``read_templates`` loads a folder of template files as rows with all
defaults filled, ``template_catalog`` lists them, ``validate_templates``
reports rule violations as rows.  ``normalise_template`` fills the same
defaults for a Python dict, which is what the plan builder consumes.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()
B = T.BooleanType()
D = T.DoubleType()
I = T.IntegerType()

SUB_ELEMENT = T.StructType([
    T.StructField("label", S), T.StructField("selector", S), T.StructField("element_type", S),
    T.StructField("attribute_name", S), T.StructField("is_required", B),
])
_ELEMENT_FIELDS = [
    T.StructField("label", S), T.StructField("selector", S), T.StructField("selector_type", S),
    T.StructField("element_type", S), T.StructField("attribute_name", S),
    T.StructField("is_multiple", B), T.StructField("is_required", B), T.StructField("is_container", B),
    T.StructField("use_find_similar", B), T.StructField("sub_elements", T.ArrayType(SUB_ELEMENT)),
    T.StructField("follow_links", B),
]
# recursion cut at depth 1: subpage elements hold no further subpage elements
SUBPAGE_ELEMENT = T.StructType(_ELEMENT_FIELDS)
ELEMENT = T.StructType(_ELEMENT_FIELDS + [T.StructField("subpage_elements", T.ArrayType(SUBPAGE_ELEMENT))])
ACTION = T.StructType([
    T.StructField("label", S), T.StructField("selector", S), T.StructField("action_type", S),
    T.StructField("wait_after", D), T.StructField("target_url", S),
    T.StructField("repeat_until_missing", B), T.StructField("repeat_until_no_change", B),
    T.StructField("max_repeats", I),
])
FILTER = T.StructType([
    T.StructField("filter_label", S), T.StructField("filter_selector", S),
    T.StructField("filter_values", T.ArrayType(S)), T.StructField("filter_type", S),
    T.StructField("wait_after_change", D),
])
PAGINATION = T.StructType([
    T.StructField("pattern_type", S), T.StructField("next_selector", S),
    T.StructField("load_more_selector", S), T.StructField("page_selector", S),
    T.StructField("scroll_pause_time", D), T.StructField("max_pages", I),
    T.StructField("end_condition_selector", S),
])
SCROLL_CONFIG = T.StructType([T.StructField("type", S), T.StructField("selector", S)])
TEMPLATE_SCHEMA = T.StructType([
    T.StructField("name", S), T.StructField("description", S), T.StructField("version", S),
    T.StructField("created_at", T.TimestampType()), T.StructField("url", S),
    T.StructField("elements", T.ArrayType(ELEMENT)), T.StructField("actions", T.ArrayType(ACTION)),
    T.StructField("filters", T.ArrayType(FILTER)), T.StructField("pagination", PAGINATION),
    T.StructField("scroll_config", SCROLL_CONFIG),
    T.StructField("enable_subpage_scraping", B), T.StructField("subpage_url_pattern", S),
    T.StructField("max_subpages", I), T.StructField("output_format", S),
])

# The accepted enumerations of the template model.
SELECTOR_TYPES = ["css", "xpath"]
ELEMENT_TYPES = ["text", "attribute", "html", "link", "container", "composite"]
ACTION_TYPES = ["click", "scroll", "hover", "wait", "infinite_scroll"]
OUTPUT_FORMATS = ["json", "csv", "excel"]

# Model defaults.
ELEMENT_DEFAULTS = {"selector_type": "css", "element_type": "text", "attribute_name": None,
                    "is_multiple": False, "is_required": True, "is_container": False,
                    "use_find_similar": False, "sub_elements": [], "follow_links": False,
                    "subpage_elements": []}
SUB_DEFAULTS = {"element_type": "text", "attribute_name": None, "is_required": True}
ACTION_DEFAULTS = {"action_type": "click", "wait_after": 2.0, "target_url": None,
                   "repeat_until_missing": False, "repeat_until_no_change": False, "max_repeats": None}
FILTER_DEFAULTS = {"filter_values": [], "filter_type": "select", "wait_after_change": 2.0}
PAGINATION_DEFAULTS = {"next_selector": None, "load_more_selector": None, "page_selector": None,
                       "scroll_pause_time": 2.0, "max_pages": None, "end_condition_selector": None}
TEMPLATE_DEFAULTS = {"description": None, "version": "1.0", "elements": [], "actions": [], "filters": [],
                     "pagination": None, "enable_subpage_scraping": False, "subpage_url_pattern": None,
                     "max_subpages": None, "output_format": "json"}


# ---------------------------------------------------------------------------
# Python-side defaults (plan building)
# ---------------------------------------------------------------------------

def _fill(d: dict | None, defaults: dict) -> dict:
    out = copy.deepcopy(defaults)
    for k, v in (d or {}).items():
        if v is not None or k not in out:
            out[k] = v
    return out


def normalise_element(e: dict, depth: int = 0) -> dict:
    el = _fill(e, ELEMENT_DEFAULTS)
    el["sub_elements"] = [_fill(s, SUB_DEFAULTS) for s in el.get("sub_elements") or []]
    if depth == 0:
        el["subpage_elements"] = [normalise_element(s, 1) for s in el.get("subpage_elements") or []]
    else:
        el.pop("subpage_elements", None)
    return el


def normalise_template(t: dict) -> dict:
    """Fill model defaults; a recorder ``scroll_config`` becomes ``pagination``."""
    tpl = _fill(t, TEMPLATE_DEFAULTS)
    tpl["elements"] = [normalise_element(e) for e in tpl["elements"] or []]
    tpl["actions"] = [_fill(a, ACTION_DEFAULTS) for a in tpl["actions"] or []]
    tpl["filters"] = [_fill(f, FILTER_DEFAULTS) for f in tpl["filters"] or []]
    sc = tpl.get("scroll_config")
    if tpl.get("pagination") is None and sc:
        tpl["pagination"] = {"pattern_type": sc.get("type"), "next_selector": sc.get("selector")}
    if tpl.get("pagination") is not None:
        tpl["pagination"] = _fill(tpl["pagination"], PAGINATION_DEFAULTS)
    return tpl


def load_template(path_or_json: str) -> dict:
    text = path_or_json
    if not path_or_json.lstrip().startswith("{"):
        with open(path_or_json, encoding="utf-8") as fh:
            text = fh.read()
    return normalise_template(json.loads(text))


# ---------------------------------------------------------------------------
# Spark-side: template tables
# ---------------------------------------------------------------------------

def _coalesce_struct(c: Column, schema: T.StructType, defaults: dict) -> Column:
    fields = []
    for f in schema.fields:
        v = c[f.name]
        if f.name in defaults and defaults[f.name] is not None:
            d = defaults[f.name]
            v = F.coalesce(v, F.array().cast(f.dataType) if isinstance(d, list) else F.lit(d).cast(f.dataType))
        fields.append(v.alias(f.name))
    return F.struct(*fields)


def with_defaults(templates: DataFrame) -> DataFrame:
    """Fill model defaults on a templates DataFrame (``TEMPLATE_SCHEMA``)."""
    def sub_fix(s):
        return _coalesce_struct(s, SUB_ELEMENT, SUB_DEFAULTS)

    def elem_fix(e, schema):
        # follow_links stays null where the template does not say: then enable_subpage_scraping decides
        st = _coalesce_struct(e, schema, ELEMENT_DEFAULTS | {"follow_links": None})
        st = st.withField("sub_elements", F.transform(st["sub_elements"], sub_fix))
        return st

    def top_elem(e):
        st = elem_fix(e, ELEMENT)
        return st.withField("subpage_elements",
                            F.transform(st["subpage_elements"], lambda s: elem_fix(s, SUBPAGE_ELEMENT)))

    t = templates
    for name, d in TEMPLATE_DEFAULTS.items():
        if d is None or name in ("elements", "actions", "filters"):
            continue
        t = t.withColumn(name, F.coalesce(F.col(name), F.lit(d)))
    empty = {n: F.array().cast(T.ArrayType(s)) for n, s in (("elements", ELEMENT), ("actions", ACTION),
                                                             ("filters", FILTER))}
    t = t.withColumn("elements", F.transform(F.coalesce("elements", empty["elements"]), top_elem))
    t = t.withColumn("actions", F.transform(F.coalesce("actions", empty["actions"]),
                                            lambda a: _coalesce_struct(a, ACTION, ACTION_DEFAULTS)))
    t = t.withColumn("filters", F.transform(F.coalesce("filters", empty["filters"]),
                                            lambda f: _coalesce_struct(f, FILTER, FILTER_DEFAULTS)))
    sc = F.col("scroll_config")
    from_scroll = F.when(sc.isNotNull() & sc["type"].isNotNull(), F.struct(
        sc["type"].alias("pattern_type"), sc["selector"].alias("next_selector"),
        F.lit(None).cast(S).alias("load_more_selector"), F.lit(None).cast(S).alias("page_selector"),
        F.lit(2.0).alias("scroll_pause_time"), F.lit(None).cast(I).alias("max_pages"),
        F.lit(None).cast(S).alias("end_condition_selector")))
    pag = F.coalesce(F.col("pagination"), from_scroll)
    t = t.withColumn("pagination", F.when(pag.isNull(), F.lit(None).cast(PAGINATION))
                     .otherwise(_coalesce_struct(pag, PAGINATION, PAGINATION_DEFAULTS)))
    return t


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """Template JSON files (one document per file) -> typed rows."""
    schema = T.StructType(TEMPLATE_SCHEMA.fields + [T.StructField("_corrupt_record", S)])
    df = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
          .withColumn("file", F.input_file_name()))
    return with_defaults(df)


def template_catalog(templates: DataFrame) -> DataFrame:
    """S3: one row per template file, sorted by file; unreadable files give an
    ``error`` row."""
    bad = F.col("_corrupt_record").isNotNull() | F.col("name").isNull()
    return (templates.select(
        F.regexp_extract("file", r"([^/]*)$", 1).alias("file"),
        F.when(bad, F.lit(None)).otherwise(F.col("name")).alias("name"),
        F.when(bad, F.lit(None)).otherwise(F.col("url")).alias("url"),
        F.when(bad, F.lit(None)).otherwise(F.size("elements")).alias("n_elements"),
        F.col("created_at"),
        F.when(bad, F.lit("unreadable template")).alias("error"))
        .orderBy("file"))


def template_violations(templates: DataFrame, key: str = "name") -> DataFrame:
    """One row per (template, problem); ``level`` is error or warning."""
    el = F.col("elements")

    def enum_errors(arr: Column, field: str, allowed: list, what: str) -> Column:
        return F.transform(
            F.filter(arr, lambda x: ~F.coalesce(x[field].isin(allowed), F.lit(False))),
            lambda x: F.concat(F.lit(f"{what} must be one of {', '.join(allowed)}: "),
                               F.coalesce(x[field], F.lit("null"))))

    def kinds(e):
        return F.struct(e["selector_type"].alias("selector_type"), e["element_type"].alias("element_type"))

    all_elems = F.concat(F.transform(el, kinds),
                         F.flatten(F.transform(el, lambda e: F.transform(e["subpage_elements"], kinds))))
    url_ok = F.col("url").rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#\s]+")
    errors = F.concat(
        F.when(url_ok, F.array().cast("array<string>")).otherwise(F.array(F.lit("Invalid URL format"))),
        enum_errors(all_elems, "selector_type", SELECTOR_TYPES, "selector_type"),
        enum_errors(all_elems, "element_type", ELEMENT_TYPES, "element_type"),
        enum_errors(F.col("actions"), "action_type", ACTION_TYPES, "action_type"),
        F.when(F.col("output_format").isin(OUTPUT_FORMATS), F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("output_format must be one of json, csv, excel: "),
                                    F.coalesce("output_format", F.lit("null"))))),
        F.when(F.col("scroll_config").isNotNull() & F.col("scroll_config")["type"].isNotNull(),
               F.array(F.lit("scroll_config is not part of the template model; read as pagination")))
        .otherwise(F.array().cast("array<string>")),
    )
    warnings = F.concat(
        F.when(F.size(el) == 0, F.array(F.lit("No elements defined"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(el, lambda e: F.coalesce(F.trim(e["selector"]), F.lit("")) == ""),
                    lambda e: F.concat(F.lit("Element has empty selector: "), F.coalesce(e["label"], F.lit("")))),
    )
    issues = F.concat(F.transform(errors, lambda m: F.struct(F.lit("error").alias("level"), m.alias("message"))),
                      F.transform(warnings, lambda m: F.struct(F.lit("warning").alias("level"), m.alias("message"))))
    return (templates.select(F.col(key), F.explode(issues).alias("issue"))
            .select(key, "issue.level", "issue.message"))


def templates_from_json(df: DataFrame, col: str = "json") -> DataFrame:
    """S2 for JSON documents held in a column (e.g. built by a query):
    parse with the explicit template schema and fill the defaults."""
    parsed = df.select(F.from_json(F.col(col), TEMPLATE_SCHEMA).alias("t")).select("t.*")
    return with_defaults(parsed)
