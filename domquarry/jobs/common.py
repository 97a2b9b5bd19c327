"""Shared helpers for the registered queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.nodes import Dom, build_dom
from ..plans.compile import Planner
from ..session import read_table

_DOMS: dict = {}  # cached node tables by session and pages


def cached_dom(key: tuple, make) -> tuple[Dom, Planner]:
    """The node table under ``key``, made by ``make()`` on first use."""
    if key not in _DOMS:
        _DOMS[key] = make()
    dom = _DOMS[key]
    return dom, Planner(dom)


def release_doms() -> None:
    """Drop all cached node tables (they are made again when needed)."""
    for dom in _DOMS.values():
        dom.unpersist()
    _DOMS.clear()


def table(spark: SparkSession, sf_dir: str, name: str):
    return read_table(spark, sf_dir, name)


def page_dom(spark: SparkSession, sf_dir: str) -> tuple[Dom, Planner]:
    """Node table of ``pages`` for one data folder, built once per session
    and reused by every query on the same pages (one tokenising pass)."""
    return cached_dom((spark.sparkContext.applicationId, sf_dir, "pages"),
                      lambda: build_dom(table(spark, sf_dir, "pages")))


def sql_decode(x: str) -> str:
    """DuckDB expression decoding the four entities present in ``pages``
    (``&amp;`` last, so ``&amp;quot;`` stays ``&quot;``)."""
    return (f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&amp;', '&')")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
