"""Work on whole pages in the scan: one Arrow pass over the page table, no shuffle.

``over_pages`` runs a function on every page, one page in memory at a time, and passes its rows on in
bounded batches; ``count_matches`` counts with it what selectors match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.ast import SelectorList
from ..plans.onepass import Automaton, Page
from .nodes import fetched_pages, spread

#: An output batch is passed on at this many rows or characters.
_FLUSH_ROWS, _FLUSH_CHARS = 10_000, 8 << 20

_COUNTS = pa.schema([("page_id", pa.int64()), ("key", pa.int32()), ("n", pa.int64())])


def over_pages(pages: DataFrame, rows_of: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``rows_of(page_id, url, html)`` yields the rows of a page; one page is in memory at a time."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0

        def batch():
            cols = zip(*rows) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            columns = [b.column(name) for name in ("page_id", "url", "html")]
            for k in range(b.num_rows):
                for row in rows_of(*[c[k].as_py() for c in columns]):
                    rows.append(row)
                    chars += sum(len(x) for x in row if isinstance(x, str))
                    if len(rows) >= _FLUSH_ROWS or chars >= _FLUSH_CHARS:
                        yield batch()
                        rows, chars = [], 0
        yield batch()

    src, _ = spread(fetched_pages(pages).select("page_id", "url", "html"))
    return src.mapInArrow(run, ddl)


def count_matches(pages: DataFrame, selectors: list[SelectorList]) -> DataFrame:
    """``(page_id, key, n)``: how many nodes each selector (``key``: its place in the list) matches on
    every page where it matches some, counted in the scan."""
    automaton = Automaton(list(enumerate(selectors)))

    def rows_of(page_id, url, html):
        for key, nodes in automaton.run(Page(html)).items():
            yield page_id, key, len(nodes)

    return over_pages(pages, rows_of, _COUNTS, "page_id BIGINT, key INT, n BIGINT")
