"""Rows that top-k search must not lose: ids behind many equal rows, vectors with large components."""

import pytest

from domquarry.llm import mtree
from test_mtree_and_lang import brute

OPTIONS = [{}, {"tree_points": 16, "page": 4, "task_queries": 3, "block": 2}]


def compared(spark, rows, options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mtree.nearest_rows(df, every=10, **options).collect()
    assert {tuple(r) for r in got} == brute(rows, 5, 10) and len(got) == len({tuple(r) for r in got})


@pytest.mark.parametrize("options", OPTIONS)
def test_repeated_query_rows(spark, options):
    near, other = [1.0, 2.0, 0.5], [1.0, 1.9, 0.5]
    rows = [(10, near)] * 12 + [(11 + i, near) for i in range(7)] + [(3, other)] * 9 + [(4, other), (5, [0.1, 0.0, 0.0])]
    compared(spark, rows, options)


@pytest.mark.parametrize("options", OPTIONS)
def test_large_components(spark, options):
    big = float(1 << 18)
    rows = [(i, [i % 7 - 3.0, i % 5 - 2.5]) for i in range(40)]
    rows += [(100 + i, [big * (i - 4), 1.0 + i]) for i in range(12)] + [(110, [big, -big]), (115, [2.0 ** 24, 0.5]),
             (120, [2.0 ** 22] * 2), (121, [float("inf"), big]), (122, [None, big]), (None, [big, 1.0]), (130, [big])]
    compared(spark, rows, options)
