"""Render HTML pages from relational tables, in Spark (round-trip fixtures).

* ``directory_pages``: one listing page per (nation, page number) with one
  ``div.profile-card`` per supplier (``h3`` name, ``span.position``, mailto
  link, ``/lawyer/<id>`` profile link, sector spans), ``per_page`` cards per
  page, and a ``a.next`` link on all but the last page.  With ``overlap`` the
  last ``overlap`` cards of page k are repeated at the top of page k+1 and
  ``trailing`` empty-news pages (repeats only) are appended: input for the
  pagination stop rules.
* ``profile_pages``: one page per supplier (``s_suppkey % 10 != 3``: some
  links lead nowhere) with ``ul.education li`` and ``ul.admissions li``.

Every page is built by a bounded ``collect_list`` (at most ``per_page`` cards),
so no group grows with the data.  Extracting these pages back with a template
and comparing with SQL on the source tables gives exact oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import row_number_within

HOST = "https://dir.example"
# 64-bit page ids: nation and page number in 32 bits each; profiles in a range of their own.
DIRECTORY_PAGE_BASE = 1 << 60
PROFILE_PAGE_BASE = 1 << 61


def esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def position_of(acctbal: Column) -> Column:
    return (F.when(acctbal >= 5000, F.lit("Partner")).when(acctbal >= 0, F.lit("Associate"))
            .otherwise(F.lit("Counsel")))


def email_of(name: Column) -> Column:
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@dir.example"))


def sectors_of(key: Column) -> Column:
    first = F.concat(F.lit("Sector "), (key % 7).cast("string"))
    second = F.concat(F.lit("Sector "), (key % 5 + 10).cast("string"))
    return F.when(key % 2 == 0, F.array(first, second)).otherwise(F.array(first))


def _card(key: Column, name: Column, acctbal: Column) -> Column:
    sectors = F.array_join(F.transform(sectors_of(key), lambda s: F.concat(
        F.lit('<span class="sector">'), s, F.lit("</span>"))), "")
    return F.concat(
        F.lit('<div class="profile-card"><h3>'), esc(name), F.lit("</h3>"),
        F.lit('<span class="position">'), position_of(acctbal), F.lit("</span>"),
        F.lit('<p class="contact-details"><a href="mailto:'), email_of(name), F.lit('">'), email_of(name),
        F.lit("</a></p>"),
        F.lit('<a class="profile" href="/lawyer/'), key.cast("string"), F.lit('">View profile</a>'),
        F.lit('<div class="sectors">'), sectors, F.lit("</div></div>"))


def directory_cards(supplier: DataFrame, nation: DataFrame, per_page: int = 4, overlap: int = 0,
                    trailing: int = 0) -> DataFrame:
    """One row per (card, page it is shown on): the listing before rendering."""
    s = supplier.join(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    # a nation may hold a large share of suppliers: numbered without a
    # per-nation window, counted with a grouped aggregate
    s = row_number_within(s, "s_nationkey", "s_suppkey", "rank").withColumn("rank", F.col("rank") - 1)
    counts = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_cards"))
    s = s.join(counts, "s_nationkey")
    s = s.withColumn("page_no", (F.col("rank") / per_page).cast("int") + 1)
    s = s.withColumn("n_pages", ((F.col("n_cards") + per_page - 1) / per_page).cast("int"))
    shown = s.withColumn("repeat", F.lit(False))
    if overlap:
        rep = (s.where((F.col("rank") % per_page >= per_page - overlap) & (F.col("page_no") < F.col("n_pages")))
               .withColumn("page_no", F.col("page_no") + 1).withColumn("repeat", F.lit(True)))
        shown = shown.unionByName(rep)
    if trailing:
        last = s.where(F.col("page_no") == F.col("n_pages"))
        for t in range(1, trailing + 1):
            shown = shown.unionByName(last.withColumn("page_no", F.col("n_pages") + t)
                                      .withColumn("repeat", F.lit(True)))
    total_pages = F.col("n_pages") + F.lit(trailing)
    return shown.withColumn("total_pages", total_pages)


def directory_pages(supplier: DataFrame, nation: DataFrame, per_page: int = 4, overlap: int = 0,
                    trailing: int = 0) -> DataFrame:
    cards = directory_cards(supplier, nation, per_page, overlap, trailing)
    cards = cards.withColumn("card", _card(F.col("s_suppkey"), F.col("s_name"), F.col("s_acctbal")))
    pages = (cards.groupBy("s_nationkey", "n_name", "page_no", "total_pages")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("repeat").cast("int").alias("r0"),
                                                       "s_suppkey", "card"))).alias("cards")))
    # repeated cards first (they continue the previous page), then by key
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "")
    nxt = F.when(F.col("page_no") < F.col("total_pages"), F.concat(
        F.lit('<a class="next" href="?page='), (F.col("page_no") + 1).cast("string"), F.lit('">Next</a>'))
    ).otherwise(F.lit(""))
    url = F.concat(F.lit(HOST + "/nation/"), F.col("s_nationkey").cast("string"), F.lit("/people?page="),
                   F.col("page_no").cast("string"))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>People &middot; "), esc(F.col("n_name")),
        F.lit(" &middot; page "), F.col("page_no").cast("string"), F.lit("</title></head><body>"),
        F.lit('<div class="directory">'), body, F.lit("</div>"), nxt, F.lit("</body></html>"))
    return pages.select(
        (F.lit(DIRECTORY_PAGE_BASE) + F.col("s_nationkey").cast("bigint") * (1 << 32) + F.col("page_no"))
        .alias("page_id"), url.alias("url"), html.alias("html"),
        F.col("s_nationkey").alias("nation_key"), "page_no")


def profile_pages(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    n = nation.join(region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    s = (supplier.where(F.col("s_suppkey") % 10 != 3)
         .join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name"), "s_nationkey"))
    k = F.col("s_suppkey")
    extra = F.when(k % 4 == 0, F.lit("<li> </li><li>None</li>")).otherwise(F.lit(""))
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), esc(F.col("s_name")), F.lit("</title></head><body>"),
        F.lit('<div class="profile-main"><h1>'), esc(F.col("s_name")), F.lit("</h1>"),
        F.lit('<p class="bio">Works in '), esc(F.col("r_name")), F.lit(".</p>"),
        F.lit('<ul class="education"><li>University of '), esc(F.col("n_name")), F.lit("</li>"),
        F.lit("<li>"), esc(F.col("r_name")), F.lit(" Law School</li>"), extra, F.lit("</ul>"),
        F.lit('<ul class="admissions"><li>Bar of '), esc(F.col("n_name")), F.lit("</li></ul>"),
        F.lit("</div></body></html>"))
    return s.select((F.lit(PROFILE_PAGE_BASE) + k).alias("page_id"),
                    F.concat(F.lit(HOST + "/lawyer/"), k.cast("string")).alias("url"), html.alias("html"))


def grid_pages(supplier: DataFrame) -> DataFrame:
    """Two pages per block of 20 supplier keys, in a column layout without
    profile cards: ``/s/<block>`` lists the first 12 keys, ``/s/<block>?offset=20``
    the other 8.  First pages of even blocks have a load-more button, of odd ones a
    next link; blocks divisible by 3 are marked as a grid plugin's.  At most 12
    columns are collected per page."""
    k = F.col("s_suppkey")
    s = supplier.select((k / 20).cast("bigint").alias("block"), ((k % 20) >= 12).alias("second"), k, "s_name")
    column = F.concat(F.lit('<div class="wp-block-column"><strong>'), esc(F.col("s_name")), F.lit("</strong><i>"),
                      email_of(F.col("s_name")), F.lit("</i><em>write @ us now</em></div>"))
    p = s.withColumn("c", column).groupBy("block", "second").agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", "c"))).alias("cs"))
    body = F.array_join(F.transform("cs", lambda x: x["c"]), "")
    more = F.when(F.col("second"), F.lit("")).when(
        F.col("block") % 2 == 0, F.lit('<button class="btn load-more-btn">Load More</button>')).otherwise(
        F.lit('<a class="next" href="?offset=20">Next</a>'))
    mark = F.when(F.col("block") % 3 == 0, F.lit(' data-grid="1"')).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><head><title>Grid "), F.col("block").cast("string"), F.lit("</title></head><body><div"),
                    mark, F.lit('><img src="/logo.png"><input value="q"><section class="people-list">'), body, F.lit("</section>"), more, F.lit("</div></body></html>"))
    url = F.concat(F.lit("https://grid.example/s/"), F.col("block").cast("string"),
                   F.when(F.col("second"), F.lit("?offset=20")).otherwise(F.lit("")))
    return p.select((F.lit(1 << 59) + F.col("block") * 2 + F.col("second").cast("int")).alias("page_id"),
                    url.alias("url"), html.alias("html"))
