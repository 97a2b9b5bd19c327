"""Related lists (J4), value contains target (J8) and the wide export (S6, S7) against brute force."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from domquarry.operators.merge import action_subpage_join, merge_related
from domquarry.operators.scrape import flatten
from domquarry.sources.sinks import write_results

LISTS = "page_id BIGINT, list_label STRING, list_order INT, record_index INT, profile_link STRING, key STRING, " \
        "value_ord INT, value STRING"


def _merged(rows):
    """J4 record by record."""
    pages, out = {}, []
    for r in rows:
        pages.setdefault(r[0], []).append(r)
    for page, rs in pages.items():
        lists = {}
        for r in rs:
            lists.setdefault((r[2], r[1]), []).append(r)

        def kind(order_label):
            keys = {r[5] for r in lists[order_label] if r[3] == 0}
            low = order_label[1].lower()
            sub = bool(keys & {"education", "credential", "admission", "bar"})
            if keys & {"name", "Position", "title"} and not sub:
                return "main"
            return "subpage" if sub or "subpage" in low or "second" in low else "other"

        kinds = {k: kind(k) for k in lists}
        if not {"main", "subpage"} <= set(kinds.values()):
            out += rs
            continue
        for k, own in lists.items():
            if kinds[k] == "other":
                out += own
            if kinds[k] != "main":
                continue
            for index, link in sorted({(r[3], r[4]) for r in own}):
                fields = {}
                for r in own:
                    if r[3] == index:
                        fields.setdefault(r[5], []).append(r[6:])
                for order, label in sorted(k2 for k2 in lists if kinds[k2] == "subpage"):
                    flat = "education" in label.lower() or "credential" in label.lower()
                    clean = label.replace("container", "").replace("second", "").strip()
                    for i in sorted({r[3] for r in lists[order, label]}):
                        sub = [r for r in lists[order, label] if r[3] == i and not r[5].startswith("_")]
                        if sub and (i == index or sub[0][4] and sub[0][4] == link):
                            for key in {r[5] for r in sub}:
                                fields[key if flat else f"{clean}_details.{key}"] = [r[6:] for r in sub if r[5] == key]
                out += [(page, k[1], k[0], index, link, key, *v) for key, vs in fields.items() for v in vs]
    return out


def test_related_lists_match_brute_force(spark):
    rng, rows = random.Random(3), []
    for page in range(30):
        for order, label in enumerate(rng.sample(["people", "subpage education", "second container", "misc", "credentials"], 4)):
            for index in range(rng.randint(1, 4)):
                link = rng.choice(["", "/a", "/b", "/c", None])
                keys = {"people": ["name", "title", "_id"], "misc": ["note"]}.get(label, ["education", "school", "_internal"])
                for key in keys if index == 0 else rng.sample(keys, rng.randint(1, len(keys))):
                    rows += [(page, label, order, index, link, key, o, f"{key}{rng.randint(0, 9)}")
                             for o in range(1, rng.randint(2, 4))]
    got = sorted(map(repr, (tuple(r) for r in merge_related(spark.createDataFrame(rows, LISTS)).collect())))
    assert got == sorted(map(repr, _merged(rows)))
    assert merge_related(spark.createDataFrame([], LISTS)).collect() == []


def test_merge_takes_few_exchanges(spark):
    plan = merge_related(spark.createDataFrame([(1, "people", 0, 0, "", "name", 1, "x")], LISTS))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 10


def test_contained_targets_match_brute_force(spark):
    rng = random.Random(9)
    letters = "ab/é"
    targets = [("".join(rng.choice(letters) for _ in range(rng.randint(1, 70)))) for _ in range(150)] + ["", None]
    targets = [(f"t{rng.randint(0, 99):02}{i}", t) for i, t in enumerate(targets)]
    values = []
    for i in range(60):
        t = rng.choice(targets)[1] or ""
        noise = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        values.append((i // 2, i % 2, "k", noise + t + noise if rng.random() < 0.8 else "zz"))
    values += [(90, 0, "k", None), (91, 0, "k", ""), (92, 0, "k", ("x" * 10_000) + targets[3][1] + "y" * 10_000)]
    want = {}
    for p, c, _, v in values:
        hits = [(label, t) for label, t in targets if t and v and t in v]
        if hits:
            want[p, c] = min(hits)
    recs = spark.createDataFrame(values, "page_id BIGINT, container_id INT, key STRING, value STRING")
    acts = spark.createDataFrame(targets, "label STRING, target_url STRING")
    got = {(r[0], r[1]): (r[3], r[2]) for r in action_subpage_join(recs, acts).collect()}
    assert got == want and (92, 0) in got
    assert action_subpage_join(recs, acts.limit(0)).collect() == []
    assert action_subpage_join(recs.limit(0), acts).collect() == []


def _results(spark, rows):
    return spark.createDataFrame(rows, "n INT, data MAP<STRING, ARRAY<STRING>>").select(
        F.concat(F.lit("T"), F.col("n").cast("string")).alias("template_name"), F.lit('https://x/"q",1').alias("url"),
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("scraped_at"), F.lit(True).alias("success"), "data",
        F.expr("CAST(array() AS ARRAY<STRUCT<container: STRING, index: INT, source_page: INT, "
               "fields: MAP<STRING, ARRAY<STRING>>, error: STRING>>)").alias("records"),
        F.expr("CAST(array() AS ARRAY<STRING>)").alias("errors"),
        F.expr("named_struct('elements_found', 1, 'actions_executed', 0, 'page_title', 'T', 'final_url', 'u')").alias("metadata"))


def _read(path):
    """Every file of a CSV folder by another reader: header and rows."""
    for name in sorted(os.listdir(path)):
        if name.startswith("part-"):
            with open(os.path.join(path, name), encoding="utf-8", newline="") as f:
                yield list(csv.reader(f))


def test_wide_export_keeps_every_cell(spark, tmp_path):
    rng = random.Random(1)
    texts = ["plain", 'with "quotes"', "comma, here", "line\nbreak", "back\\slash\\", " spaces ", "", "é"]
    rows = [(i, {f"f{rng.randint(0, 400)}": [rng.choice(texts) for _ in range(rng.randint(1, 3))] for _ in range(12)})
            for i in range(40)] + [(40, {})]
    res = _results(spark, rows).repartition(5)
    want = {(r["template_name"], r["column"]): r["value"] for r in flatten(res).collect()}
    for fmt, sub in (("csv", ""), ("excel", "scraped_data")):
        path = write_results(res, str(tmp_path / fmt), fmt)
        seen, names = [], None
        got = {}
        for header, *lines in _read(os.path.join(path, sub)):
            assert header[:2] == ["template_name", "url"] and header[2:] == sorted(set(c for _, c in want))
            for line in lines:
                assert len(line) == len(header) and line[1] == 'https://x/"q",1'
                seen.append(line[0])
                got.update({(line[0], c): v for c, v in zip(header[2:], line[2:]) if v != ""})
        assert sorted(seen) == sorted(f"T{i}" for i in range(41))
        assert got == {k: v for k, v in want.items() if v != ""}
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv"))
    assert back.count() == 41


def test_wide_export_of_many_columns_and_of_none(spark, tmp_path):
    res = _results(spark, [(i, {f"c{i}": [str(k) for k in range(10_000)]}) for i in range(10)])
    path = write_results(res, str(tmp_path / "w"), "csv")
    files = list(_read(path))
    assert all(len(line) == 100_002 for f in files for line in f)
    assert sum(len(f) - 1 for f in files) == 10
    with pytest.raises(ValueError):
        write_results(_results(spark, [(1, {})]), str(tmp_path / "n"), "csv")
