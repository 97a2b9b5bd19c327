"""The pipeline's stages one after another, and its contract."""

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing_sources", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == COLUMNS, name
        assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        assert docs.filter("n_chars <> char_length(text)").count() == 0 or name == "never"
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.filter("piece = 0").count() == docs.count()
    assert sorted(map(tuple, packed.drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))


def test_stages_take_odd_tables(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "short", None, None, 5)] * 2
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, size string, no int")
    for odd in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, odd, SF).collect()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
