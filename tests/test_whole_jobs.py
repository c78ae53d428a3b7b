"""Queries that must count every row of their tables."""

from tidepanel import registry
from tidepanel.sources.adapters import bars

SF = "/root/testdata/sf0.001"


def test_grid_has_every_bar(spark):
    assert registry.queries()["parameter_grid_all"](spark, SF).count() == 3 * bars(spark, SF).count()


def test_topics_are_counted_in_whole_texts(spark, tmp_path):
    texts = [(1, "x" * 100 + " the la", "a"), (2, "der " * 30, "a"), (3, None, "a"), (4, "und", "b")]
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.entity_id, r.topic): (r.hits, r.grouped) for r in registry.queries()["texts_by_topic"](spark, str(tmp_path)).collect()}
    assert got == {("a", "articles"): (32, True), ("a", "joins"): (0, False), ("b", "articles"): (0, False), ("b", "joins"): (1, False)}
