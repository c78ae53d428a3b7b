"""Queries of studies that SQL can't express."""

from tidepanel import registry
from tidepanel.sources import lake

SF = "/root/testdata/sf0.001"


def test_linear_model_predicts_later_days(spark):
    rows = registry.queries()["linear_model"](spark, SF).collect()
    assert rows and all(str(r.day) >= "2000-01-01" for r in rows)
    mean = sum(r.label for r in rows) / len(rows)
    assert sum((r.label - r.prediction) ** 2 for r in rows) < 1.1 * sum((r.label - mean) ** 2 for r in rows)


def test_csv_falls_back_to_the_encoding_that_fits(spark, tmp_path):
    rows = spark.createDataFrame([("a", "股票"), ("b", "é")], "id string, name string")
    for encoding in ("UTF-8", "GB18030"):
        lake.write_csv(rows, f"file://{tmp_path}/{encoding}", encoding)
        got = lake.read_csv(spark, f"file://{tmp_path}/{encoding}", "id string, name string", f"file://{tmp_path}/{encoding}-rows")
        assert sorted(map(tuple, got.collect())) == [("a", "股票"), ("b", "é")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"
