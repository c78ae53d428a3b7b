"""The join that leaves rows without a match in place gives what a plain left join gives."""

import pytest
from pyspark.sql import functions as F

from tidepanel.llm.common import left_join_few


@pytest.mark.parametrize("bits", [15, 18, 25])
@pytest.mark.parametrize("which", ["id % 7 = 0", "true", "false"])
def test_equals_left_join(spark, bits, which):
    docs = spark.range(3000).select(F.when(F.col("id") % 50 != 3, F.col("id")).alias("doc_id"), (F.col("id") % 3).cast("int").alias("tag"), F.concat(F.lit("t"), "id").alias("text"))
    docs = docs.union(docs.where("doc_id < 20"))
    found = spark.range(6000).where(which).select(F.when(F.col("id") % 11 != 5, F.col("id")).alias("doc_id"), (F.col("id") % 2).cast("int").alias("tag"), F.array("id").alias("new"))
    got, want = left_join_few(docs, found, ["doc_id", "tag"], bits), docs.join(found, ["doc_id", "tag"], "left")
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_few_matches_of_one_key(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"))
    found = spark.range(0, 20000, 1000).select(F.col("id").alias("doc_id"), F.lit(1).alias("new"))
    got = left_join_few(docs, found, ["doc_id"])
    assert got.count() == 20000 and got.where("new = 1").count() == 20
