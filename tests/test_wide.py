"""Factors stored long, put side by side."""

from pyspark.sql import functions as F

from tidepanel.sources import lake


def test_tasks_grow_in_number_and_not_in_size(spark):
    long = spark.range(8000).select(F.concat(F.lit("e"), F.col("id") % 50).alias("entity_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 100).cast("int")).alias("day"), F.when((F.col("id") / 50).cast("int") % 2 == 0, "a").otherwise("b").alias("factor_name"), F.col("id").cast("double").alias("value"))
    got = lake.wide(long, ("a", "b", "none"), rows_a_task=500)
    assert got.rdd.getNumPartitions() == 17
    want = long.groupBy("entity_id", "day").pivot("factor_name", ["a", "b", "none"]).agg(F.max("value"))
    assert got.count() == 4000 and got.exceptAll(want).isEmpty()
