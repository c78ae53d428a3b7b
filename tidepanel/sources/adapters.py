"""The given tables as the panel's tables, in Spark and as SQL common table expressions of the same meaning."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def on_workers(spark: SparkSession) -> None:
    """Let local Python workers find this package wherever the driver was started; a cluster has it installed or in --py-files."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (known.get("PYTHONPATH"), root)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark: SparkSession, sf_dir: str, label, rows_a_task: int | None = None) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    px, k = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    rows = line.select(F.concat(F.lit("supp_"), F.col("l_suppkey")).alias("entity_id"), label(F.col("l_shipdate")).alias("day"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    # a day has few lines of an entity, so summing up before the shuffle saves little; dealt by entity, one shuffle and one sort serve the bars and all windows over an entity's days
    parts = [table(spark, sf_dir, "lineitem").count() // rows_a_task + 1] if rows_a_task else []  # files know their counts
    return rows.repartition(*parts, "entity_id").groupBy("entity_id", "day").agg(
        F.min_by(px, k).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, k).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("turnover")
    )


def bars(spark: SparkSession, sf_dir: str, rows_a_task: int | None = None) -> DataFrame:
    """Daily bars of suppliers; with ``rows_a_task`` in tasks of about so many lines, where Spark would join small shuffles to few tasks with large tables of keys."""
    return _bars(spark, sf_dir, lambda t: t.cast("date"), rows_a_task)


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-23: weekly bars, labelled by the week's Sunday."""
    return _bars(spark, sf_dir, lambda t: F.date_add(F.date_trunc("week", t).cast("date"), 6))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a supplier: name, exchange (nation), area (region), cap and first day."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = table(spark, sf_dir, "lineitem").where("l_quantity > 0").groupBy("l_suppkey").agg(F.min(F.col("l_shipdate").cast("date")).alias("list_date"))
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(first, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select(F.concat(F.lit("supp_"), F.col("s_suppkey")).alias("entity_id"), F.col("s_name").alias("name"), F.col("n_name").alias("exchange"), F.col("r_name").alias("area"), F.col("s_acctbal").alias("cap"), "list_date")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user_"), F.col("user_id")).alias("entity_id"), "ts", "event_type", F.col("value").alias("price"), size.alias("size"))


def broker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, day) with its up to five largest suppliers as rank, broker and share of the amount."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("day"), "l_suppkey").agg(F.sum("l_extendedprice").alias("amount"))
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey", "day")
    rows = line.withColumn("rank", F.row_number().over(w.orderBy(F.desc("amount"), "l_suppkey"))).withColumn("rate", F.try_divide("amount", F.sum("amount").over(w)))
    return rows.where("rank <= 5").select("l_partkey", "day", "rank", F.concat(F.lit("supp_"), F.col("l_suppkey")).alias("broker"), "rate")


def _bars_sql(label: str) -> str:
    return f"""SELECT entity_id, day, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume, sum(e) AS turnover FROM (
      SELECT 'supp_' || l_suppkey AS entity_id, {label} AS day, l_extendedprice / l_quantity AS px, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k, l_quantity AS q, l_extendedprice AS e
      FROM lineitem WHERE l_quantity > 0) GROUP BY entity_id, day"""


BARS = f"bars AS ({_bars_sql('l_shipdate::DATE')})"
WEEKLY = f"weekly AS ({_bars_sql("(date_trunc('week', l_shipdate) + INTERVAL 6 DAY)::DATE")})"
ENTITIES = """entities AS (SELECT 'supp_' || s_suppkey AS entity_id, s_name AS name, n_name AS exchange, r_name AS area, s_acctbal AS cap, list_date
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_suppkey, min(l_shipdate::DATE) AS list_date FROM lineitem WHERE l_quantity > 0 GROUP BY 1) ON s_suppkey = l_suppkey)"""
TICKS = "ticks AS (SELECT event_id, 'user_' || user_id AS entity_id, ts, event_type, value AS price, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS size FROM events)"
BROKERS = """brokers AS (SELECT l_partkey, day, rank, 'supp_' || l_suppkey AS broker, rate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, day ORDER BY amount DESC, l_suppkey) AS rank, amount / nullif(sum(amount) OVER (PARTITION BY l_partkey, day), 0) AS rate
  FROM (SELECT l_partkey, l_shipdate::DATE AS day, l_suppkey, sum(l_extendedprice) AS amount FROM lineitem GROUP BY ALL)) WHERE rank <= 5)"""
