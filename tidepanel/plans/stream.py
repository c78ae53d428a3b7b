"""Streaming jobs run to the end over the given events, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ts import Series
from ..sources.adapters import BARS, bars, table
from ..streaming import jobs
from .catalog import query, r6

C = F.col


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user_"), C("user_id")).alias("entity_id"), C("ts").cast("timestamp").alias("ts"), C("value").alias("price"))


HOURLY = """k AS (SELECT 'user_' || user_id AS entity_id, date_trunc('hour', ts) AS start, value AS price, row(ts, event_id) AS k FROM events WHERE value IS NOT NULL AND value <> 0),
b AS (SELECT entity_id, start, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*)::BIGINT AS n FROM k GROUP BY ALL)"""


@query(f"WITH {HOURLY} SELECT entity_id, start, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n FROM b")
def tick_bars(spark, sf_dir):
    """ST-1, ST-3: the batch twin of the stream of bars."""
    return jobs.bars(_events(spark, sf_dir)).select("entity_id", "start", *(r6(C(c)).alias(c) for c in ("open", "high", "low", "close")), "n")


@query("""WITH k AS (SELECT 'user_' || user_id AS entity_id, ts, value AS price, row(ts, event_id) AS k FROM events WHERE value IS NOT NULL AND value <> 0),
w AS (SELECT entity_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 6 HOUR * o AS start, price, k FROM k, (SELECT unnest([0, 1]) AS o)),
g AS (SELECT entity_id, start, (arg_max(price, k) - arg_min(price, k)) / nullif(abs(arg_min(price, k)), 0) AS change FROM w GROUP BY ALL) SELECT entity_id, start, round(change, 6) AS change FROM g WHERE change >= 0.03 OR change <= -0.03""")
def shoot_today(spark, sf_dir):
    """ST-4, ST-11."""
    return jobs.shooters(_events(spark, sf_dir)).select("entity_id", "start", r6(C("change")).alias("change"))


@query(f"""WITH {BARS}, d AS (SELECT max(day) AS last FROM bars), f AS (SELECT entity_id, day, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS x FROM bars WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT entity_id, day, round(x, 6) AS value FROM f WHERE day > (SELECT last - 10 FROM d)""")
def incremental_factor(spark, sf_dir):
    """ST-8: only the last ten days' values, from those days and a lookback of calendar days; equal to a full recompute."""
    b = bars(spark, sf_dir)
    last = b.agg(F.max("day").alias("last"))
    recent = b.join(F.broadcast(last), C("day") > F.date_sub("last", 10 + 400))
    return recent.select("entity_id", "day", "last", r6(Series().mean(C("close"), 20)).alias("value")).where(C("day") > F.date_sub("last", 10)).drop("last")
