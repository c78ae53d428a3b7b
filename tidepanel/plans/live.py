"""Streams of quotes replayed in slices of time, with a stop after each, against the SQL of the whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.adapters import table
from ..streaming import jobs, quotes
from .catalog import query, r6
from .stream import HOURLY, _events
from .tables import _scratch

C = F.col
SLICES = 3


@query(f"WITH {HOURLY} SELECT entity_id, start, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n FROM b")
def tick_bars_streamed(spark, sf_dir):
    """ST-3, ST-6: tumbling bars by Structured Streaming, carried over the slices by the state store; update output into versions by day, the fullest version of a bar wins."""
    at = _scratch(spark, "stream")
    keep = quotes.Versions(spark, f"{at}/t", "entity_id string, start timestamp_ntz, open double, high double, low double, close double, n long, day date", "day")

    def sink(rows, batch):
        new = rows.withColumn("day", C("start").cast("date")).persist()
        old = keep.read(batch).join(new.select("day").distinct(), "day", "left_semi")
        both = old.unionByName(new).groupBy("entity_id", "start", "day").agg(F.max_by(F.struct("open", "high", "low", "close", "n"), "n").alias("r"))
        keep.write(both.select("entity_id", "start", "r.*", "day"), batch)
        new.unpersist()

    quotes.replay(_events(spark, sf_dir), "ts", f"{at}/in", SLICES, lambda ticks: jobs.run_once(jobs.bars(ticks), sink, f"{at}/c", "update"))
    return keep.read().select("entity_id", "start", *(r6(C(c)).alias(c) for c in ("open", "high", "low", "close")), "n")


@query("""WITH k AS (SELECT 'user_' || user_id AS entity_id, event_id, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM events WHERE value IS NOT NULL AND value <> 0)
SELECT entity_id, event_id, round(list_reduce(v, lambda a, x: a + 2.0 / 13 * (x - a)), 4) AS ema FROM k""")
def stateful_ema_streamed(spark, sf_dir):
    """ST-5, U-3, U-4: per-entity state carried over the slices of a stream, with a stop and a new start between them."""
    at, own = _scratch(spark, "ema"), quotes.with_rocksdb(spark)
    quotes.replay(_events(own, sf_dir), "ts", f"{at}/in", SLICES, lambda ticks: jobs.run_once(quotes.running_ema(ticks), f"{at}/t", f"{at}/c"))
    return spark.read.schema("entity_id string, event_id long, ema double").parquet(f"{at}/t").select("entity_id", "event_id", F.round("ema", 4).alias("ema"))


@query("""WITH k AS (SELECT 'user_' || user_id AS entity_id, ts, ts::DATE AS day, date_trunc('minute', ts) AS minute, value AS price, row(ts, event_id) AS k FROM events WHERE value IS NOT NULL AND value <> 0),
d AS (SELECT entity_id, day, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*)::BIGINT AS n FROM k GROUP BY ALL),
m AS (SELECT entity_id, minute, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, count(*)::BIGINT AS n FROM k GROUP BY ALL),
a AS (SELECT 'latest' AS kind, entity_id, day::TIMESTAMP AS time, open, high, low, close, n FROM d UNION ALL SELECT 'minute', entity_id, minute, open, high, low, close, n FROM m
UNION ALL SELECT 'daily', entity_id, day + INTERVAL 15 HOUR, open, high, low, close, n FROM d WHERE day + INTERVAL 15 HOUR <= (SELECT max(ts) FROM k))
SELECT kind, entity_id, time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, n FROM a""")
def quote_sinks_streamed(spark, sf_dir):
    """ST-2: three keyed tables written from each batch of one stream."""
    at = _scratch(spark, "sinks")
    sinks = quotes.QuoteSinks(spark, at)
    quotes.replay(_events(spark, sf_dir), "ts", f"{at}/in", SLICES, lambda ticks: jobs.run_once(ticks, sinks, f"{at}/c"))
    rows = [t.read().withColumn("kind", F.lit(k)) for k, t in (("latest", sinks.latest), ("minute", sinks.minutes), ("daily", sinks.daily))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("kind", "entity_id", C("at").cast("timestamp_ntz").alias("time"), *(r6(C(c)).alias(c) for c in ("open", "high", "low", "close")), "n")


@query("""WITH RECURSIVE k AS (SELECT 'user_' || user_id AS entity_id, value AS price, row(ts, event_id) AS k, datediff('day', min(ts::DATE) OVER (), ts::DATE) AS age, datediff('day', min(ts::DATE) OVER (), max(ts::DATE) OVER ()) + 1 AS days, value FROM events),
s AS (SELECT *, (age // (-(-days // 5)))::INTEGER AS slice FROM k WHERE value IS NOT NULL AND value <> 0), g AS (SELECT entity_id, slice, (arg_max(price, k) - arg_min(price, k)) / nullif(abs(arg_min(price, k)), 0) AS change FROM s GROUP BY ALL),
f AS (SELECT slice, list(entity_id ORDER BY change DESC, entity_id)[1:40] AS ids FROM g WHERE change >= 0.03 GROUP BY slice), n AS (SELECT i AS slice, coalesce(ids, []) AS ids FROM (SELECT unnest(range(5))::INTEGER AS i) LEFT JOIN f ON slice = i),
p(slice, ids) AS (SELECT -1, []::VARCHAR[] UNION ALL SELECT n.slice, CASE WHEN len(n.ids) = 0 THEN p.ids WHEN len(p.ids) > 40 THEN n.ids ELSE list_distinct(list_concat(p.ids, n.ids)) END FROM p JOIN n ON n.slice = p.slice + 1)
SELECT 'shooting' AS pool, unnest(ids) AS entity_id FROM p WHERE slice = 4""")
def pools_streamed(spark, sf_dir):
    """SNK-9, ST-11: a pool that each batch's risers join, or take over once it is full."""
    at = _scratch(spark, "pools")
    pools = quotes.Pools(spark, f"{at}/t", most=40)
    refresh = lambda rows, batch: pools.refresh(quotes.first_to_last(rows).where("change >= 0.03"), batch, "shooting")
    quotes.replay(_events(spark, sf_dir), "ts", f"{at}/in", 5, lambda ticks: jobs.run_once(ticks, refresh, f"{at}/c"))
    return pools.members()


@query("""WITH c AS (SELECT 'user_' || c_custkey AS entity_id, min(c_mktsegment) AS segment, min(c_acctbal) AS cap FROM customer GROUP BY 1)
SELECT event_id, entity_id, segment, round(value * cap, 4) AS value FROM (SELECT DISTINCT event_id, 'user_' || user_id AS entity_id, value FROM events) JOIN c USING (entity_id)""")
def ticks_with_attributes_streamed(spark, sf_dir):
    """J-5, ST-1: a stream in which every tick comes twice, each joined once to its entity's static attributes."""
    at = _scratch(spark, "attributes")
    c = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("user_"), C("c_custkey")).alias("entity_id")).agg(F.min("c_mktsegment").alias("segment"), F.min("c_acctbal").alias("cap"))
    e = _events(spark, sf_dir)
    joined = lambda ticks: quotes.with_attributes(ticks, c).select("event_id", "entity_id", "segment", F.round(C("price") * C("cap"), 4).alias("value"))
    quotes.replay(e.union(e), "ts", f"{at}/in", SLICES, lambda ticks: jobs.run_once(joined(ticks), f"{at}/t", f"{at}/c"))
    return spark.read.schema("event_id long, entity_id string, segment string, value double").parquet(f"{at}/t")
