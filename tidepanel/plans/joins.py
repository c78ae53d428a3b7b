"""Joins: as-of, forward, broker events, cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ts import Series
from ..sources.adapters import BARS, BROKERS, ENTITIES, bars, broker_events, entities, table
from .catalog import query, r6

C = F.col


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """J-12: each left row with the latest right row not after it; one union and one window, no range join."""
    packed = right.select(key, time, F.struct(*columns).alias("_r")).withColumn("_left", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType))
    rows = left.select(key, time, F.lit(None).cast(packed.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_left"))
    w = Window.partitionBy(key).orderBy(time, F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = packed.select(key, time, "_r", "_left").unionByName(rows)
    return both.withColumn("_r", F.last("_r", True).over(w)).where("_left is not null").select("_left.*", *(F.col(f"_r.{c}").alias(c) for c in columns))


@query(f"""WITH {BARS}, o AS (SELECT o_orderkey, 'supp_' || (o_custkey % 100 + 1) AS entity_id, o_orderdate::DATE AS day FROM orders)
SELECT o.o_orderkey, o.entity_id, o.day, round(b.close, 6) AS close FROM o ASOF LEFT JOIN bars b ON o.entity_id = b.entity_id AND o.day >= b.day""")
def as_of_price(spark, sf_dir):
    """J-12, A-27: the last price not after an order's day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("supp_"), C("o_custkey") % 100 + 1).alias("entity_id"), C("o_orderdate").cast("date").alias("day"))
    return as_of(o, bars(spark, sf_dir), "entity_id", "day", ["close"]).select("o_orderkey", "entity_id", "day", r6(C("close")).alias("close"))


@query(f"""WITH {BARS}, {BROKERS}, l AS (SELECT *, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5 FROM bars WINDOW w AS (PARTITION BY entity_id ORDER BY day))
SELECT l_partkey, k.day, rank::INTEGER AS rank, broker, round(c3 / nullif(close, 0) - 1, 6) AS r3, round(c5 / nullif(close, 0) - 1, 6) AS r5 FROM brokers k JOIN l ON k.broker = l.entity_id AND k.day = l.day WHERE c5 IS NOT NULL""")
def player_performance(spark, sf_dir):
    """J-11: events with the return over the 3 and 5 bars after; events with fewer bars are left out."""
    s = Series()
    l = bars(spark, sf_dir).select(C("entity_id").alias("broker"), "day", "close", s.lead(C("close"), 3).alias("c3"), s.lead(C("close"), 5).alias("c5")).where("c5 is not null")
    return broker_events(spark, sf_dir).join(l, ["broker", "day"]).select("l_partkey", "day", C("rank").cast("int").alias("rank"), "broker", *(r6(F.try_divide(C(f"c{n}"), C("close")) - 1).alias(f"r{n}") for n in (3, 5)))


@query(f"""WITH {BARS}, {BROKERS}, l AS (SELECT *, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5 FROM bars WINDOW w AS (PARTITION BY entity_id ORDER BY day)),
p AS (SELECT broker, c3 / nullif(close, 0) - 1 AS r3, c5 / nullif(close, 0) - 1 AS r5 FROM brokers k JOIN l ON k.broker = l.entity_id AND k.day = l.day WHERE c5 IS NOT NULL)
SELECT broker, count(*)::BIGINT AS n, round(avg((r3 > 0)::INTEGER), 6) AS rate_3, round(avg((r5 > 0)::INTEGER), 6) AS rate_5, avg((r3 > 0)::INTEGER) > 0.4 AND avg((r5 > 0)::INTEGER) > 0.3 AS good FROM p GROUP BY broker""")
def player_success_rate(spark, sf_dir):
    """A-19."""
    rate = {n: F.avg((C(f"r{n}") > 0).cast("int")) for n in (3, 5)}
    return player_performance(spark, sf_dir).groupBy("broker").agg(F.count("*").alias("n"), *(r6(v).alias(f"rate_{n}") for n, v in rate.items()), ((rate[3] > 0.4) & (rate[5] > 0.3)).alias("good"))


@query(f"""WITH {BROKERS}, c AS (SELECT rank, broker, count(*) AS n FROM brokers WHERE rank <= 3 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY n DESC, broker) AS k FROM c)
SELECT broker, min(rank)::INTEGER AS best_rank, sum(n)::BIGINT AS n FROM t WHERE k <= 10 GROUP BY broker""")
def big_players(spark, sf_dir):
    """A-18, S-6: the most frequent brokers of each of the first three ranks, united."""
    c = broker_events(spark, sf_dir).where("rank <= 3").groupBy("rank", "broker").agg(F.count("*").alias("n"))
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("n"), "broker"))).where("k <= 10")
    return top.groupBy("broker").agg(F.min("rank").cast("int").alias("best_rank"), F.sum("n").alias("n"))


@query(f"""WITH {BROKERS} SELECT l_partkey, day, max(CASE WHEN rank = 1 THEN broker END) AS dep1, max(CASE WHEN rank = 2 THEN broker END) AS dep2, round(max(CASE WHEN rank = 1 THEN rate END), 6) AS dep1_rate, round(coalesce(max(CASE WHEN rank = 2 THEN rate END), 0), 6) AS dep2_rate FROM brokers GROUP BY ALL""")
def ranked_list_to_columns(spark, sf_dir):
    """A-22."""
    w = broker_events(spark, sf_dir).groupBy("l_partkey", "day").pivot("rank", [1, 2]).agg(F.max("broker").alias("b"), F.max("rate").alias("r"))
    return w.select("l_partkey", "day", C("1_b").alias("dep1"), C("2_b").alias("dep2"), r6(C("1_r")).alias("dep1_rate"), r6(F.coalesce("2_r", F.lit(0.0))).alias("dep2_rate"))


@query(f"WITH {BROKERS} SELECT l_partkey, day, rank::INTEGER AS rank, broker, round(rate, 6) AS rate FROM brokers WHERE rank <= 2")
def columns_to_ranked_list(spark, sf_dir):
    """A-35: wide broker columns unpivoted."""
    w = broker_events(spark, sf_dir).groupBy("l_partkey", "day").pivot("rank", [1, 2]).agg(F.max("broker").alias("b"), F.max("rate").alias("r"))
    long = w.select("l_partkey", "day", F.expr("stack(2, 1, `1_b`, `1_r`, 2, `2_b`, `2_r`) as (rank, broker, rate)")).where("broker is not null")
    return long.select("l_partkey", "day", "rank", "broker", r6(C("rate")).alias("rate"))


@query(f"""WITH {BROKERS}, h AS (SELECT DISTINCT l_partkey, day, broker FROM brokers WHERE broker IN ('supp_1', 'supp_2') AND rate >= 0.1) SELECT l_partkey, day, count(*)::BIGINT AS n FROM h GROUP BY ALL""")
def buyer_filter(spark, sf_dir):
    """F-16, F-18: events with one of the brokers at a rate or more, any rank."""
    return broker_events(spark, sf_dir).where("broker in ('supp_1', 'supp_2') and rate >= 0.1").select("l_partkey", "day", "broker").distinct().groupBy("l_partkey", "day").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS}, a AS (SELECT entity_id, day, close, round(close * 1.002, 6) AS other FROM bars WHERE volume > 10) SELECT b.entity_id, b.day, round(b.close, 6) AS close, a.other AS other, abs(a.other - b.close) / b.close > 0.0019 AS flagged FROM bars b JOIN a USING (entity_id, day)""")
def source_cross_check(spark, sf_dir):
    """J-18, J-3, J-1: two sources compared on every common row."""
    b = bars(spark, sf_dir)
    a = b.where("volume > 10").select("entity_id", "day", F.round(C("close") * 1.002, 6).alias("other"))
    return b.join(a, ["entity_id", "day"]).select("entity_id", "day", r6(C("close")).alias("close"), "other", (F.abs(C("other") - C("close")) / C("close") > 0.0019).alias("flagged"))


@query(f"""WITH {BARS}, {ENTITIES}, f AS (SELECT area, day, volume, 1 + (entity_id = 'supp_1')::INTEGER * 0.1 AS factor, close FROM bars JOIN entities USING (entity_id)) SELECT area, day, round(sum(close * factor), 6) AS close, round(sum(volume / factor), 6) AS volume, count(*)::BIGINT AS n FROM f GROUP BY ALL""")
def adjusted_price_view(spark, sf_dir):
    """P-1, P-2, P-6, J-2, J-4, J-15: prices times a joined factor, volume over it, summed by area."""
    f = bars(spark, sf_dir).join(F.broadcast(entities(spark, sf_dir).select("entity_id", "area")), "entity_id").withColumn("factor", F.when(C("entity_id") == "supp_1", 1.1).otherwise(1.0))
    volume = F.when(C("factor") > 0, C("volume") / C("factor")).otherwise(C("volume"))
    return f.groupBy("area", "day").agg(r6(F.sum(C("close") * C("factor"))).alias("close"), r6(F.sum(volume)).alias("volume"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT o_custkey AS holder, l_partkey AS member, last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS report, sum(l_extendedprice) AS cap FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT holder, max(report) AS newest, max(CASE WHEN month(report) IN (6, 12) THEN report END) AS whole FROM h GROUP BY holder),
k AS (SELECT h.*, row_number() OVER (PARTITION BY h.holder, member ORDER BY report DESC) AS n FROM h JOIN t ON h.holder = t.holder AND report >= coalesce(whole, newest))
SELECT holder, member, report, round(cap, 4) AS cap FROM k WHERE n = 1""")
def portfolio_report_chain(spark, sf_dir):
    """J-13, A-34: back to the last half-year or annual report, the newest row of each member."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), C("l_orderkey") == C("o_orderkey"))
    report = F.last_day(F.add_months(F.trunc(C("o_orderdate").cast("date"), "quarter"), 2))
    h = l.groupBy(C("o_custkey").alias("holder"), C("l_partkey").alias("member"), report.alias("report")).agg(F.sum("l_extendedprice").alias("cap"))
    w = Window.partitionBy("holder")
    h = h.withColumn("since", F.coalesce(F.max(F.when(F.month("report").isin(6, 12), C("report"))).over(w), F.max("report").over(w))).where("report >= since")
    newest = F.row_number().over(Window.partitionBy("holder", "member").orderBy(F.desc("report")))
    return h.withColumn("n", newest).where("n = 1").select("holder", "member", "report", F.round("cap", 4).alias("cap"))
