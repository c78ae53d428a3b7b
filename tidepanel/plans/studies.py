"""Shapes, screens, money flows, positions, tags and pools, exports and a trained model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ts import Series
from ..sources import lake
from ..sources.adapters import BARS, ENTITIES, TICKS, bars, entities, table, ticks
from .catalog import query, r6
from .tables import _scratch

S, C = Series(), F.col
KEY = ["entity_id", "day"]
BY = "(PARTITION BY entity_id ORDER BY day)"
CHANGE = f"c AS (SELECT *, close / nullif(lag(close) OVER {BY}, 0) - 1 AS ch FROM bars)"


def _mean(n: int, x: str = "close") -> str:
    w = f"OVER (PARTITION BY entity_id ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN avg({x}) {w} END"


def _changed(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.withColumn("ch", F.try_divide("close", S.lag(C("close"))) - 1)


@query(f"""WITH {BARS}, n AS (SELECT *, lag(high) OVER {BY} AS ph, lag(low) OVER {BY} AS pl, lead(high) OVER {BY} AS nh, lead(low) OVER {BY} AS nl FROM bars),
d AS (SELECT *, CASE WHEN high > ph THEN 'up' WHEN low < pl THEN 'down' END AS turn FROM n)
SELECT entity_id, day, ph >= high AND pl <= low AS included, high > ph AS is_up, low < pl AS is_down, coalesce(last_value(turn IGNORE NULLS) OVER {BY}, 'up') AS direction,
round(-((high - close) + (high - ph) + (high - nh)) / close, 6) AS top_power, round((abs(low - close) + abs(low - pl) + abs(low - nl)) / close, 6) AS bottom_power FROM d""")
def bar_shapes(spark, sf_dir):
    """SC-9: inclusion, direction (kept from the bar before where a bar is neither up nor down) and the power of a top or bottom."""
    b = bars(spark, sf_dir).select("*", S.lag(C("high")).alias("ph"), S.lag(C("low")).alias("pl"), S.lead(C("high")).alias("nh"), S.lead(C("low")).alias("nl"))
    turn = F.when(C("high") > C("ph"), "up").when(C("low") < C("pl"), "down")
    top = -((C("high") - C("close")) + (C("high") - C("ph")) + (C("high") - C("nh"))) / C("close")
    bottom = (F.abs(C("low") - C("close")) + F.abs(C("low") - C("pl")) + F.abs(C("low") - C("nl"))) / C("close")
    inside = (C("ph") >= C("high")) & (C("pl") <= C("low"))
    return b.select(*KEY, inside.alias("included"), (C("high") > C("ph")).alias("is_up"), (C("low") < C("pl")).alias("is_down"), F.coalesce(F.last(turn, True).over(S.by), F.lit("up")).alias("direction"), r6(top).alias("top_power"), r6(bottom).alias("bottom_power"))


# Limits and names of the zone categories.
WIDTH_LIMIT, LEVEL_LIMITS, DISTANCE_LIMIT = 0.4, (3, 7), 0.5


@query(f"""WITH {BARS}, {CHANGE}, x AS (SELECT entity_id, day, ch, (high - low) / nullif(low, 0) AS width, volume FROM c)
SELECT entity_id, day, CASE WHEN width <= 0.4 THEN 'small' ELSE 'big' END AS range, CASE WHEN volume <= 3 THEN 'level1' WHEN volume <= 7 THEN 'level2' ELSE 'level3' END AS level,
CASE WHEN ch IS NULL OR ch = 0 THEN NULL WHEN ch <= -0.5 THEN 'big_down' WHEN ch < 0 THEN 'small_down' WHEN ch <= 0.5 THEN 'small_up' ELSE 'big_up' END AS distance,
CASE WHEN ch IS NOT NULL THEN round(greatest(-0.1, least(0.1, ch)), 6) END AS clipped, CASE WHEN ch > 0 THEN round(ch, 6) END AS positive FROM x""")
def zone_categories(spark, sf_dir):
    """SC-10, SC-7: buckets of width, level and distance; clipped and positive numbers."""
    width = F.try_divide(C("high") - C("low"), C("low"))
    one, two = LEVEL_LIMITS
    level = F.when(C("volume") <= one, "level1").when(C("volume") <= two, "level2").otherwise("level3")
    far = F.when(C("ch") == 0, None).when(C("ch") <= -DISTANCE_LIMIT, "big_down").when(C("ch") < 0, "small_down").when(C("ch") <= DISTANCE_LIMIT, "small_up").when(C("ch").isNotNull(), "big_up")
    clipped = F.when(C("ch").isNotNull(), F.greatest(F.lit(-0.1), F.least(F.lit(0.1), C("ch"))))
    return _changed(spark, sf_dir).select(*KEY, F.when(width <= WIDTH_LIMIT, "small").otherwise("big").alias("range"), level.alias("level"), far.alias("distance"), r6(clipped).alias("clipped"), F.when(C("ch") > 0, r6(C("ch"))).alias("positive"))


@query(f"""WITH {BARS}, new AS (SELECT entity_id, day, close * CASE WHEN entity_id LIKE '%1' THEN 1.25 ELSE 1.0 END AS close FROM bars WHERE day >= DATE '2000-01-01'),
f AS (SELECT entity_id, min(day) AS since, arg_min(close, day) AS fresh FROM new GROUP BY 1), k AS (SELECT f.entity_id, since, CASE WHEN round(bars.close, 2) <> round(fresh, 2) THEN fresh / bars.close ELSE 1.0 END AS factor FROM f JOIN bars ON bars.entity_id = f.entity_id AND day = since)
SELECT bars.entity_id, day, round(open * factor, 6) AS open, round(high * factor, 6) AS high, round(low * factor, 6) AS low, round(close * factor, 6) AS close FROM bars JOIN k USING (entity_id) WHERE day < since""")
def qfq_rebase(spark, sf_dir):
    """W-47: where a delivery's first close differs from the stored one, all older prices are scaled by new over old."""
    b = bars(spark, sf_dir)
    new = b.where("day >= '2000-01-01'").select(*KEY, (C("close") * F.when(C("entity_id").endswith("1"), 1.25).otherwise(1.0)).alias("new"))
    first = new.groupBy("entity_id").agg(F.min_by("new", "day").alias("new"), F.min("day").alias("at"))
    old = b.join(first, "entity_id").where(C("day") == C("at")).select("entity_id", "at", F.when(F.round("close", 2) != F.round("new", 2), C("new") / C("close")).otherwise(1.0).alias("factor"))
    return b.join(old, "entity_id").where(C("day") < C("at")).select(*KEY, *(r6(C(x) * C("factor")).alias(x) for x in ("open", "high", "low", "close")))


@query(f"""WITH {BARS}, {CHANGE}, m AS (SELECT *, {_mean(5)} AS m5, {_mean(10)} AS m10, {_mean(20)} AS m20, {_mean(30)} AS m30, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) AS back FROM c)
SELECT entity_id, coalesce(bool_or(ch > 0.08 AND turnover >= 20000), false) AND coalesce(bool_or(back = 1 AND turnover >= 1000 AND close > m10 AND m5 > m10 AND m10 > m20 AND m20 > m30), false) AS trending,
coalesce(bool_or(ch > 0.098), false) AND coalesce(bool_or(back = 1 AND turnover >= 1000 AND close > m10), false) AS active FROM m WHERE back <= 60 GROUP BY entity_id""")
def trending_and_active(spark, sf_dir):
    """W-48 in short: a strong day among the last sixty bars, and the averages in order (trending) or the close above one (active) on the last."""
    b = _changed(spark, sf_dir).select("*", *(S.mean(C("close"), n).alias(f"m{n}") for n in (5, 10, 20, 30)))
    b = b.withColumn("back", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("day")))).where("back <= 60")
    some = lambda x: F.coalesce(F.some(F.expr(x)), F.lit(False))
    trending = some("ch > 0.08 and turnover >= 20000") & some("back = 1 and turnover >= 1000 and close > m10 and m5 > m10 and m10 > m20 and m20 > m30")
    return b.groupBy("entity_id").agg(trending.alias("trending"), (some("ch > 0.098") & some("back = 1 and turnover >= 1000 and close > m10")).alias("active"))


@query(f"""WITH {BARS}, {CHANGE}, d AS (SELECT DISTINCT day FROM bars ORDER BY day DESC LIMIT 250), h AS (SELECT * FROM c WHERE ch > 0.095 AND day >= (SELECT min(day) FROM d))
SELECT entity_id, count(*)::BIGINT AS high_days, max(day) AS last_day, round(arg_max(close, day), 6) AS close FROM h GROUP BY entity_id HAVING count(*) >= 2""")
def high_days(spark, sf_dir):
    """K-6: each entity's last limit-up record within the recent trade days, of entities with two or more."""
    b = _changed(spark, sf_dir)
    since = b.select("day").distinct().orderBy(F.desc("day")).limit(250).agg(F.min("day").alias("since"))  # one row
    h = b.where("ch > 0.095").join(since, C("day") >= C("since"))
    g = h.groupBy("entity_id").agg(F.count("*").alias("high_days"), F.max("day").alias("last_day"), F.max_by("close", "day").alias("close"))
    return g.where("high_days >= 2").withColumn("close", r6(C("close")))


@query(f"""WITH {BARS}, f AS (SELECT entity_id, day, 'volume' AS factor, volume AS v FROM bars UNION ALL SELECT entity_id, day, 'spread', (high - low) / nullif(low, 0) FROM bars),
k AS (SELECT *, row_number() OVER (PARTITION BY factor, day ORDER BY round(v, 9) DESC NULLS LAST, entity_id) AS rank FROM f) SELECT factor, day, rank::INTEGER AS rank, entity_id FROM k WHERE rank <= 10""")
def first_targets(spark, sf_dir):
    """K-8: the first ten targets of each factor and day."""
    spread = F.try_divide(C("high") - C("low"), C("low"))
    f = bars(spark, sf_dir).select(*KEY, C("volume"), spread.alias("spread")).unpivot(KEY, ["volume", "spread"], "factor", "v")
    w = Window.partitionBy("factor", "day").orderBy(F.desc_nulls_last(F.round("v", 9)), "entity_id")
    return f.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("factor", "day", "rank", "entity_id")


@query(f"""WITH {BARS}, {CHANGE}, l AS (SELECT max(day) AS last FROM bars), t AS (SELECT entity_id, avg(turnover) AS t FROM c, l WHERE day > last - 365 GROUP BY 1),
p AS (SELECT entity_id FROM (SELECT entity_id, percent_rank() OVER (ORDER BY round(t, 6) DESC) AS r FROM t) WHERE r <= 0.4), m AS (SELECT *, {_mean(5)} AS m5, {_mean(20)} AS m20, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) AS back FROM c)
SELECT entity_id, day, round(close, 6) AS close, coalesce(m5 > m20, false) AS long FROM m SEMI JOIN p USING (entity_id) WHERE back = 1 AND turnover > 1000""")
def screening_report(spark, sf_dir):
    """S-11: the two fifths of the entities with the largest mean turnover, the last bar's threshold, then the factor's target."""
    b = bars(spark, sf_dir)
    since = b.agg(F.date_sub(F.max("day"), 365).alias("since"))  # one row
    mean = b.join(since, C("day") > C("since")).groupBy("entity_id").agg(F.avg("turnover").alias("t"))
    pool = mean.withColumn("r", F.percent_rank().over(Window.orderBy(F.desc(F.round("t", 6))))).where("r <= 0.4")  # a row an entity
    m = b.select("*", S.mean(C("close"), 5).alias("m5"), S.mean(C("close"), 20).alias("m20"), F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("day"))).alias("back"))
    return m.where("back = 1 and turnover > 1000").join(pool, "entity_id", "left_semi").select(*KEY, r6(C("close")).alias("close"), F.coalesce(C("m5") > C("m20"), F.lit(False)).alias("long"))


@query(f"""WITH {BARS}, {ENTITIES}, m AS (SELECT entity_id, date_trunc('month', day)::DATE AS month, arg_max(close, day) / nullif(arg_min(close, day), 0) - 1 AS rise, min(day) FILTER (WHERE turnover > 0) AS first_day, arg_min(close, day) FILTER (WHERE turnover > 0) AS first_close FROM bars GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(rise, 9) DESC NULLS LAST, entity_id) AS rank FROM m) SELECT month, rank::INTEGER AS rank, entity_id, first_day, round(first_close * cap, 4) AS cap FROM k JOIN entities USING (entity_id) WHERE rank <= 30""")
def month_study(spark, sf_dir):
    """A-37: the thirty best of each month with their capitalisation on its first traded day."""
    b = bars(spark, sf_dir).withColumn("month", F.trunc("day", "month"))
    traded = F.when(C("turnover") > 0, C("day"))
    m = b.groupBy("entity_id", "month").agg((F.try_divide(F.max_by("close", "day"), F.min_by("close", "day")) - 1).alias("rise"), F.min(traded).alias("first_day"), F.min_by("close", traded).alias("first_close"))
    k = m.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc_nulls_last(F.round("rise", 9)), "entity_id"))).where("rank <= 30")
    return k.join(entities(spark, sf_dir), "entity_id").select("month", "rank", "entity_id", "first_day", F.round(C("first_close") * C("cap"), 4).alias("cap"))


@query("""WITH y AS (SELECT o_custkey AS code, year(o_orderdate) AS y, sum(o_totalprice) AS income, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS receivable FROM orders GROUP BY ALL),
g AS (SELECT *, income / nullif(lag(income) OVER (PARTITION BY code ORDER BY y), 0) - 1 AS growth, row_number() OVER (PARTITION BY code ORDER BY y DESC) AS back FROM y), b AS (SELECT c_custkey AS code, c_acctbal * 20 AS equity FROM customer)
SELECT code FROM g WHERE back = 1 AND growth < -0.1 UNION SELECT code FROM g JOIN b USING (code) WHERE back = 1 AND receivable > equity UNION SELECT code FROM g WHERE back = 1 AND receivable > income / 2""")
def risky_companies(spark, sf_dir):
    """F-20: falling income, receivables above the equity, or latest receivables above half of the latest income."""
    o = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("code"), F.year("o_orderdate").alias("y"))
    y = o.agg(F.sum("o_totalprice").alias("income"), F.sum(F.when(C("o_orderstatus") == "O", C("o_totalprice")).otherwise(0.0)).alias("receivable"))
    w = Window.partitionBy("code").orderBy("y")
    g = y.select("*", (F.try_divide("income", F.lag("income").over(w)) - 1).alias("growth"), F.row_number().over(Window.partitionBy("code").orderBy(F.desc("y"))).alias("back")).where("back = 1")
    b = table(spark, sf_dir, "customer").select(C("c_custkey").alias("code"), (C("c_acctbal") * 20).alias("equity"))
    risky = (C("growth") < -0.1) | (C("receivable") > C("equity")) | (C("receivable") > C("income") / 2)
    return g.join(b, "code", "left").where(risky).select("code").distinct()


@query(f"""WITH {TICKS}, t AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY entity_id, ts ORDER BY event_id) = 1), c AS (SELECT 'user_' || c_custkey AS entity_id, c_mktsegment AS segment, c_acctbal AS cap FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY c_name) = 1)
SELECT event_id, entity_id, segment, round(price * cap, 4) AS value FROM t JOIN c USING (entity_id)""")
def ticks_with_attributes(spark, sf_dir):
    """J-5: ticks joined to the static attributes of their entity, the first row of a key on both sides."""
    first = lambda df, key, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")
    c = first(table(spark, sf_dir, "customer"), ["c_custkey"], "c_name").select(F.concat(F.lit("user_"), C("c_custkey")).alias("entity_id"), C("c_mktsegment").alias("segment"), C("c_acctbal").alias("cap"))
    return first(ticks(spark, sf_dir), ["entity_id", "ts"], "event_id").join(c, "entity_id").select("event_id", "entity_id", "segment", F.round(C("price") * C("cap"), 4).alias("value"))


@query("""WITH o AS (SELECT c_nationkey AS code, year(o_orderdate)::INTEGER AS y, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT s_nationkey AS code, year(l_shipdate)::INTEGER AS y, round(sum(l_quantity), 2) AS shipped FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT code, y, orders, amount, shipped FROM o FULL JOIN s USING (code, y)""")
def country_indicators(spark, sf_dir):
    """J-16: several yearly indicators of one country side by side, NULL where one has no value."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), C("o_custkey") == C("c_custkey")).groupBy(C("c_nationkey").alias("code"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    s = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), C("l_suppkey") == C("s_suppkey")).groupBy(C("s_nationkey").alias("code"), F.year("l_shipdate").alias("y")).agg(F.round(F.sum("l_quantity"), 2).alias("shipped"))
    return o.join(s, ["code", "y"], "full")


@query(f"""WITH {TICKS}, {BARS} SELECT entity_id || '_' || strftime(day, '%Y-%m-%d') AS id, '1d' AS level FROM bars UNION ALL SELECT entity_id || '_' || strftime(ts, '%Y-%m-%dT%H:%M:%S'), '1m' FROM ticks""")
def bar_ids(spark, sf_dir):
    """P-4: ids of bars, by date for daily levels and by ISO time below."""
    day = bars(spark, sf_dir).select(F.concat_ws("_", "entity_id", F.date_format("day", "yyyy-MM-dd")).alias("id"), F.lit("1d").alias("level"))
    return day.union(ticks(spark, sf_dir).select(F.concat_ws("_", "entity_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), F.lit("1m")))


@query("""SELECT o_orderpriority AS entity_id, count(*)::BIGINT AS n, bool_or(o_totalprice > 400000) AS "exists", max(CASE WHEN o_orderkey = 7 THEN o_custkey END)::BIGINT AS by_id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1""")
def point_lookups(spark, sf_dir):
    """SRC-8, P-5: a filtered count, an existence test and a look-up by id, over pruned columns."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= '1996-01-01'").select("o_orderkey", "o_custkey", "o_totalprice", C("o_orderpriority").alias("entity_id"))
    return o.groupBy("entity_id").agg(F.count("*").alias("n"), F.some(C("o_totalprice") > 400000).alias("exists"), F.max(F.when(C("o_orderkey") == 7, C("o_custkey"))).alias("by_id"))


@query("""WITH v AS (SELECT 'supp_' || l_suppkey AS entity_id, l_shipdate::DATE AS day, l_extendedprice * CASE l_returnflag WHEN 'R' THEN -1 ELSE 1 END AS a, CASE WHEN l_quantity >= 40 THEN 0 WHEN l_quantity >= 25 THEN 1 WHEN l_quantity >= 10 THEN 2 ELSE 3 END AS size FROM lineitem),
g AS (SELECT entity_id, day, sum(CASE WHEN size = 0 THEN a END) AS huge, sum(CASE WHEN size = 1 THEN a END) AS big, sum(CASE WHEN size = 2 THEN a END) AS medium, sum(CASE WHEN size = 3 THEN a END) AS small, sum(abs(a)) AS total FROM v GROUP BY ALL),
m AS (SELECT *, coalesce(huge, 0) + coalesce(big, 0) AS main, coalesce(huge, 0) + coalesce(big, 0) + coalesce(medium, 0) + coalesce(small, 0) AS net FROM g WHERE total <> 0)
SELECT entity_id, day, round(main / 10000, 6) AS main, round(net / 10000, 6) AS net, round(main / total, 6) AS main_rate, round(net / total, 6) AS net_rate FROM m""")
def money_flow(spark, sf_dir):
    """P-7, P-8: amounts split by order size; main and net inflow and their rates, days without turnover left out."""
    signed = C("l_extendedprice") * F.when(C("l_returnflag") == "R", -1).otherwise(1)
    size = F.when(C("l_quantity") >= 40, "huge").when(C("l_quantity") >= 25, "big").when(C("l_quantity") >= 10, "medium").otherwise("small")
    v = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supp_"), C("l_suppkey")).alias("entity_id"), C("l_shipdate").cast("date").alias("day"), signed.alias("a"), size.alias("size"))
    part = lambda *names: F.coalesce(F.sum(F.when(C("size").isin(*names), C("a"))), F.lit(0.0))
    g = v.groupBy("entity_id", "day").agg(part("huge", "big").alias("main"), part("huge", "big", "medium", "small").alias("net"), F.sum(F.abs("a")).alias("total")).where("total <> 0")
    return g.select(*KEY, r6(C("main") / 10000).alias("main"), r6(C("net") / 10000).alias("net"), r6(C("main") / C("total")).alias("main_rate"), r6(C("net") / C("total")).alias("net_rate"))


@query(f"""WITH {BARS}, a AS (SELECT entity_id, day, CASE WHEN volume > 20 THEN close * 1.5 ELSE 0 END AS adjusted FROM bars WHERE month(day) % 2 = 0), f AS (SELECT entity_id, day, round(adjusted / nullif(close, 0), 6) AS factor FROM bars JOIN a USING (entity_id, day))
SELECT entity_id AS symbol, day AS trade_date, round(close, 6) AS price_close, coalesce(factor, 1.0) AS hfq_factor, 1.0::DOUBLE AS qfq_factor, year(day)::INTEGER AS year, month(day)::INTEGER AS month FROM bars LEFT JOIN f USING (entity_id, day)""")
def daily_feed(spark, sf_dir):
    """P-6, J-1, J-3: the factor of adjusted over raw closes, joined to the bars; a missing one is 1; vendor names, year and month."""
    b = bars(spark, sf_dir)
    a = b.where(F.month("day") % 2 == 0).select(*KEY, F.when(C("volume") > 20, C("close") * 1.5).otherwise(0.0).alias("adjusted"))
    f = b.join(a, KEY).select(*KEY, r6(F.try_divide("adjusted", "close")).alias("factor"))
    rows = b.join(f, KEY, "left").select("entity_id", "day", r6(C("close")).alias("close"), F.coalesce("factor", F.lit(1.0)).alias("hfq_factor"), F.lit(1.0).alias("qfq_factor"), F.year("day").alias("year"), F.month("day").alias("month"))
    return rows.withColumnsRenamed({"entity_id": "symbol", "day": "trade_date", "close": "price_close"})


@query(f"""WITH {BARS}, l AS (SELECT entity_id, arg_max(close, day) AS close FROM bars GROUP BY 1), p AS (SELECT o_custkey AS trader, 'supp_' || l_suppkey AS entity_id, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS long_n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short_n,
sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END) AS long_paid, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) AS short_paid FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
v AS (SELECT *, long_n * close AS long_value, 2 * short_paid - short_n * close AS short_value, (long_n * close - long_paid) / nullif(long_paid, 0) AS rate FROM p JOIN l USING (entity_id))
SELECT trader, count(*)::BIGINT AS positions, round(sum(long_value), 4) AS long_value, round(sum(short_value), 4) AS short_value, round(sum(long_value) + sum(short_value) + max(c_acctbal), 4) AS all_value, (count(*) FILTER (WHERE long_n > 1 AND (rate >= 3 OR rate <= -0.3)))::BIGINT AS to_close FROM v JOIN customer ON trader = c_custkey GROUP BY trader""")
def positions_marked(spark, sf_dir):
    """A-27, F-19: long and short positions at the last close, account sums with cash, and positions beyond the profit or loss limit."""
    last = bars(spark, sf_dir).groupBy("entity_id").agg(F.max_by("close", "day").alias("close"))
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    short = C("l_returnflag") == "R"
    side = lambda x, is_short: F.sum(F.when(short if is_short else ~short, C(x)).otherwise(0.0))
    p = line.groupBy(C("o_custkey").alias("trader"), F.concat(F.lit("supp_"), C("l_suppkey")).alias("entity_id")).agg(side("l_quantity", False).alias("long_n"), side("l_quantity", True).alias("short_n"), side("l_extendedprice", False).alias("long_paid"), side("l_extendedprice", True).alias("short_paid"))
    v = p.join(last, "entity_id").withColumns({"long_value": C("long_n") * C("close"), "short_value": 2 * C("short_paid") - C("short_n") * C("close")})
    v = v.withColumn("rate", F.try_divide(C("long_value") - C("long_paid"), "long_paid"))
    g = v.groupBy("trader").agg(F.count("*").alias("positions"), F.sum("long_value").alias("l"), F.sum("short_value").alias("s"), F.count_if((C("long_n") > 1) & ((C("rate") >= 3) | (C("rate") <= -0.3))).alias("to_close"))
    cash = table(spark, sf_dir, "customer").select(C("c_custkey").alias("trader"), "c_acctbal")
    return g.join(cash, "trader").select("trader", "positions", F.round("l", 4).alias("long_value"), F.round("s", 4).alias("short_value"), F.round(C("l") + C("s") + C("c_acctbal"), 4).alias("all_value"), "to_close")


@query("""WITH h AS (SELECT l_partkey AS entity_id, date_trunc('quarter', l_shipdate)::DATE AS report, sum(l_quantity) AS held FROM lineitem GROUP BY ALL), c AS (SELECT *, held / nullif(lag(held) OVER (PARTITION BY entity_id ORDER BY report), 0) - 1 AS ratio, row_number() OVER (PARTITION BY entity_id ORDER BY report DESC) AS back FROM h)
SELECT entity_id, report, round(ratio, 6) AS ratio, CASE WHEN ratio > 0.05 THEN true WHEN ratio < -0.5 THEN false END AS signal FROM c WHERE back = 1""")
def holding_change_signals(spark, sf_dir):
    """F-18: long where a fund's holding grew by over 5 % in the latest report, short where it fell by over half."""
    h = table(spark, sf_dir, "lineitem").groupBy(C("l_partkey").alias("entity_id"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("report")).agg(F.sum("l_quantity").alias("held"))
    w = Window.partitionBy("entity_id")
    c = h.select("*", (F.try_divide("held", F.lag("held").over(w.orderBy("report"))) - 1).alias("ratio"), F.row_number().over(w.orderBy(F.desc("report"))).alias("back")).where("back = 1")
    return c.select("entity_id", "report", r6(C("ratio")).alias("ratio"), F.when(C("ratio") > 0.05, True).when(C("ratio") < -0.5, False).alias("signal"))


@query("""WITH s AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS tag, CASE WHEN p_size > 25 THEN 'up' ELSE 'down' END AS kind FROM part)
SELECT tag, count(*)::BIGINT AS n, arg_min(kind, id) AS kind, array_to_string(list(DISTINCT id ORDER BY id), ',') AS ids FROM s GROUP BY tag""")
def tag_suggestions(spark, sf_dir):
    """A-15: up and down suggestions exploded; for each tag their count, first kind and distinct ids."""
    suggested = F.to_json(F.struct(F.split("p_name", " ").alias("tags"), F.when(C("p_size") > 25, "up").otherwise("down").alias("kind")))
    s = table(spark, sf_dir, "part").select(C("p_partkey").alias("id"), F.from_json(suggested, "tags array<string>, kind string").alias("s"))
    g = s.select("id", "s.kind", F.explode("s.tags").alias("tag")).groupBy("tag")
    return g.agg(F.count("*").alias("n"), F.min_by("kind", "id").alias("kind"), F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("ids"))


@query(r"""WITH h AS (SELECT o_orderdate::DATE AS day, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE regexp_extract(o_orderpriority, '^[0-9]+')::BIGINT END AS height FROM orders)
SELECT day, max(height)::BIGINT AS max_height, sum(height)::BIGINT AS continuous_power FROM h GROUP BY day""")
def board_ladder(spark, sf_dir):
    """A-36: board counts read from text, the last whole number of it, and 1 for a first board or an empty text."""
    text = F.when(C("o_orderstatus") == "P", F.lit("首板")).otherwise(C("o_orderpriority"))
    numbers = F.regexp_extract_all(text, F.lit("([0-9]+)"))
    h = table(spark, sf_dir, "orders").select(C("o_orderdate").cast("date").alias("day"), F.coalesce(F.get(numbers, F.size(numbers) - 1).cast("long"), F.lit(1)).alias("height"))
    n = h.groupBy("day", "height").agg(F.count("*").alias("n"))
    return n.groupBy("day").agg(F.max("height").alias("max_height"), F.sum(C("height") * C("n")).alias("continuous_power"))


@query("""WITH h AS (SELECT l_partkey AS entity_id, l_shipdate::DATE AS day, l_suppkey AS holder, sum(l_quantity) AS ratio FROM lineitem GROUP BY ALL), i AS (SELECT l_partkey AS entity_id, l_shipdate::DATE AS day, sum(l_extendedprice) AS value, sum(l_quantity) AS ratio FROM lineitem WHERE l_discount < 0.05 GROUP BY ALL)
SELECT entity_id, day, holder, round(h.ratio * (value / nullif(i.ratio, 0)), 4) AS value FROM h JOIN i USING (entity_id, day)""")
def holder_value(spark, sf_dir):
    """A-38: a holder's value from its ratio and the institutions' value and ratio of the same date."""
    line = table(spark, sf_dir, "lineitem").withColumns({"entity_id": C("l_partkey"), "day": C("l_shipdate").cast("date")})
    i = line.where("l_discount < 0.05").groupBy("entity_id", "day").agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("all"))
    h = line.groupBy("entity_id", "day", C("l_suppkey").alias("holder")).agg(F.sum("l_quantity").alias("ratio"))
    return h.join(i, ["entity_id", "day"]).select("entity_id", "day", "holder", F.round(C("ratio") * F.try_divide("value", "all"), 4).alias("value"))


@query(f"""WITH {BARS}, {CHANGE}, v AS (SELECT day, 'volume' AS pool, entity_id FROM c WHERE volume > 50 UNION SELECT day, 'rise', entity_id FROM c WHERE ch > 0.1), a AS (SELECT day, 'all' AS pool, entity_id FROM v GROUP BY ALL),
n AS (SELECT day, pool, array_to_string(list(DISTINCT entity_id ORDER BY entity_id), ',') AS ids, count(DISTINCT entity_id) AS n FROM (FROM v UNION ALL FROM a) GROUP BY ALL) SELECT day, pool, ids, n::BIGINT AS n, n > 5 AS overwrite FROM n""")
def stock_pools(spark, sf_dir):
    """SNK-9, S-8, ST-11: pools of a day, appended as the union of distinct rows; the union of all; whether a pool is full and is to be overwritten."""
    c = _changed(spark, sf_dir)
    pool = lambda rows, name: rows.select("day", F.lit(name).alias("pool"), "entity_id")
    v = pool(c.where("volume > 50"), "volume").union(pool(c.where("ch > 0.1"), "rise"))
    both = v.union(pool(v, "all"))
    g = both.groupBy("day", "pool").agg(F.array_sort(F.collect_set("entity_id")).alias("ids"))
    return g.select("day", "pool", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"), (F.size("ids") > 5).alias("overwrite"))


@query("""SELECT DISTINCT p_type || '_1d_' || 's' || p_size || '_w20' AS factor_id, left(md5(p_type || '_1d_' || 's' || p_size || '_w20'), 8) AS hash FROM part""")
def factor_ids(spark, sf_dir):
    """SC-14: a factor's id of its name, timeframe and parameters in the order of their names, and the first eight digits of its md5."""
    parameters = F.array_sort(F.array(F.concat(F.lit("w"), F.lit(20)), F.concat(F.lit("s"), C("p_size"))))
    ids = table(spark, sf_dir, "part").select(F.concat_ws("_", C("p_type"), F.lit("1d"), parameters).alias("factor_id")).distinct()
    return ids.withColumn("hash", F.left(F.md5("factor_id"), F.lit(8)))


@query(f"""WITH {BARS}, {CHANGE} SELECT day, (count(*) FILTER (WHERE ch > 0))::BIGINT AS up, (count(*) FILTER (WHERE ch <= 0))::BIGINT AS down, array_to_string(list(entity_id ORDER BY entity_id) FILTER (WHERE ch > 0.1), ',') AS strong, round(arg_max(s, entity_id), 6) AS last_score
FROM (SELECT *, percent_rank() OVER (PARTITION BY day ORDER BY close) AS s FROM c) GROUP BY day""")
def scores_and_counts(spark, sf_dir):
    """U-5, U-7: a cross-section score, and counts by predicate and lists in one aggregation."""
    c = _changed(spark, sf_dir).withColumn("s", F.percent_rank().over(Window.partitionBy("day").orderBy("close")))
    strong = F.array_sort(F.collect_list(F.when(C("ch") > 0.1, C("entity_id"))))
    g = c.groupBy("day").agg(F.count_if(C("ch") > 0).alias("up"), F.count_if(C("ch") <= 0).alias("down"), F.when(F.size(strong) > 0, F.array_join(strong, ",")).alias("strong"), r6(F.max_by("s", "entity_id")).alias("last_score"))
    return g


@query(f"""WITH {BARS}, {ENTITIES} SELECT entity_id, '股票 ' || name AS name, exchange FROM entities UNION ALL SELECT DISTINCT entity_id, 'bar', NULL FROM bars""")
def csv_encodings(spark, sf_dir):
    """SRC-14, SNK-8: CSV written and read in GB18030 (which holds GBK and GB2312), and in UTF-8."""
    gb, utf, schema = _scratch(spark, "gb"), _scratch(spark, "utf"), "entity_id string, name string, exchange string"
    names = entities(spark, sf_dir).select("entity_id", F.concat(F.lit("股票 "), C("name")).alias("name"), "exchange")
    lake.write_csv(names, gb, "GB18030")
    lake.write_csv(bars(spark, sf_dir).select("entity_id", F.lit("bar").alias("name"), F.lit(None).cast("string").alias("exchange")).distinct(), utf, "UTF-8")
    return lake.read_csv(spark, gb, schema, _scratch(spark, "gb-rows")).union(lake.read_csv(spark, utf, schema, _scratch(spark, "utf-rows")))


@query(f"""WITH {BARS} SELECT entity_id, day, round(open, 6) AS open, round(close, 6) AS close, round(high, 6) AS high, round(low, 6) AS low, round(volume, 6) AS volume, round(turnover, 6) AS turnover, round(volume / 100, 6) AS change_pct, 0.0::DOUBLE AS turnover_rate FROM bars WHERE day >= DATE '1998-01-01'""")
def kline_export(spark, sf_dir):
    """SRC-12: bars from a given day on (inclusive) as k-line text, a folder for each symbol, read back and parsed."""
    path = _scratch(spark, "klines")
    text = F.concat_ws(",", "day", *(C(x).cast("string") for x in ("open", "close", "high", "low", "volume", "turnover")), F.lit("-"), C("volume").cast("string"), F.lit("-"), F.lit(""))
    rows = bars(spark, sf_dir, rows_a_task=200_000).where("day >= '1998-01-01'").select(C("entity_id").alias("symbol"), text.alias("value"))
    if lake.local_path(spark, path):
        listed = f"{path}-files"
        lake.write_lines(rows, path, "symbol", "txt", listed=listed, dealt=True)
        lines = lake.read_lines(spark.read.parquet(listed), path)
    else:
        rows.repartition("symbol").write.partitionBy("symbol").text(path)
        with lake.listed_together(spark):
            lines = spark.read.schema("value string, symbol string").text(path)
    parsed = lake.parse_klines(lines.select("value", "symbol"), keep=("symbol",))
    numbers = ("open", "close", "high", "low", "volume", "turnover", "change_pct", "turnover_rate")
    return parsed.select(C("symbol").alias("entity_id"), "day", *(r6(C(x)).alias(x) for x in numbers))


@query("""WITH n AS (SELECT l_suppkey AS id, p_brand AS tag, min(l_shipdate::DATE) AS since, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), o AS (SELECT * FROM n WHERE since < DATE '1996-01-01'), w AS (SELECT * FROM n WHERE since >= DATE '1996-01-01'),
c AS (SELECT id, arg_max(tag, (since, tag)) AS tag FROM o GROUP BY 1), d AS (SELECT id, arg_max(tag, (since, tag)) AS tag FROM w GROUP BY 1), m AS (SELECT id, array_to_string(list(tag || '=' || n ORDER BY tag), ',') AS history FROM n GROUP BY id),
s AS (SELECT l_suppkey AS id, arg_max(p_type, (n, p_type)) AS sub FROM (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY 1)
SELECT m.id, coalesce(d.tag, c.tag, 'other') AS main_tag, c.tag AS former_tag, history, sub AS sub_tag, CASE WHEN sub = 'ECONOMY' THEN 'economy' ELSE coalesce(d.tag, c.tag) END AS by_sub_tag FROM m LEFT JOIN c USING (id) LEFT JOIN d USING (id) LEFT JOIN s USING (id)""")
def tag_upkeep(spark, sf_dir):
    """T-1, T-2, T-3, T-4: current main tag taken from new rows, else kept; the history map with the new one's entries; the sub tag, and the main tag that follows from it."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), C("l_partkey") == C("p_partkey")).select(C("l_suppkey").alias("id"), C("l_shipdate").cast("date").alias("day"), "p_brand", "p_type")
    n = line.groupBy("id", C("p_brand").alias("tag")).agg(F.min("day").alias("since"), F.count("*").alias("n"))
    is_new, at = C("since") >= F.lit("1996-01-01").cast("date"), F.struct("since", "tag")
    side = lambda cond: F.map_from_entries(F.collect_list(F.when(cond, F.struct("tag", "n"))))
    m = n.groupBy("id").agg(F.max(F.when(is_new, at)).getField("tag").alias("new"), F.max(F.when(~is_new, at)).getField("tag").alias("former_tag"), side(~is_new).alias("old_map"), side(is_new).alias("new_map"))
    entries = F.transform(F.array_sort(F.map_entries(F.map_concat("old_map", "new_map"))), lambda e: F.concat(e.key, F.lit("="), e.value))
    sub = line.groupBy("id", "p_type").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("p_type", F.struct("n", "p_type")).alias("sub_tag"))
    main = F.coalesce("new", "former_tag", F.lit("other"))
    return m.join(sub, "id", "left").select("id", main.alias("main_tag"), "former_tag", F.array_join(entries, ",").alias("history"), "sub_tag", F.when(C("sub_tag") == "ECONOMY", "economy").otherwise(main).alias("by_sub_tag"))


@query("""WITH t AS (SELECT p_brand AS tag, p_partkey AS id, p_type AS name, p_retailprice AS price FROM part), a AS (SELECT tag, array_to_string(list(id || ':' || name || ':' || round(price, 2)::DECIMAL(18,2) ORDER BY id), ',') AS details FROM t GROUP BY tag),
o AS (SELECT tag, array_to_string(list(DISTINCT name ORDER BY name), ',') AS own FROM t GROUP BY tag), c AS (SELECT DISTINCT name FROM t), u AS (SELECT b.tag, array_to_string(list(name ORDER BY name), ',') AS unused FROM (SELECT DISTINCT tag FROM t) b, c WHERE (b.tag, name) NOT IN (SELECT tag, name FROM t) GROUP BY b.tag)
SELECT tag, details, own, coalesce(unused, '') AS unused FROM a JOIN o USING (tag) LEFT JOIN u USING (tag)""")
def tag_details(spark, sf_dir):
    """T-7: each tag's members with their details, its own options, and the catalogue's options that it does not use yet."""
    t = table(spark, sf_dir, "part").select(C("p_brand").alias("tag"), C("p_partkey").alias("id"), C("p_type").alias("name"), C("p_retailprice").cast("decimal(18,2)").alias("price"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("id", "name", "price"))), lambda e: F.concat_ws(":", e.id, e["name"], e.price))
    g = t.groupBy("tag").agg(F.array_join(shown, ",").alias("details"), F.array_sort(F.collect_set("name")).alias("own"))
    catalogue = t.agg(F.array_sort(F.collect_set("name")).alias("every"))  # one row: the kinds
    return g.join(F.broadcast(catalogue)).select("tag", "details", F.array_join("own", ",").alias("own"), F.array_join(F.array_except("every", "own"), ",").alias("unused"))


@query()
def linear_model(spark, sf_dir):
    """M-1, M-2, M-3: averages as features, rows with a NULL left out, a split by time, a scaled linear regression and its predictions of later days."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = [f"ma_{n}" for n in (5, 10, 20)]
    rows = bars(spark, sf_dir).select(*KEY, *(S.mean(C("close"), n).alias(f"ma_{n}") for n in (5, 10, 20)), "close", S.lead(C("close")).alias("label")).dropna()
    path = _scratch(spark, "features")
    rows.write.parquet(path)  # read by each step of the fit, which would make the bars anew
    rows = spark.read.parquet(path)
    model = Pipeline(stages=[VectorAssembler(inputCols=["close", *names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LinearRegression(maxIter=20)]).fit(rows.where("day < '2000-01-01'"))
    return model.transform(rows.where("day >= '2000-01-01'")).select(*KEY, r6(C("label")).alias("label"), r6(C("prediction")).alias("prediction"))
