"""Weights, costs, returns and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import portfolio as pf
from ..operators.cs import CrossSection
from ..operators.ts import Series
from ..sources.adapters import BARS, bars, table
from .catalog import query, r6

C, S, X = F.col, Series(), CrossSection()
SIG = """s AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close / nullif(lag(close, 20) OVER w, 0) - 1 AS mom FROM bars WINDOW w AS (PARTITION BY entity_id ORDER BY day)),
g AS (SELECT day, quantile_cont(mom, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS g FROM s GROUP BY day),
q AS (SELECT s.*, CASE WHEN mom IS NOT NULL AND len(list_distinct(g)) = 6 THEN greatest(1, len(list_filter(g[1:5], lambda b: b < mom))) END AS q FROM s JOIN g USING (day))"""


def _signals(spark, sf_dir):
    p = bars(spark, sf_dir).withColumns({"ret": S.pct_change(C("close")), "mom": S.pct_change(C("close"), 20)})
    return X.with_quantile_label(p, "mom", 5, "q")


@query(f"""WITH {BARS}, {SIG}, w AS (SELECT entity_id, day, CASE WHEN mom IS NOT NULL THEN 1.0 / count(mom) OVER (PARTITION BY day) ELSE 0 END AS w, CASE WHEN q IS NOT NULL THEN 1.0 / count(q) OVER (PARTITION BY day, q) ELSE 0 END AS wq, q FROM q)
SELECT entity_id, day, round(w, 6) AS equal, round(least(w, 0.05), 6) AS capped, q::INTEGER AS quantile, round(wq, 6) AS quantile_weight FROM w""")
def portfolio_weights(spark, sf_dir):
    """B-1, B-2, B-3, F-13."""
    p = _signals(spark, sf_dir)
    w = pf.equal_weights(C("mom"))
    return p.select("entity_id", "day", r6(w).alias("equal"), r6(pf.capped(w, 0.05)).alias("capped"), C("q").cast("int").alias("quantile"), r6(pf.equal_weights(C("q"), group="q")).alias("quantile_weight"))


RETS = f"""{BARS}, {SIG}, d AS (SELECT entity_id, day, coalesce(ret, 0) AS ret, t.k AS quantile, CASE WHEN q = t.k THEN 1.0 / nullif(count(CASE WHEN q = t.k THEN 1 END) OVER (PARTITION BY day, t.k), 0) ELSE 0 END AS w FROM q, (SELECT unnest([1, 2, 3, 4, 5]) AS k) t),
h AS (SELECT *, lag(w, 1, 0) OVER (PARTITION BY quantile, entity_id ORDER BY day) AS hw FROM d),
r AS (SELECT quantile, day, coalesce(sum(hw * ret), 0) - 0.001 * sum(abs(w - hw)) AS r FROM h GROUP BY ALL)"""


def _returns(spark, sf_dir):
    """Returns by day and quantile. A bar adds to five sums of its day; rows of five quantiles a bar are never made."""
    p = _signals(spark, sf_dir).select("entity_id", "day", "q", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    n = p.where("q is not null").groupBy("day", "q").agg(F.count("*").alias("n"))
    p = p.join(F.broadcast(n), ["day", "q"], "left").withColumn("w", F.try_divide(F.lit(1.0), C("n")))  # n: five rows a trade day
    return pf.group_returns(p, "q", 5)


@query(f"WITH {RETS} SELECT quantile::INTEGER AS quantile, day, round(r, 6) AS r FROM r")
def quantile_group_returns(spark, sf_dir):
    """B-4, J-8: weights held from the bar before, less turnover cost."""
    return _returns(spark, sf_dir).select("quantile", "day", r6(C("r")).alias("r"))


@query(f"""WITH {RETS}, x AS (SELECT quantile, day, 0.01 * r AS r FROM r), v AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY quantile ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM x),
m AS (SELECT *, value / max(value) OVER (PARTITION BY quantile ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM v)
SELECT quantile::INTEGER AS quantile, round((arg_max(value, day) - 1) * 100, 3) AS total_return, round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END, 4) AS sharpe, round(min(dd) * 100, 4) AS max_drawdown, round(count_if(r > 0) / count(r) * 100, 6) AS win_rate FROM m GROUP BY quantile""")
def performance_summary(spark, sf_dir):
    """A-29, B-5: reports at an exposure of a hundredth, since the given prices swing widely."""
    p = pf.performance(_returns(spark, sf_dir).withColumn("r", 0.01 * C("r")), ["quantile"])
    return p.select("quantile", F.round("total_return", 3).alias("total_return"), F.round("sharpe", 4).alias("sharpe"), F.round("max_drawdown", 4).alias("max_drawdown"), r6(C("win_rate")).alias("win_rate"))


@query(f"""WITH {BARS}, l AS (SELECT *, close / nullif(lag(close, 20) OVER w, 0) - 1 AS mom, lead(close, 5) OVER w / nullif(close, 0) - 1 AS f FROM bars WINDOW w AS (PARTITION BY entity_id ORDER BY day)), b AS (SELECT * FROM l WHERE mom IS NOT NULL AND f IS NOT NULL),
k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY mom) + (count(*) OVER (PARTITION BY day, mom) - 1) / 2.0 AS a, rank() OVER (PARTITION BY day ORDER BY f) + (count(*) OVER (PARTITION BY day, f) - 1) / 2.0 AS c FROM b)
SELECT day, CASE WHEN count(*) > 1 AND stddev_pop(a) > 0 AND stddev_pop(c) > 0 THEN round(corr(a, c), 6) END AS ic FROM k GROUP BY day HAVING count(*) > 2""")
def information_coefficient(spark, sf_dir):
    """A-30: Spearman correlation of factor and 5-bar forward return, by day."""
    p = bars(spark, sf_dir).withColumns({"mom": S.pct_change(C("close"), 20), "f": F.try_divide(S.lead(C("close"), 5), C("close")) - 1})
    n = p.where("mom is not null and f is not null").groupBy("day").count().where("count > 2").select("day")
    return pf.information_coefficient(p, "mom", "f").join(n, "day", "left_semi").select("day", r6(F.nanvl("ic", F.lit(None).cast("double"))).alias("ic"))


@query(f"""WITH {BARS}, {SIG}, f AS (SELECT *, lead(close, 5) OVER (PARTITION BY entity_id ORDER BY day) / nullif(close, 0) - 1 AS f FROM q) SELECT q::INTEGER AS quantile, round(avg(f), 6) AS mean_return, count(f)::BIGINT AS n FROM f WHERE q IS NOT NULL GROUP BY q""")
def quantile_mean_returns(spark, sf_dir):
    """A-31."""
    p = _signals(spark, sf_dir).withColumn("f", F.try_divide(S.lead(C("close"), 5), C("close")) - 1)
    return p.where("q is not null").groupBy(C("q").cast("int").alias("quantile")).agg(r6(F.avg("f")).alias("mean_return"), F.count("f").alias("n"))


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice AS v, left(o_orderpriority, 1) IN ('1', '2') AS buy FROM orders)
SELECT day, round(sum(greatest(v * 0.0003, 5) + CASE WHEN NOT buy THEN v * 0.0005 ELSE 0 END + v * 0.00002), 4) AS fee, round(sum(v), 4) AS value, count_if(v > 50000)::BIGINT AS over_limit FROM o GROUP BY day""")
def order_costs(spark, sf_dir):
    """X-1, A-28, F-14: fees by day; orders over a tenth of an equity of 500,000."""
    o = table(spark, sf_dir, "orders").select(C("o_orderdate").cast("date").alias("day"), C("o_totalprice").alias("v"), F.left("o_orderpriority", F.lit(1)).isin("1", "2").alias("buy"))
    return o.groupBy("day").agg(F.round(F.sum(pf.fee(C("v"), ~C("buy"))), 4).alias("fee"), F.round(F.sum("v"), 4).alias("value"), F.count_if(C("v") > 500_000 * 0.1).alias("over_limit"))


@query(f"""WITH {BARS}, b AS (SELECT *, lag(close) OVER (PARTITION BY entity_id ORDER BY day) AS prev, CASE WHEN volume % 2 < 1 THEN 'BUY' ELSE 'SELL' END AS side FROM bars)
SELECT entity_id, day, side, CASE WHEN volume <= 0 THEN 'suspended' WHEN side = 'BUY' AND abs(high - low) < 0.01 AND open >= round(prev * 1.1, 2) - 0.01 THEN 'limit_up' WHEN side = 'SELL' AND abs(high - low) < 0.01 AND open <= round(prev * 0.9, 2) + 0.01 THEN 'limit_down' ELSE 'ok' END AS reason,
round(open * 3 * CASE WHEN volume > 0 THEN 0.001 * (1 + greatest(3 / volume - 0.025, 0) * 0.1) ELSE 0.001 END, 6) AS slippage FROM b""")
def fill_and_slippage(spark, sf_dir):
    """X-2, X-3."""
    b = bars(spark, sf_dir).withColumns({"prev": S.lag(C("close")), "side": F.when(C("volume") % 2 < 1, "BUY").otherwise("SELL")})
    reason = pf.fill_reason(C("side"), C("open"), C("high"), C("low"), C("volume"), C("prev"))
    return b.select("entity_id", "day", "side", reason.alias("reason"), r6(pf.slippage(C("open"), F.lit(3.0), C("volume"))).alias("slippage"))


@query(f"""WITH {BARS}, p AS (SELECT entity_id, close, row_number() OVER (PARTITION BY entity_id ORDER BY day DESC) AS k FROM bars), last AS (SELECT entity_id, close FROM p WHERE k = 1),
t AS (SELECT entity_id, 1.0 / count(*) OVER () AS target FROM last WHERE close > 1500), h AS (SELECT 'supp_' || s_suppkey AS entity_id, s_acctbal AS held FROM supplier WHERE s_acctbal > 5000)
SELECT coalesce(t.entity_id, h.entity_id) AS entity_id, round(1000000 * coalesce(target, 0) - coalesce(held, 0), 4) AS delta, CASE WHEN h.entity_id IS NULL THEN 'open' WHEN t.entity_id IS NULL THEN 'close' ELSE 'change' END AS action FROM t FULL JOIN h ON t.entity_id = h.entity_id""")
def rebalance_orders(spark, sf_dir):
    """J-19, B-6, F-19: target value less held value, over both sides."""
    last = bars(spark, sf_dir).groupBy("entity_id").agg(F.max_by("close", "day").alias("close")).where("close > 1500")
    t = last.crossJoin(F.broadcast(last.agg(F.count("*").alias("n")))).select("entity_id", (1.0 / C("n")).alias("target"))  # one row: the count
    h = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.concat(F.lit("supp_"), C("s_suppkey")).alias("entity_id"), C("s_acctbal").alias("held"))
    both = t.join(h, "entity_id", "full")
    action = F.when(C("held").isNull(), "open").when(C("target").isNull(), "close").otherwise("change")
    return both.select("entity_id", F.round(1_000_000 * F.coalesce("target", F.lit(0.0)) - F.coalesce("held", F.lit(0.0)), 4).alias("delta"), action.alias("action"))
