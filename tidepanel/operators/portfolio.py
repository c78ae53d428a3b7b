"""Weights, costs, set-based returns and reports (B, X, A-28 to A-31, F-13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cs import CrossSection
from .ts import correlation


def equal_weights(signal: Column, time: str = "day", group: str | None = None) -> Column:
    """B-1, B-2: one over the number of signals of the time (and group); 0 without a signal."""
    w = Window.partitionBy(time, *([group] if group else []))
    return F.when(signal.isNotNull(), 1 / F.count(signal).over(w)).otherwise(0.0)


def capped(weight: Column, most: float) -> Column:
    """F-13: clipped from above, not scaled up again."""
    return F.least(weight, F.lit(most))


def fee(value: Column, sell: Column, rate: float = 0.0003, least: float = 5.0, stamp: float = 0.0005, transfer: float = 0.00002) -> Column:
    """X-1: commission with a minimum, stamp duty on sales, transfer fee."""
    return F.greatest(value * rate, F.lit(least)) + F.when(sell, value * stamp).otherwise(0.0) + value * transfer


def slippage(price: Column, quantity: Column, bar_volume: Column, rate: float = 0.001, limit: float = 0.025, impact: float = 0.1) -> Column:
    """X-2: base rate, raised by the excess over the share of the bar's volume."""
    excess = F.greatest(quantity / bar_volume - limit, F.lit(0.0))
    return price * quantity * F.when(bar_volume > 0, rate * (1 + excess * impact)).otherwise(rate)


def fill_reason(side: Column, open_: Column, high: Column, low: Column, volume: Column, previous: Column, limit: float = 0.1, tolerance: float = 0.01) -> Column:
    """X-3: why an order can't fill: 'suspended', 'limit_up', 'limit_down'; 'ok' otherwise."""
    up, down = F.round(previous * (1 + limit), 2), F.round(previous * (1 - limit), 2)
    one = F.abs(high - low) < tolerance
    return F.when(volume <= 0, "suspended").when((side == "BUY") & one & (open_ >= up - tolerance), "limit_up").when((side == "SELL") & one & (open_ <= down + tolerance), "limit_down").otherwise("ok")


def returns(panel: DataFrame, weight: str = "weight", ret: str = "ret", group: list[str] = (), entity: str = "entity_id", time: str = "day", lag: int = 1, cost: float = 0.001) -> DataFrame:
    """B-4: per time (and group) Σ weight(lag) · return − cost · Σ |weight − weight before|."""
    w = Window.partitionBy(*group, entity).orderBy(time)
    held = F.lag(weight, lag, 0.0).over(w) if lag else F.col(weight)
    moved = F.abs(F.col(weight) - F.lag(weight, 1, 0.0).over(w))
    rows = panel.withColumns({"_h": held, "_m": moved})
    return rows.groupBy(*group, time).agg((F.coalesce(F.sum(F.col("_h") * F.col(ret)), F.lit(0.0)) - cost * F.sum("_m")).alias("r"))


def group_returns(panel: DataFrame, group: str, groups: int, weight: str = "w", ret: str = "ret", entity: str = "entity_id", time: str = "day", cost: float = 0.001) -> DataFrame:
    """B-4 for groups 1 to ``groups`` at once: (quantile, time, r) as ``returns`` gives with a row for each bar and group, where an entity has ``weight`` in its own group (NULL: in none) and 0 in the others."""
    w = Window.partitionBy(entity).orderBy(time)
    rows = panel.withColumns({"_g": F.lag(group).over(w), "_w": F.lag(weight).over(w)})
    sums = []
    for k in range(1, groups + 1):
        now, held = (F.coalesce(F.when(F.col(g) == k, F.col(v)), F.lit(0.0)) for g, v in ((group, weight), ("_g", "_w")))
        r = F.coalesce(F.sum(held * F.col(ret)), F.lit(0.0)) - cost * F.sum(F.abs(now - held))
        sums.append(F.struct(F.lit(k).alias("quantile"), r.alias("r")))
    return rows.groupBy(time).agg(F.array(*sums).alias("_all")).select(time, F.explode("_all").alias("_x")).select("_x.quantile", time, "_x.r")


def performance(daily: DataFrame, group: list[str], time: str = "day") -> DataFrame:
    """A-29: final value, total and annual return, Sharpe (0 without deviation), maximum drawdown, win rate."""
    w = Window.partitionBy(*group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    v = daily.withColumn("value", F.exp(F.sum(F.ln(1 + F.col("r"))).over(w))).withColumn("dd", F.col("value") / F.max("value").over(w) - 1)
    span = F.datediff(F.max(time), F.min(time))
    final, sd = F.max_by("value", time), F.stddev_samp("r")
    return v.groupBy(*group).agg(
        final.alias("final_value"),
        ((final - 1) * 100).alias("total_return"),
        F.when(span > 0, (F.pow(final, 365.25 / span) - 1) * 100).alias("annual_return"),
        F.when(sd > 0, F.avg("r") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"),
        (F.min("dd") * 100).alias("max_drawdown"),
        (F.count_if(F.col("r") > 0) / F.count("r") * 100).alias("win_rate"),
    )


def information_coefficient(panel: DataFrame, factor: str, label: str, time: str = "day") -> DataFrame:
    """A-30: per time the Spearman correlation of factor and label, over rows that have both."""
    both = panel.where(F.col(factor).isNotNull() & F.col(label).isNotNull())
    cs = CrossSection(time)
    ranked = both.select(time, cs.average_rank(F.col(factor)).alias("a"), cs.average_rank(F.col(label)).alias("b"))
    return ranked.groupBy(time).agg(correlation(F.col("a"), F.col("b")).alias("ic"))
