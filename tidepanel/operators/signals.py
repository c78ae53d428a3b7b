"""Signals on a panel: runs, changes, gaps, crossings, states (W-22 to W-37, W-40 to W-45)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ts import Series


def run_length(df: DataFrame, sign: Column, s: Series, entity: str = "entity_id", time: str = "day", name: str = "run") -> DataFrame:
    """W-22: signed length of the run of equal signs up to each row, and the run's number."""
    df = df.withColumn("_s", sign).withColumn("_c", F.coalesce((F.col("_s") != s.lag(F.col("_s"))).cast("int"), F.lit(0)))
    df = df.withColumn(f"{name}_id", F.sum("_c").over(s.by))
    length = F.row_number().over(Window.partitionBy(entity, f"{name}_id").orderBy(time))
    return df.withColumn(name, (length * F.col("_s")).cast("long")).drop("_s", "_c")


def changes(df: DataFrame, value: Column, s: Series) -> DataFrame:
    """W-25: rows whose value differs from the one before; each entity's first row stays."""
    first = F.row_number().over(s.by) == 1
    return df.withColumn("_v", value).withColumn("_n", first | ~F.col("_v").eqNullSafe(s.lag(F.col("_v")))).where("_n").drop("_v", "_n")


def fill_gaps(df: DataFrame, value: str, most: int, entity: str = "entity_id", time: str = "day") -> DataFrame:
    """W-26: a row for each calendar day between an entity's first and last; values carried on for at most ``most`` days."""
    days = df.groupBy(entity).agg(F.explode(F.sequence(F.min(time), F.max(time))).alias(time))
    w = Window.partitionBy(entity).orderBy(time).rowsBetween(-most, 0)
    return days.join(df.select(entity, time, value), [entity, time], "left").withColumn(value, F.last(value, True).over(w))


def same_times(df: DataFrame, value: str, entity: str = "entity_id", time: str = "day") -> DataFrame:
    """W-27: every entity gets every time that occurs, NULL where it had none."""
    grid = df.select(time).distinct().withColumn("_j", F.lit(1)).join(df.select(entity).distinct().withColumn("_j", F.lit(1)), "_j").drop("_j")
    return grid.join(df.select(entity, time, value), [entity, time], "left")


def overlap(s: Series, low: Column, high: Column, k: int) -> tuple[Column, Column]:
    """W-23: the range shared by the last k price ranges (touching counts), else (0, 0)."""
    w = s.frame(k)
    lo, hi = F.max(low).over(w), F.min(high).over(w)
    return F.when(lo <= hi, lo).otherwise(0.0), F.when(lo <= hi, hi).otherwise(0.0)


def cross(*averages: Column) -> Column:
    """W-28: each average strictly above the next; false while one is missing."""
    ok = averages[0] > averages[1]
    for a, b in zip(averages[1:], averages[2:], strict=False):
        ok = ok & (a > b)
    return F.coalesce(ok, F.lit(False))


def falls_below(s: Series, close: Column, average: Column, interval: int) -> Column:
    """W-29: false (sell) after ``interval`` bars in a row below the average, else NULL."""
    return F.when(s.all_of(close < average, -(interval - 1), 0), F.lit(False))


def turned(s: Series, close: Column, average: Column, pre: int, interval: int) -> Column:
    """W-30: above the average for ``pre`` bars, then below for the last ``interval``."""
    return s.all_of(close > average, -(pre + interval - 1), -interval) & s.all_of(close < average, -(interval - 1), 0)


def crossover(s: Series, fast: Column, slow: Column) -> Column:
    """W-41: 1 where fast crosses above slow, -1 below, 0 else or where a value is missing."""
    up = (s.lag(fast) <= s.lag(slow)) & (fast > slow)
    down = (s.lag(fast) >= s.lag(slow)) & (fast < slow)
    return F.when(up, 1).when(down, -1).otherwise(0)


def bollinger(s: Series, close: Column, n: int = 20, width: float = 2.0) -> dict[str, Column]:
    """W-36: bands of the population deviation; signal true below the lower, false above the upper."""
    return bands(close, s.mean(close, n), s.std_pop(close, n), width)


def bands(close: Column, mid: Column, sd: Column, width: float = 2.0) -> dict[str, Column]:
    """W-36 from a mean and a population deviation at hand (``ts.long_stats``)."""
    low, up = mid - width * sd, mid + width * sd
    return {"mid": mid, "upper": up, "lower": low, "width": F.try_divide(up - low, mid), "pct_b": F.try_divide(close - low, up - low), "signal": F.when(close < low, True).when(close > up, False)}


def drawdown(value: Column, by) -> Column:
    """W-44."""
    return F.try_divide(value, F.max(value).over(by.rowsBetween(Window.unboundedPreceding, 0))) - 1


def compounded(ret: Column, by) -> Column:
    """W-44: the product of 1 + r so far, for r > -1."""
    return F.exp(F.sum(F.ln(1 + ret)).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def rebase(value: Column, by, scale: float = 1.0) -> Column:
    """W-45: value over the partition's first non-zero value."""
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.try_divide(value * scale, F.first(F.when(value != 0, value), True).over(whole))


def passed_in_window(ok: Column, entity: str, day: Column, days: int, count: int) -> Column:
    """W-40: at least ``count`` passing reports in the last ``days`` days (left-open)."""
    w = Window.partitionBy(entity).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    return F.coalesce(F.count_if(ok).over(w) >= count, F.lit(False))
