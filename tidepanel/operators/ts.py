"""Rolling operators of one entity's series (W-1 to W-8, W-15 to W-20): columns over a window by entity, ordered by time.

A result is NULL until its frame holds n non-null values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def correlation(x: Column, y: Column, over: WindowSpec | None = None) -> Column:
    """Pearson's, over rows that have both; NULL where one of them does not vary (``F.corr`` divides by zero there)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    both, sx, sy = (p.over(over) for p in parts) if over is not None else parts
    return F.try_divide(both, sx * sy)


class Series:
    """Columns over one panel; all share one window specification, so Spark sorts once."""

    def __init__(self, entity: str = "entity_id", time: str = "day"):
        self.entity, self.time = entity, time

    @property
    def by(self):
        return Window.partitionBy(self.entity).orderBy(self.time)

    def frame(self, n: int):
        return self.by.rowsBetween(-(n - 1), 0)

    def full(self, x: Column, n: int, value: Column) -> Column:
        return F.when(F.count(x).over(self.frame(n)) == n, value)

    def lag(self, x: Column, n: int = 1) -> Column:
        return F.lag(x, n).over(self.by)

    def lead(self, x: Column, n: int = 1) -> Column:
        return F.lead(x, n).over(self.by)

    def mean(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.avg(x).over(self.frame(n)))

    def sum(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.sum(x).over(self.frame(n)))

    def std(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.stddev_samp(x).over(self.frame(n)))

    def std_pop(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.stddev_pop(x).over(self.frame(n)))

    def max(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.max(x).over(self.frame(n)))

    def min(self, x: Column, n: int) -> Column:
        return self.full(x, n, F.min(x).over(self.frame(n)))

    def values(self, x: Column, n: int) -> Column:
        return F.collect_list(x).over(self.frame(n))

    def apply(self, x: Column, n: int, f: Callable[[Column], Column]) -> Column:
        """Any function of the frame's array (U-6)."""
        return self.full(x, n, f(self.values(x, n)))

    def rank(self, x: Column, n: int) -> Column:
        """Average-tie rank of the last value in its frame, over n."""
        below = lambda a: F.size(F.filter(a, lambda v: v < x))
        same = lambda a: F.size(F.filter(a, lambda v: v == x))
        return self.apply(x, n, lambda a: (below(a) + (same(a) + 1) / 2) / n)

    def decay_linear(self, x: Column, n: int) -> Column:
        """Weights 1 to n, the newest heaviest."""
        weighed = lambda a: F.aggregate(F.transform(a, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
        return self.apply(x, n, lambda a: weighed(a) / (n * (n + 1) / 2))

    def argmax(self, x: Column, n: int) -> Column:
        """Bars since the largest value; of equal ones the earliest."""
        return self.apply(x, n, lambda a: (n - F.array_position(a, F.array_max(a))).cast("long"))

    def argmin(self, x: Column, n: int) -> Column:
        return self.apply(x, n, lambda a: (n - F.array_position(a, F.array_min(a))).cast("long"))

    def delta(self, x: Column, n: int) -> Column:
        return x - self.lag(x, n)

    def corr(self, x: Column, y: Column, n: int) -> Column:
        return self.full(x, n, correlation(x, y, self.frame(n)))

    def pct_change(self, x: Column, n: int = 1) -> Column:
        return F.try_divide(x, self.lag(x, n)) - 1

    def all_of(self, x: Column, first: int, last: int) -> Column:
        """True if x holds on every one of the rows first to last (relative), all present."""
        w = self.by.rowsBetween(first, last)
        return F.coalesce(F.every(x).over(w), F.lit(False)) & (F.count(x).over(w) == last - first + 1)


def long_means(df: DataFrame, wanted: dict[str, tuple[str, int]], entity: str = "entity_id", time: str = "day") -> DataFrame:
    """Columns ``name: (value, n)`` with the mean of the last n bars, NULL unless all n have a value, at a cost a bar that grows with log n.

    Spark's sliding frames add up all n bars for each bar. Here sums of 1, 2, 4, ... bars are
    each the sum of two of the ones before, and n bars are the sum of one of each binary digit
    of n; nothing is subtracted, so sums are as exact as those of a frame.
    """
    by = Window.partitionBy(entity).orderBy(time)
    values = sorted({v for v, _ in wanted.values()})
    most = {v: max(n for x, n in wanted.values() if x == v) for v in values}
    rows = df.select("*", *(F.coalesce(F.col(v), F.lit(0.0)).alias(f"_{v}_1") for v in values), *(F.count(v).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_{v}_n") for v in values))
    size = 1
    while 2 * size <= max(most.values()):
        rows = rows.select("*", *((F.col(f"_{v}_{size}") + F.lag(f"_{v}_{size}", size, 0.0).over(by)).alias(f"_{v}_{2 * size}") for v in values if 2 * size <= most[v]))
        size *= 2
    out = []
    for name, (v, n) in wanted.items():
        total, past = None, 0
        for bit in reversed(range(n.bit_length())):
            if n >> bit & 1:
                part = F.lag(f"_{v}_{1 << bit}", past, 0.0).over(by) if past else F.col(f"_{v}_{1 << bit}")
                total, past = part if total is None else total + part, past + (1 << bit)
        held = F.col(f"_{v}_n") - F.lag(f"_{v}_n", n, 0).over(by)
        out.append(F.when(held == n, total / n).alias(name))
    return rows.select(*df.columns, *out)


def long_stats(df: DataFrame, n: int, moments: tuple[str, ...] = (), tops: tuple[str, ...] = (), bottoms: tuple[str, ...] = (), entity: str = "entity_id", time: str = "day") -> DataFrame:
    """Columns ``<value>_mean`` and ``<value>_dev`` (population), ``<value>_top`` and ``<value>_bottom`` over the last n bars, NULL unless all n have a value, at a cost a bar that grows with log n.

    As in ``long_means``, but by fours: values over 4, 16, 64, ... bars are merged from four blocks of a quarter of that.
    Means and squared differences from them are merged pairwise, so bars that do not vary have their own value as mean and 0 as deviation.
    """
    by = Window.partitionBy(entity).orderBy(time)
    ends = {**{f"{v}_top": (v, F.greatest) for v in tops}, **{f"{v}_bottom": (v, F.least) for v in bottoms}}

    def merged(parts: list[tuple[str, int]], v: str) -> tuple[Column, Column]:
        (name, m), *rest = parts
        mean, squares = F.col(f"{name}_{v}_mean"), F.col(f"{name}_{v}_squares")
        for name, k in rest:
            apart = F.col(f"{name}_{v}_mean") - mean
            squares = squares + F.col(f"{name}_{v}_squares") + apart * apart * (m * k / (m + k))
            mean, m = mean + apart * (k / (m + k)), m + k
        return mean, squares

    def outermost(parts: list[str], c: str) -> Column:
        every = [F.col(f"{p}_{c}") for p in parts]  # greatest and least pass over NULLs
        return every[0] if len(every) == 1 else F.when(reduce(and_, (x.isNotNull() for x in every)), ends[c][1](*every))

    def lagged(rows: DataFrame, block: str, bars: set[int], names: list[str]) -> DataFrame:
        return rows.select("*", *(F.lag(f"{block}_{c}", b).over(by).alias(f"{block}_{b}_{c}") for b in sorted(bars) for c in names))

    at = lambda block, bars: f"{block}_{bars}" if bars else block
    sums = [f"{v}_{c}" for v in moments for c in ("mean", "squares")]
    every = [*sums, *ends]
    first = [*(F.col(v).cast("double").alias(f"_1_{v}_mean") for v in moments), *((F.col(v) * 0.0).alias(f"_1_{v}_squares") for v in moments), *(F.col(v).alias(f"_1_{c}") for c, (v, _) in ends.items())]
    rows, size, kept = df.select("*", *first), 1, []
    while 4 * size <= n:
        b, four = f"_{size}", [at(f"_{size}", k * size) for k in range(4)]
        rows = lagged(rows, b, {size, 2 * size, 3 * size}, every)
        kept += [f"{b}_{c}" for c in sums] if n // size % 4 else []
        up = [x.alias(f"_{4 * size}_{v}_{c}") for v in moments for c, x in zip(("mean", "squares"), merged([(p, size) for p in four], v), strict=True)]
        rows = rows.select(*df.columns, *kept, *up, *(outermost(four, c).alias(f"_{4 * size}_{c}") for c in ends))
        size *= 4
    parts, past, k = [], 0, size
    while k:  # blocks of the digits of n to base 4, the largest first
        for _ in range(n // k % 4):
            parts.append((f"_{k}", past, k))
            past += k
        k //= 4
    # the largest and smallest values may be taken from blocks that overlap
    cover = [*range(0, n - size, size), n - size] if n > size else [0]
    for block in {p[0] for p in parts}:
        rows = lagged(rows, block, {b for p, b, _ in parts if p == block and b}, sums)
    rows = lagged(rows, f"_{size}", {b for b in cover if b}, list(ends))
    out = []
    for v in moments:
        mean, squares = merged([(at(p, b), m) for p, b, m in parts], v)
        out += [mean.alias(f"{v}_mean"), F.sqrt(squares / n).alias(f"{v}_dev")]
    return rows.select(*df.columns, *out, *(outermost([at(f"_{size}", b) for b in cover], c).alias(c) for c in ends))


# Indicators: values are columns of the panel.


def momentum(s: Series, price: Column, n: int) -> Column:
    """W-15: price over the price n bars before, less one."""
    return s.pct_change(price, n)


def with_returns(df: DataFrame, s: Series, price: Column, name: str = "ret") -> DataFrame:
    return df.withColumn(name, s.pct_change(price))


def momentum_return(s: Series, ret: Column, n: int) -> Column:
    """W-16: mean of the last n one-bar returns."""
    return s.mean(ret, n)


def volatility(s: Series, ret: Column, n: int) -> Column:
    """W-17: sample deviation of the last n one-bar returns."""
    return s.std(ret, n)


def risk_adjusted_momentum(mean: Column, deviation: Column) -> Column:
    """W-18: W-16 over W-17; a deviation of 0 counts as 1e-6."""
    return F.try_divide(mean, F.when(deviation == 0, 1e-6).otherwise(deviation))


def ema(df: DataFrame, spans: dict[str, tuple[str, int]], entity: str = "entity_id", time: str = "day", skip: int = 0, length: int = 64) -> DataFrame:
    """Columns ``name: (value, span)`` with the EMA that starts at each entity's first value after ``skip`` bars; bars before it have NULL.

    A bar's step e -> (1 - a) e + a x is an affine map. Their products over chunks of ``length``
    bars are window sums; a chunk starts from the ends of the chunks before, as many as still
    count in a double (under 1e-18 of the value is left out). Values must not be NULL.
    """
    i, at, chunk, inner = F.col("_i"), F.col("_at"), Window.partitionBy(entity, "_chunk").orderBy(time), {}
    rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(entity).orderBy(time)) - 1 - skip)
    rows = rows.withColumns({"_chunk": F.floor(i / length), "_at": F.pmod(i, F.lit(length))})
    for name, (value, span) in spans.items():
        a = 2.0 / (span + 1)
        weight = F.when(i < 0, 0.0).when(i == 0, 1.0).otherwise(a)
        total = F.sum(weight * F.when(i >= 0, F.col(value)).otherwise(0.0) * F.pow(F.lit(1 - a), -at)).over(chunk)
        inner[name] = total * F.pow(F.lit(1 - a), at)
    rows = rows.withColumns(inner)
    ends = rows.groupBy(entity, "_chunk").agg(*(F.max_by(n, "_at").alias(n) for n in spans))
    order, before = Window.partitionBy(entity).orderBy("_chunk"), []
    for name, (_, span) in spans.items():
        left = (1 - 2.0 / (span + 1)) ** length
        reach = max(1, math.ceil(math.log(1e-18) / math.log(left)))
        before.append(sum((F.coalesce(F.lag(name, k + 1).over(order), F.lit(0.0)) * left**k for k in range(reach)), F.lit(0.0)).alias(f"_{name}"))
    whole = rows.join(ends.select(entity, "_chunk", *before), [entity, "_chunk"])
    done = {n: F.when(i >= 0, F.col(n) + F.col(f"_{n}") * F.pow(F.lit(1 - 2.0 / (span + 1)), at + 1)) for n, (_, span) in spans.items()}
    return whole.withColumns(done).drop("_i", "_chunk", "_at", *(f"_{n}" for n in spans))


def macd(df: DataFrame, price: str = "close", entity: str = "entity_id", time: str = "day", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """W-20 and W-35 inputs: diff, dea, macd, live (+1 or -1), bull and the signed run length of live.

    diff and dea are NULL for the first slow - 1 bars (dea then starts at the first
    diff), where live is -1 and bull is false. Bars without a price are dropped first.
    """
    by = Window.partitionBy(entity).orderBy(time)
    rows = ema(df.where(F.col(price).isNotNull()).select(entity, time, price), {"_fast": (price, fast), "_slow": (price, slow)}, entity, time)
    rows = rows.withColumn("diff", F.when(F.row_number().over(by) >= slow, F.col("_fast") - F.col("_slow")))
    rows = ema(rows.select(entity, time, "diff"), {"dea": ("diff", signal)}, entity, time, skip=slow - 1)
    diff, dea = F.col("diff"), F.col("dea")
    rows = rows.withColumn("live", F.when(diff > dea, 1).otherwise(-1)).withColumn("_n", F.row_number().over(by))
    turns = F.when(F.coalesce(F.lag("live").over(by), F.lit(0)) != F.col("live"), F.col("_n"))
    rows = rows.withColumn("_turn", turns).withColumn("_run", F.col("_n") - F.max("_turn").over(by) + 1)
    bull = F.coalesce((diff > 0) & (dea > 0), F.lit(False))
    return rows.select(entity, time, "diff", "dea", ((diff - dea) * 2).alias("macd"), "live", bull.alias("bull"), (F.col("_run") * F.col("live")).cast("int").alias("live_count"))
