"""Cross-section operators (W-9 to W-14, W-21, W-39, K-1): columns over all entities of one time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CrossSection:
    def __init__(self, time: str = "day"):
        self.time = time

    @property
    def over(self):
        return Window.partitionBy(self.time)

    def average_rank(self, x: Column, descending: bool = False) -> Column:
        """Rank with ties at their mean; NULL stays NULL."""
        order = x.desc_nulls_last() if descending else x.asc_nulls_last()
        ties = F.count(x).over(self.over.orderBy(order).rangeBetween(Window.currentRow, Window.currentRow))  # the row's equals
        return F.when(x.isNotNull(), F.rank().over(self.over.orderBy(order)) + (ties - 1) / 2)

    def rank(self, x: Column) -> Column:
        return F.try_divide(self.average_rank(x), F.count(x).over(self.over))

    def zscore(self, x: Column) -> Column:
        return F.try_divide(x - F.avg(x).over(self.over), F.stddev_samp(x).over(self.over))

    def demean(self, x: Column) -> Column:
        return x - F.avg(x).over(self.over)

    def norm(self, x: Column) -> Column:
        low = F.min(x).over(self.over)
        return F.try_divide(x - low, F.max(x).over(self.over) - low)

    def winsorize(self, x: Column, lower: float, upper: float) -> Column:
        """Clipped to linear-interpolated quantiles."""
        edge = [F.percentile(x, F.lit(p)).over(self.over) for p in (lower, upper)]
        return F.when(x.isNotNull(), F.greatest(edge[0], F.least(edge[1], x)))

    def neutralize(self, x: Column, cap: Column) -> Column:
        """x less its cap-weighted mean; a missing x keeps its cap in the weights."""
        return x - F.try_divide(F.sum(x * cap).over(self.over), F.sum(cap).over(self.over))

    def standardize(self, x: Column) -> Column:
        """W-14: as zscore, but a constant cross-section stays as it is."""
        sd = F.stddev_samp(x).over(self.over)
        return F.when(sd == 0, x).otherwise(F.try_divide(x - F.avg(x).over(self.over), sd))

    def fill_mean(self, x: Column) -> Column:
        return F.coalesce(x, F.avg(x).over(self.over))

    def quantile_label(self, x: Column, groups: int) -> Column:
        """1 to groups by linear quantile edges, right-closed; NULL for the whole time where edges repeat."""
        edges = F.percentile(x, F.array(*(F.lit(i / groups) for i in range(groups + 1)))).over(self.over)
        inner = F.slice(edges, 1, groups)
        label = F.greatest(F.lit(1), F.size(F.filter(inner, lambda b: b < x)))
        return F.when(x.isNotNull() & (F.size(F.array_distinct(edges)) == groups + 1), label)

    def with_quantile_label(self, df: DataFrame, x: str, groups: int, name: str) -> DataFrame:
        """``quantile_label`` as a column; only the values travel to the edges of their time, and the edges come back, one row a time."""
        at = F.array(*(F.lit(i / groups) for i in range(groups + 1)))
        edges = df.select(self.time, x).groupBy(self.time).agg(F.percentile(x, at).alias("_edges"))
        inner = F.slice("_edges", 1, groups)
        label = F.greatest(F.lit(1), F.size(F.filter(inner, lambda b: b < F.col(x))))
        labelled = F.when(F.col(x).isNotNull() & (F.size(F.array_distinct("_edges")) == groups + 1), label)
        return df.join(F.broadcast(edges), self.time, "left").withColumn(name, labelled).drop("_edges")

    def quantile_score(self, x: Column, levels: list[float]) -> Column:
        """W-39: the highest level whose quantile is at most x; 0 below the lowest."""
        edges = F.percentile(x, F.array(*map(F.lit, levels))).over(self.over)
        got = F.filter(F.arrays_zip(edges.alias("e"), F.array(*map(F.lit, levels)).alias("l")), lambda p: p.e <= x)
        return F.when(x.isNotNull(), F.coalesce(F.array_max(F.transform(got, lambda p: p.l)), F.lit(0.0)))
