"""Means, deviations and extremes of the last n bars, held against a plain walk."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import signals as sg
from tidepanel.operators import ts

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("n", [1, 3, 4, 7, 20])
def test_equal_to_a_walk_over_the_bars(spark, n):
    r = random.Random(n)
    rows = [(e, DAY + dt.timedelta(i), r.choice([None, *range(40)]) if e == "gaps" else r.uniform(1, 9)) for e in ("gaps", "full", "short") for i in range(2 if e == "short" else 90)]
    rows = [(e, d, None if x is None else float(x)) for e, d, x in rows]
    got = ts.long_stats(spark.createDataFrame(rows, "entity_id string, day date, x double"), n, ("x",), ("x",), ("x",)).collect()
    assert len(got) == len(rows)
    at = {(g.entity_id, g.day): (g.x_mean, g.x_dev, g.x_top, g.x_bottom) for g in got}
    for e in ("gaps", "full", "short"):
        own = [x for x in rows if x[0] == e]
        for i, (_, d, _) in enumerate(own):
            last = [x[2] for x in own[max(0, i - n + 1) : i + 1]]
            if len(last) < n or None in last:
                assert at[e, d] == (None,) * 4
            else:
                assert at[e, d] == pytest.approx((statistics.fmean(last), statistics.pstdev(last), max(last), min(last)), abs=1e-12)


def test_prices_that_do_not_vary_give_no_signal(spark):
    bars = spark.range(30).select(F.lit("a").alias("entity_id"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"), F.lit(0.1).alias("close"))
    rows = ts.long_stats(bars, 20, ("close",))
    b = sg.bands(F.col("close"), F.col("close_mean"), F.col("close_dev"))
    assert {(r.mid, r.s) for r in rows.where("close_mean IS NOT NULL").select(b["mid"].alias("mid"), b["signal"].alias("s")).collect()} == {(0.1, None)}
