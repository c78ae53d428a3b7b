"""The last five zones of each bar, found while the bars are folded, against the windows over the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from tidepanel import registry
from tidepanel.operators import strokes


def moving(seed, n):
    """Bars whose level moves on every 60 bars or so, so that zones apart from each other are left behind."""
    rng, x, to, out = random.Random(seed), 50.0, 50.0, []
    for _ in range(n):
        if rng.random() < 1 / 60:
            to = rng.choice([5.0, 15.0, 40.0, 41.0, 90.0, 200.0])
        x = max(2.0, x + (to - x) * 0.2 + rng.gauss(0, 0.05 * x))
        out.append((x * (1 + 0.02 * rng.random()), x * (1 - 0.02 * rng.random()), x))
    return out


@pytest.mark.parametrize("batch", [1, 10_000])
def test_zones_in_one_pass_equal_the_windows(spark, batch):
    rows = [(f"e{k}", i, *b) for k, n in enumerate([2500, 1800, 9, 3000, 15]) for i, b in enumerate(moving(k, n))]
    bars = spark.createDataFrame(rows, "entity_id string, i int, high double, low double, close double")
    bars = bars.withColumn("day", F.date_add(F.lit("1990-01-01").cast("date"), F.col("i"))).repartition(2, "entity_id")
    got = strokes.zones_in_one_pass(bars, batch)
    want = strokes.last_zones(strokes.one_pass(bars))
    assert got.dtypes == want.dtypes
    got, want = (sorted(map(tuple, d.collect()), key=str) for d in (got, want))
    assert got == want
    assert len({r[2] for r in got}) > 20


def test_only_lines_are_shuffled(spark):
    df = registry.queries()["zen_states"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and df.count() > 0
