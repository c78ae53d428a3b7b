"""Strokes folded and put onto their bars in one task, against the walk and the table made of rows."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_strokes import CASES, compare, days

from tidepanel import registry
from tidepanel.operators import strokes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("batch", [1, 10_000])
def test_one_pass_equals_the_walk_and_the_rows(spark, tmp_path, batch):
    bars = days(spark).drop("i").union(spark.sql("select null, 1D, 1D, 1D, date'2000-01-01' union all select 'walk_0', 1D, 1D, 1D, null union all select 'walk_0', null, 1D, 1D, date'1999-01-01'"))
    table = strokes.one_pass(bars.repartition(3, "entity_id"), bars_a_batch=batch)
    compare(table)
    rows = strokes.wide(strokes.in_chunks(bars, f"file://{tmp_path}/z", ["2000-03-01", "2001-01-01"]), bars)
    assert table.dtypes == rows.dtypes and listed(table) == listed(rows)
    few = ["entity_id", "day", "close", "segment_state", "stroke_zone_from", "current_merged_level"]
    part = strokes.one_pass(bars.repartition(3, "entity_id"), few, bars_a_batch=batch)
    assert set(part.columns) == set(few) and listed(part.select(few)) == listed(rows.select(few))


@pytest.mark.parametrize("name", ["zen_factor", "shaking_factor"])
def test_only_lines_are_shuffled_and_nothing_is_stored(spark, monkeypatch, name):
    from tidepanel.plans import tables

    monkeypatch.setattr(tables, "_scratch", lambda *_: pytest.fail("stored"))
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert plan(df).count("Exchange") == 1 and df.count() > 0


def test_rounded_in_the_task_as_spark_rounds(spark):
    rng = random.Random(7)
    x = [k / 64 / 10**e * s for k in range(1, 200) for e in range(5) for s in (1, -1)] + [rng.gauss(0, 10**e) for e in range(-9, 19) for _ in range(40)]
    x += [0.0, -0.0, 1.0000005, 2.5e-7, 5e-7, -5e-7, 4.9999999e-7, 1e5 / 32, 123456.7890125, float("nan"), float("inf"), -float("inf"), None, 1e300]
    got = strokes._rounded(pa.array(x, pa.float64()), 6).to_pylist()
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert all(a is b is None or a == b or math.isnan(a) and math.isnan(b) for a, b in zip(got, want, strict=True))
