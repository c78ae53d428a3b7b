"""Operators against pandas and hand-made edge rows."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.functions import expr as ex
from tidepanel.operators import portfolio as pf
from tidepanel.operators import signals as sg
from tidepanel.operators import ts
from tidepanel.operators.cs import CrossSection
from tidepanel.operators.ts import Series
from tidepanel.plans.joins import as_of
from tidepanel.sources import lake

DAY = dt.date(2024, 1, 1)


def panel(spark, values, entity="a"):
    return spark.createDataFrame([(entity, DAY + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], "entity_id string, day date, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("day").collect()]


def test_rolling_with_missing_values(spark):
    x = [1, 5, 2, 8, 3, None, 4, 4, 9, 2, 2, None, 7]
    s = pd.Series(x, dtype=float)
    df, w = panel(spark, x), Series()
    got = column(df.withColumn("y", w.mean(F.col("x"), 3)), "y")
    want = s.rolling(3).mean()
    assert all((g is None and np.isnan(v)) or abs(g - v) < 1e-12 for g, v in zip(got, want, strict=True))
    got = column(df.withColumn("y", w.rank(F.col("x"), 3)), "y")
    want = s.rolling(3).apply(lambda a: pd.Series(a).rank().iloc[-1] / 3)
    assert all((g is None and np.isnan(v)) or abs(g - v) < 1e-12 for g, v in zip(got, want, strict=True))


def test_runs_and_changes(spark):
    df = panel(spark, [1, 1, -1, -1, -1, 1])
    assert column(sg.run_length(df, F.col("x").cast("int"), Series()), "run") == [1, 2, -1, -2, -3, 1]
    both = panel(spark, [1, 2, 2]).union(panel(spark, [2, 2, 3], "b"))
    assert sorted((r.entity_id, r.x) for r in sg.changes(both, F.col("x"), Series()).collect()) == [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 3.0)]


def test_fill_gaps_stops(spark):
    df = panel(spark, [1, None, None, None, 2, None, None, None, None, 3]).where("x is not null")
    assert column(sg.fill_gaps(df, "x", 2), "x") == [1.0, 1.0, 1.0, None, 2.0, 2.0, 2.0, None, None, 3.0]


def test_quantile_labels_with_repeated_edges(spark):
    df = spark.createDataFrame([(DAY, float(v)) for v in (1, 1, 1, 1, 2, 3)], "day date, x double")
    assert {r.q for r in df.select(CrossSection().quantile_label(F.col("x"), 5).alias("q")).collect()} == {None}


def test_macd_equals_pandas(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=80)) + 50
    got = ts.macd(panel(spark, x).withColumnRenamed("x", "close")).orderBy("day").toPandas()
    ema = lambda v, n: pd.Series(v).ewm(span=n, adjust=False, min_periods=n).mean()
    diff = ema(x, 12) - ema(x, 26)
    assert np.allclose(got["diff"], diff, equal_nan=True) and (got["live"][:25] == -1).all() and not got["bull"][:25].any()


def test_costs_and_fills(spark):
    df = spark.createDataFrame([("BUY", 1000.0, 11.0, 11.0, 11.0, 5.0, 10.0), ("SELL", 1e6, 9.0, 9.0, 9.0, 5.0, 10.0), ("BUY", 1e6, 10.5, 10.7, 10.1, 5.0, 10.0), ("BUY", 1.0, 1.0, 1.0, 1.0, 0.0, 1.0)], "side string, v double, o double, h double, l double, vol double, prev double")
    c = F.col
    got = df.select(pf.fee(c("v"), c("side") == "SELL").alias("fee"), pf.fill_reason(c("side"), c("o"), c("h"), c("l"), c("vol"), c("prev")).alias("r")).collect()
    assert [r.r for r in got] == ["limit_up", "limit_down", "ok", "suspended"]
    assert abs(got[0].fee - 5.02) < 1e-9 and abs(got[1].fee - 820) < 1e-6


def test_number_text_and_ranges(spark):
    df = spark.createDataFrame([("1,234.5万",), ("3亿",), ("2万亿",), ("12%",), ("--",), ("不变",), ("x",), (None,), ("7",)], "t string")
    assert [r.v for r in df.select(ex.to_float(F.col("t")).alias("v")).collect()] == [12345000.0, 3e8, 2e12, 0.12, None, None, None, None, 7.0]
    one, two = (F.lit(1.0), F.lit(2.0)), (F.lit(2.0), F.lit(3.0))
    r = spark.range(1).select(ex.intersect(one, two)[0].alias("i"), ex.combine(one, two)[1].alias("c"), ex.distance(one, (F.lit(5.0), F.lit(6.0))).alias("d"), ex.distance((F.lit(5.0), F.lit(6.0)), one).alias("e")).first()
    assert tuple(r) == (2.0, 3.0, 3.0, -3.0)


def test_as_of_and_upsert(spark):
    left = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("b", 5, "r")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 9, 3.0)], "k string, t int, y double")
    assert sorted(map(tuple, as_of(left, right, "k", "t", ["y"]).collect())) == [("a", 1, "p", None), ("a", 5, "q", 2.0), ("b", 5, "r", None)]
    old = spark.createDataFrame([("1", 1, "o")], "id string, seq int, v string")
    new = spark.createDataFrame([("1", 2, "n"), ("2", 3, "x"), ("2", 4, "y")], "id string, seq int, v string")
    assert sorted(map(tuple, lake.upsert(old, new).collect())) == [("1", 1, "o"), ("2", 4, "y")]
    assert sorted(map(tuple, lake.upsert(old, new, replace=True).collect())) == [("1", 2, "n"), ("2", 4, "y")]


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([(DAY, 0.5), (DAY, None), (DAY, 0.1)], "day date, x double")
    w = [r.w for r in df.select(pf.equal_weights(F.col("x")).alias("w")).collect()]
    assert sorted(w) == [0.0, 0.5, 0.5]
