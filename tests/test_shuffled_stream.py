"""The streamed queries over several part files that are not in the order of time."""

import duckdb
import pytest

from tidepanel import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["tick_bars_streamed", "stateful_ema_streamed"])
def test_no_row_is_late(spark, tmp_path, name):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").toPandas()
    (tmp_path / "events.parquet").mkdir()
    for k in (3, 0, 4, 1, 2):
        part = spark.createDataFrame(events[k * len(events) // 5 : (k + 1) * len(events) // 5])
        part.withColumn("ts", part.ts.cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    want = duckdb.sql(registry.oracle_sql()[name].replace("FROM events", f"FROM '{SF}/events.parquet'")).fetchall()
    assert len(got) == len(want)
    if name == "tick_bars_streamed":
        assert got == set(want)
    else:
        assert {(e, i): pytest.approx(v, abs=2e-4) for e, i, v in want} == {(e, i): v for e, i, v in got}
