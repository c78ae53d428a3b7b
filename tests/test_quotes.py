"""Live quotes: batches run again, pools over a sequence of batches, late and repeated rows, listeners."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tidepanel.streaming import jobs, quotes

DAY = dt.datetime(2024, 1, 1)
TICK = "event_id long, entity_id string, ts timestamp, price double"


def ticks(spark, n=400, days=6, seed=1):
    rng = random.Random(seed)
    rows = [(i, f"e{rng.randrange(9)}", DAY + dt.timedelta(minutes=rng.randrange(days * 1440)), rng.choice([None, 0.0, *(rng.uniform(5, 9) for _ in range(8))])) for i in range(n)]
    return spark.createDataFrame(rows, TICK), rows


def state(sinks):
    return [sorted(map(str, t.read().collect())) for t in (sinks.latest, sinks.minutes, sinks.daily)]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    df, rows = ticks(spark)
    sinks = quotes.QuoteSinks(spark, f"file://{tmp_path}/t")
    edges = [0, 1, 2, 4, 6]
    parts = [df.where((F.col("ts") >= F.lit(DAY + dt.timedelta(days=a))) & (F.col("ts") < F.lit(DAY + dt.timedelta(days=b)))) for a, b in zip(edges, edges[1:])]
    for n, part in enumerate(parts):
        sinks(part, n)
        once = state(sinks)
        sinks(part, n)
        assert state(sinks) == once
    whole = quotes.QuoteSinks(spark, f"file://{tmp_path}/w")
    whole(df, 0)
    assert state(whole) == state(sinks)
    days = {(e, t.date()) for _, e, t, p in rows if p}
    assert sinks.latest.read().count() == len(days)
    now = max(t for _, _, t, p in rows if p)
    assert {(r.entity_id, r.day) for r in sinks.daily.read().collect()} == {(e, d) for e, d in days if dt.datetime(d.year, d.month, d.day, 15) <= now}
    assert all(r["at"] == dt.datetime(r.day.year, r.day.month, r.day.day, 15) for r in sinks.daily.read().collect())


def test_pool_joins_overwrites_and_is_deleted(spark, tmp_path):
    pools, want = quotes.Pools(spark, f"file://{tmp_path}/p", most=4), []
    batches = [["a", "b", "c"], [], ["c", "d", "e", "f", "g"], ["x"], ["y", "x"]]
    for n, names in enumerate(batches):
        found = spark.createDataFrame([(x, float(10 - i)) for i, x in enumerate(names)], "entity_id string, change double")
        for _ in range(2):
            pools.refresh(found, n, "one")
        cut = names[:4]
        want = want if not cut else cut if len(want) > 4 else sorted(set(want) | set(cut))
        assert sorted(r.entity_id for r in pools.members().collect()) == sorted(want)
    pools.refresh(spark.createDataFrame([("k", 1.0)], "entity_id string, change double"), 5, "two")
    pools.delete("one", 6)
    assert [tuple(r) for r in pools.members().collect()] == [("two", "k")]
    pools.refresh(spark.createDataFrame([("z", 1.0)], "entity_id string, change double"), 7, "one")
    assert sorted(map(tuple, pools.members().where("entity_id is not null").collect())) == [("one", "z"), ("two", "k")]


def test_ema_forgets_a_silent_entity_and_goes_on_after_a_stop(spark, tmp_path):
    rows = [(1, "a", DAY, 4.0), (2, "b", DAY, 1.0), (3, "a", DAY + dt.timedelta(days=1), 8.0), (4, "a", DAY + dt.timedelta(days=9), 6.0), (5, "a", DAY + dt.timedelta(days=9), 2.0), (6, "b", DAY + dt.timedelta(days=11), 5.0)]
    own, out = quotes.with_rocksdb(spark), f"{tmp_path}/out"
    run = lambda stream: jobs.run_once(quotes.running_ema(stream, n=3, idle=5), out, f"{tmp_path}/c")
    quotes.replay(own.createDataFrame(rows, TICK), "ts", f"{tmp_path}/in", 12, run)
    got = {r.event_id: r.ema for r in spark.read.parquet(out).collect()}
    assert got == {1: 4.0, 2: 1.0, 3: 6.0, 4: 6.0, 5: 4.0, 6: 5.0}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_listener_and_changed_entities(spark, tmp_path):
    df, rows = ticks(spark, 60, 3)
    calls, ends, changed = [], [], {}
    listener = quotes.Progress(lambda name, batch, n: calls.append((batch, n)), lambda name, error: ends.append(error))
    spark.streams.addListener(listener)
    try:
        quotes.replay(df, "ts", f"{tmp_path}/in", 3, lambda s: quotes.changed_entities(s, lambda e, b: changed.update({b: {r.entity_id: r.n for r in e.collect()}}), f"{tmp_path}/c"))
        for _ in range(100):
            if len(ends) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    per_day = [sum(1 for r in rows if (r[2] - DAY).days == d) for d in range(3)]
    assert calls == list(enumerate(per_day)) and ends == [None] * 3
    assert [sum(v.values()) for _, v in sorted(changed.items())] == per_day


def test_repeated_events_join_once(spark, tmp_path):
    df, rows = ticks(spark, 50, 4)
    static = spark.createDataFrame([("e1", "x"), ("e2", "y")], "entity_id string, segment string")
    quotes.replay(df.union(df), "ts", f"{tmp_path}/in", 4, lambda s: jobs.run_once(quotes.with_attributes(s, static), f"{tmp_path}/out", f"{tmp_path}/c"))
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(i for i, e, _, _ in rows if e in ("e1", "e2"))
