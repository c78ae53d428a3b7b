"""Live quotes as Structured Streaming jobs: replays with a stop between batches, three keyed sinks of one batch, maintained pools, a deduplicated stream joined to static rows, listeners.

A sink's table is a folder of versions, one a batch; a batch writes only the
partitions it touches and reads only versions of earlier batches, so a batch that
runs again after a failure writes the same. One writer a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from .jobs import run_once

C = F.col


def replay(rows: DataFrame, time: str, path: str, slices: int, run: Callable[[DataFrame], None]) -> None:
    """Feed ``rows`` to a job in ``slices`` runs of whole days, each a new start from the checkpoint: a slice is written, then ``run`` gets the stream of all files and ends when it has read what is new."""
    first, last = rows.agg(F.min(C(time).cast("date")), F.max(C(time).cast("date"))).first()
    if first is None:
        return
    days = -(-((last - first).days + 1) // slices)
    for n in range(slices):
        lo, hi = (first + timedelta(days=days * k) for k in (n, n + 1))
        part = rows.where((C(time) >= F.lit(lo).cast("timestamp")) & (C(time) < F.lit(hi).cast("timestamp")))
        part.write.mode("append").parquet(path)
        run(rows.sparkSession.readStream.schema(rows.schema).parquet(path))


class Versions:
    """A table of one version a batch and partition."""

    def __init__(self, spark: SparkSession, path: str, schema: str, part: str):
        self.spark, self.path, self.schema, self.part = spark, path, schema, part

    def read(self, before: int | None = None) -> DataFrame:
        """The last version of each partition, of batches before ``before``."""
        there = self.spark.createDataFrame([], f"{self.schema}, batch int") if not self._exists() else self.spark.read.schema(f"{self.schema}, batch int").parquet(self.path)
        there = there if before is None else there.where(C("batch") < before)
        last = there.groupBy(self.part).agg(F.max("batch").alias("batch"))
        return there.join(last, [self.part, "batch"], "left_semi").drop("batch")

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.repartition(self.part).write.mode("overwrite").partitionBy(self.part).parquet(f"{self.path}/batch={batch}")


_BAR = "entity_id string, at timestamp, open double, high double, low double, close double, n long, first struct<ts: timestamp, event_id: long>, last struct<ts: timestamp, event_id: long>, day date"


def _merged(bars: DataFrame, *keys: str) -> DataFrame:
    """Bars of parts put together: the earliest open, the latest close."""
    return bars.groupBy(*keys).agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )


class QuoteSinks:
    """ST-2: of each batch the latest quote of an entity and day, bars of an entity and minute, and the daily bar, set to the session's end, once the session is over."""

    def __init__(self, spark: SparkSession, path: str, session_end: str = "15 hours"):
        self.end = F.expr(f"INTERVAL {session_end}")
        self.latest, self.minutes, self.daily = (Versions(spark, f"{path}/{n}", _BAR, "day") for n in ("latest", "minutes", "daily"))

    def __call__(self, ticks: DataFrame, batch: int) -> None:
        k = F.struct("ts", "event_id")
        one = ticks.where("price is not null and price <> 0").select("entity_id", C("ts").cast("date").alias("day"), F.date_trunc("minute", "ts").alias("at"), *(C("price").alias(c) for c in ("open", "high", "low", "close")), F.lit(1).cast("long").alias("n"), k.alias("first"), k.alias("last"))
        new = _merged(one, "entity_id", "day", "at").persist()
        days = new.select("day").distinct()
        old = self.minutes.read(batch).join(days, "day", "left_semi")
        columns = [c.split()[0] for c in _BAR.split(", ") if not c.endswith("long>")]
        columns = [c for c in columns if c != "day"] + ["day"]
        minutes = _merged(old.select(new.columns).unionByName(new), "entity_id", "day", "at").select(columns).persist()
        self.minutes.write(minutes, batch)
        whole = _merged(minutes.drop("at"), "entity_id", "day").withColumn("at", C("day").cast("timestamp"))
        self.latest.write(whole.select(columns), batch)
        # days that are over and were touched, or were not over when they were last written
        stored = self.minutes.read(batch + 1)
        now = stored.agg(F.max("last.ts").alias("now"))
        over = stored.select("day").distinct().join(F.broadcast(now), C("day").cast("timestamp") + self.end <= C("now")).drop("now")
        late = over.join(self.daily.read(batch).select("day").distinct(), "day", "left_anti").unionByName(over.join(days, "day", "left_semi")).distinct()
        closing = _merged(stored.join(late, "day", "left_semi").drop("at"), "entity_id", "day").withColumn("at", C("day").cast("timestamp") + self.end)
        self.daily.write(closing.select(columns), batch)
        new.unpersist(), minutes.unpersist()


class Pools:
    """SNK-9, ST-11: named pools of entities. A batch's entities, the first ``most`` of them, are united with the pool, or take its place once it holds more than ``most``."""

    def __init__(self, spark: SparkSession, path: str, most: int = 80):
        self.table, self.most = Versions(spark, path, "entity_id string, pool string", "pool"), most

    def refresh(self, found: DataFrame, batch: int, pool: str) -> None:
        """``found``: entity_id and change, the largest change first (ties by id)."""
        new = found.orderBy(F.desc("change"), "entity_id").limit(self.most).select("entity_id").persist()
        if not new.isEmpty():
            old = self.table.read(batch).where(C("pool") == pool).select("entity_id")
            full = old.limit(self.most + 1).count() > self.most
            self.table.write((new if full else old.union(new).distinct()).withColumn("pool", F.lit(pool)), batch)
        new.unpersist()

    def delete(self, pool: str, batch: int) -> None:
        """The pool is empty from this batch on: its version holds no entity but an unnamed one, which ``members`` leaves out."""
        self.table.write(self.table.spark.createDataFrame([(None, pool)], "entity_id string, pool string"), batch)

    def members(self) -> DataFrame:
        return self.table.read().where("entity_id is not null").select("pool", "entity_id")


def first_to_last(ticks: DataFrame) -> DataFrame:
    """change of each entity from its first to its last price."""
    k = F.struct("ts", "event_id")
    g = ticks.where("price is not null and price <> 0").groupBy("entity_id").agg(F.min_by("price", k).alias("a"), F.max_by("price", k).alias("b"))
    return g.select("entity_id", F.try_divide(C("b") - C("a"), F.abs("a")).alias("change"))


def with_attributes(ticks: DataFrame, attributes: DataFrame, late: str = "1 day") -> DataFrame:
    """J-5: a stream's events, each once within the watermark, joined to static rows of their entity; each start of the job reads the static rows anew."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).join(attributes, "entity_id")


class RunningEma(StatefulProcessor):
    """ST-5, U-3, U-4, W-43: an entity's EMA carried over the batches; a timer of event time forgets an entity that has been silent for ``idle`` days."""

    def __init__(self, n: int = 12, idle: int = 90):
        self.alpha, self.idle = 2.0 / (n + 1), idle * 86_400_000

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ema", "value double, count long, ts timestamp, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, count, *seen = self.state.get() if self.state.exists() else (0.0, 0, None, None)
        new, out = pd.concat(list(rows)).sort_values(["ts", "event_id"]), []
        for t, i, p in zip(new["ts"], new["event_id"], new["price"], strict=True):
            t = pd.Timestamp(t).to_pydatetime()
            if seen[0] is not None and (t, i) <= tuple(seen):
                continue
            value, count, seen = (float(p) if not count else value + self.alpha * (p - value)), count + 1, [t, int(i)]
            out.append((key[0], int(i), value))
        self.state.update((float(value), int(count), *seen))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(seen[0]).timestamp() * 1000) + self.idle)
        yield pd.DataFrame(out, columns=["entity_id", "event_id", "ema"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"entity_id": pd.Series([], dtype=object), "event_id": pd.Series([], dtype="int64"), "ema": pd.Series([], dtype="float64")})

    def close(self) -> None:
        pass


def running_ema(ticks: DataFrame, n: int = 12, idle: int = 90, late: str = "2 minutes") -> DataFrame:
    live = ticks.where("price is not null and price <> 0").withWatermark("ts", late).groupBy("entity_id")
    return live.transformWithStateInPandas(RunningEma(n, idle), "entity_id string, event_id long, ema double", "append", "EventTime")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of its own whose state is kept in RocksDB, as ``transformWithState`` asks for; other sessions keep their settings."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


class Progress(StreamingQueryListener):
    """ST-7: calls of ``on_batch(name, batch, rows)`` for every batch that read rows, and of ``on_end(name, error)``."""

    def __init__(self, on_batch: Callable[[str, int, int], None], on_end: Callable[[str, str | None], None] = lambda name, error: None):
        self.on_batch, self.on_end, self.names = on_batch, on_end, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.runId)] = event.name or ""

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.on_batch(event.progress.name or "", event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.on_end(self.names.pop(str(event.runId), ""), event.exception)


def changed_entities(ticks: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """ST-7: ``call`` gets, batch by batch, the entities that changed, with their rows' number and last time; one row an entity."""
    w = lambda rows, batch: call(rows.groupBy("entity_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")), batch)
    run_once(ticks, w, checkpoint)
