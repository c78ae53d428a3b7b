"""The Parquet lake: scans, point lookups, writes, upserts and retention (SRC, SNK, ST-9)."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


_NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: all files of a dataset, schemas merged by name, partitions discovered."""
    return spark.read.option("mergeSchema", True).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it, or None where it is not of a (shared) local file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getScheme() == "file" else None


def _folder(key: str, value: str) -> str:
    """A partition's folder as Spark's writers name it and its readers undo it."""
    escaped = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value)
    return f"{key}={escaped}"


def write_lines(df: DataFrame, path: str, key: str, ending: str, header: str = "", listed: str | None = None, dealt: bool = False) -> None:
    """SNK-6, SRC-12: the lines in ``value`` as text, a folder for each value of ``key`` in a new folder ``path`` of a local file system.

    Spark's own writer starts a process for each permission that it sets on a local file or folder
    (several for each symbol), which costs far more than a symbol's lines. Here a task
    writes its symbols' files one after the other, under a name that its attempt alone has, and then renames
    them; a second attempt replaces the files of the first. Readers should go by ``_SUCCESS`` or a mark of their own.

    ``listed``: a folder for the list of the files (key, file within ``path``, bytes), by which ``read_lines`` reads them.
    ``dealt``: a key's rows lie in one task already and need no shuffle.
    """
    root = local_path(df.sparkSession, path)

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        file, temp, folder, name, now, size = None, None, None, None, None, 0
        head = f"{header}\n".encode() if header else b""

        def done():
            file.close()
            os.replace(temp, f"{root}/{folder}/{name}")
            return None if now == _NO_KEY else now, f"{folder}/{name}", size  # as a reader of folders names it

        def files(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], [key, "file", "bytes"])

        try:
            for batch in batches:
                lines, made = batch.column(1).cast(pa.large_binary()), []
                offsets, text = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :], lines.buffers()[2]
                same, lo = pc.run_end_encode(batch.column(0)), 0
                for symbol, hi in zip(same.values.to_pylist(), same.run_ends.to_pylist(), strict=True):
                    symbol = symbol or None  # NULL and empty ones, which are neighbours, share a file, and their folder with a key of its name
                    if file is None or symbol != now:
                        if file:
                            made.append(done())
                        now, folder = symbol, _folder(key, symbol or _NO_KEY)
                        name = f"part-{task.partitionId():05d}{'-named' if symbol == _NO_KEY else ''}.{ending}"
                        os.makedirs(f"{root}/{folder}", exist_ok=True)
                        temp = f"{root}/{folder}/.{name}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
                        file = open(temp, "wb")  # noqa: SIM115
                        size = file.write(head)
                    size += file.write(memoryview(text)[offsets[lo] : offsets[hi]])
                    lo = hi
                if made:
                    yield files(made)
            if file:
                yield files([done()])
        except BaseException:
            if file and not file.closed:
                file.close()
                Path(temp).unlink(missing_ok=True)
            raise

    Path(root).mkdir(parents=True)
    rows = df.select(F.col(key).cast("string").alias(key), F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).alias("value"))
    # a key's lines go into one file, those of a key with very many into several, which Spark splits by size
    rows = rows if dealt else rows.hint("rebalance", key)
    files = rows.sortWithinPartitions(key).mapInArrow(write, f"{key} string, file string, bytes long").write.mode("overwrite")
    files.parquet(listed) if listed else files.format("noop").save()
    Path(root, "_SUCCESS").touch()


def read_lines(files: DataFrame, path: str, header: bool = False, bytes_a_task: int = 64_000_000) -> DataFrame:
    """SNK-6, SRC-12: the lines of listed files (columns ``file``, within ``path``, ``bytes`` and others) of a local file system, in ``value`` beside the other columns.

    Spark's readers list each folder and open each file as a split of its own, which costs far
    more than a symbol's lines. Here a task gets some files of the list and reads one after the other.
    """
    root, keys, piece = local_path(files.sparkSession, path), [c for c in files.columns if c not in ("file", "bytes")], 1 << 21
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, (files.agg(F.sum("bytes")).first()[0] or 0) // bytes_a_task + 1)

    def read(batches):
        def made(batch, found):
            data, at = b"".join(d for _, d in found), np.repeat([i for i, _ in found], [d.count(b"\n") for _, d in found])
            ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
            lines = pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))
            return pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(at, pa.int64())).columns, pc.utf8_rtrim(lines, "\n")], [*keys, "value"])

        for batch in batches:
            found, size = [], 0
            for i, name in enumerate(batch.column("file").to_pylist()):
                with open(f"{root}/{name}", "rb") as file:
                    if header:
                        file.readline()
                    while data := file.read(piece):
                        data += file.readline()
                        found.append((i, data if data.endswith(b"\n") else data + b"\n"))
                        size += len(data)
                        if size >= piece:
                            yield made(batch, found)
                            found, size = [], 0
            if found:
                yield made(batch, found)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.select(keys).schema)
    return files.repartition(tasks).mapInArrow(read, f"{schema}, value string")


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def register(spark: SparkSession, datasets: dict[str, str]) -> None:
    """SRC-2: a view for each dataset."""
    for name, path in datasets.items():
        scan(spark, path).createOrReplaceTempView(name)


def query_table(
    df: DataFrame, where: Iterable[Column] = (), ids: DataFrame | list | None = None, columns: list[str] | None = None, labels: dict[str, str] | None = None,
    start=None, end=None, time: str = "day", entity: str = "entity_id", order: list | None = None, limit: int | None = None, distinct: bool = False,
) -> DataFrame:
    """SRC-3, SRC-6, SRC-10: filter, project, rename, order and limit one table; bounds are inclusive, ordered by time unless told otherwise.

    A list of ids becomes a predicate; a DataFrame of ids (column ``entity``) a
    semi join. A ``year`` partition column is pruned along with the time range.
    """
    for c in where:
        df = df.where(c)
    if isinstance(ids, DataFrame):
        df = df.join(ids.select(entity).distinct(), entity, "left_semi")
    elif ids is not None:
        df = df.where(F.col(entity).isin(list(ids)))
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
        df = df.where(F.col("year") >= F.year(F.lit(start).cast("date"))) if "year" in df.columns else df
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end))
        df = df.where(F.col("year") <= F.year(F.lit(end).cast("date"))) if "year" in df.columns else df
    if columns is not None:
        df = df.select(*dict.fromkeys([*columns, time]))
    if labels:
        df = df.withColumnsRenamed(labels)
    df = df.distinct() if distinct else df
    df = df.orderBy(*(order or [(labels or {}).get(time, time)]))
    return df.limit(limit) if limit is not None else df


def last_rows(df: DataFrame, n: int, entity: str = "entity_id", time: str = "day") -> DataFrame:
    """SRC-11: each entity's last n rows, in one pass."""
    w = Window.partitionBy(entity).orderBy(F.desc(time))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def trade_dates(df: DataFrame, entity_id: str | None = None, last: int | None = None, entity: str = "entity_id", time: str = "day") -> DataFrame:
    """SRC-15: the calendar of one entity's (or all) bars, or its last k dates."""
    days = (df.where(F.col(entity) == entity_id) if entity_id else df).select(time).distinct()
    return days.orderBy(F.desc(time)).limit(last) if last else days


def write_panel(df: DataFrame, path: str, time: str = "day", by: tuple[str, ...] = ("year",), mode: str = "append") -> None:
    """SNK-1: Hive-partitioned Parquet with year and month taken from the time; ``overwrite`` replaces only the partitions present."""
    rows = df.withColumns({"year": F.year(time), "month": F.month(time)})
    rows = rows.drop(*({"year", "month"} - set(by) - set(df.columns)))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_factor(df: DataFrame, path: str, name: str, time: str = "day", mode: str = "append") -> None:
    """SNK-2: entity_id, time and value are required; factor_name is always added."""
    missing = {"entity_id", time, "value"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    write_panel(df.select("entity_id", time, "value").withColumn("factor_name", F.lit(name)), path, time, ("year", "month"), mode)


def wide(long: DataFrame, names: tuple[str, ...], time: str = "day", rows_a_task: int = 400_000) -> DataFrame:
    """A-20: a column for each factor, of values that are stored long; one aggregation over tasks of so many rows, so that a task's table of keys does not grow with the data."""
    parts = long.count() // rows_a_task + 1  # files know their counts
    rows = long.repartition(parts, "entity_id", time)
    return rows.groupBy("entity_id", time).agg(*(F.max(F.when(F.col("factor_name") == n, F.col("value"))).alias(n) for n in names))


def keep_last(df: DataFrame, key: str, sequence: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(sequence))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", sequence: str = "seq", replace: bool = False) -> DataFrame:
    """SNK-3: one row a key (the last by ``sequence``), columns cut to those of the table; existing keys win unless ``replace``."""
    rows = keep_last(new, key, sequence)
    rows = rows.select(*(c if c in rows.columns else F.lit(None).alias(c) for c in old.columns))
    if replace:
        return old.join(rows.select(key), key, "left_anti").select(old.columns).unionByName(rows)
    return old.unionByName(rows.join(old.select(key), key, "left_anti").select(old.columns))


def retained(df: DataFrame, days: int, time: str = "day") -> DataFrame:
    """SNK-4: rows of the last so many days that occur."""
    last = df.select(time).distinct().orderBy(F.desc(time)).limit(days).agg(F.min(time).alias("_from"))
    return df.join(F.broadcast(last), F.col(time) >= F.col("_from")).drop("_from")


def utc_from_micros(n: Column) -> Column:
    """Microseconds since the epoch as a UTC time without a zone, the same in every session zone and at its clock changes."""
    return F.timestamp_add("MICROSECOND", n, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def without_zone(df: DataFrame) -> DataFrame:
    """SNK-7: timestamps with a zone become UTC without one."""
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: utc_from_micros(F.unix_micros(c)) for c in zoned})


def newer(source: DataFrame, stored: DataFrame, entity: str = "entity_id", time: str = "day") -> DataFrame:
    """ST-9: rows of the source from each entity's last stored time on (that one too: an unfinished bar is replaced)."""
    mark = stored.groupBy(entity).agg(F.max(time).alias("_mark"))
    return source.join(mark, entity, "left").where(F.col("_mark").isNull() | (F.col(time) >= F.col("_mark"))).drop("_mark")


def parse_klines(df: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC-12: 'date,open,close,high,low,volume,turnover,…,change,…,rate' lines; percent fields over 100, empty ones 0."""
    part = F.split(line, ",")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    pct = lambda i: F.coalesce(number(i) / 100, F.lit(0.0))
    names = ("open", "close", "high", "low", "volume", "turnover")
    return df.select(*keep, F.get(part, F.lit(0)).try_cast("date").alias("day"), *(number(i + 1).alias(n) for i, n in enumerate(names)), pct(8).alias("change_pct"), pct(10).alias("turnover_rate"))


def session_grid(days: DataFrame, minutes: int, sessions=(("09:30", "11:30"), ("13:00", "15:00")), time: str = "day") -> DataFrame:
    """SRC-16: the expected minute stamps of each business day, session ends included."""
    week = days.where(F.weekday(time) < 5)
    at = lambda t: F.to_timestamp(F.concat_ws(" ", F.date_format(time, "yyyy-MM-dd"), F.lit(t)), "yyyy-MM-dd HH:mm")
    spans = [F.sequence(at(a), at(b), F.make_dt_interval(mins=F.lit(minutes))) for a, b in sessions]
    return week.select(time, F.explode(F.array_distinct(F.concat(*spans))).alias("ts"))


@contextmanager
def _within(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def listed_together(spark: SparkSession):
    """Lets a scan of very many small folders list them in 64 tasks, within the block alone; Spark starts a task for each folder, up to 10,000."""
    return _within(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", "64")


@contextmanager
def java_charsets(spark: SparkSession):
    """Lets CSV be read and written in every charset that Java knows, within the block alone."""
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """SNK-8: a table as CSV with a header."""
    with java_charsets(df.sparkSession):
        df.write.option("encoding", encoding).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, stored: str, encodings: tuple[str, ...] = ("UTF-8", "GB18030")) -> DataFrame:
    """SRC-14: CSV in the first of the encodings that leaves no character undecoded (GB18030 holds GB2312 and GBK), kept as Parquet in ``stored``."""
    with java_charsets(spark):
        for encoding in encodings:
            rows = spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)
            text = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
            if encoding == encodings[-1] or rows.where(" or ".join(f"contains({c}, '\ufffd')" for c in text)).isEmpty():
                rows.write.parquet(stored)
                break
    return spark.read.parquet(stored)
