"""SNK-7: one timestamp type for all files of a lake: zone-less, in UTC.

``footers`` reads each file's schema from its footer, on the executors; it is the
dry run. ``migrate`` writes all rows to a new folder, so a run that fails leaves
the old files as they were and may start again.

A file whose column is NULL in every row has its type all the same; an empty
dataset yields no rows. Folder names of the kind ``name=value`` stay columns of
the path. A file that can't be read is named in the report, and ``migrate``
refuses to run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import utc_from_micros

C = F.col
_REPORT = "path string, column string, type string, action string, rows long"
#: What a stored timestamp needs: zone-aware and int96 ones are instants (utc), nanoseconds are read as numbers (micros).
KEEP, TO_UTC, TO_MICROS, UNREADABLE = "keep", "utc", "micros", "unreadable"


def _opened(uri: str):
    """A file by its name as Spark lists it; the file systems are those that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    uri = f"s3:{rest}" if scheme in ("s3a", "s3n") else uri
    system, path = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _columns(uri: str) -> Iterator[tuple]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    try:
        with _opened(uri) as f:
            file = pq.ParquetFile(f)
            arrow, n, stored = file.schema_arrow, file.metadata.num_rows, {c.path: c.physical_type for c in map(file.schema.column, range(len(file.schema)))}
    except (pa.ArrowException, OSError) as e:
        yield uri, None, f"{type(e).__name__}: {e}", UNREADABLE, None
        return
    times = [f for f in arrow if pa.types.is_timestamp(f.type)]
    if not times:
        yield uri, None, None, KEEP, n
    for f in times:
        if stored[f.name] == "INT96":
            yield uri, f.name, "int96", TO_UTC, n
        else:
            yield uri, f.name, str(f.type), TO_MICROS if f.type.unit == "ns" else TO_UTC if f.type.tz else KEEP, n


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The dry run: each file's top-level timestamp columns with their stored type and what they need, and the file's rows; a file without such a column has a row with NULLs, one that can't be read has the reason as its type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")  # names only

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([row for uri in batch["path"] for row in _columns(uri)], columns=["path", "column", "type", "action", "rows"]).astype({"rows": "Int64"})

    return files.mapInPandas(read, _REPORT)


def summary(report: DataFrame) -> DataFrame:
    """Files and rows by column, stored type and what is to be done."""
    return report.groupBy("column", "type", "action").agg(F.count("path").alias("files"), F.sum("rows").alias("rows"))


def _kinds(report: DataFrame) -> dict[tuple, list[str]]:
    """File names by what their columns need: few kinds; the names are those that any scan lists on the driver."""
    kind = F.array_sort(F.collect_list(F.when(C("column").isNotNull() | (C("action") == UNREADABLE), F.struct("column", "action"))))
    found: dict[tuple, list[str]] = {}
    for r in report.groupBy("path").agg(kind.alias("kind")).toLocalIterator():
        found.setdefault(tuple(map(tuple, r.kind)), []).append(r.path)
    bad = [path for k, paths in found.items() if (None, UNREADABLE) in k for path in paths]
    if bad:
        raise ValueError(f"{len(bad)} files can't be read, first ones: {bad[:5]}")
    return found


def _plain(spark: SparkSession, base: str, files: list[str], kind: tuple) -> DataFrame:
    """Files of one kind with zone-less timestamps."""
    files = [re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files]  # names, not patterns
    numbers = spark.newSession()  # its setting lets nanoseconds be seen as numbers and leaves the caller's session alone
    numbers.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    schema = numbers.read.option("basePath", base).option("mergeSchema", True).parquet(*files).schema
    rows = spark.read.option("basePath", base).schema(schema).parquet(*files)
    micros: dict[str, Column] = {c: F.unix_micros(c) for c, action in kind if action == TO_UTC}
    micros |= {c: F.expr(f"(`{c}` - pmod(`{c}`, 1000)) div 1000") for c, action in kind if action == TO_MICROS}
    return rows.withColumns({c: utc_from_micros(m) for c, m in micros.items()})


def migrate(spark: SparkSession, path: str, to: str, by: tuple[str, ...] = ()) -> None:
    """Write the dataset to ``to``, lz4-compressed and partitioned by ``by``, files of one kind read together. What is below a microsecond is cut off (towards the past)."""
    parts = [_plain(spark, path, files, kind) for kind, files in _kinds(footers(spark, path)).items()]
    if parts:
        writer = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).write.mode("overwrite").option("compression", "lz4")
        (writer.partitionBy(*by) if by else writer).parquet(to)
