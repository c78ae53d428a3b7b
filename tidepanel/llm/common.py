"""Reading, cutting lineage and small Arrow helpers shared by the operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def on_workers(spark: SparkSession) -> None:
    """Let local Python workers find this package wherever the driver was started; a cluster has it installed or in --py-files."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, (known.get("PYTHONPATH"), root)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    on_workers(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled(share: Column, *columns: str) -> Column:
    """True for about ``share`` of the rows, chosen by the hash of the columns: no sort, and nothing travels."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < share * (1 << 30)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash."""
    on_workers(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def packs(texts: list[bytes | None], most: int = 1 << 20):
    """Ranges [lo, hi) of texts of about ``most`` bytes together; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def bucket_count(docs: DataFrame, bytes_each: int = 8 << 20, least: int = 8) -> int:
    """Buckets of about ``bytes_each`` of text, from the total over all documents."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(least, -(-total // bytes_each))


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on for other tasks, and what it holds counts as its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def releasing(run):
    """``run``, a function for mapInArrow, with ``release`` at the end of each task."""

    def rows(batches):
        yield from run(batches)
        release()

    return rows


def releasing_groups(run):
    """``run``, a function for a cogroup's applyInArrow, with ``release`` at the end of each group."""

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return group


def min_labels(links: DataFrame, name: str, part_rows: int = 250_000) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, label) a node, label its smallest node.

    A turn takes the smallest label among a node and its neighbours; every other
    turn first takes the label of the label, so that long chains end early. All
    are aggregations and joins, so no component is gathered in one task. It ends
    when a turn leaves the sum of the labels as it was. The tables of a turn are
    written in parts of about ``part_rows`` links, as a turn of few links is
    mostly the cost of its tasks.
    """
    ends = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in "ab" for y in "ab"]
    both = keep(links.select(F.explode(F.array(*ends)).alias("e")).select("e.x", "e.y"), f"{name}-links")
    parts = 4 + both.count() // part_rows
    labels = keep(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label")).coalesce(parts), f"{name}-labels")
    total, turn = None, 0
    while True:
        if turn % 2:
            labels = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.col("far").alias("label"))
        labels = keep(both.join(labels, both.y == labels.node).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("label")).coalesce(parts), f"{name}-labels")
        last, total, turn = total, labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0], turn + 1
        if last == total:
            return labels


def left_join_few(docs: DataFrame, found: DataFrame, on: list[str], bits: int = 25) -> DataFrame:
    """``docs`` left-joined with ``found`` by the columns ``on``; rows of ``docs`` without a match stay where they are.

    ``found`` is read twice, so it should be a kept table. A bitmap of ``2 ** bits``
    bits over the hashes of its keys (4 MB at 25, broadcast whatever the input)
    tells most rows without a match; only the others are shuffled. A null key
    matches nothing; rows of ``docs`` come once for each match.
    """
    part, bitmap = "_left_join_few_part", "_left_join_few_bits"
    place = F.pmod(F.xxhash64(*on), F.lit(1 << bits))
    page, at = F.shiftright(place, 15), place.bitwiseAND(0x7FFF)
    pages = found.dropna(subset=on).groupBy(page.alias(part)).agg(F.bitmap_construct_agg(at).alias(bitmap))
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.pmod(byte / F.pow(F.lit(2), at.bitwiseAND(7)), F.lit(2)) >= 1, F.lit(False))
    dealt = docs.withColumn(part, page).join(F.broadcast(pages), part, "left").withColumn(bitmap, marked).drop(part)
    few, rest = (dealt.where(x).drop(bitmap) for x in (F.col(bitmap), ~F.col(bitmap)))
    return few.join(found, on, "left").unionByName(rest, allowMissingColumns=True)
