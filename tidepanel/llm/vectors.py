"""Vectors as classes of equal ones, packed blocks, and the last steps that the two searches share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import on_workers


def usable(df: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """vec_id and vec (array<double>): rows with an id and a vector of finite components; ``zero`` keeps zero vectors."""
    on_workers(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    return rows if zero else rows.where(F.exists("vec", lambda x: x != 0))


def by_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` among the vectors of each length, which meet no others; one search a length."""
    lengths = sorted(r.n for r in rows.select(F.size("vec").alias("n")).distinct().collect())
    found = [search(rows.where(F.size("vec") == n) if len(lengths) > 1 else rows) for n in lengths] or [search(rows)]
    return reduce(DataFrame.union, found)


def classes(rows: DataFrame, k: int) -> DataFrame:
    """A row for each distinct vector: cid (its smallest id), vec, and ids, its k + 1 smallest ids; no others can be among k nearest, since ties go to smaller ids."""
    few = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "vec", "ids")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list<double> column without nulls as a matrix."""
    n = len(column)
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1 if n else 0)


def _pack(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("cid").to_numpy())
    table = table.take(pa.array(order))
    vecs = matrix(table.column("vec"))
    names = [c for c in ("key", "part") if c in table.column_names]
    ids = table.column("ids").to_pylist()
    one = [table.column(c).slice(0, 1).combine_chunks() for c in names]
    one = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in one]
    return pa.Table.from_arrays([*one, pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([vecs.astype(np.float64).tobytes()], pa.binary())], names=[*names, "ids", "vecs"])


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of (key, cid, vec, ids) packed into blocks of about ``most`` vectors of one key: key, part, ids, vecs (doubles, row by row)."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    salted = rows.join(sizes, "key").select("key", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), "cid", "vec", "ids")
    return salted.groupBy("key", "part").applyInArrow(_pack, "key long, part int, ids array<array<long>>, vecs binary")


def best(score: np.ndarray, ids: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores with their ids (ties: smaller ids); each score stands for all of its class's ids."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    n = [len(ids[i]) for i in at]
    s, v = np.repeat(score[at], n), np.array([x for i in at for x in ids[i]], np.int64)
    order = np.lexsort((v, -s))[:k]
    return s[order], v[order]


def ranked(found: DataFrame, queries: DataFrame, k: int, score: Column) -> DataFrame:
    """``found`` (cid, vec_id, score) holds each query class's k + 1 best from several places; ``queries`` (query_id, cid). The k best of each query, its own row left out."""
    w = Window.partitionBy("cid").orderBy(F.desc("score"), "vec_id")
    top = found.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    lists = top.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    own = queries.join(lists, "cid").select("query_id", F.slice(F.filter("top", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("top"))
    return own.select("query_id", F.posexplode("top").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), score.alias("score"))
