"""Exact top-k inner-product search by norm buckets.

Equal vectors form one class, of which only the k + 1 smallest ids can matter.
Classes are grouped by length (norm) in geometric buckets and packed into
blocks. A first pass over the block of the longest vectors gives each query a
lower bound of its k-th score. Every other (query block, block) pair then takes
from it the cosine that a vector of the block must reach: over 1, the pair is
skipped (length pruning); high, only vectors whose largest-query coordinates lie
in the range this cosine allows are multiplied (coordinate pruning); else all
that are long enough. All products are verified in whole numbers.

Query blocks meet the blocks in groups of bounded size, broadcast one at a time.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do null ids; vectors of each length are searched among
themselves; rows with the same id and vector are one; a query's own row is its id; extra columns are
not read; an empty table gives an empty result. A component beyond a long's
range is an error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .vectors import best, blocks, by_length, classes, ranked, usable

_FOUND = "cid long, vec_id long, score long"
_HIGH = 0.6  # from this local cosine on, coordinates prune


def products(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole-number inner products of the rows of p with q, exact."""
    if not p.size or float(np.abs(p).max()) * float(np.abs(q).max()) * p.shape[1] < 2.0**53:
        return (p @ q).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in p], np.int64)


def prune(unit: np.ndarray, norm: np.ndarray, q: np.ndarray, need: float) -> np.ndarray:
    """Places of the vectors (``unit`` rows of length one, ``norm``) whose product with q can be ``need`` or more."""
    length = float(np.sqrt(q @ q))
    if need <= 0 or not length:
        return np.arange(len(norm))
    if length * float(norm.max(initial=0.0)) * (1 + 1e-9) < need:
        return np.zeros(0, np.int64)
    cosine = need / (length * norm.max()) * (1 - 1e-9)
    live = norm * length * (1 + 1e-9) >= need
    if cosine >= _HIGH:
        t = min(cosine, 1.0)
        for f in np.argsort(-np.abs(q))[:2]:
            c = q[f] / length
            spread = np.sqrt(max((1 - t * t) * (1 - c * c), 0.0)) + 1e-9
            if c >= 0:
                live &= unit[:, f] >= (t * c - spread if c < 1 else t - 1e-9)
            else:
                live &= unit[:, f] <= (t * c + spread if c > -1 else -t + 1e-9)
    return np.flatnonzero(live)


def _search(k: int, bound: bool):
    """Per pair of a query block and a block: each query's k + 1 best (as found rows, or only the last of them as its bound)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids, queries = row["ids"], row["q_ids"]
                p = np.frombuffer(row["vecs"], np.float64).reshape(len(ids), -1)
                qs = np.frombuffer(row["q_vecs"], np.float64).reshape(len(queries), -1)
                norm = np.sqrt((p * p).sum(axis=1))
                unit = p / np.maximum(norm, 1e-300)[:, None]
                out = []
                for j, q in enumerate(qs):
                    need = row["bounds"][j] if not bound else None
                    at = prune(unit, norm, q, need) if need is not None else np.arange(len(p))
                    if not len(at):
                        continue
                    s, v = best(products(p[at], q), [ids[x] for x in at], k + 1)
                    if bound:
                        out.append((queries[j][0], float(s[-1]) if len(s) > k else None))
                    else:
                        out += zip([queries[j][0]] * len(s), v.tolist(), s.tolist(), strict=True)
                names = ["cid", "bound"] if bound else ["cid", "vec_id", "score"]
                types = [pa.int64(), pa.float64()] if bound else [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names)

    return run


def exact_top_k(df: DataFrame, query_rows, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, block: int = 4096, query_block: int = 512, group: int = 32) -> DataFrame:
    """query_id, rank, vec_id and score (long) of each query's k largest products of floor(scale · x); ``query_rows`` is a condition on vec_id."""
    rows = usable(df, id_col, vec_col, zero=True).select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"))
    return by_length(rows, lambda same: _top_k(same, query_rows, k, block, query_block, group))


def _top_k(rows: DataFrame, query_rows, k: int, block: int, query_block: int, group: int) -> DataFrame:
    spark = rows.sparkSession
    known = keep(classes(rows, k), "classes")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    longest = known.agg(F.max(norm)).first()[0]
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    key = F.when(norm > 0, F.floor(F.log(F.lit(longest) / norm) / 0.05)).otherwise(1 << 20).cast("long")
    packed = keep(blocks(known.withColumn("key", key), block), "blocks")
    queries = keep(rows.where(query_rows).distinct().join(known.select("vec", "cid"), "vec").select(F.col("vec_id").alias("query_id"), "cid", "vec"), "queries")
    asked = queries.select("cid", "vec").distinct().withColumn("ids", F.array("cid")).withColumn("key", F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) % 64)
    asked = blocks(asked, query_block).select(F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), F.concat_ws("-", "key", "part").alias("name"))
    asked = keep(asked, "asked")
    top = packed.orderBy("key", F.desc(F.size("ids")), "part").limit(1)
    first = asked.join(F.broadcast(top.select("ids", "vecs", F.lit(0).alias("g"))), F.lit(0) == F.col("g"))  # one block of at most ``block`` vectors
    bounds = first.select("ids", "vecs", "q_ids", "q_vecs").mapInArrow(_search(k, True), "cid long, bound double")
    named = asked.select("name", F.posexplode("q_ids").alias("pos", "q")).select("name", "pos", F.col("q")[0].alias("cid"))
    listed = named.join(bounds, "cid", "left").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bound"))), lambda x: x.bound).alias("bounds"))
    ready = keep(asked.join(listed, "name").withColumn("g", F.pmod(F.xxhash64("name"), F.lit(max(1, -(-asked.count() // group))))), "ready")
    groups = [r.g for r in ready.select("g").distinct().orderBy("g").collect()]
    found = [packed.withColumn("g", F.lit(g)).join(F.broadcast(ready.where(F.col("g") == g)), "g").select("ids", "vecs", "q_ids", "q_vecs", "bounds").mapInArrow(_search(k, False), _FOUND) for g in groups]
    return ranked(reduce(DataFrame.union, found), queries.select("query_id", "cid"), k, F.col("x.score")) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
