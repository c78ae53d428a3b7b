"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Equal vectors form one class. A coordinate sqrt(M² - |x|²), M the largest norm,
makes the largest product the nearest vector. Centroids come from k-means over a
bounded sample, with clusters of over twice the mean size split; a vector near a
boundary is put into every cluster whose centroid is at most (1 + spill) times as
far as its nearest, unless a chosen centroid is closer to that centroid than
``apart`` times the vector's distance. Queries walk a neighbour graph of the centroids, which all tasks hold
in memory (at most ``most_lists`` of them), until the next centroid is over
(1 + ratio) times as far as the nearest: the lists up to there are searched, and
a least number of them, ``least_lists`` or more. How many more is measured on the rows:
some ``probes`` queries are compared with all classes, in every task's part of them,
and the number is doubled until the lists searched hold ``aim`` of what is
truly nearest to them. Every centroid can be reached: the graph's links run both ways
and each of its components has an entry. Lists are packed into blocks, so
that neither a long list nor many queries of one list gather in one task. Scores
are products of the original vectors in double precision.

Defined results: vectors that are null, zero or hold a null or non-finite
component take no part, nor do null ids; each length is searched among its own;
rows with the same id and vector are one; a query's own row is its id; extra
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, sampled
from .vectors import best, blocks, by_length, classes, matrix, ranked, usable


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in blocks of at most some 4 million distances."""
    step = max(1, (4 << 20) // max(len(c), 1))
    return np.concatenate([distances(x[lo : lo + step], c).argmin(axis=1) for lo in range(0, len(x), step)])


def _lloyd(x: np.ndarray, c: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, _nearest(x, c)


def centroids(x: np.ndarray, lists: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """About ``lists`` centroids of the sample; clusters of over twice the mean size are split in two."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c, own = _lloyd(x, x[rng.permutation(len(x))[:lists]], rounds)
    for _ in range(4):
        n = np.bincount(own, minlength=len(c))
        big = np.flatnonzero(n > 2 * len(x) / lists)
        if not len(big):
            break
        new = [c[n > 0]]
        for b in big:
            members = x[own == b]
            new.append(members[rng.integers(0, len(members), 1)])
        c, own = _lloyd(x, np.concatenate(new), 2)
    return np.unique(c[np.bincount(own, minlength=len(c)) > 0], axis=0)


@dataclass
class CentroidGraph:
    """Each centroid's nearest others and those that it is near to; a walk goes on from the nearest centroid met until that is too far."""

    points: np.ndarray
    near: list[np.ndarray]
    entries: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, degree: int = 24) -> CentroidGraph:
        near = np.empty((len(points), min(degree, max(len(points) - 1, 0))), np.int64)
        for lo in range(0, len(points), 1024):
            d = distances(points[lo : lo + 1024], points)
            d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
            near[lo : lo + 1024] = np.argsort(d, axis=1)[:, : near.shape[1]]
        links: list[set[int]] = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row:
                links[j].add(i)
        step = max(1, len(points) // 32)
        entries = list(range(0, len(points), step))
        met = np.zeros(len(points), bool)
        for start in [*entries, *range(len(points))]:
            if met[start]:
                continue
            if start % step:  # a component that holds no entry yet
                entries.append(start)
            met[start], todo = True, [start]
            while todo:
                new = [j for j in links[todo.pop()] if not met[j]]
                met[new] = True
                todo += new
        return cls(points, [np.array(sorted(row), np.int64) for row in links], np.array(entries))

    def search(self, q: np.ndarray, ratio: float, least: int) -> list[int]:
        """The centroids at most (1 + ratio) times as far from q as the nearest one, nearest first; ``least`` of them at least, if there are so many."""
        seen = np.zeros(len(self.points), bool)
        seen[self.entries] = True
        d = np.sqrt(((self.points[self.entries] - q) ** 2).sum(axis=1))
        todo, out, best = list(zip(d.tolist(), self.entries.tolist(), strict=True)), [], float(d.min())
        heapq.heapify(todo)
        while todo:
            dist, i = heapq.heappop(todo)
            if dist > (1 + ratio) * best and len(out) >= least:
                break
            out.append((dist, i))
            new = self.near[i][~seen[self.near[i]]]
            if len(new):
                seen[new] = True
                d = np.sqrt(((self.points[new] - q) ** 2).sum(axis=1)).tolist()
                best = min(best, *d)
                for x in zip(d, new.tolist(), strict=True):
                    heapq.heappush(todo, x)
        out.sort()
        return [i for n, (dist, i) in enumerate(out) if n < least or dist <= (1 + ratio) * best]


def closure(d: np.ndarray, points: np.ndarray, spill: float, most: int, apart: float = 0.5) -> list[int]:
    """Clusters of a vector at distances d: its nearest, and boundary ones by the ratio and the relative-neighbour rule."""
    order = np.argpartition(d, 4 * most)[: 4 * most] if len(d) > 4 * most else np.arange(len(d))
    order = order[np.argsort(d[order])]
    order = order[d[order] <= (1 + spill) * d[order[0]]]
    between, chosen = distances(points[order], points[order]), [0]
    for c in range(1, len(order)):
        if len(chosen) == most:
            break
        if (between[c, chosen] >= apart * d[order[c]]).all():
            chosen.append(c)
    return order[chosen].tolist()


def _assigned(points: np.ndarray, square: float, spill: float, most: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                x = matrix(part.column("vec"))
                x = np.concatenate((x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]), axis=1)
                lists = [closure(row, points, spill, most) for row in distances(x, points)]
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(lists, pa.list_(pa.int64()))], ["cid", "keys"])

    return run


def _scaled(q: np.ndarray, graph: CentroidGraph) -> np.ndarray:
    """A query as long as the centroids are; the product's order is the same for any length of it."""
    big = np.abs(q).max()
    q = q / big  # so that no square is lost
    return np.append(q * np.sqrt((graph.points**2).sum(axis=1).mean() / (q @ q)), 0.0)


def _selected(graph: CentroidGraph, ratio: float, least: int):
    def run(batches):
        for batch in batches:
            lists = [graph.search(_scaled(q, graph), ratio, least) for q in matrix(batch.column("vec"))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(lists, pa.list_(pa.int64()))], ["cid", "keys"])

    return run


def _searched(k: int, most_held: int = 50_000):
    """Each query class's k + 1 best of all the blocks of a task; when over ``most_held`` classes are held, their rows go out and they start anew."""

    def rows(held: dict) -> pa.RecordBatch:
        cids = np.repeat(np.array(list(held), np.int64), [len(s) for s, _ in held.values()])
        score, ids = (np.concatenate(x) for x in zip(*held.values(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cids), pa.array(ids), pa.array(score)], ["cid", "vec_id", "score"])

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ids, queries = batch.column("ids")[i].as_py(), batch.column("q_ids")[i].as_py()
                p = np.frombuffer(batch.column("vecs")[i].as_py(), np.float64).reshape(len(ids), -1)
                qs = np.frombuffer(batch.column("q_vecs")[i].as_py(), np.float64).reshape(len(queries), -1)
                for q, own in zip(qs, queries, strict=True):
                    score, had = np.einsum("ij,j->i", p, q), held.get(own[0])
                    if had and len(had[0]) > k and score.max() < had[0][-1]:
                        continue
                    s, v = best(score, ids, k + 1)
                    if had:  # a vector stands in several lists
                        new = ~np.isin(v, had[1])
                        s, v = np.concatenate((had[0], s[new])), np.concatenate((had[1], v[new]))
                        order = np.lexsort((v, -s))[: k + 1]
                        s, v = s[order], v[order]
                    held[own[0]] = s, v
                if len(held) > most_held:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return run


def _compared(cids: np.ndarray, probes: np.ndarray, k: int):
    """Each probe's k nearest other classes among all the rows of a task."""

    def run(batches):
        held = [(np.empty(0), np.empty(0, np.int64)) for _ in cids]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                score, ids = matrix(part.column("vec")) @ probes.T, part.column("cid").to_numpy()
                for j, own in enumerate(cids):
                    s, v = np.concatenate((held[j][0], score[ids != own, j])), np.concatenate((held[j][1], ids[ids != own]))
                    at = np.argpartition(-s, k)[:k] if len(s) > k else np.arange(len(s))
                    held[j] = s[at], v[at]
        score, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cids, [len(s) for s, _ in held])), pa.array(ids), pa.array(score)], ["probe", "cid", "score"])

    return run


def _enough(graph: CentroidGraph, probes: DataFrame, known: DataFrame, lists: DataFrame, k: int, ratio: float, least: int, aim: float) -> int:
    """The least number of lists with which the searched lists hold ``aim`` of the k classes nearest to the probes."""
    asked = [(r.cid, r.vec) for r in probes.sort("cid").select("cid", "vec").collect()]
    if not asked or least >= len(graph.points):
        return least
    vecs = np.array([v for _, v in asked])
    compared = known.select("cid", "vec").mapInArrow(_compared(np.array([c for c, _ in asked], np.int64), vecs, k), "probe long, cid long, score double")
    w = Window.partitionBy("probe").orderBy(F.desc("score"), "cid")
    truth = compared.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    held: dict[int, list[list[int]]] = {}
    for r in truth.join(lists, "cid").select("probe", "keys").collect():  # k lists of at most ``copies`` numbers a probe
        held.setdefault(r.probe, []).append(r.keys)
    while least < len(graph.points):
        hit = total = 0
        for cid, vec in asked:
            found = set(graph.search(_scaled(np.array(vec), graph), ratio, least))
            keys = held.get(cid, [])
            hit, total = hit + sum(not found.isdisjoint(x) for x in keys), total + len(keys)
        if hit >= aim * total:
            break
        least *= 2
    return least


def nearest(
    df: DataFrame, query_rows, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
    list_size: int = 64, most_lists: int = 4096, sample: int = 20_000, spill: float = 0.15, copies: int = 8, ratio: float = 0.25, least_lists: int = 64,
    probes: int = 200, aim: float = 0.97,
) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best found; ``query_rows`` is a condition on vec_id. Centroids are fitted on about ``sample`` classes, chosen by the hash of their ids."""
    rows = usable(df, id_col, vec_col, zero=False)
    return by_length(rows, lambda same: _near_of_one_length(same, query_rows, k, list_size, most_lists, sample, spill, copies, ratio, least_lists, probes, aim))


def _near_of_one_length(rows: DataFrame, query_rows, k: int, list_size: int, most_lists: int, sample: int, spill: float, copies: int, ratio: float, least_lists: int, probes: int, aim: float) -> DataFrame:
    known = keep(classes(rows, k), "classes")
    square = known.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).first()
    if square[0] is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    square, total = square
    chosen = known if total <= sample else known.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    x = np.array([r.vec for r in chosen.sort("cid").select("vec").collect()])
    x = np.concatenate((x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]), axis=1)
    points = centroids(x, min(most_lists, -(-total // list_size)))
    graph = CentroidGraph.build(points)
    lists = keep(known.select("cid", "vec").mapInArrow(_assigned(points, square, spill, copies), "cid long, keys array<long>"), "lists")
    posted = known.join(lists, "cid").select(F.explode("keys").alias("key"), "cid", "vec", "ids")
    packed = blocks(posted, 4096)
    queries = keep(rows.where(query_rows).distinct().join(known.select("vec", "cid"), "vec").select(F.col("vec_id").alias("query_id"), "cid", "vec"), "queries")
    asked = queries.select("cid", "vec").distinct()
    count = queries.count()
    some = asked.where(sampled(F.lit(probes / max(count, probes)), "cid", F.lit("probe")))
    least_lists = _enough(graph, some, known, lists, k, ratio, least_lists, aim)
    asked = asked.repartition(max(1, count // 128), "cid")
    wanted = asked.mapInArrow(_selected(graph, ratio, least_lists), "cid long, keys array<long>")
    wanted = keep(asked.join(wanted, "cid").select(F.explode("keys").alias("key"), "cid", "vec", F.array("cid").alias("ids")), "wanted")
    q_packed = blocks(wanted, 512).select("key", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"))
    found = packed.join(q_packed, "key").select("ids", "vecs", "q_ids", "q_vecs").mapInArrow(_searched(k), "cid long, vec_id long, score double")
    return ranked(found, queries.select("query_id", "cid"), k, F.col("x.score"))
