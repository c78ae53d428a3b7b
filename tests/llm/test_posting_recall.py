import numpy as np
import pytest

from tidepanel.llm.ann import CentroidGraph, nearest


def rows(kind: str, n: int, dim: int) -> np.ndarray:
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim))
    if kind == "norms":
        return x * rng.lognormal(0, 1, (n, 1))
    return x


@pytest.mark.parametrize("kind", ["normal", "norms"])
def test_recall_without_clusters(spark, kind):
    """Vectors without clusters, whose nearest are spread over many lists."""
    x, k = rows(kind, 3000, 48), 10
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found: dict[int, set] = {}
    for r in nearest(df, "vec_id % 20 = 0", k, list_size=8, least_lists=16).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for i in range(0, len(x), 20):
        s = x @ x[i]
        s[i] = -np.inf
        hit += len(found[i] & set(np.argsort(-s)[:k].tolist()))
    assert hit / (len(x) // 20 * k) >= 0.93


def test_every_centroid_is_reached():
    """Groups of centroids far from each other, each of more than a centroid's links."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(4, 3)) + 1000 * g for g in range(60)])
    graph = CentroidGraph.build(np.unique(points, axis=0), degree=3)
    assert len(graph.search(points[7], 0.25, len(points))) == len(points)
