from collections import defaultdict

import numpy as np

from tidepanel.llm.ann import nearest
from tidepanel.llm.topk import exact_top_k


def test_each_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).round(3).tolist()) for i in range(100, 130)] + [(i, rng.normal(size=2).round(3).tolist()) for i in range(200, 208)] + [(300, [1.0]), (400, []), (500, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vec = {i: np.array(v) for i, v in rows if v}
    for search, value in ((lambda: exact_top_k(df, "vec_id % 100 = 0", 10), lambda v: np.floor(1024 * v)), (lambda: nearest(df, "vec_id % 100 = 0", 10), lambda v: v)):
        got = defaultdict(list)
        for r in search().orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, round(float(r.score), 6)))
        want = {}
        for q in (100, 200, 300):
            near = sorted((-float(value(v) @ value(vec[q])), i) for i, v in vec.items() if i != q and len(v) == len(vec[q]))[:10]
            want[q] = [(i, round(-s, 6)) for s, i in near]
        assert got == {q: x for q, x in want.items() if x} and len(want[200]) == 7
