import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm.ann import _searched


@pytest.mark.parametrize("most_held", [1, 50_000])
def test_blocks_of_a_task_meet(most_held):
    """Lists that share vectors, with ties: the best of all blocks, whether or not rows went out in between."""
    rng = np.random.default_rng(5)
    vecs, asked, k = rng.integers(-3, 4, (60, 4)).astype(float), rng.integers(-3, 4, (6, 4)).astype(float), 5
    lists = [rng.choice(60, 25, replace=False) for _ in range(8)]
    pick = [sorted(rng.choice(6, 4, replace=False).tolist()) for _ in lists]
    batch = pa.RecordBatch.from_pydict({
        "ids": [[[int(i)] for i in at] for at in lists], "vecs": [vecs[at].tobytes() for at in lists],
        "q_ids": [[[1000 + j] for j in js] for js in pick], "q_vecs": [asked[js].tobytes() for js in pick],
    })
    found: dict[int, set] = {}
    for out in _searched(k, most_held)(iter([batch.slice(0, 3), batch.slice(3), batch.slice(0, 0)])):
        for r in out.to_pylist():
            found.setdefault(r["cid"] - 1000, set()).add((-r["score"], r["vec_id"]))
    for j in range(6):
        reach = {int(i) for at, js in zip(lists, pick) if j in js for i in at}
        want = sorted((-float(vecs[i] @ asked[j]), i) for i in reach)[: k + 1]
        assert sorted(found.get(j, set()))[: k + 1] == want
    assert list(_searched(k)(iter([]))) == []
