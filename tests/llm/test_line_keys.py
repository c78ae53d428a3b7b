"""The order of a line's words by one sort, and candidates from rows sorted by key alone."""

import numpy as np
import pyarrow as pa

from tidepanel.llm.lines import Bounds, Ranks, _candidates, _in_order


def test_one_sort_is_the_order_by_owner_rank_and_hash():
    rng = np.random.default_rng(4)
    for words, most in ((1 << 63, 70_000), (1 << 63, 1), (9, 3)):
        owner = np.sort(rng.integers(0, 500, 5_000))
        h = rng.choice(rng.integers(0, words, 300, np.uint64), 5_000)
        rank = (h % np.uint64(most)).astype(np.int64)
        for hashes in (h, h | np.uint64(1 << 62)):  # small numbers differ in last bits alone: the plain order
            got, want = _in_order(owner, rank, hashes), np.lexsort((hashes, rank, owner))
            assert all((x[got] == x[want]).all() for x in (owner, rank, hashes))
    assert len(_in_order(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))) == 0


def test_frequent_words_come_last():
    h = np.array([5 << 50, 7 << 50, 9 << 50], np.uint64)
    ranks = Ranks.of((h, np.array([10, 30, 20])))
    assert ranks(np.append(h, np.uint64(11))).tolist() == [1, 3, 2, 0]


def test_candidates_of_rows_in_the_order_of_their_keys_alone():
    rows = [(2, 9, 0), (2, 3, 1), (2, 3, 0), (4, 1, 0), (6, 8, 0), (6, 7, 0)]
    key, doc, line = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
    size, p = pa.array([20] * 6, pa.int32()), pa.array([0] * 6, pa.int64())
    batch = pa.RecordBatch.from_arrays([key, doc, line, size, p], ["key", "doc_id", "line", "size", "p"])
    got = [r for b in _candidates(Bounds(), 1)(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    pairs = {(r["key"], r["doc_id"], r["line"], tuple(zip(r["others"], r["other_lines"], strict=True)), r["more"]) for r in got}
    assert pairs == {(2, 3, 1, ((3, 0),), False), (2, 9, 0, ((3, 1),), True), (6, 8, 0, ((7, 0),), False)}
