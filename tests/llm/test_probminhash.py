import random
from collections import Counter

import numpy as np

from tidepanel.llm.probminhash import near_duplicates, one_of_each, probability_jaccard, sketch
from tidepanel.llm.textkit import mix


def slow(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in {*x} & {*y})


def as_sets(x):
    e = sorted(x)
    return np.array(e, np.uint64), np.array([x[i] for i in e])


def test_probability_jaccard_and_estimate():
    rng = random.Random(1)
    for _ in range(20):
        x = {i: rng.randint(1, 4) for i in rng.sample(range(60), 40)}
        y = {i: x.get(i, 1) if rng.random() < 0.8 else rng.randint(1, 4) for i in rng.sample(range(60), 40)}
        assert abs(probability_jaccard(*as_sets(x), *as_sets(y)) - slow(x, y)) < 1e-12
    m = 4000
    held = [sketch(mix(e), w.astype(float), np.zeros(len(e), int), 1, m)[0] for e, w in (as_sets(x), as_sets(y))]
    assert abs((held[0] == held[1]).mean() - slow(x, y)) < 0.05


def grams(t):
    w = t.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(docs, t=0.8):
    sets, up = {d: grams(x or "") for d, x in docs}, {d: d for d, _ in docs}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and slow(sets[a], sets[b]) >= t:
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: top(d) for d in ids}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    docs = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    chain = [rng.choice(vocab) for _ in range(120)]
    for i in range(12):  # each near the one before, the ends far apart
        chain = chain[6:] + [rng.choice(vocab) for _ in range(6)]
        docs.append(" ".join(chain))
    rng.shuffle(docs)
    docs = [(i * 2, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (902, "a b"), (903, "a  b"), (904, " \n")]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, rep int")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, bands=40, rows=3, rounds=0).collect()}
    want = classes(docs)
    assert {d: c for d, c in got.items() if want[d] != c} == {}
    assert len(got) == len(docs)
    kept = one_of_each(df, near_duplicates(df, bands=40, rows=3))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, "x y z"), (None, None), (1, "x y z"), (1, "x y z")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in near_duplicates(df).collect()), key=str) == [(1, 1), (None, None), (None, None)]
    assert near_duplicates(df.limit(0)).collect() == []
