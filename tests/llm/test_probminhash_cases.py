import random

import zlib

import numpy as np

from tidepanel.llm.probminhash import near_duplicates, one_of_each, probability_jaccard


def classes(docs, t=0.8):
    sets, up = {}, {d: d for d, _ in docs}
    for d, x in docs:
        w = x.split()
        e, n = np.unique([zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(len(w) - 4)], return_counts=True)
        sets[d] = (e.astype(np.uint64), n)
    for a in sorted(up):
        for b in range(a):
            if probability_jaccard(*sets[a], *sets[b]) >= t:
                p, q = sorted((up[a], up[b]))
                up = {d: p if c == q else c for d, c in up.items()}
    return up


def test_production_bands_one_large_group_of_borderline_copies(spark):
    """Copies of one text at about 0.7 to 0.9 of each other: links, chains and pairs below the threshold in one bucket."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(900)]
    base = [rng.choice(vocab) for _ in range(220)]
    docs = []
    for i in range(130):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((i, " ".join(w)))
    want = classes(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for few, rounds in ((8, 2), (0, 0), (0, 3)):
        got = {r.doc_id: r.class_id for r in near_duplicates(df, few=few, rounds=rounds).collect()}
        assert got == want
    assert 1 < len(set(want.values())) < 130 or len(set(want.values())) == 1


A, B, C = "one two three four five six seven eight nine ten", "red green blue black white grey pink brown gold tan", "un deux trois quatre cinq six sept huit neuf dix"


def test_ids_with_several_texts(spark):
    rows = [(1, A, 0), (1, B, 0), (2, A, 0), (3, B, 0), (4, None, 0), (4, A, 0), (5, "", 0), (5, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, band int")
    got = near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 4), (5, 5)]
    assert sorted(r.doc_id for r in got if r.leads) == [1, 1, 4, 5]
    assert sorted(map(str, near_duplicates(df.repartition(3)).collect())) == sorted(map(str, got))


def test_no_text_is_lost_and_no_copy_stays_where_ids_repeat(spark):
    for x, y in ((A, B), (B, A)):
        for rows in ([(1, y), (5, y), (5, x), (6, C)], [(1, x), (1, y), (2, x), (3, y)], [(7, x), (7, x + " eleven"), (7, y), (8, y)]):
            df = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id long, text string, tag string, node int")
            kept = one_of_each(df, near_duplicates(df)).collect()
            texts = [r.text.removesuffix(" eleven") for r in kept]
            assert sorted(texts) == sorted({t.removesuffix(" eleven") for _, t in rows})
            assert all(r.doc_id == min(d for d, t in rows if t.removesuffix(" eleven") == r.text.removesuffix(" eleven")) for r in kept)


def test_repeated_ids_against_every_pair(spark):
    rng = random.Random(31)
    base = [[f"{k}w{rng.randrange(60)}" for _ in range(60)] for k in range(5)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = "x"
        rows.append((rng.randrange(30), " ".join(w)))
    docs = sorted(set(rows))
    where = classes([(n, t) for n, (_, t) in enumerate(docs)])
    want: dict = {}
    for n, (d, _) in enumerate(docs):
        want[where[n]] = min(want.get(where[n], d), d)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == sorted((d, want[where[n]]) for n, (d, _) in enumerate(docs))
    assert sum(r.leads for r in got) == len(want)
