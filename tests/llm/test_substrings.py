import random
import re

from tidepanel.llm.substrings import remove_repeats

SCHEMA = "doc_id long, text string, w1 string"


def brute(docs, window):
    words = {i: [(d, re.findall(r"[^\x20\x09-\x0D]+", t or ""))] for i, (d, t) in enumerate(docs)}
    first = {}
    for ((d, w),) in words.values():
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for ((d, w),) in words.values():
        bad = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    bad |= set(range(i, i + window))
        out.append((d, len(w), len(bad), " ".join(x for i, x in enumerate(w) if i not in bad)))
    return sorted(out, key=str)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA)
    return sorted((tuple(r) for r in remove_repeats(df, **kw).drop("tag").collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 60))] for _ in range(8)]
    docs = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                w += p[a : a + rng.randint(5, 60)]
        docs.append((d * 3, " ".join(w)))
    docs += [(500 + i, docs[i][1]) for i in range(10)]
    docs += [(600 + i, "the " * 90 + "end") for i in range(3)] + [(700, "is on. " * 60), (701, "on. is " * 50)]
    assert run(spark, docs, window=20, gram=5) == brute(docs, 20)


def test_edges(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, "short text"), (6, "x\t" + text.replace(" ", " \n ") + "\x0b"), (7, text.replace("a3 ", "b\x1c3 "))]
    assert run(spark, docs, window=20, gram=5) == brute(docs, 20)
    got = {r[0]: r for r in run(spark, docs, window=20, gram=5)}
    assert got[1][2] == 0 and got[2][2] == 30 and got[None][2] == 0 and got[3][1:3] == (0, 0) and got[6][2] == 30 and got[6][3] == "x"
    assert got[7][2] == 26 and got[7][1] == 30
    assert run(spark, [], window=20, gram=5) == []


def test_production_window_with_ids_of_several_texts(spark):
    """The production window; null ids, repeated ids with other texts, a very long text, a passage in every document."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    hot, other = ([rng.choice(vocab) for _ in range(n)] for n in (130, 55))
    docs = [(d, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 40))] + hot[d % 7 :] + ([] if d % 3 else other) + [rng.choice(vocab)])) for d in range(0, 80, 2)]
    long = [rng.choice(vocab) for _ in range(30_000)]
    docs += [(90, " ".join(long)), (91, " ".join(long[:200] + ["x"] + long[200:])), (None, docs[0][1]), (None, docs[1][1]), (4, " ".join(other)), (4, "z " + docs[0][1])]
    assert run(spark, docs) == brute(docs, 50)
