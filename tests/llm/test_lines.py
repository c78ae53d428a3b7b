import random

from tidepanel.llm.lines import Bounds, dedup_lines, distance, removed_lines


def edit(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def near(v, w, bounds):
    if max(len(v), len(w)) >= bounds.min_words:
        k = min(bounds.most_edits, max(len(v), len(w)) // bounds.words_per_edit)
        return abs(len(v) - len(w)) <= k and edit(v, w) <= k
    x, y = " ".join(v), " ".join(w)
    k = min(bounds.most_char_edits, max(len(x), len(y)) // bounds.chars_per_edit)
    return x == y or abs(len(x) - len(y)) <= k and edit(x, y) <= k


def brute(docs, bounds):
    """Documents in order; of those with one id, in the order they are given."""
    seen, out = [], []
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        kept, lines = [], t.split("\n") if t is not None else []
        for line in lines:
            w = line.split()
            if w and d is not None:
                gone = w in seen or any(near(v, w, bounds) for v in seen)
                seen.append(w)
                if gone:
                    continue
            kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_distance():
    rng = random.Random(3)
    for _ in range(500):
        x = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        y = list(x) if rng.random() < 0.7 else [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 9)):
            i, kind = rng.randrange(len(y) + 1), rng.randint(0, 2)
            y[i : i + (kind != 0)] = [rng.choice("abcd")] if kind != 2 else []
        assert distance(x, y, 1000) == edit(x, y) and all((distance(x, y, k) <= k) == (edit(x, y) <= k) for k in (0, 1, 3, 8))


def invented(rng, sizes, docs, spoil):
    vocab = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    pool = [[rng.choice(vocab) for _ in range(rng.choice(sizes))] for _ in range(25)]
    hot = [rng.choice(vocab) for _ in range(40)]
    out = []
    for d in range(docs):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice([*pool, hot, hot, hot]))
            for _ in range(rng.choice(spoil)):
                i, kind = rng.randrange(len(w) + 1), rng.randint(0, 2)
                w[i : i + (kind != 0)] = [rng.choice(vocab)] if kind != 2 else []
            t = rng.choice([" ", "  ", "\t"]).join(w)
            if rng.random() < 0.4:
                i = rng.randrange(len(t) + 1)
                t = t[:i] + rng.choice(["ü", " ", "", "x"]) + t[i + rng.randint(0, 1) :]
            lines.append(t)
        out.append((d, "\n".join(lines)))
    return out


def test_against_brute_force(spark):
    """The production bounds and narrower ones: word edits in long lines, character edits in short ones, lines about the border, a group of many near copies."""
    for seed, bounds in ((11, Bounds()), (12, Bounds(min_words=5, words_per_edit=5, most_edits=3, chars_per_edit=10, most_char_edits=1))):
        docs = invented(random.Random(seed), [1, 3, 5, 8, 9, 10, 11, 14, 19, 20, 22, 40], 60, [0, 1, 1, 2, 3, 4, 5, 6])
        docs += [(80, None), (81, ""), (82, "\n\n"), (None, docs[3][1]), (83, docs[5][1]), (83, docs[5][1])]
        df = spark.createDataFrame([(d, t, "z", 1) for d, t in docs], "doc_id long, text string, line string, tag int")
        want = brute(docs[:-1], bounds)
        want.append(next(r for r in want if r[0] == 83))
        assert sorted((tuple(r) for r in dedup_lines(df, bounds=bounds).collect()), key=str) == sorted(want, key=str)
        assert sum(r[2] for r in want) > 15
    for most in (8, 1):
        got = {(r.doc_id, i) for r in removed_lines(df, bounds=bounds, most=most).collect() for i in r.removed}
        assert len(got) == sum(r[2] for r in want[:-1])
    assert dedup_lines(df.limit(0)).collect() == []


def test_texts_of_one_id_lose_no_line_that_stands_once(spark):
    rows = [(1, "alpha beta"), (2, "alpha beta"), (2, "gamma delta"), (3, "gamma delta\nnew")]
    got = sorted(map(tuple, dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, 0, "alpha beta"), (2, 1, 0, "gamma delta"), (2, 1, 1, ""), (3, 2, 1, "new")]


def test_very_long_lines(spark):
    w = [f"w{i}" for i in range(20_000)]
    v = list(w)
    for i in (5, 9_000, 15_000, 19_999):
        v[i] = "other"
    far = [*v]
    far[77] = "fifth"
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(far))]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1}
