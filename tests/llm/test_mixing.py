import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from tidepanel.llm.mixing import mix_sources, repetitions, word_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, source string, size string, part int, target int"


def shares(sizes, weights, share, most):
    """Water-filling by exact fractions: clamp one turn's excess, share anew."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    rest, open_, out = Fraction(share) * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(w[n] for n in open_)
        over = {n for n in open_ if level * w[n] > Fraction(most) * sizes[n]}
        for n in over or open_:
            out[n] = Fraction(most) * sizes[n] if over else level * w[n]
        rest, open_ = rest - sum(out[n] for n in over), open_ - over if over else set()
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 9) for r in rows], COLUMNS)


def test_targets_and_words_taken(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["a", "éé", "中", "x-y"]) for _ in range(n))
    rows = [(i, words(rng.randint(0, 40)), rng.choice(["hot"] * 6 + ["a", "Z", "é", "😀", "tiny", None])) for i in range(600)]
    rows += [(None, words(5), "hot"), (None, None, "hot"), (1, words(9), "hot"), (1, words(9), "hot"), (2, "", "nothing"), (3, " \t\n", "nothing"), (4, words(30_000), "long")] + [(9, "same text", "a")] * 30
    sizes, n_rows = defaultdict(int), Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        n_rows[i, s, len(WORD.findall(t or ""))] += 1
    for share, most, part_rows in ((1.5, 2.0, 100), (0.4, 2.0, 10_000), (2.5, 2.0, 100), (3.0, 4.0, 100)):
        got = mix_sources(table(spark, rows), share=share, most=most, part_rows=part_rows).collect()
        assert Counter((r.doc_id, r.source, r.size) for r in got) == n_rows
        want, taken = shares(sizes, (3, 1, 2), share, most), defaultdict(int)
        for r in got:
            taken[r.source] += r.taken
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= most * r.size
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
        again = mix_sources(table(spark, rows).repartition(7), share=share, most=most, part_rows=part_rows // 3)
        assert sorted(map(str, again.collect())) == sorted(map(str, got))
    one, other = (mix_sources(table(spark, rows), share=0.4, seed=seed).collect() for seed in (17, 18))
    assert sorted(map(str, one)) != sorted(map(str, other))


def test_empty_and_wordless_tables(spark):
    assert mix_sources(table(spark, [])).collect() == []
    got = mix_sources(table(spark, [(1, None, None), (2, "", "s")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_word_count_on_odd_texts(spark):
    texts = ["", " ", "a", " a", "a ", "\x0b\x0ca\tb\r\n", "a b", "x" * 9, "\n\n", "中 文", None, "a b " * 50_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", word_count("text").alias("n")).orderBy("i").collect()
    assert [r.n or 0 for r in got] == [len(WORD.findall(t or "")) for t in texts]


def test_repetitions_hold_the_words_taken(spark):
    df = spark.createDataFrame([(1, "a b  c", 7), (2, "d e", 0), (3, "f\ng", 4), (4, "", 0), (5, "h i j", 2)], "doc_id long, text string, taken long")
    got = repetitions(df).orderBy("doc_id", "repetition").collect()
    assert [(r.doc_id, r.repetition, r.text) for r in got] == [(1, 0, "a b  c"), (1, 1, "a b  c"), (1, 2, "a"), (3, 0, "f\ng"), (3, 1, "f\ng"), (5, 0, "h i")]


def test_plan_is_native(spark):
    df = mix_sources(table(spark, [(1, "a b", "s")]))
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and df.where(F.col("taken") < 0).isEmpty()
