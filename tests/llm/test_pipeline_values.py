"""The deduplicating stages on planted documents: the whole expected rows, with null and repeated ids and columns of clashing names."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tidepanel_new string, tag long, removed int, leads boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", -1 if t is None else len(t), "x", 1, 2, True) for i, t in rows], SCHEMA)


def found(df, docs):
    assert df.columns == docs.columns and df.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = df.collect()
    assert all((r.lang, r.source, r._tidepanel_new, r.tag, r.removed, r.leads) == ("en", "s", "x", 1, 2, True) for r in rows)
    assert all(r.n_chars == (-1 if r.text is None else len(r.text)) for r in rows)
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10_000)}" for _ in range(n))


def test_line_dedup(spark):
    line, near, other = words(1, 14), words(1, 14).rsplit(" ", 1)[0] + " changed", words(2, 14)
    rows = [(1, f"{line}\n{other}"), (2, f"{words(3, 9)}\n{near}\n\nshort"), (3, line), (4, words(4, 40)), (None, line), (5, None), (5, f"{other}\n{words(5, 12)}"), (5, words(6, 12)), (7, ""), (8, f"  {other}  \nend of it here")]
    docs = frame(spark, rows)
    want = [(1, f"{line}\n{other}"), (2, f"{words(3, 9)}\n\nshort"), (4, words(4, 40)), (None, line), (5, None), (5, words(5, 12)), (5, words(6, 12)), (7, ""), (8, "end of it here")]
    assert found(corpus_pipeline.line_dedup(spark, docs, ""), docs) == sorted(want, key=str)


def test_near_dedup(spark):
    text, one = words(7, 120), words(7, 120).replace(words(7, 120).split()[60], "new")
    rows = [(1, text), (2, one), (3, words(8, 120)), (4, text), (4, words(9, 60)), (6, words(9, 60)), (None, text), (7, None), (8, ""), (9, words(10, 3)), (9, words(11, 3))]
    docs = frame(spark, rows)
    want = [(1, text), (3, words(8, 120)), (4, words(9, 60)), (None, text), (7, None), (8, ""), (9, words(10, 3)), (9, words(11, 3))]
    assert found(corpus_pipeline.near_dedup(spark, docs, ""), docs) == sorted(want, key=str)


def test_substring_dedup(spark):
    passage = words(12, 60)
    rows = [(1, f"{words(13, 5)} {passage} {words(14, 5)}"), (2, f"{words(15, 5)}  {passage}\n{words(16, 5)}"), (3, passage), (4, words(17, 80)), (5, passage.rsplit(" ", 11)[0]), (None, passage), (6, None), (7, passage), (7, words(18, 70)), (8, "")]
    docs = frame(spark, rows)
    want = [rows[0], (2, f"{words(15, 5)} {words(16, 5)}"), rows[3], rows[4], rows[5], rows[6], (7, words(18, 70)), (8, "")]
    assert found(corpus_pipeline.substring_dedup(spark, docs, ""), docs) == sorted(want, key=str)


def test_empty_tables(spark):
    docs = frame(spark, [])
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup):
        assert stage(spark, docs, "").collect() == []
