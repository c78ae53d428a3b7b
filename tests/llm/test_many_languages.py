from tidepanel.llm.language import fit_language


def test_rare_languages_are_learned(spark):
    words = {f"l{k:02}": chr(0x4E00 + 50 * k) + chr(0x4E07 + 50 * k) for k in range(7)}
    rows = [(100 * k + i, f"{w} {w[::-1]} " * 4, lang) for k, (lang, w) in enumerate(words.items()) for i in range(4 + 4 * (k < 3))]
    model = fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=3)
    assert all(model.predict(f"{w} {w[::-1]} {w}".encode())[0] == lang for lang, w in words.items())
