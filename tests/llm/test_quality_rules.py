import re


from corpuslens.llm import quality_rules as qr


def by_definition(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    base = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), base)


def measured(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, v int")
    return [tuple(r)[:5] + (r.base_failed,) for r in qr.quality(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "doc_id").orderBy("doc_id").collect()]


WORDS = ["the", "a", "b", "ä😀", "#x", "it's", "\n", "\t", "\x0b", "\xa0", "a b c", "a b c a b c", "\n\n", "of"]


def test_measures_by_definition(spark):
    import random

    rng = random.Random(1)
    texts = [None, "", " ", "one", "a b", "a b c", "a b c a", "a a a a", "a a a a a a a", "x\ny\nx\n \n \n", "a\r\na\r\na"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    texts += ["word " * 2000, " ".join(f"w{i}" for i in range(3000)), "z" * 100_000]
    for t, got in zip(texts, measured(spark, texts), strict=True):
        assert got == by_definition(t), repr(t)[:200]


def test_verdicts_columns_and_empty_table(spark):
    good = " ".join(f"the word{i} of" for i in range(40))
    rows = [(1, good, "a", 1), (2, None, "b", 2), (3, "% & " * 100, "c", 3), (4, "the cat and a dog " * 50, "d", 4), (None, good, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    out = qr.filtered(df)
    assert out.columns == df.columns and sorted(r[3] for r in out.collect()) == [1, 5]
    assert {(r.n_words, r.kept) for r in qr.quality(df).filter("doc_id = 2 or doc_id = 1").collect()} == {(120, True), (0, False)}
    assert qr.quality(df.limit(0)).collect() == []
    assert "Exchange" not in qr.quality(df)._jdf.queryExecution().executedPlan().toString()


def test_stop_words_are_asked_of_known_languages_only(spark):
    text = " ".join(f"sana{i % 70}x" for i in range(80))
    df = spark.createDataFrame([(1, text, "fi"), (2, text, "en"), (3, text, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.kept for r in qr.quality(df).collect()} == {1: True, 2: False, 3: False}
    assert [r.doc_id for r in qr.filtered(df).collect()] == [1]
    assert {r.kept for r in qr.quality(df.drop("lang")).collect()} == {False}
