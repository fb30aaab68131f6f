import time

import numpy as np
import pandas as pd

from tessera.llm import reading


def test_prose_leaves_out_what_is_no_prose():
    text = "# Head\n\nFirst line here. It is plain.\n\n```\nlet x = 1;\n```\n* item\n1. item\n| a | b |\n    indented = code\n> quote\nimport a.b\nSee [this](http://x.example) and `code` [3].\nhttp://only.example\n"
    kept = reading.prose(text)
    for gone in ("Head", "let", "item", "indented", "quote", "import", "http", "code", "3"):
        assert gone not in kept
    assert "First line here." in kept and "See [this" in kept
    assert reading.prose("a\r\n```\r\nb\r\n") .strip() == "a"


def test_sentences():
    assert reading.sentences("One here. Two (cf. ch. 5) there! Three?") == ["One here.", "Two (cf. ch. 5) there!", "Three?"]
    assert reading.sentences("") == []


def test_english():
    assert reading.is_english("the cat is on a mat and it is old".split())
    assert not reading.is_english("die Katze sitzt auf der Matte und schläft".lower().split()) and not reading.is_english([])


def held_out(spark, sf):
    docs, ratings = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/reading_ratings.parquet")
    rows = docs.join(ratings.where("school_years is not null"), "doc_id").groupBy("doc_id").agg({"text": "first", "school_years": "avg"}).orderBy("doc_id").collect()
    return [(r[1], r[2]) if isinstance(r[1], str) else (r[2], r[1]) for r in rows]


def test_held_out_accuracy(spark):
    rows = held_out(spark, "/root/testdata/sf0.1")
    half = len(rows) // 2
    model = reading.fit([t for t, _ in rows[:half]], [y for _, y in rows[:half]])
    features, error, right = reading._Features(), [], []
    for text, years in rows[half:]:
        sizes, words, chars, _ = features.of(reading.prose(text))
        got = model.difficulty(model.distributions(words, chars), np.array(sizes))
        error.append(abs(got - years))
        right.append((got > 14) == (years > 12.5))
    assert np.mean(error) < 1.3 and np.mean(right) > 0.97


def test_odd_rows(spark):
    model = reading.fit([], [])
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "the cat is on the mat. " * 5_000), (4, "the cat is on the mat."), (None, "it is so"), (5, "```\ncode\n```"), (6, "猫は好きです。")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, english string")
    got = reading.reading_levels(df, model).collect()
    assert len(got) == len(rows) and {r.doc_id: r.english for r in got if r.doc_id in (1, 2, 3, 5, 6)} == dict.fromkeys((1, 2, 3, 5, 6), False)
    assert all(1 <= r.school_years <= 18 for r in got if r.english) and sum(r.english for r in got) == 3
    assert reading.reading_levels(df.limit(0), model).count() == 0
    empty = spark.createDataFrame([], "doc_id int, school_years int")
    assert reading.fit_on_ratings(df, empty).years.tolist() == [9.0] * reading.LEVELS


def scorer(spark, monkeypatch, model):
    """What a task does with a batch of texts."""
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    seen = []
    plain = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: seen.append(f) or plain(self, f, schema))
    reading.reading_levels(df, model)
    return lambda texts: [r[1:] for out in seen[0](iter([pd.DataFrame({"key": range(len(texts)), "text": texts})])) for r in out.itertuples(index=False)]


def some_model():
    r = np.random.default_rng(1)
    weights = [r.normal(0, 9, (n, reading.LEVELS)).astype(np.float32) for n in (reading.WORD_BUCKETS, reading.CHAR_BUCKETS)]
    return reading.LevelModel(*weights, np.array([0.1, 0.2, 0.3, 0.4], np.float32), np.array([3.0, 7.0, 10.0, 16.0]))


def test_batches_score_like_single_sentences(spark, monkeypatch):
    monkeypatch.setattr(reading, "KNOWN_WORDS", 40)
    monkeypatch.setattr(reading, "CHUNK_WORDS", 60)
    base = "The cat is on the mat. It’s old, and so is the don't-care ΑΣ naïve dog (see e.g. the fig. 3)! \"Is it?\" 12 34. 5.\n\n6 7.\n\n"
    texts = [None, "", base, "7. 8. 9.\n\n" + base, "die Katze schläft", base * 40, "İt is the K of a \ud800x \x00 and it is so.", "a", " ".join(f"the{chr(97 + i % 26)}{chr(97 + i // 26)} is a" for i in range(200))] * 3
    model, features = some_model(), reading._Features()
    got = scorer(spark, monkeypatch, model)(texts)
    assert len(got) == len(texts)
    for text, (english, n, sentences, years, shares) in zip(texts, got):
        running = reading.prose(text or "")
        words = reading._WORD.findall(running.lower())
        assert (english, n) == (reading.is_english(words), len(words))
        if english:
            sizes, w, c, _ = features.of(running)
            found = model.distributions(w, c)
            assert sentences == len(sizes) and abs(years - model.difficulty(found, np.array(sizes))) < 1e-4
            assert np.allclose(shares, np.average(found, axis=0, weights=sizes), atol=1e-5)


def test_scoring_costs_few_passes_over_the_text(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    score = scorer(spark, monkeypatch, some_model())

    def least(f):
        took = []
        for _ in range(4):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    one_pass = least(lambda: [reading._WORD.findall(t.lower()) for t in texts if t])
    assert least(lambda: score(texts)) < 4 * one_pass
