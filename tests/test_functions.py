import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import textops
from tessera.functions.vectors import cosine




@pytest.mark.parametrize(
    "a, b, expected",
    [([0, 3, 4], [0, 6, 8], 1), ([2, 0], [0, 7], 0), ([0, 5], [0, -2], -1), ([0, 0], [3, 1], 0.0), ([2, 1, 2], [1, 4, 8], 22 / 27), ([3, 0], [2, 0, 9], 1), ([], [4], 0.0), (None, [4], 0.0)],
)
def test_cosine(spark, a, b, expected):
    row = spark.createDataFrame([(a and [float(x) for x in a] or a, [float(x) for x in b])], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert row.c == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("text, words", [("a b  c", 3), ("", 0), (None, 0), ("\n\t ", 0), ("x\ny", 2)])
def test_words_and_trim(spark, text, words):
    row = spark.createDataFrame([(text,)], "x string").select(textops.word_count(F.col("x")).alias("n"), textops.trim(F.col("x")).alias("t")).first()
    assert row.n == words and (row.t == text.strip() if text is not None else row.t is None)


def test_titles_and_numbers(spark):
    rows = spark.createDataFrame([("Microsoft Word - Lo\x07cks, p. 31",), ("",), (None,), ("12ab",), (" Microsoft Word - x",), ("Un\ufffdread\x7f ",)], "x string")
    assert [r.v for r in rows.select(textops.display_title(F.col("x")).alias("v")).collect()] == ["Locks, PDF page 31", "", "Untitled", "12ab", "Microsoft Word - x", "Unread\x7f"]
    assert rows.select(textops.leading_int(F.col("x")).alias("v")).collect()[3].v == 12
    made = textops.title_or_fallback(F.lit(" "), F.lit("\n  First line \nx"), F.lit("a/b.pdf"))
    assert rows.select(made.alias("v")).first().v == "First line"


def test_path_confinement(spark):
    rows = spark.createDataFrame([("lib/a",), ("lib",), ("library/a",), ("lib/../x",)], "x string")
    assert [r.v for r in rows.select(textops.under_root(F.col("x"), "lib").alias("v")).collect()] == [True, True, False, False]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_nul_stripping_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t.encode("utf-8", "replace").decode(),) for t in texts], "x string")
    once = df.select(textops.strip_nul(F.col("x")).alias("x"))
    assert once.collect() == once.select(textops.strip_nul(F.col("x")).alias("x")).collect()
    assert not any("\0" in r.x for r in once.collect())
