import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import citations, prompt


def respond(spark, texts, valid):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = df.withColumn("valid", F.array(*[F.lit(v) for v in valid]).cast("array<decimal(38,0)>"))
    return citations.response(df).orderBy("i").collect()


@pytest.mark.parametrize(
    "text, valid, final, numbers",
    [
        ("Caches [8] age, see [2]; [8] says how.", [2, 8], "Caches [1] age, see [2]; [1] says how.", {8: 1, 2: 2}),
        ("[6] opens [44] ports", [6], "[1] opens ports", {6: 1}),
        ("Reads [2], then [31].", [2], "Reads [1], then .", {2: 1}),
        (" \n\n\n Ends [4]\n\n\n\n and [4]\n ", [4], "Ends [1]\n\n and [1]", {4: 1}),
        ("[9][1]", [1], "[2]", {1: 2}),
        ("[007] a", [7], "[1] a", {7: 1}),
        ("[99999999999999999999999999999999999999999] a", [1], "a", {}),
        ("", [1], "", {}),
    ],
)
def test_rewrite(spark, text, valid, final, numbers):
    row = respond(spark, [text], valid)[0]
    assert row.final_text == final and {int(c.old_index): c.new_index for c in row.citations} == numbers


def test_warnings_and_null(spark):
    rows = respond(spark, ["A lock [3] waits, as [57] has it.", None], [3])
    assert rows[0].warnings == ["unknown citation [57]"] and rows[1].citations == [] and rows[1].final_text == ""


parts = st.lists(st.one_of(st.sampled_from(["word", "a", " ", "x.", "\n"]), st.integers(1, 32).map(lambda n: f"[{n}]")), max_size=16).map(" ".join)


@settings(max_examples=10, deadline=None)
@given(st.lists(parts, min_size=1, max_size=8), st.lists(st.integers(1, 32), min_size=1, max_size=8))
def test_cited_and_hallucinated_part_the_markers(spark, texts, valid):
    for text, row in zip(texts, respond(spark, texts, valid)):
        every = list(dict.fromkeys(int(m) for m in re.findall(r"\[(\d+)\]", text)))
        cited, unknown = [int(c.old_index) for c in row.citations], [int(h) for h in row.hallucinated]
        assert sorted(cited + unknown) == sorted(every) and set(cited) <= set(valid) and not set(unknown) & set(valid)
        assert cited == [m for m in every if m in valid]
        assert [c.new_index for c in row.citations] == [every.index(m) + 1 for m in cited]


def test_actions(spark):
    df = spark.createDataFrame([(1, 1, "a", "A1"), (1, 2, "b", "B"), (1, 3, "a", "A3"), (1, 4, None, "none")], "doc int, new_index int, source_ref string, label string")
    assert [(r.kind, r.label, r.source_ref) for r in citations.download_actions(df, "doc").orderBy("new_index").collect()] == [("download", "A1", "a"), ("download", "B", "b")]


def test_labels_preview_extras(spark):
    rows = [("1", "T", 3, None, "a" * 350, "p"), ("2", "T", None, "S", "b", "p"), ("3", "T", 9, "S", "c", "p"), ("4", "T", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, book_title string, page_number int, section_title string, text string, source_file_path string").withColumn("chunk_index", F.lit(5))
    got = [r.c for r in df.select(citations.citable_chunk().alias("c")).collect()]
    assert [r.label for r in got] == ["T, p. 3", "T — S", "T, p. 9 — S", "T"] and len(got[0].preview) == 200
    assert got[2].extras.asDict() == {"book_title": "T", "page_number": 9, "section_title": "S", "chunk_index": 5} and got[3].source_ref is None
    doc = spark.createDataFrame([("7", "pkg", "f/1", "text", "http://u.test", "1.0", "elixir", "web")], "id string, package string, title string, text string, url string, version string, language string, source string")
    cited = doc.select(citations.citable_document().alias("c")).first().c
    assert (cited.label, cited.source_ref, cited.extras.version) == ("pkg — f/1", "http://u.test", "1.0")
    chunk_map = doc.select(F.lit(2).alias("idx"), citations.citable_document().alias("metadata"))
    asked = spark.createDataFrame([(1, 2, 1), (1, 9, 2)], "doc int, old_index int, new_index int")
    assert [(r.doc, r.new_index, r.label) for r in citations.resolve(asked, chunk_map).collect()] == [(1, 1, "pkg — f/1")]


def test_layouts(spark):
    row = spark.range(1).select(
        prompt.chunk_context(F.lit("T"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("x")).alias("c"), prompt.document_context(F.lit("p"), F.lit("f/1"), F.lit(None).cast("string"), F.lit("x")).alias("d")
    ).first()
    assert row.c == "Book: T | Page: \nSection: (none)\n\nx" and row.d == "Package: p | Function: f/1\nURL: \n\nx"


def test_history(spark):
    df = spark.createDataFrame([("c", t, f"t{t}") for t in range(13)], "conv_id string, turn int, text string")
    rows = prompt.history_pairs(df).orderBy("ordinal").collect()
    assert [r.text for r in rows] == [f"t{t}" for t in range(2, 12)] and rows[0].role == "user" and rows[-1].role == "assistant"
    assert prompt.history_pairs(df.where("turn = 0")).count() == 0


def test_messages(spark):
    built = spark.range(1).select(prompt.messages(F.lit("q"), F.lit("[1] x"), F.lit(None).cast("array<struct<role:string,content:string>>")).alias("m")).first().m
    assert [m.role for m in built] == ["system", "user"] and built[0].content.endswith("[1] x")
    nothing = spark.range(1).select(prompt.messages(F.lit("q"), F.lit(None).cast("string"), F.array().cast("array<struct<role:string,content:string>>")).alias("m")).first().m
    assert nothing[0].content == prompt.WITHOUT_CONTEXT
