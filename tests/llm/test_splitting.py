import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting as s


@given(st.lists(st.integers(0, 5), min_size=1, max_size=200), st.data())
def test_sparse_table_gives_the_rightmost_maximum(values, data):
    table = s.SparseTable(np.array(values, np.int8), len(values))
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    best = max(values[low : high + 1])
    assert table.strongest(low, high) == max(i for i in range(low, high + 1) if values[i] == best)


@settings(max_examples=60)
@given(st.text(alphabet="ab. ,\n。é", max_size=900), st.integers(30, 90))
def test_pieces_cover_the_text(text, most):
    overlap, least = most // 6, most // 2
    pieces = s.cut_text(text, most, overlap, least)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b, k), (c, d, _) in zip(pieces, pieces[1:]):
        assert b - a <= most and c > a and b - overlap <= c <= b
    rebuilt = text[: pieces[0][1]]
    for (_, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        rebuilt += text[b:d]
    assert rebuilt == text


def test_cuts_at_the_strongest_boundary():
    text = "a" * 20 + ". " + "b" * 20 + "\n\n" + "c" * 20 + ", " + "d" * 30
    first = s.cut_text(text, 70, 0, 20)[0]
    assert text[: first[1]].endswith("\n\n") and s.BOUNDARIES[first[2]] == "paragraph"


def test_long_text_without_boundaries():
    pieces = s.cut_text("x" * 300_000, 3000, 200, 1500)
    assert all(b - a <= 3000 for a, b, _ in pieces) and len(pieces) == 1 + -(-(300_000 - 3000) // 2800)


def test_split_texts_on_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, "word " * 50, "x"), (4, "word " * 50, "x"), (5, "é" * 120, None)]
    df = spark.createDataFrame(rows, "id int, text string, piece_no string")
    out = s.split_texts(df, max_chars=100, overlap=10)
    got = out.orderBy("id", "piece_no_2").collect()
    assert set(out.columns) == {"id", "piece_no", "piece_no_2", "n_pieces", "piece_start", "piece_end", "cut_at", "piece_text"}
    assert {r.id for r in got} == {4, 5} and all(len(r.piece_text) <= 100 for r in got)
    assert sum(r.id == 4 and r.piece_no_2 == 0 for r in got) == 2  # repeated rows are split each for itself
    assert s.split_texts(df.limit(0), max_chars=100, overlap=10).count() == 0
    with pytest.raises(ValueError):
        s.split_texts(df, max_chars=100, overlap=90)


def brute_runs(pages, most, overlap):
    out, start = [], 0
    while len(pages) - start > most:
        out.append((pages[start], pages[start + most - 1]))
        start += most - overlap
    return out + [(pages[start], pages[-1])]


@pytest.mark.parametrize("stride", [50_000, 100])
def test_split_runs(spark, stride):
    numbers = [n for n in range(1, 260) if n % 9]
    rows = [("b", n, f"text {n}") for n in numbers] + [("b", 5, "again"), ("short", 1, "x"), (None, 3, "x"), ("b", None, None)]
    df = spark.createDataFrame(rows, "parsed_book_id string, page_number int, text string")
    got = s.split_runs(df, stride=stride).orderBy("run_no").collect()
    runs = [(r.first_page, r.last_page) for r in got]
    assert all(r.run_pages <= 60 and r.n_pages == len(numbers) for r in got)
    assert runs == brute_runs(numbers, 60, 2) and [r.run_no for r in got] == list(range(len(got)))
    covered = [numbers[numbers.index(a) : numbers.index(z) + 1] for a, z in runs]
    assert sorted({n for c in covered for n in c}) == numbers
    assert all(len(set(a) & set(b)) == 2 for a, b in zip(covered, covered[1:]))
    assert s.split_runs(df.limit(0)).count() == 0


def test_runs_prefer_chapters(spark):
    rows = [("b", n, "Chapter 2\nx" if n == 45 else "plain text") for n in range(1, 81)]
    got = s.split_runs(spark.createDataFrame(rows, "parsed_book_id string, page_number int, text string")).orderBy("run_no").collect()
    assert [(r.first_page, r.last_page) for r in got] == [(1, 44), (43, 80)]


def test_the_stride_changes_nothing(spark):
    """A book that holds most of the pages, with chapters, in strides of any size."""
    rnd = __import__("random").Random(5)
    rows = [("big", n, "CHAPTER " + "I" * 5 if rnd.random() < 0.03 else "text") for n in range(1, 3000)] + [("small", n, "x") for n in range(1, 70)]
    df = spark.createDataFrame(rows, "parsed_book_id string, page_number int, text string")
    every = [sorted(tuple(r) for r in s.split_runs(df, stride=stride).collect()) for stride in (61, 100, 777, 50_000)]
    assert every[0] == every[1] == every[2] == every[3]
    ends = {r[5] for r in every[0] if r[0] == "big"}
    assert len({n for _, n, t in rows if t != "text" and n - 1 in ends}) > 20


def test_headings_are_read_whole(spark):
    df = spark.createDataFrame([(" " * 300 + "\n\n Kapitel 4\nx",), ("THE " + "A" * 200 + "\nx",), ("plain\nCHAPTER 2",), (None,)], "t string")
    assert [r[0] for r in df.select(s.opens_chapter(df.t)).collect()] == [True, False, False, False]


def test_overlap_comes_close_to_what_was_asked_for():
    text = " ".join(["word"] * 2000)
    pieces = s.cut_text(text, 300, 40, 150)
    assert all(30 < a_end - b for (_, a_end, _), (b, _, _) in zip(pieces, pieces[1:]))


def test_found_matches_the_definition(spark, sf):
    from tessera.llm import queries

    got = {(r.item_kind, r.item_key) for r in queries.p4_found(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/page_contents.parquet")
    long = {("page", str(r.page_id)) for r in pages.where("length(text) > 3000").collect()}
    books = {("book", r.parsed_book_id) for r in pages.groupBy("parsed_book_id").agg({"page_number": "max"}).collect()}
    assert {g for g in got if g[0] == "page"} == long and {g for g in got if g[0] == "book"} <= books
