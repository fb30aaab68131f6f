import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import candidates, corpus, expand, index, lexical, predicates, rank, search, vector
from tessera.spec import CorpusSpec, RetrievalQuery


def test_builder_keeps_order_and_omits_min_score():
    q = RetrievalQuery.new("i").match("a", ["t"]).knn("e", [1.0], 3).match("b", ["t"]).filter_term("s", 1).with_size(5).with_size(7)
    body = q.to_map()
    assert [c["multi_match"]["query"] for c in body["query"]["bool"]["should"]] == ["a", "b"]
    assert body["size"] == 7 and "min_score" not in body and q.with_min_score(0.2).to_map()["min_score"] == 0.2
    with pytest.raises(ValueError):
        q.knn("e", [1.0], 0)


def fused(spark, rows):
    df = spark.createDataFrame([(1, i, b, c) for i, (b, c) in enumerate(rows)], "query_id int, id int, backend_score double, cosine_score double")
    return [r.relevance_score for r in rank.fuse(df).orderBy("id").collect()]


def test_minmax_fuse(spark):
    assert fused(spark, [(0.6, 0.2), (None, 0.7)]) == [0.5, 1.0]
    assert fused(spark, [(0.61, 0.44)]) == [1.0]
    assert fused(spark, [(0.25, 0.75), (0.25, 0.75)]) == [1.0, 1.0]
    assert fused(spark, [(0.2, 0.1), (0.6, 0.5), (0.4, 0.2)]) == [0.0, 1.0, 0.375]
    assert fused(spark, []) == []


def context(spark, scores):
    df = spark.createDataFrame([(1, "b", i, i, s) for i, s in enumerate(scores)], "query_id int, parsed_book_id string, chunk_index int, id int, relevance_score double")
    return [(r.prompt_index, r.relevance_score) for r in rank.prepare_context(df).orderBy("prompt_index").collect()]


def test_prepare_context(spark):
    assert [s for _, s in context(spark, [0.31, 0.3, 0.29, 0.84, 0.0])] == [0.84, 0.31, 0.3]
    assert len(context(spark, [0.62] * 13)) == 10
    assert [i for i, _ in context(spark, [0.12, 0.77, 0.21, 0.64, 0.02])] == [1, 2]
    assert context(spark, [0.66, None])[0] == (1, None)
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    df = spark.createDataFrame([(1, 0.45)], "query_id int, relevance_score double")
    assert {r.query_id: r.quality for r in rank.context_quality(queries, df).collect()} == {1: "good", 2: "none"}


def merged(indexes, offset):
    out = []
    for i in sorted(set(indexes)):
        low, high = max(i - offset, 0), i + offset
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def ranges(spark, indexes, offset=2):
    hits = spark.createDataFrame([("b", i) for i in indexes], "parsed_book_id string, chunk_index int")
    return sorted((r.low, r.high) for r in expand.merged_ranges(hits, offset).collect())


def test_ranges(spark):
    assert ranges(spark, [0, 1, 9]) == [(0, 3), (7, 11)]
    assert ranges(spark, [2, 7]) == [(0, 9)]
    assert ranges(spark, []) == []


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=12), st.integers(0, 4))
def test_ranges_match_the_sequential_rule(spark, indexes, offset):
    assert ranges(spark, indexes, offset) == merged(indexes, offset)


def test_expand_is_an_equi_join(spark):
    chunks = spark.createDataFrame([(i, "b", i) for i in range(10)], "id int, parsed_book_id string, chunk_index int")
    out = expand.expand(chunks.where("id in (0, 5)"), chunks)
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_knn_against_brute_force(spark):
    units = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)] + [(90, None), (91, [1.0]), (92, [float("nan"), 1.0, 1.0])], "id int, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None)], "query_id int, vector array<double>")
    got = vector.knn(units, queries, 5).orderBy("query_id", "rank").collect()

    def score(a, b):
        n = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round((1 + (sum(x * y for x, y in zip(a, b)) / n if n else 0.0)) / 2, 6)

    for q, v in ((1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0])):
        best = sorted(((-score(v, [i % 7, 1, i % 3]), i) for i in range(50)))[:5]
        assert [(r.id, r.backend_score) for r in got if r.query_id == q] == [(i, -s) for s, i in best]
    assert vector.knn(units.limit(0), queries, 5).count() == 0 and vector.knn(units, queries.limit(0), 5).count() == 0


def test_grid_of_blocks_gives_the_same(spark, monkeypatch):
    rows = [(i, [float(i % 11), float(i % 5), 1.0]) for i in range(90)]
    units = spark.createDataFrame(rows, "id int, embedding array<double>")
    queries = units.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    want = vector.knn(units, queries, 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(vector, "QUERY_BLOCK", 20)
    monkeypatch.setattr(vector, "UNIT_BLOCK", 25)
    assert vector.knn(units, queries, 4).orderBy("query_id", "rank").collect() == want and len(want) == 360


def test_hybrid_never_adds_rows_and_title_is_exact(spark):
    units = spark.createDataFrame([(1, "alpha beta", "alpha", [1.0, 0.0]), (2, "alpha", "x", [0.0, 1.0]), (3, "beta beta", "alpha", [0.9, 0.1])], "id int, text string, title string, embedding array<double>")
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "query_id int, text string, vector array<double>")
    got = {r.id: r.score for r in search.hybrid(units, queries, {"text": 1.0, "title": 3.0}, k=2).collect()}
    assert set(got) == {1, 3} and got[1] == pytest.approx(1.0 + 0.8 * 3.0) and got[3] > 0.8 * 3.0
    assert {r.id for r in search.keyword(units, queries, {"text": 1.0}).collect()} == {1, 2}
    assert lexical.bm25(units, queries.limit(0)).count() == 0


def test_execute_adds_clauses(spark):
    units = spark.createDataFrame([(1, "a b", [1.0, 0.0], "s"), (2, "b", [0.5, 0.5], "s"), (3, "a", [1.0, 0.1], "t")], "id int, text string, embedding array<double>, source string")
    q = RetrievalQuery.new("i").knn("embedding", [1.0, 0.0], 2).knn("embedding", [1.0, 0.0], 2).filter_term("source", "s")
    assert [r.score for r in search.execute(units, q).orderBy("rank").collect()][0] == 2.0
    assert search.execute(units, q.with_min_score(1.9)).count() == 1
    assert search.execute(units, RetrievalQuery.new("i").match("a", ["text"])).count() == 2


def test_hydrate_keeps_order_and_repeats(spark):
    hits = spark.createDataFrame([("b", 1), ("a", 2), ("zz", 3), ("b", 4)], "id string, rank int")
    units = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, text string")
    assert [r.text for r in search.hydrate(hits, units).orderBy("hit_rank").collect()] == ["B", "A", "B"]


def results(spark, rows):
    return spark.createDataFrame([(1, i, n, ref, page, "t" * 150, None, "label") for n, (i, ref, page) in enumerate(rows)], "query_id int, id string, rank int, source_ref string, page_number int, text string, book_title string, label string")


def test_grouping_selection_labels(spark):
    df = results(spark, [("c1", "A", 5), ("c2", "B", 7), ("c3", "A", 2), ("c4", None, None)])
    groups = candidates.group_by_document(df).orderBy("position").collect()
    assert [r.id for r in candidates.all_chunk_ids(candidates.group_by_document(df)).orderBy("ordinal").collect()] == ["c1", "c3", "c2", "c4"]
    assert [(g.document, g.chunk_ids) for g in groups] == [("A", ["c1", "c3"]), ("B", ["c2"]), ("c4", ["c4"])]
    labels = {r.document: (r.page_label, len(r.preview)) for r in candidates.document_metadata(df).collect()}
    assert labels == {"A": ("PDF pages 2-5", 100), "B": ("PDF page 7", 100), "c4": (None, 100)}
    chosen = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "none")], "query_id int, selected_pos int, document string")
    assert [r.id for r in candidates.expand_selection(chosen, df).orderBy("ordinal").collect()] == ["c1", "c3", "c2"]
    asked = spark.createDataFrame([(1, "c1"), (1, "q")], "query_id int, id string")
    assert [r.id for r in candidates.unknown_selection(asked, df).collect()] == ["q"]
    assert [(r.id, r.selection_index) for r in candidates.selected(df, asked).collect()] == [("c1", 1)]


def test_page_chunks_densify(spark):
    rows = [(1, "b", 1, "x", 1), (2, "b", 3, " ", 1), (3, "b", 6, "y z", 1), (4, "b", 6, "newer", 2), (5, "b", 8, None, 1), (6, "b", 9, "w", 1)]
    pages = spark.createDataFrame(rows, "page_id int, parsed_book_id string, page_number int, text string, extracted_at int")
    assert [(r.page_number, r.chunk_index, r.text) for r in corpus.page_chunks(pages).orderBy("chunk_index").collect()] == [(1, 0, "x"), (6, 1, "newer"), (9, 2, "w")]
    assert corpus.book_totals(pages).first().total_pages == 5


def test_predicates(spark):
    df = spark.createDataFrame([("b", 3), ("b", None), ("c", 9)], "parsed_book_id string, page_number int")
    assert df.where(predicates.by_book("b") & predicates.within_pages(4, 1)).count() == 1
    assert df.where(predicates.on_page(9)).count() == 1
    assert df.select(predicates.without_blanks(F.array(F.lit(""), F.lit("a"))).alias("x")).first().x == ["a"]


def test_an_index_from_the_schema(spark, tmp_path):
    units = spark.createDataFrame([(1, "alpha beta beta", "t", [1.0], True), (2, "gamma", "u", [2.0], False), (3, None, "v", None, None)], "id int, text string, title string, embedding array<float>, core boolean")
    made = index.build(units, str(tmp_path / "i"))
    assert made.kinds == {"id": "number", "text": "text", "title": "keyword", "embedding": "vector", "core": "flag"}
    held = made.postings(spark)
    assert {(r.id, r.term, r.tf, r.length) for r in held.collect()} == {(1, "alpha", 1, 3), (1, "beta", 2, 3), (1, None, 1, 3), (2, "gamma", 1, 1), (2, None, 1, 1), (3, None, 1, 0)}
    queries = spark.createDataFrame([(1, "beta gamma"), (2, "beta"), (3, "nothing")], "query_id int, text string")
    plain = {(r.query_id, r.id): r.score for r in lexical.bm25(units, queries).collect()}
    assert plain == {(r.query_id, r.id): r.score for r in lexical.bm25(made.units(spark), queries, index=held).collect()} and set(plain) == {(1, 1), (1, 2), (2, 1)}
    among = spark.createDataFrame([(1, 2)], "query_id int, id int")
    assert [(r.query_id, r.id, r.score) for r in lexical.bm25(units, queries, among=among).collect()] == [(1, 2, plain[1, 2])]


def test_units_without_an_order_are_not_expanded(spark):
    units = spark.createDataFrame([(n, f"p{n}") for n in range(5)], "id int, package string")
    hits = spark.createDataFrame([(1, 2, 0.9), (1, 4, 0.8)], "query_id int, id int, backend_score double")
    got = search.with_context(units, hits, spec=CorpusSpec("docs", {"text": 1.0})).collect()
    assert {(r.id, r.hit_source) for r in got} == {(2, "search"), (4, "search")}


def test_page_groups(spark):
    rows = [(1, n, n, "b" if n < 4 else "c", page, None, f"text {n} " + "x" * 300) for n, page in enumerate([7, 2, 7, None, 5])]
    df = spark.createDataFrame(rows, "query_id int, id int, rank int, parsed_book_id string, page_number int, section_title string, text string")
    df = df.selectExpr("*", "upper(parsed_book_id) AS book_title", "'path' AS source_file_path", "90 AS total_pages")
    got = search.page_groups(df).orderBy("position").collect()
    assert [(r.book_title, r.hit_count, r.total_pages) for r in got] == [("B", 4, 90), ("C", 1, 90)]
    assert [(p.page_number, p.chunk_preview[:6], len(p.chunk_preview)) for p in got[0].pages] == [(2, "text 1", 200), (7, "text 0", 200), (None, "text 3", 200)]
