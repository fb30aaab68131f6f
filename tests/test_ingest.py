import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import dml, ingest
from tessera.providers import HashedEmbedder
from tessera.sources import files, sinks


def test_routing_keeps_order_and_one_letter_per_error(spark):
    rows = [(n, f"i{n}", None if n == 5 else n % 3 != 0, f"e{n}" if n % 3 == 0 else None) for n in range(9)]
    df = spark.createDataFrame(rows, "ordinal int, identifier string, ok boolean, error string")
    assert [r.ordinal for r in ingest.ok(df).collect()] == [1, 2, 4, 7, 8]
    letters = {r.input_identifier: r for r in ingest.dead_letters(df, "B", "I", "1.0.0", "docs.embed").collect()}
    assert set(letters) == {"i0", "i3", "i5", "i6"} and letters["i5"].error_text == "malformed result" and not letters["i0"].pipeline_fatal
    assert [r.ordinal for r in ingest.until_first_failure(df.where("ordinal > 0")).orderBy("ordinal").collect()] == [1, 2]


@pytest.mark.parametrize("indexed, failed, expected", [(0, 0, "ok"), (0, 3, "error"), (2, 3, "ok")])
def test_summary(spark, indexed, failed, expected):
    assert spark.range(1).select(ingest.summary(F.lit(indexed), F.lit(failed)).alias("x")).first().x == expected


def test_sweep_stops(spark):
    df = spark.createDataFrame([(n, 0) for n in range(6)], "id int, retry_count int")
    left, tally = ingest.sweep(df, lambda x: x.select("id", (F.col("id") % 2 == F.col("retry_count")).alias("resolved")))
    assert left.count() == 0 and [t["resolved"] for t in tally] == [3, 3]
    left, tally = ingest.sweep(df, lambda x: x.select("id", F.lit(False).alias("resolved")), most=5)
    assert len(tally) == 1 and left.count() == 6 and left.first().retry_count == 1
    assert ingest.sweep(df.limit(0), lambda x: x)[1] == []


def test_retry_targets_and_inputs(spark):
    df = spark.createDataFrame([("books.parse",), ("docs.index",), ("docs.parse",), (None,)], "step string")
    assert [r.t for r in df.select(ingest.retry_target(F.col("step")).alias("t")).collect()] == ["file", "document", "none", "none"]
    assert spark.range(1).select(ingest.embed_input(F.lit(None).cast("string"), F.lit("x")).alias("t")).first().t == "\n\nx"
    chunks = spark.createDataFrame([("b", 1, 0), ("b", 3, 2), ("b", 6, 5)], "parsed_book_id string, page_number int, chunk_index int").withColumn("id", F.col("page_number"))
    assert [r.chunk_index for r in ingest.densify(chunks).orderBy("page_number").collect()] == [0, 1, 2]
    skipped = spark.createDataFrame([("b", 9), ("b", 2)], "parsed_book_id string, page_number int")
    assert ingest.skipped_warning(skipped).first().warning == "skipped pages: 2, 9"


def test_table_changes(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, updated_at int")
    more = spark.createDataFrame([(2, "new", 1), (3, "c", 1), (1, "old", 0)], "id int, v string, updated_at int")
    assert {r.id: r.v for r in dml.upsert(df, more).collect()} == {1: "a", 2: "new", 3: "c"}
    assert {r.id: r.v for r in dml.update(df, F.col("id") == 1, v=F.lit("z")).collect()} == {1: "z", 2: "b"}
    assert dml.delete(df, more).count() == 0 and dml.get(df, 2).first().v == "b"
    with pytest.raises(LookupError):
        dml.get(df, 9)
    kids = spark.createDataFrame([(7, 1), (8, 2)], "id int, parsed_book_id int")
    parents, children = dml.delete_cascade(df, kids, df.where("id = 1"))
    assert [r.id for r in parents.collect()] == [2] and [r.id for r in children.collect()] == [8]


def test_validation(spark):
    df = spark.createDataFrame([("1", "x", "long title"), ("2", " ", None), ("3", "x", "ok")], "id string, text string, title string")
    got = {r.id: r.errors for r in schemas.validated(df, ["text"], [schemas.too_long("title", 5)], unique="text").collect()}
    assert got["2"] == ["text can't be blank"] and "title is longer than 5" in got["1"]
    assert sum("text has already been taken" in e for e in got.values()) == 1
    assert schemas.sanitise(spark.createDataFrame([("a\0b", 1)], "x string, n int")).first().x == "ab"


def test_checked_insert_and_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1)], "id int, v string, updated_at int")
    assert sinks.insert_checked(df, str(tmp_path / "t")) == 1
    path = str(tmp_path / "merged")
    sinks.merge(df, path)
    sinks.merge(spark.createDataFrame([(1, "b", 2), (2, "c", 1)], df.schema), path)
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "b", 2: "c"}
    folders = {p.name: p.stat().st_ino for p in (tmp_path / "merged").iterdir() if p.is_dir()}
    sinks.merge(spark.createDataFrame([(2, "d", 5)], df.schema), path)
    after = {p.name: p.stat().st_ino for p in (tmp_path / "merged").iterdir() if p.is_dir()}
    # only the folder of the key that came is written anew
    assert {r.id: r.v for r in spark.read.parquet(path).collect()} == {1: "b", 2: "d"} and sum(folders[n] != after[n] for n in folders) == 1
    bad = df.select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception):
        sinks.publish({path: df, str(tmp_path / "x"): bad}, spark)
    assert spark.read.parquet(path).count() == 2
    sinks.discard(df)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes("one\ftwo\f".encode() + b"\xff\xfe")
    (tmp_path / "b.txt").write_bytes(b"x")
    found = files.binaries(spark, str(tmp_path), "*.txt")
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path), "*.txt").collect()] == ["a.txt", "b.txt"]
    for name in ("zed/deep/1.txt", "zed/2.txt", "arc/3.txt", "0.txt"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path / "tree")).collect()] == ["3.txt", "1.txt", "2.txt", "0.txt"]

    def parser(content):
        if content == b"x":
            raise ValueError("broken file")
        return files.plain_text_pages(content)

    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(found, parser).collect()}
    assert [p.text for p in got["a.txt"].pages] == ["one", "two"] and got["a.txt"].skipped[0].page_number == 3
    assert not got["b.txt"].ok and got["b.txt"].error == "broken file"


def test_documented_functions():
    source = """defmodule Store do
  @doc \"\"\"
  Puts a value.

      def in_an_example(x) do
  \"\"\"
  @spec put(map, term) :: map
  def put(store, value) do
    if value do
      Map.put(store, :v, value)
    end
  end

  def hidden(x), do: x

  @doc "A head."
  def head(x)

  @doc false
  defp g(x) when x > 1 do
    x
  end
end
"""
    found = dict(files.documented_functions(source))
    assert list(found) == ["put/1", "hidden/1", "head/0", "when/1"]
    assert found["put/1"].startswith("Puts a value.") and found["put/1"].endswith("def put(store, value) do\n  if value do\n    Map.put(store, :v, value)\n  end\nend")
    assert found["hidden/1"] == "\n\ndef hidden(x), do: x" and found["head/0"] == "A head.\n\ndef head(x)" and found["when/1"].endswith("x\nend")
    assert files.documented_functions("no module") == [] and files.documented_functions(source + source) == []


def test_retry_lookups_and_what_a_run_added(spark):
    failures = spark.createDataFrame([("f1", "Enum@x", "1.0"), ("f2", "Enum@x", "2.0"), ("f3", None, "1.0")], "id string, input_identifier string, version string")
    raw = spark.createDataFrame([("Enum", "1.0"), ("Enum", "1.0"), ("List", "1.0")], "module string, version string")
    assert {r.id: r.found for r in ingest.retry_from_raw(failures, raw).collect()} == {"f1": 2, "f2": 0, "f3": 0}
    asked = spark.createDataFrame([("f1", "7"), ("f2", "8"), ("f3", None)], "id string, input_identifier string")
    assert {r.id: r.found for r in ingest.retry_from_chunk(asked, spark.createDataFrame([(7,)], "id int")).collect()} == {"f1": True, "f2": False, "f3": False}
    before = spark.createDataFrame([("a", "B", "I", "1", False)], "id string, pipeline_behaviour string, pipeline_implementation string, version string, pipeline_fatal boolean")
    after = before.union(spark.createDataFrame([("b", "B", "I", "1", False), ("c", "B", "I", "1", True)], before.schema))
    assert [r.failures for r in ingest.failures_between(before, after).collect()] == [1]


def test_a_run_over_books(spark):
    books = spark.createDataFrame([("b1", "h1", "T", 1), ("b2", "h1", "T", 2), ("b3", "h2", None, 1)], "id string, file_hash string, title string, inserted_at int")
    pages = spark.createDataFrame([(1, "b1", 1, "some text", 1), (2, "b1", 2, " ", 1), (3, "b3", 1, None, 1), (4, "b1", 4, "more", 1)], "page_id int, parsed_book_id string, page_number int, text string, extracted_at int")
    skipped = spark.createDataFrame([("b1", 3)], "parsed_book_id string, page_number int")
    run = ingest.book_run(books, pages, skipped, HashedEmbedder(8).embed)
    got = {r.id: (r.n_chunks, r.warning, r.outcome) for r in run.report().collect()}
    assert got == {"b1": (2, "skipped pages: 3", "ok"), "b3": (0, None, "error")}
    assert [(r.chunk_index, len(r.embedding)) for r in run.chunks.orderBy("chunk_index").collect()] == [(0, 8), (1, 8)]
    assert [r.input_identifier for r in run.failures.collect()] == ["b3"]
