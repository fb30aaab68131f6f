import random
from collections import Counter

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import queries, tokens

WORDS = regex.compile(r" ?\p{L}+| ?\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+")


def plain_count(tokenizer, piece):
    parts = [bytes([b]) for b in piece.encode()]
    while True:
        ranked = [(tokenizer.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in tokenizer.ranks]
        if not ranked:
            return len(parts)
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def merges(spark, sf):
    return tokens.MergeTokenizer.from_table(spark.read.parquet(f"{sf}/tokenizer_merges.parquet"))


@settings(max_examples=150, deadline=None)
@given(piece=st.text(alphabet="etaoin shr dlé的", max_size=40))
def test_merges_match_the_plain_rule(merges, piece):
    assert merges.count(piece) == plain_count(merges, piece)


def test_long_piece_is_quick(merges):
    assert merges.count("the" * 50_000) > 0


def test_exact_counts_of_documents(spark, sf, merges):
    rows = spark.read.parquet(f"{sf}/parsed_documents.parquet").select("id", "text").collect()
    got = {r.id: r.tokens for r in queries.p2_document_tokens(spark, sf).collect()}
    assert got == {r.id: sum(merges.count(p) for p in WORDS.findall(r.text or "")) for r in rows}


def test_head_and_tail_add_up(spark, merges, monkeypatch):
    monkeypatch.setattr(tokens, "HEAD_PIECES", 3)
    rnd = random.Random(1)
    rows = [(n, " ".join(rnd.choice(["the", "data", "zebra", "x1y2", "élan"]) for _ in range(rnd.randint(0, 30)))) for n in range(60)] + [(100, None), (101, ""), (102, " \n"), (None, "the"), (103, "a" * 30_000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "id int, text string, piece string")
    got = {r.id: r.tokens for r in tokens.count_tokens(df, merges).collect()}
    assert got == {i: sum(merges.count(p) for p in WORDS.findall(t or "")) for i, t in rows}
    assert tokens.count_tokens(df.limit(0), merges).count() == 0


def test_public_vocabulary(spark, sf):
    import os

    path = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file here")
    public = tokens.RankTokenizer(path)
    import tiktoken

    whole = tiktoken.Encoding("x", pat_str=public.pattern.removeprefix("(?U)"), mergeable_ranks=public.ranks, special_tokens={})
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.tokens for r in tokens.count_tokens(spark.read.parquet(f"{sf}/documents.parquet"), public, "doc_id").collect()}
    assert got == {r.doc_id: len(whole.encode_ordinary(r.text or "")) for r in rows}


def test_totals(spark, sf, merges):
    docs = spark.read.parquet(f"{sf}/parsed_documents.parquet")
    out = tokens.token_totals(docs, merges).collect()
    each = {r.id: r.tokens for r in tokens.count_tokens(docs, merges).collect()}
    assert sum(r.tokens for r in out if r.level == "slice") == sum(each.values()) == next(r.tokens for r in out if r.level == "all")
    by = Counter()
    for r in docs.select("id", tokens.clean_language(F.col("language")).alias("l")).collect():
        by[r.l] += each[r.id]
    assert {r.language: r.tokens for r in out if r.level == "language"} == dict(by)
    assert all(r.usable_tokens <= r.tokens and r.usable_documents <= r.documents for r in out)


def test_repeated_and_missing_keys(spark, merges):
    df = spark.createDataFrame([("a", "the the"), ("a", "data"), (None, "zebra"), (None, None)], "id string, text string").selectExpr("*", "'s' AS source", "'l' AS language", "'' AS url")
    each = [sum(merges.count(p) for p in WORDS.findall(t)) for t in ("the the", "data", "zebra")]
    every = tokens.token_totals(df, merges).where("level = 'all'").first()
    assert every.documents == 4 and every.tokens == sum(each)
    rows = sorted((r.id or "", r.tokens) for r in tokens.row_tokens(df, merges, "text", "id").collect())
    assert rows == sorted([("a", each[0]), ("a", each[1]), ("", each[2]), ("", 0)])
    assert {r.id: r.tokens for r in tokens.count_tokens(df, merges).collect()} == {"a": each[0] + each[1], None: each[2]}
    assert tokens.token_totals(df.limit(0), merges).collect()[0].tokens == 0


def test_cleaning(spark):
    df = spark.createDataFrame(
        [("HTTPS://WWW.A.example:8080/x", " Hex-Docs ", "EX"), ("//u:p@b.test/x", None, " py "), ("/only/path", "", None), ("", "a", ""), (None, "b", "Go"), ("c.example/x?y=//z", "c", "golang")],
        "url string, source string, language string",
    )
    got = df.select(tokens.url_host(F.col("url")).alias("h"), tokens.clean_source(F.col("source")).alias("s"), tokens.clean_language(F.col("language")).alias("l")).collect()
    assert [r.h for r in got] == ["a.example", "b.test", "unknown", "unknown", "unknown", "c.example"]
    assert [r.s for r in got] == ["hex_docs", "unknown", "unknown", "a", "b", "c"]
    assert [r.l for r in got] == ["elixir", "python", "unknown", "unknown", "go", "go"]
