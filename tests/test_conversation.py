from pyspark.sql import functions as F

from tessera import providers
from tessera.operators import conversation
from tessera.streaming.conversation import running_transitions
from tessera.streaming.ingest import ingest_stream


def test_histories_start_anew(spark):
    df = spark.createDataFrame([("c", n, found) for n, found in enumerate([3, 2, 0, 4, 4, 0, 0])], "conv_id string, turn int, n_results int")
    got = conversation.histories(df).orderBy("turn").collect()
    assert [(r.history_start, r.history_turns) for r in got] == [(0, 1), (0, 2), (0, 3), (3, 1), (3, 2), (3, 3), (6, 1)]


def fold(commands):
    state, out = "idle", []
    for c in commands:
        then = conversation.TRANSITIONS.get((state, c))
        out.append((state, then or state, then is not None))
        state = then or state
    return out


COMMANDS = ["ask", "manual_ask", "ask", "select", "select", "manual_ask", "manual_ask", "select", "ask"]


def test_batch_transitions_match_the_fold(spark):
    df = spark.createDataFrame([("c", n, c) for n, c in enumerate(COMMANDS)], "conv_id string, turn bigint, command string")
    got = conversation.transitions(df).orderBy("turn").collect()
    assert [(r.state_before, r.state_after, r.valid) for r in got] == fold(COMMANDS)


def test_streamed_transitions_match_the_fold(spark, tmp_path):
    df = spark.createDataFrame([("c", n, c) for n, c in enumerate(COMMANDS)], "conv_id string, turn bigint, command string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = running_transitions(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("moves").orderBy("turn").collect()
    assert [(r.state_before, r.state_after, r.valid) for r in got] == fold(COMMANDS)


def test_stream_ingest_merges_and_diverts(spark, tmp_path):
    schema = "id int, text string, updated_at int"
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], schema).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), F.col("text").isNotNull(), str(tmp_path / "t"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    spark.createDataFrame([(1, "c", 3), (3, "d", 1)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {r.id: r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {1: "c", 3: "d"}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1


def test_providers(spark):
    bodies = ['{"usage":{"input_tokens":1,"output_tokens":2,"total_tokens":3}}', '{"usage":{"prompt_tokens":1,"completion_tokens":2,"total_tokens":3}}', '{"usage":{"input_tokens":1,"output_tokens":2}}', "{}"]
    got = [r.u for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(providers.usage(F.col("b")).alias("u")).collect()]
    assert [tuple(u) for u in got] == [(1, 2, 3)] * 2 + [(0, 0, 0)] * 2
    good, cut, empty, bare = ('{"output":[{"type":"x"},{"content":[{"text":"%s"}],"status":"%s"}]%s}' % x for x in (("hi", "completed", ',"usage":{}'), ("hi", "incomplete", ',"usage":{}'), ("", "completed", ',"usage":{}'), ("hi", "completed", "")))
    cases = [(200, good, None), (200, cut, None), (200, empty, None), (200, bare, None), (200, '{"usage":{},"output":[]}', None), (401, None, None), (429, None, None), (503, None, None), (None, None, "timeout"), (None, None, "closed")]
    rows = spark.createDataFrame(cases, "s int, b string, t string").select(providers.response_kind(F.col("s"), F.col("b"), F.col("t")).alias("k"), providers.finish_reason(F.col("b")).alias("f"), providers.answer_text(F.col("b")).alias("a")).collect()
    assert [r.k for r in rows] == ["ok", "ok", "empty_response", "malformed_response", "malformed_response", "auth", "rate_limited", "http", "timeout", "transport"]
    assert [(r.f, r.a) for r in rows[:2]] == [("stop", "hi"), ("length", "hi")]
    waits = spark.createDataFrame([("20",), ("7 s",), ("soon",), (None,)], "w string").select(providers.retry_after(F.col("w")).alias("n")).collect()
    assert [r.n for r in waits] == [20, 7, None, None]
    vec = spark.createDataFrame([("a b a",), (None,)], "t string").select(providers.HashedEmbedder(16).embed(F.col("t")).alias("v")).collect()
    assert len(vec[0].v) == 16 and abs(sum(x * x for x in vec[0].v) - 1) < 1e-6 and not any(vec[1].v)
