"""Queries over texts with citation markers, prompts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import citations, conversation, prompt
from tessera.plans.library import CHUNKS_SQL, chunks, documents
from tessera.plans.register import query
from tessera.runtime import spread_join
from tessera.sources.tables import table



def _valid():
    """A chunk map of the indexes 1 to 6 for every text."""
    return F.array(*[F.lit(n).cast("decimal(38,0)") for n in range(1, 7)])


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").withColumn("valid", _valid())


def _joined(numbers):
    return F.array_join(F.transform(numbers, lambda m: m.cast("string")), ",")


_MARKERS_SQL = """
    found AS (SELECT doc_id, text, list_transform(regexp_extract_all(coalesce(text, ''), '\\[(\\d+)\\]', 1), lambda x: TRY_CAST(x AS DECIMAL(38,0))) AS m FROM documents),
    marked AS (SELECT doc_id, text, m, list_filter(m, lambda x, i: list_position(m, x) = i) AS every FROM found)
"""


@query(
    f"WITH {_MARKERS_SQL} SELECT doc_id, array_to_string(list_filter(every, lambda x: x BETWEEN 1 AND 6), ',') AS cited, array_to_string(list_filter(every, lambda x: x NOT BETWEEN 1 AND 6), ',') AS hallucinated FROM marked WHERE len(m) > 0"
)
def citation_extract(spark, sf_dir):
    rows = _texts(spark, sf_dir).where(F.col("text").rlike(citations.MARKER))
    return rows.select("doc_id", _joined(citations.resolved(F.col("text"), F.col("valid"))).alias("cited"), _joined(citations.hallucinated(F.col("text"), F.col("valid"))).alias("hallucinated"))


@query(f"WITH {_MARKERS_SQL}, e AS (SELECT doc_id, every, unnest(every) AS old FROM marked) SELECT doc_id, CAST(old AS BIGINT) AS old_index, CAST(list_position(every, old) AS INTEGER) AS new_index FROM e WHERE old BETWEEN 1 AND 6")
def citation_renumber(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.explode(citations.renumbered(F.col("text"), F.col("valid"))).alias("c"))
    return rows.select("doc_id", F.col("c.old_index").cast("bigint").alias("old_index"), F.col("c.new_index").alias("new_index"))


@query(
    f"""WITH {_MARKERS_SQL}, parts AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\[\\d+\\]') AS p, list_transform(m, lambda x: CASE WHEN x BETWEEN 1 AND 6 THEN '[' || list_position(every, x) || ']' ELSE '' END) AS s FROM marked)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(p, lambda x, i: x || coalesce(s[i], '')), ''), ' +', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\v]+', ''), '[\\s\\v]+$', '') AS final_text FROM parts"""
)
def citation_rewrite(spark, sf_dir):
    return citations.response(_texts(spark, sf_dir)).select("doc_id", "final_text")


@query(f"WITH {_MARKERS_SQL} SELECT doc_id, array_to_string(list_transform(list_filter(every, lambda x: x NOT BETWEEN 1 AND 6), lambda x: 'unknown citation [' || x || ']'), '|') AS warnings FROM marked WHERE len(list_filter(every, lambda x: x NOT BETWEEN 1 AND 6)) > 0")
def citation_hallucinated(spark, sf_dir):
    rows = citations.response(_texts(spark, sf_dir)).where(F.size("warnings") > 0)
    return rows.select("doc_id", F.array_join("warnings", "|").alias("warnings"))


#: The context that all answers are taken to have had: the six first chunks of ``corelib``, numbered from 1, the fourth without a URL.
_MAP_SQL = """
    context AS (SELECT CAST(n AS DECIMAL(38,0)) AS idx, id, package || ' — ' || coalesce(title, '') AS label, left(text, 200) AS preview, CASE WHEN n <> 4 THEN url END AS source_ref, version, language
        FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM parsed_documents WHERE package = 'corelib') WHERE n <= 6),
    cited AS (SELECT doc_id, every, unnest(every) AS old FROM marked),
    resolved AS (SELECT doc_id, CAST(old AS BIGINT) AS old_index, CAST(list_position(every, old) AS INTEGER) AS new_index, context.* EXCLUDE (idx) FROM cited JOIN context ON idx = old)
"""


def _chunk_map(spark, sf_dir):
    """(idx, metadata) of the six first documents of one package."""
    six = documents(spark, sf_dir, "id", "package", "title", "text", "url", "version", "language", "source").where("package = 'corelib'").orderBy("id").limit(6)
    numbered = six.withColumn("idx", F.expr("row_number() over (order by id)"))
    return numbered.withColumn("url", F.when(F.col("idx") != 4, F.col("url"))).select("idx", citations.citable_document().alias("metadata"))


def _resolved(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("doc_id", F.explode(citations.renumbered(F.col("text"), F.col("valid"))).alias("c")).select("doc_id", "c.*")
    return citations.resolve(rows, _chunk_map(spark, sf_dir))


@query(f"WITH {_MARKERS_SQL}, {_MAP_SQL} SELECT doc_id, old_index, new_index, id, label, preview, source_ref, version, language FROM resolved")
def citation_resolve(spark, sf_dir):
    """Every citation with the metadata of what it cites."""
    rows = _resolved(spark, sf_dir)
    return rows.select("doc_id", F.col("old_index").cast("bigint").alias("old_index"), "new_index", "id", "label", "preview", "source_ref", "extras.version", "extras.language")


@query(
    f"""WITH {_MARKERS_SQL}, {_MAP_SQL} SELECT doc_id, 'download' AS kind, arg_min(label, new_index) AS label, source_ref, min(new_index) AS new_index FROM resolved WHERE source_ref IS NOT NULL GROUP BY doc_id, source_ref"""
)
def citation_actions(spark, sf_dir):
    return citations.download_actions(_resolved(spark, sf_dir), "doc_id")


@query(
    """SELECT id, coalesce(package, '') || ' — ' || coalesce(title, '') AS label, left(text, 200) AS preview, url AS source_ref, package AS x_package, title AS x_title, version AS x_version, language AS x_language, source AS x_source FROM parsed_documents"""
)
def citable_documents(spark, sf_dir):
    rows = documents(spark, sf_dir, "id", "package", "title", "text", "url", "version", "language", "source").select(citations.citable_document().alias("c"))
    return rows.select("c.id", "c.label", "c.preview", "c.source_ref", *[F.col(f"c.extras.{x}").alias(f"x_{x}") for x in ("package", "title", "version", "language", "source")])


#: The data has no sections: every third page is given one, and every fifth loses its number, so that all forms of a label occur.
_SECTIONED_SQL = "CASE WHEN c.id % 5 <> 0 THEN c.page_number END AS page, CASE WHEN c.id % 3 = 0 THEN 'Part ' || (c.id % 7) END AS section"


def _sectioned(spark, sf_dir):
    books = table(spark, sf_dir, "parsed_books", "id", "title", "source_file_path").withColumnsRenamed({"id": "parsed_book_id", "title": "book_title"})
    rows = spread_join(chunks(spark, sf_dir), books, "parsed_book_id", row_bytes=64)
    section = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Part "), F.col("id") % 7))
    return rows.withColumn("page_number", F.when(F.col("id") % 5 != 0, F.col("page_number"))).withColumn("section_title", section)


@query(
    f"""WITH {CHUNKS_SQL}, s AS (SELECT c.*, {_SECTIONED_SQL}, b.title, b.source_file_path FROM chunks c JOIN parsed_books b ON b.id = c.parsed_book_id)
    SELECT CAST(id AS VARCHAR) AS id, coalesce(title, '') || coalesce(', p. ' || page, '') || coalesce(' — ' || section, '') AS label, left(text, 200) AS preview, source_file_path AS source_ref,
      title AS x_book_title, CAST(page AS VARCHAR) AS x_page_number, section AS x_section_title, chunk_index AS x_chunk_index FROM s"""
)
def citable_chunks(spark, sf_dir):
    rows = _sectioned(spark, sf_dir).select(citations.citable_chunk().alias("c"))
    return rows.select("c.id", "c.label", "c.preview", "c.source_ref", *[F.col(f"c.extras.{x}").alias(f"x_{x}") for x in ("book_title", "section_title", "chunk_index")], F.col("c.extras.page_number").cast("string").alias("x_page_number"))


@query(
    f"""WITH {CHUNKS_SQL}, s AS (SELECT c.*, {_SECTIONED_SQL}, b.title FROM chunks c JOIN parsed_books b ON b.id = c.parsed_book_id)
    SELECT id, 'Book: ' || coalesce(title, '') || ' | Page: ' || coalesce(CAST(page AS VARCHAR), '') || chr(10) || 'Section: ' || coalesce(section, '(none)') || chr(10) || chr(10) || text AS prompt_text FROM s"""
)
def prompt_context_chunk(spark, sf_dir):
    rows = _sectioned(spark, sf_dir)
    return rows.select("id", prompt.chunk_context(F.col("book_title"), F.col("page_number"), F.col("section_title"), F.col("text")).alias("prompt_text"))


@query(
    """SELECT package, version, string_agg('[' || n || '] ' || 'Package: ' || package || ' | Function: ' || coalesce(title, '') || chr(10) || 'URL: ' || coalesce(url, '') || chr(10) || chr(10) || coalesce(text, ''), chr(10) || '---' || chr(10) ORDER BY n) AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY package, version ORDER BY id) AS n FROM parsed_documents) WHERE n <= 10 GROUP BY package, version"""
)
def context_block(spark, sf_dir):
    """The first ten documents of every package and version as one block."""
    rows = documents(spark, sf_dir, "id", "package", "version", "title", "url", "text")
    rows = rows.withColumn("prompt_index", F.expr("row_number() over (partition by package, version order by id)")).where("prompt_index <= 10")
    rows = rows.withColumn("prompt_text", prompt.document_context(F.col("package"), F.col("title"), F.col("url"), F.col("text"))).withColumn("query_id", F.struct("package", "version"))
    return prompt.context_block(rows).select("query_id.package", "query_id.version", "block")


_TURNS_SQL = "turns AS (SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_type AS text FROM events)"


def _turns(spark, sf_dir):
    """The events of a user as the turns of a conversation."""
    events = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type")
    return events.select(F.col("user_id").alias("conv_id"), F.expr("row_number() over (partition by user_id order by ts, event_id)").alias("turn"), F.col("event_type").alias("text"))


@query(
    f"""WITH {_TURNS_SQL}, c AS (SELECT conv_id, turn - 1 AS n, text, count(*) OVER (PARTITION BY conv_id) // 2 AS pairs FROM turns)
    SELECT conv_id, CAST(n // 2 - greatest(pairs - 5, 0) AS INTEGER) AS pair, CAST(n - 2 * greatest(pairs - 5, 0) AS INTEGER) AS ordinal, CASE WHEN n % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, text FROM c WHERE n // 2 < pairs AND n // 2 >= pairs - 5"""
)
def history_pairs(spark, sf_dir):
    return prompt.history_pairs(_turns(spark, sf_dir))


@query(
    f"""WITH {_TURNS_SQL}, c AS (SELECT conv_id, turn - 1 AS n, text, count(*) OVER (PARTITION BY conv_id) // 2 AS pairs FROM turns),
    h AS (SELECT conv_id, string_agg(CASE WHEN n % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, '|' ORDER BY n) AS said, count(*) AS n FROM c WHERE n // 2 < pairs AND n // 2 >= pairs - 5 GROUP BY conv_id)
    SELECT conv_id, CAST(n + 2 AS INTEGER) AS n_messages, said FROM h"""
)
def messages_build(spark, sf_dir):
    history = prompt.history_pairs(_turns(spark, sf_dir)).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("history"))
    built = history.select("conv_id", prompt.messages(F.lit("What next?"), F.lit(None).cast("string"), F.col("history")).alias("m"))
    said = F.transform(F.slice("m", 2, F.size("m") - 2), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return built.select("conv_id", F.size("m").alias("n_messages"), F.array_join(said, "|").alias("said"))


_COMMANDS_SQL = f"{_TURNS_SQL}, commands AS (SELECT conv_id, turn, CASE WHEN text IN ('click', 'view') THEN 'ask' WHEN text = 'error' THEN 'manual_ask' ELSE 'select' END AS command FROM turns)"


@query(
    f"""WITH {_COMMANDS_SQL}, w AS (SELECT conv_id, turn, command, coalesce(last_value(CASE WHEN command <> 'ask' THEN command END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'manual_ask', false) AS waiting FROM commands)
    SELECT conv_id, turn, command, CASE WHEN waiting THEN 'awaiting_selection' ELSE 'idle' END AS state_before, CASE WHEN waiting THEN command = 'select' ELSE command <> 'select' END AS valid,
      CASE WHEN waiting AND command = 'select' THEN 'idle' WHEN waiting THEN 'awaiting_selection' WHEN command = 'manual_ask' THEN 'awaiting_selection' ELSE 'idle' END AS state_after FROM w"""
)
def session_fsm_transitions(spark, sf_dir):
    command = F.when(F.col("text").isin("click", "view"), F.lit("ask")).when(F.col("text") == "error", F.lit("manual_ask")).otherwise(F.lit("select"))
    return conversation.transitions(_turns(spark, sf_dir).select("conv_id", "turn", command.alias("command")))


@query(f"WITH {_TURNS_SQL} SELECT conv_id, turn, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS used_results FROM turns")
def reused_results(spark, sf_dir):
    return conversation.reused_results(_turns(spark, sf_dir), results="text").select("conv_id", "turn", "used_results")


@query(
    f"""WITH {_TURNS_SQL}, f AS (SELECT conv_id, turn, CASE WHEN text = 'error' THEN 0 ELSE 1 END AS n_results FROM turns),
    r AS (SELECT *, coalesce(lag(n_results) OVER w, 0) = 0 AS anew FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, last_value(CASE WHEN anew THEN turn END IGNORE NULLS) OVER w AS history_start, turn - last_value(CASE WHEN anew THEN turn END IGNORE NULLS) OVER w + 1 AS history_turns FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def history_with_reset(spark, sf_dir):
    """A turn that ends in an error leaves the session without results, so the history starts anew behind it."""
    turns = _turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("text") == "error", 0).otherwise(1).alias("n_results"))
    return conversation.histories(turns).select("conv_id", "turn", "history_start", "history_turns")
