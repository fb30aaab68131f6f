"""File sources (S3-S6): binaries, recursive listings, and extraction of pages by an injected parser."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a parser returns for one file: title, pages [(number, text)], skipped [(number, reason)].
Extracted = tuple[str | None, list[tuple[int, str]], list[tuple[int, str]]]


def binaries(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of the files under a folder."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", "content")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path): in every folder the files of its subfolders come before its own, folders and files each by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split("path", "/")
    # at each level a folder sorts before a file
    place = F.transform(parts, lambda name, n: F.concat(F.when(n == F.size(parts) - 1, F.lit("1")).otherwise(F.lit("0")), name))
    return found.orderBy(place)


def extract(files: DataFrame, parser: Callable[[bytes], Extracted]) -> DataFrame:
    """(path, ok, error, title, pages, skipped): each file parsed where it lies; a failing file is a row with an error,
    a failing page one in ``skipped``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    title, pages, skipped = parser(bytes(content))
                    rows.append((path, True, None, title, [{"page_number": n, "text": t} for n, t in pages], [{"page_number": n, "reason": r} for n, r in skipped]))
                except Exception as error:
                    rows.append((path, False, str(error) or type(error).__name__, None, [], []))
            yield pd.DataFrame(rows, columns=["path", "ok", "error", "title", "pages", "skipped"])

    schema = "path string, ok boolean, error string, title string, pages array<struct<page_number:int,text:string>>, skipped array<struct<page_number:int,reason:string>>"
    return files.select("path", "content").mapInPandas(parse, schema)


def plain_text_pages(content: bytes) -> Extracted:
    """A parser of plain text with form feeds between pages; a page that is no UTF-8 is skipped."""
    pages, skipped = [], []
    for number, raw in enumerate(content.split(b"\f"), 1):
        try:
            pages.append((number, raw.decode("utf-8")))
        except UnicodeDecodeError as error:
            skipped.append((number, error.reason))
    return None, pages, skipped


_DOC = re.compile(r'^[ \t]*@doc[ \t]+(?:"""[^\n]*\n(?P<block>.*?)^[ \t]*"""|"(?P<line>[^"\n]*)"|(?P<none>false))', re.S | re.M)
_HEAD = re.compile(r"^(?P<indent>[ \t]*)(?P<kind>defp?)[ \t]+(?P<name>[\w?!]+)(?P<rest>[^\n]*)", re.M)


def _code(source: str, head: re.Match) -> str:
    """A definition from its head to the ``end`` that is indented like it, or to the end of its line where it has no block."""
    if not re.search(r"\bdo\s*$", head["rest"]):
        return head[0].strip()
    closing = re.compile(rf"^{head['indent']}end\b", re.M).search(source, head.end())
    body = source[head.start() : closing.end() if closing else len(source)]
    return textwrap.dedent(body).strip()


def documented_functions(source: str) -> list[tuple[str, str]]:
    """(name/arity, documentation and code) of the functions of one module; other sources give none.

    Every definition counts; one without documentation has an empty one. Arity is 1 for a definition with a body and 0 for a bare head; a guard
    hides the name (``when``). A documentation belongs to the next definition and is used up by it.
    """
    if len(re.findall(r"^[ \t]*defmodule\b", source, re.M)) != 1:
        return []
    docs = list(_DOC.finditer(source))
    within = lambda at: any(d.start() <= at < d.end() for d in docs)
    found = sorted([*docs, *(h for h in _HEAD.finditer(source) if not within(h.start()))], key=lambda m: m.start())
    out, doc, upto = [], "", 0
    for m in found:
        if m.start() < upto:
            continue
        if m.re is _DOC:
            doc = textwrap.dedent(m["block"]) if m["block"] is not None else m["line"] or ""
            continue
        code = _code(source, m)
        upto = m.start() + len(code)
        name = "when" if re.search(r"\)\s+when\b", m["rest"]) else m["name"]
        arity = 1 if re.search(r"\bdo\s*$|, do:", m["rest"]) else 0
        out.append((f"{name}/{arity}", f"{doc}\n\n{code}"))
        doc = ""
    return out


def parsed_functions(raw: DataFrame) -> DataFrame:
    """(module, version, title, text) of every documented function of the raw documents."""

    @F.pandas_udf("array<struct<title:string,text:string>>")
    def functions(content: pd.Series) -> pd.Series:
        return pd.Series([[{"title": t, "text": x} for t, x in documented_functions(c or "")] for c in content])

    return raw.select("module", "version", F.explode(functions("content")).alias("f")).select("module", "version", "f.title", "f.text")
