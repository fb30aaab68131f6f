"""Problem 4: splitting oversized items at natural boundaries.

Every position of a text gets a boundary strength (paragraph > line > sentence > clause > space >
none). A sparse table answers range-maximum queries over those strengths, so each cut is the strongest
boundary in the permissible length window, ties going to the right-most; the next piece starts at the
strongest boundary inside the overlap window before the cut, ties going to the left-most, so that the overlap comes
close to what was asked for.

Spark does the selection (only oversized rows leave the JVM) and the parallelism; a task holds one
Arrow batch of texts and, for each of them, a sparse table over one block of it, so memory does not
grow with the length of a text. Books are cut in the same way over their pages, where a page that
opens a chapter is the stronger boundary. A book's pages are handled in strides of a fixed number of pages: each stride
tells, for every page at which a run may enter it, at which page of the next stride the runs leave it; these small tables are
chained per book, and each stride then gives its runs. The result is that of one pass over the book, whatever the stride.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.runtime import free_name, spread_join, spread_rank, stage

#: Names of the boundary strengths 0..6; a cut at strength 0 falls inside a word.
BOUNDARIES = ("none", "space", "clause", "sentence", "line", "paragraph", "chapter")

_RULES = (
    (1, regex.compile(r"(?<=\S)\s+(?=\S)|(?<=[\p{Han}\p{Hiragana}\p{Katakana}])(?=[\p{Han}\p{Hiragana}\p{Katakana}])")),
    (2, regex.compile(r"[,;:、，；：]\s+|[、，；：]|\s[–—-]\s+")),
    (3, regex.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][」』）]*\s*")),
    (4, regex.compile(r"\r?\n[ \t]*")),
    (5, regex.compile(r"(?:\r?\n[ \t]*){2,}")),
)
_BLOCK = 65_536
_MARK = regex.compile(r"\p{M}|[‍️]")


def boundary_strengths(text: str) -> np.ndarray:
    """``s[p]`` is the strength of a cut before code point ``p`` (0 where nothing natural lies)."""
    strength = np.zeros(len(text) + 1, np.int8)
    for value, rule in _RULES:
        ends = [m.end() for m in rule.finditer(text)]
        if ends:
            at = np.asarray(ends)
            strength[at] = np.maximum(strength[at], value)
    strength[-1] = len(BOUNDARIES) - 1
    return strength


class SparseTable:
    """Range maximum over ``values`` with ties to the right: O(n log w) to build, O(1) to ask."""

    def __init__(self, values: np.ndarray, widest: int):
        n = len(values)
        # strength in the high part and position in the low part: the maximum is the right-most strongest
        level = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.levels, width = n, [level], 1
        while 2 * width <= min(n, widest):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def strongest(self, low: int, high: int) -> int:
        """Position of the maximum in ``[low, high]``, the right-most of equals."""
        k = (high - low + 1).bit_length() - 1
        k = min(k, len(self.levels) - 1)
        level = self.levels[k]
        return int(max(level[low], level[high - (1 << k) + 1]) % (self.n + 1))


class _Blocks:
    """Sparse tables over one block of a long array at a time."""

    def __init__(self, values: np.ndarray, widest: int):
        self.values, self.widest, self.base, self.table = values, widest, 0, None

    def strongest(self, low: int, high: int) -> int:
        if self.table is None or low < self.base or high >= self.base + self.table.n:
            self.base = low
            self.table = SparseTable(self.values[low : max(low + _BLOCK, high + 1)], self.widest)
        return self.base + self.table.strongest(low - self.base, high - self.base)


def cut(strength: np.ndarray, most: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """Half-open pieces of at most ``most`` positions that cover the array, each overlapping the one
    before by at most ``overlap``; ``least`` is the shortest piece but for the last."""
    length, start, out = len(strength) - 1, 0, []
    blocks = _Blocks(strength, most + 1)
    while length - start > most:
        end = blocks.strongest(start + least, start + most)
        if strength[end] == 0:
            end = start + most
        out.append((start, end))
        following = end
        if overlap:
            # a window of a few characters: the first of the strongest; without any boundary the whole overlap
            following = end - overlap + int(strength[end - overlap : end].argmax())
        start = following
    out.append((start, length))
    return out


def cut_text(text: str, most: int, overlap: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of each piece; combining marks stay with their base."""
    strength = boundary_strengths(text)
    pieces = cut(strength, most, overlap, least)
    out = []
    for n, (a, b) in enumerate(pieces):
        out.append((a, b, int(strength[b]) if n + 1 < len(pieces) else len(BOUNDARIES) - 1))
    if not _MARK.search(text):
        return out
    for n in range(len(out) - 1):  # a forced cut must not part a letter from its marks
        a, b, s = out[n]
        while s == 0 and b - a > least and _MARK.match(text[b]):
            b -= 1
        if b != out[n][1] and out[n + 1][0] <= b:
            out[n] = (a, b, s)
    return out


def split_texts(df: DataFrame, text: str = "text", max_chars: int = 3000, overlap: int = 200, min_chars: int | None = None) -> DataFrame:
    """Pieces of every row whose ``text`` has more than ``max_chars`` code points.

    All columns of ``df`` but ``text`` are kept; added are ``piece_no`` (from 0), ``n_pieces``,
    ``piece_start`` and ``piece_end`` (code points, half-open), ``cut_at`` (kind of boundary at the end)
    and ``piece_text``. Where ``df`` already has such a column, the added one gets the suffix ``_2``.

    Rows whose text is null, empty or within the limit have no pieces and do not come out. An empty
    table gives an empty result. Repeated rows are split each for itself. A text without any natural
    boundary is cut hard at ``max_chars``. Equal boundaries: the right-most wins.
    """
    least = min_chars if min_chars is not None else max_chars // 2
    if not 0 <= overlap < least <= max_chars:
        raise ValueError("needs 0 <= overlap < min_chars <= max_chars")
    schema = T.ArrayType(
        T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("k", T.IntegerType())])
    )

    @F.pandas_udf(schema)
    def bounds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"s": a, "e": b, "k": k} for a, b, k in cut_text(t, max_chars, overlap, least)] for t in batch])

    names = {n: free_name(df, n) for n in ("piece_no", "n_pieces", "piece_start", "piece_end", "cut_at", "piece_text")}
    keep = [c for c in df.columns if c != text]
    whole, at, piece = "__whole", "__bounds", "__piece"
    long = df.where(F.length(F.col(f"`{text}`")) > max_chars)
    cutted = long.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(whole), bounds(F.col(f"`{text}`")).alias(at))
    rows = cutted.select(*[F.col(f"`{c}`") for c in keep], whole, F.size(at).alias(names["n_pieces"]), F.posexplode(at).alias(names["piece_no"], piece))
    kinds = F.array(*[F.lit(b) for b in BOUNDARIES])
    last = F.col(names["piece_no"]) == F.col(names["n_pieces"]) - 1
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        names["piece_no"],
        names["n_pieces"],
        F.col(f"{piece}.s").alias(names["piece_start"]),
        F.col(f"{piece}.e").alias(names["piece_end"]),
        F.when(last, F.lit("end")).otherwise(F.element_at(kinds, F.col(f"{piece}.k") + 1)).alias(names["cut_at"]),
        F.substring(F.col(whole), F.col(f"{piece}.s") + 1, F.col(f"{piece}.e") - F.col(f"{piece}.s")).alias(names["piece_text"]),
    )


def opens_chapter(text: Column) -> Column:
    """Whether a page's first line that is not blank is a heading; the line is read whole."""
    first = F.regexp_extract(text, r"^(?U)\s*([^\r\n]*)", 1)
    numbered = first.rlike(r"(?iu)^(chapter|section|part|kapitel|chapitre|cap[ií]tulo|rozdział|глава|第)\s*[\divxlc]")
    capitals = first.rlike(r"^[\p{Lu}\p{N}\s\p{P}]{4,80}$") & first.rlike(r"\p{Lu}{3}")
    return F.coalesce(numbered | capitals, F.lit(False))


def split_runs(pages: DataFrame, book: str = "parsed_book_id", number: str = "page_number", text: str = "text", max_pages: int = 60, overlap: int = 2, min_pages: int | None = None, stride: int = 50_000) -> DataFrame:
    """Runs of at most ``max_pages`` distinct pages of every book that has more than that.

    Comes out: ``book``, ``run_no`` (from 0 per book, gaps never), ``n_runs``, ``n_pages`` (distinct pages of the
    book), ``first_page``, ``last_page``, ``run_pages``. A cut before a page that opens a chapter is
    preferred, the right-most of those in the window. Consecutive runs share ``overlap`` pages.

    Page numbers extracted twice count once (a chapter heading in either copy counts). Null page
    numbers or book ids are left out. Books within the limit do not come out; an empty table gives an
    empty result. ``stride`` bounds what one task holds of a book and changes nothing else.
    """
    least = min_pages if min_pages is not None else max(overlap + 1, max_pages // 2)
    if not 0 <= overlap < least <= max_pages or stride <= max_pages:
        raise ValueError("needs 0 <= overlap < min_pages <= max_pages < stride")
    b, p = F.col(f"`{book}`"), F.col(f"`{number}`")
    distinct = (
        pages.where(b.isNotNull() & p.isNotNull())
        .groupBy(b.alias("book"), p.cast("int").alias("page"))
        .agg(F.max(opens_chapter(F.col(f"`{text}`")).cast("tinyint")).alias("opens"))
    )
    distinct = stage(distinct, "distinct-pages")
    counts = distinct.groupBy("book").agg(F.count(F.lit(1)).cast("int").alias("n_pages")).where(F.col("n_pages") > max_pages)
    ranked = spread_rank(spread_join(distinct, counts, "book", row_bytes=40), "book", ["page"], "rank")
    part = F.floor(F.col("rank") / stride).cast("int")
    # the first pages of a stride are also what the one before looks ahead to
    both = F.when((part > 0) & (F.col("rank") % stride <= max_pages), F.array(part - 1, part)).otherwise(F.array(part))
    strides = (
        ranked.select("book", "n_pages", "page", "opens", F.explode(both).alias("part"))
        .groupBy("book", "n_pages", "part")
        .agg(F.array_sort(F.collect_list(F.struct("page", "opens"))).alias("pages"))
    )
    strides = stage(strides.select("book", "n_pages", "part", F.col("pages.opens").alias("opens"), F.col("pages.page").alias("numbers")), "strides")

    @F.pandas_udf("array<int>")
    def exits(opens: pd.Series, part: pd.Series, n_pages: pd.Series) -> pd.Series:
        # where the runs enter the next stride, by where they enter this one
        return pd.Series([[cut_pages(_page_strength(o), n - k * stride, max_pages, overlap, least, e, stride)[1] for e in range(max_pages)] for o, k, n in zip(opens, part, n_pages)])

    @F.pandas_udf("array<struct<f:int,l:int,n:int>>")
    def runs(opens: pd.Series, numbers: pd.Series, part: pd.Series, n_pages: pd.Series, entry: pd.Series) -> pd.Series:
        out = []
        for o, pages_, k, n, e in zip(opens, numbers, part, n_pages, entry):
            cuts = cut_pages(_page_strength(o), n - k * stride, max_pages, overlap, least, e, stride)[0] if e >= 0 else []
            out.append([{"f": int(pages_[a]), "l": int(pages_[z - 1]), "n": z - a} for a, z in cuts])
        return pd.Series(out)

    tables = strides.where(F.col("n_pages") > stride).select("book", "part", exits("opens", "part", "n_pages").alias("exits"))
    chain = tables.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("part", "exits"))).alias("t"))
    entries = F.aggregate(
        "t", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.when(F.element_at(acc, -1) < 0, F.lit(-1)).otherwise(F.element_at(x["exits"], F.greatest(F.element_at(acc, -1), F.lit(0)) + 1))))
    )
    entered = chain.select("book", F.posexplode(entries).alias("part", "entry"))
    placed = strides.join(entered, ["book", "part"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    cut = stage(placed.select("book", "n_pages", "part", runs("opens", "numbers", "part", "n_pages", "entry").alias("runs")), "runs")
    # a row per stride: few per book
    whole, before = Window.partitionBy("book"), Window.partitionBy("book").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.select("*", F.coalesce(F.sum(F.size("runs")).over(before), F.lit(0)).alias("skip"), F.sum(F.size("runs")).over(whole).alias("n_runs"))
    return sizes.select("*", F.posexplode("runs").alias("pos", "run")).select(
        F.col("book").alias(book),
        (F.col("skip") + F.col("pos")).cast("int").alias("run_no"),
        F.col("n_runs").cast("int").alias("n_runs"),
        "n_pages",
        F.col("run.f").alias("first_page"),
        F.col("run.l").alias("last_page"),
        F.col("run.n").alias("run_pages"),
    )


def _page_strength(opens) -> np.ndarray:
    return np.append(np.where(np.asarray(opens) > 0, 6, 1), 6).astype(np.int8)


def cut_pages(strength: np.ndarray, length: int, most: int, overlap: int, least: int, start: int = 0, stop: int | None = None) -> tuple[list[tuple[int, int]], int]:
    """Like :func:`cut`, but the overlap is exactly ``overlap`` pages: the runs that start at ``start`` and before ``stop``, and how far
    behind ``stop`` the next one starts (-1 if there is none). ``length`` counts the pages to the end of the book."""
    out: list[tuple[int, int]] = []
    blocks = _Blocks(strength, most + 1)
    while length - start > most:
        if stop is not None and start >= stop:
            return out, start - stop
        end = blocks.strongest(start + least, start + most)
        if strength[end] == 1:  # no chapter opens in the window: a full run
            end = start + most
        out.append((start, end))
        start = end - overlap
    if stop is not None and start >= stop and length > start:
        return out, start - stop
    return ([*out, (start, length)] if start < length else out), -1
