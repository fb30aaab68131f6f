"""Text expressions: words, trimming, previews, titles, hashes, integers (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(c: Column) -> Column:
    """Without outer white space of any kind (``F.trim`` removes blanks only)."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trim(c) == "", F.lit(True))


def word_count(c: Column) -> Column:
    """Runs of other than white space; null counts 0."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def char_count(c: Column) -> Column:
    """Code points; null counts 0."""
    return F.length(F.coalesce(c, F.lit("")))


def preview(c: Column, most: int = 200) -> Column:
    return F.substring(c, 1, most)


def terms(c: Column) -> Column:
    """Search terms: lower case, cut at everything but letters and digits, no stemming."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def file_hash(c: Column) -> Column:
    """Lower-case hexadecimal SHA-256."""
    return F.sha2(c, 256)


def strip_nul(c: Column) -> Column:
    """Without NUL characters, which many databases reject."""
    return F.replace(c, F.lit("\0"), F.lit(""))


def marker_number(c: Column) -> Column:
    """The number of a citation marker; one too large for 38 digits is null, so it never resolves."""
    return c.try_cast("decimal(38,0)")


def leading_int(c: Column) -> Column:
    """The integer at the start of a string, or null."""
    return F.nullif(F.regexp_extract(c, r"^([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


def first_line(c: Column) -> Column:
    """The first line that is not blank, trimmed, or null."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), trim), lambda x: x != "")
    return F.get(lines, F.lit(0))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def title_or_fallback(title: Column, first_page: Column, path: Column) -> Column:
    """The title of the metadata, else the first line of the first page, else the file's name."""
    return F.coalesce(F.when(~is_blank(title), trim(title)), first_line(first_page), basename(path))


def display_title(c: Column) -> Column:
    """A title fit for display: no control or replacement characters, no tool prefix, ``, p. N`` spelled out; null is ``Untitled``."""
    plain = F.regexp_replace(c, r"[\x{fffd}\x00-\x1f]+", "")
    plain = F.regexp_replace(plain, r"^Microsoft Word - ", "")
    plain = F.regexp_replace(plain, r", p\. (\d+)", ", PDF page $1")
    return F.coalesce(trim(plain), F.lit("Untitled"))


def under_root(path: Column, root: str) -> Column:
    """Whether a path is the folder ``root`` or lies below it (and does not climb out of it)."""
    return (path.startswith(F.lit(root.rstrip("/") + "/")) | (path == root.rstrip("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")
