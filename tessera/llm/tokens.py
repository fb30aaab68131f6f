"""Problem 2: token budget per source, language and host.

Texts are cut into the tokenizer's pieces by its own pattern (in the JVM); each distinct piece is
tokenized once; the cached lengths are joined back with the pieces of the documents, which gives exact
totals. The most frequent pieces, whose number and length are bounded, are broadcast, so the hot pieces
of a language are summed where they are read; the rare rest is aggregated per group (a slice of the corpus, or a
document) and joined in a shuffle. A text is cut once: the pieces are written and serve both passes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import stage

#: Broadcast at most so many pieces of at most so many characters: 64 k * 48 characters stay below 16 MB.
HEAD_PIECES, HEAD_CHARS = 65_536, 48

# Spellings of programming languages.
LANGUAGE_ALIASES = {
    "ex": "elixir",
    "exs": "elixir",
    "py": "python",
    "python3": "python",
    "rs": "rust",
    "rb": "ruby",
    "js": "javascript",
    "ecmascript": "javascript",
    "clj": "clojure",
    "golang": "go",
}


class MergeTokenizer:
    """A byte-level tokenizer given by merge rules, best rank first."""

    # Fixed value: the pattern that cuts a text into words.
    pattern = r"(?U) ?\p{L}+| ?\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+"

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.ranks = {}
        for rank, pair in enumerate(merges):
            self.ranks.setdefault(pair, rank)

    @staticmethod
    def from_table(df: DataFrame, most: int = 1_000_000) -> MergeTokenizer:
        """From (merge_rank, left_hex, right_hex); a tokenizer's rules are few, which ``most`` asserts."""
        rows = df.orderBy("merge_rank").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} merge rules")
        return MergeTokenizer([(bytes.fromhex(r.left_hex), bytes.fromhex(r.right_hex)) for r in rows])

    def count(self, piece: str) -> int:
        """Tokens of one piece: the adjacent pair of the lowest rank is joined, the left-most of equals first."""
        ranks = self.ranks
        parts: list[bytes | None] = [bytes([b]) for b in piece.encode("utf-8", "surrogatepass")]
        n = left = len(parts)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, *p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been joined to something else since
            parts[i], parts[j] = a + b, None
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (parts[i], parts[k])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, *p))
            if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in ranks:
                heapq.heappush(heap, (ranks[p], h, *p))
        return left


class RankTokenizer:
    """A public byte-level tokenizer from its file of ranks (base64 piece and rank per line).

    The file is read on the driver, so executors need no copy of it; ``path`` is where it lies.
    """

    # Fixed value: the pattern that cuts a text into pieces.
    pattern = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self._encoding = None

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "_encoding": None}

    def count(self, piece: str) -> int:
        if self._encoding is None:
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern.removeprefix("(?U)"), mergeable_ranks=self.ranks, special_tokens={})
        return len(self._encoding.encode_ordinary(piece))


def piece_lengths(pieces: DataFrame, tokenizer) -> DataFrame:
    """(piece, uses, tokens): every distinct piece tokenized once."""
    sent = pieces.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary: some megabytes, whatever the corpus

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = sent.value.count
        for batch in batches:
            yield batch.assign(tokens=[count(p) for p in batch["piece"]])

    used = pieces.where(F.col("piece").isNotNull()).groupBy("piece").agg(F.count(F.lit(1)).alias("uses"))
    return used.mapInPandas(lengths, "piece string, uses bigint, tokens int")


def _cut(df: DataFrame, tokenizer, text: str, **carry: Column) -> DataFrame:
    """(row, carry..., pieces): every row with a number of its own and the pieces of its text, cut once and written."""
    pieces = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(tokenizer.pattern), F.lit(0))
    cut = df.select(*[c.alias(name) for name, c in carry.items()], pieces.alias("__pieces"))
    # the number is fixed by writing it
    return stage(cut.withColumn("__row", F.monotonically_increasing_id()), "cut-texts")


def _sums(cut: DataFrame, tokenizer, *by: str) -> DataFrame:
    """(by..., tokens): the tokens of all rows of each group, null being a group. Groups without any piece are left out.

    Head pieces are summed where they are read; the rest meets its lengths in a shuffled join, in which a group has each
    piece once.
    """
    pieces = cut.select(*by, F.explode("__pieces").alias("piece"))
    lengths = stage(piece_lengths(pieces, tokenizer), "piece-lengths")
    short = lengths.where(F.length("piece") <= HEAD_CHARS)
    head = F.broadcast(short.orderBy(F.desc("uses"), "piece").limit(HEAD_PIECES).select("piece", F.col("tokens").alias("known")))
    rare = F.when(F.col("known").isNull(), F.col("piece"))
    summed = pieces.join(head, "piece", "left").groupBy(*by, rare.alias("piece")).agg(F.sum(F.coalesce("known", F.lit(0))).alias("known"), F.count(F.lit(1)).alias("n"))
    summed = stage(summed, "group-pieces")
    tail = summed.where(F.col("piece").isNotNull()).join(lengths.select("piece", "tokens"), "piece")
    parts = summed.where(F.col("piece").isNull()).select(*by, F.col("known").alias("t")).unionByName(tail.select(*by, (F.col("n") * F.col("tokens")).alias("t")))
    return parts.groupBy(*by).agg(F.sum("t").alias("tokens"))


def row_tokens(df: DataFrame, tokenizer, text: str = "text", *carry: str) -> DataFrame:
    """(carry..., tokens): one row per row of ``df`` with the exact number of tokens of its text.

    Null and empty texts have 0 tokens; blank ones have those of their white space. Rows that repeat a key or have none
    stay rows of their own. An empty table gives an empty result. Texts are counted whole, however long.
    """
    names = {f"c{n}": c for n, c in enumerate(carry)}
    cut = _cut(df, tokenizer, text, **{n: F.col(f"`{c}`") for n, c in names.items()})
    counted = cut.drop("__pieces").join(_sums(cut, tokenizer, "__row"), "__row", "left")
    return counted.select(*[F.col(n).alias(c) for n, c in names.items()], F.coalesce("tokens", F.lit(0)).alias("tokens"))


def count_tokens(df: DataFrame, tokenizer, key: str = "id", text: str = "text") -> DataFrame:
    """(key, tokens): :func:`row_tokens` with rows of the same key counted together (a null key is a key)."""
    counted = row_tokens(df, tokenizer, text, key)
    return counted.groupBy(F.col(f"`{key}`").alias(key)).agg(F.sum("tokens").alias("tokens")) if key != "tokens" else counted


def clean_source(source: Column) -> Column:
    """Case, outer white space and the separator (``-`` or ``_``) do not matter; missing is ``unknown``."""
    return F.coalesce(F.nullif(F.translate(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", "")), "-", "_"), F.lit("")), F.lit("unknown"))


def clean_language(language: Column) -> Column:
    """Lower case, trimmed, short names written out; missing is ``unknown``."""
    plain = F.coalesce(F.nullif(F.lower(F.regexp_replace(language, r"(?U)^\s+|\s+$", "")), F.lit("")), F.lit("unknown"))
    aliases = F.create_map(*[F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, plain), plain)


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and ``www.``; ``unknown`` where there is none."""
    low = F.lower(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""))
    with_scheme = F.regexp_extract(low, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    bare = F.regexp_extract(low, r"^((?:[a-z0-9-]+\.)+[a-z0-9-]+)(?::\d+)?(?:[/?#]|$)", 1)
    host = F.regexp_replace(F.when(with_scheme != "", with_scheme).otherwise(bare), r"^www\.", "")
    return F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))


def is_usable(text: Column, min_words: int) -> Column:
    """Whether a text is more than a stub: at least ``min_words`` runs of letters and digits."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+")) >= min_words, F.lit(False))


def token_totals(df: DataFrame, tokenizer, text: str = "text", source: str = "source", language: str = "language", url: str = "url", min_words: int = 20) -> DataFrame:
    """Totals per (source, language, host), per each of the three, and overall.

    Comes out: ``level`` (``slice``, ``source``, ``language``, ``host`` or ``all``), ``source``, ``language``, ``host`` (null where summed over), ``documents``,
    ``tokens``, ``usable_documents``, ``usable_tokens``. Every row counts, whatever its key; a null text has no tokens and is not usable. An empty
    table gives an empty result but for ``all``, whose sums are 0.
    """
    cut = _cut(
        df,
        tokenizer,
        text,
        source=clean_source(F.col(f"`{source}`")),
        language=clean_language(F.col(f"`{language}`")),
        host=url_host(F.col(f"`{url}`")),
        usable=is_usable(F.col(f"`{text}`"), min_words),
    )
    by = ["source", "language", "host", "usable"]
    held = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("documents")).join(_sums(cut, tokenizer, *by), by, "left")
    tokens = F.coalesce("tokens", F.lit(0))
    each = held.groupBy("source", "language", "host").agg(
        F.sum("documents").alias("documents"), F.sum(tokens).alias("tokens"), F.sum(F.when(F.col("usable"), F.col("documents")).otherwise(0)).alias("usable_documents"), F.sum(F.when(F.col("usable"), tokens).otherwise(0)).alias("usable_tokens")
    )
    each = stage(each, "slices")
    sums = ["documents", "tokens", "usable_documents", "usable_tokens"]

    def level(name: str, *by: str) -> DataFrame:
        summed = each.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
        return summed.select(F.lit(name).alias("level"), *[F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in ("source", "language", "host")], *sums)

    out = level("slice", "source", "language", "host")
    for by in ("source", "language", "host"):
        out = out.unionByName(level(by, by))
    return out.unionByName(level("all"))
