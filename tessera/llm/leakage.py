"""Problem 6: evaluation texts leaking into training text.

Winnowing: of every window of ``span - k + 1`` consecutive k-gram hashes the least is kept, so any run
of ``span`` words that a document shares with a test item shares a fingerprint at the same place of the run. Fingerprints of both
sides are joined in Spark with their positions; a hit puts the words of the document and of the item side by
side (document position less item position), and is extended to the whole runs that agree there. Only documents with a hit are read again.

The test side is broadcast only if it is measured to be small; otherwise the joins are shuffled, split on wording that very many
documents hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import WordHasher, gram_hashes, reading_words
from tessera.runtime import broadcast_if_small, spread_join, stage


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the kept k-grams: in each window the least hash, the right-most of equals."""
    n = len(grams)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(grams[::-1]))]) if n else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    at = n - 1 - (np.arange(n - window + 1) + views.argmin(axis=1))
    return np.unique(at)


def _flat(spans: list[tuple[object, np.ndarray, np.ndarray]], key: str, kind: str) -> pd.DataFrame:
    sizes = [len(p) for _, p, _ in spans]
    keys = pd.Series([k for k, _, _ in spans]).repeat(sizes) if spans else pd.Series([], dtype="object")
    return pd.DataFrame(
        {
            key: keys.to_numpy(),
            "pos": np.concatenate([p for _, p, _ in spans]).astype(np.int32) if spans else np.empty(0, np.int32),
            kind: np.concatenate([h for _, _, h in spans]).view(np.int64) if spans else np.empty(0, np.int64),
        }
    )


def _hashed(df: DataFrame, key: str, text: str, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], kind: str) -> DataFrame:
    """(key, pos, hash) rows of every text; ``pick`` maps word hashes to positions and hashes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            yield _flat([(k, *pick(hasher(reading_words(t)))) for k, t in zip(batch.iloc[:, 0].tolist(), batch.iloc[:, 1].tolist())], "key", kind)

    k = F.col(f"`{key}`")
    narrow = df.select(k.alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    return narrow.mapInPandas(rows, f"key {df.schema[key].dataType.simpleString()}, pos int, {kind} bigint")


def fingerprints(df: DataFrame, key: str, text: str, k: int, span: int) -> DataFrame:
    """(key, pos, fp): the winnowed fingerprints of every text."""

    def pick(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(words) < span:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = gram_hashes(words, k)
        at = winnow(grams, span - k + 1)
        return at, grams[at]

    return _hashed(df, key, text, pick, "fp")


def excerpts(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, excerpt): the text between ``Excerpt:`` and ``Question:``, or the whole text without them."""
    body = F.regexp_extract(F.col(f"`{text}`"), r"(?s)Excerpt:\s*(.*?)\s*(?:\n\s*Question:|\z)", 1)
    return items.select(F.col(f"`{item}`").alias(item), F.when(body != "", body).otherwise(F.col(f"`{text}`")).alias("excerpt"))


def word_lists(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): the hashes of the words of every text, in order (64 bits each)."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "words": [hasher(reading_words(t)).tobytes() for t in batch["text"]]})

    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("key").isNotNull() & F.col("text").isNotNull())
    return narrow.mapInPandas(hashed, f"key {df.schema[key].dataType.simpleString()}, words binary")


def extend(doc: np.ndarray, item: np.ndarray, own: np.ndarray, diagonals: list[int], span: int) -> tuple[int, int, int] | None:
    """(shared runs of ``span`` words, words of the longest run, its least start in the document) on the diagonals of the hits.

    ``own`` tells of each item position whether the run of ``span`` words that starts there belongs to the item alone.
    """
    count, longest, starts = 0, 0, []
    for d in diagonals:
        low, high = max(0, -d), min(len(item), len(doc) - d)
        if high - low < span:
            continue
        agree = doc[low + d : high + d] == item[low:high]
        # a run of ``span`` words from each place on: as many agree as there are
        sums = np.concatenate([[0], np.cumsum(agree)])
        at = np.flatnonzero((sums[span:] - sums[:-span] == span) & own[low : high - span + 1])
        if len(at):
            count += len(at)
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            longest = max(longest, max(len(r) for r in runs) + span - 1)
            starts.append(int(at[0]) + low + d)
    return (count, longest, min(starts)) if count else None


def find_leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "excerpt", span: int = 10, k: int = 5) -> DataFrame:
    """Every (document, item) such that the document holds ``span`` consecutive words of the item.

    Comes out: ``doc_id``, ``item_id``, ``shared_grams`` (shared runs of ``span`` words), ``longest_run`` (words of the longest
    run shared without a break), ``first_word`` (where in the document the first run starts, from 0).

    Wording that different items share does not count: a run of ``span`` words that texts of different items hold gives no hit. Items
    with the same words (an item issued again) are one text, and each of them is reported. Rows that repeat an item under one
    key (an item revised) are no different items: wording that only they share counts. Null texts or keys and texts of
    fewer than ``span`` words give nothing; an empty table on either side gives an empty result. Of rows that repeat a document
    or item key the ones that share most count. Extra columns of either table are ignored.
    """
    if not 0 < k <= span:
        raise ValueError("needs 0 < k <= span")
    # items by their words; a text is known by the least of its items
    issued = stage(word_lists(items, item, item_text).distinct(), "item-words")
    texts = stage(issued.groupBy("words").agg(F.min("key").alias("key")), "item-texts")
    numbered = Window.partitionBy("key").orderBy("words")
    texts = texts.withColumn("t", F.concat_ws(":", F.col("key").cast("string"), F.row_number().over(numbered).cast("string")))
    owners = stage(issued.join(texts.select("words", "t"), "words").select("t", F.col("key").alias("item_id")), "owners")
    revised = owners.join(owners.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item_id"), "item_id")

    @F.pandas_udf("array<struct<pos:int,gram:bigint>>")
    def grams(words: pd.Series) -> pd.Series:
        return pd.Series([[{"pos": n, "gram": g} for n, g in enumerate(gram_hashes(np.frombuffer(w, np.uint64), span).view(np.int64).tolist())] for w in words])

    @F.pandas_udf("array<struct<pos:int,fp:bigint>>")
    def prints(words: pd.Series) -> pd.Series:
        out = []
        for w in words:
            h = gram_hashes(np.frombuffer(w, np.uint64), k)
            at = winnow(h, span - k + 1) if len(h) > span - k else np.empty(0, np.int64)
            out.append([{"pos": n, "fp": f} for n, f in zip(at.tolist(), h[at].view(np.int64).tolist())])
        return pd.Series(out)

    each = texts.select("t", F.explode(grams("words")).alias("g")).select("t", "g.pos", "g.gram")
    # a run that several texts hold is still one item's if that item has all of them
    holders = each.select("t", "gram").distinct()
    of_one = spread_join(holders, revised, "t", row_bytes=32).groupBy("gram", "item_id").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.max("n").alias("of_one"))
    alone = holders.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).join(of_one, "gram", "left").where("n = 1 or n = of_one").select("gram")
    own = stage(each.join(alone, "gram").select("t", "pos"), "own-grams")
    held = texts.join(own.groupBy("t").agg(F.sort_array(F.collect_list("pos")).alias("own")), "t")
    held = stage(held.select("t", "words", "own"), "own-texts")
    marks = held.select("t", F.explode(prints("words")).alias("f")).select("t", F.col("f.pos").alias("item_pos"), "f.fp").alias("f")
    inside = (F.col("f.item_pos") >= F.col("o.pos")) & (F.col("f.item_pos") <= F.col("o.pos") + span - k)
    test = stage(marks.join(own.alias("o"), (F.col("f.t") == F.col("o.t")) & inside, "left_semi"), "test-prints")
    hits = spread_join(fingerprints(docs, doc, text, k, span), test, "fp", row_bytes=32)
    sides = hits.groupBy("key", "t").agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("diagonals"))
    sides = stage(sides, "hits")
    wanted = broadcast_if_small(sides.select("key").distinct(), 16)
    again = word_lists(docs.join(wanted.withColumnRenamed("key", doc), doc, "left_semi"), doc, text).withColumnRenamed("words", "doc_words")

    @F.pandas_udf("struct<n:int,longest:int,first:int>")
    def extended(words: pd.Series, item_words: pd.Series, own: pd.Series, diagonals: pd.Series) -> pd.DataFrame:
        rows = []
        for w, i, o, d in zip(words, item_words, own, diagonals):
            of = np.frombuffer(i, np.uint64)
            mask = np.zeros(len(of), bool)
            mask[o] = True
            rows.append(extend(np.frombuffer(w, np.uint64), of, mask, d.tolist(), span) or (None, None, None))
        return pd.DataFrame(rows, columns=["n", "longest", "first"]).astype("Int32")

    pairs = sides.join(broadcast_if_small(held, 64), "t").join(again, "key")
    found = pairs.select("key", "t", extended("doc_words", "words", "own", "diagonals").alias("x")).where("x.n is not null")
    best = found.join(broadcast_if_small(owners, 32), "t").groupBy("key", "item_id").agg(F.max(F.struct("x.n", "x.longest", F.col("x.first").alias("first"))).alias("x"))
    return best.select(
        F.col("key").alias("doc_id"), "item_id", F.col("x.n").cast("bigint").alias("shared_grams"), F.col("x.longest").alias("longest_run"), F.col("x.first").alias("first_word")
    )
