"""Problem 1: near-duplicate records with small edits, by odd sketches over banded MinHash.

1. Every record's words become a digest (exact copies collapse to one representative), ``bands * rows``
   MinHash samples of its word shingles and an odd sketch: the samples folded into a parity bitmap.
2. Representatives that agree in a whole band are candidates. Buckets are paired by a self-join whose hot
   buckets are split into blocks; pairs of hot buckets are pruned inside the join, before any shuffle.
3. The population count of the XOR of two sketches estimates their similarity; candidates well below the
   threshold are dropped, the rest is decided exactly on the shingle sets.

Only the first step and the exact check see texts. Nothing is capped: a bucket of any size is paired
whole, spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import WordHasher, gram_hashes, mix, plain_words
from tessera.runtime import broadcast_if_small, forget, heavy_keys, spread_join, stage

SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: Rows of a bucket that are paired in one block.
BLOCK_ROWS = 256


def minhash(grams: np.ndarray, bounds: np.ndarray, samples: int) -> np.ndarray:
    """(records, samples) least permuted hashes; record ``r`` owns ``grams[bounds[r]:bounds[r + 1]]``."""
    seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(bounds) - 1, samples), np.uint64)
    for s in range(samples):
        # an odd multiplier and a shift by xor permute the 64-bit words
        out[:, s] = np.minimum.reduceat((grams ^ seeds[s]) * (seeds[s] | np.uint64(1)), bounds[:-1])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(records, SKETCH_WORDS) parity bitmaps: each (sample number, value) toggles one bit."""
    k = samples.shape[1]
    bit = mix(samples ^ (np.arange(k, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))) % np.uint64(SKETCH_BITS)
    parity = np.zeros((len(samples), SKETCH_BITS), np.uint8)
    np.add.at(parity, (np.arange(len(samples))[:, None], bit.astype(np.int64)), 1)
    return np.packbits(parity & 1, axis=1, bitorder="little").view(np.uint64)


def most_odd_bits(threshold: float, samples: int, sigmas: float = 4.0) -> int:
    """The largest XOR population count that a pair of similarity ``threshold`` shows but for ``sigmas``
    standard deviations (of the MinHash samples and of the folding)."""
    differ = 2 * samples * (1 - threshold)
    decay = math.exp(-2 * differ / SKETCH_BITS)
    mean = SKETCH_BITS * (1 - decay) / 2
    folding = SKETCH_BITS * (1 - decay * decay) / 4
    sampling = 4 * samples * threshold * (1 - threshold) * decay * decay
    return int(mean + sigmas * math.sqrt(folding + sampling))


def estimated_similarity(odd_bits: float, samples: int) -> float:
    """The similarity at which ``odd_bits`` is the expected population count."""
    share = min(2 * odd_bits / SKETCH_BITS, 0.999999)
    return max(0.0, 1 + SKETCH_BITS * math.log(1 - share) / (4 * samples))


def _shingles(text: str, hasher: WordHasher, shingle: int, least: int) -> tuple[np.ndarray, bytes] | None:
    words = plain_words(text)
    if len(words) < max(least, shingle):
        return None
    return gram_hashes(hasher(words), shingle), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def signatures(df: DataFrame, key: str, text: str, shingle: int, least: int, bands: int, rows: int) -> DataFrame:
    """(id, digest, bands array, s0..s7): signature of every record of at least ``least`` words."""
    samples = bands * rows

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for batch in batches:
            ids, digests, parts = [], [], []
            for i, t in zip(batch["id"].tolist(), batch["text"].tolist()):
                if (found := _shingles(t, hasher, shingle, least)) is not None:
                    ids.append(i)
                    parts.append(found[0])
                    digests.append(found[1])
            if not ids:
                continue
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            values = minhash(np.concatenate(parts), bounds, samples)
            band = np.zeros((len(ids), bands), np.uint64)
            for b in range(bands):
                for r in range(rows):
                    band[:, b] = mix(band[:, b] * np.uint64(31) + values[:, b * rows + r])
                band[:, b] = mix(band[:, b] + np.uint64(b + 1))
            sketch = odd_sketch(values).view(np.int64)
            out = {"id": ids, "digest": digests, "bands": list(band.view(np.int64))}
            yield pd.DataFrame(out | {f"s{w}": sketch[:, w] for w in range(SKETCH_WORDS)})

    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    narrow = narrow.where(F.col("id").isNotNull() & (F.length("text") >= 2 * least - 1))
    columns = ", ".join(f"s{w} bigint" for w in range(SKETCH_WORDS))
    return narrow.mapInPandas(sign, f"id {kind}, digest binary, bands array<bigint>, {columns}")


def pairs_within(rows: DataFrame, bucket: str, item: str, carry: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (a, b), a < b, of the items of each bucket; a bucket of many rows is spread over blocks.

    ``rows`` has a column ``m``, the number of rows of its bucket. With ``b = ceil(m / block_rows)`` blocks,
    a row is sent to ``b`` tasks on one side and to one on the other, so no task gets a whole hot bucket.
    """
    blocks = F.ceil(F.col("m") / block_rows).cast("int")
    own = F.pmod(F.xxhash64(item), blocks).cast("int")
    left = rows.select(bucket, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col(item).alias("a"), *[F.col(c).alias(f"a_{c}") for c in carry])
    right = rows.select(bucket, own.alias("block"), F.col(item).alias("b"), *[F.col(c).alias(f"b_{c}") for c in carry])
    return left.join(right, [bucket, "block"]).where("a < b")


def _odd_bits(left: str, right: str):
    total = F.lit(0)
    for w in range(SKETCH_WORDS):
        total = total + F.bit_count(F.col(f"{left}s{w}").bitwiseXOR(F.col(f"{right}s{w}")))
    return total


class NearDuplicates:
    """Near-duplicate links between the distinct texts of ``df``.

    ``members``: (id, rep) for every record that takes part; ``links``: (a, b, similarity) between representatives, a < b,
    pairs of distinct texts whose shingle sets share at least ``threshold`` of their union. Every such link is exact, but a pair
    of similarity s is missed with probability (1 - s^rows)^bands: with 40 bands of 3 rows 6e-5 at 0.6 and less above (and 3e-5 by the
    sketch, at the threshold itself). More bands bring it as low as is wanted.

    Words are runs of letters and digits, lower-cased; texts with the same words are copies. Records
    with a null key or text, or fewer than ``min_words`` words (so also empty and blank ones), take no part. Keys
    are taken to be unique; rows that repeat a key and a text count once. An empty table gives empty
    results. The texts of very long records are processed whole. Other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.8, shingle: int = 5, min_words: int = 5, bands: int = 40, rows: int = 3, block_rows: int = BLOCK_ROWS):
        self.threshold, self.shingle, self.min_words, self.samples, self.block_rows = threshold, shingle, min_words, bands * rows, block_rows
        self._texts = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
        sketch = [f"s{w}" for w in range(SKETCH_WORDS)]
        signed = stage(signatures(df, key, text, shingle, min_words, bands, rows), "signatures")
        one = signed.groupBy("digest").agg(F.min(F.struct("id", "bands", *sketch)).alias("x"), F.count(F.lit(1)).alias("copies"))
        reps = one.select("digest", F.col("x.id").alias("rep"), F.col("x.bands").alias("bands"), *[F.col(f"x.{s}").alias(s) for s in sketch])
        # the number is fixed by writing it: a lost executor cannot change it
        self._reps = stage(reps.withColumn("n", F.monotonically_increasing_id()), "representatives")
        self.members = spread_join(signed.select("id", "digest").distinct(), self._reps.select("digest", "rep", "n"), "digest").select("id", "rep", "n")
        self._sketches = self._reps.select("n", *sketch)
        self.links = self._link()

    def _candidates(self) -> DataFrame:
        banded = self._reps.select("n", F.explode("bands").alias("band"))
        # the few buckets that are too large for one task are counted apart from the very many others
        full = broadcast_if_small(heavy_keys(banded, ["band"]).withColumnRenamed("__rows", "m"), 24)
        counted = banded.join(full.select("band"), "band", "left_anti").withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("m > 1")
        shared = stage(counted.unionByName(banded.join(full, "band")), "shared-bands")
        cold = pairs_within(shared.where(F.col("m") <= self.block_rows), "band", "n", block_rows=self.block_rows).select("a", "b")
        hot_rows = shared.where(F.col("m") > self.block_rows)
        cold = cold.distinct()
        most = most_odd_bits(self.threshold, self.samples)
        sketch = [f"s{w}" for w in range(SKETCH_WORDS)]
        cold = (
            cold.join(self._sketches.select(F.col("n").alias("a"), *[F.col(s).alias(f"a_{s}") for s in sketch]), "a")
            .join(self._sketches.select(F.col("n").alias("b"), *[F.col(s).alias(f"b_{s}") for s in sketch]), "b")
            .where(_odd_bits("a_", "b_") <= most)
            .select("a", "b")
        )
        if hot_rows.isEmpty():
            return cold
        hot = pairs_within(hot_rows.join(self._sketches, "n"), "band", "n", tuple(sketch), self.block_rows).where(_odd_bits("a_", "b_") <= most)
        return cold.unionByName(hot.select("a", "b")).distinct()

    def _link(self) -> DataFrame:
        pairs = stage(self._candidates(), "candidates")
        wanted = stage(pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct().join(self._reps.select("n", "rep"), "n"), "candidate-texts")
        texts = self._texts.join(broadcast_if_small(wanted.withColumnRenamed("rep", "id"), 64), "id").select("n", "text").dropDuplicates(["n"])
        shingle, least = self.shingle, self.min_words

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hasher = WordHasher()
            for batch in batches:
                blobs = []
                for t in batch["text"]:
                    found = _shingles(t, hasher, shingle, least)
                    # 32 of the 64 bits tell the few shingles of one pair apart
                    blobs.append(np.unique((found[0] >> np.uint64(32)).astype(np.uint32)).tobytes() if found else b"")
                yield pd.DataFrame({"n": batch["n"], "grams": blobs})

        grams = stage(texts.mapInPandas(sets, "n bigint, grams binary"), "shingle-sets")

        @F.pandas_udf("double")
        def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
            out = []
            for x, y in zip(left, right):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both) if len(x) and len(y) else 0.0)
            return pd.Series(out, dtype="float64")

        # a record may be a candidate with very many others
        joined = spread_join(pairs, grams.select(F.col("n").alias("a"), F.col("grams").alias("left")), "a", heavy=heavy_keys(pairs, ["a"]))
        joined = spread_join(joined, grams.select(F.col("n").alias("b"), F.col("grams").alias("right")), "b", heavy=heavy_keys(pairs, ["b"]))
        scored = joined.select("a", "b", jaccard("left", "right").alias("similarity")).where(F.col("similarity") >= self.threshold)
        return stage(scored, "links")

    def record_pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: the links written out for the records, copies included.

        n copies of a text are n * (n - 1) / 2 pairs; ``links`` with ``members`` say the same in n rows.
        """
        members = stage(self.members, "members")
        heavy = heavy_keys(members, ["n"])
        counts = members.groupBy("n").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        copies = pairs_within(spread_join(members, counts, "n", heavy=heavy), "n", "id", block_rows=self.block_rows).select("a", "b")
        # the class with more copies meets the links split, and so do the links of a text with very many of them
        left = spread_join(members.select(F.col("n").alias("a"), F.col("id").alias("x")), self.links.select("a", "b"), "a", heavy=heavy.withColumnRenamed("n", "a"))
        across = spread_join(left, members.select(F.col("n").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return copies.unionByName(across).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))

    def groups(self) -> DataFrame:
        """One row per record: (id, class_id, class_size, copies, links).

        ``class_id`` is the least representative that the record is linked to, directly or through others
        (a lone record is its own class); ``copies`` counts the records with the same words, ``links`` the
        links of its text to different texts.
        """
        both = self.links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(self.links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        root = components(both)
        degree = both.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
        members = stage(self.members, "members")
        heavy = heavy_keys(members, ["n"])
        by_rep = members.groupBy("n").agg(F.count(F.lit(1)).alias("copies"), F.min("rep").alias("rep"))
        reps = by_rep.join(root.withColumnRenamed("node", "n"), "n", "left").join(degree.withColumnRenamed("x", "n"), "n", "left")
        reps = stage(reps.select("n", "rep", "copies", F.coalesce("root", "n").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
        classes = reps.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
        reps = reps.drop("rep").join(classes, "root")
        return spread_join(members.select("id", "n"), reps, "n", heavy=heavy).select("id", "class_id", "class_size", "copies", "links")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): connected components of the symmetric ``edges`` (x, y); ``root`` is the least node.

    Each round takes the least label among the neighbours and then jumps to the label's own label, so
    chains halve. Labels stay distributed and are written at each round; only the number of changes
    reaches the driver.
    """
    edges = stage(edges.select("x", "y"), "edges")
    heavy = heavy_keys(edges, ["y"])
    labels = stage(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = spread_join(edges, labels.select(F.col("node").alias("y"), F.col("root")), "y", heavy=heavy).groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = stage(lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        forget(labels)
        labels, labels._staged_at = new.select("node", "root"), new._staged_at
        if new.where("was <> root").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
