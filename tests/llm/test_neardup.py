import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neardup as n
from tessera.llm.words import plain_words


def shingles(text, k):
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold, least):
    sets = [(i, shingles(t, k)) for i, t in rows if t is not None and i is not None and len(plain_words(t)) >= least]
    out = set()
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if len(x & y) >= threshold * len(x | y):
            out.add((min(a, b), max(a, b)))
    return out


def corpus(seed=1, groups=25):
    rnd = random.Random(seed)
    words = [f"w{n}" for n in range(400)]
    rows, at = [], 0
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(25, 90))]
        for _ in range(rnd.randint(1, 5)):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((f"id{at:04}", " ".join(text).upper() if rnd.random() < 0.2 else ", ".join(text)))
            at += 1
    return rows


def test_pairs_match_brute_force(spark):
    rows = corpus() + [("z1", None), ("z2", ""), ("z3", "too short"), ("z4", "   "), (None, "x " * 40)]
    df = spark.createDataFrame([(i, t, "extra", 3) for i, t in rows], "id string, text string, n string, band int")
    found = n.NearDuplicates(df, threshold=0.6, shingle=3, min_words=20)
    got = [(r.id_a, r.id_b) for r in found.record_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6, 20)


def test_groups_are_the_components(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r for r in n.NearDuplicates(df, threshold=0.6, shingle=3, min_words=20).groups().collect()}
    assert set(got) == {i for i, _ in rows}
    pairs = brute(rows, 3, 0.6, 20)
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    for a, b in itertools.combinations(root, 2):
        assert (root[a] == root[b]) == (got[a].class_id == got[b].class_id)
    for i in root:
        assert got[i].class_size == sum(root[j] == root[i] for j in root)


def test_hot_buckets_and_copies_are_paired_whole(spark):
    """A third of the rows are copies and more are near-copies: small blocks must lose no pair."""
    base = [f"w{k}" for k in range(60)]
    near = []
    for k in range(40):
        text = list(base)
        text[k] = f"x{k}"
        near.append((f"n{k:03}", " ".join(text)))
    rows = near + [(f"c{k:03}", " ".join(base)) for k in range(30)]
    df = spark.createDataFrame(rows, "id string, text string")
    found = n.NearDuplicates(df, threshold=0.6, shingle=3, min_words=20, block_rows=7)
    got = [(r.id_a, r.id_b) for r in found.record_pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6, 20)
    groups = found.groups().collect()
    assert len({r.class_id for r in groups}) == 1 and all(r.class_size == 70 for r in groups)
    assert all(r.copies == (30 if r.id[0] == "c" else 1) for r in groups)


def test_empty_repeated_and_very_long(spark):
    empty = spark.createDataFrame([], "id string, text string")
    found = n.NearDuplicates(empty)
    assert found.record_pairs().count() == 0 and found.groups().count() == 0
    long = " ".join(f"w{k}" for k in range(60_000))
    df = spark.createDataFrame([("a", long), ("a", long), ("b", long + " tail"), ("c", "w1 w2 w3 w4 w5 w6")], "id string, text string")
    assert [(r.id_a, r.id_b) for r in n.NearDuplicates(df).record_pairs().collect()] == [("a", "b")]


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.6, 0.75, 0.9):
        estimates = []
        for _ in range(30):
            both = rng.integers(0, 2**63, int(1000 * share)).astype(np.uint64)
            rest = rng.integers(0, 2**63, 1000 - len(both)).astype(np.uint64)
            half = len(rest) // 2
            sets = [np.concatenate([both, rest[:half]]), np.concatenate([both, rest[half:]])]
            bounds = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
            sketch = n.odd_sketch(n.minhash(np.concatenate(sets), bounds, 128))
            bits = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
            estimates.append(n.estimated_similarity(bits, 128))
            assert bits <= n.most_odd_bits(share, 128)
        assert abs(np.mean(estimates) - share) < 0.04


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    both = edges.union(edges.select("y", "x"))
    assert {r.root for r in n.components(both).collect()} == {0}
