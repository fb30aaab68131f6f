import numpy as np
import pytest

from tessera.llm import vectors as v

SMALL = v.SearchSettings(dimension=8, leaf_sample=10, branching=6, block_rows=300, chunk_rows=300, whole_rows=500, leaf_rows=64, recall=0.95, probe_queries=100)


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [float(y) for y in x], 1, "e") for i, x in rows], "id string, embedding array<float>, n int, unit string")


def brute(ids, rows, k=10):
    u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    return {i: [ids[j] for j in np.argsort(-sim[n], kind="stable")[:k]] for n, i in enumerate(ids)}, sim


def test_recall_in_blocks_and_chunks(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(1500, 8)).astype(np.float32)
    rows[700:720] = rows[0:20] * 3 + rng.normal(size=(20, 8)) * 0.01
    ids = [f"r{n:05}" for n in range(1500)]
    search = v.VectorSearch(table(spark, list(zip(ids, rows))), settings=SMALL)
    got = search.neighbours().collect()
    truth, sim = brute(ids, rows.astype(np.float64))
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == set(ids) and all(sorted(x.rank for x in r) == list(range(1, 11)) for r in by.values())
    assert all(r.id not in {x.neighbour for x in by[r.id]} for r in got)
    hits = sum(len(set(truth[i]) & {x.neighbour for x in by[i]}) for i in ids)
    assert hits / (10 * len(ids)) >= 0.9 and search.measured_recall >= 0.95 and search.visits < search.leaves
    close = {(r.id, r.neighbour) for r in search.neighbours(at_least=0.99).collect()}
    at = {i: n for n, i in enumerate(ids)}
    assert all(sim[at[a], at[b]] >= 0.99 for a, b in close)
    assert {(ids[n], ids[700 + n]) for n in range(20)} <= close


def test_unusable_copies_and_ties(spark):
    base = [1, 2, 3, 4, 5, 6, 7, 9]
    rows = [("null", None), ("short", [1, 2]), ("nan", [float("nan")] + [1] * 7), ("flat", [2] * 8), ("zero", [0] * 8), ("inf", [float("inf")] + base[1:])]
    rows += [(f"copy{n:03}", [x * (1 + n % 2) for x in base]) for n in range(30)] + [("other", [9, 7, 1, 0, 0, 0, 0, 1])]
    got = v.VectorSearch(table(spark, rows), settings=SMALL).neighbours().collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.rank, r.neighbour, r.similarity))
    assert set(by) == {i for i, _ in rows if i.startswith("copy")} | {"other"}
    assert [x[1] for x in sorted(by["copy000"])] == [f"copy{n:03}" for n in range(1, 11)]
    assert all(s == pytest.approx(1.0, abs=1e-3) for _, _, s in by["copy005"])
    assert [x[1] for x in sorted(by["other"])] == [f"copy{n:03}" for n in range(10)]


def test_tiny_and_empty(spark):
    assert v.VectorSearch(table(spark, []), settings=SMALL).neighbours().count() == 0
    assert v.VectorSearch(table(spark, [("a", range(8))]), settings=SMALL).neighbours().count() == 0
    pair = v.VectorSearch(table(spark, [("a", range(8)), ("b", range(1, 9))]), settings=SMALL).neighbours().collect()
    assert sorted((r.id, r.neighbour) for r in pair) == [("a", "b"), ("b", "a")]


def _tree(seed, rows=600, leaf=8):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(rows, 8)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return v.KMeansTree.fit(rows, 4, leaf, 1), rows


def test_walk_pops_the_best_bin_first_and_stops_at_the_bar():
    tree, rows = _tree(2)
    assert len(tree.leaves) > 20 and int(tree.depth.max()) > 1
    for q in rows[:10]:
        seen = []
        tree.walk(q[None, :], np.array([-2.0]), lambda leaf, who: seen.append(leaf))
        keys = tree.keys(q[None, :])[0]
        assert seen == np.argsort(-keys, kind="stable").tolist()
        few = []
        tree.walk(q[None, :], np.array([0.4]), lambda leaf, who: few.append(leaf))
        assert few == seen[: len(few)] and set(few) == set(np.flatnonzero(keys >= 0.4))
    assert tree.assign(rows).min() >= 0


def test_walk_of_a_batch_and_rising_bars():
    tree, rows = _tree(3)
    bars, visited = np.full(50, 0.2, np.float32), {}

    def visit(leaf, who):
        for w in who.tolist():
            visited.setdefault(w, []).append(leaf)
            if len(visited[w]) == 3:
                bars[w] = 2.0  # three leaves are enough for anyone

    tree.walk(rows[:50], bars, visit)
    assert all(len(x) <= 3 for x in visited.values()) and len(visited) == 50
    families = []
    tree.walk(rows[:50], np.full(50, 0.2, np.float32), None, family=lambda leaves, who, keys: families.extend((int(w), int(leaf)) for i, leaf in enumerate(leaves) for w in who[keys[i] >= 0.2]))
    keys = tree.keys(rows[:50])
    assert set(families) == {(int(a), int(b)) for a, b in zip(*np.nonzero(keys >= 0.2))}


def test_large_leaves_are_split_under_exact_bounds():
    rng = np.random.default_rng(4)
    rows = np.repeat(rng.normal(size=(6, 8)), 200, axis=0) + rng.normal(size=(1200, 8)) * 0.05
    rows = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    tree = v.KMeansTree.fit(rows[:40], 4, 40, 1)  # a single leaf
    plan = v._Plan(tree, v.StopRule(0.0, 2.0), np.zeros(1, int), np.ones(1, int), np.ones(1, int), np.zeros(1, int), np.zeros(1, int), np.empty(0), np.empty((0, 8)))
    block = v._Block(plan, v.SearchSettings(dimension=8, leaf_rows=64, branching=8), np.arange(1200), np.zeros(1200, int), rows)
    assert len(block.bins[0][2]) > 6 and max(b - a for a, b in block.bins[0][2]) < 600
    found = block.search(np.arange(1200), rows, np.full(1200, -2, np.float32))
    sim = rows @ rows.T
    np.fill_diagonal(sim, -2)
    best = -np.sort(-sim, axis=1)[:, :10]
    assert np.allclose(np.stack(found.set_index("n").loc[range(1200), "near_s"].to_numpy()), best, atol=1e-5)


def test_samples_of_very_large_tables(spark):
    rng = np.random.default_rng(6)
    search = v.VectorSearch(table(spark, [(f"r{n:04}", x) for n, x in enumerate(rng.normal(size=(1000, 8)))]), settings=SMALL)
    n, rows = search._sample(100, 11)
    assert len(n) == len(rows) == 100 and len(set(n)) == 100
    assert search._sample(5000, 11)[0].size == 1000
    # as if these were a thousand of 400 million rows: the bar stays that fine, and having drawn nothing is no error
    search.total = 400_000_000
    assert search._sample(256, 11)[0].size == 0
    tree, _ = _tree(2)
    stop, seen = search._calibrate(tree, np.ones(len(tree.leaves)), n, rows)
    assert seen.all() and (stop.bars(np.ones(3)) < -1).all()
    assert len(search._sample(300_000_000, 3)[0]) > 600


def test_half_of_the_rows_are_copies_of_one_vector(spark):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(300, 8))
    rows[150:] = rows[0] * np.linspace(1, 2, 150)[:, None].round(0)
    ids = [f"r{n:03}" for n in range(300)]
    got = v.VectorSearch(table(spark, list(zip(ids, rows.astype(np.float32)))), settings=SMALL).neighbours().collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == set(ids) and all(len(x) == 10 for x in by.values())
    assert all(x.similarity > 0.999 for i in ["r000", *ids[150:]] for x in by[i])
