"""Problem 5: the k most similar vectors of every vector, by a hierarchical k-means tree.

The upper tree is fitted on the driver to a bounded sample; every row is indexed. A query walks the tree best bin first: a priority
queue holds the nodes that it may still have to see, by the bound that the angle to their centroid and their radius allow, and is
popped until no bin is left whose key reaches the query's bar. Queries walk in batches: an entry of the queue is a node with all
queries of the batch that want it, so that opening a node or visiting a leaf is one matrix product.

A query's bar follows from the similarity of its k-th best row in a bounded sample, so each query ends its walk at a number of leaves
of its own. How far the bars lie below is widened until the recall, measured against brute force over the whole table for a
sample of queries, reaches the target. A leaf that holds many rows is split again where it lies, under exact bounds that follow the
k-th best row so far, so that leaves stay small however large the table is.

The search is a distributed join of queries with groups of neighbouring leaves. A task holds one block of a group and one chunk
of the queries that visit it; both are bounded, so neither a hot leaf nor a hot query region lands in one task. Every row is
shipped to ``max(sqrt(2 * cores), rows / block_rows)`` tasks at most on either side: once there are more than ``block_rows`` rows per
root of twice the cores, and where the vectors do not cluster, so that a query visits all groups, this grows with the table.
Exact copies of a vector are searched once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import broadcast_if_small, spread_join, stage


@dataclass(frozen=True)
class SearchSettings:
    """Bounds and targets of the index; none of them leaves out a row."""

    k: int = 10
    dimension: int = 64
    #: Rows at most that the upper tree is fitted to, and sampled rows per leaf.
    fit_rows: int = 80_000
    leaf_sample: int = 20
    branching: int = 64
    #: Rows of a leaf beyond which it is split again where it lies.
    leaf_rows: int = 512
    #: Sampled queries that are answered by brute force to set the bars, and the recall they must reach.
    probe_queries: int = 256
    recall: float = 0.91
    #: Sampled rows that give every query a lower bound of its k-th similarity.
    bound_rows: int = 2048
    #: Data rows and queries at most (as estimated from the sample) in one task.
    block_rows: int = 200_000
    chunk_rows: int = 200_000
    #: Tables of so many rows at most are one block and one chunk: dealing them out costs more than the search.
    whole_rows: int = 4_000
    seed: int = 7


class KMeansTree:
    """Nodes in breadth-first order; ``leaves`` are the nodes without children, in tree order."""

    def __init__(self, centroids: np.ndarray, parent: np.ndarray, depth: np.ndarray, leaves: np.ndarray):
        self.centroids, self.parent, self.depth, self.leaves = centroids, parent, depth, leaves
        self.number = np.full(len(parent), -1)
        self.number[leaves] = np.arange(len(leaves))
        self.children: dict[int, np.ndarray] = {}
        for node in range(1, len(parent)):
            self.children.setdefault(int(parent[node]), []).append(node)
        self.children = {node: np.asarray(below) for node, below in self.children.items()}
        self.radius = self._radii()

    @staticmethod
    def fit(rows: np.ndarray, branching: int, leaf_rows: int, seed: int) -> KMeansTree:
        """Spherical k-means, split by split, until a node has at most ``leaf_rows`` of the sample."""
        rng = np.random.default_rng(seed)
        nodes, parent, depth, order = [_mean(rows)], [-1], [0], []
        level = [(0, np.arange(len(rows)))]
        children: dict[int, list[int]] = {}
        while level:
            following = []
            for node, members in level:
                parts = min(branching, len(members) // leaf_rows)
                split = _kmeans(rows[members], parts, rng) if parts > 1 else None
                if split is None:
                    continue
                for centroid, of in split:
                    children.setdefault(node, []).append(len(nodes))
                    following.append((len(nodes), members[of]))
                    nodes.append(centroid)
                    parent.append(node)
                    depth.append(depth[node] + 1)
            level = following
        stack = [0]
        while stack:
            node = stack.pop()
            if node in children:
                stack.extend(reversed(children[node]))
            else:
                order.append(node)
        return KMeansTree(np.asarray(nodes, np.float32), np.asarray(parent), np.asarray(depth), np.asarray(order))

    def _radii(self) -> np.ndarray:
        """Per node the largest angle between its centroid and that of a leaf under it."""
        radius = np.zeros(len(self.parent))
        for leaf in self.leaves.tolist():
            node = int(self.parent[leaf])
            while node >= 0:
                radius[node] = max(radius[node], math.acos(float(np.clip(self.centroids[node] @ self.centroids[leaf], -1, 1))))
                node = int(self.parent[node])
        return radius

    def keys(self, queries: np.ndarray) -> np.ndarray:
        """(queries, leaves): the similarity of every query and every leaf's centroid."""
        return queries @ self.centroids[self.leaves].T

    def above(self, leaves: np.ndarray) -> set[int]:
        """The nodes on the way to some leaves."""
        found: set[int] = set()
        for node in self.leaves[leaves].tolist():
            while node >= 0 and node not in found:
                found.add(node)
                node = int(self.parent[node])
        return found

    def walk(self, queries: np.ndarray, bars: np.ndarray, visit: Callable[[int, np.ndarray], None], only: set[int] | None = None, family: Callable[[np.ndarray, np.ndarray, np.ndarray], None] | None = None) -> None:
        """Best-bin-first walks of a batch of queries from the root.

        ``visit(leaf, who)`` is called once for each leaf that queries ``who`` must see, the best bin first. A query sees a node as long as
        the node's bound reaches its bar; ``visit`` may raise ``bars``, which ends walks. ``only`` limits the walk to some nodes. With
        ``family(leaves, who, keys)`` the leaves of an opened node are handed over together, by their keys, instead of being queued.
        """
        queue: list = [(-1.0, 0, np.arange(len(queries)), None)]
        while queue:
            _, node, who, key = heapq.heappop(queue)
            if key is not None:  # the bars may have risen since
                who = who[key >= bars[who]]
            if not len(who):
                continue
            if (leaf := int(self.number[node])) >= 0:
                visit(leaf, who)
                continue
            below = self.children[node]
            if only is not None:
                below = np.asarray([c for c in below.tolist() if c in only])
            whole = len(who) == len(queries)
            bound = self.centroids[below] @ (queries if whole else queries[who]).T
            inner = self.number[below] < 0
            if inner.any():
                angle = np.arccos(np.clip(bound[inner], -1, 1)) - self.radius[below[inner]][:, None]
                bound[inner] = np.cos(np.maximum(angle - 1e-3, 0))
            least = bars if whole else bars[who]
            if family is not None and not inner.all():
                family(self.number[below[~inner]], who, bound[~inner])
            for j, child in enumerate(below.tolist()):
                if family is None or inner[j]:
                    at = np.flatnonzero(bound[j] >= least)
                    if len(at):
                        heapq.heappush(queue, (-float(bound[j][at].max()), child, who[at], bound[j][at]))

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: at every node the nearest child."""
        at = np.zeros(len(rows), np.int64)
        for d in range(int(self.depth.max())):
            for node in np.unique(at[self.depth[at] == d]).tolist():
                if node in self.children:
                    of = np.flatnonzero(at == node)
                    below = self.children[node]
                    at[of] = below[(rows[of] @ self.centroids[below].T).argmax(axis=1)]
        return self.number[at]


def _mean(rows: np.ndarray) -> np.ndarray:
    total = rows.sum(axis=0)
    return total / max(float(np.linalg.norm(total)), 1e-12)


def _kmeans(rows: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> list[tuple[np.ndarray, np.ndarray]] | None:
    centroids = rows[rng.choice(len(rows), parts, replace=False)].copy()
    for _ in range(rounds):
        of = (rows @ centroids.T).argmax(axis=1)
        for p in range(parts):
            if (mine := of == p).any():
                centroids[p] = _mean(rows[mine])
    of = (rows @ centroids.T).argmax(axis=1)
    found = [(centroids[p], np.flatnonzero(of == p)) for p in range(parts) if (of == p).any()]
    return found if len(found) > 1 else None


def _floats(blobs, dimension: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, dimension).astype(np.float32)


def usable_vectors(df: DataFrame, key: str, vector: str, dimension: int) -> DataFrame:
    """(id, unit): unit vectors (float32 bytes) of the rows whose vector takes part in a search."""
    v = F.col("vector")

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                norm = np.linalg.norm(rows, axis=1)
                good = np.isfinite(norm) & (norm > 0)
                rows = (rows[good] / norm[good, None]).astype(np.float32) + np.float32(0)  # no negative zeros
                yield pd.DataFrame({"id": batch["id"][good], "unit": [r.tobytes() for r in rows]})

    narrow = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    sound = narrow.where(F.col("id").isNotNull() & (F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (F.array_min(v) < F.array_max(v)))
    return sound.mapInPandas(unit, f"id {df.schema[key].dataType.simpleString()}, unit binary")


def _nearest(n: np.ndarray, rows: np.ndarray, sample_n: np.ndarray, sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the k nearest of the sample (places, similarities; -2 marks the row itself), and the k-th similarity (or -2)."""
    sim = rows @ sample.T
    sim[n[:, None] == sample_n[None, :]] = -2
    most = min(k, sim.shape[1])
    best = np.argpartition(-sim, most - 1, axis=1)[:, :most] if most else np.empty((len(n), 0), np.int64)
    near = np.take_along_axis(sim, best, 1)
    return best, near, near.min(axis=1) if most == k else np.full(len(n), -2, np.float32)


@dataclass(frozen=True)
class StopRule:
    """A query whose k-th best similarity in the sample is ``t`` visits the leaves whose key is at least ``slope * t - slack``."""

    slope: float
    slack: float

    def bars(self, kth: np.ndarray) -> np.ndarray:
        # keys are computed anew from the rounded form in which queries are shipped: leave its error some room
        return (self.slope * kth - self.slack - 5e-4).astype(np.float32)


@dataclass(frozen=True)
class _Plan:
    """What the tasks need to know; its size is bounded by the settings, but for a few numbers per group and task."""

    tree: KMeansTree
    stop: StopRule
    group_of_leaf: np.ndarray
    #: Per group its blocks, its chunks, and the number of its first task; per task the label that hashes to its partition.
    blocks: np.ndarray
    chunks: np.ndarray
    first: np.ndarray
    labels: np.ndarray
    bound_rows: np.ndarray
    bound_units: np.ndarray

    @property
    def tasks(self) -> int:
        return int((self.blocks * self.chunks).sum())


class _Best:
    """The k best rows so far of each query of a batch."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.n = floors, k, len(floors)
        self.q, self.row, self.sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, q: np.ndarray, row: np.ndarray, sim: np.ndarray) -> None:
        self.new.append((q, row, sim))
        self.pending += len(q)

    def settle(self) -> None:
        """Keep the k best and raise the floors to the k-th."""
        if not self.new:
            return
        q, row, sim = (np.concatenate(x) for x in zip((self.q, self.row, self.sim), *self.new))
        # one integer that sorts by query and then by falling similarity
        bits = sim.view(np.uint32)
        rising = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        order = np.argsort((q << 32) | (~rising).astype(np.int64))
        q, row, sim = q[order], row[order], sim[order]
        starts = np.searchsorted(q, np.arange(self.n + 1))
        keep = np.arange(len(q)) - starts[q] < self.k
        full = np.flatnonzero(np.diff(starts) >= self.k)
        self.floors[full] = np.maximum(self.floors[full], sim[starts[full] + self.k - 1])
        self.q, self.row, self.sim = q[keep], row[keep], sim[keep]
        self.new, self.pending = [], 0


class _Block:
    """The rows of one block, leaf by leaf; leaves of many rows are split again."""

    def __init__(self, plan: _Plan, s: SearchSettings, numbers: np.ndarray, leaf: np.ndarray, rows: np.ndarray):
        self.plan, self.s = plan, s
        self.held, starts = np.unique(leaf, return_index=True)
        self.only = plan.tree.above(self.held)
        order = np.arange(len(leaf))
        self.bins: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]] = {}
        self.span: dict[int, tuple[int, int]] = {}
        for of, a, b in zip(self.held.tolist(), starts.tolist(), [*starts[1:].tolist(), len(leaf)]):
            self.span[of] = a, b
            if b - a > s.leaf_rows:
                part = KMeansTree.fit(rows[a:b], s.branching, s.leaf_rows // 2, s.seed)
                at = part.assign(rows[a:b])
                inside = np.argsort(at, kind="stable")
                order[a:b] = a + inside
                cuts = np.searchsorted(at[inside], np.arange(len(part.leaves) + 1))
                centroids = part.centroids[part.leaves]
                near = (rows[a:b] * centroids[at]).sum(axis=1)
                radius = np.array([np.arccos(np.clip(near[at == p].min(initial=1.0), -1, 1)) for p in range(len(part.leaves))])
                self.bins[of] = centroids, radius, [(a + int(x), a + int(y)) for x, y in zip(cuts, cuts[1:])]
        self.numbers = numbers[order]
        # a further component of 1 meets the query's negative floor: what reaches the floor is not negative
        self.rows = np.zeros((len(rows), s.dimension + 4), np.float32)
        self.rows[:, : s.dimension], self.rows[:, s.dimension] = rows[order], 1

    def search(self, n: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> pd.DataFrame | None:
        """(n, near_n, near_s) of the k best rows of the block that reach the queries' floors."""
        s = self.s
        bars, best = self.plan.stop.bars(floors), _Best(floors - np.float32(5e-4), s.k)
        asked = np.zeros((len(queries), s.dimension + 4), np.float32)
        asked[:, : s.dimension], asked[:, s.dimension] = queries, -best.floors

        def scan(a: int, b: int, who: np.ndarray) -> None:
            over = self.rows[a:b] @ asked[who].T
            at = np.flatnonzero(over >= 0)
            if len(at):
                y, x = np.divmod(at, len(who))
                q, row = who[x], self.numbers[a + y]
                other = n[q] != row
                q = q[other]
                best.add(q, row[other], over.ravel()[at[other]] - asked[q, s.dimension])
            if best.pending > 24 * len(queries):
                best.settle()
                asked[:, s.dimension] = -best.floors

        def visit(leaf: int, who: np.ndarray) -> None:
            if leaf not in self.bins:
                scan(*self.span[leaf], who)
                return
            centroids, radius, spans = self.bins[leaf]
            angle = np.arccos(np.clip(centroids @ asked[who, : s.dimension].T, -1, 1)) - radius[:, None]
            bound = np.cos(np.maximum(angle - 1e-3, 0))
            for p in np.argsort(-bound.max(axis=1)).tolist():
                some = who[bound[p] >= best.floors[who]]
                if len(some) and spans[p][0] < spans[p][1]:
                    scan(*spans[p], some)

        self.plan.tree.walk(queries, bars, visit, self.only)
        best.settle()
        which, begin = np.unique(best.q, return_index=True)
        return pd.DataFrame({"n": n[which], "near_n": np.split(best.row, begin[1:]), "near_s": np.split(best.sim, begin[1:])}) if len(which) else None


class VectorSearch:
    """The k nearest neighbours by cosine of every usable row of ``df``.

    Usable: a non-null key and ``dimension`` components without null, NaN or infinity that are not all
    equal (so no zero vector). All other rows, and other columns, are left out. Keys are taken to be unique. Fewer
    than k + 1 usable rows give fewer neighbours; an empty table gives an empty result. Equal similarities:
    the lesser key first. Rows with the same direction are each other's neighbours at similarity 1.

    ``measured_recall`` holds the recall of the sampled queries against brute force, ``visits`` the leaves that
    a sampled query visits on average, ``leaves`` how many there are, ``copies`` to how many tasks a row is shipped at most.
    """

    def __init__(self, df: DataFrame, key: str = "id", vector: str = "embedding", settings: SearchSettings | None = None):
        self.s = settings or SearchSettings()
        s = self.s
        # two hashes, 128 bits, tell distinct vectors apart
        units = usable_vectors(df, key, vector, s.dimension).select("id", "unit", F.xxhash64("unit").alias("h"), F.xxhash64(F.lit(1), "unit").alias("g"))
        units = stage(units, "units")
        one = units.groupBy("h", "g").agg(F.min("id").alias("rep"), F.first("unit").alias("unit"))
        self._rows = stage(one.withColumn("n", F.monotonically_increasing_id()), "distinct-units")
        self._units = units
        self.total = self._rows.count()
        self.visits = self.leaves = 0
        self.copies = 1
        self.measured_recall = 1.0
        self._lists = self._search() if self.total > 1 else None

    def _sample(self, rows: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """``rows`` rows (a few less in an unlucky draw, all if there are no more), picked by a hash of their number: the same ones in
        every run. The hash has 64 bits, so the share may be as small as it likes."""
        picked = self._rows.select("n", "unit", F.xxhash64("n", F.lit(salt)).alias("lot"))
        if rows < self.total:
            share = min(1.0, (rows + 6 * math.sqrt(rows) + 16) / self.total)
            picked = picked.where(F.col("lot") <= min(2**63 - 1, int(share * 2**64) - 2**63))
        got = picked.orderBy("lot", "n").limit(rows).toPandas()
        return got["n"].to_numpy(np.int64), _floats(got["unit"], self.s.dimension)

    def _brute_force(self, numbers: np.ndarray, queries: np.ndarray) -> pd.DataFrame:
        """(q, sim, unit) of the k nearest of the sampled queries, from the whole table."""
        s = self.s
        sent = self._rows.sparkSession.sparkContext.broadcast((numbers, queries))

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            numbers, queries = sent.value
            for batch in batches:
                if len(batch):
                    n, rows = batch["n"].to_numpy(), _floats(batch["unit"], s.dimension)
                    sim = queries @ rows.T
                    sim[numbers[:, None] == n[None, :]] = -2
                    best = np.argsort(-sim, axis=1)[:, : s.k] if len(n) <= s.k else np.argpartition(-sim, s.k - 1, axis=1)[:, : s.k]
                    q = np.repeat(np.arange(len(queries)), best.shape[1])
                    at = best.ravel()
                    yield pd.DataFrame({"q": q, "n": n[at], "sim": sim[q, at], "unit": batch["unit"].to_numpy()[at]})

        found = self._rows.select("n", "unit").mapInPandas(nearest, "q int, n bigint, sim float, unit binary").where("sim > -1.5")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))
        return found.withColumn("r", rank).where(F.col("r") <= s.k).select("q", "sim", "unit").toPandas()

    def _calibrate(self, tree: KMeansTree, sizes: np.ndarray, bound_n: np.ndarray, bound: np.ndarray) -> tuple[StopRule, np.ndarray]:
        """The rule that lets the sampled queries find ``recall`` of their true neighbours at the least rows; (queries, leaves) visited."""
        numbers, queries = self._sample(self.s.probe_queries, 11)
        truth = self._brute_force(numbers, queries) if len(numbers) else pd.DataFrame({"q": [], "sim": [], "unit": []})
        if not len(truth):  # nothing to measure by: every leaf is visited
            return StopRule(0.0, 2.0), np.ones((1, len(tree.leaves)), bool)
        keys, q = tree.keys(queries), truth["q"].to_numpy(np.int64)
        kth = _nearest(numbers, queries, bound_n, bound, self.s.k)[2]
        own = keys[q, tree.assign(_floats(truth["unit"], self.s.dimension))]
        tried = []
        for slope in (0.0, 0.5, 1.0):
            # widened neighbour by neighbour up to the one that makes the recall
            needed = np.sort(slope * kth[q] - own)
            slack = float(needed[min(len(needed) - 1, max(0, math.ceil(self.s.recall * len(needed)) - 1))])
            seen = keys >= (slope * kth - slack)[:, None]
            tried.append((float((seen * sizes).sum()), slope, slack, seen, float((needed <= slack).mean())))
        _, slope, slack, seen, self.measured_recall = min(tried, key=lambda t: t[:2])
        self.visits = int(round(seen.sum(axis=1).mean()))
        return StopRule(slope, slack), seen

    def _plan(self) -> _Plan:
        s, spark = self.s, self._rows.sparkSession
        _, fit = self._sample(s.fit_rows, 3)
        tree = KMeansTree.fit(fit, s.branching, s.leaf_sample, s.seed)
        self.leaves = len(tree.leaves)
        expected = np.bincount(tree.assign(fit), minlength=self.leaves) * (self.total / len(fit))
        bound_n, bound = self._sample(s.bound_rows, 5)
        stop, seen = self._calibrate(tree, expected, bound_n, bound)
        # every core gets a task or two, and no task more than a block and a chunk
        least = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism)) if self.total > s.whole_rows else 1
        most = min(s.block_rows, math.ceil(1.02 * self.total / least))
        group, rows, groups = np.zeros(self.leaves, np.int64), 0.0, 0
        for leaf in range(self.leaves):
            if rows and rows + expected[leaf] > most:
                groups, rows = groups + 1, 0.0
            group[leaf], rows = groups, rows + expected[leaf]
        groups += 1
        sizes = np.bincount(group, weights=expected, minlength=groups)
        visiting = np.stack([seen[:, group == g].any(axis=1).mean() for g in range(groups)])
        blocks = np.maximum(1, np.ceil(sizes / (1.05 * most))).astype(np.int64)
        chunks = np.maximum(1, np.ceil(visiting * self.total / min(s.chunk_rows, math.ceil(1.02 * self.total / least)))).astype(np.int64)
        self.copies = int(max(chunks.max(), blocks.sum()))
        tasks = int((blocks * chunks).sum())
        return _Plan(tree, stop, group, blocks, chunks, np.concatenate([[0], np.cumsum(blocks * chunks)[:-1]]), self._labels(tasks), bound_n, bound)

    def _labels(self, tasks: int) -> np.ndarray:
        """A label per task number such that each label hashes to a partition of its own.

        Without it a hash of few tasks would put several into one partition and leave others empty. Of
        very many tasks the plain numbers spread evenly enough.
        """
        if tasks > 5_000:
            return np.arange(tasks)
        labels = self._rows.sparkSession.range(40 * tasks).select(F.col("id").cast("int").alias("label")).withColumn("part", F.pmod(F.hash("label"), F.lit(tasks)))
        of = {r.part: r.label for r in labels.groupBy("part").agg(F.min("label").alias("label")).collect()}
        free = iter(range(40 * tasks, 41 * tasks))
        return np.asarray([of[t] if t in of else next(free) for t in range(tasks)])

    def _search(self) -> DataFrame:
        s = self.s
        plan = self._rows.sparkSession.sparkContext.broadcast(self._plan())

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p = plan.value
            for whole in batches:
                for a in range(0, len(whole), 4096):
                    batch = whole.iloc[a : a + 4096]
                    n, rows = batch["n"].to_numpy(), _floats(batch["unit"], s.dimension)
                    best, near, floor = _nearest(n, rows, p.bound_rows, p.bound_units, s.k)
                    bars, seen = p.stop.bars(floor), np.zeros((len(p.blocks), len(n)), bool)

                    def note(leaves: np.ndarray, who: np.ndarray, keys: np.ndarray) -> None:
                        reached = keys >= bars[who]
                        for g in np.unique(p.group_of_leaf[leaves]).tolist():
                            seen[g, who[reached[p.group_of_leaf[leaves] == g].any(axis=0)]] = True

                    def alone(leaf: int, who: np.ndarray) -> None:  # a tree that is a single leaf
                        seen[p.group_of_leaf[leaf], who] = True

                    p.tree.walk(rows, bars, alone, family=note)
                    leaf = p.tree.assign(rows)
                    lot = (n * 0x9E3779B1) & 0x7FFFFFFF
                    asks, holds = [], []
                    for i, g in enumerate(p.group_of_leaf[leaf].tolist()):
                        tasks = [p.first[h] + b * p.chunks[h] + (lot[i] >> 8) % p.chunks[h] for h in np.flatnonzero(seen[:, i]) for b in range(p.blocks[h])]
                        asks.append(p.labels[np.asarray(tasks, np.int64)].astype(np.int32))
                        at = p.first[g] + (lot[i] >> 4) % p.blocks[g] * p.chunks[g]
                        holds.append(p.labels[at : at + p.chunks[g]].astype(np.int32))
                    yield pd.DataFrame(
                        {"n": n, "leaf": leaf, "half": [h.tobytes() for h in rows.astype(np.float16)], "floor": floor, "asks": asks, "holds": holds, "near_n": list(p.bound_rows[best]), "near_s": list(near)}
                    )

        schema = "n bigint, leaf int, half binary, floor float, asks array<int>, holds array<int>, near_n array<bigint>, near_s array<float>"
        routed = stage(self._rows.select("n", "unit").mapInPandas(route, schema), "routed")
        p = plan.value
        asked = routed.select("n", "half", "floor", F.explode("asks").alias("task")).repartition(p.tasks, "task")
        held = routed.select(F.col("n").alias("m"), F.col("half").alias("row"), F.col("leaf").alias("of_leaf"), F.explode("holds").alias("task")).repartition(p.tasks, "task")

        def scan(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(queries) and len(data):
                data = data.sort_values("of_leaf", kind="stable")
                block = _Block(plan.value, s, data["m"].to_numpy(), data["of_leaf"].to_numpy(), _floats(data["row"], s.dimension, np.float16))
                n, rows, floors = queries["n"].to_numpy(), _floats(queries["half"], s.dimension, np.float16), queries["floor"].to_numpy()
                for a in range(0, len(n), 16384):
                    if (found := block.search(n[a : a + 16384], rows[a : a + 16384], floors[a : a + 16384])) is not None:
                        out.append(found)
            return pd.concat(out) if out else pd.DataFrame({"n": [], "near_n": [], "near_s": []})

        lists = asked.groupBy("task").cogroup(held.groupBy("task")).applyInPandas(scan, "n bigint, near_n array<bigint>, near_s array<float>")
        lists = lists.unionByName(routed.select("n", "near_n", "near_s"))
        zipped = lists.select("n", F.filter(F.zip_with("near_s", "near_n", lambda sim, n: F.struct((-sim).alias("d"), n.alias("m"))), lambda x: x["d"] < 1.5).alias("near"))
        merged = zipped.groupBy("n").agg(F.flatten(F.collect_list("near")).alias("near"))
        # a row found both in the sample and in its leaf has two entries; 2k of them hold k different ones
        best = F.slice(F.array_sort("near"), 1, 2 * s.k)
        return stage(merged.select("n", best.alias("near")), "neighbour-lists")

    def _exact(self, near: DataFrame, at_least: float) -> DataFrame:
        """(n, m, similarity) of the pairs of at least ``at_least``, from the full-precision vectors."""
        dimension = self.s.dimension
        pairs = stage(near.where(F.col("similarity") >= at_least - 2e-3).select("n", "m").distinct(), "near-pairs")
        ends = broadcast_if_small(pairs.select("n").union(pairs.select("m")).distinct(), 16)
        units = stage(self._rows.join(ends, "n", "left_semi").select("n", "unit"), "near-units")

        @F.pandas_udf("double")
        def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            a, b = _floats(x, dimension).astype(np.float64), _floats(y, dimension).astype(np.float64)
            return pd.Series(np.clip((a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)), -1, 1))

        left, right = units.select("n", F.col("unit").alias("x")), units.select(F.col("n").alias("m"), F.col("unit").alias("y"))
        # a row has at most 2k partners here, but may be the partner of very many
        scored = spread_join(pairs.join(left, "n"), right, "m").select("n", "m", cosine("x", "y").alias("similarity"))
        return scored.where(F.col("similarity") >= at_least)

    def neighbours(self, at_least: float | None = None) -> DataFrame:
        """(id, neighbour, similarity, rank): up to k rows per usable row, rank from 1.

        ``at_least`` keeps only neighbours of at least that similarity, computed from the full-precision
        vectors; ranks are the same as without it. Without it similarities are those of the search, which are right to 0.001.
        """
        s = self.s
        # very many rows may be copies of one vector: their joins are split
        members = stage(spread_join(self._units.select("id", "h", "g"), self._rows.select("h", F.col("g").alias("g2"), "n"), "h").where("g = g2").select("id", "n"), "members")
        by_n = Window.partitionBy("n").orderBy("id")
        # k + 1 copies are enough for anyone's k neighbours: the rest tie with them at a higher key
        few = members.withColumn("c", F.row_number().over(by_n)).where(F.col("c") <= s.k + 1).drop("c")
        few = stage(few, "few-copies")
        copied = few.groupBy("n").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("n")
        twins = spread_join(members, few.join(copied, "n", "left_semi").select("n", F.col("id").alias("neighbour")), "n").where("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("similarity"))
        if self._lists is None:
            found = twins
        else:
            near = self._lists.select("n", F.explode("near").alias("x")).select("n", F.col("x.m").alias("m"), (-F.col("x.d")).cast("double").alias("similarity"))
            near = near.groupBy("n", "m").agg(F.max("similarity").alias("similarity")) if at_least is None else self._exact(near, at_least)
            scored = near.join(few.select(F.col("n").alias("m"), F.col("id").alias("neighbour")), "m").select("n", "neighbour", "similarity")
            across = spread_join(members, scored, "n").select("id", "neighbour", "similarity")
            found = twins.unionByName(across)
        if at_least is not None:
            found = found.where(F.col("similarity") >= at_least)
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
        return found.withColumn("rank", rank).where(F.col("rank") <= s.k)
