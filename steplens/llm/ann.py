"""Approximate nearest neighbours by inner product: a forest of random-projection trees searched through one priority
queue, and exact reranking of what the leaves hold."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steplens.llm.common import ship
from steplens.sources.scratch import materialise

#: Vectors that the trees are learned from at most, those of them that tell how near the answers of a query may be, and those
#: that are searched for in the sample to set the chance of a miss. They go to the driver, directions and splits to every task.
SAMPLE, NEARNESS, TRIALS = 32_768, 1_024, 384
#: Trees, rows of the table in a leaf, and vectors of the sample in a leaf at least.
TREES, LEAF, LEARNED = 128, 48, 32
#: The share of their nearest vectors that the trials must find, and the chances at which a query may stop that a row as near
#: as its last answer stands in no leaf it has visited: the first one that is enough is taken.
RECALL = 0.94
MISSES = tuple(0.3 * 0.92**i for i in range(70))
#: Rows that one task holds at most, queries that it answers at most, and tasks for tables of fewer rows.
PART, BLOCK, LEAST_PARTS = 1 << 17, 1 << 20, 16
#: A logistic curve of this slope follows the normal distribution function.
_SLOPE = 1.702


@dataclass(frozen=True)
class Forest:
    """Trees in which all nodes of one level share a direction: node i of a tree has the children 2 i and 2 i + 1, root 1,
    and sends up to the second what lies above its split. Leaves are numbered through all trees."""

    centre: np.ndarray
    directions: np.ndarray  # (width, trees * depth)
    splits: np.ndarray  # (trees, 2 ** depth)
    spread: np.ndarray  # (trees, depth)
    depth: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) @ self.directions).reshape(len(x), len(self.splits), self.depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree. Projections are made for some rows at a time."""
        if len(x) > 2048:
            return np.concatenate([self.leaves(x[at : at + 2048]) for at in range(0, len(x), 2048)])
        p, trees = self.project(x), np.arange(len(self.splits))
        node = np.ones((len(x), len(trees)), np.int64)
        for level in range(self.depth):
            node = 2 * node + (p[:, :, level] > self.splits[trees, node])
        return (node + (trees - 1) * (1 << self.depth)).astype(np.int32)

    @property
    def size(self) -> int:
        return len(self.splits) << self.depth


def grow(x: np.ndarray, trees: int, depth: int, rng: np.random.Generator) -> Forest:
    """Directions are differences of two random vectors, splits the medians of what reaches a node."""
    centre = x.mean(axis=0)
    directions = np.zeros((trees, depth, x.shape[1]))
    for _ in range(4):
        poor = np.flatnonzero(np.linalg.norm(directions, axis=2).ravel() == 0)
        a, b = rng.integers(0, len(x), (2, len(poor)))
        directions.reshape(-1, x.shape[1])[poor] = x[a] - x[b]
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-300)
    splits, spread = np.zeros((trees, 1 << depth)), np.zeros((trees, depth))
    some = x[: len(x) >> depth << depth] - centre
    for t in range(trees):
        p = some @ directions[t].T
        spread[t] = p.std(axis=0)
        order = np.arange(len(some))
        for level in range(depth):
            order = order.reshape(1 << level, -1)
            own = np.argsort(p[order, level], axis=1)
            order = np.take_along_axis(order, own, axis=1)
            half = order.shape[1] // 2
            splits[t, 1 << level : 2 << level] = p[order[:, half - 1 : half + 1], level].mean(axis=1)
    return Forest(centre, directions.reshape(trees * depth, x.shape[1]).T.copy(), splits, spread, depth)


class Search:
    """Visits of a forest. One queue holds the open branches of all trees, by what it costs to cross their splits: the log
    odds that a row of cosine ``near`` with the query lies on the query's side of each."""

    def __init__(self, forest: Forest, miss: float):
        self.forest, self.goal = forest, log(max(miss, 1e-300))
        self.splits = forest.splits.tolist()

    def visit(self, projected: np.ndarray, near: float) -> tuple[list[int], list[float]]:
        """Leaves in the order of the queue, until a row that is this near stands in none of them with a chance of
        ``miss``, by the shares of such rows that the visited leaves of each tree have; and after each leaf the logarithm of
        that chance."""
        depth = self.forest.depth
        inverse = _SLOPE / (max(1e-3, 1 - near * near) ** 0.5 * np.maximum(self.forest.spread, 1e-12))
        at, by = (near * projected * inverse).tolist(), inverse.tolist()
        queue = [(0.0, 0.0, t, 0, 1) for t in range(len(self.splits))]
        seen, missing, found, chance = [0.0] * len(queue), 0.0, [], []
        while queue and missing > self.goal:
            cost, rare, t, level, node = heapq.heappop(queue)
            splits, a, b = self.splits[t], at[t], by[t]
            while level < depth:
                z = a[level] - splits[node] * b[level]
                level, node, up = level + 1, 2 * node, z > 0
                z = z if up else -z
                rare += log1p(exp(-z)) if z < 40 else 0.0
                heapq.heappush(queue, (cost + z, rare + z, t, level, node if up else node + 1))
                node += up
            found.append(node + (t - 1 << depth))
            missing -= log1p(-seen[t])
            seen[t] = min(1 - 1e-9, seen[t] + exp(-rare))
            missing += log1p(-seen[t])
            chance.append(missing)
        return found, chance


@dataclass(frozen=True)
class Index:
    """What every task knows: the trees, and the vectors by which the nearness of a query's answers is judged."""

    forest: Forest
    longest: float
    yard: np.ndarray
    yard_ids: np.ndarray
    order: int
    miss: float = 0.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.longest - np.einsum("ij,ij->i", x, x)))])

    def visits(self, search: Search, own: np.ndarray, q: np.ndarray) -> list[tuple[list[int], list[float]]]:
        """The leaves that each query visits, with the chances of a miss."""
        s = q @ self.yard.T
        s[own[:, None] == self.yard_ids[None, :]] = -np.inf
        order = min(self.order, len(self.yard))
        last = np.argpartition(s, len(self.yard) - order, axis=1)[:, -order]
        place = np.column_stack([q * np.sqrt(self.longest / np.einsum("ij,ij->i", q, q))[:, None], np.zeros(len(q))])
        aim, hit = place - self.forest.centre, self.lift(self.yard[last]) - self.forest.centre
        near = np.einsum("ij,ij->i", aim, hit) / np.maximum(np.linalg.norm(aim, axis=1) * np.linalg.norm(hit, axis=1), 1e-300)
        return [search.visit(p, min(0.995, max(0.05, c))) for p, c in zip(self.forest.project(place), near.tolist(), strict=True)]


def index_of(known: np.ndarray, ids: np.ndarray, n: int, longest: float, k: int, trees: int = TREES, recall: float = RECALL) -> Index:
    """An index of a table of ``n`` rows, learned from some of them in random order. Its chance of a miss is the largest one
    at which ``recall`` of the nearest sample vectors of the trials are found in the sample."""
    deepest = int(np.log2(len(known) / LEARNED)) if len(known) > LEARNED else 0
    depth = min(deepest, max(0, round(np.log2(n / LEAF))))
    yard = known[:NEARNESS]
    order = lambda rows: max(1, round(k * len(yard) / rows))
    bare = Index(Forest(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 1)), np.zeros((0, 0)), 0), longest, yard, ids[:NEARNESS], order(len(known)))
    index = replace(bare, forest=grow(bare.lift(known), trees, depth, np.random.default_rng(11)))
    tried, own = known[-TRIALS:], ids[-TRIALS:]
    k = min(k, len(known) - 1)
    if not k:
        return replace(index, order=order(n), miss=MISSES[-1])
    best = []
    for own_id, q in zip(own, tried, strict=True):
        s = known @ q
        s[ids == own_id] = -np.inf
        best.append(np.argpartition(s, -k)[-k:])
    found = np.zeros(len(MISSES))
    leaves = index.forest.leaves(index.lift(known))
    for (visited, chance), rows in zip(index.visits(Search(index.forest, MISSES[-1]), own, tried), best, strict=True):
        place = np.full(index.forest.size, len(visited))
        place[visited] = np.arange(len(visited))
        first = place[leaves[rows]].min(axis=1)  # the visit that meets each of the nearest
        stop = [int(np.argmax(np.array(chance) <= log(m))) if chance[-1] <= log(m) else len(visited) - 1 for m in MISSES]
        found += [(first <= at).mean() for at in stop]
    enough = np.flatnonzero(found >= recall * len(tried)) if recall < 1 else []
    return replace(index, order=order(n), miss=MISSES[enough[0]] if len(enough) else 0.0)


class Part:
    """The rows of one part with the lists of what each leaf holds."""

    def __init__(self, index: Index, number: np.ndarray, x: np.ndarray):
        forest = index.forest
        order = np.argsort(number, kind="stable")
        self.number, self.x = number[order], x[order]
        leaf = np.concatenate([np.empty((0, len(forest.splits)), np.int32), *[forest.leaves(index.lift(self.x[at : at + 2048].astype(np.float64))) for at in range(0, len(x), 2048)]])
        self.rows = np.concatenate([np.argsort(own, kind="stable").astype(np.int32) for own in leaf.T])
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(leaf.ravel(), minlength=forest.size))])
        self.hit = np.zeros(len(x), bool)

    def candidates(self, leaves: np.ndarray) -> np.ndarray:
        """Rows that any of the leaves holds, each once, in the order of their numbers."""
        begin = self.begin[leaves]
        size = self.begin[leaves + 1] - begin
        ahead = np.cumsum(size)
        total = int(ahead[-1]) if len(ahead) else 0
        self.hit[self.rows[np.repeat(begin - ahead + size, size) + np.arange(total)]] = True
        rows = np.flatnonzero(self.hit)
        self.hit[rows] = False
        return rows

    def best(self, own: int, q: np.ndarray, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(leaves)
        rows = rows[self.number[rows] != own]
        # Each score sums in the same order wherever its vectors stand, so equal vectors tie exactly.
        s = np.einsum("nd,d->n", self.x[rows].astype(np.float64), q, optimize=False)
        if len(s) > k:
            keep = np.flatnonzero(s >= np.partition(s, -k)[-k])
            keep = keep[np.argsort(-s[keep], kind="stable")[:k]]
            rows, s = rows[keep], s[keep]
        return self.number[rows], s


def _matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, trees: int = TREES, recall: float = RECALL, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``vectors`` (vec_id, embedding) with the
    largest inner product among those that its leaves hold, the row of its own vec_id left out; ties to smaller vec_id.

    Vectors null, zero, with null or non-finite components, of another width than most of the sample, or of null vec_id
    take no part; of a repeated vec_id the least vector counts, once. Lengths may differ: a further coordinate makes all vectors equally long, so
    that nearness and inner product agree in the trees; scores come from the given vectors in double precision.

    The trees are as deep as leaves of ``LEAF`` rows ask for and the sample allows. A query visits leaves until it is
    unlikely to miss a row as near as its last answer is expected to be, judged by a small sample, in which trials have set
    how unlikely that must be for a share of ``recall``; where nothing is enough, or all is asked for, it visits every leaf. So the share of the
    table that it scores falls as its neighbours come nearer, in larger tables and in tables with structure. Rows are dealt by a
    hash into parts of at most about ``part``; a task holds one part and streams the queries past it, with the leaves they
    visit, and scores each row that these hold once. Queries are copied to every part, rows once for each block of queries.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    out = "query_id long, rank int, vec_id long, score double"
    given = vectors.schema["embedding"].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind, held_as = ("float", np.float32) if single else ("double", np.float64)
    real = lambda e: F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)

    def usable_of(df: DataFrame) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e")).where("vec_id is not null and e is not null").where(real(F.col("e")))
        return own.groupBy("vec_id", F.size("e").alias("w")).agg(F.min("e").alias("e"))

    usable, asked = materialise(usable_of(vectors), "vectors"), usable_of(queries)
    n = usable.count()
    # About twice the sample passes the first test, all rows of a small table do.
    share = min(1.0, 2 * sample / max(1, n))
    chance = F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / float(1 << 53)
    chosen = usable.where(chance < share).orderBy(F.xxhash64("vec_id"), "vec_id", "w").limit(sample).toArrow().combine_chunks()
    if not chosen.num_rows:
        return spark.createDataFrame([], out)
    widths = chosen["w"].to_pylist()
    width = max(sorted(set(widths)), key=widths.count)
    chosen = chosen.filter(pa.compute.equal(chosen["w"], width)).combine_chunks()
    usable, asked = (d.where(F.col("w") == width).select("vec_id", "e") for d in (usable, asked))
    known = _matrix(chosen["e"].combine_chunks(), width)
    length = F.aggregate("e", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, longest = usable.agg(F.count("*"), F.max(length)).first()
    n_queries = asked.count()

    index = index_of(known, chosen["vec_id"].to_numpy(), n, longest, k, trees, recall)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(index.forest, index.miss)
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("e"), width)
            for at in range(0, len(x), 256):
                found = [leaves for leaves, _ in index.visits(search, own[at : at + 256], x[at : at + 256])]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *[np.array(f, np.int32) for f in found]])))
                some = batch.slice(at, len(found))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("e"), leaves], ["vec_id", "e", "leaves"])

    parts = max(-(-n // part), min(LEAST_PARTS, -(-n // 1024)))
    blocks = max(1, -(-n_queries // BLOCK))
    cell = lambda p, b: (p.cast("int") * blocks + b.cast("int")).alias("cell")
    deal = lambda many: F.pmod(F.xxhash64("vec_id"), F.lit(many))
    every = lambda many, name: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(name)
    rows = usable.select("vec_id", "e", deal(parts).alias("p"), every(blocks, "b")).select(cell(F.col("p"), F.col("b")), F.lit(0).alias("side"), "vec_id", "e", F.lit(None).cast("array<int>").alias("leaves"))
    asking = materialise(asked.repartition(parts * blocks).mapInArrow(ask, f"vec_id long, e array<{kind}>, leaves array<int>"), "visits")
    asking = asking.select("vec_id", "e", "leaves", deal(blocks).alias("b"), every(parts, "p")).select(cell(F.col("p"), F.col("b")), F.lit(1).alias("side"), "vec_id", "e", "leaves")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, numbers, held, part = None, [], [], None
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            edges = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(cells)], strict=True):
                some = batch.slice(a, b - a)
                if cells[a] != at:
                    at, numbers, held, part = cells[a], [], [], None
                if not sides[a]:
                    numbers.append(some.column("vec_id").to_numpy())
                    held.append(_matrix(some.column("e"), width, held_as))
                    continue
                if part is None:
                    part = Part(index, np.concatenate([np.empty(0, np.int64), *numbers]), np.concatenate([np.empty((0, width), held_as), *held]))
                    numbers, held = [], []
                lists = some.column("leaves")
                ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
                own = some.column("vec_id").to_numpy()
                found = [part.best(i, q, flat[e:f], k) for i, q, e, f in zip(own.tolist(), _matrix(some.column("e"), width), ends, ends[1:], strict=False)]
                query = np.repeat(own, [len(v) for v, _ in found])
                v, s = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    both = rows.unionByName(asking).repartitionById(parts * blocks, "cell").sortWithinPartitions("cell", "side")
    answers = both.mapInArrow(score, "query_id long, vec_id long, score double")
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
