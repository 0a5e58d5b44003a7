"""Approximate nearest neighbours by learned partitions: balanced cuts of neighbour graphs, and a tree of routers."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, drawn, settle, table

#: Each router is fitted on so many vectors, about, those of the smallest digests; all are indexed.
SAMPLE = 16384
#: Vectors of a partition, about; partitions that a router tells apart at most; vectors of a block of work.
PARTITION, FANOUT, BLOCK = 800, 64, 4096
#: Vectors that a router is fitted on at least; fewer are one partition.
FEWEST = 64
#: A query is routed to its most probable partitions until they hold so much of the router's probability.
MASS = 0.95


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each vector the k others of largest inner product."""
    n, out = len(x), []
    for i in range(0, n, 256):
        s = x[i : i + 256] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k].copy())
    return np.concatenate(out)


def bisect(x: np.ndarray, graph: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Cut the members into two halves with few edges between: smooth a score over the graph, cut at its median, swap."""
    place = np.full(len(x), -1)
    place[members] = np.arange(len(members))
    to = place[graph[members]]
    a, b = np.repeat(np.arange(len(members)), graph.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    src, dst = np.append(a, b), np.append(b, a)
    degree = np.maximum(np.bincount(src, minlength=len(members)), 1)
    centred = x[members] - x[members].mean(0)
    score = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
    for _ in range(30):
        score = 0.5 * score + 0.5 * np.bincount(src, score[dst], len(members)) / degree
        score -= score.mean()
        score /= np.abs(score).max() or 1
    side = np.zeros(len(members), bool)
    side[np.argsort(score, kind="stable")[len(members) // 2 :]] = True
    for _ in range(10):
        across = np.bincount(src, side[src] != side[dst], len(members))
        gain = 2 * across - np.bincount(src, minlength=len(members))
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right), max(1, len(members) // 50))
        better = int((gain[left[:m]] + gain[right[:m]] > 0).sum())
        if not better:
            break
        side[left[:better]], side[right[:better]] = True, False
    return side


class Router:
    """A network of one hidden layer that gives each partition's probability for a vector."""

    def __init__(self, x: np.ndarray, parts: int, seed: int = 7, hidden: int = 96, epochs: int = 25):
        x = np.asarray(x, np.float32)
        self.mean, self.scale = x.mean(0), np.float32(x.std() or 1)
        self.parts, rng = parts, np.random.default_rng(seed)
        k = min(12, len(x) - 1)
        graph = neighbour_graph(x, k)
        labels = np.zeros(len(x), int)
        groups = [np.arange(len(x))]
        while len(groups) < parts:
            groups = [g for members in groups for side in [bisect(x, graph, members)] for g in (members[~side], members[side])]
        for i, members in enumerate(groups):
            labels[members] = i
        goal = np.zeros((len(x), parts), np.float32)
        np.add.at(goal, (np.repeat(np.arange(len(x)), k), labels[graph].ravel()), 1.0)
        goal[np.arange(len(x)), labels] += 2
        goal /= goal.sum(1, keepdims=True)
        z = (x - self.mean) / self.scale
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, parts)), np.zeros(parts)]
        self.w = [w.astype(np.float32) for w in self.w]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 256):
                rows = order[i : i + 256]
                h = np.maximum(z[rows] @ self.w[0] + self.w[1], 0)
                p = self.softmax(h @ self.w[2] + self.w[3])
                e = (p - goal[rows]) / len(rows)
                back = (e @ self.w[2].T) * (h > 0)
                t += 1
                for j, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.w[j] = self.w[j] - (0.004 * (1 - epoch / epochs) * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    @staticmethod
    def softmax(s: np.ndarray) -> np.ndarray:
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    def shares(self, x: np.ndarray, mass: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, partition, probability): of each vector the most probable partition, or as many as hold `mass` of its probability."""
        z = (np.asarray(x, np.float32) - self.mean) / self.scale
        p = self.softmax(np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])
        order = np.argsort(-p, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
        rows, places = np.nonzero(np.column_stack([np.ones(len(x), bool), held[:, :-1] < (mass or 0)]))
        return rows, order[rows, places], p[rows, order[rows, places]]


def parts_of(n: int, least: int = 1) -> int:
    """Partitions of n vectors that one router tells apart: a power of two."""
    return 1 << max(least.bit_length() - 1, min(FANOUT.bit_length() - 1, round(math.log2(max(n, 1) / PARTITION))))


class Tree:
    """A router to partitions, and one below each of those that are large. A leaf's number is the first one's times FANOUT, and the second one's."""

    def __init__(self, top: Router):
        self.top, self.below, self.fanout = top, {}, FANOUT

    @property
    def leaves(self) -> int:
        return sum(self.below[i].parts if i in self.below else 1 for i in range(self.top.parts))

    def route(self, x: np.ndarray, mass: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs: of each vector the most probable leaf, or as many as hold `mass` of its probability."""
        rows, parts, p = self.top.shares(x, mass)
        out = [], [], []
        for i in np.unique(parts):
            at = np.flatnonzero(parts == i)
            inner, leaf, q = self.below[i].shares(x[rows[at]], mass) if i in self.below else (np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at)))
            for column, v in zip(out, (rows[at[inner]], i * self.fanout + leaf, p[at[inner]] * q), strict=True):
                column.append(v)
        if not out[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, leaves, p = map(np.concatenate, out)
        order = np.lexsort((leaves, -p, rows))
        rows, leaves, p = rows[order], leaves[order], p[order]
        first = np.searchsorted(rows, rows)
        before = np.cumsum(p) - p
        keep = before - before[first] < mass if mass is not None else np.arange(len(rows)) == first
        return rows[keep], leaves[keep]


def usable(vector: Column) -> Column:
    """Not null, not empty, not zero, no null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def best(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, score) of each query's k best rows but its own, ties to the smaller id.

    A product of matrices finds what may be among the best; those are scored again, each by the
    same sum in the order of the components, so that equal vectors get equal scores.
    """
    qid, q = queries
    order = np.argsort(rows[0], kind="stable")
    rid, r = rows[0][order], rows[1][order]
    found: list = [[], [], []]
    for i in range(0, len(qid), 256):
        a, ids = q[i : i + 256], qid[i : i + 256]
        s = a @ r.T
        s[ids[:, None] == rid[None, :]] = -np.inf
        if len(rid) > k:
            least = np.partition(s, len(rid) - k, axis=1)[:, len(rid) - k]
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            x, y = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
        else:
            x, y = np.nonzero(np.isfinite(s))
        exact = np.zeros(len(x))
        for j in range(a.shape[1]):
            exact += a[x, j] * r[y, j]
        order = np.lexsort((rid[y], -exact, x))
        x, y, exact = x[order], y[order], exact[order]
        first = np.searchsorted(x, np.arange(len(ids)))
        keep = np.arange(len(x)) - first[x] < k
        for out, v in zip(found, (ids[x[keep]], rid[y[keep]], exact[keep]), strict=True):
            out.append(v)
    return tuple(np.concatenate(v) if v else np.zeros(0, t) for v, t in zip(found, (np.int64, np.int64, float), strict=True))


def fit(rows: DataFrame, n: int, sample: int) -> Tree:
    """A tree of routers for n vectors (vec_id, v), with leaves in proportion to n: a second level where one router's partitions are too few.

    A router below is fitted in a task on a sample of its partition; at most FANOUT of them reach the driver.
    """
    found = drawn(rows, "vec_id", n, sample).select("v").toArrow()
    tree = Tree(Router(matrix(found.column(0).combine_chunks()), parts_of(n, 2)))
    if n < 2 * PARTITION * FANOUT:
        return tree
    top = rows.sparkSession.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            if b.num_rows:
                _, part = top.value.route(matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part // top.value.fanout, pa.int32())], names=["vec_id", "v", "part"])

    placed = rows.mapInArrow(place, "vec_id long, v array<double>, part int")
    sizes = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    large = {part: m for part, m in sizes.items() if m >= 2 * PARTITION}
    if not large:
        return tree
    bars = [F.lit(x) for part, m in large.items() for x in (part, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * sample // m))]

    def fit_one(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        router = Router(matrix(group.slice(0, sample + sample // 4).column("v").combine_chunks()), parts_of(large[part], 2))
        return pa.table({"part": pa.array([part], pa.int32()), "router": pa.array([pickle.dumps(router)], pa.binary())})

    chosen = placed.where(F.xxhash64("vec_id") <= F.create_map(*bars)[F.col("part")])
    for r in chosen.groupBy("part").applyInArrow(fit_one, "part int, router binary").collect():
        tree.below[r["part"]] = pickle.loads(r["router"])
    top.unpersist()
    return tree


#: Numbers of leaves of vectors of other dimensions than most: the dimension is added.
OTHER = 1 << 30


def search(vectors: DataFrame, is_query: Column, k: int = 20, mass: float = MASS, sample: int = SAMPLE) -> DataFrame:
    """Each query's k nearest of all other vectors by inner product, as far as the routed partitions hold them.

    mass is what a query's partitions hold of the router's probability, and about the recall to expect.

    vectors: vec_id, embedding; other columns are ignored. is_query: a condition on vec_id. Vectors
    that are null, empty, zero or hold a null or non-finite component take no part. Rows that repeat a query's vec_id are
    not its neighbours. A query meets vectors of its own dimension alone; the commonest dimension is partitioned, each other one is
    one partition. Returns query_id, rank, vec_id, score. An empty table gives an empty result.

    A graph cut and its router are fitted on about `sample` vectors (a quarter more at most); every vector is indexed, under its most
    probable partition. There are as many partitions as it takes for about PARTITION vectors each, two at least. Work is
    dealt in blocks of BLOCK vectors by BLOCK queries of a partition, so a partition with a third of all rows is split on both
    sides; only counts by partition reach the driver.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null").where(usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    n, d = (sizes[0]["count"], sizes[0]["d"]) if sizes else (0, 0)
    # a router needs some vectors to learn from
    model = spark.sparkContext.broadcast(fit(rows.where(F.size("v") == d), n, sample) if n >= FEWEST else None)

    def placed(mass: float | None):
        def run(batches):
            for b in batches:
                size = np.diff(b.column(1).offsets.to_numpy())
                usual = np.flatnonzero(size == d)
                if model.value is None or not len(usual):
                    index, to = np.arange(b.num_rows), OTHER + size
                else:
                    index, to = model.value.route(matrix(b.column(1).take(pa.array(usual))), mass)
                    other = np.flatnonzero(size != d)
                    index, to = np.append(usual[index], other), np.append(to, OTHER + size[other])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(index)), b.column(1).take(pa.array(index)), pa.array(to, pa.int32())], names=["vec_id", "v", "part"])

        return run

    schema = "vec_id long, v array<double>, part int"
    held = checkpointed(rows.mapInArrow(placed(None), schema))
    asked = checkpointed(rows.where(is_query).mapInArrow(placed(mass), schema))
    # a row a partition, of which there are some thousands at most
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    both = F.broadcast(blocks(held, "of_rows").join(blocks(asked, "of_queries"), "part"))
    spread = lambda df, own, other, mine, others: (
        df.join(both, "part").withColumn(mine, F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")).withColumn(others, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("vec_id", "v", "part", "rb", "qb")
    )
    left = spread(held, "of_rows", "of_queries", "rb", "qb")
    right = spread(asked, "of_queries", "of_rows", "qb", "rb")

    def work(r: pa.Table, q: pa.Table) -> pa.Table:
        both = [(t.column("vec_id").to_numpy(), matrix(t.column("v").combine_chunks())) for t in (q, r)]
        query, row, score = best(*both, k) if q.num_rows and r.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        at = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
        items = pa.StructArray.from_arrays([pa.array(-score), pa.array(row, pa.int64())], names=["far", "vec_id"])
        near = pa.ListArray.from_arrays(pa.array(np.append(at, len(query)), pa.int32()), items)
        settle()
        return pa.table({"query_id": pa.array(query[at], pa.int64()), "near": near})

    found = left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInArrow(work, "query_id long, near array<struct<far: double, vec_id: long>>")

    def merge(batches):
        held: list[tuple[np.ndarray, ...]] = []

        def nearest(query, far, row):
            order = np.lexsort((row, far, query))
            query, far, row = query[order], far[order], row[order]
            fresh = np.append(True, (query[1:] != query[:-1]) | (row[1:] != row[:-1]) | (far[1:] != far[:-1]))[: len(query)]
            query, far, row = query[fresh], far[fresh], row[fresh]
            rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
            use = rank <= k
            return pa.RecordBatch.from_arrays([pa.array(query[use]), pa.array(rank[use], pa.int32()), pa.array(row[use]), pa.array(-far[use])], names=["query_id", "rank", "vec_id", "score"])

        for b in batches:
            near = b.column(1)
            items = near.flatten()
            query = np.repeat(b.column(0).to_numpy(), np.diff(near.offsets.to_numpy()))
            if not len(query):
                continue
            held.append((query, items.field(0).to_numpy(), items.field(1).to_numpy()))
            if query[-1] != held[0][0][0]:
                # what is found for the last query may go on in the next batch
                query, far, row = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(query, query[-1]))
                yield nearest(query[:cut], far[:cut], row[:cut])
                held = [(query[cut:], far[cut:], row[cut:])]
        if held:
            yield nearest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
