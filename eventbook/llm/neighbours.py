"""Operator 2: nearest neighbours by inner product through a hierarchical k-means tree.

The tree is trained on a bounded sample of rows; every row is put into a leaf.  A query visits leaves best
bin first: a priority queue holds the branches met so far by the inner product of query and centre, and
the best one is opened next.  How many leaves are visited is calibrated: for a sample of queries the true
neighbours among all rows are found by brute force, and visits widen until the wanted share of them lies
in visited leaves; a query goes on until its leaves hold as many rows as it asks for.  Leaves of one branch are searched together; branches with many rows are dealt to
several tasks by a hash of the id, queries in blocks, and the best of each task are merged.  Branches are searched in
turns, each of three times as many as all before, nearest first: the k-th score of one turn has to be reached in the
next, so that a turn returns about three times the k rows of a query, however many branches there are.

Cases: vectors that are null, zero, of another length than most or hold null or non-finite components take
no part, nor do rows without an id; rows that share an id are one row, the one that sorts first; equal
scores go by the smaller id, and equal vectors have equal scores; with fewer candidates than asked for
all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventbook.llm.common import portion
from eventbook.session import cut_lineage

#: Bounds of the training sample and of the calibration queries (expected numbers of rows).
SAMPLE_ROWS, CALIBRATION_QUERIES = 20_000, 200
#: Rows that a leaf is meant to hold, branches of an inner node, sample rows behind a leaf at least.
LEAF_ROWS, BRANCHES, SAMPLE_PER_LEAF = 512, 16, 16
#: Rows and queries that one task step holds.
TASK_ROWS, TASK_QUERIES = 4096, 8192
#: Products that a step holds at once.
PRODUCTS = 1 << 20
RECALL, NEAREST = 0.97, 20


@dataclass
class Tree:
    """Nodes by number, 0 the root: centres, children, and the leaf's number (-1: inner node)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    #: Leaves of one parent are one branch.
    branch: list[int]

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row belongs to: the nearest centre on every level."""
        out = np.zeros(len(rows), np.int64)
        stack = [(0, np.arange(len(rows)))]
        while stack:
            node, of = stack.pop()
            if self.leaf[node] >= 0:
                out[of] = self.leaf[node]
            elif len(of):
                nearest = nearest_centre(rows[of], self.centres[self.children[node]])
                stack += [(child, of[nearest == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, query: np.ndarray, most: int, sizes: list[int] | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and further ones until they hold ``rows`` by ``sizes``."""
        worth = -(self.centres @ query)
        queue, found, held = [(worth[0], 0)], [], 0
        while queue and (len(found) < most or held < rows):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                held += sizes[self.leaf[node]] if sizes else 0
            for child in self.children[node]:
                heapq.heappush(queue, (worth[child], child))
        return found


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def k_means(rows: np.ndarray, k: int, random: np.random.Generator, turns: int = 12) -> np.ndarray:
    centres = rows[random.choice(len(rows), k, replace=False)]
    for _ in range(turns):
        nearest = nearest_centre(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def train(sample: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    """A tree of about ``leaves`` leaves; nodes with few sample rows or without variety stay leaves."""
    random = np.random.default_rng(seed)
    per_leaf = max(1.0, len(sample) / leaves)
    centres, children, leaf, parent = [sample.mean(axis=0)], [[]], [-1], [0]
    queue = [(0, sample)]
    while queue:
        node, rows = queue.pop(0)
        wanted = min(BRANCHES, math.ceil(len(rows) / per_leaf))
        distinct = len(np.unique(rows, axis=0)) if wanted > 1 else 1
        if min(wanted, distinct) > 1:
            found = k_means(rows, min(wanted, distinct), random)
            nearest = nearest_centre(rows, found)
            for j, centre in enumerate(found):
                if (nearest == j).any():
                    children[node].append(len(centres))
                    centres.append(centre)
                    children.append([])
                    leaf.append(-1)
                    parent.append(node)
                    queue.append((len(centres) - 1, rows[nearest == j]))
            if len(children[node]) > 1:
                continue
            children[node] = []
        leaf[node] = 0
    numbers = itertools.count()
    branches: dict[int, int] = {}
    branch = []
    reachable = {0}
    for node in range(len(centres)):
        if node in reachable:
            reachable.update(children[node])
            if not children[node]:
                leaf[node] = next(numbers)
                branch.append(branches.setdefault(parent[node], len(branches)))
    return Tree(np.array(centres), children, leaf, branch)


def usable(vector: Column) -> Column:
    """Arrays of finite numbers that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` nearest rows, the query's own left out; scores by one order of sums."""
    rough = rows @ query
    rough[ids == own] = -np.inf
    take = np.arange(len(ids))
    if len(ids) > k:
        edge = np.partition(rough, len(ids) - k)[len(ids) - k]
        size = np.abs(rows).max() * np.abs(query).max() * rows.shape[1]
        take = np.flatnonzero(rough >= edge - 1e-12 * size)
    take = take[ids[take] != own]
    scores = (rows[take] * query).sum(axis=1)
    order = np.lexsort((ids[take], -scores))[:k]
    return ids[take][order], scores[order]


def best_in_leaves(
    rows: np.ndarray, ids: np.ndarray, leaf: np.ndarray, queries: np.ndarray, own: np.ndarray, leaves: list[np.ndarray], least: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and score of each query's ``k`` nearest rows in its ``leaves`` that reach ``least``, as
    ``best_of`` finds them.  Rows of a leaf lie side by side and meet all queries that visit it in one product."""
    order = np.argsort(leaf, kind="stable")
    rows, ids = rows[order], ids[order]
    numbers, counts = np.unique(leaf, return_counts=True)
    ends = np.cumsum(counts)
    visited = np.zeros((len(queries), len(numbers)), bool)
    asked, of = np.concatenate(leaves), np.repeat(np.arange(len(queries)), [len(x) for x in leaves])
    at = np.minimum(np.searchsorted(numbers, asked), len(numbers) - 1)
    there = numbers[at] == asked
    visited[of[there], at[there]] = True
    slack = 1e-12 * np.abs(rows).max() * np.abs(queries).max(axis=1) * rows.shape[1]
    step, out = max(1, PRODUCTS // len(rows)), []
    for first in range(0, len(queries), step):
        part = slice(first, first + step)
        asking, floor = queries[part], least[part]
        rough = np.full((len(asking), len(rows)), -np.inf)
        for j, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            here = np.flatnonzero(visited[part, j])
            rough[here, end - count : end] = asking[here] @ rows[end - count : end].T
        met = np.repeat(visited[part], counts, axis=1) & (ids != own[part, None])
        rough[~met] = -np.inf
        edge = (floor - slack[part])[:, None]
        many = np.flatnonzero((met & (rough >= edge)).sum(axis=1) > k)
        if len(many):
            kth = np.partition(rough[many], len(rows) - k, axis=1)[:, len(rows) - k]
            edge[many, 0] = np.maximum(edge[many, 0], kth - slack[part][many])
        query, row = np.nonzero(met & (rough >= edge))
        for a in range(0, len(query), PRODUCTS // 16):
            q, r = query[a : a + PRODUCTS // 16], row[a : a + PRODUCTS // 16]
            scores = (rows[r] * asking[q]).sum(axis=1)
            good = scores >= floor[q]
            out.append((first + q[good], ids[r[good]], scores[good]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((found, -scores, query))
    query, found, scores = query[order], found[order], scores[order]
    first_ = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[first_], found[first_], scores[first_]


def nearest_exact(vectors: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """Brute force over all rows for a bounded set of queries: ``query_id, vec_id, score, leaf``."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"))
            leaf = dict(zip(ids.tolist(), batch.column("leaf").to_pylist(), strict=True))
            out = []
            for query_id, query in shared.value:
                out += [(query_id, i, s, leaf[i]) for i, s in zip(*(x.tolist() for x in best_of(rows, ids, query, query_id, k)), strict=True)]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "vec_id", "score", "leaf"])

    found = vectors.select("vec_id", "vector", "leaf").mapInArrow(run, "query_id long, vec_id long, score double, leaf long")
    return ranked_first(found, k)


def ranked_first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(tree: Tree, truth: list[tuple[int, int]], queries: dict[int, np.ndarray], recall: float) -> int:
    """Fewest leaves to visit so that the share ``recall`` of the true neighbours' leaves is visited."""
    leaves = sum(x >= 0 for x in tree.leaf)
    place = {q: {leaf: i for i, leaf in enumerate(tree.visits(v, leaves))} for q, v in queries.items()}
    needed = sorted(place[q][leaf] + 1 for q, leaf in truth)
    return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else leaves


def search(table: DataFrame, is_query: Column, k: int = NEAREST, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's nearest rows found.  ``is_query`` speaks of ``vec_id``."""
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    valid = named.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    valid = cut_lineage(valid.withColumn("width", F.size("vector")))
    widths = valid.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths:
        return empty
    width, n = widths[0]["width"], widths[0]["n"]
    valid = valid.where(F.col("width") == width).select("vec_id", "vector")
    sample = valid.where(portion(F.col("vec_id")) < SAMPLE_ROWS / n).toArrow().sort_by("vec_id")
    if not len(sample):
        sample = valid.limit(SAMPLE_ROWS).toArrow().sort_by("vec_id")
    rows = matrix(sample.column("vector").combine_chunks())
    tree = train(rows, max(1, min(math.ceil(n / LEAF_ROWS), len(rows) // SAMPLE_PER_LEAF)))
    shared = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            leaf = tree.leaves_of(matrix(batch.column("vector")))
            branch = np.array(tree.branch, np.int64)[leaf]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(branch)], ["vec_id", "vector", "leaf", "branch"])

    vectors = cut_lineage(valid.mapInArrow(assign, "vec_id long, vector array<double>, leaf long, branch long"))
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    count = queries.count()
    if not count:
        return empty
    some = queries.where(portion(F.col("query_id") + F.lit(1)) < CALIBRATION_QUERIES / count).toArrow()
    by_id = dict(zip(some.column("query_id").to_pylist(), matrix(some.column("query").combine_chunks()) if len(some) else [], strict=True))
    truth = [(r["query_id"], r["leaf"]) for r in nearest_exact(vectors, list(by_id.items()), k).select("query_id", "leaf").collect()] if by_id else []
    most = calibrated(tree, truth, by_id, recall)

    # At most as many branches as the tree has inner nodes.
    sizes, held = [0] * len(tree.branch), Counter()
    for r in vectors.groupBy("leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
        held[tree.branch[r["leaf"]]] += r["n"]
    parts = {branch: math.ceil(n_ / TASK_ROWS) for branch, n_ in held.items()}
    blocks = math.ceil(count / TASK_QUERIES)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            out = []
            for query_id, query in zip(batch.column("query_id").to_pylist(), matrix(batch.column("query")), strict=True):
                # Branches by their first leaf: turn 0 has one, then come 3, 12, 48 and so on.
                leaves: dict[int, list[int]] = {}
                for leaf in tree.visits(query, most, sizes, k + 1):
                    leaves.setdefault(tree.branch[leaf], []).append(leaf)
                held_ = [b for b in leaves if parts.get(b, 0)]
                out += [(query_id, query, b, part, leaves[b], (i.bit_length() + 1) // 2) for i, b in enumerate(held_) for part in range(parts[b])]
            columns = zip(*out, strict=True) if out else ((),) * 6
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["query_id", "query", "branch", "part", "leaves", "turn"])

    met = queries.mapInArrow(visit, "query_id long, query array<double>, branch long, part long, leaves array<long>, turn int")
    met = met.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("long"))
    of_branch = F.element_at(F.create_map(*(F.lit(x) for b, n_ in parts.items() for x in (b, n_))), F.col("branch"))
    dealt = vectors.withColumn("part", F.pmod(F.xxhash64("vec_id"), of_branch).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ("branch", "part", "block")

    def within(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        query, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(left) and len(right):
            rows, asking = np.stack(left["vector"].to_numpy()), np.stack(right["query"].to_numpy())
            own, least, leaves = right["query_id"].to_numpy(), right["least"].to_numpy(), list(right["leaves"])
            at, found, scores = best_in_leaves(rows, left["vec_id"].to_numpy(), left["leaf"].to_numpy(), asking, own, leaves, least, k)
            query = own[at]
        return pd.DataFrame({"query_id": query, "vec_id": found, "score": scores})

    def found_in(asking: DataFrame) -> DataFrame:
        rows = dealt.select(*keys, "vec_id", "leaf", "vector").groupBy(*keys)
        return rows.cogroup(asking.drop("turn").groupBy(*keys)).applyInPandas(within, "query_id long, vec_id long, score double")

    # Equal scores are told apart by their ids, so that they are still returned.
    met, none = cut_lineage(met), F.lit(float("-inf"))
    turns = met.agg(F.max("turn")).first()[0]
    found = ranked_first(found_in(met.where("turn = 0").withColumn("least", none)), k)
    for turn in range(1, (turns or 0) + 1):
        found = cut_lineage(found)
        reached = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
        asking = met.where(F.col("turn") == turn).join(reached, "query_id", "left").withColumn("least", F.coalesce("reached", none)).drop("reached")
        found = ranked_first(found.drop("rank").unionByName(found_in(asking)), k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
