"""Nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on a bounded sample and has a bounded number of leaves; every row is indexed under its leaf.
A query walks the tree best bin first through a priority queue, which orders all leaves for it; it visits the first
ones, as many as a calibration against brute force (a fixed number of queries, all rows) needs for the wanted
recall, and goes on while they hold fewer other rows than it wants neighbours. A cell holds the rows of neighbouring small leaves, or by id a share of a large leaf's. A query is sent
to the cells of its leaves, in blocks: a task keeps the rows of one cell and lets the queries of a block stream by.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

SAMPLE_ROWS = 16_384
BRANCHES = 8
#: Leaves at most: they grow with the rows, one for about 128, as far as the sample tells them apart.
LEAVES = 4096
CALIBRATION_QUERIES = 128
RECALL = 0.97
NEIGHBOURS = 20
ROWS_PER_CELL = 8192
QUERIES_PER_BLOCK = 32_768


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: no null, non-finite or all-zero vectors, no null ids."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad & F.exists("v", lambda x: x != 0.0))


@dataclass
class Tree:
    """Nodes with the centroids of their children; a leaf has a number instead."""

    centroids: list[np.ndarray]
    children: list[list[int]]  # node numbers; negative: leaf -1 - n
    n_leaves: int

    @classmethod
    def fit(cls, x: np.ndarray, leaves: int, seed: int = 5) -> Tree:
        rnd = np.random.default_rng(seed)
        tree = cls([], [], 0)

        def grow(rows: np.ndarray, wanted: int) -> int:
            distinct = np.unique(x[rows], axis=0) if wanted > 1 else x[rows][:1]
            if wanted <= 1 or len(distinct) < 2:
                tree.n_leaves += 1
                return -tree.n_leaves
            k = min(BRANCHES, wanted, len(distinct))
            centre = distinct[rnd.choice(len(distinct), k, replace=False)]
            for _ in range(8):
                own = _nearest(x[rows], centre)
                centre = np.stack([x[rows][own == j].mean(0) if (own == j).any() else centre[j] for j in range(k)])
            own = _nearest(x[rows], centre)
            at = len(tree.centroids)
            tree.centroids.append(centre)
            tree.children.append([])
            share = [max(1, round(wanted * (own == j).mean())) for j in range(k)]
            tree.children[at] = [grow(rows[own == j], share[j] if (own == j).any() else 1) for j in range(k)]
            return at

        root = grow(np.arange(len(x)), leaves)
        if root < 0:
            tree.centroids, tree.children = [x[:1]], [[-1]]
        return tree

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: down to the nearest centroid."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            own = _nearest(x[rows], self.centroids[node])
            for j, child in enumerate(self.children[node]):
                part = rows[own == j]
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def visit(self, query: np.ndarray, least: int, rows_of: np.ndarray, rows: int) -> list[int]:
        """Leaves in the order of a best-bin-first walk: the open bin with the largest inner product is next.

        The walk ends when it has met ``least`` leaves and, by the counts of ``rows_of``, ``rows`` rows, or all leaves.
        """
        queue, out, met = [(0.0, 0)], [], 0
        while queue and (len(out) < least or met < rows):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                met += int(rows_of[-1 - node])
                continue
            for score, child in zip((self.centroids[node] @ query).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-score, child))
        return out


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1) if len(x) else np.empty(0, np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 1))


def top(query: np.ndarray, own_id: int, rows: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k best of the given rows but the query's own: (query, row, score); ``ids`` ascend, ties go to the smaller.

    ``rough`` are the rows' products up to rounding. The score of every row that could be among the best is summed
    again, the same way wherever it stands, so that equal vectors have equal scores.
    """
    at = np.flatnonzero(ids != own_id)
    if len(at) > k:
        least = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= least - 1e-9 * max(1.0, abs(least))]
    score = (rows[at] * query).sum(1)
    best = np.argsort(-score, kind="stable")[:k]
    return [(own_id, i, s) for i, s in zip(ids[at[best]].tolist(), score[best].tolist(), strict=True)]


@dataclass
class Layout:
    """Where the rows of every leaf are: in ``cells`` cells from ``first`` on, each met by ``blocks`` blocks of queries."""

    first: np.ndarray
    cells: np.ndarray
    blocks: np.ndarray

    @classmethod
    def plan(cls, rows_of: np.ndarray, asked: np.ndarray, queries: int) -> Layout:
        """From the rows and the queries of every leaf, and all queries: small leaves in turn share a cell, a large one has several."""
        first, cells, blocks = (np.ones(len(rows_of), np.int64) for _ in range(3))
        n_cells = low = 0
        while low < len(rows_of):
            high, held = low + 1, int(rows_of[low])
            while high < len(rows_of) and held + rows_of[high] <= ROWS_PER_CELL:
                held += int(rows_of[high])
                high += 1
            first[low:high] = n_cells
            cells[low:high] = max(1, -(-held // ROWS_PER_CELL))
            blocks[low:high] = max(1, -(-min(queries, int(asked[low:high].sum())) // QUERIES_PER_BLOCK))
            n_cells += int(cells[low])
            low = high
        return cls(first, cells, blocks)

    def groups(self, leaves: np.ndarray) -> list[np.ndarray]:
        """The given leaves by the cells that they share."""
        leaves = np.sort(leaves)
        return np.split(leaves, np.flatnonzero(np.diff(self.first[leaves])) + 1) if len(leaves) else []


def _answers(part: pd.DataFrame, x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The best of one cell's rows, whose ids ascend, for queries that name their leaves."""
    found: list[tuple[int, int, float]] = []
    for low in range(0, len(part), 64):
        few = part.iloc[low : low + 64]
        asked = _matrix(few["v"])
        wanted = np.zeros((len(few), int(leaf.max()) + 1), bool)
        for i, leaves in enumerate(few["leaves"]):
            wanted[i, leaves[leaves < wanted.shape[1]]] = True
        any_of = np.flatnonzero(wanted.any(0)[leaf])  # rows in a leaf that one of these queries visits
        own_x, own_ids, own_leaf = x[any_of], ids[any_of], leaf[any_of]
        rough = asked @ own_x.T
        for i, q in enumerate(few["vec_id"].tolist()):
            at = np.flatnonzero(wanted[i][own_leaf])
            found += top(asked[i], q, own_x[at], own_ids[at], rough[i][at], k)
    return found


def _stream_top(k: int):
    """Per cell and block the rows come first, by id, and are kept; then the queries come, a frame at a time."""

    def run(frames):
        key, kept, cell = None, [], None
        for frame in frames:
            found: list[tuple[int, int, float]] = []
            marks = frame[["cell", "block", "asks"]].to_numpy(np.int64)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1).tolist(), len(marks)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                part = frame.iloc[low:high]
                if key != tuple(marks[low, :2]):
                    key, kept, cell = tuple(marks[low, :2]), [], None
                if not marks[low, 2]:
                    kept.append((_matrix(part["v"]), part["vec_id"].to_numpy(), np.array([leaves[0] for leaves in part["leaves"]])))
                elif kept:
                    cell = cell or tuple(np.concatenate(c) for c in zip(*kept, strict=True))
                    found += _answers(part, *cell, k)
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


_FOUND = "query_id long, vec_id long, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of every query: a bounded list per query and cell meets, so no group grows."""
    from pyspark.sql import Window as W

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest: queries are rows whose vec_id divides by ``every``.

    Nearness is the largest inner product in double precision; ties go to the smaller vec_id; a query's own row (and
    repeated rows with its id) is no candidate. Null or zero vectors, and those with null or non-finite parts, take
    no part, nor do rows without an id, nor vectors of another length than the most frequent one (of two as frequent,
    the shorter). Of several vectors with one id the smallest, component by component, counts. Fewer candidates than k give them all. No usable row gives no result.
    The sample (SAMPLE_ROWS rows) and the calibration queries are chosen by a hash of the id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = store(rows.where(F.size("v") == (lengths["length"] if lengths else 0)), "vectors")
    n = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE_ROWS).select("v").collect()
    x = np.array([r.v for r in sample])
    tree = Tree.fit(x, int(np.clip(n // 128, 1, LEAVES)))
    shared = spark.sparkContext.broadcast(tree)  # LEAVES centroids and their parents

    def place(frames):
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": frame["v"], "leaf": shared.value.leaf_of(_matrix(frame["v"]))})

    indexed = store(rows.mapInPandas(place, "vec_id long, v array<double>, leaf long"), "index")
    queries = rows.where(F.col("vec_id") % every == 0)
    rows_of = np.zeros(tree.n_leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row a leaf; the tree has at most SAMPLE_ROWS leaves
        rows_of[r["leaf"]] = r["count"]

    def walks(asked: DataFrame, most: int) -> DataFrame:
        """Queries with the leaves that they visit."""

        def walk(frames):
            for frame in frames:
                leaves = [shared.value.visit(q, most, rows_of, k + 1) for q in frame["v"]]  # k and its own
                yield pd.DataFrame({"vec_id": frame["vec_id"], "v": frame["v"], "leaves": leaves})

        return asked.select("vec_id", "v").mapInPandas(walk, "vec_id long, v array<double>, leaves array<long>")

    def ask(walked: DataFrame, asked_of: np.ndarray, n_asked: int) -> DataFrame:
        """The best of every cell for the queries sent to it; ``asked_of``: how many of the ``n_asked`` visit each leaf."""
        layout = Layout.plan(rows_of, asked_of, n_asked)

        def send(frames):
            for frame in frames:
                out = []
                for q, v, leaves in zip(frame["vec_id"], frame["v"], frame["leaves"], strict=True):
                    out += [(q, v, own, layout.first[own[0]], layout.cells[own[0]], layout.blocks[own[0]]) for own in layout.groups(leaves)]
                    if len(out) >= 4096:
                        yield pd.DataFrame(out, columns=["vec_id", "v", "leaves", "first", "cells", "blocks"])
                        out = []
                yield pd.DataFrame(out, columns=["vec_id", "v", "leaves", "first", "cells", "blocks"])

        at_leaf = lambda numbers: F.element_at(F.lit(numbers.tolist()).cast("array<long>"), (F.col("leaf") + 1).cast("int"))
        hashed = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), n)
        every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        held = indexed.select(
            "vec_id", "v", F.array("leaf").alias("leaves"), (at_leaf(layout.first) + hashed(1, at_leaf(layout.cells))).alias("cell"),
            every_one(at_leaf(layout.blocks)).alias("block"), F.lit(0).alias("asks"),
        )
        sent = walked.mapInPandas(send, "vec_id long, v array<double>, leaves array<long>, first long, cells long, blocks long").select(
            "vec_id", "v", "leaves", "first", every_one(F.col("cells")).alias("n"), hashed(2, F.col("blocks")).alias("block")
        )
        sent = sent.select("vec_id", "v", "leaves", (F.col("first") + F.col("n")).alias("cell"), "block", F.lit(1).alias("asks"))
        dealt = held.unionByName(sent).repartition("cell", "block").sortWithinPartitions("cell", "block", "asks", "vec_id")
        return dealt.mapInPandas(_stream_top(k), _FOUND)

    trial = store(queries.orderBy(F.xxhash64("vec_id")).limit(CALIBRATION_QUERIES), "trial")
    all_leaves = np.full(tree.n_leaves, CALIBRATION_QUERIES)
    truth = _best(ask(walks(trial, tree.n_leaves), all_leaves, CALIBRATION_QUERIES), k).select("query_id", "vec_id").join(indexed.select("vec_id", "leaf"), "vec_id").groupBy("query_id").agg(F.collect_list("leaf").alias("leaves"))
    vector_of = {r.vec_id: np.array(r.v) for r in trial.collect()}
    place_of = []
    for r in truth.collect():  # at most CALIBRATION_QUERIES rows of k leaves
        order = {leaf: i for i, leaf in enumerate(tree.visit(vector_of[r.query_id], tree.n_leaves, rows_of, 0))}
        place_of += [order[leaf] for leaf in r.leaves]
    most = int(np.quantile(place_of, recall, method="higher")) + 1 if place_of else tree.n_leaves
    walked = store(walks(queries, most), "walks")
    asked_of = np.zeros(tree.n_leaves, np.int64)
    for r in walked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        asked_of[r["leaf"]] = r["count"]
    found = _best(ask(walked, asked_of, walked.count()), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
