"""Sharding by best-fit-decreasing bin packing: indivisible groups of equal texts, in as few fixed-capacity shards as it takes.

1. Rows are reduced to id, size, checksum and digest of the text; groups to their digest, rows and bytes (map-side).
2. Every task packs its groups into bundles by best-fit decreasing: a bundle is a small fraction of a shard, and a larger
   group is one by itself. So the number of bundles follows the shards, not the rows.
3. The bundles' sizes are packed into shards on the driver, again best-fit decreasing. For a given number of shards
   the capacity is the least one, by bisection, that needs no more of them; a group above the fair share of what is left
   gets a shard of its own.
4. Rows take the shard of their digest; digests of very many rows are broadcast, so no copy group meets in one task.
   Slots are counted task by task and shifted by the counts of the tasks before.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_weighted, store

SHARDS = 40
#: Bytes that every row costs besides its text.
ROW_BYTES = 16
#: Bundles in a shard, and in all: the driver packs at most twice as many, and one for every task.
BUNDLES_PER_SHARD = 64
BUNDLES = 1 << 18


class _Node:
    __slots__ = ("key", "rank", "left", "right")

    def __init__(self, key: tuple[int, int], rank: float):
        self.key, self.rank, self.left, self.right = key, rank, None, None


def _split(node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
    """Nodes below ``key``, and the others."""
    if node is None:
        return None, None
    if node.key < key:
        node.right, rest = _split(node.right, key)
        return node, rest
    rest, node.left = _split(node.left, key)
    return rest, node


def _merge(low: _Node | None, high: _Node | None) -> _Node | None:
    if low is None or high is None:
        return low or high
    if low.rank > high.rank:
        low.right = _merge(low.right, high)
        return low
    high.left = _merge(low, high.left)
    return high


def _pop_least(node: _Node) -> tuple[tuple[int, int], _Node | None]:
    if node.left is None:
        return node.key, node.right
    key, node.left = _pop_least(node.left)
    return key, node


class Bins:
    """Open bins in a balanced search tree (a treap), by remaining capacity and number."""

    def __init__(self, capacity: int):
        self.capacity, self.opened, self.root = capacity, 0, None
        self.rank = random.Random(int(capacity)).random

    def put(self, size: int) -> int:
        """The open bin with the least remaining capacity that holds ``size``, or a new one; its number."""
        low, high = _split(self.root, (size, -1))
        if high is None:
            remaining, number = self.capacity, self.opened
            self.opened += 1
        else:
            (remaining, number), high = _pop_least(high)
        self.root = _merge(low, high)
        if remaining > size:
            low, high = _split(self.root, (remaining - size, number))
            self.root = _merge(_merge(low, _Node((remaining - size, number), self.rank())), high)
        return number


def best_fit_decreasing(sizes: np.ndarray, bins: Bins) -> np.ndarray:
    """The bin of every size, the largest first; a size above the capacity is alone in its bin."""
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        out[i] = bins.put(int(sizes[i]))
    return out


def even_shards(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every size, in at most ``shards`` shards that are as equal as best-fit decreasing makes them."""
    out = np.zeros(len(sizes), np.int64)
    order, left, alone = np.argsort(-sizes, kind="stable"), int(sizes.sum()), 0
    while alone < min(shards - 1, len(sizes)) and int(sizes[order[alone]]) * (shards - alone) > left:
        out[order[alone]] = alone
        left -= int(sizes[order[alone]])
        alone += 1
    rest = order[alone:]
    if not len(rest):
        return out
    most = shards - alone
    fair, largest = -(-left // most), int(sizes[rest[0]])
    low, high = max(fair, largest) - 1, fair + largest  # the latter always is enough
    best = best_fit_decreasing(sizes[rest], Bins(high))
    while high - low > max(1, fair // 20_000):
        bins = Bins((low + high) // 2)
        found = best_fit_decreasing(sizes[rest], bins)
        if bins.opened <= most:
            high, best = bins.capacity, found
        else:
            low = bins.capacity
    out[rest] = alone + best
    return out


def _bundles(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, first = Bins(capacity), TaskContext.get().partitionId() << 32
        for frame in frames:
            yield frame.assign(bundle=best_fit_decreasing(frame["bytes"].to_numpy(np.int64), bins) + first)

    return run


def _number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task get numbers within their shard."""
    part, seen = TaskContext.get().partitionId(), {}
    for frame in frames:
        nth = frame.groupby("shard").cumcount().to_numpy(np.int64)
        before = frame["shard"].map(lambda s: seen.get(s, 0)).to_numpy(np.int64)
        for shard, n in frame["shard"].value_counts().items():
            seen[shard] = seen.get(shard, 0) + n
        yield frame.assign(part=part, nth=nth + before)


def shard_documents(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. Rows with equal texts share a shard.

    Size is the UTF-8 bytes of the text (null: none, like empty) and 16. With a ``capacity``, shards hold at most so many
    bytes and their number is made small; without, there are at most ``shards`` of near equal bytes. A group of equal
    texts is never parted: one above the capacity, or the fair share, is a shard by itself. ``law`` is ``bytes``, and
    grown_shard null. Slots count from 0 in every shard, without gaps. A null doc_id stays null and repeated rows are rows
    of their own; an empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = F.length("text").cast("long") + ROW_BYTES
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = store(rows, "sized")
    groups = store(rows.groupBy("digest").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    n_shards = shards if capacity is None else max(1, -(-total // capacity))
    share = total // n_shards if capacity is None else capacity
    bundle = max(1, share // max(4, min(BUNDLES_PER_SHARD, BUNDLES // n_shards)))
    groups = store(groups.mapInPandas(_bundles(bundle), "digest binary, rows long, bytes long, bundle long"), "bundles")
    bundles = groups.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).orderBy("bundle").toPandas()
    sizes = bundles["bytes"].to_numpy(np.int64)
    found = even_shards(sizes, shards) if capacity is None else best_fit_decreasing(sizes, Bins(capacity))
    plan = docs.sparkSession.createDataFrame(pd.DataFrame({"bundle": bundles["bundle"].to_numpy(np.int64), "shard": found.astype(np.int32)}), "bundle long, shard int")
    keyed = store(groups.join(F.broadcast(plan), "bundle").select("digest", "rows", "shard"), "shards")
    placed = join_weighted(rows, keyed, "digest", "rows").select("doc_id", "size", "text_crc32", "shard")
    placed = store(placed.mapInPandas(_number, "doc_id long, size long, text_crc32 long, shard int, part int, nth long"), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.expr("coalesce(sum(n) over (partition by shard order by part rows between unbounded preceding and 1 preceding), 0)")
    return placed.join(counts.select("shard", "part", before.alias("before")), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
