"""Exact dedup over a minimal perfect hash of historical digests.

History is kept as an index: its distinct SHA-256 digests, sharded by digest so that a shard stays small, each
shard a minimal perfect hash (levels of collision-free bits; a key's slot is the rank of its bit) whose slots hold
the full digest, the winner's doc_id and the size of its group. A new batch is grouped by digest first (with map-side
combining, so a text that is a third of all rows is one row per task), then its distinct digests are looked up.
A lookup compares all 32 bytes in the slot: members are repeats of history and merge with their slot; nonmembers
form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, outer_id, store
from .textscan import mix

KEYS_PER_SHARD = 8192
_U = np.uint64


class PerfectHash:
    """Levels of bit arrays; a key takes the first level in which no other remaining key shares its bit."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []
        total = 0
        for bits in levels:
            self.ranks.append(total + np.concatenate(([0], np.cumsum(bits)[:-1])) if len(bits) else np.empty(0, np.int64))
            total += int(bits.sum())

    @staticmethod
    def _bit(halves: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(halves[:, 0] + mix(halves[:, 1] ^ _U(level * 0x9E37 + 1))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """``digests``: distinct rows of four 64-bit words."""
        levels, left = [], digests
        while len(left):
            size = 2 * len(left) + 1
            at = cls._bit(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for every digest, member or not; -1 where all levels say no."""
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            at = self._bit(digests[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.ranks[level][at[hit]]
            left = left[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<i8")
        return sizes.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        at, levels = 8 * (n + 1), []
        for size in sizes.tolist():
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += len(packed)
        return cls(levels)


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    keys = _matrix(frame["digest"])
    hashed = PerfectHash.build(keys)
    order = np.argsort(hashed.slots(keys))
    pick = lambda c: frame[c].to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame({"shard": frame["shard"].iloc[:1], "hash": [hashed.dump()], "digests": [keys[order].tobytes()], "winners": [pick("keep_id")], "sizes": [pick("group_size")]})


def _probe_shard(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = batch[["digest", "keep_id", "group_size"]].copy()
    if not len(batch) or not len(index):
        return out
    row = index.iloc[0]
    keys, stored = _matrix(batch["digest"]), np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
    slot = PerfectHash.load(row["hash"]).slots(keys)
    member = (slot >= 0) & (stored[slot] == keys).all(1)  # the full digest decides
    keep, size = out["keep_id"].to_numpy(np.int64).copy(), out["group_size"].to_numpy(np.int64).copy()
    at = slot[member]
    keep[member] = np.maximum(keep[member], np.frombuffer(row["winners"], np.int64)[at])
    size[member] += np.frombuffer(row["sizes"], np.int64)[at]
    return out.assign(keep_id=keep, group_size=size)


def groups(rows: DataFrame) -> DataFrame:
    """Distinct digests with the largest doc_id and the number of rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _shard(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def build_index(history: DataFrame, n_shards: int) -> DataFrame:
    """history: rows of ``groups``. One row per shard: its perfect hash and slots."""
    return history.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(
        _build_shard, "shard int, hash binary, digests binary, winners binary, sizes binary"
    )


def probe(batch: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """batch: rows of ``groups``. Members come merged with their slot, nonmembers as they are."""
    return batch.withColumn("shard", _shard(n_shards)).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(
        _probe_shard, "digest binary, keep_id long, group_size long"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty; of equal texts the row with the largest doc_id stays.
    A null doc_id counts as smaller than all others (keep_id is null where a group has no other). Of repeated rows
    (same doc_id and text) one is kept, and all count in group_size. An empty table gives no rows; further columns
    are ignored. The older half of the ids is the history, the rest the new batch.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    nth = F.row_number().over(W.partitionBy("digest", "doc_id").orderBy(F.lit(1)))
    rows = store(rows.withColumn("nth", nth), "digests")
    low, high = rows.where(F.col("doc_id") != NO_ID).agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = (low + high) // 2 if low is not None else 0
    history = store(groups(rows.where(F.col("doc_id") <= middle)), "history")
    n_shards = max(1, -(-history.count() // KEYS_PER_SHARD))
    index = store(build_index(history, n_shards), "index")
    current = store(probe(groups(rows.where(F.col("doc_id") > middle)), index, n_shards), "current")
    winners = current.unionByName(history.join(current, "digest", "left_anti"))
    out = rows.join(winners, "digest")
    return out.select(
        outer_id().alias("doc_id"),
        outer_id("keep_id").alias("keep_id"),
        F.col("group_size"),
        ((F.col("doc_id") == F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
