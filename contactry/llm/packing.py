"""Packing of token sequences: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, outer_id

CAPACITY = 1024
VOCABULARY = "byte_bpe_50k"
#: Word units whose ids one worker remembers: some 20 MB.
REMEMBERED = 100_000
#: A document's leftover: 36 bytes.
_TAIL = np.dtype([("doc_id", "<i8"), ("start", "<i8"), ("length", "<i8"), ("ids_crc32", "<u4"), ("doc_tokens", "<i8")])
_TWO_SPACES = re.compile(r"\s\s")


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree that tells the least capacity that holds a size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, window: int) -> None:
        self.windows[remaining].append(window)
        self._change(remaining, 1)

    def _change(self, remaining: int, by: int) -> None:
        node = remaining + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity of at least ``size``, removed: (capacity, window)."""
        node = size + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: go up until there is something to the right
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # wrapped around to the next level's left edge
                return None
        while node < self.leaves:
            node = 2 * node if self.count[2 * node] else 2 * node + 1
        remaining = node - self.leaves
        self._change(remaining, -1)
        return remaining, self.windows[remaining].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset in it, number of windows) for every size; sizes are at most ``capacity``."""
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, opened = OpenWindows(capacity), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            found = capacity, opened
            opened += 1
        remaining, at = found
        window[i], offset[i] = at, capacity - remaining
        if remaining > size:
            tree.add(remaining - size, at)
    return window, offset, opened


class Ids:
    """Token ids of a text as little-endian 32-bit bytes.

    The tokenizer file's added tokens (``added``: content and id) are cut out first, wherever they stand in the text.
    Where white space stands alone, a space and the word after it are a unit whose ids do not depend on the rest,
    so units are encoded once and remembered; other texts are encoded whole.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.added = {text: np.array([i], "<u4").tobytes() for text, i in (added or {}).items()}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def unit(self, unit: str) -> bytes:
        out = self.whole(" " + unit)
        if len(self.known) < REMEMBERED and len(unit) < 64:
            self.known[unit] = out
        return out

    def __call__(self, text: str) -> bytes:
        if self.split and any(t in text for t in self.added):
            return b"".join([self.added[part] if i % 2 else self.plain(part) for i, part in enumerate(self.split(text))])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _TWO_SPACES.search(text):
            return self.whole(text)
        head, *units = text.split(" ")
        known = self.known.get
        return self.whole(head) + b"".join([known(u) or self.unit(u) for u in units])


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Content and id of the tokenizer file's added tokens, which it turns into their ids wherever they stand."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"]:
            raise ValueError(f"added token with options that are not built: {t}")
    return {t["content"]: t["id"] for t in tokens}


_ids: dict[tuple[str, str, str], Ids] = {}


def _pack(ranks_path: str, tokenizer_path: str, pattern: str, capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = (ranks_path, tokenizer_path, pattern)
        if key not in _ids:
            _ids[key] = Ids(ranks_path, pattern, added_tokens(tokenizer_path))
        ids = _ids[key]
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        next_id = TaskContext.get().partitionId() << 32
        tails: list[np.ndarray] = []
        for frame in frames:
            full, left = [], []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                data = ids(text) + b"\0\0\0\0"
                n = len(data) // 4
                for start in range(0, n - n % capacity, capacity):
                    full.append((doc_id, start, capacity, zlib.crc32(data[4 * start : 4 * (start + capacity)]), n, next_id, 0))
                    next_id += 1
                if rest := n % capacity:
                    left.append((doc_id, n - rest, rest, zlib.crc32(data[-4 * rest :]), n))
            tails.append(np.array(left, _TAIL))
            yield pd.DataFrame(full, columns=columns)
        rest = np.concatenate(tails or [np.empty(0, _TAIL)])
        window, offset, _ = best_fit_decreasing(rest["length"].astype(np.int64), capacity)
        for low in range(0, len(rest), 65_536):
            part = slice(low, low + 65_536)
            out = pd.DataFrame({c: rest[c][part].astype(np.int64) for c in columns[:5]})
            yield out.assign(sequence_id=window[part] + next_id, offset=offset[part])

    return run


def pack(docs: DataFrame, vocabulary_folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and a closing id 0. Its full windows are sequences of their own; what is
    left over is packed best-fit decreasing among the leftovers of the same input partition, so nothing is
    shuffled and a task keeps 36 bytes per document of its partition, whatever its length, and the places of its windows. Null text counts as empty (one piece, the closing id).
    A null doc_id is kept as null; repeated rows are documents of their own; further columns are ignored.

    ``vocabulary_folder``: where the tokenizer files are; by default those of ``public_tokenizers``. The rank file
    and the added tokens of the tokenizer file give the same ids as that file under its defaults (tested), and faster.
    """
    import public_tokenizers

    names = (f"{VOCABULARY}.tiktoken", f"{VOCABULARY}.json")
    paths = [f"{vocabulary_folder}/{name}" if vocabulary_folder else public_tokenizers.path(name) for name in names]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInPandas(_pack(*paths, public_tokenizers.PATTERN, capacity), schema).withColumn("doc_id", outer_id())
