"""Windows of a document that also start in a document with a smaller id: shared by the byte and the word operator.

Steps, each a Spark job over tables of bounded groups:

1. copies: documents whose whole text stands under a smaller id; they are settled at once.
2. anchors: per chunk of documents and shard of the anchor space one row of packed 40-bit anchors; a shard
   answers which of them occur in at least two different texts.
3. segments: runs of windows under such an anchor, with their content. Other windows cannot repeat.
4. distinct contents per anchor with the smallest document id; an anchor with one content needs no more.
5. an anchor with several contents goes to ``resolve`` (the suffix order), which classes equal windows
   in pieces of PIECE contents. Up to HOT contents an anchor's pieces are merged in one task; beyond, pieces are
   classed on any task and merged by window hash with a pre-aggregated minimum, so no key meets in one task.
6. verdicts return to their documents, chunk by chunk.

The byte operator takes all steps; the word operator takes steps 2 and 3 (with anchors that repeat inside one document,
and without step 1) and confirms and finds its phrases by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import keyed_documents, n_partitions, store

#: Contents of one anchor that are classed together in one piece.
PIECE = 48
#: Contents of one anchor up to which one task takes them all, piece by piece: at most a few hundred KB.
HOT = 4096
#: Text bytes per shard of the anchor space: a task holds some 2 million anchors of one shard.
SHARD_BYTES = 32 << 20
_LOW40 = np.uint64((1 << 40) - 1)


@dataclass(frozen=True)
class Kind:
    """How a text is cut into units. ``prepare`` gives the bytes that contents are cut from, and unit hashes, starts, ends.

    ``own``: repeats inside one document count too, so runs are cut where equal windows could share one.
    """

    window: int
    k: int
    prepare: Callable[[bytes], tuple[bytes, np.ndarray, np.ndarray | None, np.ndarray | None]]
    own: bool = False

    def segments(self, text: bytes):
        data, units, starts, ends = self.prepare(text)
        keys, first, count = textscan.runs(units, self.window, self.k, self.own)
        return data, starts, ends, keys, first, count

    def cut(self, data: bytes, starts, ends, first: np.ndarray, count: np.ndarray) -> list[bytes]:
        last = first + count + self.window - 2
        low, high = (first, last + 1) if starts is None else (starts[first], ends[last])
        return [data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]


#: resolve(contents of one anchor or piece, their smallest document ids)
#: -> (content number, window in it, smallest document id of the window's class) of every window.
Resolve = Callable[[list[list[bytes]], list[np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def _anchor_blocks(kind: Kind, shards: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for chunk, part in frame.groupby("chunk", sort=False):
                rows = []
                for text in part["text"]:
                    found, times = np.unique(kind.segments(text)[3], return_counts=True)
                    rows.append(np.repeat(found, np.minimum(times, 2)) if kind.own else found)
                sizes = [len(x) for x in rows]
                keys = np.concatenate(rows)
                if not len(keys):
                    continue
                owner = np.repeat(np.arange(len(rows), dtype=np.uint32), sizes)
                shard = (keys >> np.uint64(40)) % np.uint64(shards)
                order = np.argsort(shard, kind="stable")
                present, cuts = np.unique(shard[order], return_index=True)
                cuts = np.append(cuts, len(order))
                idents = part["ident"].to_numpy(np.int64)
                out = []
                for i, s in enumerate(present.tolist()):
                    at = order[cuts[i] : cuts[i + 1]]
                    used, nth = np.unique(owner[at], return_inverse=True)
                    out.append((s, chunk, _pack(keys[at] & _LOW40), nth.astype("<u2" if len(used) <= 65536 else "<u4").tobytes(), idents[used].tobytes()))
                yield pd.DataFrame(out, columns=["shard", "chunk", "keys", "nth", "idents"])

    return scan


def _repeated_in_shard(frame: pd.DataFrame, own: bool) -> pd.DataFrame:
    """Anchors in at least two different texts; with ``own``, also those at two places of one text or of equal ones."""
    keys, idents, block = [], [], []
    for i, (packed, nth, ids) in enumerate(zip(frame["keys"], frame["nth"], frame["idents"], strict=True)):
        k = _unpack(packed)
        ids = np.frombuffer(ids, np.int64)
        keys.append(k)
        idents.append(ids[np.frombuffer(nth, "<u2" if len(ids) <= 65536 else "<u4")])
        block.append(np.full(len(k), i, np.uint32))
    k, ident, block = np.concatenate(keys), np.concatenate(idents), np.concatenate(block)
    order = np.argsort(k, kind="stable")
    sorted_k = k[order]
    at = np.flatnonzero(np.concatenate(([True], sorted_k[1:] != sorted_k[:-1])))
    sizes = np.diff(np.append(at, len(k)))
    many = sizes > 1 if own else np.minimum.reduceat(ident[order], at) != np.maximum.reduceat(ident[order], at)
    hit = np.zeros(len(k), bool)
    hit[order] = np.repeat(many, sizes)
    out = []
    shard = np.uint64(int(frame["shard"].iloc[0]))
    at = np.flatnonzero(hit)
    cuts = np.searchsorted(block[at], np.arange(len(frame) + 1))
    for i, chunk in enumerate(frame["chunk"]):
        own = np.unique(k[at[cuts[i] : cuts[i + 1]]])
        if len(own):
            out.append((chunk, ((shard << np.uint64(40)) | own).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "keys"])


def _segments_of_chunk(kind: Kind, shards: int):
    columns = ["a", "chunk", "doc_id", "ident", "first", "n", "content"] + ["more"] * kind.own

    def cut(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        marks = told["keys"].notna()
        copies = set(zip(told.loc[~marks, "doc_id"], told.loc[~marks, "ident"], strict=True))
        repeated = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in told.loc[marks, "keys"]] or [np.empty(0, np.uint64)]))
        out, content, more, done = [], [], [], set()
        chunk = int(docs["chunk"].iloc[0]) if len(docs) else 0
        for doc_id, ident, text in zip(docs["doc_id"], docs["ident"], docs["text"], strict=True):
            if not len(repeated) or (doc_id, ident) in copies or (doc_id, ident) in done:
                continue
            done.add((doc_id, ident))
            data, starts, ends, keys, first, count = kind.segments(text)
            full = (((keys >> np.uint64(40)) % np.uint64(shards)) << np.uint64(40)) | (keys & _LOW40)
            hit = np.searchsorted(repeated, full)
            hit[hit == len(repeated)] = 0
            at = np.flatnonzero(repeated[hit] == full)
            if len(at) and kind.own:  # equal runs of one document travel as one, with all their places
                places: dict[bytes, list[int]] = {}
                for i, run in zip(at.tolist(), kind.cut(data, starts, ends, first[at], count[at]), strict=True):
                    places.setdefault(run, []).append(i)
                at = np.array([x[0] for x in places.values()])
                more += [first[x[1:]].astype("<i4").tobytes() for x in places.values()]
            if len(at):
                out.append((keys[at].view(np.int64), np.full(len(at), doc_id, np.int64), np.full(len(at), ident, np.int64), first[at], count[at]))
                content += kind.cut(data, starts, ends, first[at], count[at])
        a, doc_id, ident, first, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * 5
        frame = {"a": a, "chunk": np.full(len(a), chunk), "doc_id": doc_id, "ident": ident, "first": first, "n": n, "content": content}
        return pd.DataFrame(frame | ({"more": more} if kind.own else {}), columns=columns)

    return cut


def _pieces(frames: Iterator[pd.DataFrame], most: int, most_bytes: int = 1 << 20) -> Iterator[tuple[pd.DataFrame, list[list[bytes]], list[np.ndarray]]]:
    """Rows that come sorted by anchor, in batches of pieces; a piece is one anchor's contents, up to ``most`` of them."""
    left = None
    for frame in frames:
        frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
        if not len(frame):
            continue
        a = frame["a"].to_numpy()
        tail = len(a) - 1 - int(np.flatnonzero(a[::-1] != a[-1])[0]) if (a != a[-1]).any() else -1
        open_from = tail + 1 if len(a) - tail - 1 <= most else len(a)
        left = frame.iloc[open_from:]
        yield from _batches(frame.iloc[:open_from], most, most_bytes)
    if left is not None:
        yield from _batches(left, most, most_bytes)


def _batches(frame: pd.DataFrame, most: int, most_bytes: int):
    if not len(frame):
        return
    a = frame["a"].to_numpy()
    change = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
    size = np.diff(np.append(change, len(a)))
    parts = -(-size // most)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(change, parts) + nth * most
    stop = np.minimum(start + most, np.repeat(change + size, parts))
    length = np.concatenate(([0], np.cumsum(frame["content"].map(len).to_numpy())))
    low = 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(length[stop], length[start[low]] + most_bytes, "right")))
        rows = frame.iloc[start[low] : stop[high - 1]].reset_index(drop=True)
        base = start[low]
        content, ids = rows["content"].tolist(), rows["min_doc"].to_numpy(np.int64)
        cut = [(int(s - base), int(e - base)) for s, e in zip(start[low:high], stop[low:high], strict=True)]
        yield rows, [content[s:e] for s, e in cut], [ids[s:e] for s, e in cut]
        low = high


def _names(kind: Kind, content: bytes) -> list[bytes]:
    """A 128-bit hash of every window of a content."""
    units = [content[i : i + 1] for i in range(len(content))] if kind.prepare(b"")[2] is None else content.split(b" ")
    joint = b"" if kind.prepare(b"")[2] is None else b" "
    return [blake2b(joint.join(units[w : w + kind.window]), digest_size=16).digest() for w in range(len(units) - kind.window + 1)]


def _masks(resolve: Resolve, kind: Kind):
    """All contents of an anchor are here: its classes are final. Those of several pieces are merged by name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, contents, ids in _pieces(frames, HOT):
            flat = rows["content"].tolist()
            parts = [(g[i : i + PIECE], d[i : i + PIECE]) for g, d in zip(contents, ids, strict=True) for i in range(0, len(g), PIECE)]
            content, window, least = resolve([p[0] for p in parts], [p[1] for p in parts])
            large = np.concatenate([np.full(len(g), len(g) > PIECE) for g in contents])
            at = np.flatnonzero(large[content])
            if len(at):
                names = {i: _names(kind, flat[i]) for i in np.flatnonzero(large).tolist()}
                keys = np.array([names[c][w] for c, w in zip(content[at].tolist(), window[at].tolist(), strict=True)], dtype="V16").view([("hi", "<u8"), ("lo", "<u8")])
                _, same = np.unique(keys, return_inverse=True)
                low = np.full(same.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, same, least[at])
                least[at] = low[same]
            own = rows["min_doc"].to_numpy(np.int64)
            hit = least < own[content]
            mask = np.zeros(len(rows), np.uint64)
            np.bitwise_or.at(mask, content[hit], np.uint64(1) << window[hit].astype(np.uint64))
            some = mask != 0
            yield pd.DataFrame({"a": rows["a"], "c": rows["c"], "min_doc": own, "mask": mask.view(np.int64)})[some]

    return run


def _window_rows(resolve: Resolve, kind: Kind):
    """An anchor's contents are spread over tasks: the classes of each piece, by window name, to be merged by Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, contents, ids in _pieces(frames, PIECE):
            content, window, least = resolve(contents, ids)
            names = [_names(kind, x) for x in rows["content"]]
            named = [names[c][w] for c, w in zip(content.tolist(), window.tolist(), strict=True)]
            yield pd.DataFrame({"name": named, "least": least, "a": rows["a"].to_numpy()[content], "c": rows["c"].to_numpy()[content], "min_doc": rows["min_doc"].to_numpy()[content], "window": window})

    return run


def anchored_segments(keyed: DataFrame, kind: Kind, copies: DataFrame | None = None) -> DataFrame:
    """Runs of windows under an anchor that repeats, with their content; rows in ``copies`` are left out.

    Where repeats inside a document count, ``more`` has the further places of an equal run in it (32-bit, little-endian). The number of anchor shards follows the bytes of the texts. Rows with the same id and text are taken once.
    """
    spark = keyed.sparkSession
    n_bytes = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(n_partitions(spark), -(-n_bytes // SHARD_BYTES))
    blocks = keyed.select("chunk", "ident", "text").mapInPandas(_anchor_blocks(kind, shards), "shard int, chunk long, keys binary, nth binary, idents binary")
    answers = store(blocks.groupBy("shard").applyInPandas(lambda frame: _repeated_in_shard(frame, kind.own), "chunk long, keys binary"), "anchors")
    none = F.lit(0).cast("long")  # not null: pandas would turn the idents of copies into floats
    told = answers.select("chunk", "keys", none.alias("doc_id"), none.alias("ident"))
    if copies is not None:
        told = told.unionByName(copies.select("chunk", F.lit(None).cast("binary").alias("keys"), "doc_id", "ident"))
    found = keyed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(
        _segments_of_chunk(kind, shards), "a long, chunk long, doc_id long, ident long, first int, n int, content binary" + ", more binary" * kind.own
    )
    return store(found, "segments")


def repeated_windows(docs: DataFrame, kind: Kind, resolve: Resolve) -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id, chunk, ident, text; notes by chunk on what repeats in them).

    A note without ``first`` says that the document is a copy of a smaller one; others carry a run of windows,
    ``first`` and ``n``, and a bit mask of those that start in a smaller document.
    """
    shards = n_partitions(docs.sparkSession)
    keyed = keyed_documents(docs)
    digests = store(keyed.select("doc_id", "chunk", "ident", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = store(digests.join(firsts, "digest").where("doc_id > least").select("chunk", "doc_id", "ident"), "copies")
    named = F.xxhash64("content")  # with the anchor, a content's name; cheaper to compute again than to store
    segments = anchored_segments(keyed, kind, copies).withColumn("c", named)

    contents = segments.groupBy("a", "content").agg(F.min("doc_id").alias("min_doc"), F.max("doc_id").alias("max_doc"))
    contents = store(contents, "contents").withColumn("c", named)
    several = store(contents.groupBy("a").agg(F.count("*").alias("of"), F.min("min_doc").alias("lo"), F.max("max_doc").alias("hi")).where("of > 1 and lo < hi").select("a", "of"), "several")
    few = contents.join(several.where(F.col("of") <= HOT), "a").select("a", "c", "content", "min_doc")
    schema = "a long, c long, min_doc long, mask long"
    masks = few.repartition(shards, "a").sortWithinPartitions("a", "min_doc", "content").mapInPandas(_masks(resolve, kind), schema)
    many = contents.join(several.where(F.col("of") > HOT), "a").select("a", "c", "content", "min_doc")
    windows = store(many.mapInPandas(_window_rows(resolve, kind), "name binary, least long, a long, c long, min_doc long, window int"), "windows")
    merged = windows.groupBy("name").agg(F.min("least").alias("lowest"), F.max("min_doc").alias("high")).where("lowest < high").select("name", "lowest")
    hot_masks = windows.join(merged, "name").where("lowest < min_doc").groupBy("a", "c", "min_doc").agg(F.bit_or(F.expr("shiftleft(1L, window)")).alias("mask"))
    whole = contents.where("min_doc < max_doc").select("a", "c", "min_doc", F.lit(0).cast("long").alias("mask"))
    verdicts = store(masks.unionByName(hot_masks).unionByName(whole), "verdicts")

    hits = (
        segments.select("a", "c", "chunk", "doc_id", "ident", "first", "n")
        .join(verdicts, ["a", "c"])
        .where("doc_id > min_doc or mask <> 0")
        .select("chunk", "doc_id", "ident", "first", "n", F.when(F.col("doc_id") > F.col("min_doc"), F.lit(-1)).otherwise(F.col("mask")).cast("long").alias("mask"))
    )
    notes = hits.unionByName(copies, allowMissingColumns=True)
    return keyed, store(notes, "notes")


Notes = tuple[np.ndarray, np.ndarray, np.ndarray]


def notes_by_document(notes: pd.DataFrame) -> dict[tuple[int, int], Notes | None]:
    """first, n and mask of the notes on each (doc_id, ident) of a chunk; None for a copy of a smaller document."""
    doc_id, ident = notes["doc_id"].to_numpy(np.int64), notes["ident"].to_numpy(np.int64)
    order = np.lexsort((ident, doc_id))
    doc_id, ident = doc_id[order], ident[order]
    copied = notes["first"].isna().to_numpy()[order]
    first, n, mask = (notes[c].fillna(0).to_numpy(np.int64)[order] for c in ("first", "n", "mask"))
    change = np.ones(len(order), bool)
    change[1:] = (doc_id[1:] != doc_id[:-1]) | (ident[1:] != ident[:-1])
    cuts = np.append(np.flatnonzero(change), len(order)).tolist()
    return {
        (int(doc_id[a]), int(ident[a])): None if copied[a:b].any() else (first[a:b], n[a:b], mask[a:b])
        for a, b in zip(cuts, cuts[1:], strict=False)
    }


def marked(n_units: int, window: int, notes: Notes) -> np.ndarray:
    """Which units are covered by a repeated window."""
    starts = np.zeros(max(n_units - window + 1, 0), bool)
    first, n, mask = notes
    whole = mask == -1
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, first[whole], 1)
    np.add.at(edge, first[whole] + n[whole], -1)
    starts |= np.cumsum(edge)[:-1] > 0
    bits, at = mask[~whole], first[~whole]
    for b in range(textscan.RUN):
        some = (bits >> b) & 1 == 1
        starts[at[some] + b] = True
    return cover(starts, n_units, window)


def cover(starts: np.ndarray, n_units: int, window: int) -> np.ndarray:
    """Units covered by windows at the marked starts."""
    edge = np.zeros(n_units + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    edge[at + window] -= 1  # starts are distinct, so are the ends
    return np.cumsum(edge)[:-1] > 0
