"""Substring dedup with repeated-phrase automata: remove words under a 20-word window that also starts earlier.

1. Runs of windows under a repeated anchor are cut from all documents; no other window can recur.
2. Recurring phrases are confirmed: an aggregate over the windows' names keeps those with two places or more, and
   where the smallest document has them.
3. Confirmed phrases are dealt to shards of bounded size, by anchor (phrases of an anchor that has very many: by their
   names). Every shard compiles an Aho-Corasick automaton, a symbol for every four words, and the runs of all documents
   under its anchors stream through it. Each removed word comes from a place that an automaton reports: copies of
   whole documents and repeats inside one document take the same way.

A shard through which very many runs stream is compiled on several tasks, each taking a part of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .common import keyed_documents, outer_id, store
from .repeats import Kind, anchored_segments, marked, notes_by_document

WINDOW = 20
#: Words to a symbol of an automaton; it divides the window.
GRAM = 4
#: Digits of a symbol: one of 256 values, and one for the rest, which has a further value for every 256 symbols.
DIGITS = 2
#: Phrases in one automaton, on average: about 200,000 nodes.
SHARD_PHRASES = 20_000
#: Phrases of one anchor from which they are dealt by their words.
HOT_PHRASES = 4096
#: Runs that stream through one copy of an automaton, on average.
STREAM_RUNS = 100_000
#: Passages whose phrases an automaton's copy remembers, so that equal ones are scanned once.
REMEMBERED = 100_000


def join_words(text: bytes) -> bytes:
    """The words of a text, joined by one space; bytes.split() parts at space and 0x09-0x0D only."""
    return b" ".join(text.split())


def _prepare(text: bytes):
    joined = join_words(text)
    return joined, *textscan.word_units(joined)


WORDS = Kind(WINDOW, 8, _prepare, own=True)


def _names(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of each window of each content: content, place in it, hash, first and last byte in the joined contents (given too)."""
    data = b" ".join(contents)
    units, starts, ends = textscan.word_units(data)
    content = np.searchsorted(np.cumsum([len(c) + 1 for c in contents]), starts, "right")
    names = textscan.rolling_all(units, WINDOW)
    at = np.flatnonzero(content[: len(names)] == content[WINDOW - 1 :])
    low = np.searchsorted(content, np.arange(len(contents)))
    return content[at], at - low[content[at]], names[at].view(np.int64), starts[at], ends[at + WINDOW - 1], data


def _windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of each content by its name, with ``at``: the content's name, its last five bits the place in it."""
    for frame in frames:
        if len(frame):
            content, nth, name, *_ = _names(frame["content"].tolist())
            rows = frame[["a", "least", "places"]].iloc[content]
            yield rows.assign(name=name, at=frame["c"].to_numpy(np.int64)[content] | nth)


def _single(keys: list[str]):
    """Each window of each content as a row of its own with ``name`` and ``words``; only those at the bits of a ``mask`` if it is among ``keys``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                content, nth, name, start, end, data = _names(frame["content"].tolist())
                at = np.flatnonzero(frame["mask"].to_numpy(np.int64)[content] >> nth & 1) if "mask" in keys else np.arange(len(nth))
                words = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                rows = frame[keys].iloc[content[at]].assign(name=name[at], words=words)
                if "mask" in keys:
                    yield rows.assign(mask=1)
                else:
                    more = [(np.frombuffer(m, "<i4") + n).astype("<i4").tobytes() if m else m for m, n in zip(rows["more"], nth.tolist(), strict=True)]
                    yield rows.assign(first=rows["first"].to_numpy() + nth.astype(np.int32), more=more)

    return run


_DIGIT = [chr(256 + i) for i in range(256)]


class Automaton:
    """Phrases of a shard with the smallest document of each; finds the places of a passage that are to go.

    A symbol stands for GRAM consecutive words, so a phrase is a few symbols, and a passage streams through once for each
    of the GRAM words at which its symbols can begin. A symbol is written in DIGITS digits, as a node of the automaton looks
    through all its children: with a letter for each symbol, its root would have one for almost every phrase.
    """

    def __init__(self):
        self.symbols: dict[tuple[bytes, ...], str] = {}
        self.texts: dict[bytes, list[str]] = {}
        self.least: list[int] = []
        self.seen: list[tuple[int, int] | None] = []
        self.known: dict[bytes, tuple[int, int, list[tuple[int, int]]]] = {}
        self.machine = ahocorasick.Automaton()
        self.ready = False

    def add(self, passage: bytes, mask: int, least: int) -> None:
        """The windows of ``passage`` at the bits of ``mask`` are phrases."""
        symbols, text = self.symbols, []
        for gram in _grams(passage):
            symbol = symbols.get(gram)
            if symbol is None:
                n = len(symbols)
                symbol = symbols[gram] = _DIGIT[n & 255] + chr(512 + (n >> 8))
            text.append(symbol)
        self.texts[passage] = text
        for i in range(len(text) - WINDOW + GRAM):
            if mask >> i & 1:
                self.machine.add_word("".join(text[i : i + WINDOW : GRAM]), len(self.least))
                self.least.append(least)
                self.seen.append(None)

    def phrases(self, passage: bytes) -> list[tuple[int, int]]:
        """(bit of the window, phrase) of the phrases in a passage, from left to right."""
        text = self.texts.get(passage)
        if text is None:
            get = self.symbols.get
            text = [get(gram, "\0" * DIGITS) for gram in _grams(passage)]
        ends = [(low, end + 1, p) for low in range(GRAM) for end, p in self.machine.iter("".join(text[low::GRAM]))]
        found = sorted([(low + end // DIGITS * GRAM - WINDOW, p) for low, end, p in ends if end % DIGITS == 0])
        return [(1 << at, p) for at, p in found]

    def places(self, passage: bytes, row: tuple[int, int]) -> int:
        """Bits of the windows that stand in a smaller document, or further left in this one.

        ``row`` is (doc_id, ident); the passages of a row come one after the other, by their first places.
        """
        if not self.least:
            return 0
        if not self.ready:
            self.machine.make_automaton()
            self.ready = True
        known = self.known.get(passage)
        if known is None:
            phrases = self.phrases(passage)
            known = sum([b for b, _ in phrases]), max([self.least[p] for _, p in phrases], default=0), phrases
            if len(self.known) < REMEMBERED:
                self.known[passage] = known
        every, most, phrases = known
        if row[0] > most:  # all of them stand in smaller documents
            return every
        least, seen, doc_id, bits = self.least, self.seen, row[0], 0
        for bit, p in phrases:
            if least[p] < doc_id or seen[p] == row:
                bits |= bit
            else:
                seen[p] = row
        return bits


def _grams(passage: bytes) -> Iterator[tuple[bytes, ...]]:
    """Every GRAM consecutive words."""
    words = passage.split(b" ")
    return zip(*(words[i:] for i in range(GRAM)))  # noqa: B905


def _locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by shard: its phrases (``part`` 0, doc_id the smallest document), then passages by row and first place.

    A passage that stands at more places of its row streams through a second time, for all of them.
    """
    at, automaton = None, Automaton()
    for frame in frames:
        out = []
        columns = (frame[c].tolist() for c in ("shard", "salt", "part", "chunk", "doc_id", "ident", "first", "more", "mask", "words"))
        for shard, salt, part, chunk, doc_id, ident, first, more, mask, words in zip(*columns, strict=True):
            if (shard, salt) != at:
                at, automaton = (shard, salt), Automaton()
            if part == 0:
                automaton.add(words, mask, doc_id)
                continue
            if bits := automaton.places(words, (doc_id, ident)):
                out.append((chunk, doc_id, ident, first.to_bytes(4, "little", signed=True), bits))
            if more and (bits := automaton.places(words, (doc_id, ident))):
                out.append((chunk, doc_id, ident, more, bits))
        yield pd.DataFrame(out, columns=["chunk", "doc_id", "ident", "firsts", "mask"])


def confirmed_phrases(contents: DataFrame) -> DataFrame:
    """a, c, mask: the windows of a content, as bits, that have two places or more; each phrase once, in its smallest document.

    Windows are told apart by name, a 64-bit hash beside the anchor. It only chooses what is compiled: the automaton
    compares words, so equal names of different windows remove nothing.
    """
    windows = contents.mapInPandas(_windows, "a long, least long, places long, name long, at long")
    found = windows.groupBy("a", "name").agg(F.sum("places").alias("places"), F.min_by("at", "least").alias("at"))
    content, nth = F.col("at").bitwiseAND(F.lit(~31).cast("long")), F.col("at").bitwiseAND(F.lit(31)).cast("int")
    chosen = found.where("places > 1").select("a", content.alias("c"), nth.alias("nth"))
    return chosen.groupBy("a", "c").agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("mask"))


def repeated_places(segments: DataFrame) -> DataFrame:
    """chunk, doc_id, ident, firsts, mask: windows from each of ``firsts`` (packed) on that an automaton reports as repeats."""
    places = F.sum(1 + F.length("more") / 4).cast("long").alias("places")
    contents = segments.groupBy("a", "content").agg(F.min("doc_id").alias("least"), places)
    contents = store(contents.withColumn("c", F.xxhash64("content").bitwiseAND(F.lit(~31).cast("long"))), "contents")
    confirmed = confirmed_phrases(contents).join(contents.select("a", "c", "least", "content"), ["a", "c"])
    confirmed = store(confirmed.select("a", F.col("least").alias("doc_id"), "mask", "content"), "patterns")
    per_anchor = store(confirmed.groupBy("a").agg(F.sum(F.bit_count("mask")).alias("of")), "anchor_phrases")
    shards = max(1, -(-(per_anchor.agg(F.sum("of")).first()[0] or 0) // SHARD_PHRASES))
    hot = store(per_anchor.where(F.col("of") >= HOT_PHRASES).select("a"), "hot")  # stored, so its size is known to the joins

    def dealt(rows, keys, types):
        """Rows by the shard of their anchor, those under a hot anchor window by window."""
        plain = rows.join(hot, "a", "left_anti").select(F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int").alias("shard"), *keys, F.col("content").alias("words"))
        single = rows.join(hot, "a", "left_semi").mapInPandas(_single(keys), f"{types}, name long, words binary")
        return plain.unionByName(single.select(F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), *keys, "words"))

    patterns = dealt(confirmed, ["doc_id", "mask"], "doc_id long, mask long")
    passages = dealt(segments, ["chunk", "doc_id", "ident", "first", "more"], "chunk long, doc_id long, ident long, first int, more binary")
    load = store(passages.groupBy("shard").agg(F.ceil(F.count("*") / STREAM_RUNS).cast("int").alias("salts")), "load")
    zero, none = F.lit(0), F.lit(0).cast("long")
    patterns = patterns.join(load, "shard").select(
        "shard", F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"), zero.alias("part"), none.alias("chunk"),
        "doc_id", none.alias("ident"), zero.alias("first"), F.lit(None).cast("binary").alias("more"), "mask", "words",
    )
    passages = passages.join(load, "shard").select(
        "shard", F.pmod(F.xxhash64("doc_id", "ident"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("part"), "chunk",
        "doc_id", "ident", "first", "more", none.alias("mask"), "words",
    )
    stream = patterns.unionByName(passages).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "part", "doc_id", "ident", "first")
    return store(stream.mapInPandas(_locate, "chunk long, doc_id long, ident long, firsts binary, mask long"), "notes")


def _apply(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    firsts = [np.frombuffer(x, "<i4") for x in notes["firsts"]]
    wide = notes.iloc[np.repeat(np.arange(len(notes)), [len(x) for x in firsts])]
    told = notes_by_document(wide.assign(first=np.concatenate(firsts or [np.empty(0, np.int32)]), n=0))
    out = []
    for doc_id, ident, text in zip(docs["doc_id"], docs["ident"], docs["text"], strict=True):
        joined = join_words(text)
        starts, ends = textscan.word_spans(joined)
        kept, n, n_gone = joined, len(starts), 0
        if (doc_id, ident) in told:
            gone = marked(n, WINDOW, told[doc_id, ident])
            n_gone, keep = int(gone.sum()), np.flatnonzero(~gone)
            kept = b" ".join([joined[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
        out.append((doc_id, n, n_gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup_phrases(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and the kept words if asked for.

    Words are runs of bytes other than space and 0x09-0x0D. A word goes if a window of 20 words over it also
    starts earlier: in a smaller document, or further left in the same one. Null text has no words. A null doc_id
    counts as smaller than all others and is returned as null. Rows with the same doc_id don't remove each
    other's words. Very long texts are cut into runs of at most 32 windows and take the same way; equal runs of a document
    (a ruler, a repeated line) travel as one, with all their places. An empty table gives
    no rows; further columns are ignored.
    """
    keyed = keyed_documents(docs)
    notes = repeated_places(anchored_segments(keyed, WORDS))
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    out = keyed.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInPandas(lambda d, m: _apply(d, m)[columns], schema)
    return out.withColumn("doc_id", outer_id())
