"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file gives pieces and scores, taken as log scores. Spaces become the marker U+2581; characters
without a piece fall back to byte pieces. Where no piece holds a marker after another character, the best path
breaks before every marked word, so distinct words are encoded once per worker, many side by side in numpy.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, outer_id

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: An unknown character scores this much below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Units that one worker remembers.
REMEMBERED = 600_000
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    types: list[int]
    dummy_prefix: bool = True

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        pieces, scores, types, dummy = [], [], [], True
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    pieces.append(piece[1].decode())
                    scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                    types.append(piece.get(3, _NORMAL))
                elif number == 3:
                    dummy = bool(dict(_fields(value)).get(3, 1))
        return cls(pieces, np.array(scores), types, dummy)


class DoubleArray:
    """Trie over the UTF-8 bytes of the pieces: the child of s by byte b is base[s] + b if check[...] == s."""

    def __init__(self, words: dict[bytes, int]):
        base, check, value, used = [0], [-1], [-1], bytearray([1])
        todo = [(0, sorted(words), 0)]
        free, tail = 1, 1
        for state, own, depth in todo:  # grows while it runs: breadth first
            if own and len(own[0]) == depth:
                value[state] = words[own[0]]
                own = own[1:]
            if not own:
                continue
            parts: dict[int, list[bytes]] = {}
            for w in own:
                parts.setdefault(w[depth], []).append(w)
            keys = list(parts)
            # one child takes the first gap; several look from the sparse end on
            at = free if len(keys) == 1 else tail
            while True:
                if at + 512 > len(used):
                    grow = len(used) + 512
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    used += bytes(grow)
                begin = at - keys[0]
                if begin >= 0 and not any(used[begin + k] for k in keys):
                    break
                at += 1
            if len(keys) == 1:
                free = at
            else:
                tail = max(tail, at - 64)
            base[state] = begin
            for k, inner in parts.items():
                used[begin + k] = 1
                check[begin + k] = state
                todo.append((begin + k, inner, depth + 1))
        self.base, self.check, self.value = (np.array(x, np.int64) for x in (base, check, value))
        self.longest = max(map(len, words), default=0)


class Unigram:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        normal = {p.encode(): i for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)) if t == _NORMAL}
        self.trie = DoubleArray(normal)
        self.scores = v.scores
        self.dummy_prefix = v.dummy_prefix
        self.unknown_score = min((v.scores[i] for i in normal.values()), default=0.0) - UNKNOWN_PENALTY
        self.unknown = v.types.index(_UNKNOWN) if _UNKNOWN in v.types else 0
        self.byte_ids = np.full(256, -1, np.int64)
        for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)):
            if t == _BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.fallback = bool((self.byte_ids >= 0).all())
        of_byte = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids) if i >= 0}
        self.output = [of_byte.get(i, p.encode() if t == _NORMAL else b" \xe2\x81\x87 " if t == _UNKNOWN else b"") for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True))]
        self.by_word = not any(MARK in p.lstrip(MARK) for p, t in zip(v.pieces, v.types, strict=True) if t == _NORMAL)

    def units(self, text: str) -> list[str]:
        marked = (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)
        return _UNIT.findall(marked) if self.by_word else [marked] if marked else []

    def encode_units(self, units: list[str]) -> list[tuple[bytes, int, float]]:
        """(ids as little-endian 32-bit bytes, number of byte pieces, score) of every unit."""
        data = [u.encode() for u in units]
        out: list = [None] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(data[i]))
        low = 0
        while low < len(order):
            high = low + 1
            most = max(16, 2 * len(data[order[low]]))
            while high < len(order) and high - low < 4096 and len(data[order[high]]) <= most:
                high += 1
            for i, x in zip(order[low:high], self._viterbi([data[i] for i in order[low:high]]), strict=True):
                out[i] = x
            low = high
        return out

    def _viterbi(self, data: list[bytes]) -> list[tuple[bytes, int, float]]:
        n, size = len(data), np.array([len(d) for d in data])
        wide = int(size.max())
        text = np.frombuffer(b"".join(d.ljust(wide, b"\0") for d in data), np.uint8).reshape(n, wide).astype(np.int64)
        lead = (text & 0xC0) != 0x80
        after = np.full((n, wide), 1, np.int64)  # length of the character that begins here
        for b, k in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            after[text >= b] = k
        best = np.full((n, wide + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, wide + 1), np.int64), np.full((n, wide + 1), -1, np.int64)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(wide):
            rows = np.flatnonzero((size > i) & lead[:, i])
            if not len(rows):
                continue
            single = np.zeros(n, bool)
            at, state = rows, np.zeros(len(rows), np.int64)
            for end in range(i + 1, min(wide, i + self.trie.longest) + 1):
                inside = size[at] >= end
                at, state = at[inside], state[inside]
                nxt = base[state] + text[at, end - 1]
                nxt[nxt >= len(check)] = 0
                ok = (check[nxt] == state) & (nxt > 0)
                at, state = at[ok], nxt[ok]
                if not len(at):
                    break
                hit = value[state] >= 0
                own, ids = at[hit], value[state[hit]]
                single[own[after[own, i] == end - i]] = True
                score = best[own, i] + self.scores[ids]
                better = score > best[own, end]
                own = own[better]
                best[own, end], came[own, end], piece[own, end] = score[better], i, ids[better]
            own = rows[~single[rows]]
            end = np.minimum(i + after[own, i], size[own])
            score = best[own, i] + self.unknown_score
            better = score > best[own, end]
            own, end = own[better], end[better]
            best[own, end], came[own, end], piece[own, end] = score[better], i, -1
        out = []
        came_l, piece_l = came.tolist(), piece.tolist()
        for r in range(n):
            ids, at, n_bytes = [], int(size[r]), 0
            while at:
                start = came_l[r][at]
                if piece_l[r][at] >= 0:
                    ids.append(piece_l[r][at])
                elif self.fallback:
                    ids += [int(self.byte_ids[b]) for b in reversed(data[r][start:at])]
                    n_bytes += at - start
                else:
                    ids.append(self.unknown)
                at = start
            out.append((np.array(ids[::-1], "<u4").tobytes(), n_bytes, float(best[r, size[r]])))
        return out

    def decode(self, ids: list[int]) -> str:
        output = self.output
        text = b"".join([output[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Encoder:
    """Encodes texts of a batch; remembers units."""

    def __init__(self, model: Unigram):
        self.model = model
        self.known: dict[str, tuple[bytes, int, float]] = {}

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, int, float]]:
        units = [self.model.units(t) for t in texts]
        fresh = list({u for own in units for u in own if u not in self.known})
        got = dict(zip(fresh, self.model.encode_units(fresh), strict=True))
        known = self.known
        for own in units:
            found = [known.get(u) or got[u] for u in own]
            yield b"".join([x[0] for x in found]), sum([x[1] for x in found]), sum([x[2] for x in found])
        for u, x in got.items():
            if len(known) >= REMEMBERED:
                break
            if len(u) < 64:
                known[u] = x


_encoders: dict[str, Encoder] = {}


def _run(path: str, model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _encoders:
            _encoders[path] = Encoder(model.value)
        encoder = _encoders[path]
        for frame in frames:
            texts, out = frame["text"].tolist(), []
            low = 0
            while low < len(texts):
                high, chars = low, 0
                while high < len(texts) and chars < 1 << 20:
                    chars += len(texts[high])
                    high += 1
                for text, (ids, n_bytes, score) in zip(texts[low:high], encoder.encode(texts[low:high]), strict=True):
                    decoded = encoder.model.decode(np.frombuffer(ids, "<u4").tolist())
                    out.append((len(ids) // 4, n_bytes, score, zlib.crc32(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text, ids))
                low = high
            got = pd.DataFrame(out, columns=["n_pieces", "n_byte_pieces", "score", "ids_crc32", "decoded_sha256", "exact", "ids"])
            got.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield got

    return run


def encode_documents(docs: DataFrame, vocabulary_folder: str | None = None) -> DataFrame:
    """Per document: doc_id, n_pieces, n_byte_pieces, score, ids_crc32, decoded_sha256, exact, ids.

    ``ids``: little-endian 32-bit ids of the best path; decoding them gives the text back (``exact``), but for a text
    that holds the marker character itself. Null text counts as empty (no ids); a null doc_id stays null; repeated
    rows are documents of their own; further columns are ignored. Map-only. ``vocabulary_folder``: where the
    vocabulary files are, by default those of ``public_tokenizers``.
    """
    import public_tokenizers

    path = f"{vocabulary_folder}/{VOCABULARY}" if vocabulary_folder else public_tokenizers.path(VOCABULARY)
    model = docs.sparkSession.sparkContext.broadcast(Unigram(Vocabulary.read(path)))  # as large as the vocabulary
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_pieces long, n_byte_pieces long, score double, ids_crc32 long, decoded_sha256 string, exact boolean, ids binary"
    return rows.mapInPandas(_run(path, model), schema).withColumn("doc_id", outer_id())
