"""Suffix-array dedup: remove bytes under a 50-byte string that also starts in a smaller document.

Suffixes are sorted by linear grouping: first groups of suffixes by Lyndon prefix, made in descending order with
previous-smaller pointers, then each group's order emitted in ascending order, without recursive renaming. Many
small texts are sorted at once: every step handles the current group (or rank) of each of them in one array
operation, which keeps the per-byte work in numpy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import textscan
from .common import outer_id
from .repeats import Kind, marked, notes_by_document, repeated_windows

WINDOW = 50
BYTES = Kind(WINDOW, 20, lambda text: (text, textscan.byte_units(text), None, None))


def lyndon_groups(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 for many texts side by side: each suffix's group (first rank of it) and its previous smaller suffix.

    Per text, groups are taken in descending order. A suffix that j of the group's members point at is moved
    behind the rest of its own group, further back the larger j is: the new groups share a longer Lyndon prefix.
    """
    n = len(text)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((text, owner))
    fresh = np.ones(n, bool)
    fresh[1:] = (text[order][1:] != text[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    group, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = np.arange(n)
    begins = np.flatnonzero(fresh)
    begin_of, end_of = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    begin_of[np.append(begins[1:], n)] = begins
    end_of[begins] = np.append(begins[1:], n)
    unknown = -2
    prev = np.full(n, unknown, np.int64)
    taken = np.zeros(n, bool)
    base = bounds[:-1][owner]
    bottom, top = bounds[:-1], bounds[1:].copy()
    live = np.flatnonzero(top > bottom)
    while len(live):
        low = begin_of[top[live]]
        size = top[live] - low
        members = order[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        top[live] = low
        live = live[low > bottom[live]]
        # walk left over suffixes of higher or equal groups, along the pointers that are known
        j, first, mine = members - 1, base[members], group[members]
        todo = np.flatnonzero(j >= first)
        while len(todo := todo[group[j[todo]] >= mine[todo]]):
            known = prev[j[todo]]
            j[todo] = np.where(known == unknown, j[todo] - 1, known)
            todo = todo[j[todo] >= first[todo]]
        j = np.where(j < first, -1, j)
        prev[members] = j
        target, hits = np.unique(j[j >= 0], return_counts=True)
        if not len(target):
            continue
        by = np.lexsort((hits, group[target]))
        target, hits, old = target[by], hits[by], group[target][by]
        cut = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        moved = np.diff(np.append(cut, len(old)))
        stop = end_of[old[cut]]
        rest = stop - moved
        tail = np.repeat(rest - cut, moved) + np.arange(len(target))
        there = order[tail]
        taken[target] = True
        displaced = there[~taken[there]]
        taken[target] = False
        holes = np.sort(rank[target][rank[target] < np.repeat(rest, moved)])
        displaced = displaced[np.argsort(group[displaced], kind="stable")]
        order[holes], rank[displaced] = displaced, holes
        order[tail], rank[target] = target, tail
        head = np.concatenate(([True], (old[1:] != old[:-1]) | (hits[1:] != hits[:-1])))
        heads = tail[head]
        group[target] = tail[np.maximum.accumulate(np.where(head, np.arange(len(tail)), 0))]
        ends = np.append(heads[1:], 0)
        ends[np.append(old[head][1:] != old[head][:-1], True)] = stop
        begin_of[ends], end_of[heads] = heads, ends
        some = rest > old[cut]
        begin_of[rest[some]], end_of[old[cut][some]] = old[cut][some], rest[some]
    return group, prev


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Suffix arrays of many texts side by side.

    ``text``: all symbols, each text ending in a symbol that is smaller than all others in it and occurs once;
    ``bounds``: offsets of the texts, with the end. The suffixes of text i, in ascending order, stand in
    [bounds[i], bounds[i + 1]).
    """
    group, prev = lyndon_groups(text, bounds)
    out = np.full(len(text), -1, np.int64)
    placed = np.zeros(len(text), bool)
    front = np.arange(len(text))
    by_size = np.argsort(-np.diff(bounds), kind="stable")
    begin, size = bounds[:-1][by_size], np.diff(bounds)[by_size]
    begin, size = begin[size > 0], size[size > 0]
    if not len(size):
        return out
    out[begin] = begin + size - 1
    placed[begin + size - 1] = True
    for step in range(int(size[0])):
        some = begin[: np.searchsorted(-size, -step, "left")]
        j = out[some + step] - 1
        j = j[j >= some]
        while len(j := j[~placed[j]]):
            at = front[group[j]]
            out[at], placed[j] = j, True
            front[group[j]] = at + 1
            j = prev[j]
            j = j[j >= 0]
    return out


def window_classes(contents: list[list[bytes]], ids: list[np.ndarray], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of every content with the smallest id of a content of its group that has the same window.

    One suffix array per group of contents: suffixes with the same first ``window`` bytes are neighbours in it.
    """
    flat = [x for group in contents for x in group]
    sizes = np.array([len(x) + 1 for x in flat], np.int64)
    first = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(flat) + b"\0", np.uint8).astype(np.int16) + 2
    per_group = np.array([len(g) for g in contents], np.int64)
    bounds = np.append(0, np.cumsum(np.add.reduceat(sizes, np.cumsum(per_group) - per_group)))
    text[first + sizes - 1] = 1  # between contents
    text[bounds[1:] - 1] = 0
    order = suffix_arrays(text, bounds)
    content = np.repeat(np.arange(len(flat)), sizes)
    offset = np.arange(len(text)) - first[content]
    order = order[offset[order] + window < sizes[content[order]]]
    doc = np.concatenate(ids)[content[order]]
    same = np.ones(max(len(order) - 1, 0), bool)
    group_of = np.repeat(np.arange(len(contents)), per_group)[content[order]]
    same &= group_of[1:] == group_of[:-1]
    step = 1 << 16
    for b in range(0, len(same), step):
        at = np.flatnonzero(same[b : b + step]) + b
        for k in range(0, window, 10):
            span = np.arange(k, min(k + 10, window))
            at = at[(text[order[at][:, None] + span] == text[order[at + 1][:, None] + span]).all(1)] if len(at) else at
        keep = np.zeros(len(same[b : b + step]), bool)
        keep[at - b] = True
        same[b : b + step] = keep
    head = np.flatnonzero(np.concatenate(([True], ~same)))[: len(order)]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = np.minimum.reduceat(doc, head)
    least = np.repeat(least, np.diff(np.append(head, len(order))))
    return content[order], offset[order], least


def _apply(docs: pd.DataFrame, notes: pd.DataFrame) -> pd.DataFrame:
    told = notes_by_document(notes)
    out = []
    for doc_id, ident, text in zip(docs["doc_id"], docs["ident"], docs["text"], strict=True):
        if (doc_id, ident) not in told or len(text) < WINDOW:
            out.append((doc_id, len(text), 0, 0, hashlib.sha256(text).hexdigest(), text))
            continue
        part = told[doc_id, ident]
        if part is None:  # a copy of a smaller document
            out.append((doc_id, len(text), len(text), 1, hashlib.sha256(b"").hexdigest(), b""))
            continue
        gone = marked(len(text), WINDOW, part)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_substrings(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; strings are judged
    on the input. Null text counts as empty. A null doc_id counts as smaller than all others and is returned as
    null. Rows with the same doc_id are documents of their own that don't remove each other's bytes. Texts under
    50 bytes stay whole. An empty table gives no rows; further columns are ignored.
    """
    keyed, notes = repeated_windows(docs, BYTES, window_classes)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    out = keyed.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInPandas(lambda d, m: _apply(d, m)[columns], schema)
    return out.withColumn("doc_id", outer_id())
