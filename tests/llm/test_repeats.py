import hashlib
import re

import numpy as np

from contactry.llm import textscan
from contactry.llm.phrase_dedup import Automaton, dedup_phrases
from contactry.llm.suffix_dedup import dedup_substrings, suffix_arrays

from .docs import corpus, table


def brute_bytes(rows):
    out, seen = {}, set()
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        own = [data[i : i + 50] for i in range(len(data) - 49)]
        gone = np.zeros(len(data), bool)
        for i, x in enumerate(own):
            if x in seen:
                gone[i : i + 50] = True
        seen.update(own)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows):
    out, seen = {}, set()
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            x = tuple(words[i : i + 20])
            if x in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(x)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_suffix_arrays_equal_sorted_suffixes():
    rnd = np.random.default_rng(3)
    for _ in range(100):
        texts = [[*rnd.integers(1, 1 + rnd.integers(1, 4), rnd.integers(0, 60)).tolist(), 0] for _ in range(rnd.integers(1, 6))]
        bounds = np.append(0, np.cumsum([len(t) for t in texts]))
        got = suffix_arrays(np.array(sum(texts, [])), bounds)
        for i, t in enumerate(texts):
            assert (got[bounds[i] : bounds[i + 1]] - bounds[i]).tolist() == sorted(range(len(t)), key=lambda j: t[j:])


def test_runs_hold_each_window_once(monkeypatch):
    text = ("ab" * 100 + "the quick brown fox jumps over the lazy dog and runs away from here " * 3).encode() + bytes(range(1, 200))
    whole = textscan.runs(textscan.byte_units(text), 50, 20)
    monkeypatch.setattr(textscan, "_BLOCK", 64)
    blocks = textscan.runs(textscan.byte_units(text), 50, 20)
    for keys, first, count in (whole, blocks):
        assert count.max() <= textscan.RUN
        assert [w for f, n in zip(first, count, strict=True) for w in range(f, f + n)] == list(range(len(text) - 49))
    a = dict(w for k, f, n in zip(*whole, strict=True) for w in ((x, k) for x in range(f, f + n)))
    b = dict(w for k, f, n in zip(*blocks, strict=True) for w in ((x, k) for x in range(f, f + n)))
    assert a == b


def test_bytes(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        got = {r[0]: tuple(r)[1:] for r in dedup_substrings(table(spark, rows)).collect()}
        assert got == brute_bytes(rows)


def test_words(spark):
    for seed in (0, 1):
        rows = corpus(seed)
        got = {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()}
        assert got == brute_words(rows)


def test_a_hot_anchor_is_classed_in_pieces(spark):
    """A passage before 70 different continuations: more contents than PIECE under the passage's last anchors."""
    rows = corpus(5, 12)
    passage = " ".join(f"shared{i}" for i in range(40))
    rows += [(1000 + i, f"{i * 7919} {passage} {i * 104729} own {i} tail of text {i * 31} that goes on {i * 17} for a while") for i in range(70)]
    got = {r[0]: tuple(r)[1:] for r in dedup_substrings(table(spark, rows)).collect()}
    assert got == brute_bytes(rows)
    got = {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()}
    assert got == brute_words(rows)


def test_a_hotter_anchor_is_classed_on_any_task(spark, monkeypatch):
    monkeypatch.setattr("contactry.llm.repeats.HOT", 1)
    rows = corpus(2)
    assert {r[0]: tuple(r)[1:] for r in dedup_substrings(table(spark, rows)).collect()} == brute_bytes(rows)
    assert {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()} == brute_words(rows)


def test_words_in_many_small_shards(spark, monkeypatch):
    """Few phrases to a shard, phrases dealt by their words, and shards compiled on several tasks: the same rows."""
    for name, value in (("SHARD_PHRASES", 50), ("HOT_PHRASES", 2), ("STREAM_RUNS", 20)):
        monkeypatch.setattr(f"contactry.llm.phrase_dedup.{name}", value)
    for seed in (3, 4):
        rows = corpus(seed)
        assert {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()} == brute_words(rows)


def test_words_of_a_very_long_text(spark):
    """Beyond the block of the scans (65,536 units), with repeats inside the text and in another document."""
    words = [f"w{i}" for i in range(70_000)]
    rows = [(1, " ".join(words + words[65_500:65_600])), (2, " ".join(words[65_520:65_560])), (3, "x " * 70_000)]
    got = {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()}
    assert got == brute_words(rows)
    assert got[1][1] == 100 and got[2][1] == 40 and got[3][1] == 69_999


def test_every_removed_word_comes_from_an_automaton():
    passage, other = [f"a{i}".encode() for i in range(25)], [b"z%d" % i for i in range(20)]
    automaton = Automaton()
    automaton.add(b" ".join(passage), 0b111111, 3)
    assert automaton.places(b" ".join(passage), (3, 7)) == 0
    assert automaton.places(b" ".join(passage), (3, 7)) == 0b111111
    assert automaton.places(b" ".join(passage), (3, 8)) == 0
    assert automaton.places(b" ".join([b"own", *passage, *other]), (4, 9)) == 0b1111110
    assert Automaton().places(b" ".join(passage), (5, 1)) == 0


def test_empty_and_odd_rows(spark):
    assert dedup_substrings(table(spark, [])).count() == 0
    assert dedup_phrases(table(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (1, text), (1, text), (1, text + " more"), (None, None)]
    got = sorted((str(r.doc_id), r.n_removed) for r in dedup_substrings(table(spark, rows)).collect())
    n = len(text)
    assert got == [("1", n), ("1", n), ("1", n), ("None", 0), ("None", 0)]
    got = sorted((str(r.doc_id), r.n_removed) for r in dedup_phrases(table(spark, rows)).collect())
    assert got == [("1", 40), ("1", 40), ("1", 40), ("None", 0), ("None", 0)]


def test_equal_windows_never_share_a_run():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        units = rnd.integers(1, 1 + rnd.integers(1, 4), rnd.integers(20, 120)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keys, first, count = textscan.runs(units, 20, 8, by_place=True)
        assert [w for f, n in zip(first, count, strict=True) for w in range(f, f + n)] == list(range(len(units) - 19))
        for f, n in zip(first.tolist(), count.tolist(), strict=True):
            assert len({tuple(units[w : w + 20].tolist()) for w in range(f, f + n)}) == n


def short_periods():
    """Texts of every period from 1 to 33 words, each alone in its words, and texts that share such passages."""
    texts = []
    for period in range(1, 34):
        for length in (20, 21, 22, 20 + period, 41, 60):
            unit = [f"p{period}l{length}w{i}" for i in range(period)]
            texts.append(" ".join((unit * 60)[:length]))
    texts += ["- " * 30 + f"prose of {i} " * 3 + "= " * (20 + i) + "and = " * 15 for i in range(6)]
    return list(enumerate(texts))


def test_short_periods(spark):
    rows = short_periods()
    assert {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()} == brute_words(rows)
    assert {r[0]: tuple(r)[1:] for r in dedup_substrings(table(spark, rows)).collect()} == brute_bytes(rows)
    for text, gone in (("x " * 21, 20), ("a b " * 22, 42), ("x " * 20, 0)):
        alone = {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, [(1, text)])).collect()}
        assert alone == brute_words([(1, text)]) and alone[1][1] == gone


def test_few_words(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, " ".join(rnd.choice(list("abcd")[: rnd.integers(2, 5)], rnd.integers(15, 90)))) for i in range(200)]
    assert {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()} == brute_words(rows)
    assert {r[0]: tuple(r)[1:] for r in dedup_substrings(table(spark, rows)).collect()} == brute_bytes(rows)


def test_few_words_as_single_windows(spark, monkeypatch):
    for name, value in (("SHARD_PHRASES", 50), ("HOT_PHRASES", 2), ("STREAM_RUNS", 20)):
        monkeypatch.setattr(f"contactry.llm.phrase_dedup.{name}", value)
    rnd = np.random.default_rng(9)
    rows = [(i, " ".join(rnd.choice(list("abc"), rnd.integers(15, 90)))) for i in range(60)] + [(100 + i, t) for i, t in short_periods()[:30]]
    assert {r[0]: tuple(r)[1:] for r in dedup_phrases(table(spark, rows)).collect()} == brute_words(rows)


def test_whole_documents_table(spark):
    for sf in ("0.001", "0.01"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert {r[0]: tuple(r)[1:] for r in dedup_phrases(docs).collect()} == brute_words(rows)
        if sf == "0.001":
            assert {r[0]: tuple(r)[1:] for r in dedup_substrings(docs).collect()} == brute_bytes(rows)
