import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from contactry.llm import prefix_trie as trie
from contactry.llm import sharding
from contactry.llm.codes import Codebooks, compress
from contactry.llm.prefix_trie import prefix_trie
from contactry.llm.sharding import Bins, best_fit_decreasing, even_shards, shard_documents

from .docs import corpus, table


def naive_best_fit(sizes, capacity):
    left, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[i] and r > 0]
        if fits:
            _, b = min(fits)
        else:
            b = len(left)
            left.append(capacity)
        left[b] = max(0, left[b] - sizes[i])
        out[i] = b
    return out


def test_best_fit_takes_the_tightest_bin():
    rnd = random.Random(4)
    for _ in range(200):
        sizes = [rnd.randint(1, rnd.choice([5, 40, 130])) for _ in range(rnd.randint(0, 80))]
        assert best_fit_decreasing(np.array(sizes, np.int64), Bins(100)).tolist() == naive_best_fit(sizes, 100)


def test_even_shards():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(16, 3000, 4000)
    load = np.bincount(even_shards(sizes, 40), weights=sizes, minlength=40)
    assert len(load) == 40 and load.max() <= 1.001 * load.mean() and load.min() >= 0.98 * load.mean()
    big = np.append(sizes, [sizes.sum(), 5])
    found = even_shards(big, 40)
    assert (found == found[4000]).sum() == 1 and found.max() == 39
    load = np.bincount(found[found != found[4000]], weights=big[found != found[4000]])
    assert load[load > 0].max() <= 1.01 * load[load > 0].mean()
    assert even_shards(np.array([7, 7]), 40).tolist() == [0, 1] and even_shards(np.array([], np.int64), 40).tolist() == []


def held_to_contract(rows, got, shards=40):
    """Everything the rows must satisfy, given the texts by doc_id."""
    by_id = defaultdict(list)
    for doc_id, text in rows:
        by_id[doc_id].append((len((text or "").encode()) + 16, zlib.crc32((text or "").encode())))
    assert len(got) == len(rows)
    where, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    texts = {d: t or "" for d, t in rows}
    for r in got:
        assert (r.size, r.text_crc32) in by_id[r.doc_id] and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        if len(by_id[r.doc_id]) == 1:
            where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads


def test_shards(spark):
    for seed, n in ((0, 60), (3, 400)):
        rows = corpus(seed, n) + [(10_000 + i, "the same text") for i in range(300)]
        loads = held_to_contract(rows, shard_documents(table(spark, rows)).collect())
        assert len(loads) == 40
    copies = [(i, "x" * 500) for i in range(100)] + [(1000 + i, f"own {i} " * 20) for i in range(200)]
    loads = sorted(held_to_contract(copies, shard_documents(table(spark, copies)).collect()).values())
    assert loads[-1] == 100 * 516 and loads[-2] <= 1.3 * loads[0]  # the copies alone; 200 texts in 39 shards


def test_many_bundles_and_given_capacity(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUNDLES_PER_SHARD", 4)
    rows = [(i, f"text {i} " * (i % 37 + 1)) for i in range(3000)]
    loads = held_to_contract(rows, shard_documents(table(spark, rows), shards=5).collect(), 5)
    assert max(loads.values()) <= 1.05 * min(loads.values())
    total = sum(loads.values())
    loads = held_to_contract(rows, shard_documents(table(spark, rows), capacity=10_000).collect(), 10**6)
    assert max(loads.values()) <= 10_000 and len(loads) <= math.ceil(total / 10_000) * 1.1 + 1


def test_odd_rows_in_shards(spark):
    assert shard_documents(table(spark, [])).count() == 0
    rows = [(None, "a"), (1, "a"), (1, "a"), (2, None), (3, ""), (4, "é" * 100_000)]
    got = shard_documents(table(spark, rows)).collect()
    assert len(got) == 6 and sorted(r.size for r in got) == [16, 16, 17, 17, 17, 200_016]
    assert len({r.shard for r in got if r.size == 17}) == 1 and len({r.shard for r in got if r.size == 16}) == 1
    assert sum(r.doc_id is None for r in got) == 1


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("parts", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("label_key", T.IntegerType()),
    ]
)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 0) for i, v, label in rows], VECTORS)


def brute_codes(rows, rounds=4, entries=256):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // 4
    first = sorted(kept, key=lambda r: r[0])[:entries]
    books = np.array([[r[1][j * w : j * w + w] for r in first] for j in range(4)])
    parts = np.array([[r[1][j * w : j * w + w] for r in kept] for j in range(4)])

    def assign():
        d = [((parts[j][:, None] - books[j][None]) ** 2).sum(2) for j in range(4)]
        return [x.argmin(1) for x in d], sum(x.min(1) for x in d)

    for _ in range(rounds):
        code, _ = assign()
        for j in range(4):
            for e in set(code[j].tolist()):
                own = parts[j][code[j] == e]
                books[j][e] = own.sum(0) // len(own)
    code, error = assign()
    labels = defaultdict(int)
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        labels[label] += e
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted((r[0], "".join(f"{code[j][n]:02x}" for j in range(4)), int(error[n]), labels[r[2]], sha) for n, r in enumerate(kept))


def test_codes_equal_brute_force(spark):
    rnd = np.random.default_rng(6)
    clustered = [(int(i) * 7, (rnd.normal(size=16) * 0.02 + (i % 9)).tolist(), int(i % 3) if i % 5 else None) for i in rnd.permutation(700)]
    spread = [(i, rnd.normal(size=8).tolist(), i % 2) for i in range(400)]
    copies = [(i, [0.25, -0.5, 1.0, -1.0] if i % 3 else rnd.normal(size=4).tolist(), None) for i in range(300)]
    few = [(i, rnd.normal(size=4).tolist(), 1) for i in range(9)]
    for rows in (clustered, spread, copies, few):
        bad = [(90_000, None, 1), (90_001, [None] + rows[0][1][1:], 1), (90_002, [float("nan")] + rows[0][1][1:], 1), (90_003, [float("inf")] + rows[0][1][1:], 2)]
        assert sorted(tuple(r) for r in compress(vector_table(spark, rows + bad)).collect()) == brute_codes(rows + bad)


def test_pivots_leave_few_entries_to_evaluate():
    rnd = np.random.default_rng(2)
    parts = (rnd.normal(size=(3000, 4, 8)) * 20 + rnd.integers(0, 40, (3000, 4, 1)) * 300).astype(np.int64)
    books = Codebooks.start(parts[:256])
    code, error, evaluated = books.assign(parts, books.to_pivots(parts))
    for j in range(4):
        d = ((parts[:, j, None] - books.entries[j][None]) ** 2).sum(2)
        assert (code[:, j] == d.argmin(1)).all() and (error[:, j] == d.min(1)).all()
    assert evaluated < 0.2 * 3000 * 4 * 256


def test_odd_vectors_in_codes(spark):
    assert compress(vector_table(spark, [])).count() == 0
    rows = [(None, [1.0] * 4, 1), (5, [1.0] * 4, None), (5, [1.0] * 4, None), (6, [1.0] * 3, 1), (7, [1e30] * 4, 2), (8, [], 2)]
    got = sorted((str(r.vec_id), r.code, r.error) for r in compress(vector_table(spark, rows)).collect())
    assert [g[0] for g in got] == ["5", "5", "7", "None"] and all(g[2] == 0 for g in got)
    got = compress(vector_table(spark, [(1, [0.5, 0.5, 0.5, 0.5, 0.5], 1), (2, [1.5] * 5, 1)])).collect()
    assert sorted((r.vec_id, r.code) for r in got) == [(1, "00000000"), (2, "01010100")]  # the last part is all filling


TURNS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("depth", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("at", T.StringType()),
    ]
)


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, "d", None, "") for r in rows], TURNS)


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in members:
        if x:
            kids[x[:-1]] += 1
    for x, m in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in kids
            saved[x[:d]] += (len(m) - 1) * len(x[-1][1]) if x else 0
    out = []
    for x, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == x)
        parent = min(members[x[:-1]]) if x else None
        out.append((min(m), len(x), parent, len(m), kids[x], leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_conversations(seed, n=120, longest=12):
    rnd = random.Random(seed)
    texts = ["", None, "yes", "no", "tell me more", "é" * 5, "a:b", "1:a"]
    rows = []
    for c in rnd.sample(range(450), n):
        for t in rnd.sample(range(100), rnd.randint(1, longest)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(texts)))
    return rows


@pytest.mark.parametrize("component", [1, 3, 40, 100_000])
def test_trie_equals_brute_force(spark, component):
    rows = some_conversations(component)
    rows += [(9000, t, "user", "long" if t % 2 else f"t{t}") for t in range(60)] + [(9001, t, "user", "long" if t % 2 else f"t{t}") for t in range(55)]
    rows += [(10_000 + i, 0, "user", "the same") for i in range(30)] + [(5, None, "system", "first"), (None, 1, "user", "lost")]
    assert sorted((tuple(r) for r in prefix_trie(turn_table(spark, rows), component).collect()), key=str) == brute_trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = some_conversations(7, 40, 80)
    rows += [(c, t, "user", "again") for c in (700, 701, 702) for t in range(150 + c % 3)]
    assert sorted((tuple(r) for r in prefix_trie(turn_table(spark, rows), 20).collect()), key=str) == brute_trie(rows)


def test_odd_conversations(spark):
    assert prefix_trie(turn_table(spark, [])).count() == 0
    assert prefix_trie(turn_table(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(7, 1, "user", "only")]  # turnless where its head comes from a conversation that is not there
    got = sorted((tuple(r) for r in prefix_trie(turn_table(spark, rows)).collect()), key=str)
    assert got == brute_trie(rows)
    rows = [(3, 1, "user", "twice"), (3, 1, "user", "twice"), (0, 1, "user", "twice")]
    assert sorted((tuple(r) for r in prefix_trie(turn_table(spark, rows)).collect()), key=str) == brute_trie(rows)


def test_roll_up_equals_sums_over_subtrees():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 60)
        parent = [-1] + [rnd.randint(max(0, i - rnd.choice([1, 3, 60])), i - 1) for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        order = sorted(range(n), key=lambda i: depth[i])
        place = {v: i for i, v in enumerate(order)}
        parent = [place[parent[v]] if parent[v] >= 0 else -1 for v in order]
        values = [(rnd.randint(0, 5), rnd.randint(0, 9)) for _ in range(n)]
        want = [list(v) for v in values]
        for v in range(n - 1, 0, -1):
            want[parent[v]] = [a + b for a, b in zip(want[parent[v]], want[v], strict=True)]
        assert trie.roll_up(parent, values) == want
