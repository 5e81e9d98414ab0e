import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from contactry.llm import ann, exact_dedup, language_id, license_scan, minhash, packing, pii, unigram

from .docs import corpus, table


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 1 exact dedup


def test_perfect_hash_is_minimal_and_survives_its_bytes():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 4)).astype(np.uint64)
    hashed = exact_dedup.PerfectHash.load(exact_dedup.PerfectHash.build(keys).dump())
    assert sorted(hashed.slots(keys)) == list(range(5000))
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


def test_exact_dedup(spark):
    rows = corpus(3) + [(None, "twice"), (5000, "twice"), (7000, "same row"), (7000, "same row"), (None, "only")]
    got = rows_of(exact_dedup.exact_dedup(table(spark, rows)))
    assert len(got) == len(rows)
    ids, kept = defaultdict(list), Counter()
    for i, t in rows:
        ids[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    for r in got:
        own = ids[r["text_sha256"]]
        assert r["group_size"] == len(own)
        assert r["keep_id"] == max((i for i in own if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0


# 3 packing


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(2)
    sizes = np.array([rnd.randint(1, 1024) for _ in range(800)])
    window, offset, n = packing.best_fit_decreasing(sizes)
    open_, expected = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        fit = min((w for w in range(len(open_)) if open_[w] >= sizes[i]), key=lambda w: open_[w], default=None)
        if fit is None:
            open_.append(1024)
            fit = len(open_) - 1
        expected[i] = open_[fit]
        open_[fit] -= sizes[i]
    assert n == len(open_)
    assert all(1024 - offset[i] == expected[i] for i in range(len(sizes)))
    assert len(window) == 800


def test_ids_equal_the_tokenizer_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rnd = random.Random(4)
    odd = ["", " ", "  ", " a", "a ", "a  b", "it's  we'll", "x\n\ny z", " a 　b", "\x1c a", "<|endoftext|> x", "日本 語 1234 é́", "a\tb c\r\nd e", "…!? .. 12,3"]
    odd += ["".join(rnd.choice(" ab'1é\n. 語") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    for text in odd + [t or "" for _, t in corpus(1)]:
        assert np.frombuffer(ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_packed_ids_equal_the_tokenizer_file_under_its_defaults(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(7)
    parts = ["<|endoftext|>", "<|endoftext|", "word", " ", "  ", "é", "\n", "'s", "12"]
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y  ", "<<|endoftext|>>"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30))) for _ in range(300)] + ["tail <|endoftext|> words " * 900]
    got = defaultdict(dict)
    for r in packing.pack(table(spark, list(enumerate(texts)))).collect():
        got[r.doc_id][r.start] = (r.length, r.ids_crc32, r.doc_tokens)
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = {s: ids[s : s + 1024] for s in range(0, len(ids), 1024)}
        assert got[i] == {s: (len(p), zlib.crc32(p.tobytes()), len(ids)) for s, p in pieces.items()}, repr(text)


def test_packing(spark):
    rows = corpus(2) + [(9000, "long text of words " * 3000), (9001, "x" * 200_000), (None, "no id"), (1, "again"), (1, "again"), (7, "a <|endoftext|> b")]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    got = rows_of(packing.pack(table(spark, rows)))
    crc = Counter()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        crc[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    expected = Counter()
    for i, t in rows:
        data = ids(t or "") + b"\0\0\0\0"
        n = len(data) // 4
        for s in range(0, n, 1024):
            part = data[4 * s : 4 * min(s + 1024, n)]
            expected[(i, s, len(part) // 4, zlib.crc32(part), n)] += 1
    assert crc == expected
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(table(spark, [])).count() == 0


# 5 near duplicates


def brute_classes(rows):
    sets = [minhash.shingles((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and minhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    classes = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        classes[root(i)].append(doc_id)
    return sorted(sorted(c) for c in classes.values())


def test_probability_jaccard_is_jaccard_for_equal_weights_and_matches_its_definition():
    u = {1: 1, 2: 1, 3: 1}
    v = {2: 1, 3: 1, 4: 1, 5: 1}
    as_set = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    assert minhash.probability_jaccard(as_set(u), as_set(v)) == pytest.approx(2 / 5)
    rnd = random.Random(0)
    for _ in range(50):
        u, v = ({k: rnd.randint(1, 4) for k in rnd.sample(range(12), 7)} for _ in range(2))
        exact = sum(1 / sum(max(u.get(j, 0) / u[i], v.get(j, 0) / v[i]) for j in u.keys() | v.keys()) for i in u.keys() & v.keys())
        assert minhash.probability_jaccard(as_set(u), as_set(v)) == pytest.approx(exact)


def test_registers_agree_as_often_as_documents_are_similar():
    rnd = np.random.default_rng(1)
    agree, exact = [], []
    for _ in range(60):
        a = np.unique(rnd.integers(0, 400, 200)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.8], rnd.integers(400, 440, 20).astype(np.uint64)]))
        sets = [(minhash.mix(x), rnd.integers(1, 3, len(x))) for x in (a, b)]
        s = minhash.signatures(sets)
        agree.append((s[0] == s[1]).mean())
        exact.append(minhash.probability_jaccard(*sets))
    assert np.mean(agree) == pytest.approx(np.mean(exact), abs=0.02)


def test_near_duplicates(spark):
    rnd = random.Random(8)
    rows = corpus(4, 40)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    for i in range(30):  # a group whose members differ from each other more than from the base
        own = list(base)
        for at in rnd.sample(range(120), 3):
            own[at] = f"x{i}"
        rows.append((2000 + i, " ".join(own)))
    rows += [(3000, "one two"), (3001, "one two"), (3002, "one")]
    got = rows_of(minhash.near_duplicates(table(spark, rows)))
    classes = defaultdict(list)
    for r in got:
        classes[r["class_id"]].append(r["doc_id"])
        assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert all(min(v) == k for k, v in classes.items())
    assert all(r["class_size"] == len(classes[r["class_id"]]) for r in got)
    assert sorted(sorted(c) for c in classes.values()) == brute_classes(rows)


@pytest.mark.parametrize("turns", [0, 2])
def test_near_duplicates_with_many_members_apart(spark, monkeypatch, turns):
    """Members with few to many edits, repeated and cut passages: the last comparison loses no link."""
    monkeypatch.setattr(minhash, "TURNS", turns)
    rnd = random.Random(turns)
    base = [f"w{rnd.randrange(400)}" for _ in range(110)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in rnd.sample(range(len(own)), rnd.randint(0, 9)):
            own[at] = f"x{rnd.randrange(6)}"
        if i % 4 == 0:
            own = own[: rnd.randint(80, 110)]
        if i % 5 == 0:
            own += own[-rnd.randint(5, 30) :] * rnd.randint(1, 3)
        rows.append((i, " ".join(own)))
    got = defaultdict(list)
    for r in rows_of(minhash.near_duplicates(table(spark, rows))):
        got[r["class_id"]].append(r["doc_id"])
    assert len(got) > 5
    assert sorted(sorted(c) for c in got.values()) == brute_classes(rows)


def test_near_duplicates_of_a_large_group_of_which_most_are_below_the_threshold(spark, monkeypatch):
    """2,000 edited copies: no link is lost, and few pairs are compared."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(2000):
        own = list(base)
        for n, at in enumerate(rnd.sample(range(len(own)), rnd.randint(1, 7))):
            own[at] = f"x{i}a{n}" if rnd.random() < 0.9 else f"y{rnd.randrange(20)}"
        if i % 10 == 0:
            del own[rnd.randrange(100) : rnd.randrange(100, 150)]
        rows.append((i, " ".join(own)))
    sets = [minhash.shingles(t.encode()) for _, t in rows]
    assert all((c == 1).all() for _, c in sets)
    names = {k: n for n, k in enumerate(np.unique(np.concatenate([k for k, _ in sets])).tolist())}
    x = np.zeros((2000, len(names)), np.float32)
    for i, (k, _) in enumerate(sets):
        x[i, [names[v] for v in k.tolist()]] = 1
    both = x @ x.T
    similar = both / (x.sum(1)[:, None] + x.sum(1)[None] - both) >= 0.8
    label = np.arange(2000)
    while (label != (new := np.where(similar, label[None], 2000).min(1))).any():
        label = new

    compared = []

    def counted(*args, was=minhash._left_open):
        pairs = was(*args)
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_left_open", counted)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert [got[i] for i in range(2000)] == label.tolist()
    assert len(set(label.tolist())) > 500
    assert compared[0] < 20_000


def test_near_duplicates_of_rows_without_ids_stay_linear(spark):
    rows = [(None, f"one two three four five six {i // 2} eight") for i in range(400)]
    got = rows_of(minhash.near_duplicates(table(spark, rows)))
    assert len(got) == 400


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    got = rows_of(minhash.near_duplicates(table(spark, [(1, None), (2, ""), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")])))
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in got) == [("1", "1", 1), ("2", "2", 1), ("4", "None", 3), ("4", "None", 3), ("None", "None", 3)]


# 6 licenses


def brute_base(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. ALL RIGHTS\nreserved", "cc  by cc by", "KKby ccé by", None]
    rows = [(i, f"{(t or '')[:40]} {line or ''}" if i % 3 else line) for i, ((_, t), line) in enumerate(zip(corpus(1), lines * 20, strict=False))]
    for r in rows_of(license_scan.scan_licenses(table(spark, [*rows, (None, "Released under the MIT License.")]))):
        text = dict(rows).get(r["doc_id"]) if r["doc_id"] is not None else "Released under the MIT License."
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan.scan_licenses(table(spark, [])).count() == 0


def accepting(template):
    """The template as a regular expression over words joined by spaces."""
    out = []
    for token in re.findall(r"\[\[|\]\]|\(\(|\)\)|\||<<\d+>>|[^\s\[\]()<>|]+", template):
        if token in ("[[", "(("):
            out.append("(?:(?:")
        elif token in ("]]", "))"):
            out.append("))" + ("?" if token == "]]" else ""))
        elif token == "|":
            out.append("|")
        elif token.startswith("<<"):
            out.append(f"(?: [^ ]+){{1,{token[2:-2]}}}")
        else:
            out += [" " + re.escape(w.decode()) for w in license_scan.words_of(token.encode())]
    return re.compile("(?= )" + "".join(out) + "(?= |$)")


def instance(template, rnd):
    """Words that the template accepts, by random choices."""
    tokens = re.findall(r"\[\[|\]\]|\(\(|\)\)|\||<<\d+>>|[^\s\[\]()<>|]+", template)

    def read(at):
        branches, now = [], []
        while at < len(tokens) and tokens[at] not in ("]]", "))"):
            if tokens[at] in ("[[", "(("):
                inner, end = read(at + 1)
                now += inner if tokens[at] == "((" or rnd.random() < 0.5 else []
                at = end
            elif tokens[at] == "|":
                branches.append(now)
                now = []
            elif tokens[at].startswith("<<"):
                now += [rnd.choice(["some", "body", "x1"]) for _ in range(rnd.randint(1, int(tokens[at][2:-2])))]
            else:
                now += [w.decode() for w in license_scan.words_of(tokens[at].encode())]
            at += 1
        return rnd.choice([*branches, now]), at

    return read(0)[0]


@pytest.mark.parametrize("n", range(len(license_scan.TEMPLATES)))
def test_template_accepts_what_its_expression_accepts(n):
    """Instances are accepted; each word of the mandatory wording that changes or goes is noticed, as by the expression."""
    label, template, _ = license_scan.TEMPLATES[n]
    automaton, expression, rnd = license_scan.TokenAutomaton(template), accepting(template), random.Random(n)
    found = lambda words: automaton.found_in([w.encode() for w in words])
    refused = 0
    for _ in range(60):
        words = ["before", "it", *instance(template, rnd), "after"]
        assert found(words)
        for _ in range(4):
            other = list(words)
            at = rnd.randrange(2, len(words) - 1)
            kind = rnd.random()
            other[at : at + 1] = [] if kind < 0.4 else ["changed"] if kind < 0.8 else [other[at], "added"]
            wanted = expression.search(" " + " ".join(other)) is not None
            assert found(other) == wanted, (label, other)
            refused += not wanted
    assert refused > 50


def test_denied_notices_and_scores(spark):
    rows = [(1, "we are not under the MIT license at all"), (2, "it is not licensed under the MIT license"), (3, "Licensed under the MIT License."), (4, "plain")]
    rows.append((5, "x " * 70_000 + " ".join(instance(license_scan.TEMPLATES[0][1], random.Random(1))) + " y" * 70_000))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(table(spark, rows)).collect()}
    assert got == {1: ("", 0.0), 2: ("", 0.0), 3: ("mit-notice", 0.8), 4: ("", 0.0), 5: ("mit", 1.0)}


# 7 language


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9):
        code = language_id.codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n < 3 else 2)


def test_language_identification(spark):
    alphabets = {"aa": "abcde ", "bb": "fghij ", "cc": "klmnoé "}
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(alphabets[lang]) for _ in range(200)), lang) for i in range(150) for lang in [rnd.choice(list(alphabets))]]
    rows += [(900, None, "aa"), (901, "12 34 --", "bb"), (902, "", None), (None, "fghij gihjf fighj", None), (903, "abc dea", None)]
    got = rows_of(language_id.identify(table(spark, rows)))
    wanted = {r[0]: r[2] for r in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und"
    tried = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900]
    assert np.mean([r["lang_pred"] == wanted[r["doc_id"]] for r in tried]) > 0.98
    assert {r["lang_pred"] for r in rows_of(language_id.identify(table(spark, [(1, "some text", None)])))} == {"und"}
    assert language_id.identify(table(spark, [])).count() == 0


def test_decoding_takes_the_codeword_of_least_weighted_loss():
    rnd = np.random.default_rng(0)
    names = list("abcdefg")
    x = rnd.normal(size=(70, language_id.BUCKETS))
    model = language_id.CodeModel.fit(x, [names[i % 7] for i in range(70)], rounds=5)
    tried = rnd.normal(size=(40, language_id.BUCKETS))
    best, score, lead = model.predict(tried)
    for i, row in enumerate(tried):
        margin = [sum(row[f] * model.weights[f, b] for f in range(len(row))) + model.bias[b] for b in range(model.code.shape[1])]
        loss = [sum(model.trust[b] * math.log1p(math.exp(-margin[b] * word[b])) for b in range(len(word))) for word in model.code]
        like = [math.exp(-model.code.shape[1] * (v - min(loss))) for v in loss]
        ranked = sorted((v / sum(like) for v in like), reverse=True)
        assert best[i] == loss.index(min(loss))
        assert score[i] == pytest.approx(ranked[0]) and lead[i] == pytest.approx(ranked[0] - ranked[1])


def test_sample_of_repeated_ids_keeps_every_language(spark):
    rows = [(1, f"same id {i % 7}", "aa") for i in range(5000)] + [(i, f"zz text {i}", "zz") for i in range(2, 300)] + [(None, "no id", "nn")]
    _, languages = language_id.training_sample(table(spark, rows), 50)
    assert Counter(languages) == {"aa": 1, "zz": 50, "nn": 1}
    _, languages = language_id.training_sample(table(spark, [(i, "t", f"l{i % 40}") for i in range(4000)]), 400, 80)
    assert Counter(languages) == {f"l{i}": 2 for i in range(40)}


def test_held_out_accuracy_on_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98


# 8 unigram


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return unigram.Unigram(unigram.Vocabulary.read(public_tokenizers.path(unigram.VOCABULARY)))


def brute_viterbi(model, vocabulary, text):
    best = [(0.0, [])] + [None] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + 20) + 1):
            k = vocabulary.get(text[i:j])
            if k is None and not (j == i + 1 and not single):
                continue
            single |= j == i + 1
            score = best[i][0] + (model.scores[k] if k is not None else model.unknown_score)
            if best[j] is None or score > best[j][0]:
                best[j] = score, best[i][1] + ([k] if k is not None else [int(model.byte_ids[b]) for b in text[i:j].encode()])
    return best[-1]


def test_best_paths(model):
    import public_tokenizers

    v = unigram.Vocabulary.read(public_tokenizers.path(unigram.VOCABULARY))
    names = {p: i for i, (p, t) in enumerate(zip(v.pieces, v.types, strict=True)) if t == 1}
    texts = ["", " ", "hello world", "  two  spaces ", "日本語 text", "\U0001f9ff x", "naïve café\n\ttab", "a▁b"] + [(t or "")[:300] for _, t in corpus(1)]
    encoder = unigram.Encoder(model)
    for text, (ids, _, score) in zip(texts, encoder.encode(texts), strict=True):
        marked = ("▁" + text if text else "").replace(" ", "▁")
        wanted = brute_viterbi(model, names, marked)
        assert np.frombuffer(ids, "<u4").tolist() == wanted[1]
        assert score == pytest.approx(wanted[0])
        assert "▁" in text or model.decode(wanted[1]) == text


def test_unigram_query(spark, model):
    rows = [*corpus(1), (None, "x"), (1, "x"), (1, "x")]
    got = rows_of(unigram.encode_documents(table(spark, rows)))
    assert len(got) == len(rows) and all(r["exact"] for r in got)
    assert unigram.encode_documents(table(spark, [])).count() == 0


# 9 nearest neighbours


def test_search(spark):
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 16))
    x = (centres[rnd.integers(0, 20, 3000)] + 0.4 * rnd.normal(size=(3000, 16))).astype("f4")
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(20_000, None, 1), (20_020, [0.0] * 16, 1), (20_040, [float("nan")] * 16, 1), (20_060, [1.0] * 15 + [None], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    got = defaultdict(list)
    for r in ann.search(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        scores = x.astype(float) @ x[q].astype(float)
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        for _, v, s in found:
            assert v != q and s == pytest.approx(scores[v], abs=1e-12)
        order = [i for i in np.lexsort((np.arange(3000), -np.round(scores, 12))) if i != q][:20]
        hits += len({v for _, v, _ in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.5, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in ann.search(few).collect()) == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.where("vec_id < 0")).count() == 0


def test_search_fills_the_list_of_isolated_vectors(spark):
    x = np.zeros((4000, 8))
    x[:, 0] = 10.0  # copies, whose neighbours are all in one leaf
    for i in range(1, 4):
        x[1000 * i] = 0.0
        x[1000 * i, i] = -1.0 - i  # queries, each in a leaf of its own
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert sorted(got) == list(range(0, 4000, 20))
    for q, found in got.items():
        assert [r for r, _ in sorted(found)] == list(range(1, 21)), q
        assert len({v for _, v in found} - {q}) == 20


def test_search_with_unequal_lengths_and_repeated_ids(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 41)] + [(41, [1.0, 2.0, 3.0]), (42, [1.0]), (20, [0.5, 0.5]), (20, [0.25, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.search(df).collect())
    assert {r[0] for r in got} == {20, 40} and all(len([r for r in got if r[0] == q]) == 20 for q in (20, 40))
    assert not {r[2] for r in got} & {41, 42}
    assert got[0] == (20, 1, 40, 0.25 * 40 + 9.0)


def test_search_in_cells_and_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rnd.normal(size=(1, 8)), 900, 0), rnd.normal(size=(1500, 8))])[rnd.permutation(2400)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    one = sorted(tuple(r) for r in ann.search(df, every=4).collect())
    monkeypatch.setattr(ann, "ROWS_PER_CELL", 100)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 50)
    assert sorted(tuple(r) for r in ann.search(df, every=4).collect()) == one
    assert len(one) == 600 * 20

    rows_of, asked = np.array([30, 60, 5, 250, 0, 10]), np.array([10, 20, 25, 120, 0, 4])
    plan = ann.Layout.plan(rows_of, asked, 130)
    assert plan.first.tolist() == [0, 0, 0, 1, 4, 4]
    assert plan.cells.tolist() == [1, 1, 1, 3, 1, 1]
    assert plan.blocks.tolist() == [2, 2, 2, 3, 1, 1]
    assert [g.tolist() for g in plan.groups(np.array([5, 0, 3, 2]))] == [[0, 2], [3], [5]]

    frame = lambda rows: pd.DataFrame(rows, columns=["vec_id", "v", "leaves", "cell", "block", "asks"])
    held = [(i, np.array([float(i)]), np.array([0]), 0, 0, 0) for i in range(5)]
    asks = [(i, np.array([1.0]), np.array([0]), 0, 0, 1) for i in range(7)]
    every = held + asks + [(9, np.array([1.0]), np.array([1]), 1, 0, 1)]
    pieces = [frame(every[i : i + 2]) for i in range(0, len(every), 2)]
    answers = [list(f.itertuples(index=False, name=None)) for f in ann._stream_top(2)(iter(pieces))]
    assert max(len(a) for a in answers) <= 2 * 2  # a frame is answered before the next is taken
    assert [a for part in answers for a in part if a[0] in (0, 4)] == [(0, 4, 4.0), (0, 3, 3.0), (4, 3, 3.0), (4, 2, 2.0)]


# 10 personal data


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(6)
    texts = ["a@b.c", "a@b@c.d", "x@y..z a.b@c-d.e.f.", "1.2.3.4.5", "0001.2.3.255 256.1.1.1", "4111 1111 1111 1111", "é4111-1111-1111-1111x", "+49 (0)30 1234567 +1", "+1+22 333 4444"]
    texts += ["".join(rnd.choice("ab@@..-1245 +(5)") for _ in range(rnd.randint(1, 80))) for _ in range(3000)]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t


@pytest.mark.parametrize("iban", ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"])
def test_iban_before_and_after_capitals_and_numbers(iban):
    for before in ("", "XX12 ", "NR 7 "):
        for after in ("", " BIC GEBABEBB", " 5", " BIC", " EUR 100", " EUR 2024 OK", " GEBA BEBB 12", ", BIC"):
            for own in (iban, iban.replace(" ", "")):
                text = f"x {before}{own}{after}"
                spans = [text[s:e] for kind, s, e, _ in pii.find_spans(text) if kind == "iban"]
                assert spans == [own], text
    assert pii.redact(f"to {iban} BIC x") == "to [IBAN] BIC x"
    assert not any(x[0] == "iban" for x in pii.find_spans("BE68 5390 0754 7035 BIC A"))


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [x[0] for x in pii.find_spans(t)]
    assert kinds("bank account GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("call me: phone 555-123-4567 now") == ["local_phone"]
    assert kinds("order 555-123-4567 shipped") == []
    assert pii.redact("mail é.a@b.de now, +49 30 1234567!") == "mail é[EMAIL] now, [PHONE]!"


def test_pii_query(spark):
    rows = [*corpus(1), (5000, "write to a@b.org or call +1 (555) 010-9999"), (None, "1.2.3.4"), (6000, "a" * 200_000 + "@ 1.2"), (6001, "1" * 200_000)]
    texts = dict(rows)
    for r in rows_of(pii.scan_pii(table(spark, rows))):
        base = brute_spans(texts[r["doc_id"]] or "") if r["doc_id"] not in (6000, 6001) else []
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in base) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    assert pii.scan_pii(table(spark, [])).count() == 0
    fixed = {r["doc_id"]: r for r in rows_of(pii.redact_documents(table(spark, rows)))}
    assert fixed[5000]["text"] == "write to [EMAIL] or call [PHONE]" and fixed[5000]["n_chars"] == 32


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [*corpus(1), (5000, "write to a@b.org or call +1 (555) 010-9999"), (5001, "12 34"), (5002, "12 34")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table(spark, []).columns
    texts = {i: t for i, t in rows if t and re.search(r"[^\W\d_]", t)}
    last = {}
    for i, t in sorted(texts.items()):
        last[t] = i
    unique = [(i, t) for t, i in last.items()]
    kept = sorted(c[0] for c in brute_classes(unique))
    assert sorted(r.doc_id for r in docs.collect()) == kept
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert sorted({r["doc_id"] for r in got}) == kept
