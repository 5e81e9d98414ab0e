"""Near-duplicate documents by ProbMinHash over weighted five-word shingles.

A shingle's weight is how often it stands in the document. Its arrivals are a Poisson process with that rate; each
arrival falls on a random register, and a register keeps the shingle of its earliest arrival. A document stops as
soon as no arrival can come before the latest register. Two documents agree in a register with their probability
Jaccard similarity, which for equal weights is the Jaccard similarity.

Bands of registers give candidates. Each document is compared with a central one of its bands, then with the centre
of every band in which several classes are left, then in a few turns with documents outside a group's main class;
similar ones join classes. What is then still in different classes is compared pair by pair, but for pairs that provably
stay under the threshold, so that no candidate pair is left both apart and unverified. Documents with the same best
centre meet under it; others that share a band meet under the band's centre.

The proof: let a and b be the shares of the weight of two documents on shingles that the other lacks. Their similarity
is at most (1 - a)(1 - b) / (1 - ab), so a + b is at most 2 (1 - t) / (1 + t) where it reaches the threshold t. The
shingles that no other open document has are in a or b; so are those of the band's centre that one of the two has and
the other lacks. Both are known without the pair: the comparison with the centre also counts the shingles of it that
a document lacks, in GAPS parts (``_gaps``), and in each part the counts of two documents differ by no more than the
shingles in which they do. Members of a group that were edited in different places are told apart by this alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactry.operators.components import connected_components

from . import textscan
from .common import NO_ID, join_weighted, outer_id, store
from .textscan import mix

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Turns of linking to documents outside a group's main class, before what is still in different classes is compared.
TURNS = 2
#: Bytes of a shingle's hash in a stored set.
KEY = 6
#: Parts of a centre's shingles in which the missing ones are counted.
GAPS = 32
#: Bins up to the largest share of weight that similar documents can have apart.
BINS = 2
#: Documents of a group in one share of the last comparison.
PER_SHARE = 4096
#: Texts or sets of shingles that go to Python at a time.
TEXTS = 1000
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of WORDS consecutive words (A-Z in lower case, parted by white space) and their counts.

    A text of fewer words, but at least one, has one shingle of them all.
    """
    joined = b" ".join(text.lower().split())
    units = textscan.word_units(joined)[0]
    if not len(units):
        return np.empty(0, _U), np.empty(0, np.int64)
    return np.unique(textscan.rolling_all(units, min(WORDS, len(units))), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The registers of many documents at once: the shingle of each register's earliest arrival."""
    n = len(sets)
    keys = np.concatenate([s[0] for s in sets])
    weight = np.concatenate([s[1] for s in sets]).astype(float)
    doc = np.repeat(np.arange(n), [len(s[0]) for s in sets])
    times = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, _U)
    when = np.zeros(len(keys))
    live, nth = np.arange(len(keys)), 0
    while len(live):
        nth += 1
        bits = mix(keys[live] + _U(nth * int(_STEP) % 2**64))
        gap = -np.log(((bits >> _U(11)).astype(float) + 0.5) / 2.0**53)
        when[live] += gap / weight[live]
        at = doc[live] * REGISTERS + (mix(bits + _STEP) % _U(REGISTERS)).astype(np.int64)
        arrived = when[live]
        first = arrived < times[at]
        at, arrived, own = at[first], arrived[first], live[first]
        np.minimum.at(times, at, arrived)
        won = arrived == times[at]
        winner[at[won]] = keys[own[won]]
        latest = times.reshape(n, REGISTERS).max(1)
        live = live[when[live] < latest[doc[live]]]
    return winner.reshape(n, REGISTERS)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common shingles i of 1 / sum over all j of max(u_j / u_i, v_j / v_i)."""
    (ka, ca), (kb, cb) = a, b
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    u, v = ca[ia].astype(float), cb[ib].astype(float)
    only_a, only_b = ca.sum() - u.sum(), cb.sum() - v.sum()
    # the sum is (only_a + sum max(u_j, v_j * r)) / u_i + only_b / v_i with r = u_i / v_i: once per distinct ratio
    ratio, which = np.unique(u / v, return_inverse=True)
    inner = np.array([np.maximum(u, v * r).sum() for r in ratio])[which]
    return float((1 / ((only_a + inner) / u + only_b / v)).sum())


def _signed(text: bytes, s: tuple[np.ndarray, np.ndarray]) -> int:
    """Hash of a document's weighted set, as a signed long: documents with equal sets are one node."""
    both = mix(s[0] + s[1].astype(_U) * _STEP)
    return int(np.array([mix(np.array([both.sum() + _U(len(both))]))[0]]).view(np.int64)[0])


def _sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fold = np.cumprod(np.full(ROWS, _STEP | _U(1)))
    for frame in frames:
        low = 0
        texts = frame["text"].tolist()
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and size < 1 << 20:
                size += len(texts[high])
                high += 1
            sets = [shingles(t) for t in texts[low:high]]
            nodes = [_signed(t, s) if len(s[0]) else None for t, s in zip(texts[low:high], sets, strict=True)]
            some = [i for i, s in enumerate(sets) if len(s[0])]
            keys: list = [None] * len(sets)
            if some:
                bands = mix((signatures([sets[i] for i in some]).reshape(len(some), BANDS, ROWS) * fold).sum(2) + np.arange(BANDS, dtype=_U) * _STEP)
                for i, b in zip(some, bands.view(np.int64), strict=True):
                    keys[i] = b
            yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[low:high].to_numpy(), "text_hash": frame["text_hash"].iloc[low:high].to_numpy(), "node": pd.array(nodes, dtype="Int64"), "bands": keys})
            low = high


def _as_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["node", "keys", "counts", "n", "total"]
    for frame in frames:
        out = []
        for node, text in zip(frame["node"], frame["text"], strict=True):
            if len(out) >= 256:
                yield pd.DataFrame(out, columns=columns)
                out = []
            s = shingles(text)
            if len(s[0]) and _signed(text, s) == node:
                keys = np.ascontiguousarray(s[0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY :])
                keys, where = np.unique(keys.view(f"V{KEY}").ravel(), return_inverse=True)
                counts = np.bincount(where, s[1]).astype("<u4")
                out.append((node, keys.tobytes(), counts.tobytes(), len(keys), int(counts.sum(dtype=np.int64))))
        yield pd.DataFrame(out, columns=columns)


def _read_set(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(keys) // KEY, 8), np.uint8)
    wide[:, 8 - KEY :] = np.frombuffer(keys, np.uint8).reshape(-1, KEY)
    return wide.view("<u8").ravel(), np.frombuffer(counts, "<u4").astype(np.int64)


def _set_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for low in range(0, len(frame), 64):
            part = frame.iloc[low : low + 64]
            sets = [_read_set(keys, counts) for keys, counts in zip(part["keys"], part["counts"], strict=True)]
            shingle, weight = np.concatenate([k for k, _ in sets]).view(np.int64), np.concatenate([w for _, w in sets])
            yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), [len(k) for k, _ in sets]), "shingle": shingle, "weight": weight})


def _gaps(own: np.ndarray, centre: np.ndarray) -> list[int]:
    """How many shingles of the centre a document lacks, in each of GAPS parts of the shingles."""
    lacks = np.setdiff1d(centre, own, assume_unique=True)
    return np.bincount((mix(lacks) % _U(GAPS)).astype(np.int64), minlength=GAPS).tolist()


def _compare(threshold: float, with_gaps: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            similar, gaps = [], []
            for ka, ca, kb, cb in zip(frame["keys"], frame["counts"], frame["other_keys"], frame["other_counts"], strict=True):
                own, other = _read_set(ka, ca), _read_set(kb, cb)
                similar.append(bool(min(len(ka), len(kb)) and probability_jaccard(own, other) >= threshold))
                gaps.append(_gaps(own[0], other[0]) if with_gaps else [])
            yield pd.DataFrame({"src": frame["src"], "dst": frame["dst"], "similar": similar, "gaps": gaps})

    return run


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float, with_gaps: bool = False) -> DataFrame:
    """src, dst, similar, gaps (what src lacks of dst) of the given pairs."""
    other = sets.select(F.col("node").alias("dst"), F.col("keys").alias("other_keys"), F.col("counts").alias("other_counts"))
    both = pairs.join(sets.withColumnRenamed("node", "src"), "src").join(other, "dst")
    both = both.select("src", "dst", "keys", "counts", "other_keys", "other_counts")
    return both.mapInPandas(_compare(threshold, with_gaps), "src long, dst long, similar boolean, gaps array<int>")


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where("similar").select("src", "dst")


def _with_centres(placed: DataFrame) -> DataFrame:
    """Adds each band's most central document; one is the more central the more documents share its bands."""
    sizes = placed.groupBy("band").agg(F.count("*").alias("of"))
    central = placed.join(sizes, "band").groupBy("node").agg(F.sum("of").alias("central"))
    centres = placed.join(central, "node").groupBy("band").agg(F.max(F.struct("central", "node")).alias("centre"))
    return placed.join(centres, "band")


def _to_central(placed: DataFrame) -> DataFrame:
    """First turn: pairs of each document with the most central document of all its bands, its best centre."""
    best = _with_centres(placed).groupBy("node").agg(F.max("centre").alias("centre"))
    return best.select(F.col("node").alias("src"), F.col("centre.node").alias("dst")).where("src <> dst")


def _open(placed: DataFrame, labels: DataFrame, by: str = "band") -> DataFrame:
    """The bands (or other groups) that hold several classes."""
    ends = placed.join(labels, "node").groupBy(by).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    return placed.join(ends.where("lo < hi").select(by), by)


def _facts(sets: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """node, total (weight), u: the share of it on shingles that no other of ``nodes`` has.

    Documents with more than 1 - threshold of it are similar to none and left out.
    """
    mine = sets.join(nodes, "node", "left_semi")
    rows = mine.select("node", "keys", "counts").mapInPandas(_set_rows, "node long, shingle long, weight long")
    single = rows.groupBy("shingle").agg(F.count("*").alias("of"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("of = 1")
    own = single.groupBy("node").agg(F.sum("weight").alias("own"))
    told = mine.select("node", "total").join(own, "node", "left").withColumn("u", F.coalesce(F.col("own") / F.col("total"), F.lit(0.0)))
    return told.where(F.col("u") <= 1 - threshold + 1e-9).select("node", "total", "u")


def _most_apart(threshold: float) -> float:
    """What the shares of two similar documents' weights on shingles that the other lacks come to at most."""
    return 2 * (1 - threshold) / (1 + threshold) + 1e-9


def _allowed(threshold: float, a: str, b: str):
    """Whether documents with the given prefixes of u, gaps and total can be similar, by what is known of their centre."""
    apart = F.aggregate(F.zip_with(f"{a}gaps", f"{b}gaps", lambda x, y: F.abs(x - y)), F.lit(0), lambda total, x: total + x)
    u = F.col(f"{a}u") + F.col(f"{b}u")
    most = _most_apart(threshold)
    return (u <= most) & (u + apart / F.greatest(f"{a}total", f"{b}total") <= most)


def _to_strays(placed: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Pairs of a group's documents with one (another each turn) outside their main class, where they can be similar."""
    order = F.struct(F.col("label") == F.col("main"), F.xxhash64("node", F.lit(turn)), "node", "label", "u", "gaps", "total")
    chosen = _with_main(placed).groupBy("group").agg(F.min(order).alias("c"))
    chosen = chosen.select("group", *(F.col(f"c.{n}").alias(f"c_{n}") for n in ("node", "label", "u", "gaps", "total")))
    met = placed.join(chosen, "group").where(F.col("label") != F.col("c_label")).where(_allowed(threshold, "", "c_"))
    met = met.groupBy("node", "c_label").agg(F.min("c_node").alias("c_node"))
    return met.select(F.least("node", "c_node").alias("src"), F.greatest("node", "c_node").alias("dst")).distinct()


def _with_main(placed: DataFrame) -> DataFrame:
    """The groups of several classes, with the label of the largest one, the number of documents and the largest weight."""
    classes = placed.groupBy("group", "label").agg(F.count("*").alias("of"), F.max("total").alias("heaviest"))
    main = classes.groupBy("group").agg(
        F.max_by("label", F.struct("of", "label")).alias("main"), F.sum("of").alias("held"), F.count("*").alias("classes"), F.max("heaviest").alias("heaviest")
    )
    return placed.join(main.where("classes > 1").drop("classes"), "group")


def _left_open(placed: DataFrame, threshold: float) -> DataFrame:
    """All pairs of documents of one group in different classes, but for those within their main class, that can be similar.

    With g the number of the centre's shingles that a document lacks, as a share of their largest weight: two
    documents are similar only if u + g of each is at most the most allowed, less u, plus g of the other. So each is
    an interval; they meet in the bin where the later of two intervals begins, and there the parts of g are compared.
    The others of a large group are dealt over shares of it, each of which meets all strays.
    """
    most = _most_apart(threshold)
    gaps = F.aggregate("gaps", F.lit(0), lambda total, x: total + x) / F.col("heaviest")
    both = _with_main(placed).withColumn("g", gaps).withColumns({"size": F.col("u") + F.col("g"), "most": most + F.col("g") - F.col("u")})
    bin_of = lambda v: F.floor(v / (most / BINS) + 1e-9).cast("int")
    both = both.withColumns({"low": bin_of(F.col("size")), "high": bin_of(F.greatest("size", "most")), "first": bin_of(F.least("size", "most"))})
    shares = F.ceil(F.col("held") / PER_SHARE).cast("int")
    strays = both.where(F.col("label") != F.col("main"))
    range_of = strays.groupBy("group").agg(F.min("first").alias("from"), F.max("high").alias("to"))
    others = both.join(range_of, "group").withColumn("low", F.greatest("low", "from")).where(F.col("low") <= F.least(F.greatest("low", "high"), "to"))
    others = others.select(
        "group", "node", "best", "label", "main", "u", "gaps", "total", "low", F.pmod(F.xxhash64("node"), shares).alias("share"),
        F.explode(F.sequence("low", F.least(F.greatest("low", "high"), F.greatest("low", "to")))).alias("bin"),
    )
    strays = strays.select(
        "group", F.col("node").alias("stray"), *(F.col(n).alias(f"s_{n}") for n in ("best", "label", "u", "gaps", "total", "first")),
        F.explode(F.sequence("first", "high")).alias("bin"), shares.alias("shares"),
    ).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares").cast("long") - 1)))
    met = others.join(strays, ["group", "bin", "share"]).where("s_label <> label and bin = greatest(low, s_first) and (label = main or stray < node) and (group.by_best or best <> s_best)")
    met = met.where(_allowed(threshold, "", "s_"))
    return met.select(F.least("stray", "node").alias("src"), F.greatest("stray", "node").alias("dst")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the classes at both ends of each link are one."""
    ends = links.join(labels.withColumnRenamed("node", "src").withColumnRenamed("label", "a"), "src").join(labels.withColumnRenamed("node", "dst").withColumnRenamed("label", "b"), "dst")
    edges = store(ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "edges")
    joined = connected_components(edges, lambda df: store(df, "stars")).select(F.col("node").alias("label"), F.col("label").alias("one"))
    return store(labels.join(joined, "label", "left").select("node", F.coalesce("one", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Per document: doc_id, class_id, class_size, kept, text_hash (xxhash64 of the text).

    class_id is the smallest doc_id of the class, which is the one that stays; documents with equal weighted shingle
    sets are one node and always together. Null and wordless texts are alike to nothing, each a class of its own.
    Of repeated rows (same doc_id) with one text all carry the same class; ``kept`` is true for those with the
    smallest doc_id. A null doc_id counts as smaller than all others and is returned as null (class_id is null where
    it is the smallest). An empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text)
    hashed = texts.withColumn("text_hash", F.xxhash64("text"))
    sketches = store(hashed.mapInPandas(_sketch, "doc_id long, text_hash long, node long, bands array<long>"), "sketches", TEXTS)
    known = sketches.where("node is not null")
    one = F.min(F.struct("doc_id", "text_hash")).alias("one")
    nodes = known.groupBy("node").agg(one, F.count("*").alias("members"), F.any_value("bands").alias("bands"))
    nodes = store(nodes.select("node", F.col("one.doc_id").alias("least"), "one.text_hash", "members", "bands"), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("of")).where("of > 1").select("band")
    placed = store(bands.join(shared, "band"), "bands")
    labels = store(placed.select("node", F.col("node").alias("label")).distinct(), "labels")
    wanted = labels.join(nodes, "node").select(F.col("least").alias("doc_id"), "text_hash", "node")
    chosen = hashed.join(wanted, ["doc_id", "text_hash"])
    sets = store(chosen.mapInPandas(_as_sets, "node long, keys binary, counts binary, n int, total long").dropDuplicates(["node"]), "sets", TEXTS)

    first = store(_compared(_to_central(placed), sets, threshold, with_gaps=True), "compared", TEXTS)
    labels = _merged(labels, store(_linked(first), "links", TEXTS))
    placed = store(_open(placed, labels), "bands")
    if not placed.isEmpty():
        best = first.select(F.col("src").alias("node"), F.col("dst").alias("best"))
        left = placed.select("node").unionByName(best.select(F.col("best").alias("node"))).distinct()
        facts = store(_facts(sets, left, threshold).join(best, "node", "left").withColumn("best", F.coalesce("best", "node")), "facts", TEXTS)
        centred = _with_centres(placed.join(facts, "node")).select(F.col("node").alias("src"), F.col("centre.node").alias("dst"))
        compared = store(_compared(centred.where("src <> dst").distinct(), sets, threshold, with_gaps=True), "compared", TEXTS)
        labels = _merged(labels, store(_linked(compared), "links", TEXTS))
        group = lambda by_best: F.struct(F.lit(by_best).alias("by_best"), F.col("dst").alias("centre")).alias("group")
        told = first.select(F.col("src").alias("node"), group(True), "gaps").unionByName(compared.select(F.col("src").alias("node"), group(False), "gaps"))
        placed = store(_open(told.join(facts, "node"), labels, "group"), "groups")
        for turn in range(TURNS):
            if placed.isEmpty():
                break
            pairs = _to_strays(placed.join(labels, "node"), turn, threshold)
            labels = _merged(labels, store(_linked(_compared(pairs, sets, threshold)), "links", TEXTS))
            placed = store(_open(placed, labels, "group"), "groups")
        pairs = store(_left_open(placed.join(labels, "node"), threshold), "pairs")
        labels = _merged(labels, store(_linked(_compared(pairs, sets, threshold)), "links", TEXTS))

    named = nodes.select("node", "least", "members").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("members").alias("class_size"))
    classes = store(join_weighted(named.select("node", "label", "members"), sizes, "label", "class_size").select("node", "members", "class_id", "class_size"), "named")
    out = join_weighted(known.select("doc_id", "text_hash", "node"), classes, "node", "members").select("doc_id", "text_hash", "class_id", "class_size")
    alone = sketches.where("node is null").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    out = out.unionByName(alone)
    return out.select(outer_id().alias("doc_id"), outer_id("class_id").alias("class_id"), "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"), "text_hash")
