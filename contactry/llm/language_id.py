"""Language identification with error-correcting output codes.

Each language has a codeword; one binary classifier of hashed character n-grams per bit. A text's margins are
decoded to the codeword with the least weighted loss; a small lead over the next codeword is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, fresh, outer_id
from .textscan import mix

#: Rows per language, and in all, in the training sample: this bounds what the driver holds.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_ROWS = 3200
BUCKETS = 1 << 12
NGRAMS = (1, 2, 3)
UNKNOWN = "und"
#: A decoded lead below this is ambiguous.
LEAD = 0.1
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEEDS = mix(np.arange(1, 4, dtype=_U) * _U(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_BLOCK = 1 << 18


def features(text: bytes) -> np.ndarray:
    """Relative frequencies of hashed byte n-grams of the whole text, square-rooted, of length 1."""
    codes = _FOLD[np.frombuffer(text, np.uint8)].astype(np.uint32)
    out = np.zeros(BUCKETS)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for b in range(0, len(codes), _BLOCK):
        part = codes[b : b + _BLOCK + max(NGRAMS) - 1]
        value = np.zeros(len(part), np.uint32)
        for n, seed in zip(NGRAMS, _SEEDS, strict=True):
            value = (value[: len(part) - n + 1] << np.uint32(8)) + part[n - 1 :]
            out += np.bincount((value[:_BLOCK] * seed) >> shift, minlength=BUCKETS)
    out = np.sqrt(out)
    return out / max(np.linalg.norm(out), 1e-12)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per language: the exhaustive code up to 5 languages, else the best of fixed random ones."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        columns = [[(c + 1) >> i & 1 for i in range(n - 1)] + [0] for c in range(bits)]
        return np.array(columns, float).T * 2 - 1
    rnd, best, apart = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rnd.choice([-1.0, 1.0], (n, max(15, int(np.ceil(10 * np.log2(n))))))
        near = ((code[:, None] != code[None]).sum(2) + 10**6 * np.eye(n, dtype=int)).min()
        if near > apart:
            best, apart = code, near
    return best


class CodeModel:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    @classmethod
    def fit(cls, x: np.ndarray, languages: list[str], rounds: int = 300) -> CodeModel:
        names = sorted(set(languages))
        code = codewords(len(names))
        wanted = code[[names.index(v) for v in languages]]
        share = {v: 1 / languages.count(v) for v in names}
        row = np.array([share[v] for v in languages])
        row /= row.sum()
        weights, bias = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
        speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(rounds):  # logistic regression by gradient descent with momentum
            slope = -wanted / (1 + np.exp(np.clip(wanted * (x @ weights + bias), -30, 30))) * row[:, None]
            speed_w = 0.9 * speed_w - 4.0 * (x.T @ slope + 1e-4 * weights)
            speed_b = 0.9 * speed_b - 1.0 * slope.sum(0)
            weights, bias = weights + speed_w, bias + speed_b
        right = ((x @ weights + bias) * wanted > 0).astype(float)
        error = np.clip(1 - (right * row[:, None]).sum(0), 0.01, 0.49)
        trust = np.log((1 - error) / error)
        return cls(names, code, weights, bias, trust / trust.sum())

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, score from 0 to 1, lead over the next) by loss-weighted decoding."""
        margins = x @ self.weights + self.bias
        loss = (self.trust * np.logaddexp(0, -margins[:, None, :] * self.code[None])).sum(2)
        like = np.exp(-self.code.shape[1] * (loss - loss.min(1, keepdims=True)))
        like /= like.sum(1, keepdims=True)
        ranked = np.sort(like, 1)
        lead = ranked[:, -1] - ranked[:, -2] if like.shape[1] > 1 else ranked[:, -1]
        return loss.argmin(1), ranked[:, -1], lead


def is_held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Features and languages of labelled rows: of each language the ids that come first by a hash of the id.

    A language gives ``per_language`` ids, or its part of ``most`` if there are too many languages for that; an id
    counts once, however often it is repeated. A count per language tells the share of the hashes that holds about
    twice the wanted ids, so that only those reach the ranking. Ids are chosen from narrow columns; only the chosen
    rows' texts are turned into features.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~is_held_out(), F.lit(True)))
    known = known.select("lang", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("held"))
    languages = held.count()
    if not languages:
        return np.empty((0, BUCKETS)), []
    each = max(1, min(per_language, most // languages))
    order = F.xxhash64("doc_id")
    place = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    if languages <= 10_000:  # a few hundred KB
        held = F.broadcast(held)
    near = known.select("lang", "doc_id").join(held, "lang").where(place <= (2 * each + 50) / F.col("held"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(place, order, "doc_id"))
    chosen = near.distinct().withColumn("nth", nth).where(F.col("nth") <= each)
    chosen = chosen.orderBy("nth", "lang").limit(most).select("lang", "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang": frame["lang"], "x": [features(t).astype("<f4").tobytes() for t in frame["text"]]})

    picked = known.join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = picked.mapInPandas(run, "doc_id long, lang string, x binary").groupBy("lang", "doc_id").agg(F.min("x").alias("x"))
    rows = rows.orderBy("lang", "doc_id").collect()  # at most SAMPLE_ROWS
    return np.stack([np.frombuffer(r.x, "<f4") for r in rows]), [r.lang for r in rows]


def train(docs: DataFrame) -> CodeModel | None:
    x, languages = training_sample(docs)
    return CodeModel.fit(x, languages) if languages else None


def _predicted(model: CodeModel | None, texts: pd.Series, letters: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of every text, 256 at a time."""
    lang = np.full(len(texts), UNKNOWN, object)
    score, lead, letters = np.zeros(len(texts)), np.zeros(len(texts)), letters.to_numpy(bool)
    for b in range(0, len(texts), 256):
        at = np.flatnonzero(letters[b : b + 256]) + b
        if model is not None and len(at):
            best, score[at], lead[at] = model.predict(np.stack([features(texts.iloc[i]) for i in at]))
            lang[at] = np.array(model.languages, object)[best]
    return lang, score, lead < LEAD


def _has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: CodeModel | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, ambiguous.

    The classifiers learn from a bounded sample (SAMPLE_PER_LANGUAGE rows of each language, SAMPLE_ROWS in all) of the
    labelled rows that are not held out; every whole text is predicted from its bytes alone. A null text or one
    without a letter is ``und`` with score 0, as is everything when no row is labelled. A null doc_id stays null and
    is not held out. Repeated rows are documents of their own; further columns are ignored; an empty table gives no
    rows. Texts of any length are read whole, block by block. Ties between codewords go to the first language by name.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    if model is None:
        model = train(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lang, score, ambiguous = _predicted(model, frame["text"], frame["letters"])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "lang_pred": lang, "score": score, "ambiguous": ambiguous})

    rows = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(is_held_out(), F.lit(False)).alias("held_out"),
        _has_letter().alias("letters"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean").withColumn("doc_id", outer_id())


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents with a language, which ``lang`` then holds: the predicted one.

    Null texts, texts without a letter, and texts whose two nearest codewords are too close to tell apart go. Where
    no row is labelled, nothing can be learned: texts with a letter stay as they are. Repeated rows are judged alike;
    long texts are read whole; an empty table gives no rows; further columns of any name are kept.
    """
    model = train(docs)
    if model is None:
        return docs.where(_has_letter())

    @F.pandas_udf("struct<lang: string, ambiguous: boolean>")
    def told(texts: pd.Series) -> pd.DataFrame:
        lang, _, ambiguous = _predicted(model, texts, pd.Series(np.ones(len(texts), bool)))
        return pd.DataFrame({"lang": lang, "ambiguous": ambiguous})

    name = fresh(docs, "told")
    kept = docs.where(_has_letter()).withColumn(name, told(F.col("text").cast("binary"))).where(~F.col(f"{name}.ambiguous"))
    return kept.withColumn("lang", F.col(f"{name}.lang")).select(*docs.columns)
