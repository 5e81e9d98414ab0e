"""Vector code compression: product codes by integer k-means, with nearest entries found through LAESA pivots.

A vector becomes integers, cut into equal parts; every part position has a codebook. Parts, and their distances to
a few fixed pivots, are computed once and stored. Each round the driver computes the distances from pivots to entries:
with the stored ones they bound the distance of a part to every entry from below. The entries with the least bounds are
evaluated first, exactly and in integers; of the others only those whose bound does not exceed the best distance.
A round is one pass over the stored table with a pre-aggregated sum per entry; codebooks are the only thing that
comes to the driver, and their size does not depend on the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_weighted, store

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 16
#: Components beyond so much are cut to it, so squared distances are exact in 64 bits.
LIMIT = 1 << 24
#: Entries that are evaluated before the bounds are compared with the best distance.
FIRST = 16
_ROWS = 1024


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances row by row, exact in integers."""
    x = x - y
    return np.einsum("ij,ij->i", x, x).astype(np.int64)


@dataclass
class Codebooks:
    """entries: part position, entry, component; pivots: part position, pivot, component."""

    entries: np.ndarray
    pivots: np.ndarray

    @classmethod
    def start(cls, parts: np.ndarray, pivots: int = PIVOTS) -> Codebooks:
        """parts: the first vectors, part position and component. Pivots are entries far from each other."""
        entries = np.ascontiguousarray(parts.transpose(1, 0, 2))
        chosen = []
        for book in entries.astype(np.float64):
            at = [0]
            far = np.linalg.norm(book - book[0], axis=1)
            while len(at) < min(pivots, len(book)):
                at.append(int(far.argmax()))
                far = np.minimum(far, np.linalg.norm(book - book[at[-1]], axis=1))
            chosen.append(book[at])
        return cls(entries, np.array(chosen).astype(np.int64))

    def to_pivots(self, parts: np.ndarray) -> np.ndarray:
        """Distance of each part of each vector to the pivots of its position."""
        out = np.empty((*parts.shape[:2], self.pivots.shape[1]), np.float32)
        for j in range(parts.shape[1]):
            for p, pivot in enumerate(self.pivots[j]):
                out[:, j, p] = np.sqrt(((parts[:, j] - pivot) ** 2).sum(1))
        return out

    def nearest(self, j: int, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each part at position ``j``, ties to the lower index, its squared distance, and how many were evaluated."""
        book = self.entries[j].astype(x.dtype)
        from_pivots = np.sqrt(((self.entries[j][:, None] - self.pivots[j][None]) ** 2).sum(2)).astype(np.float32)
        bound = np.zeros((len(x), len(book)), np.float32)
        for p in range(from_pivots.shape[1]):
            np.maximum(bound, np.abs(to_pivots[:, p, None] - from_pivots[None, :, p]), out=bound)
        bound -= bound * np.float32(1e-5) + np.float32(1e-6) * np.float32(max(to_pivots.max(initial=0), from_pivots.max(initial=0)) + 1)  # rounding never lifts it above the distance
        first = min(FIRST, len(book))
        order = np.argpartition(bound, first - 1, axis=1)[:, :first]
        d = _squares(np.repeat(x, first, 0), book[order.reshape(-1)]).reshape(len(x), first)
        best = d.min(1)
        entry = np.where(d == best[:, None], order, len(book)).min(1)
        np.put_along_axis(bound, order, np.inf, 1)
        np.maximum(bound, 0, out=bound)
        row, other = np.nonzero(bound.astype(np.float64) ** 2 <= best[:, None])
        if len(row):
            d = _squares(x[row], book[other])
            change = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            at, low = row[change], np.minimum.reduceat(d, change)
            least = np.full(len(x), np.iinfo(np.int64).max)
            least[at] = low
            index = np.where(d == least[row], other, len(book))
            rival = np.minimum.reduceat(index, change)
            better = (low < best[at]) | ((low == best[at]) & (rival < entry[at]))
            best[at[better]], entry[at[better]] = low[better], rival[better]
        return entry, best, x.shape[0] * first + len(row)

    def assign(self, parts: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each part of each vector, and the number of exact evaluations."""
        most = max(int(np.abs(a).max(initial=0)) for a in (parts, self.entries))
        parts = parts.astype(np.int32 if 4 * most * most * parts.shape[2] < 1 << 31 else np.int64)  # as narrow as is exact
        code, error, evaluated = np.empty(parts.shape[:2], np.int64), np.empty(parts.shape[:2], np.int64), 0
        for low in range(0, len(parts), _ROWS):
            at = slice(low, low + _ROWS)
            for j in range(parts.shape[1]):
                code[at, j], error[at, j], n = self.nearest(j, parts[at, j], to_pivots[at, j])
                evaluated += n
        return code, error, evaluated

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def integer_parts(vectors: list[np.ndarray], parts: int, width: int) -> np.ndarray:
    """Floors of the scaled components, by vector, part position and component; missing ones of the last part are 0."""
    out = np.zeros((len(vectors), parts * width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.clip(np.floor(np.asarray(v, np.float64) * SCALE), -LIMIT, LIMIT)
    return out.reshape(len(vectors), parts, width)


def _prepare(books: Codebooks, parts: int, width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = integer_parts(frame["v"].tolist(), parts, width)
            far = books.to_pivots(x) if len(x) else np.empty((0, parts, books.pivots.shape[1]), np.float32)
            packed = [row.astype("<i4").tobytes() for row in x]
            yield frame[["vec_id", "label_key"]].assign(parts=packed, to_pivots=[row.astype("<f4").tobytes() for row in far])

    return run


def _unpack(frame: pd.DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    n_parts, n_pivots, width = books.pivots.shape
    x = np.frombuffer(b"".join(frame["parts"]), "<i4").astype(np.int64).reshape(-1, n_parts, width)
    return x, np.frombuffer(b"".join(frame["to_pivots"]), "<f4").reshape(-1, n_parts, n_pivots)


def _sums(books: Codebooks):
    """Per task and entry in use: number and sum of its parts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_parts, n_entries, width = books.entries.shape
        number, total = np.zeros(n_parts * n_entries, np.int64), np.zeros((n_parts * n_entries, width), np.int64)
        for frame in frames:
            x, far = _unpack(frame, books)
            code = books.assign(x, far)[0]
            for j in range(n_parts):
                at = code[:, j] + j * n_entries
                number += np.bincount(at, minlength=len(number))
                np.add.at(total, at, x[:, j])
        used = np.flatnonzero(number)
        yield pd.DataFrame({"part": used // n_entries, "entry": used % n_entries, "n": number[used], "total": pd.Series(list(total[used]), dtype=object)})

    return run


def _codes(books: Codebooks):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            code, error, _ = books.assign(*_unpack(frame, books))
            codes = ["".join([f"{c:02x}" for c in row]) for row in code.tolist()]
            yield frame[["vec_id", "label_key"]].assign(code=codes, error=error.sum(1))

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, dim: int | None = None) -> DataFrame:
    """Per vector: vec_id, code (two hex digits per part), error, label_error (summed over equal labels), codebooks_sha256.

    Vectors that are null or empty, or hold null or non-finite components, are dropped, and so are those whose length is not
    ``dim`` (default: the length of the vector with the smallest id). Where the parts do not divide the length, the
    last one is filled with zeros. Components become floor(1024 * x), cut to 24 bits. The codebook starts as the parts of
    the vectors with the smallest ids: fewer than ``entries`` where there are fewer, equal ids by vector, null ids last.
    Repeated rows each count. A table without such vectors gives no rows; further columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits per part")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label_key"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    first = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    if dim is None:
        least = rows.orderBy(*first).select("v").first()
        dim = len(least.v) if least else 1
    rows = rows.where(F.size("v") == dim)
    start = [r.v for r in rows.orderBy(*first).select("v").limit(entries).collect()]
    width = -(-dim // parts)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not start:
        return vectors.sparkSession.createDataFrame([], schema)
    books = Codebooks.start(integer_parts(start, parts, width))
    table = store(rows.mapInPandas(_prepare(books, parts, width), "vec_id long, label_key string, parts binary, to_pivots binary"), "parts")
    for _ in range(rounds):
        sums = table.select("parts", "to_pivots").mapInPandas(_sums(books), "part int, entry int, n long, total array<long>")
        merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
        moved = books.entries.copy()
        for r in merged.collect():  # at most parts * entries rows
            moved[r.part, r.entry] = np.array(r.total, np.int64) // r.n
        books = Codebooks(moved, books.pivots)
    coded = store(table.mapInPandas(_codes(books), "vec_id long, label_key string, code string, error long"), "coded")
    labels = store(coded.groupBy("label_key").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "labels")
    return join_weighted(coded, labels, "label_key", "n").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same rounds, entry by entry: |x - e|^2 = |x|^2 - 2 x e + |e|^2 is exact in doubles."""
    pairs = "cast(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) AS BIGINT)"
    steps = [
        "raw AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "p AS (SELECT vec_id, label, j, list_transform(v[len(v) // 4 * j + 1 : len(v) // 4 * (j + 1)], lambda y: floor(1024 * y::DOUBLE)) AS x FROM raw, range(4) t(j))",
        "c0 AS (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < 256)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.j, min({pairs} * 256 + c.e) AS m FROM p JOIN c{r} c ON p.j = c.j GROUP BY p.vec_id, p.j)")
        if r < ROUNDS:
            steps += [
                f"u{r} AS (SELECT j, m % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p.j, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{r} JOIN p USING (vec_id, j)) GROUP BY ALL)",
                f"v{r} AS (SELECT j, e, list(floor(s / n) ORDER BY i) AS x FROM u{r} GROUP BY j, e)",
                f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.e, coalesce(v.x, c.x) AS x FROM c{r} c LEFT JOIN v{r} v ON c.j = v.j AND c.e = v.e)",
            ]
    steps += [
        f"code AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY j) AS code, sum(m // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)",
        f"book AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 "
        "FROM code JOIN raw USING (vec_id), book"
    )


ORACLE = _oracle()
