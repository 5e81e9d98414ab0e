"""Small corpora with every awkward case, and the brute-force results they are held against."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("chunk", T.StringType()),
        T.StructField("keys", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("ident", T.StringType()),
    ]
)


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), "x", None, "d", "") for r in rows]
    return spark.createDataFrame(full, DOCS)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    make = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = make(30)
    line = make(25)
    texts = [make(rnd.randint(1, 150)) for _ in range(n)]
    for i in range(0, n, 4):
        texts[i] = f"{texts[i]} {passage[rnd.randint(0, 20):]} {make(rnd.randint(0, 30))}"
    for i in range(1, n, 9):
        texts[i] = "\n".join([line] * rnd.randint(2, 4)) + texts[i]
    for i in range(5, n, 5):
        base = texts[rnd.randrange(i)].split()
        base[rnd.randrange(len(base))] = "edited"
        texts[i] = " ".join(base)
    for i in range(7, n, 10):
        texts[i] = texts[i - 3]
    texts += ["", None, "a" * 3000, "ab" * 700, passage, "a" * 3000, passage[:49], passage[:50], "word " * 200, "\t \n", None]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows
