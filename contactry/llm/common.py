"""Shared pieces of the training-data operators: typed inputs, stored stages, row identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactry.storage import store  # noqa: F401

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NO_ID = -(2**63)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_documents(docs: DataFrame, rows_per_chunk: int = 256) -> DataFrame:
    """doc_id (null: the smallest value), chunk, ident (hash of the whole text) and the text as UTF-8 bytes.

    Only these columns are taken, so further columns of any name do no harm. ``chunk`` brings documents with
    near ids together: packed answers about a chunk meet its texts by one join key. Rows without an id are
    spread by their text.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    ident = F.xxhash64("text")
    chunk = F.when(F.col("doc_id").isNull(), -1 - F.pmod(ident, F.lit(4096))).otherwise(
        F.floor(F.col("doc_id") / rows_per_chunk)
    )
    return base.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), chunk.cast("long").alias("chunk"), ident.alias("ident"), "text"
    )


def outer_id(column: str = "doc_id"):
    """The id as the caller gave it: the stand-in for a missing id becomes null again."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def join_weighted(rows: DataFrame, keyed: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """``rows`` joined with the one row of ``keyed`` per key, whose ``weight`` counts the rows of that key.

    Keys that hold more than a thousandth of all rows (so at most a thousand of them) are broadcast, and their rows
    stay where they are; no other key is more than a thousandth of the shuffled side.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = keyed.where(F.col(weight) > max(total // 1000, 1000))
    if hot.isEmpty():
        return rows.join(keyed, key)
    cold = keyed.where(F.col(weight) <= max(total // 1000, 1000))
    some = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return some.unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
