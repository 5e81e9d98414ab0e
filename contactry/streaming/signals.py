"""Signals as a stream: the same state as running the batches one by one.

The state is a table of signals in buckets of their key. A batch rewrites only the buckets that it touches, into a folder
of its own number, and then notes in a manifest which buckets it wrote. A batch that is delivered again starts from
the versions before its number and so writes the same; readers take the latest noted version of each bucket.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from contactry.operators.dedup import first_wins
from contactry.operators.state import upsert

BUCKETS = 64
#: Versions of a bucket that stay, so that the last batches can be folded again.
VERSIONS = 3


def best_of_batch(batch: DataFrame) -> DataFrame:
    return first_wins(batch, ["fingerprint"], [F.desc("score"), "ord"]).drop("ord")


def _manifest(spark: SparkSession, state_path: str) -> DataFrame:
    try:
        return spark.read.schema("bucket int, batch long").parquet(f"{state_path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "bucket int, batch long")


def _versions(spark: SparkSession, state_path: str, before: int | None = None) -> dict[int, list[int]]:
    """The last few batches that wrote each bucket, the latest first."""
    noted = _manifest(spark, state_path)
    noted = noted if before is None else noted.where(F.col("batch") < before)
    nth = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("batch")))
    rows = noted.withColumn("nth", nth).where(F.col("nth") <= VERSIONS + 1).orderBy("bucket", "nth").collect()
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r.bucket, []).append(r.batch)
    return out


def _read(spark: SparkSession, state_path: str, latest: dict[int, int], schema) -> DataFrame:
    paths = [f"{state_path}/data/batch={n}/bucket={b}" for b, n in sorted(latest.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_state(spark: SparkSession, state_path: str, schema) -> DataFrame:
    """The signals after the last batch that was folded in."""
    return _read(spark, state_path, {b: n[0] for b, n in _versions(spark, state_path).items()}, schema)


def fold(batch: DataFrame, number: int, state_path: str, buckets: int = BUCKETS) -> None:
    """One batch into the state; the same batch again, under the same number, changes nothing."""
    spark = batch.sparkSession
    key = F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int")
    new = best_of_batch(batch).persist()
    touched = [r.bucket for r in new.select(key.alias("bucket")).distinct().collect()]
    before = _versions(spark, state_path, number)
    old = _read(spark, state_path, {b: before[b][0] for b in touched if b in before}, new.schema)
    merged = upsert(old, new).withColumn("bucket", key)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/data/batch={number}")
    notes = spark.createDataFrame([(b, number) for b in touched], "bucket int, batch long").coalesce(1)
    notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{state_path}/manifest")
    new.unpersist()
    _prune(spark, state_path, {b: before.get(b, []) for b in touched})


def _prune(spark: SparkSession, state_path: str, before: dict[int, list[int]]) -> None:
    """Old versions of the buckets that were just written go: their folders stay noted, but are never read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(state_path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket, batches in before.items():
        for number in batches[VERSIONS - 1 :]:
            files.delete(path(f"{state_path}/data/batch={number}/bucket={bucket}"), True)


def run(stream: DataFrame, state_path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Folds each micro-batch of signals (with an ``ord``) into the state, whatever number the first one has."""
    folded = stream.writeStream.foreachBatch(lambda batch, number: fold(batch, number, state_path, buckets))
    return folded.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_redelivery(stream: DataFrame, horizon: str = "14 days") -> DataFrame:
    """Signals (fingerprint, published_at) without those that come again within the horizon."""
    return stream.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark(["fingerprint"])
