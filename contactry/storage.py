"""Stored steps: tables in the folder that all executors share, which cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that go to Python at a time while a step is stored, however long single texts are.
BATCH_BYTES = 8 << 20
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: an own one on a local master, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder[context.applicationId]


def store(df: DataFrame, name: str = "step", batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    A lost executor then costs the tasks it ran, not the stages before the table. Shuffle files of the finished
    write go at once. What goes to Python at a time during the write is bounded in bytes, and by ``batch_rows`` where given.
    The session's own settings are put back after the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    wanted = {_CLEAN: "true", _BYTES: str(BATCH_BYTES)} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {conf: spark.conf.get(conf, None) for conf in wanted}
    for conf, value in wanted.items():
        spark.conf.set(conf, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for conf, value in before.items():
            spark.conf.unset(conf) if value is None else spark.conf.set(conf, value)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows of ``df`` dealt to tasks for all cores: a small file is one task, however much is then made of each row."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
