"""Providers of search results: a name and a function that reads what has landed. One that fails is a row, not the end of the job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactry.storage import store

#: What a provider gives; columns that it lacks are null.
RESULT = "query string, ord long, title string, url string, content string, published_at string, author string"
Provider = Callable[[SparkSession], DataFrame]


def run_providers(spark: SparkSession, providers: dict[str, Provider | None]) -> tuple[DataFrame, DataFrame]:
    """(results of all providers: provider, rank and RESULT; statuses: provider, rank, status, results, message).

    Every provider is read and stored by itself, so that what breaks one, when planned or when run, leaves the others: it is
    ``failed`` with the message's first line. A provider that is None is ``disabled``.
    """
    columns = spark.createDataFrame([], RESULT).schema
    rows, told = spark.createDataFrame([], f"provider string, rank int, {RESULT}"), []
    for rank, (name, provider) in enumerate(providers.items()):
        if provider is None:
            told.append((name, rank, "disabled", 0, None))
            continue
        try:
            own = provider(spark)
            typed = [(F.col(f.name) if f.name in own.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns]
            own = store(own.select(F.lit(name).alias("provider"), F.lit(rank).alias("rank"), *typed), "provider")
            told.append((name, rank, "used", own.count(), None))
            rows = rows.unionByName(own)
        except PySparkException as error:
            told.append((name, rank, "failed", 0, str(error).split("\n")[0][:200]))
    return rows, spark.createDataFrame(told, "provider string, rank int, status string, results long, message string")


def sticky_statuses(rounds: DataFrame) -> DataFrame:
    """provider, status over several rounds (provider, round, status): ``used`` stays, else the last one counts."""
    best = F.max_by("status", F.struct((F.col("status") == "used").alias("used"), "round"))
    return rounds.groupBy("provider").agg(best.alias("status"))


def company_outcomes(bodies: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """(entity_id and the fields of ``shape`` of bodies that can be read; a failure row for each that can not).

    bodies (entity_id, body as JSON). A failure row has entity_id, status ``failed``, warnings, and the one action that is left:
    skipped, as the company's processing was broken off. A null body fails too.
    """
    told = bodies.withColumn("b", F.from_json("body", f"{shape}, broken string", {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}))
    bad = F.col("b").isNull() | F.col("b.broken").isNotNull()
    why = F.when(F.col("body").isNull(), "no body").otherwise(F.concat(F.lit("unreadable body: "), F.left("body", F.lit(40))))
    action = F.struct(F.lit("skip").alias("type"), F.lit("failed").alias("status"), F.lit("processing was broken off").alias("detail"))
    failures = told.where(bad).select("entity_id", F.lit("failed").alias("status"), F.array(why).alias("warnings"), F.array(action).alias("actions"))
    return told.where(~bad).select("entity_id", "b.*").drop("broken"), failures
