"""Keyed state: upserts, run-scoped overwrite, review decisions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactry.storage import store

KEPT = ("first_seen_at", "status")


def upsert(state: DataFrame, batch: DataFrame, key: str = "fingerprint", kept: tuple[str, ...] = KEPT) -> DataFrame:
    """State after a batch: the batch's values win, but those of ``kept`` columns stay as they first were."""
    old, new = state.alias("o"), batch.alias("n")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in kept else F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*((F.coalesce(f"n.{key}", f"o.{key}") if c == key else pick(c)).alias(c) for c in state.columns))


def decide(rows: DataFrame, decisions: DataFrame, allowed: tuple[str, ...] = ("pending", "approved", "rejected")) -> DataFrame:
    """rows (id, decision, synced_at) after decisions (id, wanted): only allowed ones, and only while unsynced.

    Of several allowed decisions on an id, the last in alphabetical order counts, so a rejection stands.
    """
    told = decisions.where(F.col("wanted").isin(*allowed)).groupBy("id").agg(F.max("wanted").alias("wanted"))
    out = rows.join(told, "id", "left")
    return out.withColumn("decision", F.when(F.col("synced_at").isNull() & F.col("wanted").isNotNull(), F.col("wanted")).otherwise(F.col("decision"))).drop("wanted")


def write_run(df: DataFrame, path: str) -> None:
    """Replaces the rows of the runs in ``df`` and leaves other runs: writing twice is writing once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def replace_runs(companies: DataFrame, candidates: DataFrame, folder: str, write_id: str | None = None) -> None:
    """Replaces the companies of their runs, and with them their candidates and those candidates' decisions.

    companies (run_id, source_lead_id, ...), candidates (run_id, source_lead_id, ...). A candidate holds by its company's
    row: both carry the name of the write, so candidates of an earlier write are gone as soon as the companies are
    written, also where a run has no candidates any more.
    """
    write = F.lit(write_id or uuid.uuid4().hex)
    write_run(candidates.withColumn("write_id", write), f"{folder}/candidates")
    write_run(companies.withColumn("write_id", write), f"{folder}/companies")


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(companies, candidates) as last written; each candidate with the company row of its run and lead."""
    companies, candidates = (spark.read.parquet(f"{folder}/{t}") for t in ("companies", "candidates"))
    key = ["run_id", "source_lead_id", "write_id"]
    return companies.drop("write_id"), candidates.join(companies.select(*key), key, "left_semi").drop("write_id")


def decide_stored(spark: SparkSession, folder: str, decisions: DataFrame) -> None:
    """Stores the decisions (id, wanted) on the candidates of the runs they concern; other runs stay as they are."""
    candidates = spark.read.parquet(f"{folder}/candidates")
    runs = candidates.join(decisions.select("id"), "id", "left_semi").select("run_id").distinct()
    changed = decide(candidates.join(runs, "run_id", "left_semi"), decisions).select(*candidates.columns)
    write_run(store(changed, "decided"), f"{folder}/candidates")


Rules = dict[str, Column]


def _one_of(column: str, *values: str) -> Column:
    return F.col(column).isin(*values)


def run_rules() -> Rules:
    """What every row of runs must satisfy."""
    return {
        "id": F.col("id").isNotNull(), "started_at": F.col("started_at").isNotNull(),
        "mode": _one_of("mode", "dry-run", "apply"), "write_mode": _one_of("write_mode", "enrich", "new_lead"), "status": _one_of("status", "running", "completed", "failed"),
    }


def candidate_rules() -> Rules:
    given = {c: F.col(c).isNotNull() for c in ("run_id", "source_lead_id", "company_name")}
    return given | {"score": F.col("score").between(0, 100), "decision": _one_of("decision", "pending", "approved", "rejected")}


def signal_rules() -> Rules:
    given = {c: F.col(c).isNotNull() for c in ("fingerprint", "source", "category", "intent", "query", "title", "url", "snippet")}
    return given | {"score": F.col("score").between(0, 100), "status": _one_of("status", "new", "qualified", "dismissed")}


def checked(rows: DataFrame, rules: Rules, unique: tuple[str, ...] = (), order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy all rules, rejects with ``reasons``: the names of those that they break).

    A rule that gives null is broken, so a null is no allowed value. With ``unique``, of good rows with equal keys the
    first by ``order`` is good and the others are rejects for ``unique``.
    """
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    told = rows.withColumn("reasons", broken)
    if unique:
        nth = F.row_number().over(W.partitionBy(F.size("reasons") == 0, *unique).orderBy(order or unique[0]))
        told = told.withColumn("nth", nth)
        told = told.withColumn("reasons", F.when((F.size("reasons") == 0) & (F.col("nth") > 1), F.array(F.lit("unique"))).otherwise(F.col("reasons"))).drop("nth")
    return told.where(F.size("reasons") == 0).drop("reasons"), told.where(F.size("reasons") > 0)
