"""Entity resolution: candidates that share a key, directly or through others, are one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm

from .components import connected_components


def candidate_keys(candidates: DataFrame, with_phones: bool = False) -> DataFrame:
    """entity_id, cand_id, key: email, social and person keys (and phones if asked for)."""
    mail = F.transform("emails", lambda e: F.concat(F.lit("email:"), norm.email(e.value)))
    social = F.transform("social_urls", lambda u: F.concat(F.lit("social:"), F.lower(u)))
    person = F.when(F.col("full_name").isNotNull(), F.array(F.concat(F.lit("person:"), F.lower("full_name"), F.lit("|"), F.lower(F.coalesce("position", F.lit(""))))))
    keys = [mail, social, person] + ([F.transform("phones", lambda p: F.concat(F.lit("phone:"), p))] if with_phones else [])
    empty = F.array().cast("array<string>")
    return candidates.select("entity_id", "cand_id", F.explode(F.array_distinct(F.concat(*(F.coalesce(k, empty) for k in keys)))).alias("key"))


def resolve(keys: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """cand_id, group_id: the smallest candidate that is tied to this one by shared keys within its entity.

    Every key ties its candidates to its smallest one: as many edges as there are keys, also for a hub key. Shared keys
    are stored, so that the join shuffles both sides and a hub key's rows can be split.
    """
    hubs = save(keys.groupBy("entity_id", "key").agg(F.min("cand_id").alias("src"), F.count("*").alias("of")).where("of > 1"))
    edges = keys.join(hubs, ["entity_id", "key"]).where("cand_id <> src").select("src", F.col("cand_id").alias("dst")).distinct()
    labels = connected_components(edges, save)
    everyone = keys.select("cand_id").distinct()
    return everyone.join(labels.withColumnRenamed("node", "cand_id"), "cand_id", "left").select("cand_id", F.coalesce("label", "cand_id").alias("group_id"))


def best_emails(emails: DataFrame) -> DataFrame:
    """group_id, value, deliverability, status, generic, confidence: the best of each address, ties to the earlier.

    emails: group_id, ord, value, generic, deliverability, status, confidence.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for pair in lex.DELIVERABILITY_RANK for x in pair))[F.col("deliverability")], F.lit(0))
    status = F.when(F.col("status").eqNullSafe("inferred"), 0).when(F.col("status").eqNullSafe("general") | F.col("generic"), 1).otherwise(2)
    ranked = emails.withColumn("r", F.struct((status * 10 + rank).alias("rank"), (-F.col("ord")).alias("first")))
    best = ranked.groupBy("group_id", "value").agg(F.max_by(F.struct("deliverability", "status", "generic"), "r").alias("b"), F.max("confidence").alias("confidence"))
    return best.select("group_id", "value", "b.deliverability", "b.status", "b.generic", "confidence")


def combine(candidates: DataFrame, groups: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """One row per group: first name and position by order, whether a fact holds for any candidate, n_phones (distinct),
    the largest confidence, the newest evidence, and whether it has several URLs.

    Nothing is listed: aggregates of fixed size, combined before the shuffle, and distinct phones as rows.
    """
    rows = candidates.join(groups, "cand_id").withColumns(facts)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    held = lambda c: F.when(F.bool_or(c), True).when(F.bool_or(F.col(c).isNull()), None).otherwise(False)
    urls = F.transform("evidence", lambda e: e.url)
    low, high, missing = F.min(F.array_min(urls)), F.max(F.array_max(urls)), F.bool_or(F.exists(urls, lambda u: u.isNull()))
    merged = rows.groupBy("entity_id", "group_id").agg(
        first("full_name").alias("full_name"),
        first("position").alias("position"),
        *(held(name).alias(name) for name in facts),
        F.max(F.array_max(F.transform("emails", lambda e: e.confidence))).alias("confidence"),
        F.max(F.array_max(F.transform("evidence", lambda e: e.published_at))).alias("newest"),
        F.coalesce((low != high) | (missing & high.isNotNull()), F.lit(False)).alias("several_urls"),
        F.min("ord").alias("ord"),
    )
    phones = rows.select("entity_id", "group_id", F.explode("phones").alias("phone")).distinct().groupBy("entity_id", "group_id").agg(F.count("*").alias("n"))
    return merged.join(phones, ["entity_id", "group_id"], "left").withColumn("n_phones", F.coalesce("n", F.lit(0).cast("long"))).drop("n")
