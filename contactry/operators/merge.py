"""Contacts out of candidates: merged by shared keys, addresses inferred, merged again, scored and selected.

A candidate has entity_id, cand_id, ord, full_name, position, emails (value, generic, deliverability, confidence, status,
domain_has_mx), phones, social_urls, social_profiles (platform, kind, url) and evidence (source, url, published_at).
A key that ties a third of all candidates together makes a large group: facts of a group are aggregates, and what is listed
of it is whole or, if asked for, cut to its first entries by a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm

from . import dedup, research, resolve, score

MAIL = "struct<value:string,generic:boolean,deliverability:string,confidence:int,status:string,domain_has_mx:boolean>"
PROFILE = "struct<platform:string,kind:string,url:string>"
EVIDENCE = "struct<source:string,url:string,published_at:timestamp>"
LISTS = {"emails": MAIL, "phones": "string", "social_urls": "string", "social_profiles": PROFILE, "evidence": EVIDENCE}
CANDIDATE = "entity_id string, cand_id long, ord long, full_name string, position string, " + ", ".join(f"{k} array<{v}>" for k, v in LISTS.items())
#: Entries of a contact's list that are shown where it need not be whole; their numbers count all of them.
SHOWN = 50
Save = Callable[[DataFrame], DataFrame]


def social_candidates(profiles: DataFrame, evidence: DataFrame) -> DataFrame:
    """A candidate of each profile (entity_id, ord, url, platform, kind, person_name, role, evidence_url), with the first evidence of that address."""
    first = evidence.groupBy("entity_id", F.col("url").alias("evidence_url")).agg(F.min_by(F.struct("source", "url", "published_at"), "ord").alias("e"))
    rows = profiles.join(first, ["entity_id", "evidence_url"], "left")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return rows.select(
        "entity_id", "ord", F.col("person_name").alias("full_name"), F.col("role").alias("position"), empty(MAIL).alias("emails"), empty("string").alias("phones"), F.array("url").alias("social_urls"),
        F.array(F.struct("platform", "kind", "url")).alias("social_profiles"), F.array_compact(F.array("e")).alias("evidence"),
    )


def _rank(mail: Column) -> Column:
    """What makes an address the better of two equal ones: found before general before inferred, then deliverability."""
    table = F.create_map(*(F.lit(x) for pair in lex.DELIVERABILITY_RANK for x in pair))
    status = F.when(mail["status"].eqNullSafe("inferred"), 0).when(mail["status"].eqNullSafe("general") | mail["generic"], 1).otherwise(2)
    return status * 10 + F.coalesce(F.try_element_at(table, mail["deliverability"]), F.lit(0))


def _items(rows: DataFrame, name: str) -> DataFrame:
    """The entries of one list as rows: what they are known by, their place, rank, and the entry under its list's name."""
    x, out = F.col("x"), rows.select("group_id", "ord", F.posexplode(name).alias("nth", "x"))
    if name == "emails":
        value = norm.email(x["value"])
        x = F.struct(value.alias("value"), (F.coalesce(x["generic"], F.lit(False)) | norm.is_generic(value)).alias("generic"), *(x[c].alias(c) for c in ("deliverability", "confidence", "status", "domain_has_mx")))
    elif name == "phones":
        x = norm.phone(x)
    key = {"emails": x["value"], "social_profiles": F.concat_ws(":", x["platform"], x["url"]), "evidence": F.concat_ws(":", x["source"], x["url"])}.get(name, x)
    own = [(x if other == name else F.lit(None)).cast(kind).alias(other) for other, kind in LISTS.items()]
    rank = _rank(x) if name == "emails" else F.lit(0)
    told = out.select("group_id", F.lit(name).alias("list"), key.alias("key"), F.struct("ord", "nth").alias("place"), rank.alias("rank"), *own)
    return told.where("key is not null and key <> ''")


def entries(candidates: DataFrame, groups: DataFrame, lists: Iterable[str] = LISTS) -> DataFrame:
    """group_id, list, key, place, most and the entry under its list's name: every entry of the groups' lists, each once.

    Of equal addresses the better one stays, at the place of the first, with the largest confidence; of other equal entries
    the first.
    """
    rows = candidates.join(groups, "cand_id")
    items = reduce(DataFrame.unionByName, (_items(rows, name) for name in lists))
    best = F.struct((-F.col("rank")).alias("rank"), "place")
    once = items.groupBy("group_id", "list", "key").agg(*(F.min_by(c, best).alias(c) for c in LISTS), F.min("place").alias("place"), F.max("emails.confidence").alias("most"))
    return once.withColumn("emails", F.when(F.col("emails").isNotNull(), F.col("emails").withField("confidence", F.col("most"))))


def listed(candidates: DataFrame, groups: DataFrame, shown: int | None = SHOWN) -> DataFrame:
    """group_id, the first ``shown`` of the ``entries`` (None: all) of every list of a group, and n_<list>: how many there are.

    All lists take the same two shuffles.
    """
    once = entries(candidates, groups)
    counts = [F.count_if(F.col("list") == name).alias(f"n_{name}") for name in LISTS]
    sort = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("place", "key", name)))), lambda s: s[name])
    lists = [sort(name).alias(name) for name in LISTS]
    if shown is None:
        return once.groupBy("group_id").agg(*lists, *counts)
    first = dedup.top_k(once, ["group_id", "list"], ["place", "key"], shown)
    return first.groupBy("group_id").agg(*lists).join(once.groupBy("group_id").agg(*counts), "group_id")


def fallback_groups(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id of the groups with a general address that is not undeliverable and evidence of the own website."""
    e = F.col("emails")
    mail = F.bool_or(e["generic"] & ~e["deliverability"].eqNullSafe("undeliverable"))
    told = entries(candidates, groups, ("emails", "evidence")).groupBy("group_id").agg(mail.alias("mail"), F.bool_or(F.col("evidence.source") == "website").alias("site"))
    return told.where("mail and site").select("group_id")


def merge_again(groups: DataFrame, keys: DataFrame, touched: DataFrame, save: Save) -> DataFrame:
    """cand_id, group_id after further keys came up (entity_id, group_id, key in ``touched``).

    Only groups that have such a key, or had it before (``keys``: entity_id, cand_id, key), can change: components
    are built over them alone, and all other groups keep their name.
    """
    told = touched.select("entity_id", "key").distinct()
    before = keys.join(told, ["entity_id", "key"], "left_semi").join(groups, "cand_id").select("entity_id", "group_id", "key")
    both = save(before.unionByName(touched.select("entity_id", "group_id", "key")).distinct())
    renamed = resolve.resolve(both.withColumnRenamed("group_id", "cand_id"), save).select(F.col("cand_id").alias("group_id"), F.col("group_id").alias("now"))
    renamed = renamed.where("group_id <> now")
    return groups.join(renamed, "group_id", "left").select("cand_id", F.coalesce("now", "group_id").alias("group_id"))


def with_mx(candidates: DataFrame, domains: DataFrame) -> DataFrame:
    """Candidates whose addresses know whether their domain takes mail: domains (domain, has_mx), unknown stays null."""
    domain = lambda e: F.substring_index(e["value"], "@", -1)
    found = candidates.select("cand_id", F.explode("emails").alias("e")).select("cand_id", domain(F.col("e")).alias("domain")).distinct()
    told = found.join(domains, "domain").groupBy("cand_id").agg(F.map_from_entries(F.collect_list(F.struct("domain", "has_mx"))).alias("mx"))
    mx = lambda e: F.coalesce(F.try_element_at(F.col("mx"), domain(e)), e["domain_has_mx"])
    emails = F.transform("emails", lambda e: e.withField("domain_has_mx", mx(e)))
    return candidates.join(told, "cand_id", "left").withColumn("emails", emails).drop("mx")


def merge_twice(candidates: DataFrame, save: Save) -> tuple[DataFrame, DataFrame]:
    """(candidates and the addresses inferred for their groups as candidates of their own, groups: cand_id, group_id).

    Groups by shared addresses, profiles, and name with position. A named group without an address gets the one that its
    entity's first personal address suggests, labelled as inferred; groups with equal ones become one.
    """
    keys = save(resolve.candidate_keys(candidates))
    everyone = candidates.select("cand_id")
    groups = resolve.resolve(keys, save)
    groups = save(everyone.join(groups, "cand_id", "left").select("cand_id", F.coalesce("group_id", "cand_id").alias("group_id")))
    rows = candidates.join(groups, "cand_id")
    named = F.min_by(F.nullif("full_name", F.lit("")), F.when(F.nullif("full_name", F.lit("")).isNotNull(), F.col("ord")))
    heads = rows.groupBy("entity_id", "group_id").agg(named.alias("full_name"), F.max(F.size("emails")).alias("mails"), F.max("ord").alias("ord"))
    persons = heads.where("full_name is not null and mails < 1").select(F.col("group_id").alias("person_id"), "entity_id", "full_name")
    known = candidates.select("entity_id", "ord", F.posexplode("emails").alias("nth", "e"))
    generic = F.coalesce(F.col("e.generic"), F.lit(False)) | norm.is_generic(F.col("e.value"))
    known = known.select("entity_id", F.struct("ord", "nth").alias("ord"), norm.email(F.col("e.value")).alias("value"), generic.alias("generic"))
    made = save(research.infer_emails(persons, known).select(F.col("person_id").alias("group_id"), "value", "status", "confidence").join(heads.select("entity_id", "group_id", "ord"), "group_id"))
    mail = F.struct("value", F.lit(False).alias("generic"), F.lit("unknown").alias("deliverability"), F.col("confidence").cast("int").alias("confidence"), "status", F.lit(None).cast("boolean").alias("domain_has_mx"))
    empty = {name: F.array().cast(f"array<{kind}>").alias(name) for name, kind in LISTS.items()} | {"emails": F.array(mail).alias("emails")}
    none = F.lit(None).cast("string")
    more = made.select("entity_id", (-1 - F.col("group_id")).alias("cand_id"), "ord", none.alias("full_name"), none.alias("position"), *empty.values())
    own = made.select((-1 - F.col("group_id")).alias("cand_id"), "group_id")
    touched = made.select("entity_id", "group_id", F.concat(F.lit("email:"), "value").alias("key"))
    after = merge_again(groups.unionByName(own), keys, touched, save)
    return candidates.unionByName(more), save(after)


def contacts(
    candidates: DataFrame, run_ts: Column, target_roles: Sequence[str], save: Save, domains: DataFrame | None = None, least: int = 35, most: int = 5, shown: int | None = SHOWN, wanted: Column | None = None
) -> DataFrame:
    """entity_id, group_id, full_name, position, the lists of ``listed``, score, score_reasons, usable, rank.

    ``rank`` is the contact's place among the selected ones of its entity; null where it is not selected. Contacts are
    selected before anything is listed; with ``wanted``, a condition on a contact without its lists, only those that it holds
    for have lists and their counts, and they are null for the others.
    """
    every, groups = merge_twice(candidates, save)
    every = with_mx(every, domains) if domains is not None else every
    general = lambda e: F.coalesce(e["generic"], F.lit(False)) | norm.is_generic(norm.email(e["value"]))
    asked = {"general": F.exists("emails", general), "site": F.exists("evidence", lambda e: e["source"] == "website")}
    merged = resolve.combine(every, groups, score.contact_facts() | asked)
    scored = score.apply_rules(merged, score.contact_rules(run_ts, target_roles)).withColumn("usable", score.usable(least))
    scored = save(scored.select("entity_id", "group_id", "full_name", "position", "ord", "score", "score_reasons", "usable", "generic", *asked))
    fit = fallback_groups(every, groups.join(scored.where("general and site").select("group_id"), "group_id", "left_semi"))
    facts = scored.join(fit.withColumn("fit", F.lit(True)), "group_id", "left")
    facts = facts.select("entity_id", F.col("group_id").alias("cand_id"), "score", "usable", F.coalesce("generic", F.lit(False)).alias("generic"), F.coalesce("fit", F.lit(False)).alias("fallback_ok"))
    chosen = save(research.select_candidates(save(facts), least, most).select(F.col("cand_id").alias("group_id"), "fallback", "rank"))
    out = scored.join(chosen, "group_id", "left")
    reasons = F.when(F.col("fallback"), F.concat("score_reasons", F.array(F.lit("fallback: general address of the official site")))).otherwise(F.col("score_reasons"))
    out = out.withColumn("score_reasons", reasons).drop("fallback", "generic", *asked)
    own = groups if wanted is None else groups.join(save(out.where(wanted).select("group_id")), "group_id", "left_semi")
    lists = listed(every, own, shown)
    rest = [c for c in out.columns if c not in ("entity_id", "group_id")]
    return save(out.join(lists, "group_id", "left").select("entity_id", "group_id", *rest, *(c for c in lists.columns if c != "group_id")))


def display_key() -> Column:
    """What a report tells contacts apart by: first address, phone, profile, else name and position."""
    filled = lambda c: F.nullif(c, F.lit(""))
    first = lambda c: filled(F.try_element_at(c, F.lit(1)))
    name = F.concat(F.coalesce("full_name", F.lit("")), F.lit("|"), F.coalesce("position", F.lit("")))
    return F.coalesce(filled(F.try_element_at("emails", F.lit(1))["value"]), first("phones"), first("social_urls"), name)


def rejected(found: DataFrame) -> DataFrame:
    """Contacts that were not selected, and whose key no selected contact of their entity has."""
    rows = found.withColumn("key", display_key())
    return rows.where("rank is null").join(rows.where("rank is not null").select("entity_id", "key").distinct(), ["entity_id", "key"], "left_anti").drop("key")


def totals(found: DataFrame) -> DataFrame:
    """One row of a run's totals over its contacts: distinct people, positions and channels, confidence, profiles by platform.

    Listed channels are counted, so ``found`` must list all of them; nothing is counted approximately.
    """
    person = F.when(F.col("full_name").isNotNull(), F.concat_ws(":", "entity_id", F.lower("full_name")))
    place = F.when(F.col("full_name").isNotNull() & F.col("position").isNotNull(), F.concat_ws(":", "entity_id", F.lower("full_name"), F.lower("position")))
    heads = found.agg(
        F.count("*").alias("candidates"), F.count("rank").alias("selected"), F.count_distinct(person).alias("people"), F.count_distinct(place).alias("positions"),
        F.count_if(F.col("score") >= 75).alias("high"), F.count_if((F.col("score") >= 45) & (F.col("score") < 75)).alias("medium"), F.count_if(F.col("score") < 45).alias("low"),
    )
    mails = found.select("entity_id", F.explode("emails").alias("e")).select("entity_id", "e.*")
    inferred = F.col("status").eqNullSafe("inferred")
    key = F.concat_ws(":", "entity_id", "value")
    mails = mails.agg(F.count_distinct(F.when(~inferred, key)).alias("emails"), F.count_distinct(F.when(~inferred & ~F.col("generic"), key)).alias("personal"), F.count_distinct(F.when(inferred, key)).alias("inferred"))
    phones = found.select("entity_id", F.explode("phones").alias("phone")).agg(F.count_distinct("entity_id", "phone").alias("phones"))
    social = found.select("entity_id", F.explode("social_profiles").alias("p")).select("entity_id", "p.*").distinct().groupBy("platform").agg(F.count("*").alias("n"))
    social = social.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("profiles"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "n")))).alias("by_platform"))
    return heads.join(mails).join(phones).join(social)  # one row each
