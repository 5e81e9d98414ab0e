"""Explainable scores: tables of (points, reason, condition)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm

Rule = tuple[int | Column, str, Column]


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds score (0 to 100) and score_reasons, in the order of the rules."""
    points = reduce(lambda a, b: a + b, (F.when(cond, p).otherwise(0) for p, _, cond in rules))
    reasons = F.array_compact(F.array(*(F.when(cond, F.lit(reason)) for _, reason, cond in rules)))
    return df.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int"), "score_reasons": reasons})


def contact_facts() -> dict[str, Column]:
    """What the rules ask of a candidate's emails, phones, social_urls, social_profiles and evidence, as true or false."""
    mail = lambda f: F.exists("emails", f)
    on = lambda *p: F.exists("social_profiles", lambda s: s.platform.isin(*p))
    source = lambda *s: F.exists("evidence", lambda e: e.source.isin(*s))
    return {
        "official": source(*lex.OFFICIAL_SOURCES),
        "hunter": source("hunter"),
        "web": source(*lex.WEB_SOURCES),
        "mail": F.size("emails") > 0,
        "inferred": mail(lambda e: e.status.eqNullSafe("inferred")),
        "direct": mail(lambda e: ~F.coalesce(e.generic, F.lit(False)) & ~e.status.eqNullSafe("inferred")),
        "generic": mail(lambda e: F.coalesce(e.generic, F.lit(False))),
        "alive": mail(lambda e: ~e.deliverability.eqNullSafe("undeliverable")),
        "deliverable": mail(lambda e: e.deliverability.eqNullSafe("deliverable")),
        "no_mx": mail(lambda e: e.domain_has_mx.eqNullSafe(False)),
        "usable_mail": mail(lambda e: ~e.status.eqNullSafe("inferred") & ~e.deliverability.eqNullSafe("undeliverable")),
        "phone": F.size("phones") > 0,
        "telegram": on("telegram"),
        "professional": on("tenchat", "linkedin", "github"),
        "social": on("vk", "threads", "instagram"),
        "person": F.exists("social_profiles", lambda s: s.kind.eqNullSafe("person")),
        "social_url": F.size("social_urls") > 0,
    }


def contact_rules(run_ts: Column, target_roles: Sequence[str] = ()) -> list[Rule]:
    """Rules over a contact's columns: full_name, position, those of contact_facts, confidence, newest, several_urls."""
    named, placed = F.coalesce(F.col("full_name") != "", F.lit(False)), F.coalesce(F.col("position") != "", F.lit(False))
    wanted = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce("position", F.lit(""))), F.lit(r.lower())) for r in target_roles), F.lit(False))
    official, direct, generic, telegram = (F.col(c) for c in ("official", "direct", "generic", "telegram"))
    age = (F.unix_micros(run_ts) - F.unix_micros("newest")) / F.lit(86400000000.0)
    none = F.lit(False)
    return [
        (10, "+10 name", named),
        (5, "+5 position", placed),
        (20, "+20 name and position in an official source", named & placed & official),
        (20, "+20 target role", wanted),
        (40, "+40 direct email in an official source", direct & official),
        (25, "+25 direct email", direct & ~official),
        (10, "+10 general email", generic & ~direct),
        (-30, "-30 inferred email", F.col("inferred")),
        (20, "+20 deliverable email", F.col("deliverable")),
        (10, "+10 confidence", F.coalesce(F.col("confidence") >= 70, none)),
        (8, "+8 phone", F.col("phone")),
        (35, "+35 telegram in an official source", telegram & official),
        (20, "+20 telegram", telegram & ~official),
        (20, "+20 professional profile", F.col("professional")),
        (12, "+12 social profile", F.col("social")),
        (5, "+5 social link", ~F.col("social") & F.col("social_url")),
        (8, "+8 official source", official),
        (8, "+8 domain contacts", F.col("hunter")),
        (5, "+5 independent source", F.col("web")),
        (5, "+5 several sources", F.col("several_urls")),
        (-100, "-100 undeliverable", F.col("mail") & ~F.col("alive")),
        (-30, "-30 domain without MX", F.col("no_mx")),
        (10, "+10 fresh", F.coalesce(age <= 730, none)),
        (-20, "-20 stale", F.coalesce(age > 1460, none)),
    ]


def usable(min_score: int) -> Column:
    """Score reached, and an email that is neither inferred nor undeliverable, a phone, or a personal profile."""
    personal = F.col("social_url") & (F.col("full_name").isNotNull() | F.col("person"))
    return (F.col("score") >= min_score) & (F.col("usable_mail") | F.col("phone") | personal)


def term_count(text: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(t)).cast("int") for t in terms))


def _found(text: Column, terms: Sequence[str], most: int) -> Column:
    """The first terms that a text contains, in one line."""
    return F.array_join(F.slice(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)), 1, most), ", ")


def demand_score(df: DataFrame, lexicon: dict[str, Sequence[str]] | None = None, reasons: bool = False) -> DataFrame:
    """Adds score, and score_reasons if asked for, to rows with text, days (age, null if unknown), author, intent, channels (number of direct ones)."""
    words = {"intent": lex.INTENT_TERMS, "fit": lex.FIT_TERMS, "strong": lex.STRONG_TERMS, "negative": lex.NEGATIVE_TERMS} | (lexicon or {})
    low = F.lower("text")
    n = {k: F.col(f"n_{k}") for k in words}
    out = df.withColumns({f"n_{k}": term_count(low, v) for k, v in words.items()})
    grow = lambda k, top, base, each: F.when(n[k] > 0, F.least(F.lit(top), base + each * n[k])).otherwise(0)
    age = F.when(F.col("days") <= 3, 16).when(F.col("days") <= 14, 10).when(F.col("days") <= 45, 4).otherwise(0)
    points = (
        grow("intent", 35, 18, 5) + grow("fit", 30, 12, 4) + grow("strong", 25, 15, 5) - grow("negative", 50, 25, 10) + age
        + F.when(F.coalesce(F.col("author") != "", F.lit(False)), 5).otherwise(0)
        + F.when(F.col("intent").isin("tender", "vendor_search"), 8).otherwise(0)
        + F.when(F.col("channels") > 0, 12).otherwise(0)
    )
    out = out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int"))
    if not reasons:
        return out
    days, says = F.col("days"), lambda k, most: F.when(n[k] > 0, F.concat(F.lit(lex.DEMAND_REASONS[k]), _found(low, words[k], most)))
    fresh = F.when(days <= 3, lex.DEMAND_REASONS[3]).when(days <= 14, lex.DEMAND_REASONS[14]).when(days <= 45, lex.DEMAND_REASONS[45])
    told = (
        says("intent", 3), says("fit", 4), says("strong", 3), fresh,
        F.when(F.col("author") != "", lex.DEMAND_REASONS["author"]),
        F.when(F.col("intent").isin("tender", "vendor_search"), F.concat(F.lit(lex.DEMAND_REASONS["kind"]), F.col("intent"))),
        says("negative", 3), F.when(F.col("channels") > 0, lex.DEMAND_REASONS["channel"]),
    )
    return out.withColumn("score_reasons", F.array_compact(F.array(*told)))


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", norm.fingerprint(F.col("url")))
