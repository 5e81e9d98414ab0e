"""Registered queries on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm
from contactry.operators import dedup, extract, resolve, score, state
from contactry.storage import store

RUN_TS = "2024-02-01 00:00:00"
#: Words of the synthetic texts, in place of the default lexicons.
TERMS = {"intent": ("tion ", "the "), "fit": ("ing", "and"), "strong": ("rights", "licensed"), "negative": ("###", "***")}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def emails_in_documents(spark, d):
    rows = _t(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", "source", F.explode(extract.emails(F.col("text"))).alias("email"))
    return rows.select("doc_id", "email", norm.is_generic(F.col("email")).alias("generic"), F.when(F.col("source").isin(*lex.OFFICIAL_SOURCES), 95).otherwise(75).alias("confidence"))


def phones_in_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(extract.phones(F.col("text"))).alias("phone"))


def url_parts(spark, d):
    u = norm.url(F.col("url"))
    return _t(spark, d, "pages").select("page_id", u.alias("normal"), norm.domain(u).alias("domain"), norm.path(u).alias("path"))


def fingerprint_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", norm.fingerprint(F.col("text")).alias("fingerprint"))


def truncate_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", norm.truncate(F.col("text"), 120).alias("short"))


def fnv_sources(spark, d):
    return _t(spark, d, "documents").select("doc_id", norm.fnv1a(F.concat(F.lit("2024-02-01:"), F.col("source"))).alias("hash"))


def freshness_days(spark, d):
    days = norm.age_days(F.col("ts"), F.lit(RUN_TS).cast("timestamp"))
    return _t(spark, d, "events").select("event_id", F.floor(days).cast("long").alias("days"))


def page_text(spark, d):
    return _t(spark, d, "pages").select("page_id", extract.page_title(F.col("html")).alias("title"), extract.page_text(F.col("html")).alias("text"))


def _links(spark, d):
    return extract.page_links(_t(spark, d, "pages"))


def page_links(spark, d):
    return _links(spark, d)


def top_links_per_page(spark, d):
    """Links of pages whose paths from a to t are moved below /team, so that they are useful ones."""
    pages = _t(spark, d, "pages").withColumn("html", F.regexp_replace("html", 'href="/([a-t])', 'href="/team/$1'))
    rows = extract.in_site(extract.page_links(pages)).groupBy("page_id", "link").agg(F.min("ord").alias("ord"))
    rows = rows.withColumn("score", extract.link_score(F.col("link")))
    return dedup.top_k(rows, ["page_id"], [F.desc("score"), "ord"], 3, "rank").select("page_id", "link", "score", "rank")


def robots_filter(spark, d):
    rules = _t(spark, d, "pages").select(norm.domain(F.col("url")).alias("rule_host")).distinct().withColumn("prefix", F.explode(F.array(F.lit("/a"), F.lit("/p"), F.lit("/"))))
    return extract.allowed_by_robots(_links(spark, d), rules).select("page_id", "ord", "link")


def first_wins_dedup(spark, d):
    docs = _t(spark, d, "documents").withColumn("key", norm.fingerprint(F.col("text")))
    best = docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return best.select("doc_id", "key", "copies")


def union_evidence(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars"))
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("chars"))
    talk = _t(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.length("text").cast("long").alias("chars"))
    rows = dedup.union_streams(("documents", docs), ("pages", pages), ("conversations", talk))
    return rows.groupBy("stage").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


def provider_status(spark, d):
    docs = _t(spark, d, "documents")
    used = F.bool_or(F.length("text") > 20_000)
    return docs.groupBy("source").agg(F.when(used, "used").otherwise("failed").alias("status"), F.count("*").alias("results"))


def term_windows(spark, d):
    terms = ["rights reserved", "licensed under"]
    rows = extract.windows_around(_t(spark, d, "documents"), terms, 20)
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("places"), F.min("at").alias("first_at"))


def allowlist_semi_join(spark, d):
    docs, marks = _t(spark, d, "documents"), _t(spark, d, "labels").where("quality = 1 and toxic = 0")
    return docs.join(marks, "doc_id", "left_semi").select("doc_id", "source")


def _candidates(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", extract.emails(F.col("text")).alias("mails"), extract.phones(F.col("text")).alias("phones"))
    docs = docs.where("size(mails) + size(phones) > 0")
    return docs.select(
        F.col("source").alias("entity_id"),
        F.col("doc_id").alias("cand_id"),
        F.col("doc_id").alias("ord"),
        F.lit(None).cast("string").alias("full_name"),
        F.lit(None).cast("string").alias("position"),
        F.transform("mails", lambda m: F.struct(*[
            m.alias("value"), norm.is_generic(m).alias("generic"), F.lit("unknown").alias("deliverability"), F.lit(75).alias("confidence"),
            F.when(norm.is_generic(m), "general").otherwise("found").alias("status"), F.lit(None).cast("boolean").alias("domain_has_mx"),
        ])).alias("emails"),
        "phones",
        F.array().cast("array<string>").alias("social_urls"),
        F.array(F.struct(F.col("source").alias("source"), F.col("doc_id").cast("string").alias("url"), F.lit(RUN_TS).cast("timestamp").alias("published_at"))).alias("evidence"),
    )


def _groups(spark, d):
    found = store(_candidates(spark, d))
    return found, resolve.resolve(resolve.candidate_keys(found, with_phones=True), store)


def resolve_components(spark, d):
    return _groups(spark, d)[1]


def best_email(spark, d):
    found, groups = _groups(spark, d)
    rows = found.join(groups, "cand_id").select("group_id", "ord", F.explode("emails").alias("e")).select("group_id", "ord", "e.*")
    return resolve.best_emails(rows).select("group_id", "value", "status", "generic", F.col("confidence").cast("long").alias("confidence"))


def _scored(spark, d):
    found, groups = _groups(spark, d)
    found = found.withColumn("social_profiles", F.array().cast("array<struct<platform:string,kind:string>>"))
    merged = resolve.combine(found, groups, score.contact_facts())
    return score.apply_rules(merged, score.contact_rules(F.lit(RUN_TS).cast("timestamp")))


def contact_scores(spark, d):
    return _scored(spark, d).select("entity_id", "group_id", "n_phones", "score")


def top_contacts_per_source(spark, d):
    rows = _scored(spark, d).where(score.usable(10))
    return dedup.top_k(rows, ["entity_id"], [F.desc("score"), "ord"], 5, "rank").select("entity_id", "group_id", "score", "rank")


def confidence_buckets(spark, d):
    s = _scored(spark, d)
    return s.agg(F.count_if(F.col("score") >= 75).alias("high"), F.count_if((F.col("score") >= 45) & (F.col("score") < 75)).alias("middle"), F.count_if(F.col("score") < 45).alias("low"))


def _demand(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", "text", F.concat(F.lit("https://"), F.col("source"), F.lit(".example/"), F.col("doc_id") % 500).alias("url"))
    docs = docs.withColumns({"days": (F.col("doc_id") % 60).cast("double"), "author": F.when(F.col("doc_id") % 2 == 0, F.col("source")), "intent": F.when(F.col("lang") == "en", "tender").otherwise("other"), "channels": F.when(F.contains("text", F.lit("@")), 1).otherwise(0)})
    return score.with_fingerprint(score.demand_score(docs, TERMS))


def demand_scores(spark, d):
    return _demand(spark, d).select("doc_id", "n_intent", "n_fit", "n_strong", "n_negative", "score")


def top_signals(spark, d):
    best = dedup.first_wins(_demand(spark, d).where("score >= 25"), ["fingerprint"], [F.desc("score"), "doc_id"])
    return best.orderBy(F.desc("score"), "doc_id").limit(120).select("fingerprint", "doc_id", "score")


def signal_upsert(spark, d):
    best = dedup.first_wins(_demand(spark, d), ["fingerprint", F.col("doc_id") % 2], [F.desc("score"), "doc_id"])
    rows = best.select("doc_id", "fingerprint", "score", F.col("doc_id").alias("first_seen_at"), F.col("lang").alias("status"))
    return state.upsert(rows.where("doc_id % 2 = 0").drop("doc_id"), rows.where("doc_id % 2 = 1").drop("doc_id"))


def review_decisions(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("pending").alias("decision"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("synced_at"))
    told = _t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("unknown").alias("wanted"))
    return state.decide(rows, told).groupBy("decision").agg(F.count("*").alias("n"), F.count("synced_at").alias("synced"))


def lead_queue(spark, d):
    leads, people = _t(spark, d, "orders"), _t(spark, d, "customer")
    found = leads.where("o_orderstatus = 'O'").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    return found.orderBy("o_orderkey").limit(100).select("o_orderkey", F.coalesce(F.nullif(F.trim("c_name"), F.lit("")), F.lit("unnamed")).alias("company"), "c_mktsegment")


def query_matrix(spark, d):
    forms = ["contacts {}", "{} team", "{} press service", "{} tender"]
    made = F.array(*(F.struct(F.lit(i).alias("nth"), F.concat(F.lit(f.split("{}")[0]), F.col("c_name"), F.lit(f.split("{}")[1])).alias("query")) for i, f in enumerate(forms)))
    return _t(spark, d, "customer").select("c_custkey", F.explode(made).alias("q")).select("c_custkey", "q.nth", "q.query")


def rejected_contacts(spark, d):
    docs, marks = _t(spark, d, "documents"), _t(spark, d, "labels").where("toxic = 0")
    return docs.join(marks, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("rejected"))


def run_totals(spark, d):
    docs = _t(spark, d, "documents")
    return docs.agg(F.count("*").alias("results"), F.count_distinct("source").alias("sources"), F.count_distinct(F.when(F.col("lang") == "en", F.lower("source"))).alias("en_sources"), F.sum("n_chars").alias("chars"))


def customer_initials(spark, d):
    return _t(spark, d, "customer").select("c_custkey", norm.initials(F.regexp_replace("c_name", "#", " ")).alias("initials"))


QUERIES = {
    f.__name__: f
    for f in (
        emails_in_documents, phones_in_documents, url_parts, fingerprint_documents, truncate_texts, fnv_sources, freshness_days,
        page_text, page_links, top_links_per_page, robots_filter, first_wins_dedup, union_evidence, provider_status, term_windows,
        allowlist_semi_join, resolve_components, best_email, contact_scores, top_contacts_per_source, confidence_buckets,
        demand_scores, top_signals, signal_upsert, review_decisions, lead_queue, query_matrix, rejected_contacts,
        run_totals, customer_initials,
    )
}
