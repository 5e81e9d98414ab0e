"""The plan of CRM actions: matches with known contacts, actions per candidate and lead, review state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTE = 9500


def channels(df: DataFrame, id_: str) -> DataFrame:
    """id, key: every email and phone of a row (emails, phones) as a key."""
    keys = F.concat(F.transform("emails", lambda e: F.concat(F.lit("e:"), e)), F.transform("phones", lambda p: F.concat(F.lit("p:"), p)))
    return df.select(id_, F.explode(keys).alias("key")).distinct()


def match_contacts(candidates: DataFrame, contacts: DataFrame) -> DataFrame:
    """cand_id, contact_id: the first contact that shares an email or a phone."""
    first = channels(contacts, "contact_id").groupBy("key").agg(F.min("contact_id").alias("contact_id"))
    return channels(candidates, "cand_id").join(first, "key").groupBy("cand_id").agg(F.min("contact_id").alias("contact_id"))


def exportable(emails, status):
    """Addresses that may leave: not inferred (a missing status counts as not inferred)."""
    return F.filter(emails, lambda e: ~F.coalesce(status(e) == "inferred", F.lit(False)))


def note_text(run_id: str):
    """The note of a candidate row (company, label, position, score, channels, reasons, sources); blank lines go."""
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    lines = F.concat_ws(
        "\n", F.lit(f"[{run_id}]"), line("Company: ", F.col("company")), line("Contact: ", F.col("label")), line("Position: ", F.col("position")),
        F.concat(F.lit("Score: "), F.col("score").cast("string"), F.lit("/100")), line("Channels: ", F.array_join("channels", ", ")),
        line("Reasons: ", F.array_join("reasons", "; ")), line("Sources:\n", F.array_join(F.transform(F.array_distinct("sources"), lambda s: F.concat(F.lit("- "), s)), "\n")),
    )
    return F.when(F.length(lines) > NOTE, F.concat(F.left(lines, F.lit(NOTE - 1)), F.lit("…"))).otherwise(lines)


def action_plan(leads: DataFrame, candidates: DataFrame, matches: DataFrame, mode: str = "enrich", task: bool = True, success_status: int | None = None) -> DataFrame:
    """lead_id, cand_id (null: of the lead), step, type, status, detail of the planned actions; nothing is carried out.

    leads (lead_id, linked: contact ids), candidates (lead_id, cand_id, label), matches (cand_id, contact_id).
    """
    rows = candidates.join(matches, "cand_id", "left").join(leads, "lead_id")
    known = F.col("contact_id").isNotNull()
    linked = known & F.array_contains("linked", F.col("contact_id"))
    told = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    label, lead, contact = F.col("label"), F.col("lead_id"), F.col("contact_id")
    pair = lambda step, kind, detail, status: F.struct(F.lit(step).alias("step"), kind.alias("type"), status.alias("status"), detail.alias("detail"))
    planned = F.lit("planned")
    steps = [pair(1, F.when(known, "reuse_contact").otherwise("create_contact"), F.when(known, told(label, " -> contact #", contact)).otherwise(label), planned)]
    if mode == "enrich":
        steps.append(pair(2, F.when(linked, "skip").otherwise("link_contact"), F.when(linked, told("contact #", contact, " is linked to lead #", lead)).otherwise(told(label, " -> lead #", lead)), F.when(linked, "skipped").otherwise(planned)))
        steps.append(pair(3, F.lit("create_note"), told("source and score of ", label), planned))
    else:
        steps.append(pair(2, F.lit("create_lead"), told("new lead: ", label), planned))
        steps.append(pair(3, F.lit("create_note"), F.lit("sources -> planned new lead"), planned))
    own = rows.select("lead_id", "cand_id", F.explode(F.array(*steps)).alias("a")).select("lead_id", "cand_id", "a.*")
    held = leads.select("lead_id").join(candidates.groupBy("lead_id").agg(F.count("*").alias("held")), "lead_id", "left")
    some = F.col("held").isNotNull()
    last = [F.when(~some, pair(6, F.lit("skip"), F.lit("no fitting contact"), F.lit("skipped")))]
    if task:
        last.append(F.when(some, pair(4, F.lit("create_task"), told("task in lead #", lead), planned)))
    if success_status is not None:
        last.append(F.when(some, pair(5, F.lit("move_source_lead"), told("lead #", lead, f" -> status #{success_status}"), planned)))
    per_lead = held.select("lead_id", F.lit(None).cast("long").alias("cand_id"), F.explode(F.array_compact(F.array(*last))).alias("a")).select("lead_id", "cand_id", "a.*")
    return own.unionByName(per_lead)


def mark_synced(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows (id, synced_at, ...) with the time of ``done`` (id, at) where they were not synced before."""
    return rows.join(done, "id", "left").withColumn("synced_at", F.coalesce("synced_at", "at")).drop("at")


def approved_queue(rows: DataFrame, limit: int) -> DataFrame:
    """Approved rows that are not synced, oldest first."""
    return rows.where("decision = 'approved' and synced_at is null").orderBy("created_at", "id").limit(limit)


def by_lead(actions: DataFrame) -> DataFrame:
    """lead_id, actions, failed: a lead fails if any of its actions did."""
    return actions.groupBy("lead_id").agg(F.count("*").alias("actions"), F.bool_or(F.col("status") == "failed").alias("failed"))


#: What the review views show: their order, and how many rows.
REVIEW = {
    "runs": (("started_at",), 50), "companies": (("created_at",), 500), "candidates": (("created_at",), 200), "demand_runs": (("started_at",), 30), "signals": (("score", "last_seen_at"), 300),
}


def review(rows: DataFrame, view: str, key: str) -> DataFrame:
    """The latest rows of a view, or its best; ties by the larger key."""
    order, limit = REVIEW[view]
    return review_lists(rows, [F.desc(c) for c in (*order, key)], limit)


def asked(*streams: DataFrame) -> DataFrame:
    """query: what several providers were asked, each once."""
    out = streams[0].select("query")
    for s in streams[1:]:
        out = out.union(s.select("query"))
    return out.distinct()


def enrichment_counts(pages: DataFrame, steps: DataFrame) -> DataFrame:
    """entity_id, attempted, succeeded, failed: profiles that were tried, those that gave a page, and the others, never below none."""
    done = pages.groupBy("entity_id").agg(F.count("*").alias("succeeded"))
    rows = steps.groupBy("entity_id").agg(F.sum("attempted").alias("attempted")).join(done, "entity_id", "left").fillna(0, ["succeeded"])
    return rows.withColumn("failed", F.greatest(F.lit(0).cast("long"), F.col("attempted") - F.col("succeeded")))


def review_lists(rows: DataFrame, order: list, limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def set_status(rows: DataFrame, told: DataFrame, allowed: tuple[str, ...] = ("new", "qualified", "dismissed")) -> DataFrame:
    """rows (id, status, ...) after told (id, wanted): only allowed values count."""
    fit = told.where(F.col("wanted").isin(*allowed))
    return rows.join(fit, "id", "left").withColumn("status", F.coalesce("wanted", "status")).drop("wanted")


def safe_file_date(c):
    """A time as part of a file's name."""
    return F.regexp_replace(c, "[:.]", "-")


def note_rows(contacts: DataFrame, run_id: str) -> DataFrame:
    """entity_id, group_id, note of contacts (company, full_name, position, score, score_reasons and lists): inferred addresses never leave."""
    safe = exportable(F.col("emails"), lambda e: e["status"])
    status = lambda e: F.coalesce(e["status"], F.when(e["generic"], "general").otherwise("found"))
    sure = lambda e: F.when(e["confidence"] > 0, F.concat(F.lit(", "), e["confidence"].cast("string"), F.lit("%"))).otherwise("")
    told = F.transform("safe", lambda e: F.concat(e["value"], F.lit(" ("), status(e), F.lit(", "), e["deliverability"], sure(e), F.lit(")")))
    rows = contacts.withColumn("safe", safe)
    filled = lambda c: F.nullif(c, F.lit(""))
    label = F.coalesce(filled(F.col("full_name")), F.try_element_at("safe", F.lit(1))["value"], F.try_element_at("phones", F.lit(1)), F.try_element_at("social_urls", F.lit(1)), F.lit("nameless contact"))
    rows = rows.withColumns({"label": label, "channels": F.concat(told, "phones", "social_urls"), "reasons": F.col("score_reasons"), "sources": F.transform("evidence", lambda e: e["url"])})
    return rows.select("entity_id", "group_id", note_text(run_id).alias("note"))


def escape_markdown(c):
    return F.trim(F.regexp_replace(c, "[|\\r\\n]+", " "))
