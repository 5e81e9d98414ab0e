"""Reports as rows of lines: a run's or a radar's lines keep their order by (run_id, section, ord), and never meet in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crm

LINE = "run_id string, section int, entity_id string, ord long, line string"


def _told(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("—")) for p in parts))


def _lines(df: DataFrame, section: int, entity: Column, order: Column, line: Column) -> DataFrame:
    return df.select("run_id", F.lit(section).alias("section"), entity.cast("string").alias("entity_id"), order.cast("long").alias("ord"), line.alias("line"))


def channels(most: int = 20) -> Column:
    """A contact's channels in a cell: addresses with their status, phones, profiles."""
    status = lambda e: F.upper(F.coalesce(e["status"], F.when(e["generic"], "general").otherwise("found")))
    mails = F.transform("emails", lambda e: F.concat(e["value"], F.lit(" ["), status(e), F.lit("]")))
    return F.array_join(F.slice(F.concat(mails, "phones", "social_urls"), 1, most), "<br>")


def contact_name() -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(F.col("full_name")), F.try_element_at("emails", F.lit(1))["value"], F.try_element_at("phones", F.lit(1)), F.try_element_at("social_urls", F.lit(1)), F.lit("—"))


def shows_channels() -> Column:
    """Whether a report shows anything of a contact's lists: of selected ones their channels, of nameless ones the first."""
    return F.col("rank").isNotNull() | (F.coalesce("full_name", F.lit("")) == "")


def run_report(companies: DataFrame, contacts: DataFrame, actions: DataFrame) -> DataFrame:
    """Lines of a run: a table of companies, then for each its selected contacts, those below the threshold, warnings and actions.

    companies (run_id, entity_id, name, website, warnings), contacts (run_id, entity_id, group_id, full_name, position,
    emails, phones, social_urls, score, score_reasons, rank; lists only where ``shows_channels``), actions (run_id, entity_id, ord, type, status, detail).
    """
    key = ["run_id", "entity_id"]
    count = lambda df, **counts: df.groupBy(*key).agg(*(c.alias(n) for n, c in counts.items()))
    n = companies.join(count(contacts, found=F.count("*"), selected=F.count("rank")), key, "left").join(count(actions, failed=F.count_if(F.col("status") == "failed")), key, "left").fillna(0, ["found", "selected", "failed"])
    clean = crm.escape_markdown
    entity, none = F.col("entity_id"), F.lit("")
    site = F.when(F.col("website").isNotNull(), _told("[open](", F.col("website"), ")")).otherwise("—")
    heads = companies.select("run_id").distinct()
    table = _lines(n, 2, entity, F.lit(0), _told("| ", clean(F.col("name")), " | ", site, " | ", F.col("found"), " | ", F.col("selected"), " | ", F.col("failed"), " |"))
    title = _lines(heads, 0, none, F.lit(0), _told("# Contact search — ", F.col("run_id")))
    names = _lines(heads, 1, none, F.lit(0), F.lit("| Company | Site | Candidates | Selected | Failures |\n|---|---|---:|---:|---:|"))
    own = _lines(companies, 3, entity, F.lit(0), _told("## ", clean(F.col("name"))))
    fit = contacts.where("rank is not null")
    header = _lines(fit.select(*key).distinct(), 3, entity, F.lit(1), F.lit("| Contact | Position | Channels | Score |\n|---|---|---|---:|"))
    row = _told("| ", clean(contact_name()), " | ", clean(F.coalesce("position", F.lit("—"))), " | ", clean(channels()), " | ", F.col("score"), " |")
    base = 1_000_000_000_000  # lines of one kind stay together: the kind, then the place within it
    chosen = _lines(fit, 3, entity, F.col("rank") + 1, row)
    nobody = _lines(n.where("selected = 0"), 3, entity, F.lit(1), F.lit("No fitting contacts."))
    why = _told("- ", clean(contact_name()), " · ", F.coalesce("position", F.lit("no position")), " · ", F.col("score"), "/100 · ", F.array_join("score_reasons", "; "))
    below = _lines(contacts.where("rank is null"), 3, entity, F.lit(base) + F.lit(1000) * (100 - F.col("score")), why)
    told = companies.select(*key, F.posexplode("warnings").alias("nth", "w"))
    warned = _lines(told, 3, entity, F.lit(2 * base) + F.col("nth"), _told("- ", F.col("w")))
    done = _lines(actions, 3, entity, F.lit(3 * base) + F.col("ord"), _told("- ", F.col("status"), ": ", F.col("type"), " — ", F.col("detail")))
    out = title
    for part in (names, table, own, header, chosen, nobody, below, warned, done):
        out = out.unionByName(part)
    return out


def demand_report(signals: DataFrame, statuses: DataFrame, failures: DataFrame) -> DataFrame:
    """Lines of a demand run: providers, the table of signals by score, failures.

    signals (run_id, rank, score, intent, category, source, title, url, emails, phones, social_urls), statuses (run_id,
    provider, rank, status), failures (run_id, ord, provider, message).
    """
    clean = crm.escape_markdown
    runs, none = signals.select("run_id").unionByName(statuses.select("run_id")).distinct(), F.lit("")
    contacts = F.coalesce(F.nullif(F.array_join(F.concat("emails", "phones", "social_urls"), "<br>"), F.lit("")), F.lit("—"))
    row = _told("| ", F.col("score"), " | ", F.col("intent"), " / ", F.col("category"), " | ", F.col("source"), " | [", clean(F.col("title")), "](", F.col("url"), ") | ", clean(contacts), " |")
    out = _lines(runs, 0, none, F.lit(0), _told("# Demand radar — ", F.col("run_id")))
    for part in (
        _lines(statuses, 1, none, F.col("rank"), _told("- ", F.col("provider"), "=", F.col("status"))),
        _lines(runs, 2, none, F.lit(0), F.lit("| Score | Kind | Source | Signal | Contacts |\n|---:|---|---|---|---|")),
        _lines(signals, 3, none, F.col("rank"), row),
        _lines(failures, 4, none, F.col("ord"), _told("- ", F.col("provider"), ": ", F.col("message"))),
    ):
        out = out.unionByName(part)
    return out
