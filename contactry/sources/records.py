"""Landed records of CRM, CMS and social services: custom fields, CMS items, nested sitemaps, public profile pages, model answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm
from contactry.operators import extract
from contactry.sources.html import read_pages
from contactry.storage import store

NESTED = 10
URLS_PER_SITEMAP = 150
PROFILES = 12


def field_values(fields: Column, fits: Callable[[Column], Column]) -> Column:
    """Trimmed, non-blank values of the custom fields (id, code, type, name, values) that fit."""
    values = F.flatten(F.transform(F.filter(fields, lambda f: F.coalesce(fits(f), F.lit(False))), lambda f: f["values"]["value"]))
    return F.filter(F.transform(values, lambda v: F.trim(v.cast("string"))), lambda v: v != "")


def website(fields: Column, field_id: int | None = None, name: str = "(?iu)^(web|site|website|сайт)$") -> Column:
    """The first valid address among the fields with the given id, code WEB, type url, or such a name."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    fits = lambda f: yes(f["code"] == "WEB") | yes(f["type"] == "url") | yes(f["name"].rlike(name)) | (F.lit(False) if field_id is None else yes(f["id"] == field_id))
    return F.try_element_at(F.filter(F.transform(field_values(fields, fits), norm.url), lambda u: u.isNotNull()), F.lit(1))


def company_name(fields: Column, field_id: int) -> Column:
    return F.try_element_at(field_values(fields, lambda f: f["id"] == field_id), F.lit(1))


def lead_queue(leads: DataFrame, companies: DataFrame, pipeline: int, status: str, limit: int, name_field: int | None = None) -> DataFrame:
    """The oldest leads of a pipeline and status with their company: lead_id, lead_name, company_id, company, website, contact_ids.

    leads (id, pipeline_id, status_id, name, company_id, company_name: the link's, fields, contact_ids), companies (id, name,
    fields). The company's name is the company's own, else the link's, the lead's field, the lead's; blank ones do not count.
    """
    queue = leads.where((F.col("pipeline_id") == pipeline) & (F.col("status_id") == status)).orderBy("id").limit(limit)
    known = companies.select(F.col("id").alias("company_id"), F.col("name").alias("own_name"), F.col("fields").alias("own_fields"))
    rows = queue.join(known, "company_id", "left")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    given = [company_name(F.col("fields"), name_field)] if name_field is not None else []
    names = F.coalesce(filled("own_name"), filled("company_name"), *given, filled("name"))
    return rows.select(F.col("id").alias("lead_id"), F.col("name").alias("lead_name"), "company_id", names.alias("company"), website(F.col("own_fields")).alias("website"), F.coalesce("contact_ids", F.array().cast("array<long>")).alias("contact_ids"))


def manual_company(spark: SparkSession, name: str, site: str | None = None) -> DataFrame:
    """The one row of a company that is named by hand instead of by a lead."""
    row = spark.range(1).select(F.lit(None).cast("long").alias("lead_id"), F.lit(name).alias("lead_name"), F.lit(None).cast("long").alias("company_id"), F.lit(name).alias("company"), norm.url(F.lit(site)).alias("website"))
    return row.withColumns({"contact_ids": F.array().cast("array<long>"), "source": F.lit("manual")})


def _rendered(c: str) -> Column:
    """Text that is given plainly or as {rendered: text}; the JSON type decides, not what the text looks like."""
    v = F.col(c)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.rendered", "string"))


def cms_items(bodies: DataFrame) -> DataFrame:
    """site, ord, url, title, html, pdf of CMS answers (site, body: JSON array of posts, pages, users or media).

    title, content, caption and description are text or {rendered: text}; ``pdf`` is the address of a PDF, for the frontier.
    Bodies that are no JSON array give no rows, and items without an address are dropped.
    """
    item = "array<struct<link:string,url:string,source_url:string,name:string,title:variant,content:variant,caption:variant,description:variant>>"
    rows = bodies.select("site", F.posexplode(F.from_json("body", item)).alias("ord", "i")).select("site", "ord", "i.*")
    url = norm.url(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("link", "url", "source_url"))))
    parts = (F.nullif(_rendered(c), F.lit("")) for c in ("content", "caption", "description"))
    pdf = F.when(F.col("source_url").rlike("(?i)[.]pdf($|[?])"), F.col("source_url"))
    return rows.select(
        "site", F.col("ord").cast("long").alias("ord"), url.alias("url"), F.coalesce(_rendered("title"), F.col("name")).alias("name"),
        F.concat_ws(" ", *parts).alias("html"), pdf.alias("pdf"),
    ).where("url is not null")


def cms_pages(bodies: DataFrame) -> DataFrame:
    """The items of ``cms_items`` read as pages: site, ord, url, pdf, title, text, emails, phones, social_urls, source."""
    pages = read_pages(cms_items(bodies))
    title = F.coalesce("name", "title")
    return pages.select("site", "ord", "url", "pdf", title.alias("title"), "text", "emails", "phones", "social_urls", F.lit("wordpress").alias("source"))


def sitemap_order(roots: DataFrame, entries: DataFrame, most: int = NESTED) -> DataFrame:
    """site, place, sitemap: the sitemaps of a site in the order in which they are read, each once.

    roots (site, ord, sitemap): those a site names itself. entries (site, sitemap, ord, nested, url): what each sitemap
    lists. The first ``most`` nested ones of a sitemap queue up behind those known before; the queue ends after ``most``
    places, and a sitemap that comes again (a cycle) takes a place but is not read again. Every round follows one level of all
    sites at once, so there are at most ``most`` rounds, on at most ``most`` rows a site.
    """
    by_site = lambda *order: F.row_number().over(W.partitionBy("site").orderBy(*order)) - 1
    nested = entries.where("nested").select("site", "sitemap", "ord", "url")
    nth = F.row_number().over(W.partitionBy("site", "sitemap").orderBy("ord"))
    nested = store(nested.withColumn("nth", nth).where(F.col("nth") <= most), "nested")
    level = store(roots.withColumn("place", by_site("ord")).where(F.col("place") < most).select("site", "place", "sitemap"), "level")
    queue = level
    for _ in range(most):
        known = queue.groupBy("site", "sitemap").agg(F.min("place").alias("place"))
        children = level.join(known, ["site", "place", "sitemap"], "left_semi").join(nested, ["site", "sitemap"])
        taken = queue.groupBy("site").agg(F.count("*").alias("taken"))
        children = children.withColumn("behind", by_site("place", "ord")).join(taken, "site")
        place = (F.col("behind") + F.col("taken")).cast("int")
        level = store(children.select("site", place.alias("place"), F.col("url").alias("sitemap")).where(F.col("place") < most), "level")
        if level.isEmpty():
            break
        queue = queue.unionByName(level)
    return queue.groupBy("site", "sitemap").agg(F.min("place").alias("place")).select("site", "place", "sitemap")


def expand_sitemaps(roots: DataFrame, entries: DataFrame, per_sitemap: int = URLS_PER_SITEMAP, most: int = NESTED) -> DataFrame:
    """site, place, sitemap, url, score, rank: the useful pages of the sitemaps of ``sitemap_order``, the best of each by link score."""
    pages = sitemap_order(roots, entries, most).join(entries.where("not nested").select("site", "sitemap", "ord", "url"), ["site", "sitemap"])
    pages = pages.where(extract.fits(F.col("url"), lex.USEFUL_PATH)).withColumn("url", norm.url(F.col("url"))).where("url is not null")
    rank = F.row_number().over(W.partitionBy("site", "place").orderBy(F.desc("score"), "ord"))
    return pages.withColumn("score", extract.link_score(F.col("url"))).withColumn("rank", rank).where(F.col("rank") <= per_sitemap).drop("ord")


def public_page(platform: Column, url: Column) -> Column:
    """Where a profile can be read without an account: a channel's preview; invitations have none."""
    name = norm.username(url)
    return F.when(platform == "telegram", F.when(~norm.path(url).rlike("^/(joinchat|\\+)") & (name != ""), F.concat(F.lit("https://t.me/s/"), name))).otherwise(url)


def profiles_to_read(profiles: DataFrame, most: int = PROFILES) -> DataFrame:
    """entity_id, ord, page: the first profiles of an entity, distinct by platform and address, with their public page."""
    first = profiles.groupBy("entity_id", "platform", F.lower("url").alias("low")).agg(F.min("ord").alias("ord"), F.min_by("url", "ord").alias("url"))
    nth = F.row_number().over(W.partitionBy("entity_id").orderBy("ord", "low"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select("entity_id", "ord", public_page(F.col("platform"), F.col("url")).alias("page"))


def validated_answers(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, urls, emails of model answers that hold: evidence addresses, and emails that stand in the evidence.

    answers (answer_id, entity_id, urls, emails), evidence (entity_id, url, text). An answer without an address or
    without an email that holds goes.
    """
    known = evidence.select("entity_id", F.explode(extract.emails(F.col("text"))).alias("email")).distinct()
    urls = answers.select("answer_id", "entity_id", F.explode(F.array_distinct("urls")).alias("url")).join(evidence.select("entity_id", "url").distinct(), ["entity_id", "url"], "left_semi")
    mails = answers.select("answer_id", "entity_id", F.explode(F.array_distinct(F.transform("emails", norm.email))).alias("email")).join(known, ["entity_id", "email"], "left_semi")
    held = urls.groupBy("answer_id").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    return held.join(mails.groupBy("answer_id").agg(F.array_sort(F.collect_list("email")).alias("emails")), "answer_id")


ANSWER_SOCIAL = "(?i)t\\.me|telegram|vk\\.com|linkedin|threads\\.net|tenchat"


def model_contacts(answers: DataFrame, evidence: DataFrame, snippet: int = 2000) -> DataFrame:
    """entity_id, answer_id, full_name, position, emails, phones, social_urls, urls of a model's contacts, as far as the sources bear them out.

    answers (entity_id, answer_id, full_name, position, emails, phones, social_urls, urls), evidence (entity_id, url, title,
    snippet). Addresses of sources must be given ones; emails and profiles must stand in the sources' texts, as they were
    shown (cut to ``snippet``). Contacts without a source, or without any channel left, go.
    """
    shown = evidence.select("entity_id", "url", F.concat_ws("\n", "url", "title", norm.truncate(F.coalesce("snippet", F.lit("")), snippet)).alias("text"))
    links = F.filter(F.regexp_extract_all("text", F.lit("(?i)https?://[^\\s)\\]>'\"]+"), F.lit(0)), lambda u: u.rlike(ANSWER_SOCIAL))
    known = {
        "urls": shown.select("entity_id", F.col("url").alias("x")), "emails": shown.select("entity_id", F.explode(extract.emails(F.col("text"))).alias("x")), "social_urls": shown.select("entity_id", F.explode(links).alias("x")),
    }
    wanted = {"urls": F.col("urls"), "emails": F.transform("emails", norm.email), "social_urls": F.col("social_urls")}
    held = None
    for name, allowed in known.items():
        rows = answers.select("entity_id", "answer_id", F.lit(name).alias("list"), F.posexplode(F.array_distinct(wanted[name])).alias("nth", "x"))
        rows = rows.join(allowed.distinct(), ["entity_id", "x"], "left_semi")
        held = rows if held is None else held.unionByName(rows)
    part = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.struct("nth", "x")))), lambda s: s["x"]).alias(name)
    lists = held.groupBy("entity_id", "answer_id").agg(*(part(name) for name in known))
    phones = F.filter(F.array_distinct(F.transform(F.coalesce("phones", F.array().cast("array<string>")), norm.phone)), lambda x: x != "")
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = answers.select("entity_id", "answer_id", filled("full_name").alias("full_name"), filled("position").alias("position"), phones.alias("phones")).join(lists, ["entity_id", "answer_id"])
    return out.where((F.size("urls") > 0) & (F.size("emails") + F.size("phones") + F.size("social_urls") > 0))


def within_budgets(queries: DataFrame, budgets: tuple[tuple[str, int], ...], order: str = "ord") -> DataFrame:
    """The first queries of every provider and run, as many as its budget."""
    most = F.coalesce(*(F.when(F.col("provider") == name, n) for name, n in budgets), F.lit(0))
    nth = F.row_number().over(W.partitionBy("run_id", "provider").orderBy(order))
    return queries.withColumn("nth", nth).where(F.col("nth") <= most)
