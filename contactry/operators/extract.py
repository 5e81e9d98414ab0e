"""Channels, links and text out of landed pages and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm


def emails(text: Column) -> Column:
    """Distinct normalised addresses in order; image names are no addresses."""
    found = F.transform(F.regexp_extract_all(text, F.lit(lex.EMAIL), F.lit(0)), norm.email)
    return F.filter(F.array_distinct(found), lambda e: ~e.rlike("\\.(png|jpe?g|gif|webp|svg)$"))


def phones(text: Column, least: int = 10) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(lex.PHONE), F.lit(0)), norm.phone)
    return F.filter(F.array_distinct(found), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= least)


def page_channels(text: Column, hrefs: Column, url: Column) -> tuple[Column, Column, Column]:
    """emails, phones and social_urls of a page: those of its mailto, tel and other links first, then those in its text."""
    scheme = lambda name: F.filter(hrefs, lambda h: F.startswith(F.lower(h), F.lit(name)))
    written = F.concat(F.transform(scheme("mailto:"), norm.email), F.transform(F.regexp_extract_all(text, F.lit(lex.EMAIL), F.lit(0)), norm.email))
    called = F.concat(F.transform(scheme("tel:"), lambda h: norm.phone(F.substring(h, 5, F.length(h)))), F.transform(F.regexp_extract_all(text, F.lit(lex.PHONE), F.lit(0)), norm.phone))
    places = F.filter(F.transform(hrefs, lambda h: norm.resolve(h, url)), lambda u: norm.platform(u).isNotNull())
    return (
        F.filter(F.array_distinct(written), lambda e: F.contains(e, F.lit("@")) & ~e.rlike("\\.(png|jpe?g|gif|webp|svg)$")).alias("emails"),
        F.filter(F.array_distinct(called), lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 10).alias("phones"),
        F.array_distinct(places).alias("social_urls"),
    )


def classify_email(address: Column, source: Column, url: Column) -> Column:
    generic = norm.is_generic(address)
    return F.struct(
        address.alias("value"),
        generic.alias("generic"),
        F.lit("unknown").alias("deliverability"),
        F.when(source.isin(*lex.OFFICIAL_SOURCES), 95).otherwise(75).alias("confidence"),
        F.when(generic, "general").otherwise("found").alias("status"),
        url.alias("evidence_url"),
    )


def page_title(html: Column) -> Column:
    raw = F.coalesce(F.nullif(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")), F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1))
    return F.trim(F.regexp_replace(F.regexp_replace(raw, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def page_text(html: Column) -> Column:
    text = F.regexp_replace(html, "(?is)<(script|style|noscript|svg|iframe|template)[^>]*>.*?</(script|style|noscript|svg|iframe|template)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " "))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, ord, link: hrefs resolved against the page, without fragments, in order."""
    href = F.regexp_extract_all("html", F.lit("(?i)href=[\"']([^\"'#]+)"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(href).alias("ord", "href"))
    return rows.select("page_id", "url", F.col("ord").cast("long").alias("ord"), norm.resolve(F.col("href"), F.col("url")).alias("link")).where("link is not null")


def fits(c: Column, pattern: str) -> Column:
    """Whether a pattern of ``lexicons`` occurs, also in letters that are not Latin."""
    return c.rlike("(?u)" + pattern)


def link_score(link: Column) -> Column:
    def points(p: Column) -> Column:
        worth = lambda c, n: F.when(c, n).otherwise(0)
        return worth(p == "/", 110) + worth(fits(p, lex.HIGH_VALUE_PATH), 100) + worth(fits(p, lex.USEFUL_PATH), 25) - F.size(F.split(p, "/"))

    return norm.let(norm.path(link), points).cast("long")


def in_site(links: DataFrame) -> DataFrame:
    """Links of the page's own host that are useful, by path or query, and not blocked."""
    rows = links.withColumn("way", norm.path(F.col("link")))
    useful = fits(F.concat("way", F.regexp_extract("link", "[?].*$", 0)), lex.USEFUL_PATH)
    return rows.where((norm.domain(F.col("url")) == norm.domain(F.col("link"))) & useful & ~fits(F.col("way"), lex.BLOCKED_PATH)).drop("way")


def allowed_by_robots(links: DataFrame, rules: DataFrame, honour_root: bool = False) -> DataFrame:
    """Drops links whose path starts with a disallowed prefix of their host; ``/`` only counts if asked for."""
    own = rules if honour_root else rules.where("prefix <> '/'")
    keyed = links.withColumns({"host": norm.domain(F.col("link")), "path": norm.path(F.col("link"))})
    return keyed.join(own, (keyed.host == own.rule_host) & F.startswith(keyed.path, own.prefix), "left_anti").drop("host", "path")


def robots_rules(lines: DataFrame) -> DataFrame:
    """host, line_no, line of robots files -> rule_host, prefix of the group for all agents."""
    from pyspark.sql import Window as W

    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    key, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    order = W.partitionBy("host").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    agent = F.last(F.when(key == "user-agent", value), ignorenulls=True).over(order)
    return clean.withColumns({"key": key, "value": value, "agent": agent}).where("agent = '*' and key = 'disallow' and value <> ''").select(F.col("host").alias("rule_host"), F.col("value").alias("prefix"))


def robots_sitemaps(lines: DataFrame) -> DataFrame:
    """host, line_no, line of robots files -> host, ord, sitemap: the sitemaps that a host names, in any group, each once and in order."""
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where(F.lower(F.trim(F.substring_index("line", ":", 1))) == "sitemap")
    value = F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    place = norm.resolve(value, F.concat(F.lit("https://"), F.col("host"), F.lit("/")))
    rows = clean.where(value != "").select("host", "line_no", place.alias("sitemap")).where("sitemap is not null")
    return rows.groupBy("host", "sitemap").agg(F.min("line_no").alias("ord")).select("host", "ord", "sitemap")


def windows_around(docs: DataFrame, terms: list[str], reach: int = 140) -> DataFrame:
    """The other columns of ``docs``, and term, at, window: each non-overlapping occurrence of a term with ``reach`` characters on each side.

    The places of a term are folded once over the text between them, into an array of numbers; windows are cut from the one
    text, so a text that is full of a term is not copied for every place. A text is put in lower case and parted once.
    """
    rest = [c for c in docs.columns if c != "text"]
    flat = F.regexp_replace("text", "[ \\t\\r\\n]+", " ")
    every = F.array(*(F.struct(F.lit(t).alias("term"), F.lower(F.lit(t)).alias("low")) for t in terms)).cast("array<struct<term:string,low:string>>")

    def parted(low: Column) -> Column:
        gaps = lambda t: F.transform(F.split(low, F.concat(F.lit("\\Q"), t["low"], F.lit("\\E"))), F.length)
        return F.transform(F.filter(every, lambda t: F.contains(low, t["low"])), lambda t: F.struct(t["term"].alias("term"), gaps(t).alias("gaps")))

    rows = docs.select(*rest, flat.alias("flat")).select(*rest, "flat", F.inline(norm.let(F.lower("flat"), parted)))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))

    def place(done: Column, gap: Column) -> Column:
        at = done["end"] + gap
        return F.struct((at + F.length("term")).alias("end"), F.concat(done["at"], F.array(at)).alias("at"))

    places = F.aggregate(F.slice("gaps", F.lit(1), F.size("gaps") - 1), start, place, lambda done: done["at"])
    low = lambda at: F.greatest(F.lit(0), at - reach)
    cut = lambda at: F.substring(F.col("flat"), low(at) + 1, at + F.length("term") + reach - low(at))
    windows = F.transform(places, lambda at: F.struct(at.cast("long").alias("at"), cut(at).alias("window")))
    return rows.select(*rest, "term", F.inline(windows))
