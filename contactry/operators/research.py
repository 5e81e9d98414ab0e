"""Evidence, people and candidates out of pages and results; the official site; selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactry.functions import catalog as cat
from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm

from . import dedup, extract

SNIPPET = 4000
URL_IN_TEXT = "(?i)https?://[^\\s<>\"')\\]]+"


def page_evidence(pages: DataFrame) -> DataFrame:
    """pages (url, ord, source, title, text, emails, phones, socials) -> evidence: url, ord, source, title, snippet."""
    channels = F.filter(F.concat("emails", "phones", "socials", F.array("text")), lambda x: x != "")
    source = F.when(F.col("source") == "wordpress", "website").otherwise(F.coalesce("source", F.lit("website")))
    return pages.select("url", "ord", source.alias("source"), "title", norm.truncate(F.array_join(channels, "\n"), SNIPPET).alias("snippet"))


def search_evidence(results: DataFrame) -> DataFrame:
    """results (provider, url, title, content, query, ord) -> evidence."""
    return results.select("url", "ord", F.coalesce("provider", F.lit("search")).alias("source"), "title", F.col("content").alias("snippet"), "query")


def candidates_from_pages(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """One candidate per page and email, with up to 3 phones and 5 socials; one for a page that has other channels only.

    Of several evidence rows with a page's url the last counts; pages without any give nothing.
    """
    last = evidence.groupBy("url").agg(F.max_by(F.struct("source", "title", F.col("ord").alias("evidence_ord")), "ord").alias("e"))
    rows = pages.join(last, "url").withColumns({"phones": F.slice("phones", 1, 3), "socials": F.slice("socials", 1, 5)})
    some = rows.where((F.size("emails") > 0) | (F.size("phones") > 0) | (F.size("socials") > 0))
    out = some.select("url", "ord", "phones", "socials", "e", F.posexplode_outer("emails").alias("nth", "email"))
    return out.select("url", "ord", "nth", "email", "phones", "socials", "e.source", "e.title", "e.evidence_ord")


def candidates_from_evidence(evidence: DataFrame) -> DataFrame:
    """One candidate per distinct address in a snippet, classified by the evidence's source."""
    rows = evidence.select("url", "ord", "source", F.posexplode(extract.emails(F.col("snippet"))).alias("nth", "address"))
    return rows.select("url", "ord", "nth", extract.classify_email(F.col("address"), F.col("source"), F.col("url")).alias("email"))


def social_profiles(evidence: DataFrame, official: tuple[str, ...] = ("website", "sitemap", "rss")) -> DataFrame:
    """entity_id, platform, url, username, kind, confidence, ord, nth: profiles in an evidence's url and snippet.

    Of equal platform and url (in lower case) the first of an entity stays.
    """
    found = F.array_distinct(F.concat(F.array("url"), F.regexp_extract_all("snippet", F.lit(URL_IN_TEXT), F.lit(0))))
    rows = evidence.select("entity_id", "source", "ord", F.posexplode(found).alias("nth", "raw"))
    rows = rows.select("entity_id", "source", "ord", "nth", norm.social_url(F.col("raw")).alias("url")).where("url is not null")
    rows = rows.withColumns({"platform": norm.platform(F.col("url")), "username": norm.username(F.col("url")), "own": F.col("source").isin(*official)})
    rows = rows.withColumns({
        "kind": norm.profile_kind(F.col("url"), F.col("username"), F.col("own"), F.col("platform")),
        "confidence": F.when(F.col("own"), 95).when(F.col("platform") == "tenchat", 80).otherwise(65),
    })
    first = W.partitionBy("entity_id", "platform", F.lower("url")).orderBy("ord", "nth")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "own", "source")


def role_terms(wanted: tuple[str, ...] = (), default: tuple[str, ...] = cat.ROLES) -> list[str]:
    """Wanted and default roles, each once, the longest first."""
    return sorted(dict.fromkeys([*wanted, *default]), key=len, reverse=True)


def people(texts: DataFrame, roles: list[str], name_pattern: str = lex.PERSON, reach: int = 140, names: int = 3) -> DataFrame:
    """entity_id, ord, full_name, position, at, emails, profiles: names around every mention of a role.

    texts (entity_id, ord, url, text), ``roles`` in the order in which they are tried. Of a window the first ``names`` names
    count; each has all addresses and all social profiles of the window, and the profile that the text's url is. Of equal
    name and role (in lower case) the first of an entity stays; only then its window is searched for channels.
    """
    order = F.array_position(F.array(*map(F.lit, roles)), F.col("term"))
    social = F.concat(F.array("url"), F.regexp_extract_all("window", F.lit(URL_IN_TEXT), F.lit(0)))
    social = F.array_distinct(F.filter(F.transform(social, norm.social_url), lambda u: u.isNotNull()))
    found = extract.windows_around(texts, roles, reach)
    named = F.slice(F.regexp_extract_all("window", F.lit(name_pattern), F.lit(0)), 1, names)
    found = found.select("entity_id", "ord", F.col("term").alias("position"), "at", order.alias("role_ord"), "url", "window", F.posexplode(named).alias("nth", "full_name"))
    rows = dedup.first_wins(found, ["entity_id", F.lower("full_name"), F.lower("position")], ["ord", "role_ord", "at", "nth"])
    return rows.select("entity_id", "ord", "full_name", "position", "at", extract.emails(F.col("window")).alias("emails"), social.alias("profiles"))


def people_to_search(found: DataFrame, most: int = 3) -> DataFrame:
    """entity_id, full_name, rank: the first distinct people of an entity, for a second round of searches."""
    firsts = found.groupBy("entity_id", F.lower("full_name").alias("person")).agg(F.min(F.struct("ord", "at", "full_name")).alias("f"))
    rank = F.row_number().over(W.partitionBy("entity_id").orderBy("f"))
    return firsts.withColumn("rank", rank).where(F.col("rank") <= most).select("entity_id", "f.full_name", "rank")


def latin(word: Column) -> Column:
    """Transliterated, letters and digits only."""
    out = F.lower(word)
    for letter, pair in cat.DIGRAPHS:
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.regexp_replace(F.translate(out, *cat.LETTERS), "[^a-z0-9]", "")


def infer_emails(persons: DataFrame, known: DataFrame) -> DataFrame:
    """person_id, value, status, confidence, pattern_source: an address for named persons without one.

    persons (person_id, entity_id, full_name), known (entity_id, ord, value, generic): the first address of an entity
    that is not generic gives domain and pattern. Inferred addresses are only ever labelled as such.
    """
    example = known.where(~F.col("generic") & F.contains("value", F.lit("@"))).groupBy("entity_id").agg(F.min_by("value", "ord").alias("example"))
    parts = F.filter(F.split(F.trim("full_name"), "\\s+"), lambda x: x != "")
    rows = persons.withColumn("parts", parts).where(F.size("parts") >= 2).join(example, "entity_id")
    rows = rows.select("person_id", "example", latin(F.col("parts")[0]).alias("first"), latin(F.col("parts")[1]).alias("last"), F.substring_index("example", "@", 1).alias("local"))
    rows = rows.where("first <> '' and last <> ''")
    made = (
        F.when(F.col("local").rlike("(?i)^[a-z]+\\.[a-z]+$"), F.when(F.col("local").rlike("(?i)^[a-z]{2,}\\."), F.concat("first", F.lit("."), "last")).otherwise(F.concat(F.left("first", F.lit(1)), F.lit("."), "last")))
        .when(F.col("local").rlike("(?i)^[a-z][a-z]+$") & (F.length("local") > 5), F.concat(F.left("first", F.lit(1)), "last"))
    )
    rows = rows.withColumn("made", made).where("made is not null")
    value = F.concat("made", F.lit("@"), F.substring_index("example", "@", -1))
    return rows.select("person_id", value.alias("value"), F.lit("inferred").alias("status"), F.lit(35).alias("confidence"), F.col("example").alias("pattern_source"))


def name_tokens(name: Column, legal: str = "(?U)\\b(ооо|ао|пао|зао|оао|llc|inc|ltd)\\b") -> Column:
    """Words of a company name of at least three characters, without quotes and legal forms."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[«»\"']", " "), legal, " ")
    return F.filter(F.split(plain, "[^a-zа-яё0-9]+"), lambda t: F.length(t) >= 3)


def official_website(companies: DataFrame, results: DataFrame, blocked: tuple[str, ...] = cat.NON_OFFICIAL_HOSTS) -> DataFrame:
    """entity_id, url, score: the result of an entity whose host and title hold most words of its name.

    companies (entity_id, name), results (entity_id, ord, url, title, score): 10 points a word and the result's own
    score; at least 10; hosts in ``blocked`` and below them are no official sites.
    """
    host = norm.domain(F.col("url"))
    barred = F.lit(False)
    for name in blocked:
        barred = barred | (host == name) | F.endswith(host, F.lit("." + name))
    rows = results.where(~barred).join(companies, "entity_id")
    hay = F.lower(F.concat_ws(" ", F.regexp_extract("url", "(?i)^https?://([^/?#:]+)", 1), "title"))
    rows = rows.withColumns({"tokens": name_tokens(F.col("name")), "hay": hay})
    points = F.size(F.filter("tokens", lambda t: F.contains("hay", t))) * 10 + F.coalesce("score", F.lit(0))
    rows = rows.select("entity_id", "ord", "url", points.alias("score")).where("score >= 10")
    best = rows.groupBy("entity_id").agg(F.max(F.struct("score", (-F.col("ord")).alias("neg"), "url")).alias("b"))
    return best.select("entity_id", "b.url", "b.score")


def select_candidates(scored: DataFrame, least: int, most: int, include_generic: bool = True) -> DataFrame:
    """entity_id, cand_id, score, fallback, rank: up to ``most`` candidates of each entity.

    scored (entity_id, cand_id, score, usable, generic: has a generic address, fallback_ok: one that is deliverable on
    the own website). Usable ones with ``least`` points come by score; where none of them has a generic address, the
    best one fit for it is put behind them, so the limit may cut it off.
    """
    fit = scored.withColumn("fit", (F.col("score") >= least) & F.col("usable"))
    told = fit.groupBy("entity_id").agg(
        F.bool_or(F.col("fit") & F.col("generic")).alias("has"),
        F.max(F.when(F.col("fallback_ok"), F.struct("score", (-F.col("cand_id")).alias("neg")))).alias("b"),
    )
    rows = fit.join(told, "entity_id")
    extra = F.lit(include_generic) & ~F.col("has") & (F.col("cand_id") == -F.col("b.neg"))
    rows = rows.withColumn("fallback", F.coalesce(~F.col("fit") & extra, F.lit(False))).where(F.col("fit") | F.col("fallback"))
    rank = F.row_number().over(W.partitionBy("entity_id").orderBy("fallback", F.desc("score"), "cand_id"))
    return rows.select("entity_id", "cand_id", "score", "fallback", rank.alias("rank")).where(F.col("rank") <= most)


def candidate_key() -> Column:
    """What a report knows a candidate by: name, else first email, phone or social address."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(F.col("full_name")), *(filled(F.try_element_at(c, F.lit(1))) for c in ("emails", "phones", "social_urls")), F.lit("—"))
