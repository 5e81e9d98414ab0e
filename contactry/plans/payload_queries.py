"""Queries over payloads that Spark makes of the driver's tables, each with the SQL that gives the same rows.

Every ten documents (or twenty pages) are one answer of a service, so an answer stays small at any size of the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.sources import payloads

from .oracle import _domain, _flat, _normal, _path
from .queries import RUN_TS, _t

SITE = "https://example.org/"


def _bodies(df: DataFrame, id_: str, per: int, field: str, hit: Column) -> DataFrame:
    """query, nth bucket, hits (sorted by id) and body: the hits as JSON under ``field``."""
    rows = df.groupBy(F.floor(F.col(id_) / per).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct(F.col(id_).alias("id"), hit.alias("hit")))).alias("rows"))
    rows = rows.select("bucket", F.concat(F.lit("q"), "bucket").alias("query"), F.col("rows.hit").alias("hits"))
    return rows.withColumn("body", F.to_json(F.struct(F.col("hits").alias(field))))


def _address(path: str = "") -> Column:
    return F.concat(F.lit(SITE + path), "doc_id")


def meta_search_results(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct(F.col("source").alias("title"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(_address()).alias("url"), F.col("text").alias("content"), F.col("lang").alias("publishedDate"))
    return payloads.meta_search(_bodies(_t(spark, d, "documents"), "doc_id", 10, "results", hit)).drop("author")


def discussion_results(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    hit = F.struct(F.col("doc_id").cast("string").alias("objectID"), F.when(even, _address()).alias("url"), F.when(even, F.col("lang")).alias("title"), F.col("source").alias("author"), F.col("text").alias("comment_text"))
    return payloads.discussions(_bodies(_t(spark, d, "documents"), "doc_id", 10, "hits", hit)).drop("published_at")


def recent_questions(spark: SparkSession, d: str) -> DataFrame:
    made = F.unix_timestamp(F.lit(RUN_TS).cast("timestamp")) - F.col("doc_id") % 30 * 86400
    hit = F.struct(_address("q/").alias("link"), F.col("text").alias("body"), made.alias("creation_date"), F.struct(F.col("source").alias("display_name")).alias("owner"))
    bodies = _bodies(_t(spark, d, "documents"), "doc_id", 10, "items", hit)
    return payloads.questions(bodies, F.lit(RUN_TS).cast("timestamp")).drop("published_at")


def grounded_sources(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct(_address().alias("uri"), F.col("source").alias("title"), F.col("lang").alias("text"))
    rows = _bodies(_t(spark, d, "documents"), "doc_id", 10, "hits", hit)
    supports = F.transform("hits", lambda h, i: F.struct(h.text.alias("text"), F.array(i, i + 1).alias("chunks")))
    chunks = F.transform("hits", lambda h: F.struct(h.uri.alias("uri"), h.title.alias("title")))
    return payloads.grounded_answer(rows.withColumn("body", F.to_json(F.struct(chunks.alias("chunks"), supports.alias("supports"))))).drop("published_at", "author")


def archived_page_urls(spark: SparkSession, d: str) -> DataFrame:
    place = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(SITE + "team/"), (F.col("page_id") % 7).cast("string"))).otherwise(F.col("url"))
    rows = _bodies(_t(spark, d, "pages"), "page_id", 20, "hits", F.struct(place.alias("url")))
    lines = F.array_join(F.transform("hits", lambda h: F.to_json(h)), "\n")
    table = F.to_json(F.concat(F.array(F.array(F.lit("url"))), F.transform("hits", lambda h: F.array(h.url))))
    body = F.when(F.col("bucket") % 3 == 0, lines).when(F.col("bucket") % 3 == 1, table).otherwise(F.to_json("hits"))
    index = payloads.crawl_index(rows.withColumn("body", body))
    return payloads.archived_urls(index.select("query", "ord", F.col("row")["url"].alias("url")))


def _xml(c: Column) -> Column:
    """Text as XML holds it: without what XML can't hold, the rest with entities."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), NOT_XML, "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(char), F.lit(name))
    return clean


NOT_XML = "[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"
_tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
_cdata = lambda c: F.concat(F.lit("<![CDATA["), F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), NOT_XML, ""), F.lit("]]>"), F.lit("]] >")), F.lit("]]>"))


def feed_signals(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in RSS and Atom feeds, with entities or as CDATA, and the channels of every item."""
    even = F.col("doc_id") % 2 == 0
    text = F.when(even, _xml(F.col("text"))).otherwise(_cdata(F.col("text")))
    rss = _tag("item", F.concat(_tag("title", _xml(F.concat(F.lit("A & B "), "source"))), _tag("link", _address()), _tag("description", text), _tag("pubDate", F.lit("Mon, 17 Aug 2026 10:00:00 GMT"))))
    atom = _tag("entry", F.concat(F.lit('<title type="text">'), _xml(F.col("source")), F.lit('</title><link rel="x" href="'), _address(), F.lit('"/>'), _tag("summary", text), _tag("updated", F.lit("2026-08-17"))))
    is_rss = F.floor(F.col("doc_id") / 40) % 2 == 0
    rows = _bodies(_t(spark, d, "documents"), "doc_id", 40, "hits", F.when(is_rss, rss).otherwise(atom))
    joined = F.array_join("hits", "\n")
    body = F.when(F.col("bucket") % 2 == 0, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>all</title>'), joined, F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), joined, F.lit("</feed>"))
    )
    got = payloads.feed_results(rows.select(F.concat(F.lit(SITE), "query").alias("feed_url"), body.alias("body")))
    return got.select("query", "ord", "title", "url", "content", "published_at", F.array_join("emails", " ").alias("emails"), F.size("phones").alias("n_phones"))


def news_results(spark: SparkSession, d: str) -> DataFrame:
    """News answers: publication and description, the first eight of an answer."""
    item = _tag("item", F.concat(_tag("title", _xml(F.col("lang"))), F.when(F.col("doc_id") % 9 > 0, _tag("link", _address())).otherwise(""), F.lit('<source url="x">'), _xml(F.col("source")), F.lit("</source>"), _tag("description", _cdata(F.col("text")))))
    rows = _bodies(_t(spark, d, "documents"), "doc_id", 10, "hits", item)
    return payloads.news_feed(rows.select("query", _tag("rss", _tag("channel", F.array_join("hits", ""))).alias("body"))).drop("published_at", "author")


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with entities, in sitemaps; every third bucket is an index."""
    nested = F.floor(F.col("page_id") / 20) % 3 == 0
    place = F.concat(F.lit("<loc> "), _xml(F.col("url")), F.lit(" </loc>"))
    rows = _bodies(_t(spark, d, "pages"), "page_id", 20, "hits", F.when(nested, _tag("sitemap", place)).otherwise(_tag("url", place)))
    lines = F.array_join("hits", "\n")
    body = F.when(F.col("bucket") % 3 == 0, _tag("sitemapindex", lines)).otherwise(F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), lines, F.lit("</urlset>")))
    return payloads.sitemap(rows.select(F.col("query").alias("site"), body.alias("body"))).drop("ord")


def domain_contact_candidates(spark: SparkSession, d: str) -> DataFrame:
    people = _t(spark, d, "customer")
    address = F.concat(F.lit("c"), "c_custkey", F.lit("@example.org"))
    hit = F.struct(address.alias("value"), F.lit("personal").alias("type"), F.lit(80).alias("confidence"), F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("position"))
    told = people.where("c_custkey % 3 = 0").select(address.alias("email"), F.lit("accept_all").alias("status"), F.lit(50).alias("confidence"), (F.col("c_custkey") % 9 == 0).alias("claimed"))
    rows = _bodies(people, "c_custkey", 10, "emails", hit).withColumn("body", F.to_json(F.struct(F.struct(F.col("hits").alias("emails")).alias("data"))))
    return payloads.domain_contacts(rows, told).select("domain", "email", "full_name", "position", "deliverability", "confidence", F.element_at("evidence_urls", 1).alias("evidence_url"))


def article_results(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    seen = F.concat(F.lit("2024"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.when(i % 2 == 0, "T101112Z").otherwise(""))
    hit = F.struct(F.when(i % 3 > 0, F.col("source")).alias("title"), _address("a/").alias("url"), F.when(i % 4 > 0, "d.example").otherwise("").alias("domain"), F.col("lang").alias("language"), seen.alias("seendate"))
    return payloads.articles(_bodies(_t(spark, d, "documents"), "doc_id", 10, "articles", hit)).drop("author")


def paid_results(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    hit = F.struct(F.when(i % 2 == 0, F.col("source")).alias("title"), F.when(i % 5 == 0, " ").otherwise(_address()).alias("url"), F.col("text").alias("content"), F.when(i % 3 > 0, i / 4).alias("score"))
    return payloads.paid_search(_bodies(_t(spark, d, "documents"), "doc_id", 10, "results", hit)).drop("published_at", "author")


def video_results(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    shown = F.date_format(F.lit(RUN_TS).cast("timestamp") - F.make_dt_interval((i % 30).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    hit = F.struct(F.struct(F.when(i % 3 > 0, F.concat(F.lit("v"), i)).alias("videoId")).alias("id"), F.struct(F.when(i % 2 == 0, F.col("lang")).alias("title"), F.col("text").alias("description"), shown.alias("publishedAt"), F.col("source").alias("channelTitle")).alias("snippet"))
    return payloads.videos(_bodies(_t(spark, d, "documents"), "doc_id", 10, "items", hit), F.lit(RUN_TS).cast("timestamp")).drop("published_at")


def account_results(spark: SparkSession, d: str) -> DataFrame:
    """The first two accounts of each search, with what is known of them."""
    hit = F.struct(F.concat(F.lit("u"), F.col("doc_id") % 2000).alias("login"))
    k = F.col("c_custkey")
    people = _t(spark, d, "customer").select(
        F.concat(F.lit("u"), k).alias("login"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise(" ").alias("company"), F.lit("bio").alias("bio"),
        F.when(k % 5 == 0, F.concat(F.lit("c"), k, F.lit("@example.org"))).alias("email"), F.lit("").alias("blog"), F.concat(F.lit("Example.org/u/"), k).alias("url"),
    )
    return payloads.profiles(_bodies(_t(spark, d, "documents"), "doc_id", 10, "items", hit), people).drop("published_at", "author")


def healthy_instances(spark: SparkSession, d: str) -> DataFrame:
    """Instances of a hundred pages an answer, each with its own health: the fastest eight."""
    i = F.col("page_id")
    health = F.struct(
        (i % 7 == 0).alias("analytics"), F.when(i % 5 == 0, "tor").otherwise("normal").alias("network_type"), F.struct(F.when(i % 11 == 0, 500).otherwise(200).alias("status_code")).alias("http"),
        F.struct(F.struct((i % 20 + 81).cast("double").alias("success_percentage"), F.struct(F.when(i % 3 > 0, i * 37 % 1000 / 100).alias("median")).alias("all")).alias("search")).alias("timing"), F.struct((i % 10 + 90).cast("double").alias("uptimeDay")).alias("uptime"),
    )
    rows = _t(spark, d, "pages").groupBy(F.floor(i / 100).alias("bucket")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("i"), F.lpad(i.cast("string"), 9, "0")), health)))).alias("instances"))
    return payloads.healthy_instances(rows.select(F.to_json(F.struct("instances")).alias("body")))


def _cut(n: int) -> str:
    flat = f"coalesce({_flat}, '')"
    return f"CASE WHEN length({flat}) > {n} THEN left({flat}, {n - 1}) || '…' ELSE {flat} END"


def _places(per: int) -> str:
    return f"d AS (SELECT *, 'q' || (doc_id // {per}) AS query, row_number() OVER (PARTITION BY doc_id // {per} ORDER BY doc_id) - 1 AS ord FROM documents)"


_source = "nullif(trim(source), '')"
_clean = lambda c: rf"regexp_replace(coalesce({c}, ''), '[^\x09\x0A\x0D\x20-\x{{D7FF}}\x{{E000}}-\x{{FFFD}}\x{{10000}}-\x{{10FFFF}}]', '', 'g')"
_once = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def _emails_of(c: str) -> str:
    """Distinct addresses in a text, in order."""
    found = rf"list_filter(list_transform(regexp_extract_all({c}, '{lex.EMAIL}'), lambda x: lower(trim(x))), lambda e: NOT regexp_matches(e, '\.(png|jpe?g|gif|webp|svg)$'))"
    return _once(found)


def _phones_of(c: str) -> str:
    found = rf"list_filter(list_transform(regexp_extract_all({c}, '{lex.PHONE}'), lambda x: CASE WHEN starts_with(trim(x), '+') THEN '+' ELSE '' END || regexp_replace(x, '[^0-9]', '', 'g')), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 10)"
    return _once(found)


_pages = "p AS (SELECT *, 'q' || (page_id // 20) AS query, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS ord, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)"

QUERIES = {
    f.__name__: f
    for f in (
        meta_search_results, discussion_results, recent_questions, grounded_sources,
        archived_page_urls, feed_signals, news_results, sitemap_urls, domain_contact_candidates,
        article_results, paid_results, video_results, account_results, healthy_instances,
    )
}
ORACLE = {
    "meta_search_results": f"WITH {_places(10)} SELECT query, ord, coalesce({_source}, '{SITE}' || doc_id) AS title, '{SITE}' || doc_id AS url, {_cut(2000)} AS content, lang AS published_at FROM d WHERE ord < 8 AND doc_id % 7 <> 0",
    "discussion_results": f"""WITH {_places(10)} SELECT query, ord, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'discussion · ' || coalesce(source, 'post')) AS title,
      CASE WHEN doc_id % 2 = 0 THEN '{SITE}' ELSE '{payloads.DISCUSSION_URL}' END || doc_id AS url, {_cut(3000)} AS content, source AS author FROM d""",
    "recent_questions": f"WITH {_places(10)} SELECT query, ord, '{SITE}q/' || doc_id AS title, '{SITE}q/' || doc_id AS url, {_cut(3000)} AS content, source AS author FROM d WHERE doc_id % 30 <= 14",
    "grounded_sources": f"""WITH {_places(10)}, n AS (SELECT *, nullif(lang, '') AS own, nullif(lag(lang) OVER (PARTITION BY query ORDER BY ord), '') AS before FROM d)
      SELECT query, ord, coalesce({_source}, '{SITE}' || doc_id) AS title, '{SITE}' || doc_id AS url, coalesce(nullif(concat_ws(' ', before, own), ''), {_source}, 'Grounded source') AS content FROM n""",
    "archived_page_urls": f"""WITH {_pages.replace("regexp_replace(trim(url)", f"regexp_replace(trim(CASE WHEN page_id % 3 = 0 THEN '{SITE}team/' || (page_id % 7) ELSE url END)")}, n AS (SELECT query, ord, {_normal} AS url FROM p), f AS (SELECT query, url, min(ord) AS ord FROM n WHERE url IS NOT NULL GROUP BY 1, 2),
      r AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY ord)::INTEGER AS rank FROM f WHERE regexp_matches({_path('url')}, '{payloads.ARCHIVE_PATH}')) SELECT * FROM r WHERE rank <= {payloads.ARCHIVE_URLS}""",
    "feed_signals": rf"""WITH {_places(40)}, c AS (SELECT *, CASE WHEN doc_id % 2 = 1 THEN replace({_clean('text')}, ']]>', ']] >') ELSE {_clean('text')} END AS t FROM d),
      m AS (SELECT *, {_emails_of('t')} AS mails, {_phones_of('t')} AS tels, (doc_id // 40) % 2 = 0 AS rss FROM c WHERE ord < 30)
      SELECT 'feed:{SITE}' || query AS query, ord, CASE WHEN rss THEN rtrim('A & B ' || coalesce({_clean('source')}, '')) ELSE coalesce({_source}, '{SITE}' || doc_id) END AS title, '{SITE}' || doc_id AS url, {_cut(3000).replace('text', 't')} AS content,
        CASE WHEN rss THEN 'Mon, 17 Aug 2026 10:00:00 GMT' ELSE '2026-08-17' END AS published_at, array_to_string(mails, ' ') AS emails, len(tels)::INTEGER AS n_phones FROM m""",
    "news_results": rf"""WITH {_places(10)}, c AS (SELECT *, replace({_clean('text')}, ']]>', ']] >') AS t FROM d), n AS (SELECT *, concat_ws(' · ', nullif(trim(source), ''), nullif(trim(t), '')) AS said FROM c)
      SELECT query, ord, coalesce(nullif(trim(lang), ''), '{SITE}' || doc_id) AS title, '{SITE}' || doc_id AS url, {_cut(2000).replace('text', 'said')} AS content FROM n WHERE ord < 8 AND doc_id % 9 > 0""",
    "sitemap_urls": "SELECT 'q' || (page_id // 20) AS site, (page_id // 20) % 3 = 0 AS nested, trim(url) AS url FROM pages WHERE trim(url) <> ''",
    "article_results": f"""WITH {_places(10)} SELECT query, ord, coalesce(CASE WHEN doc_id % 3 > 0 THEN {_source} END, CASE WHEN doc_id % 4 > 0 THEN 'd.example' END, '{SITE}a/' || doc_id) AS title, '{SITE}a/' || doc_id AS url,
      concat_ws(' · ', CASE WHEN doc_id % 4 > 0 THEN 'd.example' END, nullif(trim(lang), '')) AS content, CASE WHEN doc_id % 2 = 0 THEN '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T10:11:12Z'
        ELSE '2024' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS published_at FROM d""",
    "paid_results": f"WITH {_places(10)} SELECT query, ord, coalesce(CASE WHEN doc_id % 2 = 0 THEN {_source} END, '{SITE}' || doc_id) AS title, '{SITE}' || doc_id AS url, {_cut(2000)} AS content, CASE WHEN doc_id % 3 > 0 THEN doc_id / 4 ELSE 0 END::DOUBLE AS score FROM d WHERE doc_id % 5 > 0",
    "video_results": f"WITH {_places(10)} SELECT query, ord, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, 'v' || doc_id) AS title, '{payloads.VIDEO_URL}v' || doc_id AS url, {_cut(3000)} AS content, source AS author FROM d WHERE doc_id % 3 > 0 AND doc_id % 30 <= 14",
    "account_results": f"""WITH {_places(10)} SELECT query, ord, concat_ws(' · ', coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'u' || c_custkey), CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END) AS title, 'https://example.org/u/' || c_custkey AS url,
      concat_ws(' · ', 'bio', CASE WHEN c_custkey % 5 = 0 THEN 'c' || c_custkey || '@example.org' END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END) AS content FROM d JOIN customer ON c_custkey = doc_id % 2000 WHERE ord < 2""",
    "healthy_instances": """WITH h AS (SELECT page_id, coalesce(CASE WHEN page_id % 3 > 0 THEN page_id * 37 % 1000 / 100 END, 99) AS median FROM pages WHERE page_id % 7 > 0 AND page_id % 5 > 0 AND page_id % 11 > 0 AND page_id % 20 + 81 >= 90 AND page_id % 10 + 90 >= 95),
      r AS (SELECT 'i' || lpad(page_id::VARCHAR, 9, '0') AS instance, row_number() OVER (ORDER BY median, page_id % 100)::INTEGER AS rank FROM h) SELECT rank, instance FROM r WHERE rank <= 8""",
    "domain_contact_candidates": """SELECT 'q' || (c_custkey // 10) AS domain, 'c' || c_custkey || '@example.org' AS email, c_name AS full_name, c_mktsegment AS position,
      CASE WHEN c_custkey % 3 = 0 THEN 'risky' ELSE 'unknown' END AS deliverability, CASE WHEN c_custkey % 3 = 0 THEN 50 ELSE 80 END AS confidence, 'https://q' || (c_custkey // 10) AS evidence_url FROM customer WHERE c_custkey % 9 <> 0""",
}
