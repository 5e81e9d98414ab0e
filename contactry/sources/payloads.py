"""Landed answers of search, news, discussion and contact services as rows.

Readers take rows of (query, body) with the body as JSON text and give one row per hit: query, ord (its place in
the answer, from 0), title, url, content, published_at (text as delivered), author. Bodies that are null or no JSON
give no rows. Hits without a usable URL are dropped; they keep their place among the first hits that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactry.functions import normalize as norm
from contactry.operators import extract

# Fixed values.
SEARCH_FIRST = 8
ORG_FIRST, PERSON_FIRST = 2, 3
FEED_FIRST = 30
ARCHIVE_URLS = 80
CONTACT_SOURCES = 5
DAYS = 14
ARCHIVE_PATH = "(?i)contact|team|management|people|staff|about|press|news|blog|author|speaker|expert|career|vacanc|event|conference|webinar|document|file|upload|\\.pdf$"
VERIFIER_STATUS = (
    ("valid", "deliverable"),
    ("accept_all", "risky"),
    ("webmail", "risky"),
    ("disposable", "risky"),
    ("invalid", "undeliverable"),
    ("blocked", "undeliverable"),
)
VIDEO_URL = "https://www.youtube.com/watch?v="
DISCUSSION_URL = "https://news.ycombinator.com/item?id="


def _filled(c: Column | str) -> Column:
    """The trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def _hits(payloads: DataFrame, field: str, shape: str, first: int | None = None) -> DataFrame:
    hits = F.from_json("body", f"{field} array<struct<{shape}>>")[field]
    if first is not None:
        hits = F.slice(hits, 1, first)
    return payloads.select("query", F.posexplode(hits).alias("ord", "hit")).select("query", F.col("ord").cast("long").alias("ord"), "hit.*")


def _result(hits: DataFrame, title: Column, url: Column, content: Column, published: Column | None = None, author: Column | None = None, longest: int = 2000, more: list[Column] | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return hits.select(
        "query", "ord", title.alias("title"), url.alias("url"), norm.truncate(F.coalesce(content, F.lit("")), longest).alias("content"),
        (none if published is None else published).alias("published_at"), (none if author is None else author).alias("author"), *(more or []),
    ).where("url is not null")


def meta_search(payloads: DataFrame) -> DataFrame:
    """``results`` of a meta-search engine, the first SEARCH_FIRST per query; the title falls back to the URL."""
    hits = _hits(payloads, "results", "title string, url string, content string, publishedDate string", SEARCH_FIRST)
    link = norm.url(F.col("url"))
    return _result(hits, F.coalesce(_filled("title"), link), link, F.col("content"), F.col("publishedDate"))


def paid_search(payloads: DataFrame) -> DataFrame:
    """``results`` of a paid search service, with the service's own score."""
    hits = _hits(payloads, "results", "title string, url string, content string, score double")
    link = norm.url(F.col("url"))
    return _result(hits, F.coalesce(_filled("title"), link), link, F.col("content"), more=[F.coalesce("score", F.lit(0.0)).alias("score")])


def articles(payloads: DataFrame) -> DataFrame:
    """``articles`` of a news index; content is domain · language."""
    hits = _hits(payloads, "articles", "title string, url string, domain string, language string, seendate string")
    title = F.coalesce(_filled("title"), _filled("domain"), F.col("url"))
    return _result(hits, title, norm.url(F.col("url")), F.concat_ws(" · ", _filled("domain"), _filled("language")), norm.compact_date(F.col("seendate")), longest=500)


def discussions(payloads: DataFrame) -> DataFrame:
    """``hits`` of a discussion site; without a URL of its own, a hit has that of its discussion."""
    hits = _hits(payloads, "hits", "objectID string, url string, story_url string, title string, story_title string, comment_text string, author string, created_at string")
    link = F.coalesce(norm.url(F.coalesce("url", "story_url")), F.concat(F.lit(DISCUSSION_URL), _filled("objectID")))
    title = F.coalesce("title", "story_title", F.concat(F.lit("discussion · "), F.coalesce("author", F.lit("post"))))
    return _result(hits, title, link, F.col("comment_text"), F.col("created_at"), F.col("author"), 3000)


def questions(payloads: DataFrame, run_ts: Column) -> DataFrame:
    """``items`` of a question site of the last DAYS days; dates are epoch seconds."""
    hits = _hits(payloads, "items", "title string, link string, body string, creation_date long, owner struct<display_name:string>")
    recent = hits.where(F.col("creation_date").isNull() | (F.timestamp_seconds("creation_date") >= run_ts - F.expr(f"interval {DAYS} days")))
    when = F.date_format(F.timestamp_seconds("creation_date"), "yyyy-MM-dd'T'HH:mm:ss")
    return _result(recent, F.coalesce("title", "link"), _filled("link"), F.col("body"), when, F.col("owner.display_name"), 3000)


def videos(payloads: DataFrame, run_ts: Column) -> DataFrame:
    """``items`` of a video site of the last DAYS days, if they are videos."""
    hits = _hits(payloads, "items", "id struct<videoId:string>, snippet struct<title:string,description:string,publishedAt:string,channelTitle:string>")
    shown = F.try_to_timestamp("snippet.publishedAt")
    recent = hits.where(shown.isNull() | (shown >= run_ts - F.expr(f"interval {DAYS} days")))
    video = _filled("id.videoId")
    return _result(recent, F.coalesce("snippet.title", video), F.concat(F.lit(VIDEO_URL), video), F.col("snippet.description"), F.col("snippet.publishedAt"), F.col("snippet.channelTitle"), 3000)


def profiles(payloads: DataFrame, people: DataFrame, first: int = ORG_FIRST) -> DataFrame:
    """``items`` of an account search joined to ``people`` (login, name, company, bio, email, blog, url)."""
    hits = _hits(payloads, "items", "login string", first)
    known = people.select("login", *(_filled(c).alias(c) for c in ("name", "company", "bio", "email", "blog", "url")))
    found = hits.join(known, "login")
    title = F.concat_ws(" · ", F.coalesce("name", "login"), "company")
    return _result(found, title, norm.url(F.col("url")), F.concat_ws(" · ", "bio", "email", "blog", "company"))


def grounded_answer(payloads: DataFrame) -> DataFrame:
    """Sources of a grounded answer: a source's content is the text of the supports that name it, in their order.

    A support without a text of its own stands for its part of the answer; a source without support has its title.
    """
    shape = "answer string, chunks array<struct<uri:string,title:string>>, supports array<struct<text:string,start:int,stop:int,chunks:array<int>>>"
    told = payloads.select("query", F.from_json("body", shape).alias("b"))
    chunks = told.select("query", F.posexplode("b.chunks").alias("ord", "web")).select("query", "ord", "web.*").where(_filled("uri").isNotNull())
    parts = told.select("query", F.col("b.answer").alias("answer"), F.posexplode("b.supports").alias("nth", "s"))
    cut = F.substring(F.col("answer"), F.coalesce("s.start", F.lit(0)) + 1, F.greatest(F.coalesce("s.stop", F.lit(0)) - F.coalesce("s.start", F.lit(0)), F.lit(0)))
    parts = parts.select("query", "nth", F.coalesce("s.text", cut).alias("part"), F.explode(F.array_distinct("s.chunks")).alias("ord")).where("part <> ''")
    text = parts.groupBy("query", "ord").agg(F.array_sort(F.collect_list(F.struct("nth", "part"))).alias("parts"))
    text = text.select("query", "ord", F.array_join(F.col("parts.part"), " ").alias("text"))
    both = chunks.join(text, ["query", "ord"], "left").withColumn("ord", F.col("ord").cast("long"))
    out = _result(both, F.coalesce(_filled("title"), "uri"), F.col("uri"), F.coalesce("text", _filled("title"), F.lit("Grounded source")), longest=3000)
    first = F.row_number().over(W.partitionBy("query", "url").orderBy("ord"))
    return out.withColumn("__nth", first).where("__nth = 1").drop("__nth")


def healthy_instances(payloads: DataFrame, limit: int = 8) -> DataFrame:
    """rank, instance: the fastest search instances that are up, without analytics, on the normal network; of equal ones the first of their answer, then by name."""
    shape = (
        "instances map<string, struct<analytics:boolean,network_type:string,http:struct<status_code:int>,"
        "timing:struct<search:struct<success_percentage:double,all:struct<median:double>>>,uptime:struct<uptimeDay:double>>>"
    )
    rows = payloads.select(F.posexplode(F.from_json("body", shape)["instances"]).alias("ord", "instance", "i"))
    good = rows.where("not i.analytics and i.network_type = 'normal' and i.http.status_code = 200 and i.timing.search.success_percentage >= 90 and i.uptime.uptimeDay >= 95")
    ranked = good.select("instance", F.coalesce("i.timing.search.all.median", F.lit(99.0)).alias("median"), "ord")
    order = ("median", "ord", "instance")
    return ranked.orderBy(*order).limit(limit).select(F.row_number().over(W.orderBy(*order)).alias("rank"), "instance")


def verifier_status(status: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in VERIFIER_STATUS for x in pair))
    return F.coalesce(known[status], F.lit("unknown"))


def domain_contacts(payloads: DataFrame, verified: DataFrame) -> DataFrame:
    """``data.emails`` of a contact service as candidates; query is the domain.

    ``verified`` (email, status, confidence, claimed) overrides status and confidence; claimed addresses go.
    """
    shape = (
        "data struct<emails:array<struct<value:string,type:string,confidence:int,first_name:string,last_name:string,position:string,"
        "verification:struct<status:string>,sources:array<struct<uri:string,extracted_on:string,last_seen_on:string>>>>>"
    )
    rows = payloads.select(F.col("query").alias("domain"), F.posexplode(F.from_json("body", shape)["data"]["emails"]).alias("ord", "e"))
    rows = rows.withColumn("email", norm.email(F.col("e.value"))).where("email <> ''")
    told = verified.select(norm.email(F.col("email")).alias("email"), F.col("status").alias("v_status"), F.col("confidence").alias("v_confidence"), "claimed")
    both = rows.join(told, "email", "left").where(~F.coalesce("claimed", F.lit(False)))
    sources = F.slice(F.filter("e.sources", lambda s: F.coalesce(s.uri != "", F.lit(False))), 1, CONTACT_SOURCES)
    urls = F.transform(sources, lambda s: s.uri)
    own = F.array(F.concat(F.lit("https://"), F.col("domain")))
    return both.select(
        "domain", F.col("ord").cast("long").alias("ord"), "email",
        _filled(F.concat_ws(" ", _filled("e.first_name"), _filled("e.last_name"))).alias("full_name"), _filled("e.position").alias("position"),
        (F.col("e.type").eqNullSafe("generic") | norm.is_generic(F.col("email"))).alias("generic"),
        F.when(F.col("v_status").isNotNull(), verifier_status(F.col("v_status"))).otherwise(verifier_status(F.col("e.verification.status"))).alias("deliverability"),
        F.coalesce("v_confidence", "e.confidence").alias("confidence"),
        F.when(F.size(urls) > 0, urls).otherwise(own).alias("evidence_urls"),
    )


def crawl_index(payloads: DataFrame) -> DataFrame:
    """query, ord, row (a map of text) of a crawl index, delivered as objects, one object, a table with header, or lines."""
    body, row = F.trim("body"), "map<string,string>"
    lines = F.filter(F.split(body, "\\r?\\n"), lambda x: F.trim(x) != "")
    table = F.from_json(body, "array<array<string>>")
    from_table = F.transform(F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0))), lambda r: F.map_from_arrays(table[0], r))
    rows = (
        F.when(body.rlike("^\\[\\s*\\["), from_table)
        .when(body.startswith("["), F.from_json(body, f"array<{row}>"))
        .when((F.size(lines) > 1) & F.forall(lines, lambda x: F.trim(x).rlike("^\\{.*\\}$")), F.transform(lines, lambda x: F.from_json(x, row)))
        .otherwise(F.array(F.from_json(body, row)))
    )
    out = payloads.where(body != "").select("query", F.posexplode(rows).alias("ord", "row"))
    return out.select("query", F.col("ord").cast("long").alias("ord"), "row").where("row is not null")


def archived_urls(rows: DataFrame, limit: int = ARCHIVE_URLS) -> DataFrame:
    """query, url, rank: distinct useful URLs of crawl-index rows (query, ord, url), the first ``limit`` per query."""
    seen = rows.select("query", "ord", norm.url(F.col("url")).alias("url")).where("url is not null")
    firsts = seen.groupBy("query", "url").agg(F.min("ord").alias("ord")).where(norm.path(F.col("url")).rlike(ARCHIVE_PATH))
    rank = F.row_number().over(W.partitionBy("query").orderBy("ord"))
    return firsts.select("query", "url", rank.alias("rank")).where(F.col("rank") <= limit)


#: An item or entry of a feed. Attributes have a leading underscore, an element's own text beside them is ``_VALUE``.
_ITEM = (
    "struct<title:string,link:array<struct<_href:string,_VALUE:string>>,description:string,summary:string,`content:encoded`:string,content:string,"
    "source:string,pubDate:string,published:string,updated:string>"
)
_FEED = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ITEM}>"


def _items(body: Column, first: int) -> Column:
    """The first items and entries of an RSS or Atom body, entities and CDATA decoded; null or broken XML has none."""
    none = F.array().cast(f"array<{_ITEM}>")
    told = F.from_xml(body, _FEED)
    parts = (told["channel"]["item"], told["item"], told["entry"])
    return F.slice(F.filter(F.concat(*(F.coalesce(p, none) for p in parts)), lambda x: x.isNotNull()), 1, first)


def feed_items(feeds: DataFrame) -> DataFrame:
    """``feeds`` (feed_url, body as XML text), the first FEED_FIRST items or entries of each.

    feed_url, ord, title, url, text, published_at and the item's emails, phones and social_urls; an item without a link
    has the feed's address.
    """
    rows = feeds.select("feed_url", F.posexplode(_items(F.col("body"), FEED_FIRST)).alias("ord", "x"))
    part = lambda name: _filled(F.col("x")[name])
    place = F.try_element_at(F.col("x.link"), F.lit(1))
    link = norm.url(F.coalesce(_filled(place["_href"]), _filled(place["_VALUE"]), F.col("feed_url")))
    text = F.concat_ws(" ", *(part(name) for name in ("description", "summary", "content:encoded", "content")))
    rows = rows.select(
        "feed_url", F.col("ord").cast("long").alias("ord"), part("title").alias("title"), link.alias("url"), text.alias("text"),
        F.coalesce(*(part(name) for name in ("pubDate", "published", "updated"))).alias("published_at"),
    ).where("url is not null")
    hrefs = F.regexp_extract_all("text", F.lit("(?i)https?://[^\\s<>\"']+"), F.lit(0))
    found = extract.page_channels(F.col("text"), hrefs, F.col("url"))
    return rows.select("feed_url", "ord", norm.truncate(F.coalesce("title", "url"), 180).alias("title"), "url", norm.truncate(F.col("text"), 40_000).alias("text"), "published_at", *found)


def feed_results(feeds: DataFrame) -> DataFrame:
    """Feed items as results of the query ``feed:`` and the feed's URL, each URL once."""
    rows = feed_items(feeds).withColumns({"content": norm.truncate(F.col("text"), 3000), "query": F.concat(F.lit("feed:"), "feed_url")}).drop("text")
    nth = F.row_number().over(W.partitionBy("url").orderBy("feed_url", "ord"))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth", "feed_url")


def news_feed(feeds: DataFrame) -> DataFrame:
    """News search (query, body as XML text), the first SEARCH_FIRST items; content is publication · description."""
    rows = feeds.select("query", F.posexplode(_items(F.col("body"), SEARCH_FIRST)).alias("ord", "x")).withColumn("ord", F.col("ord").cast("long"))
    part = lambda name: _filled(F.col("x")[name])
    link = _filled(F.try_element_at(F.col("x.link"), F.lit(1))["_VALUE"])
    return _result(rows, F.coalesce(part("title"), link), link, F.concat_ws(" · ", part("source"), part("description")), part("pubDate"))


def sitemap(files: DataFrame) -> DataFrame:
    """The other columns of ``files`` (with body as XML text), and ord, nested (whether the place is a further sitemap), url."""
    rest = [c for c in files.columns if c != "body"]
    told = F.from_xml("body", "url array<struct<loc:string>>, sitemap array<struct<loc:string>>")
    rows = files.select(*rest, told.alias("x"))
    places = lambda name, nested: rows.select(*rest, F.posexplode(F.transform(F.col("x")[name], lambda p: _filled(p["loc"]))).alias("ord", "url"), F.lit(nested).alias("nested"))
    both = places("url", False).unionByName(places("sitemap", True))
    return both.where("url is not null").select(*rest, F.col("ord").cast("long").alias("ord"), "nested", "url")
