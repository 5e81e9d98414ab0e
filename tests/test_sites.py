"""Pages, feeds, sitemaps, addresses and people: the cases a reader of the services' formats expects, and broken ones."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm
from contactry.operators import demand, extract, research
from contactry.plans.site_queries import LINKS, WRITTEN
from contactry.sources import html, payloads, records

SITE = "https://a.example/"


def page(spark, text, url=SITE):
    return html.read_pages(spark.createDataFrame([(1, url, text)], "page_id int, url string, html string")).first()


def test_addresses_as_a_browser_reads_them(spark):
    rows = spark.createDataFrame([(w.replace("{}", "7"), u and u.replace("{}", "7")) for w, u in WRITTEN], "w string, u string")
    got = rows.select("w", "u", norm.url(F.col("w")).alias("got")).collect()
    assert [(r.w, r.got) for r in got] == [(r.w, r.u) for r in got]
    rows = spark.createDataFrame([(w.replace("{}", "7"), u and u.replace("{}", "7")) for w, u in LINKS], "w string, u string")
    got = rows.select("w", "u", norm.resolve(F.col("w"), F.lit("https://example.org/a/b?x=1")).alias("got")).collect()
    assert [(r.w, r.got) for r in got] == [(r.w, r.u) for r in got]
    odd = [(None, None), ("example.com/contact", "https://example.com/contact"), ("/./..//a/", "https://.//a/"), ("a.b/c/./d/../e/..", "https://a.b/c/"), ("a.b/😀", "https://a.b/%F0%9F%98%80")]
    got = spark.createDataFrame(odd, "w string, u string").select("u", norm.url(F.col("w")).alias("got")).collect()
    assert [r.got for r in got] == [r.u for r in got]


def test_normalised_channels(spark):
    one = spark.range(1)
    row = one.select(norm.email(F.lit("MAILTO:John.Doe@Example.COM?subject=Hi")), norm.phone(F.lit("+7 (999) 123-45-67")), norm.domain(F.lit("https://www.example.com/contact"))).first()
    assert tuple(row) == ("john.doe@example.com", "+79991234567", "example.com")
    assert tuple(one.select(*(norm.is_generic(F.lit(m)) for m in ("info@example.com", "hello.team@example.com", "andrey@example.com"))).first()) == (True, True, False)


@pytest.mark.parametrize(
    ("url", "platform"),
    [
        ("https://t.me/ivan", "telegram"), ("https://vk.com/id1", "vk"), ("https://youtube.com/@anna", "youtube"), ("https://threads.net/@ivan", "threads"),
        ("https://instagram.com/ivan", "instagram"), ("https://tenchat.ru/ivan", "tenchat"), ("https://rutube.ru/channel/1", "rutube"), ("https://not-t.me/x", None), ("https://m.vk.com/x", "vk"),
    ],
)
def test_platforms(spark, url, platform):
    assert spark.range(1).select(norm.platform(F.lit(url))).first()[0] == platform


def test_html_with_entities_and_broken_markup(spark):
    r = page(spark, "<title>A &amp; B</title><p>x &lt;b&gt; <a href='mailto:X@Y.ru?subject=1'>mail<p>still a link <a href=/t>t", SITE)
    assert r.title == "A & B" and r.emails == ["x@y.ru"] and r.links == ["mailto:X@Y.ru?subject=1", "/t"]
    assert "x <b>" in r.text
    r = page(spark, "<svg><text>drawn<a href='https://vk.com/x'>no")
    assert r.links == [] and r.social_urls == []
    assert page(spark, None).title == SITE and page(spark, "").text == "" and page(spark, "<<<>><a href").links in ([], [""])
    r = page(spark, "<script src=a></script><script src=b></script><body>short</body>")
    assert r.likely_spa and r.text == "short"
    assert not page(spark, "<script src=a></script><script src=b></script><body>" + "long " * 80).likely_spa
    r = page(spark, "<title>t</title><title>u</title><h1>h</h1>" + "w " * 30_000)
    assert r.title == "t" and len(r.text) == 40_000 and r.text.endswith("…")


def test_references_without_their_end(spark):
    text = "<title>a&amp;&amp</title><script type='application/ld+json'>{\"q\": \"x&lt y\"}</script><p>&lt;b &lt b &copy=1 &#65 &#65; AT&T <a href='/?a&amp;b&amp'>x"
    rows = spark.createDataFrame([(1, SITE, text)], "page_id int, url string, html string")
    kept, read = html.read_pages(rows, bare=False).first(), html.read_pages(rows).first()
    assert kept.title == "a&&amp" and kept.links == ["/?a&b&amp"] and kept.text.startswith("<b &lt b &copy=1 &#65 A AT&T x") and '"x&lt y"' in kept.text
    assert read.title == "a&&" and read.text.startswith("<b < b ©=1 A A AT&T x")


def test_parts_go_back_in_pieces(spark):
    """Many large pages in one batch come back a few at a time, each once and in order."""
    pages = pd.Series([None, ""] + [f"<title>{i}</title>" + "w " * (html.PIECE // 4) for i in range(9)])
    frames = list(html._parts(True)(iter([pages, pages[:0], pages[:1]])))
    assert [t for f in frames for t in f["title"]] == ["", "", *map(str, range(9)), ""]
    assert len(frames) > 4 and max(f["body"].str.len().sum() for f in frames) <= html.PIECE
    rows = spark.range(3_000).selectExpr("id", "'https://a.example/' AS url", "concat('<title>', id, '</title>', repeat('w ', 1000)) AS html").coalesce(1)
    assert html.read_pages(rows).where("title <> id").count() == 0 and html.read_pages(rows).select("title").distinct().count() == 3_000


def test_titles_fall_back(spark):
    assert page(spark, "<h1>Head <b>line</b></h1><h1>two</h1>").title == "Head line"
    assert page(spark, "<p>none").title == SITE
    r = html.read_social_pages(spark.createDataFrame([(SITE, "<meta property=og:title content=Shared><title>t</title><a href='//t.me/x.'>x</a> https://vk.com/y).")], "url string, html string")).first()
    assert r.title == "Shared" and r.social_urls == ["https://t.me/x", "https://vk.com/y"]


def test_feeds_with_entities(spark):
    item = "<item><title>Назначение</title><link>https://a.ru/news/1</link><pubDate>Mon, 17 Aug 2026 10:00:00 GMT</pubDate><description>Иван &amp; Петров, директор. ivan@a.ru</description><content:encoded xmlns:content='c'><![CDATA[<b>x</b> https://t.me/ivan]]></content:encoded></item>"
    feeds = spark.createDataFrame([("https://a.ru/rss.xml", f"<rss><channel>{item}</channel></rss>"), ("f", "<rss><channel><item><title>no link"), ("g", None), ("h", "no xml"), ("b.org/f", "<rss><channel><item><title>x</title></item></channel></rss>")], "feed_url string, body string")
    got = {r.feed_url: r for r in payloads.feed_items(feeds).collect()}
    r = got["https://a.ru/rss.xml"]
    assert (r.url, r.emails, r.social_urls) == ("https://a.ru/news/1", ["ivan@a.ru"], ["https://t.me/ivan"]) and "2026" in r.published_at and "Иван & Петров" in r.text
    assert got["b.org/f"].url == "https://b.org/f" and set(got) == {"https://a.ru/rss.xml", "b.org/f"}


def test_sitemaps(spark):
    files = spark.createDataFrame([("s", '<?xml version="1.0"?><sitemapindex><sitemap><loc>https://a.ru/posts.xml</loc></sitemap></sitemapindex>'), ("t", "<urlset><url><loc>https://a.ru/team</loc></url><url><loc> https://a.ru/x?a=1&amp;b=2 </loc></url></urlset>"), ("u", "broken <url>")], "site string, body string")
    assert sorted((r.site, r.ord, r.nested, r.url) for r in payloads.sitemap(files).collect()) == [("s", 0, True, "https://a.ru/posts.xml"), ("t", 0, False, "https://a.ru/team"), ("t", 1, False, "https://a.ru/x?a=1&b=2")]


def test_sitemaps_in_reading_order(spark):
    """A queue by hand: first come, first read; ten places; a sitemap read before takes a place."""
    named = {"a": ["b", "c", "a"], "b": [f"b{i}" for i in range(12)], "c": ["d"]}
    queue, seen, order = ["a"], set(), {}
    for place, name in enumerate(queue):
        if place >= 10:
            break
        if name not in seen:
            seen.add(name)
            order[name] = place
            queue += named.get(name, [])[:10]
    entries = spark.createDataFrame([("s", name, i, True, n) for name, below in named.items() for i, n in enumerate(below)], "site string, sitemap string, ord int, nested boolean, url string")
    roots = spark.createDataFrame([("s", 0, "a"), ("lone", 0, "x")], "site string, ord int, sitemap string")
    got = records.sitemap_order(roots, entries).collect()
    assert {r.sitemap: r.place for r in got if r.site == "s"} == order and [r.place for r in got if r.site == "lone"] == [0]


def texts(spark, *rows):
    return spark.createDataFrame([(e, i, "https://company.ru/team", t) for i, (e, t) in enumerate(rows)], "entity_id string, ord int, url string, text string")


def test_people_around_roles(spark):
    found = research.people(texts(spark, ("a", "Команда. Иван Петров — директор по маркетингу компании."), ("b", "И.И. Иванов — генеральный директор компании.")), research.role_terms(("директор по маркетингу", "генеральный директор"))).collect()
    assert {(r.entity_id, r.full_name, r.position) for r in found} == {("a", "Иван Петров", "директор по маркетингу"), ("b", "И.И. Иванов", "генеральный директор")}


def test_people_once_a_company(spark):
    said = "Анна Смирнова, CEO, anna@a.ru и https://t.me/anna"
    found = research.people(texts(spark, ("a", said), ("a", said + " снова"), ("b", said)), ["CEO"]).collect()
    assert sorted((r.entity_id, r.ord) for r in found) == [("a", 0), ("b", 2)]
    assert all(r.emails == ["anna@a.ru"] and r.profiles == ["https://t.me/anna"] for r in found)
    far = research.people(texts(spark, ("a", "Лев Толстой " + "x" * 200 + " CEO")), ["CEO"])
    assert far.count() == 0 and research.people(texts(spark, ("a", None), ("a", "")), ["CEO"]).count() == 0


def test_channels_are_read_for_the_first_only(spark):
    """The windows of people who are met again are not searched: the addresses stand above the limit to the first."""
    rows = texts(spark, *(("a", f"Анна Смирнова, CEO, anna{i}@a.ru") for i in range(50)))
    found = research.people(rows.repartition(4), ["CEO"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.ord, r.emails) for r in found.collect()] == [(0, ["anna0@a.ru"])]
    assert plan.index(" AS emails#") < plan.index("Window")


def test_windows_of_a_text_full_of_a_term(spark):
    rows = spark.createDataFrame([(1, "ab " * 5000)], "doc_id int, text string")
    got = extract.windows_around(rows, ["AB"], 4).orderBy("at").collect()
    assert len(got) == 5000 and [r.at for r in got[:3]] == [0, 3, 6] and got[1].window == "ab ab ab "


def test_useful_links(spark):
    links = spark.createDataFrame([(SITE, SITE + x) for x in ("team", "shop", "login/team", "x?view=contacts", "")], "url string, link string")
    assert {r.link for r in extract.in_site(links).collect()} == {SITE + "team", SITE + "x?view=contacts"}
    assert spark.range(1).select(extract.fits(F.lit("/О-Компании"), lex.USEFUL_PATH), extract.fits(F.lit("/Личный"), lex.BLOCKED_PATH)).first() == (True, True)


def test_cms_items(spark):
    body = '[{"link": "a.ru/1", "content": {"rendered": "<p>x</p>"}, "description": "plain {rendered}"}, {"url": "a.ru/2", "description": {"rendered": "r"}, "title": {"rendered": "T"}}, {"source_url": "https://a.ru/f.PDF?1", "name": "N"}, {"content": {"rendered": "no place"}}]'
    got = records.cms_items(spark.createDataFrame([("s", body), ("t", None), ("u", "no json"), ("v", "[]")], "site string, body string")).orderBy("ord").collect()
    assert [(r.url, r.name, r.html, r.pdf) for r in got] == [("https://a.ru/1", None, "<p>x</p> plain {rendered}", None), ("https://a.ru/2", "T", "r", None), ("https://a.ru/f.PDF?1", "N", "", "https://a.ru/f.PDF?1")]


def test_classification_by_parts_of_words(spark):
    catalog = spark.createDataFrame([(1, "need animation studio", 50), (2, "animation animation", 50), (3, "other things", 99)], "query_id long, query string, priority int")
    results = spark.createDataFrame([(1, None, "Reanimations everywhere"), (2, "animation animation", "x"), (3, "unknown", ""), (4, None, None), (5, None, "a STUDIO that needs animation")], "result_id int, query string, text string")
    for part in (50_000, 1):
        got = {r.result_id: (r.query_id, r.matches) for r in demand.classify(results, catalog, part).collect()}
        assert got == {1: (2, 2), 2: (2, None), 3: (3, 0), 4: (3, 0), 5: (1, 3)}
    assert {(r.query_id, r.matches) for r in demand.classify(results, catalog.where("false")).collect()} == {(None, None)}


def test_catalog_has_its_size(spark):
    catalog = demand.build_catalog(spark)
    assert catalog.count() == 710 and catalog.where("query like '%механизма действия препарата%'").count() > 0
    assert catalog.where("channel = 'social' and query like '%site:t.me%'").count() > 0 and catalog.where("channel = 'forum' and query like '%site:vc.ru%'").count() > 0
    days = spark.createDataFrame([("2026-08-21",), ("2026-08-22",)], "day string")
    taken = demand.daily_sample(catalog, days).join(catalog.drop("ord"), "id")
    assert {r.day: r["count"] for r in taken.groupBy("day").count().collect()} == {"2026-08-21": 36, "2026-08-22": 36}
    assert {"social", "forum", "web"} <= {r.channel for r in taken.where("day = '2026-08-21'").select("channel").collect()} and taken.where("locale = 'en'").count() > 0


def test_demand_scores(spark):
    now = "2026-08-21T00:00:00Z"
    rows = [
        ("Ищем подрядчика на ролик по охране труда", "https://t.me/example/42", "Нужно сделать анимационный видеоинструктаж. Есть бюджет и ТЗ. Пишите producer@example.ru", now, "Закупки", "vendor_search"),
        ("Ищу работу", "https://example.com/job", "Ищу работу аниматором, нужен бесплатный курс и tutorial", None, None, "vendor_search"), (None, "https://example.com/x", None, None, None, None),
    ]
    got = demand.score_results(spark.createDataFrame(rows, "title string, url string, content string, published_at string, author string, intent string"), F.lit(now).cast("timestamp")).collect()
    brief, job, none = got
    assert brief.score >= 75 and "producer@example.ru" in brief.emails and "https://t.me/example/42" in brief.social_urls and brief.score_reasons[0].startswith("+ намерение: ищем")
    assert job.score < 25 and none.score == 0


def test_sitemaps_of_robots_files(spark):
    lines = ["User-agent: bad", "Disallow: /x", "Sitemap: /a.xml # main", "sitemap:https://b.example/s", "Sitemap: /a.xml", "Sitemap:", "# Sitemap: /no"]
    rows = spark.createDataFrame([("h.example", i, x) for i, x in enumerate(lines)] + [("h.example", 9, None)], "host string, line_no int, line string")
    assert [(r.ord, r.sitemap) for r in extract.robots_sitemaps(rows).orderBy("ord").collect()] == [(2, "https://h.example/a.xml"), (3, "https://b.example/s")]


def test_dates_of_articles(spark):
    assert spark.range(1).select(norm.compact_date(F.lit("20260817T102030Z")), norm.compact_date(F.lit("yesterday")), norm.compact_date(F.lit(None))).first() == ("2026-08-17T10:20:30Z", "yesterday", None)


def test_contacts_that_a_model_made_up_go(spark):
    shape = "entity_id int, answer_id int, full_name string, position string, emails array<string>, phones array<string>, social_urls array<string>, urls array<string>"
    rows = [
        (1, 1, " Анна ", "CEO", ["ANNA@a.ru", "made@up.ru"], None, ["https://t.me/anna", "https://t.me/other"], ["https://a.ru/1", "https://no.ru"]), (1, 2, None, None, ["made@up.ru"], [], [], ["https://a.ru/1"]),
        (1, 3, None, None, [], ["+7 1"], [], ["https://a.ru/1"]), (1, 4, None, None, ["anna@a.ru"], [], [], ["https://no.ru"]), (2, 5, None, None, ["anna@a.ru"], [], [], ["https://a.ru/1"]), (1, 6, None, None, None, None, None, None),
    ]
    evidence = spark.createDataFrame([(1, "https://a.ru/1", "T", "Anna@A.ru https://t.me/anna")], "entity_id int, url string, title string, snippet string")
    got = {r.answer_id: r for r in records.model_contacts(spark.createDataFrame(rows, shape), evidence).collect()}
    assert set(got) == {1, 3}
    assert (got[1].full_name, got[1].emails, got[1].social_urls, got[1].urls) == ("Анна", ["anna@a.ru"], ["https://t.me/anna"], ["https://a.ru/1"]) and got[3].phones == ["+71"]


def test_companies_by_hand_and_from_leads(spark):
    assert records.manual_company(spark, "Firm", "Firm.example").first()[:5] == (None, "Firm", None, "Firm", "https://firm.example/")
    field = "array<struct<id:int,code:string,type:string,name:string,values:array<struct<value:string>>>>"
    leads = spark.createDataFrame(
        [(i, 1, "open", f"L{i}", c, link, None, None) for i, c, link in ((3, 9, "link"), (1, None, "link"), (2, 8, " "), (4, 8, "x"))] + [(0, 2, "open", "other", 9, "x", None, None)],
        f"id long, pipeline_id int, status_id string, name string, company_id long, company_name string, fields {field}, contact_ids array<long>",
    )
    companies = spark.createDataFrame([(9, "Own", None), (8, "", None)], f"id long, name string, fields {field}")
    got = records.lead_queue(leads, companies, 1, "open", 3).orderBy("lead_id").collect()
    assert [(r.lead_id, r.company) for r in got] == [(1, "link"), (2, "L2"), (3, "Own")]
