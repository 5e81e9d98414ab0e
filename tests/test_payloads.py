import json

from pyspark.sql import functions as F

from contactry.sources import payloads


def bodies(spark, *answers):
    return spark.createDataFrame([(f"q{i}", a if isinstance(a, str) or a is None else json.dumps(a)) for i, a in enumerate(answers)], "query string, body string")


def test_nothing_from_null_broken_or_empty_bodies(spark):
    odd = bodies(spark, None, "no json", {}, {"results": []})
    assert payloads.meta_search(odd).count() == 0
    assert payloads.grounded_answer(odd).count() == 0
    assert payloads.news_feed(odd).count() == 0


def test_paid_search_and_articles(spark):
    found = payloads.paid_search(bodies(spark, {"results": [{"url": "a.org", "score": 0.5}, {"url": " "}, {"title": "T", "url": "b.org"}]}))
    assert {(r.ord, r.title, r.url, r.score) for r in found.collect()} == {(0, "https://a.org/", "https://a.org/", 0.5), (2, "T", "https://b.org/", 0.0)}
    found = payloads.articles(bodies(spark, {"articles": [{"url": "a.org/x", "domain": "a.org", "language": "English"}, {"title": "no place"}]})).collect()
    assert [(r.title, r.content) for r in found] == [("a.org", "a.org · English")]


def test_instances_by_median(spark):
    good = lambda m: {"analytics": False, "network_type": "normal", "http": {"status_code": 200}, "timing": {"search": {"success_percentage": 95, "all": {"median": m}}}, "uptime": {"uptimeDay": 99}}
    answer = {"instances": {"slow": good(2.0), "fast": good(0.5), "unknown": good(None), "tor": good(0.1) | {"network_type": "tor"}}}
    assert [r.instance for r in payloads.healthy_instances(bodies(spark, answer)).orderBy("rank").collect()] == ["fast", "slow", "unknown"]


def test_equal_instances_by_name(spark):
    """Equal medians at equal places of several answers: the rank does not depend on how the answers are dealt."""
    good = {"analytics": False, "network_type": "normal", "http": {"status_code": 200}, "timing": {"search": {"success_percentage": 95, "all": {"median": 1.0}}}, "uptime": {"uptimeDay": 99}}
    rows = bodies(spark, *({"instances": {name: good}} for name in "hcagfbed"))
    for parts in (1, 5):
        assert [r.instance for r in payloads.healthy_instances(rows.repartition(parts), 4).orderBy("rank").collect()] == ["a", "b", "c", "d"]


def test_videos_of_the_last_days(spark):
    item = lambda v, day: {"id": {"videoId": v}, "snippet": {"publishedAt": f"2024-01-{day}T00:00:00Z"}}
    found = payloads.videos(bodies(spark, {"items": [item("new", 30), item("old", 10), {"id": {}}]}), F.lit("2024-02-01").cast("timestamp")).collect()
    assert [(r.title, r.url) for r in found] == [("new", payloads.VIDEO_URL + "new")]


def test_profiles_take_the_first_hits(spark):
    people = spark.createDataFrame([(x, x.upper(), "", "bio", None, "", f"site.org/{x}") for x in "abc"], "login string, name string, company string, bio string, email string, blog string, url string")
    found = payloads.profiles(bodies(spark, {"items": [{"login": x} for x in "abc"]}), people).orderBy("ord").collect()
    assert [(r.title, r.content) for r in found] == [("A", "bio"), ("B", "bio")]


def test_grounded_part_of_the_answer(spark):
    answer = {"answer": "one two", "chunks": [{"uri": "u"}, {"uri": "v"}, {"uri": "u"}], "supports": [{"start": 4, "stop": 7, "chunks": [0]}]}
    assert {(r.url, r.content) for r in payloads.grounded_answer(bodies(spark, answer)).collect()} == {("u", "two"), ("v", "Grounded source")}


def test_news_and_atom_feeds(spark):
    rss = "<rss><item><title>T</title><link>a.org</link><source url='x'>P</source><description><![CDATA[D]]></description></item><item><title>no link</title></item></rss>"
    assert [(r.title, r.url, r.content) for r in payloads.news_feed(bodies(spark, rss)).collect()] == [("T", "a.org", "P · D")]
    atom = spark.createDataFrame([("f.org", "<feed><entry><link rel='x' href='b.org/1'/><summary>S</summary><updated>2024</updated></entry></feed>")], "feed_url string, body string")
    assert [(r.title, r.url, r.text, r.published_at) for r in payloads.feed_items(atom).collect()] == [("https://b.org/1", "https://b.org/1", "S", "2024")]


def test_crawl_index_forms(spark):
    one, two = {"url": "a", "status": "200"}, {"url": "b", "status": "200"}
    forms = bodies(spark, [one, two], one, [["url", "status"], ["a", "200"], ["b", "200"]], json.dumps(one) + "\n" + json.dumps(two), "", [["url"]])
    found = payloads.crawl_index(forms).groupBy("query").agg(F.array_sort(F.collect_list(F.col("row")["url"])).alias("u")).collect()
    assert {r.query: r.u for r in found} == {"q0": ["a", "b"], "q1": ["a"], "q2": ["a", "b"], "q3": ["a", "b"]}
