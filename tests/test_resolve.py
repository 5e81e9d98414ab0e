from pyspark.sql import functions as F

from contactry.operators import merge, resolve, score
from contactry.plans import contact_queries
from contactry.storage import store

MAIL = "array<struct<value:string,generic:boolean,deliverability:string,confidence:int,status:string,domain_has_mx:boolean>>"
ROWS = f"entity_id string, cand_id long, ord long, full_name string, position string, emails {MAIL}, phones array<string>, social_urls array<string>, social_profiles array<struct<platform:string,kind:string>>, evidence array<struct<source:string,url:string,published_at:timestamp>>"


def test_contacts_are_combined_without_lists(spark):
    mail = ("a@b.example", False, "undeliverable", 75, "found", None)
    rows = [
        ("e", 1, 1, None, None, [mail], ["1", "2"], [], [], [("web", "u", None)]),
        ("e", 2, 2, "Name", None, [mail], ["2", "3"], [], [], [("web", "u", None)]),
        ("e", 3, 3, "Other", "Head", [], [], ["s"], [("vk", "person")], [("web", "v", None)]),
        ("e", 4, 4, None, None, [mail], [], [], [], [("web", "u", None)]),
    ]
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "cand_id long, group_id long")
    merged = resolve.combine(spark.createDataFrame(rows, ROWS), groups, score.contact_facts())
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "flatten" not in plan
    one, four = score.apply_rules(merged, score.contact_rules(F.lit("2024-02-01").cast("timestamp"))).orderBy("group_id").collect()
    assert (one.full_name, one.position, one.n_phones, one.ord, one.several_urls, one.alive) == ("Name", "Head", 3, 1, True, False)
    assert {"-100 undeliverable", "+5 several sources", "+12 social profile", "+8 phone", "+10 confidence"} <= set(one.score_reasons)
    assert (four.n_phones, four.several_urls, four.phone) == (0, False, False)


def candidate(i, name=None, position=None, mails=(), phones=(), social=(), evidence=(), profiles=()):
    emails = [(v, g, d, c, s, None) for v, g, d, c, s in mails]
    return ("company", i, i, name, position, emails, list(phones), list(social), list(profiles), [(s, u, None) for s, u in evidence])


def contacts(spark, *rows, roles=(), least=35):
    found = merge.contacts(spark.createDataFrame(list(rows), merge.CANDIDATE), F.lit("2024-02-01").cast("timestamp"), roles, store, least=least)
    return sorted(found.collect(), key=lambda r: (r.rank is None, r.rank, r.group_id))


def test_equal_addresses_merge(spark):
    rows = (
        candidate(1, mails=[("Person@Example.com", False, "unknown", None, None)], evidence=[("website", "https://example.com/team")]),
        candidate(2, "Иван Петров", "Директор по маркетингу", [("person@example.com", False, "deliverable", 92, None)], evidence=[("hunter", "https://example.com/ivan")]),
    )
    (one,) = contacts(spark, *rows)
    assert one.full_name == "Иван Петров" and one.n_evidence == 2 and len(one.evidence) == 2
    assert [(e.value, e.deliverability, e.confidence) for e in one.emails] == [("person@example.com", "deliverable", 92)]


def test_a_named_decision_maker_comes_first(spark):
    rows = (
        candidate(1, "Анна Смирнова", "Директор по маркетингу", [("anna@example.com", False, "deliverable", 90, None)], evidence=[("website", "https://example.com/team"), ("hunter", "https://example.com/about")]),
        candidate(2, mails=[("info@example.com", True, "unknown", None, None)], evidence=[("website", "https://example.com/contacts")]),
    )
    anna, info = contacts(spark, *rows, roles=("директор по маркетингу",))
    assert anna.full_name == "Анна Смирнова" and anna.score >= 90 and (anna.rank, info.rank) == (1, 2)
    assert info.emails[0].value == "info@example.com" and info.score_reasons[-1].startswith("fallback")


def test_an_address_that_takes_no_mail_is_not_selected(spark):
    (bad,) = contacts(spark, candidate(1, "Bad Address", "CEO", [("bad@example.com", False, "undeliverable", None, None)], evidence=[("hunter", "https://example.com")]), roles=("ceo",), least=1)
    assert bad.rank is None


def test_ties_through_others_merge(spark):
    rows = (
        candidate(1, "Иван Петров", "CEO", social=["https://t.me/ivan"], evidence=[("website", "https://example.com/team")]),
        candidate(2, social=["https://t.me/ivan"], mails=[("ivan@example.com", False, "unknown", None, "found")], evidence=[("searxng", "https://search.example/ivan")]),
        candidate(3, "Иван Петров", "CEO", phones=["+79990000000"], evidence=[("rss", "https://example.com/feed/ivan")]),
    )
    (one,) = contacts(spark, *rows)
    assert len(one.evidence) == 3 and one.emails[0].value == "ivan@example.com" and one.phones == ["+79990000000"]


def test_an_inferred_address_is_no_channel(spark):
    (one,) = contacts(spark, candidate(1, "Иван Петров", "CEO", [("ivan@example.com", False, "unknown", None, "inferred")], evidence=[("website", "https://example.com/team")]), roles=("ceo",))
    assert one.rank is None


def test_equal_inferred_addresses_merge(spark):
    """Two people of one name without an address: the one inferred for both makes them one; the other groups keep their names."""
    rows = (
        candidate(1, mails=[("anna.sidorova@company.ru", False, "unknown", 75, "found")]),
        candidate(2, "Иван Иванов", "директор", phones=["+7 495 1"], social=["s2"], profiles=[("vk", "person", "s2")]),
        candidate(3, "Иван Иванов", "ceo", phones=["+7 495 2", "+74951"], social=["s3"]),
        candidate(4, "Пётр", "ceo", phones=["3"]), candidate(5, None, None, phones=["4"]),
    )
    by = {r.group_id: r for r in contacts(spark, *rows)}
    assert set(by) == {1, 2, 4, 5}
    two = by[2]
    assert [(e.value, e.status, e.confidence) for e in two.emails] == [("ivan.ivanov@company.ru", "inferred", 35)]
    assert two.phones == ["+74951", "+74952"] and two.social_urls == ["s2", "s3"] and two.n_social_profiles == 1 and two.position == "директор"


def test_lists_are_cut_and_counted(spark):
    rows = [candidate(i, social=["hub"], phones=[str(10_000 + i)]) for i in range(120)]
    (one,) = contacts(spark, *rows)
    assert one.n_phones == 120 and len(one.phones) == merge.SHOWN and one.phones[0] == "10000" and one.social_urls == ["hub"]


def test_domains_that_take_no_mail(spark):
    rows = spark.createDataFrame([candidate(1, mails=[("a@x.ru", False, "unknown", 1, "found"), ("b@y.ru", False, "unknown", 1, "found")]), candidate(2)], merge.CANDIDATE)
    got = {r.cand_id: [e.domain_has_mx for e in r.emails] for r in merge.with_mx(rows, spark.createDataFrame([("x.ru", False)], "domain string, has_mx boolean")).collect()}
    assert got == {1: [False, None], 2: []}


def test_contacts_of_no_candidates(spark):
    assert contacts(spark) == []


def test_whole_lists(spark):
    rows = [candidate(i, social=["hub"], phones=[str(10_000 + i)], profiles=[("vk", "person", f"s{i}")]) for i in range(120)]
    found = merge.contacts(spark.createDataFrame(rows, merge.CANDIDATE), F.lit("2024-02-01").cast("timestamp"), (), store, shown=None)
    assert found.first().phones == [str(10_000 + i) for i in range(120)]
    assert merge.totals(found).select("phones", "profiles").first() == (120, 120)


def test_contact_queries_list_whole_groups(spark, tmp_path):
    """70 people of one name and company without an address are one contact with 70 phones."""
    people = spark.range(70).selectExpr("id * 420 AS p").selectExpr("explode(array(3 * p, 3 * p + 1, 3 * p + 2)) AS c_custkey")
    known = spark.range(3).selectExpr("id + 63 AS c_custkey")
    people.unionByName(known).write.parquet(f"{tmp_path}/customer.parquet")
    found = {r.group_id: r for r in contact_queries.merged_contacts(spark, str(tmp_path)).collect()}
    assert len(found) == 2 and len(found[0].phones.split()) == 70 and len(found[0].social_urls.split()) == 140
