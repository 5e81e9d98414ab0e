"""Queries of record sources, frontier, reports and run state, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from contactry.functions import catalog as cat
from contactry.functions import normalize as norm
from contactry.operators import dedup, extract, research
from contactry.sources import records

from .oracle import _emails, _normal, _path
from .payload_queries import _bodies
from .queries import _t
from .research_queries import NAME, ROLES, _list, social_profiles
from .research_queries import ORACLE as RESEARCH


def custom_fields(spark, d):
    kind = F.col("c_custkey") % 3
    value = lambda *v: F.array(*(F.struct(x.alias("value")) for x in v))
    text = lambda v: F.lit(v).cast("string")
    field = lambda id_, code, type_, name, values: F.struct(F.lit(id_).alias("id"), text(code).alias("code"), text(type_).alias("type"), text(name).alias("name"), values.alias("values"))
    web = field(1, "WEB", "text", "Site", value(text(""), F.concat(F.lower("c_mktsegment"), F.lit(".example.org/x"))))
    home = field(2, None, "url", "Home", value(F.concat(F.lit("http://Home"), "c_custkey", F.lit(".example.com#a"))))
    own = field(3, None, "text", "Company", value(text("  "), text(None), F.concat(F.lit(" "), "c_name")))
    fields = F.when(kind == 0, F.array(web, home, own)).when(kind == 1, F.array(own, home)).otherwise(F.array(own))
    rows = _t(spark, d, "customer").select("c_custkey", fields.alias("f"))
    return rows.select("c_custkey", records.website(F.col("f")).alias("website"), records.company_name(F.col("f"), 3).alias("company"), F.size(records.field_values(F.col("f"), lambda f: f["id"] > 0)).alias("n_values"))


def profile_pages(spark, d):
    return records.profiles_to_read(social_profiles(spark, d), 6)


def validated_answers(spark, d):
    docs = _t(spark, d, "documents").where(F.contains("text", F.lit("@")))
    told = docs.select(F.col("doc_id").alias("answer_id"), F.col("source").alias("entity_id"), F.array(F.concat(F.lit("doc:"), "doc_id"), F.concat(F.lit("doc:"), F.col("doc_id") + 1)).alias("urls"), F.concat(extract.emails(F.col("text")), F.array(F.lit("made@up.example"))).alias("emails"))
    held = docs.where("doc_id % 3 > 0").select(F.col("source").alias("entity_id"), F.concat(F.lit("doc:"), "doc_id").alias("url"), "text")
    return records.validated_answers(told, held).select("answer_id", F.array_join("urls", " ").alias("urls"), F.array_join("emails", " ").alias("emails"))


def provider_budgets(spark, d):
    names = F.array(*(F.lit(n) for n, _ in cat.BUDGETS))
    rows = _t(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("provider"), F.col("event_id").alias("ord"))
    return records.within_budgets(rows, cat.BUDGETS)


def open_frontier(spark, d):
    """Archived and live addresses, each once, without those visited."""
    pages = _t(spark, d, "pages").select("page_id", F.regexp_replace(norm.url(F.col("url")), "\\?.*$", "").alias("url"))
    both = dedup.union_streams(("archive", pages.where("page_id % 2 = 0")), ("live", pages.where("page_id % 3 = 0")))
    return dedup.first_wins(both, ["url"], ["stage_ord", "page_id"]).join(pages.where("page_id % 5 = 0").select("url"), "url", "left_anti").select("url", "stage", "page_id")


def distinct_evidence(spark, d):
    """Evidence once per source, address and title; pages once per source and address: how many of each stay."""
    rows = _t(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("u"), F.col("doc_id") % 50).alias("url"), F.col("lang").alias("title"))
    ev = dedup.first_wins(rows, ["source", "url", "title"], ["doc_id"]).groupBy("source").agg(F.count("*").alias("evidence"), F.sum("doc_id").alias("ids"))
    pages = dedup.first_wins(rows, ["source", "url"], ["doc_id"]).groupBy("source").agg(F.count("*").alias("pages"), F.array_join(F.array_sort(F.collect_set("title")), ",").alias("titles"))
    return ev.join(pages, "source")


def company_reports(spark, d):
    """One JSON line per company (source); a company without texts fails, but its row stays."""
    rows = _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("results"), F.count_if(F.length(F.coalesce("text", F.lit(""))) < 40).alias("failures"), F.count_distinct("lang").alias("languages"), F.sum("n_chars").alias("chars"))
    status = F.when(F.col("failures") > 0, "partly").otherwise("completed")
    return rows.select("source", F.to_json(F.struct("source", "results", "failures", "languages", "chars", status.alias("status"))).alias("report"))


def markdown_report(spark, d):
    """A table line per source, and its number of approved documents and of enrichment steps that failed."""
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("approved"), F.count("quality").alias("tried"))
    failed = F.greatest(F.lit(0).cast("long"), F.col("tried") - F.col("approved"))
    return rows.select(F.concat_ws(" | ", F.lit("|"), F.replace("source", F.lit("_"), F.lit(" ")), F.col("approved").cast("string"), failed.cast("string"), F.lit("|")).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        custom_fields, profile_pages, validated_answers, provider_budgets, open_frontier, distinct_evidence,
        company_reports, markdown_report,
    )
}

_budget = "CASE provider " + " ".join(f"WHEN '{n}' THEN {b}" for n, b in cat.BUDGETS) + " ELSE 0 END"
_score = r"(CASE WHEN {p} = '/' THEN 110 ELSE 0 END + CASE WHEN regexp_matches({p}, '{high}') THEN 100 ELSE 0 END + CASE WHEN regexp_matches({p}, '{useful}') THEN 25 ELSE 0 END - len(string_split({p}, '/')))::BIGINT"


def _link_score() -> str:
    from contactry.functions import lexicons as lex

    return _score.replace("{p}", _path("url")).replace("{high}", lex.HIGH_VALUE_PATH).replace("{useful}", lex.USEFUL_PATH)


_plain = "u0 AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages)"

ORACLE = {
    "custom_fields": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'https://' || lower(c_mktsegment) || '.example.org/x' WHEN 1 THEN 'http://home' || c_custkey || '.example.com/' END AS website, trim(c_name) AS company,
      CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS n_values FROM customer""",
    "profile_pages": f"""WITH s AS ({RESEARCH['social_profiles']}), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ord, lower(url)) AS n FROM s)
      SELECT entity_id, ord, CASE WHEN platform = 'telegram' THEN 'https://t.me/s/' || username ELSE url END AS page FROM r WHERE n <= 6""",
    "validated_answers": f"""WITH {_emails}, k AS (SELECT DISTINCT source, email FROM emails WHERE doc_id % 3 > 0), dd AS (SELECT DISTINCT doc_id, source FROM documents WHERE contains(text, '@')),
      m AS (SELECT e.doc_id, string_agg(DISTINCT e.email, ' ' ORDER BY e.email) AS emails FROM emails e JOIN k USING (source, email) GROUP BY 1),
      c AS (SELECT doc_id, source, 'doc:' || doc_id AS url FROM dd UNION SELECT doc_id, source, 'doc:' || (doc_id + 1) FROM dd),
      u AS (SELECT c.doc_id, string_agg(c.url, ' ' ORDER BY c.url) AS urls FROM c JOIN dd ON c.url = 'doc:' || dd.doc_id AND c.source = dd.source WHERE dd.doc_id % 3 > 0 GROUP BY 1)
      SELECT doc_id AS answer_id, urls, emails FROM m JOIN u USING (doc_id)""",
    "provider_budgets": f"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, {_list([n for n, _ in cat.BUDGETS])}[event_id % 5 + 1] AS provider, event_id AS ord FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY run_id, provider ORDER BY ord)::INTEGER AS nth FROM e) SELECT * FROM r WHERE nth <= {_budget}""",
    "open_frontier": f"""WITH {_plain}, p AS (SELECT page_id, regexp_replace({_normal}, '\\?.*$', '') AS url FROM u0), a AS (SELECT *, 0 AS s, 'archive' AS stage FROM p WHERE page_id % 2 = 0 UNION ALL SELECT *, 1, 'live' FROM p WHERE page_id % 3 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY s, page_id) AS n FROM a) SELECT url, stage, page_id FROM r WHERE n = 1 AND url NOT IN (SELECT url FROM p WHERE page_id % 5 = 0)""",
    "distinct_evidence": """WITH d AS (SELECT doc_id, source, 'u' || (doc_id % 50) AS url, lang FROM documents), e AS (SELECT source, url, lang, min(doc_id) AS doc_id FROM d GROUP BY 1, 2, 3), p AS (SELECT source, url, min_by(lang, doc_id) AS lang FROM d GROUP BY 1, 2)
      SELECT source, evidence, ids, pages, titles FROM (SELECT source, count(*) AS evidence, sum(doc_id)::BIGINT AS ids FROM e GROUP BY 1) JOIN (SELECT source, count(*) AS pages, string_agg(DISTINCT lang, ',' ORDER BY lang) AS titles FROM p GROUP BY 1) USING (source)""",
    "company_reports": """WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) < 40) AS f, count(DISTINCT lang) AS l, sum(n_chars)::BIGINT AS c FROM documents GROUP BY 1)
      SELECT source, '{"source":"' || source || '","results":' || n || ',"failures":' || f || ',"languages":' || l || ',"chars":' || c || ',"status":"' || CASE WHEN f > 0 THEN 'partly' ELSE 'completed' END || '"}' AS report FROM r""",
    "markdown_report": "SELECT '| | ' || replace(source, '_', ' ') || ' | ' || count(*) FILTER (quality = 1) || ' | ' || greatest(0, count(quality) - count(*) FILTER (quality = 1)) || ' | |' AS line FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
}
