"""The queries of ``queries.py`` in SQL."""

from __future__ import annotations

from contactry.functions import lexicons as lex

from .queries import RUN_TS, TERMS

_names = ", ".join(f"'{m}'" for m in lex.GENERIC_MAILBOXES)
_generic = f"(split_part(email, '@', 1) IN ({_names}) OR regexp_matches(split_part(email, '@', 1), '{lex.GENERIC_PREFIX}'))"
_emails = rf"""
  e0 AS (SELECT doc_id, source, unnest(list_distinct_ordered) AS email FROM (
    SELECT doc_id, source, list_transform(regexp_extract_all(text, '{lex.EMAIL}'), lambda x: regexp_replace(regexp_replace(lower(trim(x)), '^mailto:', ''), '[?#].*$', '')) AS list_distinct_ordered FROM documents)),
  emails AS (SELECT doc_id, source, email FROM e0 WHERE NOT regexp_matches(email, '\.(png|jpe?g|gif|webp|svg)$') GROUP BY ALL)"""
_phones = rf"""
  p0 AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '{lex.PHONE}')) AS raw FROM documents),
  phones AS (SELECT doc_id, source, CASE WHEN starts_with(trim(raw), '+') THEN '+' ELSE '' END || regexp_replace(raw, '[^0-9]', '', 'g') AS phone FROM p0
             WHERE length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 10 GROUP BY ALL)"""
_url = "regexp_extract(url, '(?i)^https?://[^/?]+')"
_escaped = lambda c: f"""array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN unicode(x) > 126 OR unicode(x) < 33 OR x IN ('"', '<', '>', '^', '`', '{{', '}}') THEN url_encode(x) ELSE x END), '')"""
_rest = _escaped("regexp_replace(u, '(?i)^https?://[^/?]+', '')")
_normal = rf"""CASE WHEN regexp_extract(u, '(?i)^https?://[^/?]+') <> '' THEN lower(regexp_extract(u, '(?i)^https?://[^/?]+')) ||
  CASE WHEN starts_with(regexp_replace(u, '(?i)^https?://[^/?]+', ''), '/') THEN '' ELSE '/' END || {_rest} END"""
_domain = lambda c: rf"nullif(regexp_replace(lower(regexp_extract({c}, '(?i)^https?://([^/?#:]+)', 1)), '^www\.', ''), '')"
_path = lambda c: rf"regexp_extract({c}, '(?i)^https?://[^/?#]+([^?#]*)', 1)"
_links = rf"""
  h AS (SELECT page_id, url, regexp_extract(url, '(?i)^https?://[^/?#]+') AS site, list_transform(regexp_extract_all(html, '(?i)href=["'']([^"''#]+)', 1), lambda x: trim(x)) AS hs FROM pages),
  h2 AS (SELECT page_id, url, site, generate_subscripts(hs, 1) - 1 AS ord, unnest(hs) AS href FROM h),
  h3 AS (SELECT page_id, url, ord, regexp_replace(CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END, '#.*$', '') AS u FROM h2),
  links AS (SELECT page_id, url, ord, {_normal} AS link FROM h3 WHERE {_normal} IS NOT NULL)"""
_moved = r"""FROM (SELECT page_id, url, regexp_replace(html, 'href="/([a-t])', 'href="/team/\1', 'g') AS html FROM pages)"""
_groups = rf"""
  {_emails}, {_phones},
  keys AS (SELECT source, doc_id, 'email:' || email AS key FROM emails UNION SELECT source, doc_id, 'phone:' || phone FROM phones),
  reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM keys UNION
     SELECT reach.a, y.doc_id FROM reach JOIN keys x ON x.doc_id = reach.b JOIN keys y ON x.source = y.source AND x.key = y.key),
  groups AS (SELECT a AS cand_id, min(b) AS group_id FROM reach GROUP BY a)"""
_scored = rf"""
  {_groups},
  per AS (SELECT g.group_id, any_value(k.source) AS entity_id, count(DISTINCT g.cand_id) AS n FROM groups g JOIN (SELECT DISTINCT source, doc_id FROM keys) k ON k.doc_id = g.cand_id GROUP BY 1),
  mail AS (SELECT g.group_id, bool_or(NOT {_generic}) AS direct FROM groups g JOIN emails e ON e.doc_id = g.cand_id GROUP BY 1),
  tel AS (SELECT g.group_id, count(DISTINCT phone) AS n_phones FROM groups g JOIN phones p ON p.doc_id = g.cand_id GROUP BY 1),
  scored AS (SELECT entity_id, per.group_id, coalesce(n_phones, 0) AS n_phones,
     greatest(0, least(100, CASE WHEN direct THEN 35 WHEN NOT direct THEN 20 ELSE 0 END + CASE WHEN n_phones > 0 THEN 8 ELSE 0 END + CASE WHEN n >= 2 THEN 5 ELSE 0 END + 10))::INTEGER AS score
     FROM per LEFT JOIN mail USING (group_id) LEFT JOIN tel USING (group_id))"""
_n = lambda words: " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in words)
_demand = f"""
  base AS (SELECT *, sha256(lower('https://' || source || '.example/' || (doc_id % 500))) AS fingerprint, {', '.join(f'{_n(v)} AS n_{k}' for k, v in TERMS.items())} FROM documents),
  demand AS (SELECT *, greatest(0, least(100,
     CASE WHEN n_intent > 0 THEN least(35, 18 + 5 * n_intent) ELSE 0 END + CASE WHEN n_fit > 0 THEN least(30, 12 + 4 * n_fit) ELSE 0 END
     + CASE WHEN n_strong > 0 THEN least(25, 15 + 5 * n_strong) ELSE 0 END - CASE WHEN n_negative > 0 THEN least(50, 25 + 10 * n_negative) ELSE 0 END
     + CASE WHEN doc_id % 60 <= 3 THEN 16 WHEN doc_id % 60 <= 14 THEN 10 WHEN doc_id % 60 <= 45 THEN 4 ELSE 0 END
     + CASE WHEN doc_id % 2 = 0 AND source <> '' THEN 5 ELSE 0 END + CASE WHEN lang = 'en' THEN 8 ELSE 0 END + CASE WHEN contains(text, '@') THEN 12 ELSE 0 END))::INTEGER AS score FROM base)"""
_platform = "CASE " + " ".join(f"WHEN {' OR '.join(f'''host = '{h}' OR ends_with(host, '.{h}')''' for h in hosts)} THEN '{p}'" for p, hosts in lex.PLATFORM_HOSTS) + " ELSE 'other' END"
_flat = r"trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))"
_tags = "script|style|noscript|svg|iframe|template"

ORACLE = {
    "emails_in_documents": f"WITH {_emails} SELECT doc_id, email, {_generic} AS generic, 75 AS confidence FROM emails",
    "phones_in_documents": f"WITH {_phones} SELECT doc_id, phone FROM phones",
    "url_parts": f"WITH x AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), y AS (SELECT page_id, {_normal} AS normal FROM x) SELECT page_id, normal, {_domain('normal')} AS domain, {_path('normal')} AS path FROM y",
    "fingerprint_documents": "SELECT doc_id, sha256(lower(text)) AS fingerprint FROM documents",
    "truncate_texts": f"SELECT doc_id, CASE WHEN length({_flat}) > 120 THEN left({_flat}, 119) || '…' ELSE {_flat} END AS short FROM documents",
    "fnv_sources": "SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('2024-02-01:' || source, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM documents",
    "freshness_days": f"SELECT event_id, floor(greatest(0, (epoch_us(TIMESTAMP '{RUN_TS}') - epoch_us(ts)) / 86400000000.0))::BIGINT AS days FROM events",
    "page_text": rf"""SELECT page_id,
      trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS title,
      trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<({_tags})[^>]*>.*?</({_tags})>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""",
    "page_links": f"WITH {_links} SELECT page_id, url, ord::BIGINT AS ord, link FROM links",
    "top_links_per_page": rf"""WITH {_links.replace("FROM pages", _moved)}, own AS (SELECT page_id, link, min(ord) AS ord FROM links WHERE {_domain('url')} = {_domain('link')} AND regexp_matches({_path('link')} || regexp_extract(link, '[?].*$'), '{lex.USEFUL_PATH}')
        AND NOT regexp_matches({_path('link')}, '{lex.BLOCKED_PATH}') GROUP BY 1, 2),
      s AS (SELECT *, (CASE WHEN {_path('link')} = '/' THEN 110 ELSE 0 END + CASE WHEN regexp_matches({_path('link')}, '{lex.HIGH_VALUE_PATH}') THEN 100 ELSE 0 END + CASE WHEN regexp_matches({_path('link')}, '{lex.USEFUL_PATH}') THEN 25 ELSE 0 END - len(string_split({_path('link')}, '/')))::BIGINT AS score FROM own),
      r AS (SELECT page_id, link, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 3""",
    "robots_filter": f"WITH {_links} SELECT page_id, ord::BIGINT AS ord, link FROM links WHERE NOT ({_domain('link')} IN (SELECT {_domain('url')} FROM pages) AND (starts_with({_path('link')}, '/a') OR starts_with({_path('link')}, '/p')))",
    "first_wins_dedup": "SELECT min(doc_id) AS doc_id, sha256(lower(text)) AS key, count(*) AS copies FROM documents GROUP BY 2",
    "union_evidence": "SELECT 'documents' AS stage, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'pages', count(*), sum(length(html))::BIGINT FROM pages UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations",
    "provider_status": "SELECT source, CASE WHEN bool_or(length(text) > 20000) THEN 'used' ELSE 'failed' END AS status, count(*) AS results FROM documents GROUP BY 1",
    "term_windows": r"""WITH f AS (SELECT doc_id, lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS t FROM documents), x AS (SELECT doc_id, t, unnest(['rights reserved', 'licensed under']) AS term FROM f)
      SELECT doc_id, term, ((length(t) - length(replace(t, term, ''))) // length(term))::BIGINT AS places, (instr(t, term) - 1)::BIGINT AS first_at FROM x WHERE contains(t, term)""",
    "allowlist_semi_join": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)",
    "resolve_components": f"WITH RECURSIVE {_groups} SELECT cand_id, group_id FROM groups",
    "best_email": f"WITH RECURSIVE {_groups} SELECT DISTINCT group_id, email AS value, CASE WHEN {_generic} THEN 'general' ELSE 'found' END AS status, {_generic} AS generic, 75::BIGINT AS confidence FROM groups g JOIN emails e ON e.doc_id = g.cand_id",
    "contact_scores": f"WITH RECURSIVE {_scored} SELECT entity_id, group_id, n_phones, score FROM scored",
    "top_contacts_per_source": f"WITH RECURSIVE {_scored}, r AS (SELECT entity_id, group_id, score, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, group_id)::INTEGER AS rank FROM scored WHERE score >= 10) SELECT * FROM r WHERE rank <= 5",
    "confidence_buckets": f"WITH RECURSIVE {_scored} SELECT count(*) FILTER (score >= 75) AS high, count(*) FILTER (score >= 45 AND score < 75) AS middle, count(*) FILTER (score < 45) AS low FROM scored",
    "demand_scores": f"WITH {_demand} SELECT doc_id, n_intent, n_fit, n_strong, n_negative, score FROM demand",
    "top_signals": f"WITH {_demand}, r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, doc_id) AS nth FROM demand WHERE score >= 25) SELECT fingerprint, doc_id, score FROM r WHERE nth = 1 ORDER BY score DESC, doc_id LIMIT 120",
    "signal_upsert": f"""WITH {_demand}, r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, doc_id % 2 ORDER BY score DESC, doc_id) AS nth FROM demand),
      o AS (SELECT * FROM r WHERE nth = 1 AND doc_id % 2 = 0), n AS (SELECT * FROM r WHERE nth = 1 AND doc_id % 2 = 1)
      SELECT coalesce(n.fingerprint, o.fingerprint) AS fingerprint, CASE WHEN n.fingerprint IS NOT NULL THEN n.score ELSE o.score END AS score, coalesce(o.doc_id, n.doc_id) AS first_seen_at, coalesce(o.lang, n.lang) AS status FROM o FULL JOIN n ON o.fingerprint = n.fingerprint""",
    "review_decisions": """WITH t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' END AS wanted FROM labels),
      r AS (SELECT CASE WHEN d.doc_id % 3 <> 0 AND wanted IS NOT NULL THEN wanted ELSE 'pending' END AS decision, CASE WHEN d.doc_id % 3 = 0 THEN lang END AS synced_at FROM documents d LEFT JOIN t USING (doc_id))
      SELECT decision, count(*) AS n, count(synced_at) AS synced FROM r GROUP BY 1""",
    "lead_queue": "SELECT o_orderkey, coalesce(nullif(trim(c_name), ''), 'unnamed') AS company, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100",
    "query_matrix": "SELECT c_custkey, nth, replace(form, '{}', c_name) AS query FROM customer, (VALUES (0, 'contacts {}'), (1, '{} team'), (2, '{} press service'), (3, '{} tender')) f(nth, form)",
    "rejected_contacts": "SELECT source, count(*) AS rejected FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY 1",
    "run_totals": "SELECT count(*) AS results, count(DISTINCT source) AS sources, count(DISTINCT CASE WHEN lang = 'en' THEN lower(source) END) AS en_sources, sum(n_chars)::BIGINT AS chars FROM documents",
    "customer_initials": "WITH w AS (SELECT c_custkey, list_filter(string_split(trim(replace(c_name, '#', ' ')), ' '), lambda x: x <> '') AS w FROM customer) SELECT c_custkey, upper(left(w[1], 1)) || coalesce(upper(left(w[2], 1)), '') AS initials FROM w",
}
