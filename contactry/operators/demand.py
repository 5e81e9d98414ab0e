"""The demand catalog, its daily sample, and the classification of results by it."""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contactry.functions import catalog as cat
from contactry.functions import lexicons as lex
from contactry.functions import normalize as norm

from . import extract, score


def build_catalog(spark: SparkSession) -> DataFrame:
    """ord, id, query, category, intent, priority, locale, channel; of queries equal in lower case the first stays."""
    phrases = [(i, j, category, phrase) for i, (category, group) in enumerate(cat.SERVICES) for j, phrase in enumerate(group)]
    services = spark.createDataFrame(phrases, "service int, nth int, category string, phrase string")
    intents = spark.createDataFrame([(i, *v) for i, v in enumerate(cat.INTENTS)], "step int, words string, intent string, priority int")
    sites = lambda names: " OR ".join(f"site:{n}" for n in names)
    derived = [
        (len(cat.INTENTS), "social", f"({sites(cat.SOCIAL_SITES)})", "market_signal", cat.SOCIAL_PRIORITY, "social"),
        (len(cat.INTENTS) + 1, "forum", f"({sites(cat.FORUM_SITES)})", "problem", cat.FORUM_PRIORITY, "forum"),
    ]
    others = spark.createDataFrame(derived, "step int, words string, tail string, intent string, priority int, channel string")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    web = services.crossJoin(F.broadcast(intents)).withColumns({"query": F.concat_ws(" ", quoted(F.col("words")), quoted(F.col("phrase"))), "channel": F.lit("web")})
    more = services.crossJoin(F.broadcast(others)).withColumn("query", F.concat_ws(" ", quoted(F.col("phrase")), "tail")).drop("tail")
    russian = web.unionByName(more).select(
        F.struct("service", "nth", "step").alias("ord"), norm.slug(F.col("category"), F.col("words"), F.col("phrase")).alias("id"),
        "query", "category", "intent", "priority", F.lit("ru").alias("locale"), "channel",
    )
    english = spark.createDataFrame([(i, *v) for i, v in enumerate(cat.ENGLISH)], "nth int, category string, query string, intent string").select(
        F.struct(F.lit(len(cat.SERVICES)).alias("service"), "nth", F.lit(0).alias("step")).alias("ord"), norm.slug(F.col("category"), F.col("query")).alias("id"),
        "query", "category", "intent", F.lit(cat.ENGLISH_PRIORITY).alias("priority"), F.lit("en").alias("locale"), F.lit("forum").alias("channel"),
    )
    first = W.partitionBy(F.lower("query")).orderBy("ord")
    return russian.unionByName(english).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def daily_sample(catalog: DataFrame, days: DataFrame, budget: int = 36) -> DataFrame:
    """day, id, stratum of the queries that each day takes: fixed strata first, each by a hash of day and id, then the rest."""
    left, limits = budget, []
    for name, most in cat.STRATA:
        limits.append((name, min(most, left)))
        left -= limits[-1][1]
    stratum = (
        F.when((F.col("priority") >= cat.CORE_PRIORITY) & (F.col("channel") == "web"), "core")
        .when(F.col("channel") == "social", "social")
        .when((F.col("channel") == "forum") & (F.col("locale") == "ru"), "forum-ru")
        .when(F.col("locale") == "en", "english")
        .otherwise("")
    )
    hashed = lambda salt: norm.fnv1a(F.concat_ws(":", "day", salt, "id"))
    rows = days.crossJoin(F.broadcast(catalog)).withColumn("stratum", stratum)
    nth = F.row_number().over(W.partitionBy("day", "stratum").orderBy("hash", "ord"))
    most = F.coalesce(*(F.when(F.col("stratum") == name, limit) for name, limit in limits), F.lit(0))
    ranked = rows.withColumn("hash", hashed(F.col("stratum"))).withColumn("taken", nth <= most)
    again = ranked.withColumn("hash", F.when(~F.col("taken"), hashed(F.lit("remaining"))))
    rest = F.row_number().over(W.partitionBy("day", "taken").orderBy("hash", F.desc("priority"), "ord"))
    chosen = again.withColumn("nth", rest).where(F.col("taken") | (F.col("nth") <= left))
    return chosen.select("day", "id", F.when(F.col("taken"), F.col("stratum")).otherwise("remaining").alias("stratum"))


def query_tokens(query: Column, stop: tuple[str, ...] = lex.QUERY_STOP_WORDS) -> Column:
    """Words of at least four characters, without search operators and stop words; a repeated word counts again."""
    plain = F.regexp_replace(F.lower(query), "site:[^ )]+", " ")
    return F.filter(F.split(plain, "[^a-zа-яё0-9-]+"), lambda t: (F.length(t) >= 4) & ~t.isin(*stop))


class QueryMatcher:
    """An automaton over the words of some catalog queries, which finds them as parts of words of a text in one pass."""

    def __init__(self, queries: list[tuple[int, int, str, list[str]]]):
        """queries: (id, priority, text, words); of equal matches the first by priority and id wins."""
        self.queries = sorted(queries, key=lambda q: (-q[1], q[0]))
        self.exact: dict[str, int] = {}
        where: dict[str, dict[int, int]] = {}
        for i, (id_, _, text, words) in enumerate(self.queries):
            self.exact[text] = min(id_, self.exact.get(text, id_))
            for w in words:
                where.setdefault(w, {})[i] = where.get(w, {}).get(i, 0) + 1
        self.rows = [(np.array(list(at)), np.array(list(at.values()))) for at in where.values()]
        self.machine = ahocorasick.Automaton()
        for n, w in enumerate(where):
            self.machine.add_word(w, n)
        self.machine.make_automaton()
        self.zeros = np.zeros(len(self.queries), np.int64)

    def best(self, low: str) -> tuple[int, int, int]:
        """(matches, priority, id) of the query with most words in a text in lower case."""
        counts = self.zeros.copy()
        if self.rows:
            for n in {n for _, n in self.machine.iter(low)}:
                at, times = self.rows[n]
                counts[at] += times
        i = int(counts.argmax())
        return int(counts[i]), self.queries[i][1], self.queries[i][0]


#: Queries in one automaton: some 10 MB on every worker. A larger catalog takes several passes.
CATALOG_PART = 50_000


def classify(results: DataFrame, catalog: DataFrame, part: int = CATALOG_PART) -> DataFrame:
    """result_id, query_id, matches: the query with the given text, else the one of which most words are in the result's text.

    results (result_id, query, text), catalog (query_id, query, priority). Words also match as parts of words; of equal
    matches the higher priority wins, then the smaller id. A result that shares nothing has the query of the highest
    priority, with 0 matches; ``matches`` is null for a given query, and both are null where the catalog is empty.
    The catalog's words are compiled into automata of at most ``part`` queries, each broadcast to all tasks: results are
    scanned once for every automaton, and no word is joined.
    """
    spark = results.sparkSession
    n = catalog.count()
    words = catalog.select("query_id", F.coalesce("priority", F.lit(0)).alias("priority"), "query", query_tokens(F.coalesce("query", F.lit(""))).alias("words"))
    parts = -(-n // part)
    marked = words.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(parts, 1))))
    schema = "exact long, matches long, priority long, query_id long"
    found = []
    for i in range(parts):
        rows = marked.where(F.col("part") == i).select("query_id", "priority", "query", "words").collect()  # about ``part`` rows
        if rows:
            found.append(_best_query(spark.sparkContext.broadcast([tuple(r) for r in rows]), schema)(F.col("query"), F.lower(F.coalesce("text", F.lit("")))))
    if not found:
        return results.select("result_id", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("matches"))
    told = results.select("result_id", *(f.alias(f"f{i}") for i, f in enumerate(found)))
    every = F.array(*(F.col(f"f{i}") for i in range(len(found))))
    exact = F.array_min(F.transform(every, lambda f: f["exact"]))
    best = F.array_max(F.transform(every, lambda f: F.struct(f["matches"].alias("matches"), f["priority"].alias("priority"), (-f["query_id"]).alias("neg"))))
    told = told.select("result_id", exact.alias("exact"), best.alias("best"))
    return told.select("result_id", F.coalesce("exact", -F.col("best.neg")).alias("query_id"), F.when(F.col("exact").isNull(), F.col("best.matches")).alias("matches"))


def _best_query(catalog, schema: str):
    name = uuid.uuid4().hex

    @F.pandas_udf(schema)
    def best(queries: pd.Series, texts: pd.Series) -> pd.DataFrame:
        matcher = _matcher(name, catalog)
        rows = [(matcher.exact.get(q), *matcher.best(t)) for q, t in zip(queries, texts, strict=True)]
        return pd.DataFrame(rows, columns=["exact", "matches", "priority", "query_id"]).astype({"exact": "Int64"})

    return best


_matchers: dict[str, QueryMatcher] = {}


def _matcher(name: str, catalog) -> QueryMatcher:
    """A worker compiles an automaton once, and keeps the last few."""
    if name not in _matchers:
        while len(_matchers) > 3:
            _matchers.pop(next(iter(_matchers)))
        _matchers[name] = QueryMatcher(catalog.value)
    return _matchers[name]


def plain_text(html: Column) -> Column:
    """Text without tags, entities of the markup itself decoded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \\t\\r\\n\\f\u00a0]+", " "))


def score_results(results: DataFrame, run_ts: Column, lexicon: dict | None = None, snippet: int = 4000) -> DataFrame:
    """Results (title, url, content, author, published_at, intent and further columns) as signals.

    Adds snippet, fingerprint, emails, phones, social_urls, score and score_reasons. Addresses of no person count only if
    they ask for contact; words are looked for in title and snippet, the address itself may be a channel.
    """
    rows = results.withColumns({"title": plain_text(F.col("title")), "snippet": norm.truncate(plain_text(F.col("content")), snippet)}).drop("content")
    rows = rows.withColumns({"text": F.concat_ws(" ", "title", "snippet"), "days": norm.age_days(norm.timestamp(F.col("published_at")), run_ts)})
    urls = F.concat(F.array("url"), F.regexp_extract_all("snippet", F.lit("(?i)https?://[^\\s<>\"')\\]]+"), F.lit(0)))
    social = F.array_distinct(F.filter(F.transform(urls, norm.social_url), lambda u: u.isNotNull()))
    asked = F.filter(extract.emails(F.lower("text")), lambda e: ~norm.is_generic(e) | e.rlike("info@|contact@|sales@"))
    rows = rows.withColumns({"emails": asked, "phones": extract.phones(F.col("text")), "social_urls": social})
    rows = rows.withColumns({"channels": F.size("emails") + F.size("phones") + F.size("social_urls"), "fingerprint": norm.fingerprint(F.col("url"))})
    return score.demand_score(rows, lexicon, reasons=True).drop("text", "days", "channels", *(f"n_{k}" for k in ("intent", "fit", "strong", "negative")))
