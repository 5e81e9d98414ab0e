"""Queries of stored state: the streaming fold, replaced runs, checked writes, providers and companies that fail."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from contactry.operators import state
from contactry.sources import payloads, registry
from contactry.storage import shared_folder
from contactry.streaming import signals

from .payload_queries import _address, _bodies, _cut, _places
from .queries import _t

BATCHES = 4
SIGNAL = "fingerprint string, score int, first_seen_at timestamp, last_seen_at timestamp, status string, ord long"


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"


def _signals(spark, d):
    """Events as signals: a user's is one signal, seen again and again."""
    seen = F.col("ts").cast("timestamp")
    return _t(spark, d, "events").select(
        F.sha2(F.concat(F.lit("user "), "user_id"), 256).alias("fingerprint"), (F.col("event_id") * 37 % 101).cast("int").alias("score"), seen.alias("first_seen_at"), seen.alias("last_seen_at"),
        F.col("event_type").alias("status"), F.col("event_id").alias("ord"),
    )


def streamed_signals(spark, d):
    """The state after a stream of events in four loads, one a batch, of which one is folded twice; all cores write a load's files."""
    folder, rows = _folder(spark), _signals(spark, d)
    for i in range(BATCHES):  # the stream takes what has landed as one batch, whatever its number of files, and goes on from its checkpoint
        rows.where(F.col("ord") % BATCHES == i).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SIGNAL).parquet(f"{folder}/in")
        signals.run(stream, f"{folder}/state", f"{folder}/checkpoint", 8).awaitTermination()
    signals.fold(rows.where(F.col("ord") % BATCHES == BATCHES - 1), BATCHES - 1, f"{folder}/state", 8)
    schema = spark.createDataFrame([], SIGNAL).drop("ord").schema
    return signals.read_state(spark, f"{folder}/state", schema).withColumns({c: F.unix_micros(c) for c in ("first_seen_at", "last_seen_at")})


def _run_tables(spark, d, changed: bool = False):
    """Companies and candidates of runs: orders of a day and their lines; the second write of odd customers' orders has other candidates."""
    orders = _t(spark, d, "orders").select((F.col("o_orderkey") % 20).cast("string").alias("run_id"), F.col("o_orderkey").alias("source_lead_id"), F.col("o_orderstatus").alias("company_name"))
    lines = _t(spark, d, "lineitem").select((F.col("l_orderkey") % 20).cast("string").alias("run_id"), F.col("l_orderkey").alias("source_lead_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("score"))
    lines = lines.withColumns({"decision": F.lit("pending"), "synced_at": F.when(F.col("id") % 7 == 0, F.lit("before"))})
    if not changed:
        return orders, lines
    return orders.where("run_id in ('3', '4')"), lines.where("run_id = '3' and score = 1")


def replaced_runs(spark, d):
    """Runs written, decided, and two of them written again, one without candidates: what is left of the candidates."""
    folder = _folder(spark)
    state.replace_runs(*_run_tables(spark, d), folder)
    told = _run_tables(spark, d)[1].where("score = 1 and run_id in ('3', '5')").select("id", F.when(F.col("id") % 3 == 0, "rejected").when(F.col("id") % 3 == 1, "approved").otherwise("unheard").alias("wanted"))
    state.decide_stored(spark, folder, told)
    for _ in range(2):  # the second write changes nothing
        state.replace_runs(*_run_tables(spark, d, changed=True), folder)
    companies, candidates = state.read_runs(spark, folder)
    n = companies.groupBy("run_id").agg(F.count("*").alias("companies"))
    rows = candidates.groupBy("run_id", "decision").agg(F.count("*").alias("candidates"), F.sum("id").alias("ids"))
    return n.join(rows, "run_id", "left").withColumn("run_id", F.col("run_id").cast("int"))


def rejected_rows(spark, d):
    """Candidates against their table's rules: how many are good, and how many broke which."""
    i = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = _t(spark, d, "lineitem").select(
        F.when(i % 11 > 0, "r").alias("run_id"), F.col("l_orderkey").alias("source_lead_id"), F.col("l_returnflag").alias("company_name"), (F.col("l_quantity") * 2.5).cast("int").alias("score"),
        F.when(i % 13 == 0, "maybe").when(i % 17 > 0, "approved").alias("decision"), i.alias("id"),
    )
    good, bad = state.checked(rows, state.candidate_rules(), ("source_lead_id",), "id")
    return good.select(F.lit("").alias("reasons"), "id").unionByName(bad.select(F.array_join("reasons", " ").alias("reasons"), "id")).groupBy("reasons").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def provider_outcomes(spark, d):
    """Two providers that landed, one whose answers are gone, one that is turned off: their results and statuses."""
    hit = F.struct(F.col("source").alias("title"), _address().alias("url"), F.col("text").alias("content"))
    body = lambda s: _bodies(_t(s, d, "documents"), "doc_id", 10, "results", hit)
    providers = {
        "meta": lambda s: payloads.meta_search(body(s)), "gone": lambda s: payloads.meta_search(s.read.parquet(f"{d}/landed_{uuid.uuid4().hex}.parquet")),
        "paid": lambda s: payloads.paid_search(body(s)).where("ord < 2"), "off": None,
    }
    rows, statuses = registry.run_providers(spark, providers)
    told = rows.groupBy("provider").agg(F.sum(F.length("content")).alias("chars"), F.sum("ord").alias("ords"))
    return statuses.join(told, "provider", "left").select("provider", "rank", "status", "results", "chars", "ords")


def company_failures(spark, d):
    """Companies whose answer is broken off or missing become rows of their own."""
    i = F.col("doc_id")
    body = F.to_json(F.struct(F.col("source").alias("name"), F.col("n_chars").alias("pages")))
    body = F.when(i % 7 == 0, F.left(body, F.length(body) - 2)).when(i % 11 > 0, body)
    good, bad = registry.company_outcomes(_t(spark, d, "documents").select(i.alias("entity_id"), body.alias("body")), "name string, pages long")
    good = good.select("entity_id", F.lit("completed").alias("status"), "name", "pages", F.lit("").alias("why"))
    return good.unionByName(bad.select("entity_id", "status", F.element_at("warnings", 1).alias("why")), allowMissingColumns=True).withColumn("why", F.substring_index("why", ":", 1))


QUERIES = {f.__name__: f for f in (streamed_signals, replaced_runs, rejected_rows, provider_outcomes, company_failures)}

ORACLE = {
    "streamed_signals": f"""WITH s AS (SELECT sha256('user ' || user_id) AS fingerprint, (event_id * 37 % 101)::INTEGER AS score, epoch_us(ts) AS ts, event_type, event_id, event_id % {BATCHES} AS b FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, b ORDER BY score DESC, event_id) AS n FROM s)
      SELECT fingerprint, arg_max(score, b) AS score, arg_min(ts, b) AS first_seen_at, arg_max(ts, b) AS last_seen_at, arg_min(event_type, b) AS status FROM r WHERE n = 1 GROUP BY fingerprint""",
    "replaced_runs": """WITH o AS (SELECT o_orderkey % 20 AS run_id, o_orderkey FROM orders), n AS (SELECT run_id, count(*) AS companies FROM o GROUP BY 1),
      l AS (SELECT l_orderkey % 20 AS run_id, l_orderkey * 10 + l_linenumber AS id, l_linenumber AS nth FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
      c AS (SELECT run_id, id, CASE WHEN run_id = 5 AND nth = 1 AND id % 7 > 0 THEN CASE id % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'approved' ELSE 'pending' END ELSE 'pending' END AS decision FROM l WHERE run_id <> 4 AND (run_id <> 3 OR nth = 1)),
      g AS (SELECT run_id, decision, count(*) AS candidates, sum(id)::BIGINT AS ids FROM c GROUP BY 1, 2)
      SELECT n.run_id::INTEGER AS run_id, companies, decision, candidates, ids FROM n LEFT JOIN g ON g.run_id = n.run_id""",
    "rejected_rows": """WITH r AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS id, trunc(l_quantity * 2.5) AS score FROM lineitem),
      b AS (SELECT *, concat_ws(' ', CASE WHEN id % 11 = 0 THEN 'run_id' END, CASE WHEN score NOT BETWEEN 0 AND 100 THEN 'score' END, CASE WHEN id % 13 = 0 OR id % 17 = 0 THEN 'decision' END) AS why FROM r),
      u AS (SELECT id, CASE WHEN why = '' AND row_number() OVER (PARTITION BY why = '', l_orderkey ORDER BY id) > 1 THEN 'unique' ELSE why END AS reasons FROM b)
      SELECT reasons, count(*) AS n, sum(id)::BIGINT AS ids FROM u GROUP BY 1""",
    "provider_outcomes": f"""WITH {_places(10)}, m AS (SELECT count(*) AS results, sum(length({_cut(2000)}))::BIGINT AS chars, sum(ord)::BIGINT AS ords FROM d WHERE ord < 8), p AS (SELECT count(*) AS results, sum(length({_cut(2000)}))::BIGINT AS chars, sum(ord)::BIGINT AS ords FROM d WHERE ord < 2)
      SELECT 'meta' AS provider, 0 AS rank, 'used' AS status, * FROM m UNION ALL SELECT 'gone', 1, 'failed', 0, NULL, NULL UNION ALL SELECT 'paid', 2, 'used', * FROM p UNION ALL SELECT 'off', 3, 'disabled', 0, NULL, NULL""",
    "company_failures": """SELECT doc_id AS entity_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 7 > 0 AND doc_id % 11 > 0 THEN source END AS name, CASE WHEN doc_id % 7 > 0 AND doc_id % 11 > 0 THEN n_chars END AS pages,
      CASE WHEN doc_id % 7 = 0 THEN 'unreadable body' WHEN doc_id % 11 = 0 THEN 'no body' ELSE '' END AS why FROM documents""",
}
