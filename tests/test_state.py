"""Stored state: the streaming fold, replaced runs, checked writes, providers that fail."""

import pytest
from pyspark.sql import functions as F

from contactry.operators import state
from contactry.sources import registry
from contactry.streaming import signals

SCHEMA = "fingerprint string, score int, first_seen_at long, status string, ord long"


def batch(spark, *rows):
    return spark.createDataFrame([(f, s, t, st, i) for i, (f, s, t, st) in enumerate(rows)], SCHEMA)


def state_of(spark, path):
    return {r.fingerprint: (r.score, r.first_seen_at, r.status) for r in signals.read_state(spark, path, spark.createDataFrame([], SCHEMA).drop("ord").schema).collect()}


def batches(spark):
    return [
        batch(spark, ("a", 10, 1, "new"), ("b", 20, 1, "new"), ("a", 30, 2, "again")),
        batch(spark, ("b", 5, 9, "late"), ("c", 7, 9, "late")),
        batch(spark),
        batch(spark, *((f"x{i}", i, 30, "many") for i in range(40)), ("a", 1, 31, "last")),
    ]


def by_hand(given):
    out = {}
    for rows in given:
        best = {}
        for r in sorted(rows.collect(), key=lambda r: (-r.score, r.ord)):
            best.setdefault(r.fingerprint, r)
        for k, r in best.items():
            first = out.get(k, (None, r.first_seen_at, r.status))
            out[k] = (r.score, first[1], first[2])
    return out


@pytest.mark.parametrize("start", [0, 5])
def test_a_batch_folded_again_changes_nothing(spark, tmp_path, start):
    """Whatever the first number is, each batch may come twice; the score is the newest, first sight and status are kept."""
    given, path = batches(spark), str(tmp_path / "state")
    for n, rows in enumerate(given):
        for _ in range(2):
            signals.fold(rows, start + n, path, 4)
            assert state_of(spark, path) == by_hand(given[: n + 1])


def test_old_versions_go(spark, tmp_path):
    path = tmp_path / "state"
    for n in range(6):
        signals.fold(batch(spark, ("a", n, n, "new")), n, str(path), 1)
    kept = sorted(int(p.parent.name.split("=")[1]) for p in path.glob("data/batch=*/bucket=0"))
    assert kept == [3, 4, 5] and state_of(spark, str(path)) == {"a": (5, 0, "new")}


def test_stream_equals_the_fold(spark, tmp_path):
    given = [b for b in batches(spark) if not b.isEmpty()]
    for rows in given:
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    signals.run(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"), 4).awaitTermination()
    assert state_of(spark, str(tmp_path / "state")) == by_hand(given)
    batch(spark, ("a", 99, 40, "more")).write.mode("append").parquet(str(tmp_path / "in"))  # the query goes on where it ended
    signals.run(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"), 4).awaitTermination()
    assert state_of(spark, str(tmp_path / "state"))["a"] == (99, 2, "again")


def test_redelivery_within_the_horizon_goes(spark, tmp_path):
    schema = "fingerprint string, published_at timestamp"
    for rows in ([("a", "2024-01-01"), ("b", "2024-01-02")], [("a", "2024-01-03"), ("c", "2024-01-03")]):
        spark.createDataFrame(rows, "fingerprint string, at string").select("fingerprint", F.col("at").cast("timestamp").alias("published_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = signals.without_redelivery(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def tables(spark, *rows):
    """rows: (run, lead, candidate ids)."""
    companies = spark.createDataFrame([(r, lead, f"c{lead}") for r, lead, _ in rows], "run_id string, source_lead_id long, company_name string")
    candidates = spark.createDataFrame([(r, lead, i, "pending", None) for r, lead, ids in rows for i in ids], "run_id string, source_lead_id long, id long, decision string, synced_at string")
    return companies, candidates


def stored(spark, folder):
    companies, candidates = state.read_runs(spark, folder)
    return sorted((r.run_id, r.source_lead_id) for r in companies.collect()), sorted((r.run_id, r.id, r.decision) for r in candidates.collect())


def test_runs_written_twice(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for _ in range(2):
        state.replace_runs(*tables(spark, ("r", 1, [10, 11]), ("s", 1, [20])), folder)
        assert stored(spark, folder) == ([("r", 1), ("s", 1)], [("r", 10, "pending"), ("r", 11, "pending"), ("s", 20, "pending")])
    state.decide_stored(spark, folder, spark.createDataFrame([(10, "approved"), (20, "rejected"), (11, "odd")], "id long, wanted string"))
    assert stored(spark, folder)[1] == [("r", 10, "approved"), ("r", 11, "pending"), ("s", 20, "rejected")]
    state.replace_runs(*tables(spark, ("r", 1, [10])), folder)  # the run's decisions go with it, the other run stays
    assert stored(spark, folder)[1] == [("r", 10, "pending"), ("s", 20, "rejected")]
    state.replace_runs(*tables(spark, ("r", 2, [])), folder)  # no candidates any more
    assert stored(spark, folder) == ([("r", 2), ("s", 1)], [("s", 20, "rejected")])


def test_checked_rows(spark):
    rows = spark.createDataFrame([(1, "r", 5, "pending"), (2, None, 101, "pending"), (3, "r", None, None), (1, "r", 6, "approved")], "source_lead_id int, run_id string, score int, decision string").withColumn("company_name", F.lit("c"))
    good, bad = state.checked(rows, state.candidate_rules(), ("source_lead_id",), "score")
    assert [r.score for r in good.collect()] == [5]
    assert sorted((r.source_lead_id, r.reasons) for r in bad.collect()) == [(1, ["unique"]), (2, ["run_id", "score"]), (3, ["score", "decision"])]


def test_a_broken_provider_is_a_row(spark):
    def landed(s):
        return s.createDataFrame([("q", 0, "u")], "query string, ord long, url string")

    def late(s):  # fails when it runs, not when it is planned
        return landed(s).withColumn("title", F.raise_error(F.lit("gone")).cast("string"))

    rows, told = registry.run_providers(spark, {"one": landed, "two": late, "three": landed, "four": lambda s: s.read.parquet("/nowhere/x"), "five": None})
    assert [(r.provider, r.status, r.results) for r in told.orderBy("rank").collect()] == [("one", "used", 1), ("two", "failed", 0), ("three", "used", 1), ("four", "failed", 0), ("five", "disabled", 0)]
    assert sorted((r.provider, r.url) for r in rows.collect()) == [("one", "u"), ("three", "u")]
    assert "gone" in told.where("provider = 'two'").first().message
    rounds = spark.createDataFrame([("a", 0, "used"), ("a", 1, "failed"), ("b", 0, "skipped"), ("b", 1, "failed")], "provider string, round int, status string")
    assert {r.provider: r.status for r in registry.sticky_statuses(rounds).collect()} == {"a": "used", "b": "failed"}


def test_broken_companies_are_rows(spark):
    bodies = spark.createDataFrame([(1, '{"name": "n"}'), (2, '{"name": '), (3, None)], "entity_id int, body string")
    good, bad = registry.company_outcomes(bodies, "name string")
    assert [tuple(r) for r in good.collect()] == [(1, "n")]
    assert {r.entity_id: (r.status, r.actions[0].status) for r in bad.collect()} == {2: ("failed", "failed"), 3: ("failed", "failed")}
