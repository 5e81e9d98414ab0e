"""A load of the stream is written by as many tasks as its table is read by, and is still one batch."""

from pathlib import Path

from contactry.plans import state_queries


def test_a_load_is_several_files_and_one_batch(spark, tmp_path, monkeypatch):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(state_queries, "_folder", lambda _: f"{tmp_path}/state")
    monkeypatch.setattr(state_queries, "_t", lambda s, d, name: s.read.parquet(f"{d}/{name}.parquet").repartition(4))
    got = {tuple(r) for r in state_queries.streamed_signals(spark, str(tmp_path)).collect()}
    assert len(list(Path(tmp_path, "state", "in").glob("*.parquet"))) > state_queries.BATCHES
    batches = {int(p.name[6:]) for p in Path(tmp_path, "state", "state", "manifest").glob("batch=*")}
    assert batches == set(range(state_queries.BATCHES))
    monkeypatch.undo()
    assert got == {tuple(r) for r in state_queries.streamed_signals(spark, "/root/testdata/sf0.001").collect()}
