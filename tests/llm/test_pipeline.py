"""The stages of the corpus pipeline on rows without ids, repeated rows, empty tables and clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from .docs import corpus, table

BY_NAME = dict(corpus_pipeline.STAGES)


def odd(spark):
    rows = [(i, t, "aa") for i, t in corpus(6, 30)] + [(None, "no id at all here", "aa"), (None, "no id at all here", "aa"), (1, "twice the same", "aa"), (1, "twice the same", "aa"), (2, None, None)]
    return table(spark, rows).withColumns({"at": F.lit("mine"), "By": F.lit(7), "kept_row": F.col("doc_id"), "told": F.lit("x")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_and_takes_empty_tables(spark, name):
    docs = odd(spark)
    out = BY_NAME[name](spark, docs, "")
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert all(r["at"] == "mine" and r["By"] == 7 and r["told"] == "x" and r["kept_row"] == r["doc_id"] for r in out.collect())
    assert BY_NAME[name](spark, docs.where("false"), "").count() == 0


def test_exact_and_near_stage_keep_one_row_of_each_group(spark):
    docs = odd(spark)
    rows = docs.select("doc_id", "text").collect()
    texts = {r.text or "" for r in rows}
    kept = BY_NAME["exact_dedup"](spark, docs, "").select("doc_id", "text").collect()
    assert len(kept) == len(texts) and {r.text or "" for r in kept} == texts
    for r in kept:
        assert r.doc_id == max((o.doc_id for o in rows if (o.text or "") == (r.text or "") and o.doc_id is not None), default=None)
    near = BY_NAME["near_dedup"](spark, docs, "").select("doc_id", "text").collect()
    assert len({(r.doc_id, r.text) for r in near}) == len(near)
    assert {(r.doc_id, r.text) for r in near} <= {(r.doc_id, r.text) for r in rows}


def test_language_stage(spark):
    rows = [(i, "abcde bcdea " * 5 if i % 2 else "fghij hgfij " * 5, "aa" if i % 2 else "bb") for i in range(60)]
    rows += [(100, None, "aa"), (101, "12 34", "aa"), (102, "fghij hgfij", None), (106, "fghij hgfij jihgf", "aa")]  # the last one is held out
    got = {r.doc_id: r.lang for r in BY_NAME["language_id"](spark, table(spark, rows), "").collect()}
    assert set(got) == {i for i in range(60)} | {102, 106}
    assert got[1] == "aa" and got[0] == got[102] == got[106] == "bb"


def test_packing_stage(spark):
    docs = odd(spark)
    got = BY_NAME["packing"](spark, docs, "").collect()
    assert sum(r.start == 0 for r in got) == docs.count()
    assert BY_NAME["packing"](spark, docs.where("false"), "").count() == 0
