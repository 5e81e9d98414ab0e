"""Contacts are selected before they are listed: only wanted ones have lists, and the selection sees whole groups."""

from pyspark.sql import functions as F

from contactry.operators import merge
from contactry.storage import store

from .test_resolve import candidate


def _found(spark, rows, **how):
    found = merge.contacts(spark.createDataFrame(list(rows), merge.CANDIDATE), F.lit("2024-02-01").cast("timestamp"), (), store, **how)
    return {r.group_id: r for r in found.collect()}


def test_only_wanted_contacts_are_listed(spark):
    mail = lambda i: [(f"p{i}@example.com", False, "deliverable", 90, "found")]
    rows = [candidate(i, mails=mail(i), phones=[str(100 + i), str(200 + i)], evidence=[("website", f"https://example.com/{i}")]) for i in range(4)]
    every, some = (_found(spark, rows, most=2, wanted=w) for w in (None, F.col("rank").isNotNull()))
    assert sum(r.rank is not None for r in every.values()) == 2
    for i, r in every.items():
        assert r.phones == [str(100 + i), str(200 + i)]
        assert some[i].rank == r.rank and some[i].score == r.score
        assert some[i].phones == (r.phones if r.rank else None) and some[i].n_emails == (1 if r.rank else None)


def test_a_general_address_behind_the_shown_ones_counts(spark):
    """Of sixty addresses the last one is general: it makes the contact the fallback, however few are shown."""
    mails = [(f"p{i}@example.com", False, "undeliverable", None, "found") for i in range(59)] + [("info@example.com", True, "unknown", None, "found")]
    rows = [candidate(1, mails=mails, evidence=[("website", "https://example.com/team")])]
    one = _found(spark, rows, least=99)[1]
    assert one.rank == 1 and one.score_reasons[-1].startswith("fallback") and len(one.emails) == merge.SHOWN
