"""A text is put in lower case and parted once, and its windows are searched for names once, however many roles are tried."""

from contactry.functions import lexicons as lex
from contactry.operators import extract
from contactry.plans import site_queries


def test_texts_and_windows_are_searched_once(spark):
    plan = site_queries.second_round_people(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count(lex.PERSON) == 1
    assert "lower(lambda" not in plan  # of roles, they are fixed


def test_windows_of_several_terms(spark):
    """Against a search by hand: terms in both cases, side by side, within each other, with signs that patterns know."""
    terms, reach = ["L&D (a|b)", "CEO", "ceo", "eo", "\\Q.", "none"], 3
    texts = [(1, "CeO ceoceo,\n\t l&d (A|B)L&D (a|b)"), (2, "Ё\\q.\\Q.Я CEO"), (3, ""), (4, None)]
    want = set()
    for i, text in texts:
        flat = (text or "").replace(",\n\t ", ", ")
        for term in terms:
            at = flat.lower().find(term.lower())
            while at >= 0:
                want.add((i, term, at, flat[max(at - reach, 0) : at + len(term) + reach]))
                at = flat.lower().find(term.lower(), at + len(term))
    rows = spark.createDataFrame(texts, "doc_id int, text string")
    got = extract.windows_around(rows, terms, reach).collect()
    assert extract.windows_around(rows, [], reach).count() == 0 and len(got) == len(want) and {(r.doc_id, r.term, r.at, r.window) for r in got} == want
