"""Benchmark passages, re-parameterised ones and clean texts."""

import pytest
from busweave.llm.decontaminate import contaminated, drop_contaminated

ITEMS = [
    (1, "A train leaves Boston at 60 km/h and needs 3 hours to reach Chicago; how far did the train of 60 km/h go?"),
    (2, "the quick brown fox jumps over"), (3, "too short item"), (4, None), (5, ""),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"),
]
DOCS = [
    (1, "Some intro. A train leaves Boston at 60 km/h and needs 3 hours to reach Chicago; how far did the train of 60 km/h go? The end."),
    (2, "We ask: a train leaves Denver at 85 km/h and needs 7 hours to reach Dallas; how far did the train of 85 km/h go? Indeed"),
    (3, "then: a train leaves Denver at 85 km/h and needs 7 hours to reach Dallas; how far did the train of 99 km/h go? Indeed"),
    (4, "A completely clean text about trains and Boston, 60 km/h."), (5, None), (6, ""), (None, "x the QUICK brown, fox\njumps over y"),
    (7, "one two three four five alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu six"),
    (7, "one two three four five alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu six"),
    (8, "12 34 56 78 90 12 34 56 78 90 12 34 , . ! ?"), (9, "w " * 200_000 + "the quick brown fox jumps over"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, 1, "q") for d in DOCS], "doc_id long, text string, item_id int, hash string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("most", [500_000, 0])
def test_pairs(tables, most):
    docs, items = tables
    rows = contaminated(docs, items, broadcast_windows=most).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert set(found) == {(1, 1), (2, 1), (None, 2), (7, 6), (9, 2)}
    assert not found[1, 1].changed and found[1, 1].n_matched == found[1, 1].n_item_windows
    assert found[2, 1].changed and found[2, 1].n_slots >= 5
    assert found[9, 2].offset == 200_000


def test_removal(tables):
    docs, items = tables
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 8]


def test_empty_tables(tables):
    docs, items = tables
    assert contaminated(docs.filter("false"), items).count() == 0
    assert contaminated(docs, items.filter("false")).count() == 0
    assert drop_contaminated(docs, items.filter("false")).count() == len(DOCS)


@pytest.mark.parametrize("item, copy, found", [
    ("Tom has 3 apples. Tom buys 4 more. Tom eats 2.", "Here: Maria has 5 apples. Maria buys 9 more. Maria eats 7.", True),
    ("A box holds 3 pens and another box holds 5 pens after some minutes or a few hours of work",
     "A box holds 4 pens and another box holds 4 pens after some hours or a few hours of work", True),
    ("compute 12 + 7 34 8 90 11 2 5 and then subtract 4 6 from this whole sum",
     "compute 13 + 8 35 9 91 12 3 6 and then subtract 5 7 from this whole sum", True),
    ("A box holds 4 pens and another box holds 4 pens after some hours or a few hours of work",
     "A box holds 3 pens and another box holds 5 pens after some minutes or a few hours of work", False),
])
def test_changed_values(spark, item, copy, found):
    docs = spark.createDataFrame([(1, copy), (2, "Nothing of this kind is here. Tom sleeps 3 hours.")], "doc_id long, text string")
    rows = contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.changed, r.n_matched >= min(5, r.n_item_windows)) for r in rows] == [(1, True, True)] * found
