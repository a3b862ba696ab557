"""Ranked search against a plain score of every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from busweave.llm import ranking
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    bags = [(key, terms(text)) for key, text in docs]
    bags = [(key, t) for key, t in bags if t]
    n, total, out = len(bags), sum(len(t) for _, t in bags), []
    for item, text in items:
        scores = []
        query = set(terms(text))
        df = {t: sum(t in own for _, own in bags) for t in query}
        for key, own in bags:
            m = 100 - 90 + (90 * len(own) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * own.count(t)) // (1000 * own.count(t) + 8 * m))
                for t in query if t in own
            )
            if score > 0:
                scores.append((-score, key is None, key))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, i + 1, key, -score) for i, (score, _, key) in enumerate(scores[:k])]
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    return [(i, " ,.\n"[rng.randrange(4)].join(rng.choice(vocabulary).title() for _ in range(rng.randrange(40)))) for i in range(n)]


@pytest.mark.parametrize("coordinates", [8, 4096])
@pytest.mark.parametrize("block", [3, 1000])
def test_agrees_with_plain_scores(spark, coordinates, block):
    rng = random.Random(coordinates)
    docs = corpus(rng, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (None, None), (None, ""), (5000, "...")]
    docs.append((6000, "Long " * 60_000 + docs[3][1]))
    items = [(i, text) for i, (_, text) in enumerate(corpus(rng, 12))] + [(3, docs[7][1]), (None, docs[3][1]), (20, None), (21, "!?"), (22, "unknown")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(5)
    got = ranking.search(table, spark.createDataFrame(items, "item_id long, text string"), coordinates=coordinates, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(docs.limit(0), items).count() == 0
    assert ranking.search(docs, items.limit(0)).count() == 0
    assert [tuple(r) for r in ranking.search(docs, items).collect()] == plain([(1, "a b")], [(1, "a")])


def test_sketch_bounds_every_score():
    rng = random.Random(9)
    texts = pa.array([t for _, t in corpus(rng, 200)])
    found = ranking.terms_of(texts)
    impact = ranking.impacts(found.times, np.repeat(found.total + 10, np.diff(found.first)))
    items = []
    for _, text in corpus(rng, 9):
        own = ranking.terms_of(pa.array([text + " a"])).hash
        items.append(ranking.Item(own, np.arange(1, len(own) + 1), ranking.coordinates_of(own, 32)))
    bounds = ranking.upper_bounds(ranking.max_sketches(found, impact, 32), items)
    exact = np.array([[ranking.rescore(found, impact, d, i) if found.total[d] else 0 for i in items] for d in range(200)])
    assert (bounds >= exact).all() and (bounds > exact).any()


def test_descent_stops_at_the_threshold(spark):
    """Most documents are never rescored once k good ones are known."""
    words = pa.array(["alpha beta gamma"] * 10 + [f"w{i} x{i} alpha" for i in range(500)])
    found = ranking.terms_of(words)
    impact = ranking.impacts(found.times, np.full(len(found.hash), 100))
    own = ranking.terms_of(pa.array(["alpha beta gamma"])).hash
    item = ranking.Item(own, np.array([5, 5, 5]), ranking.coordinates_of(own, 4096))
    bounds = ranking.upper_bounds(ranking.max_sketches(found, impact, 4096), [item])
    best = [ranking.Best(10)]
    assert ranking._descend(found, impact, list(range(510)), bounds, [item], best) < 40
    assert [key for _, _, key in best[0].rows] == list(range(10))


def test_plan_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    plan = ranking.search(docs, items)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "text#" not in above
