"""Components against union-find on chains, stars, cycles and random graphs."""

import random

from busweave.llm.components import components


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)] + [(700, 499), (499, 520)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    for pairs in (chain, star, loose, chain + star + loose + [(5, 5), (139, 1100), (101, 100)], []):
        rng.shuffle(pairs)
        edges = spark.createDataFrame(pairs, "u long, v long")
        rows = components(edges).collect()
        assert {r.node: r.label for r in rows} == brute(pairs) and len(rows) == len(brute(pairs))
