"""Near-duplicate groups against all-pairs comparison."""

import random
import re
import tracemalloc
from itertools import combinations

import numpy as np
from busweave.llm import minhash


def brute(rows, width=5, percent=85):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets.setdefault(key, []).append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = {key: key for key in sets if key is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(root, 2):
        for s in sets[a]:
            for t in sets[b]:
                i = len(s & t)
                if i and 100 * i >= percent * (len(s) + len(t) - i):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {key: find(key) for key in root}, sets


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = []
    for base in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 150, 400]))]
        for _ in range(rng.choice([1, 4, 30])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "  "]).join(copy)
            rows.append((len(rows) * 3 + 1, text.upper() if rng.random() < 0.1 and "é" not in text else text))
    long = [rng.choice(vocabulary) for _ in range(60_000)]
    rows += [(9001, " ".join(long)), (9002, " ".join(long[:-5])), (9003, None), (9004, ""), (9005, " \n"), (9006, "A b"), (9007, "a B"), (9007, "a b")]
    rng.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark):
    rows = corpus()
    want, sets = brute(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows] + [(None, "a b", 1, "x")], "doc_id long, text string, k1 int, kept string")
    for block in (200_000, 500):
        got = minhash.duplicate_components(docs, block_shingles=block).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
                assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
    left = minhash.near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {None, *want.values()}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.duplicate_components(docs).count() == 0


def test_many_short_sets_in_a_block():
    """A block of thousands of tiny sets stays within memory and keeps its links."""
    n = 6000
    sets = [np.array(sorted({1, 2, 3, 10 + i // 2}), np.uint64) for i in range(n)]
    tracemalloc.start()
    links = list(minhash._forest(list(range(n)), sets, [0] * n, 85))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {tuple(sorted(p)) for p in links} == {(i, i + 1) for i in range(0, n, 2)}
    assert len(links) == n // 2 and peak < 200e6
    links = list(minhash._forest(list(range(n)), sets, [0] * (n // 2) + [1] * (n // 2), 60))
    assert len(links) == n - 1
