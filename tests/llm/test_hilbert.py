"""Neighbours against brute force; the curve itself."""

import itertools

import numpy as np
from busweave.llm.hilbert import hilbert_keys, nearest


def brute(ids, vectors, every, k):
    out = {}
    norms = np.sqrt((vectors**2).sum(1))
    for q in np.flatnonzero(ids % every == 0):
        score = vectors @ vectors[q] / (norms * norms[q])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def test_curve_is_continuous():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 12)).astype(np.float32)
    vectors[20:60] = vectors[20]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(vectors)]
    odd = [(10_000, None), (10_050, [0.0] * 12), (10_100, [float("nan")] * 12), (10_150, [1.0, None] * 6), (None, [1.0] * 12), (10_200, [1.0] * 3), (10_250, [float("inf")] * 12)]
    table = spark.createDataFrame(rows + [rows[50]] + [(*o, "x", 1) for o in odd], "vec_id long, embedding array<float>, curve string, rank int")
    got = {}
    for r in nearest(table, reach=2000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(np.arange(700), vectors.astype(np.float64), 50, 5)
    assert set(got) == set(want)
    for q, rows in want.items():
        if q == 50:
            assert all(abs(s - 1) < 1e-12 for _, s in got[q])
            continue
        assert [i for i, _ in got[q]] == [i for i, _ in rows]
        assert np.allclose([s for _, s in got[q]], [s for _, s in rows], atol=1e-14)


def test_recall_through_narrow_windows(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest(table, reach=128, curves=24).collect()
    rows = table.collect()
    want = brute(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64), 50, 5)
    hits = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_and_no_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (7, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest(table).collect()] == [(0, 1, 7)]
    assert nearest(table.filter("false")).count() == 0


def test_reach_follows_the_table(spark):
    """Recall holds where the least windows cover a small share of the table."""
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(12_000, 5)) @ rng.normal(size=(5, 16))
    vectors = (flat + 0.05 * rng.normal(size=flat.shape)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    want = brute(np.arange(len(vectors)), vectors.astype(np.float64), 50, 5)

    def recall(**options):
        got = nearest(table, curves=4, **options).collect()
        return sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in got) / sum(map(len, want.values()))

    assert recall(reach=4) < 0.8
    assert recall(least_reach=4) >= 0.9


def test_copies_and_repeated_ids(spark):
    """Large groups of equal vectors answer with their smallest ids; cuts count ids."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(1200, 8)).astype(np.float32)
    vectors[300:900] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    near = vectors[0] + 1e-4 * rng.normal(size=(60, 8)).astype(np.float32)
    rows += [(7, v.tolist()) for v in near]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(table, reach=40, curves=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(got[q] == [i for i in range(300, 306) if i != q][:5] for q in range(300, 900, 50))
    assert all(len(set(found)) == 5 for found in got.values())
    assert got[0][0] == 7
