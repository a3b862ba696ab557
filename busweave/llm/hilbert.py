"""Approximate nearest neighbours along shifted Hilbert curves.

Each curve projects the unit vectors to a few dimensions by its own random
orthonormal map, shifts and quantises them, and orders them along a Hilbert
curve.  The orders are ranked in Spark by range sort; a window of ``reach``
ranks on either side of a query, cut into blocks with overlapping borders, is
its candidate set on that curve.  Candidates are scored exactly where they lie,
and the best of all curves are merged.

Equal vectors are one row on every curve, with the ``k + 1`` smallest distinct
ids of their group: ties go to the smaller id, so no further id of a group can
be among the best ``k`` of a query.  The ids are expanded after the merge.

``reach`` follows the data by one rule for all sizes.  ``SAMPLE`` of the queried
vectors (those of the least hashes) are scored against all vectors, and the
ranks tell how near their true neighbours lie on the nearest curve; the reach is
the distance within which ``TARGET`` of them lie, ``REACH`` at least.  It grows
with the table as far as its vectors are spread out, and on vectors without any
structure in proportion to it.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id;
rows that share an id are one candidate with its best score; ties go to the
smaller id; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from busweave.llm.ranks import ranked
from busweave.session import settle

CURVES = 24
REACH = 1024
SAMPLE = 100
TARGET = 0.95
DIMENSIONS = 8
BITS = 6
SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows x dimensions), at most 62 bits.

    Gray-code rotations run over all rows at once, from the coarsest bit down.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, axis in enumerate(axes):
            high = (axis >> level) & 1
            swap = np.where(high, 0, (axes[0] ^ axis) & low)
            axes[0] = axes[0] ^ np.where(high, low, swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    fold = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        fold ^= np.where((axes[-1] >> level) & 1, (1 << level) - 1, 0)
    key = np.zeros_like(fold)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ fold) >> level) & 1)
    return key


def _curve_keys(size: int, curves: int, dimensions: int, bits: int, seed: int):
    draw = np.random.default_rng(seed)
    dimensions = min(dimensions, size)
    maps = [
        (np.linalg.qr(draw.normal(size=(size, size)))[0][:, :dimensions], draw.uniform(-0.7, 0.7, dimensions))
        for _ in range(curves)
    ]

    def run(batches):
        for batch in batches:
            vectors = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) * np.sqrt(size)
            keys = np.empty((len(unit), curves), np.int64)
            for c, (plane, shift) in enumerate(maps):
                share = 1 / (1 + np.exp(-1.702 * (unit @ plane + shift)))
                cells = np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                keys[:, c] = hilbert_keys(cells, bits)
            ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * curves)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                names=["node", "v", "keys"],
            )

    return run


def _first_ids(scores: np.ndarray, ids: list, most: int) -> list[tuple[int, float]]:
    """The ``most`` best distinct ids of scored groups, ties to the smaller id."""
    take = 2 * most
    while True:
        chosen = np.arange(len(scores))
        if len(scores) > take:
            chosen = np.flatnonzero(scores >= np.partition(scores, len(scores) - take)[len(scores) - take])
        seen: dict[int, float] = {}
        for score, other in sorted((-float(scores[i]), other) for i in chosen for other in ids[i]):
            seen.setdefault(other, -score)
            if len(seen) == most:
                break
        if len(seen) == most or len(chosen) == len(scores):
            return list(seen.items())
        take *= 2


def _best(size: int, reach: int, most: int):
    """The best ids of each query among the vectors of a block, which stream past.

    Rows arrive by (curve, block), the queries of a block before its vectors;
    only queries and one batch of vectors are held.
    """

    def run(batches):
        key, asked = None, {}

        def results():
            rows = [(q, other, score) for (q, _, _), best in asked.items() for other, score in best]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["query", "vec_id", "score"],
            )

        for batch in batches:
            curve, block, node, ranks, query = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("curve", "block", "node", "rank", "query")
            )
            ids = batch.column("ids").to_pylist()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
            lengths = np.sqrt(np.einsum("ij,ij->i", flat, flat))
            new = np.flatnonzero((np.diff(curve) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *new], [*new, len(node)], strict=True):
                if a == b:
                    continue
                now = (int(curve[a]), int(block[a]))
                if now != key:
                    yield results()
                    key, asked, vectors = now, {}, {}
                first = a + int(np.count_nonzero(query[a:b]))
                for i in range(a, first):
                    q = (int(node[i]), int(ranks[i]), float(lengths[i]))
                    asked[q], vectors[q] = [], flat[i].copy()
                for q, best in asked.items():
                    low, high = first + np.searchsorted(ranks[first:b], (q[1] - reach, q[1] + reach + 1))
                    if low == high:
                        continue
                    scores = np.einsum("ij,j->i", flat[low:high], vectors[q]) / (lengths[low:high] * q[2])
                    scores = np.append(scores, [score for _, score in best])
                    asked[q] = _first_ids(scores, ids[low:high] + [[other] for other, _ in best], most)
        yield results()

    return run


def _exact(size: int, nodes: list[int], vectors: np.ndarray, k: int):
    """The k best other vectors of each sampled one, batch by batch."""
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))

    def run(batches):
        for batch in batches:
            node = batch.column("node").to_numpy()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
            own = np.sqrt(np.einsum("ij,ij->i", flat, flat))
            rows = []
            for q, vector, length in zip(nodes, vectors, lengths, strict=True):
                scores = np.where(node == q, -np.inf, np.einsum("ij,j->i", flat, vector) / (own * length))
                best = np.argsort(-scores, kind="stable")[:k]
                rows.extend((q, int(node[i]), float(scores[i])) for i in best if node[i] != q)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["query", "node", "score"],
            )

    return run


def fitted_reach(
    groups: DataFrame, queried: DataFrame, placed: DataFrame, size: int, k: int,
    sample: int = SAMPLE, target: float = TARGET, least: int = REACH,
) -> int:
    """Ranks within which ``target`` of the true neighbours of a sample lie on some curve.

    The driver sees the sample, its neighbours and their ranks only.
    """
    chosen = queried.select("node", "v").orderBy(F.xxhash64("v"), "node").limit(sample).collect()
    if not chosen:
        return least
    vectors = np.array([r.v for r in chosen], np.float64)
    pairs = groups.select("node", "v").mapInArrow(
        _exact(size, [r.node for r in chosen], vectors, k), "query long, node long, score double"
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    true = pairs.withColumn("place", place).filter(F.col("place") <= k).select("query", "node").collect()
    wanted = sorted({r.node for r in true} | {r.node for r in chosen})
    ranks: dict[int, dict[int, int]] = {}
    for r in placed.filter(F.col("node").isin(wanted)).select("curve", "node", "rank").collect():
        ranks.setdefault(r.node, {})[r.curve] = r["rank"]
    apart = sorted(min(abs(ranks[r.query][c] - at) for c, at in ranks[r.node].items()) for r in true)
    return max(least, apart[int(np.ceil(target * len(apart))) - 1]) if apart else least


def usable_vectors(table: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, and their length."""
    v = F.col(vector)
    finite: Column = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    good = table.filter(F.col(key).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = good.select(F.mode(F.size(v))).first()[0] or 0
    rows = good.filter(F.size(v) == size).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    return rows, size


def _groups(base: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, v, ids) of the distinct vectors and (query_id, node, v) of the queries.

    ``row_number`` is limited inside each task first, so a vector that a third of
    all rows hold sends a few rows a task.
    """
    rows = settle(base.distinct(), "vectors")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    groups = least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = settle(groups.select(F.monotonically_increasing_id().alias("node"), "v", "ids"), "vector-groups")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    return groups, settle(queries.join(groups.select("node", "v"), "v").select("query_id", "node", "v"), "queries")


def nearest(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5,
    curves: int = CURVES, reach: int | None = None, dimensions: int = DIMENSIONS, bits: int = BITS, seed: int = SEED,
    least_reach: int = REACH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of ids divisible by ``every``.

    ``reach`` None fits it to the table, ``least_reach`` at least.
    """
    base, size = usable_vectors(table, key, vector)
    size = max(1, size)
    kind = base.schema["v"].dataType.simpleString()
    groups, queries = _groups(base, every, k)
    queried = queries.groupBy("node").agg(F.any_value("v").alias("v"))
    keyed = groups.select("node", "v").mapInArrow(
        _curve_keys(size, curves, dimensions, bits, seed), f"node long, v {kind}, keys array<long>"
    ).select("node", "v", F.posexplode("keys").alias("curve", "key"))
    placed = ranked(keyed, ["curve"], ["key", "node"], "rank", "curves")
    if reach is None:
        reach = fitted_reach(groups, queried, placed, size, k, least=least_reach)
    rows = 2 * reach
    vectors = placed.join(groups.select("node", "ids"), "node").select(
        "curve", F.floor(F.col("rank") / rows).alias("block"), "node", "rank", "v", "ids", F.lit(False).alias("query")
    )
    first, last = F.floor((F.col("rank") - reach) / rows), F.floor((F.col("rank") + reach) / rows)
    asked = placed.join(queried.select("node"), "node", "left_semi").select(
        "curve", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("block"), "node", "rank", "v",
        F.array().cast("array<long>").alias("ids"), F.lit(True).alias("query"),
    )
    near = (
        vectors.unionByName(asked).repartition("curve", "block")
        .sortWithinPartitions("curve", "block", F.desc("query"), "rank")
        .mapInArrow(_best(size, reach, k + 1), "query long, vec_id long, score double")
    )
    best = near.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", place).filter(F.col("place") <= k + 1)
    found = queries.select("query_id", "node").join(best, F.col("node") == F.col("query"))
    found = found.filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every 50th vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op4_hilbert_neighbours": op4_hilbert_neighbours}
