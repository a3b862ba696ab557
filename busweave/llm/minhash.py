"""Near-duplicate groups by circulant MinHash and exact Jaccard verification.

Shingles are hashed (the first permutation); coordinate k of a signature is the
least value of one second permutation applied to the hashes shifted circularly
by k.  Bands of coordinates meet in buckets, buckets chain into candidate
groups, and inside a group full shingle sets are compared exactly.

Equal sets are one node from the start, so thousands of copies cost one row.  A
candidate group of any size is cut into blocks by total set size; each pair of
blocks is one unit of work that returns at most a spanning forest of its links,
never all pairs.  With 35 bands of 7 coordinates a pair at similarity 0.85
misses all buckets with probability 1.3e-6.

Defined results: null or wordless text has an empty set and is linked with
nothing; a text with fewer words than a shingle is one shingle; rows without a
document id take no part (component null, kept); rows that share an id are one
node; an empty table gives no rows; other columns pass through ``near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from busweave.llm.candidates import possible, without
from busweave.llm.components import components
from busweave.llm.words import mix, slices, windows, words_of
from busweave.session import settle

WIDTH = 5
PERCENT = 85
BANDS = 35
ROWS = 7
BLOCK_SHINGLES = 50_000

_BASE = 0xD6E8FEB86659FD93
_FEW = 24
_COLUMNS = 4096
_STRIP = 1024


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased."""
    words = words_of(texts, fold=True)
    every = mix(windows(words.hash, width, _BASE))
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            short = windows(words.hash[a:b], max(1, b - a), _BASE)
            out.append(mix(short + np.uint64(b - a)))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (set x band) from the circulant signature of nonempty sets."""
    first = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    shifted = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    value, high = np.empty_like(shifted), np.empty_like(shifted)
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        total = np.full(len(sets), band + 1, np.uint64)
        for row in range(rows):
            np.add(shifted, np.uint32(band * rows + row), out=value)
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(value, np.uint32(shift), out=high)
                value ^= high
                value *= np.uint32(factor)
            np.right_shift(value, np.uint32(16), out=high)
            value ^= high
            total *= np.uint64(_BASE)
            total += np.minimum.reduceat(value, first)
        out[:, band] = mix(total)
    return out


def _sketch(width: int, bands: int, rows: int):
    """Per row: set size, 128-bit digest of the set, band hashes."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), width)
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                digest = np.zeros((2, len(sets)), np.uint64)
                hashes = np.zeros((len(sets), bands), np.uint64)
                if len(full):
                    chosen = [sets[i] for i in full]
                    first = np.cumsum([0, *size[full][:-1]])
                    flat = np.concatenate(chosen)
                    digest[0, full] = np.add.reduceat(mix(flat ^ np.uint64(_BASE)), first)
                    digest[1, full] = np.add.reduceat(mix(flat + np.uint64(_BASE)), first)
                    hashes[full] = signatures(chosen, bands, rows)
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(size),
                        pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def _set_rows(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"), width)
                offsets = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                columns = [part.column(c) for c in ("cell", "doc_id", "block", "blocks")]
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["cell", "doc_id", "block", "blocks", "shingles"]
                )

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all left with all right sets."""
    if len(left) * len(right) <= _FEW:
        return np.array([[len(np.intersect1d(a, b, True)) for b in right] for a in left]).reshape(
            len(left), len(right)
        )
    out = np.zeros((len(left), len(right)), np.float64)
    common = np.intersect1d(
        np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), True
    )
    places = []
    for sets in (left, right):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, flat)
        hit = common[np.minimum(at, len(common) - 1)] == flat if len(common) else at < 0
        order = np.argsort(at[hit], kind="stable")
        places.append((owner[hit][order], at[hit][order]))
    for low in range(0, len(common), _COLUMNS):
        grids = []
        for sets, (owner, at) in zip((left, right), places, strict=True):
            a, b = np.searchsorted(at, (low, low + _COLUMNS))
            grid = np.zeros((len(sets), _COLUMNS), np.float32)
            grid[owner[a:b], at[a:b] - low] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def _forest(ids, sets, blocks, percent: int):
    """Pairs (id, root) that join what the exact links of one cell join.

    Both sides are walked in strips of ``_STRIP`` sets, so memory does not grow
    with the number of short sets in a block.
    """
    parts = sorted(set(blocks))
    sides = [np.array([i for i, b in enumerate(blocks) if b == part]) for part in parts]
    left, right = sides[0], sides[-1]
    size = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(ids))
    for low in range(0, len(left), _STRIP):
        above = left[low : low + _STRIP]
        for start in range(low if left is right else 0, len(right), _STRIP):
            beside = right[start : start + _STRIP]
            shared = _shared([sets[i] for i in above], [sets[i] for i in beside])
            union = size[above][:, None] + size[beside][None, :] - shared
            linked = 100 * shared >= percent * union
            for a, row in zip(above, linked, strict=True):
                near = beside[row]
                near = near[root[near] != root[a]]
                if len(near):
                    others, first = np.unique(root[near], return_index=True)
                    root[np.isin(root, others)] = root[a]
                    for b in near[first]:
                        yield ids[a], ids[b]


def _verify(percent: int):
    """Exact links within each (cell, left, right); rows arrive sorted by those."""

    def run(batches):
        key, held = None, ([], [], [])

        def links():
            if len(held[0]) > 1:
                yield from _forest(*held, percent)

        def flush(pairs):
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                names=["u", "v"],
            )

        for batch in batches:
            found = []
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("cell", "left", "right")], strict=True))
            ids, blocks = batch.column("doc_id").to_pylist(), batch.column("block").to_pylist()
            lists = batch.column("shingles")
            flat = lists.flatten().to_numpy().view(np.uint64)
            ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy())
            for i, now in enumerate(keys):
                if now != key:
                    found.extend(links())
                    key, held = now, ([], [], [])
                held[0].append(ids[i])
                held[1].append(flat[(ends[i - 1] if i else 0) : ends[i]].copy())
                held[2].append(blocks[i])
            yield flush(found)
        yield flush(list(links()))

    return run


def duplicate_components(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
    percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = settle(
        base.mapInArrow(
            _sketch(width, bands, rows),
            "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>",
        ),
        "minhash-sketch",
    )
    classes = settle(
        sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("k1", "k2", "n_shingles")
        .agg(F.min("doc_id").alias("cid"), F.any_value("bands").alias("bands")),
        "minhash-classes",
    )
    buckets = classes.select(F.explode("bands").alias("bucket"), "cid")
    least = buckets.groupBy("bucket").agg(F.min("cid").alias("u"), F.max("cid").alias("w"))
    stars = buckets.join(least.filter("u < w"), "bucket").select("u", F.col("cid").alias("v"))
    groups = components(stars)
    links = _links(base, classes, groups, width, percent, block_shingles)
    labels = components(links)
    placed = classes.join(labels, F.col("cid") == F.col("node"), "left").select(
        "k1", "k2", F.col("n_shingles").alias("n"), F.coalesce("label", "cid").alias("component")
    )
    placed = settle(placed, "minhash-labels")
    rows_out = sketch.select("doc_id", "n_shingles", "k1", "k2")
    joined = rows_out.join(
        placed,
        (rows_out.k1 == placed.k1) & (rows_out.k2 == placed.k2) & (rows_out.n_shingles == placed.n),
        "left",
    )
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", F.col("doc_id"))
    )
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def _links(base, classes, groups, width, percent, block_shingles) -> DataFrame:
    """Spanning links of the exact comparisons inside candidate groups."""
    members = groups.join(
        classes.select(F.col("cid").alias("node"), "n_shingles"), "node"
    )
    weight = members.groupBy("label").agg(F.sum("n_shingles").alias("weight"))
    weight = settle(weight, "minhash-weights").withColumnRenamed("label", "cell")
    blocks = F.ceil(F.col("weight") / block_shingles).cast("int")
    planned = members.join(weight, F.col("label") == F.col("cell")).select(
        F.col("node"), "cell", blocks.alias("blocks"),
        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"),
    )
    planned = settle(planned, "minhash-plan")
    texts = possible(base, F.col("doc_id"), planned, "node")
    sets = texts.join(planned, F.col("doc_id") == F.col("node")).select(
        "cell", "doc_id", "block", "blocks", "text"
    ).mapInArrow(
        _set_rows(width), "cell long, doc_id long, block int, blocks int, shingles array<long>"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cells = sets.select("cell", "doc_id", "block", "shingles", other).select(
        "cell", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "doc_id", "block", "shingles",
    )
    return (
        cells.repartition("cell", "left", "right")
        .sortWithinPartitions("cell", "left", "right")
        .mapInArrow(_verify(percent), "u long, v long")
    )


def first_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row of every group of near duplicates, that of the smallest id, null last.

    A row's node is the hash of its id and text, so repeated and null ids are
    decided row by row; of fully repeated rows the one of the least hash of all
    columns stays.  Rows without words stay.
    """
    node = F.xxhash64(key, text)
    keyed = docs.select(node.alias("__node"), F.col(text).alias("text"))
    labels = duplicate_components(keyed, key="__node", **options).filter("n_shingles > 0")
    labels = labels.groupBy(F.col("doc_id").alias("node"), "component_id").agg(F.count("*").alias("copies"))
    ids = docs.select(node.alias("__node"), F.col(key).cast("long").alias("id")).groupBy("__node").agg(F.min("id").alias("id"))
    rows = settle(
        labels.join(ids, F.col("node") == F.col("__node")).select("component_id", "node", "id", "copies"), "minhash-rows"
    )
    head = rows.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "copies")).alias("head"),
        F.sum("copies").alias("n"),
    ).filter("n > 1")
    head = settle(head.select(F.col("component_id").alias("__group"), "head.node", "head.copies"), "minhash-heads")
    gone = rows.join(head.select("__group", F.col("node").alias("__head")), F.col("component_id") == F.col("__group"))
    gone = gone.filter("node <> __head").select("node")
    many = head.filter("copies > 1").select(F.col("node").alias("__many"))
    once = settle(gone.union(many).select(F.col("node").alias("__extra")), "minhash-extra")
    kept = without(docs, node, once, "__extra", node == F.col("__extra"))
    least = Window.partitionBy(node).orderBy(F.xxhash64(*docs.columns))
    repeated = possible(docs, node, many, "__many").join(many, node == F.col("__many"), "left_semi").withColumn("__place", F.row_number().over(least))
    return kept.unionByName(repeated.filter("__place = 1").drop("__place"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The first document of every group by id, all columns as they were.

    ``first_rows`` decides row by row instead.  Rows that repeat a kept id all stay; rows without an id stay.  The ids that
    go are the smaller side, so texts are shuffled only when even those are many.
    """
    extra = duplicate_components(docs, key=key, **options).filter("NOT kept")
    ids = settle(extra.select(F.col("doc_id").alias("__extra")).distinct(), "minhash-extra")
    place = F.col(key).cast("long")
    return without(docs, place, ids, "__extra", place == F.col("__extra"))


def op10_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicate_components(docs)


QUERIES = {"op10_circulant_minhash": op10_circulant_minhash}
