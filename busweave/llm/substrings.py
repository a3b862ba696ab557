"""Removal of long word runs that occur more than once, by De Bruijn compaction.

Windows of ``width`` words are the edges of a De Bruijn graph over all texts.
Consecutive windows that share their least ``SEED``-word hash (minimizer) form a
path; equal windows have equal minimizers, so a minimizer seen once proves all
windows of its path unique.  Where every path of a repeated minimizer has the
same words, the path does not branch and counts as a whole.  Where paths differ,
the graph branches: the windows of those paths are hashed again from the source
coordinates with 128 bits and counted one by one.

Counts are partial aggregates and the joins back to coordinates are plain joins
of written tables, so that a passage found in a third of all documents is split
over tasks.  Everything held per document is bounded by its own words.

Defined results: null and empty texts have no words; shorter texts than a window
lose nothing; rows that repeat id and text count as other places; null ids are
kept; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from busweave.llm.words import _powers, mix, slices, windows, words_of
from busweave.session import settle

WIDTH = 35
SEED = 8

_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_LONGEST_PATH = 100
_KEY = ["__id", "__tk"]


class _Runs:
    """Hashes of word ranges of one slice from prefix sums."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.inverse = _powers(pow(base, -1, 1 << 64), len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _powers(base, len(hashes)), out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        value = (self.sums[stop] - self.sums[start]) * self.inverse[start]
        return mix(value + (stop - start).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _paths(width: int, seed: int):
    """Per path: document, minimizer, content hash, place, minimizers inside.

    The place is position * 256 + windows * 2.  A path that holds its minimizer
    several times can repeat a window within itself.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column("text"))
                n = len(words.hash)
                count = n - width + 1
                if count <= 0:
                    continue
                owner = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
                grams = mix(windows(words.hash, seed, _BASES[0]))
                low = _least(grams, width - seed + 1)[:count]
                inside = owner[:count] == owner[width - 1 :]
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (
                    (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
                )
                head = np.flatnonzero(new)
                length = np.diff(np.append(head, len(at)))
                pieces = -(-length // _LONGEST_PATH)
                step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.repeat(at[head], pieces) + step * _LONGEST_PATH
                size = np.minimum(np.repeat(length, pieces) - step * _LONGEST_PATH, _LONGEST_PATH)
                content = _Runs(words.hash, _BASES[1]).of(start, start + size + width - 1)
                reach = size + width - seed
                begin = np.cumsum(reach) - reach
                near = np.repeat(start - begin, reach) + np.arange(reach.sum())
                again = np.add.reduceat(grams[near] == np.repeat(low[start], reach), begin, dtype=np.int32)
                rows = pa.array(owner[start])
                place = (start - words.first[owner[start]]) * 256 + size * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id").take(rows), part.column("__tk").take(rows),
                        pa.array(low[start].view(np.int64)), pa.array(content.view(np.int64)),
                        pa.array(place), pa.array(again),
                    ],
                    names=["__id", "__tk", "seed", "content", "place", "again"],
                )

    return run


def _ranges(lists: pa.Array):
    """(row, value) of a list column, null lists as empty."""
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), flat


def _branch_windows(width: int):
    """Two hashes of every window on a branching path."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                row, place = _ranges(part.column("__paths"))
                keep = (place & 1) == 1
                row, place = row[keep], place[keep]
                words = words_of(part.column("text"))
                size = (place & 255) >> 1
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row, at = np.repeat(row, size), np.repeat(place >> 8, size) + step
                start = words.first[row] + at
                h1, h2 = (_Runs(words.hash, base).of(start, start + width) for base in _BASES)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("__id").take(rows), part.column("__tk").take(rows), pa.array(at),
                        pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                    ],
                    names=["__id", "__tk", "at", "h1", "h2"],
                )

    return run


def _cut(width: int, text: str, passed: list[str]):
    """Words outside repeated windows, joined by one space."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()
                words = [t.split() for t in texts]
                first = np.cumsum([0, *[len(w) + 1 for w in words]])
                change = np.zeros(first[-1] + 1, np.int32)
                row, place = _ranges(part.column("__paths"))
                whole = (place & 1) == 0
                row, place = row[whole], place[whole]
                start = first[row] + (place >> 8)
                np.add.at(change, start, 1)
                np.add.at(change, start + ((place & 255) >> 1) + width - 1, -1)
                row, at = _ranges(part.column("__starts"))
                np.add.at(change, first[row] + at, 1)
                np.add.at(change, first[row] + at + width, -1)
                free = np.cumsum(change) == 0
                kept, removed = [], []
                for i, w in enumerate(words):
                    own = free[first[i] : first[i] + len(w)]
                    some = len(w) - int(np.count_nonzero(own))
                    removed.append(some)
                    kept.append(b" ".join(itertools.compress(w, own.tolist()) if some else w))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in passed], pa.array([len(w) for w in words], pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*passed, "n_words", "n_removed", "kept_text"],
                )

    return run


def _same_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({"__id": "__id2", "__tk": "__tk2"})
    same = F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__tk") == F.col("__tk2"))
    return left.join(renamed, same, how).drop("__id2", "__tk2")


def drop_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, seed: int = SEED
) -> DataFrame:
    """Rows of ``docs`` with n_words, n_removed and kept_text."""
    passed = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text") or c == text]
    keyed = docs.select(
        *passed, F.col(key).alias("__id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__tk")
    )
    source = keyed.select("__id", "__tk", F.col(text).alias("text"))
    id_type = docs.schema[key].dataType.simpleString()
    head = f"__id {id_type}, __tk long"
    paths = settle(
        source.mapInArrow(_paths(width, seed), f"{head}, seed long, content long, place long, again int"),
        "repeat-paths",
    )
    seeds = settle(
        paths.groupBy("seed")
        .agg(F.sum("again").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"),
             F.count("*").alias("paths"))
        .filter("n > 1")
        .select(F.col("seed").alias("seed2"),
                ((F.col("lo") < F.col("hi")) | (F.col("paths") == 1)).cast("int").alias("branch")),
        "repeat-seeds",
    )
    marked = settle(
        paths.join(seeds, F.col("seed") == F.col("seed2"))
        .select(*_KEY, (F.col("place") + F.col("branch")).alias("place"))
        .groupBy(*_KEY)
        .agg(F.collect_set("place").alias("__paths")),
        "repeat-marks",
    )
    branching = marked.filter(F.exists("__paths", lambda p: p % 2 == 1))
    edges = settle(
        _same_key(source, branching, "inner").mapInArrow(
            _branch_windows(width), f"{head}, at long, h1 long, h2 long"
        ),
        "repeat-edges",
    )
    twice = settle(
        edges.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"),
        "repeat-windows",
    )
    starts = (
        edges.join(twice, ["h1", "h2"], "left_semi")
        .groupBy(*_KEY)
        .agg(F.collect_set("at").alias("__starts"))
    )
    joined = _same_key(_same_key(keyed, marked, "left"), starts, "left")
    fields = [f for f in docs.schema.fields if f.name in passed]
    schema = T.StructType(fields).add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return joined.mapInArrow(_cut(width, text, passed), schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Word counts and digest of what stays of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
