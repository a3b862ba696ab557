"""Ranked lexical search by hashed max-sketches.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII,
A-Z lower-cased.  The impact of a term in a document is its saturated frequency
under the document's length; a document folds the impacts of all its terms into
a sketch, the largest impact per hash coordinate.  No term's impact exceeds its
coordinate, so the weighted sum over an item's coordinates bounds the item's
score in that document from above.

Two passes over the texts, neither of which shuffles them.  The first counts
documents, terms and, for the items' terms, the documents that hold them.  In the
second a task sketches its documents slice by slice, looks all items of a block
up in the sketches at once, and rescores documents exactly in descending order
of bounds, until the bound falls below the item's k-th best exact score so far.
What is left of each task, k documents per item at most, meets in one small
ranking.  A document outside a task's k best is outside the whole table's, so
nothing is lost.  Items go through in blocks of ``BLOCK``, which bounds what the
driver and a task hold of them; a further block is a further second pass.

Defined results: null or empty texts, and texts without terms, rank nowhere and
do not count as documents; null and empty items give no rows; equal scores go by
ascending doc_id, null ids last; repeated rows and ids are documents of their
own, repeated items are ranked each; an empty table gives no rows.  Other columns
do not matter, whatever their names.  Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from busweave.llm.words import range_hashes, slices, text_bytes
from busweave.session import settle

K = 10
COORDINATES = 1 << 12
BLOCK = 1024
#: Items looked up in one step; with the slice, this bounds the step's memory.
_AT_ONCE = 32
_SLICE_BYTES = 1 << 20
_SLICE_ROWS = 512

_IN_TERM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_TERM[_low : _high + 1] = True


class Terms(NamedTuple):
    """Distinct terms of documents; document i owns hash[first[i]:first[i + 1]], ascending."""

    hash: np.ndarray
    times: np.ndarray
    first: np.ndarray
    total: np.ndarray


class Item(NamedTuple):
    """A query: its terms' hashes, weights and coordinates."""

    hash: np.ndarray
    weight: np.ndarray
    coordinate: np.ndarray


def terms_of(texts: pa.Array) -> Terms:
    """Distinct terms with frequencies, ascending by hash within each text."""
    body, cuts = text_bytes(texts)
    inside = _IN_TERM[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[cuts] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1 : len(body)]
    stop[:-1] &= ~inside[1:] | edge[1 : len(body)]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    hashes = range_hashes(body, starts, stops, fold=True)
    owner = np.searchsorted(cuts, starts, "right") - 1
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    n = len(cuts) - 1
    return Terms(
        hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(owner[at], np.arange(n + 1)),
        np.bincount(owner, minlength=n),
    )


def coordinates_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The top bits of a hash, so that ascending hashes have ascending coordinates."""
    return (hashes >> np.uint64(64 - (size - 1).bit_length())).astype(np.int64)


def impacts(times: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Saturated frequency under a document's length figure, rounded down."""
    return 1_000_000_000 * times // (1000 * times + 8 * length)


def length_figure(total: int, documents: int, terms: int) -> int:
    """A document's length against the mean one, 10 to 100 of it fixed."""
    return 100 - 90 + (90 * total * documents) // terms


def max_sketches(terms: Terms, impact: np.ndarray, size: int) -> np.ndarray:
    """Largest impact per document and coordinate, as whole doubles."""
    n = len(terms.first) - 1
    out = np.zeros((n, size))
    if len(impact):
        cell = np.repeat(np.arange(n), np.diff(terms.first)) * size + coordinates_of(terms.hash, size)
        at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        out.reshape(-1)[cell[at]] = np.maximum.reduceat(impact, at)
    return out


def upper_bounds(sketches: np.ndarray, items: list[Item]) -> np.ndarray:
    """Bound of every document for every item: exact sums of whole numbers below 2 ** 53."""
    starts = np.cumsum([0, *(len(i.hash) for i in items)])[:-1]
    looked_up = sketches[:, np.concatenate([i.coordinate for i in items])]
    looked_up *= np.concatenate([i.weight for i in items])
    return np.add.reduceat(looked_up, starts, axis=1)


class Best:
    """The k best documents of an item: descending score, then ascending id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple[int, bool, int]] = []

    def least(self) -> int:
        """The score below which no document counts any more."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: int, key: int | None) -> None:
        bisect.insort(self.rows, (-score, key is None, key or 0))
        del self.rows[self.k :]


def rescore(terms: Terms, impact: np.ndarray, doc: int, item: Item) -> int:
    """The exact score of one document."""
    low, high = terms.first[doc], terms.first[doc + 1]
    own = terms.hash[low:high]
    at = own.searchsorted(item.hash)
    at[at == len(own)] = 0
    hit = own[at] == item.hash
    return int(impact[low:high][at[hit]].dot(item.weight[hit]))


def _descend(terms: Terms, impact: np.ndarray, keys: list, bounds: np.ndarray, items: list[Item], best: list[Best]) -> int:
    """Rescore documents in descending order of bounds, item by item; the number of rescored ones."""
    least = np.array([b.least() for b in best])
    scored = 0
    for i in np.flatnonzero((bounds >= least).any(axis=0)):
        some = np.flatnonzero(bounds[:, i] >= least[i])
        for doc in some[np.argsort(-bounds[some, i], kind="stable")]:
            if bounds[doc, i] < best[i].least():
                break
            scored += 1
            if (score := rescore(terms, impact, doc, items[i])) >= best[i].least():
                best[i].add(score, keys[doc])
    return scored


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in slices bounded by bytes of text and by number."""
    for batch in batches:
        for part in slices(batch, most=_SLICE_BYTES):
            for low in range(0, part.num_rows, _SLICE_ROWS):
                yield part.slice(low, _SLICE_ROWS)


def _search(items: list[Item], numbers: list[int], documents: int, terms: int, k: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for part in _parts(batches):
            found = terms_of(part.column("text"))
            if not len(found.hash):
                continue
            figures = np.array([length_figure(n, documents, terms) for n in found.total.tolist()], np.int64)
            impact = impacts(found.times, np.repeat(figures, np.diff(found.first)))
            sketches = max_sketches(found, impact, size)
            keys = part.column("doc_id").to_pylist()
            for a in range(0, len(items), _AT_ONCE):
                some = items[a : a + _AT_ONCE]
                _descend(found, impact, keys, upper_bounds(sketches, some), some, best[a : a + _AT_ONCE])
        rows = [(n, None if none else key, -score) for n, b in zip(numbers, best, strict=True) for score, none, key in b.rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item", "doc_id", "score"]
        )

    return run


def _count(vocabulary: np.ndarray) -> Callable:
    """(term, n): documents that hold each term; -1 all documents with terms, -2 all terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds, documents, terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for part in _parts(batches):
            found = terms_of(part.column("text"))
            documents += int((found.total > 0).sum())
            terms += int(found.total.sum())
            at = np.searchsorted(vocabulary, found.hash)
            at[at == len(vocabulary)] = 0
            at = at[vocabulary[at] == found.hash]
            holds += np.bincount(at, minlength=len(holds))
        some = np.flatnonzero(holds)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([documents, terms, *holds[some].tolist()], pa.int64())],
            names=["term", "n"],
        )

    return run


def _weighted(docs: DataFrame, hashes: list[np.ndarray], size: int) -> tuple[list[Item], int, int]:
    """Items with weights from counts over all documents, the number of documents and of terms."""
    vocabulary = np.unique(np.concatenate(hashes))
    counted = docs.select("text").mapInArrow(_count(vocabulary), "term long, n long")
    held = {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents, terms = held.get(-1, 0), held.get(-2, 0)
    items = []
    for own in hashes:
        df = [held.get(int(t), 0) for t in np.searchsorted(vocabulary, own)]
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df]
        items.append(Item(own, np.array(weight, np.int64), coordinates_of(own, size)))
    return items, documents, terms


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    text: str = "text",
    key: str = "doc_id",
    item_key: str = "item_id",
    item_text: str = "text",
    coordinates: int = COORDINATES,
    block: int = BLOCK,
) -> DataFrame:
    """(item key, rank, document key, score): the k best documents of each item, score above 0.

    Document keys are whole numbers.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    queries = settle(
        items.select(F.col(item_key).alias("__id"), F.col(item_text).alias("__text"))
        .filter("__text IS NOT NULL")
        .withColumn("__item", F.monotonically_increasing_id()),
        "items",
    )
    found = []
    last = -1
    while True:
        some = queries.filter(F.col("__item") > last).orderBy("__item").limit(block).select("__item", "__text").collect()
        if not some:
            break
        last = some[-1]["__item"]
        terms = terms_of(pa.array([r["__text"] for r in some], pa.large_string()))
        own = [(r["__item"], terms.hash[terms.first[i] : terms.first[i + 1]]) for i, r in enumerate(some)]
        own = [(n, hashes) for n, hashes in own if len(hashes)]
        if own:
            weighted, documents, total = _weighted(rows, [h for _, h in own], coordinates)
            run = _search(weighted, [n for n, _ in own], documents, total, k, coordinates)
            found.append(rows.mapInArrow(run, "item long, doc_id long, score long"))
    if not found:
        found = [rows.filter(F.lit(False)).select(F.lit(0).cast("long").alias("item"), "doc_id", F.lit(0).cast("long").alias("score"))]
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = queries.select("__item", F.col("__id").alias("__name"))
    return ranked.join(named, F.col("item") == F.col("__item")).select(
        F.col("__name").alias(item_key), "rank", F.col("doc_id").alias(key), "score"
    )


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_ranked_search": op13_ranked_search}
