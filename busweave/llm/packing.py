"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents become tokens with an end token; longer ones are cut into pieces of
``capacity`` tokens, of which the first may be shorter.  Full pieces are
sequences of their own.

The distributed method, range-sorted rows of documents and gaps matched by
successor sweeps in Spark, is replaced: pieces of one size are interchangeable,
so Spark only range-sorts, counts and ranks the pieces, and ``fit_rounds`` plans
every match in the driver from the histogram of sizes.  Gaps are never rows of a
table.  A sweep from the largest size down gives each run of pieces the smallest
gap that holds it; matched gaps shrink, and the next round begins.  When no gap
holds any piece, as many sequences open as the remaining tokens need.  A join by
size and rank carries the plan back to the pieces.  The driver's state and the
plan grow with ``capacity``, not with the input.

Defined results: null text is empty, and an empty document is its end token;
repeated rows and ids are documents of their own; null ids are kept; an empty
table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import base64
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from busweave.llm.ranks import ranked
from busweave.llm.words import _SPACE, range_hashes, slices, text_bytes
from busweave.session import fixed_rows, settle

CAPACITY = 1024
END = 2
BAND = 16

# Fixed values of the byte-level vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MOST_CACHED = 1_000_000
_SLICE = 2 << 20
# First bytes of white space beyond ASCII, and the ASCII separators.
_RARE = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
_PLAIN = re.compile(r"[\x21-\x7e\x20\x09-\x0d¡-ᙹᚁ-῿]*")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Token ids of texts by the vocabulary in a tokenizers JSON file.

    Splits never cross the start of a white-space run, so texts are cut there and
    each distinct part is encoded once per task.  The parts go through a byte-pair
    encoder with the ranks of the same file.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        alphabet = _byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        self.codec = tiktoken.Encoding("vocabulary", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, text: str) -> list[int]:
        return self.codec.encode(text, allowed_special="all")

    def _learn(self, keys: list[int], parts: list[bytes]) -> None:
        """Encode parts that begin with white space in one call.

        No token crosses from one part to the next, so the bytes of the tokens
        tell where each part ends.  Parts without it, or with the text of a
        special token, are encoded alone.
        """
        alone = [i for i, p in enumerate(parts) if not p[:1].isspace() or b"<|" in p]
        single = {i: self.encode(parts[i].decode()) for i in alone}
        joined = b"".join(p for i, p in enumerate(parts) if i not in single)
        ids = np.array(self.codec.encode_ordinary(joined.decode()), np.uint32)
        reach = np.cumsum(self.widths[ids])
        stops = np.cumsum([0 if i in single else len(p) for i, p in enumerate(parts)])
        size = np.diff(np.searchsorted(reach, stops, "right"), prepend=0)
        size[alone] = [len(single[i]) for i in alone]
        ends = np.cumsum(size)
        flat = np.empty(ends[-1], np.uint32)
        inside = np.ones(len(flat), bool)
        for i in alone:
            flat[ends[i] - size[i] : ends[i]] = single[i]
            inside[ends[i] - size[i] : ends[i]] = False
        flat[inside] = ids
        place = len(self.ends) - 1
        self.known.update(zip(keys, range(place, place + len(keys)), strict=True))
        self.ends = np.append(self.ends, ends + self.ends[-1])
        self.pool = np.append(self.pool, flat)

    def columns(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without the end token."""
        body, cuts = text_bytes(texts)
        n = len(body)
        if not n:
            return [np.zeros(0, np.uint32)] * len(texts)
        space = _SPACE[body]
        begin = np.zeros(n, bool)
        begin[1:] = space[1:] & ~space[:-1]
        begin[cuts[:-1][cuts[:-1] < n]] = True
        starts = np.flatnonzero(begin)
        stops = np.append(starts[1:], n)
        raw = body.tobytes()
        rare = np.cumsum(np.append(0, _RARE[body]))[cuts]
        odd = [
            i for i in np.flatnonzero(np.diff(rare))
            if not _PLAIN.fullmatch(raw[cuts[i] : cuts[i + 1]].decode())
        ]
        values, at, inverse = np.unique(range_hashes(body, starts, stops), return_index=True, return_inverse=True)
        if len(self.known) > _MOST_CACHED:
            self._clear()
        listed = values.tolist()
        new = [j for j, value in enumerate(listed) if value not in self.known]
        if new:
            self._learn([listed[j] for j in new], [raw[starts[k] : stops[k]] for k in at[new]])
        known = self.known
        place = np.array([known[value] for value in listed])[inverse]
        size = np.diff(self.ends)[place]
        total = np.cumsum(size)
        ids = self.pool[np.repeat(self.ends[place] - total + size, size) + np.arange(total[-1])]
        edges = np.append(0, total)[np.searchsorted(starts, cuts)]
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i in odd:
            out[i] = np.array(self.encode(raw[cuts[i] : cuts[i + 1]].decode()), np.uint32)
        return out


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        tokens = Tokens(path)
        for batch in batches:
            for part in slices(batch, most=_SLICE):
                ids_of = tokens.columns(part.column("text"))
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(ids_of):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    begin = 0
                    for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        row.append(i)
                        piece.append(k)
                        start.append(begin)
                        length.append(stop - begin)
                        crc.append(zlib.crc32(ids[begin:stop].tobytes()))
                        begin = stop
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return run


def sweep(docs: list[list[int]], gaps: list[list[int]]) -> tuple[list[tuple], list[list[int]], list[list[int]]]:
    """One round: (matches, docs left, gaps left).

    ``docs`` are runs [size, first rank, count] and ``gaps`` runs [gap, first
    sequence, count].  Going down the sizes, a piece takes the smallest gap still
    open, the last one passed; runs match rank by rank.  No gap takes two pieces.
    """
    matches, left, grown = [], [], []
    order = sorted(gaps, key=lambda g: (-g[0], g[1]))
    docs = sorted(docs, key=lambda d: (-d[0], d[1]))
    open_gaps: list[list[int]] = []
    at = 0
    for size, rank, count in docs:
        while at < len(order) and order[at][0] >= size:
            open_gaps.append(list(order[at]))
            at += 1
        while count and open_gaps:
            gap, sequence, free = open_gaps[-1]
            n = min(count, free)
            matches.append((size, rank, n, sequence, gap))
            if gap > size:
                grown.append([gap - size, sequence, n])
            open_gaps[-1] = [gap, sequence + n, free - n]
            if n == free:
                open_gaps.pop()
            rank, count = rank + n, count - n
        if count:
            left.append([size, rank, count])
    return matches, left, [*open_gaps, *order[at:], *grown]


def fit_rounds(counts: dict[int, int], capacity: int, band: int = BAND) -> tuple[list[tuple], int]:
    """(size, first rank, count, first sequence, offset) of all pieces; sequences used.

    Rounds go down the sizes band by band, so that small pieces cannot take gaps
    that larger ones still need.
    """
    gaps: list[list[int]] = []
    plan, used = [], 0
    for low in range((capacity - 1) // band * band, -1, -band):
        docs = [[size, 0, counts[size]] for size in range(low, low + band) if counts.get(size)]
        while docs:
            matches, docs, gaps = sweep(docs, gaps)
            plan += [(size, rank, n, seq, capacity - gap) for size, rank, n, seq, gap in matches]
            if docs and not any(gap >= docs[-1][0] for gap, *_ in gaps):
                need = math.ceil(sum(size * n for size, _, n in docs) / capacity)
                gaps.append([capacity, used, need])
                used += need
    return plan, used


def pack(
    docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    pieces = settle(
        base.mapInArrow(
            _pieces(vocabulary, capacity, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
        ),
        "pieces",
    )
    counts = {r.length: r["count"] for r in pieces.filter(F.col("length") < capacity).groupBy("length").count().collect()}
    plan, used = fit_rounds(counts, capacity)
    placed = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", "pieces-by-size")
    full = placed.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.col("rank") + used, "offset": F.lit(0).cast("long")}
    )
    names = "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    if not plan:
        return full.select(*names)
    runs = fixed_rows(
        docs.sparkSession, "size bigint, low bigint, n bigint, sequence bigint, at bigint", plan
    )
    inside = (F.col("length") == F.col("size")) & F.col("rank").between(F.col("low"), F.col("low") + F.col("n") - 1)
    rest = placed.filter(F.col("length") < capacity).join(F.broadcast(runs), inside).withColumns(
        {"sequence_id": F.col("sequence") + F.col("rank") - F.col("low"), "offset": F.col("at")}
    )
    return rest.select(*names).union(full.select(*names))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
