"""Token counts of whole texts by a public tokenizer's own library.

An Arrow function gets the text column alone and returns lengths alone; all
other columns stay with Spark.  Inside a task, rows form groups of about equal
bytes, and a group is one batch of the library.  Long texts are cut at places
that no token crosses, so the lengths of the parts add up to that of the whole
and a batch stays small.  Safe places are, by the tokenizer's file:

- byte-level vocabularies without a normaliser: after a character that is not
  white space, before a blank, tab or line end;
- tokenizers that drop white space, and sentence pieces with a leading word
  mark: a single blank between two letters or digits, which belongs to no part.

A tokenizer whose file shows neither form gets every text in one part, as does a
text without such a place.

The library of byte-level JSON files takes about a second a megabyte, so plain
parts go through a rank encoder with the merges of the same file, three times as
fast and with the same lengths: parts of scripts whose characters have long been
assigned, without special strings and without very long unbroken runs.  All
others take the library itself.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings
inside a text count as the library counts them by default; no token is added,
nothing truncated or padded.  Rows stand for themselves: repeated rows and ids
are counted each, nulls in other columns are kept, an empty table gives no rows.
Input columns named like an output (``n_bytes``, ``n_tokens``, ``over_limit``)
are replaced by it, all others pass through.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from busweave.llm.packing import Tokens
from busweave.llm.words import slices

LIMIT = 1024
GROUP_BYTES = 1 << 20
PART_CHARS = 1 << 16
#: Longer unbroken runs are left to the library.
UNBROKEN = 1 << 10

_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[ \t\r\n])")
_BETWEEN_WORDS = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: Outside Latin, Cyrillic, Hangul, kana, the first Han block and common punctuation.
_UNUSUAL = re.compile(
    r"[^\x09-\x0d\x20-\x7e\xa1-\u036f\u0400-\u052f\u2010-\u2027\u3001-\u3003"
    r"\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]"
)
_RUN = re.compile(rf"\S{{{UNBROKEN}}}")


def _json_cut(spec: dict) -> re.Pattern | None:
    """Where texts may be cut for a tokenizers JSON file, or None."""
    added = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added):
        return None
    split, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not normal:
        return _BEFORE_SPACE
    first = (split.get("pretokenizers") or [{}])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return _BETWEEN_WORDS if drops and " " not in first["pattern"].get("Regex", " ") else None


class Counter:
    """Token counts of texts by the library of a vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.ranks, self.special = None, []
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
            marked = model.encode_as_pieces("a")[0].startswith("▁")
            self.cut = _BETWEEN_WORDS if marked and not inner else None
            self.library = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as source:
                spec = json.load(source)
            codec = Tokenizer.from_file(path)
            codec.no_truncation()
            codec.no_padding()
            self.cut = _json_cut(spec)
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
            self.library = lambda texts: [len(x) for x in codec.encode_batch_fast(texts, add_special_tokens=False)]
            if self.cut is _BEFORE_SPACE and spec["model"]["type"] == "BPE":
                self.ranks = Tokens(path).codec

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about PART_CHARS characters, cut at safe places only."""
        start = 0
        while self.cut and len(text) - start > PART_CHARS:
            found = self.cut.search(text, start + PART_CHARS)
            if not found:
                break
            yield text[start : found.start()]
            start = found.end()
        yield text[start:] if start else text

    def _plain(self, part: str) -> bool:
        return (
            self.ranks is not None
            and not any(mark in part for mark in self.special)
            and not _UNUSUAL.search(part)
            and not (len(part) >= UNBROKEN and _RUN.search(part))
        )

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a batch of the library holds about GROUP_BYTES."""
        out = np.zeros(len(texts), np.int64)
        batch, owners, held = [], [], 0
        for i, text in enumerate(texts):
            for part in self.parts(text):
                if self._plain(part):
                    out[i] += len(self.ranks.encode_ordinary(part))
                    continue
                batch.append(part)
                owners.append(i)
                held += len(part)
                if held >= GROUP_BYTES:
                    np.add.at(out, owners, self.library(batch))
                    batch, owners, held = [], [], 0
        if batch:
            np.add.at(out, owners, self.library(batch))
        return out


def _lengths(path: str) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path)
        for column in columns:
            groups = slices(pa.record_batch([column], names=["text"]), most=GROUP_BYTES)
            counts = [counter.counts([x or "" for x in g.column(0).to_pylist()]) for g in groups]
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *counts]))

    return run


def token_count(text: Column, tokenizer: str) -> Column:
    """Number of tokens of a text column; null counts as empty."""
    run = _lengths(tokenizer)

    @F.arrow_udf("bigint")
    def lengths(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(columns)

    return lengths(text)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is a vocabulary file that every executor can open: JSON of the
    tokenizers library, or a sentence-piece model.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        *rest, F.octet_length(whole).cast("long").alias("n_bytes"), token_count(whole, tokenizer).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


QUERIES = {"op12_token_counts": op12_token_counts}
