"""Packing: ids of the tokenizer, gapless sequences, few of them."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from busweave.llm.packing import Tokens, fit_rounds, pack
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "a<|endoftext|> b  c\n\n d\t\te  ", "don't  stop\xa0 now   x\x1cy", " lead", "trail \n", "日本語 テスト　x 🙂🙂  1234567 é", "\n\n", "w " * 300_000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    tokens = Tokens(PATH)
    for batch in (texts, texts[::-1], [""], []):
        assert [x.tolist() for x in tokens.columns(pa.array(batch, pa.string()))] == ids_of(tokenizer, batch)


def test_rounds_are_close_to_best():
    rng = random.Random(2)
    counts = Counter(min(1023, int(rng.expovariate(1 / 300)) + 1) for _ in range(20_000))
    plan, used = fit_rounds(counts, 1024)
    load = np.zeros(used, int)
    placed = Counter()
    for size, _, n, sequence, offset in sorted(plan, key=lambda p: p[4]):
        assert (load[sequence : sequence + n] == offset).all()
        load[sequence : sequence + n] += size
        placed[size] += n
    assert placed == counts and load.max() <= 1024 and load.min() > 0
    assert used <= 1.01 * math.ceil(sum(s * n for s, n in counts.items()) / 1024) + 1
    assert fit_rounds({}, 1024) == ([], 0) and fit_rounds({1: 1}, 1024)[1] == 1


def test_pack(spark, tokenizer):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD
    rows = [(i // 2 if i < 8 else i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1)]
    docs = spark.createDataFrame([*rows, rows[30]], "doc_id long, text string, length string, rank int")
    got = pack(docs, PATH).collect()
    want = Counter()
    for (key, *_), ids in zip([*rows, rows[30]], ids_of(tokenizer, [r[1] for r in [*rows, rows[30]]])):
        ids = np.array([*ids, 2], "<u4")
        begin = 0
        for piece, stop in enumerate(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)):
            want[key, piece, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())] += 1
            begin = stop
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.03 * math.ceil(sum(r.length for r in got) / 1024) + 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
