"""Token counts against the tokenizers' own libraries on whole texts."""

import random

import public_tokenizers as P
import pytest
from busweave.llm import tokencount
from busweave.llm.tokencount import Counter, count_tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def library(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def texts():
    rng = random.Random(5)
    signs = list("ab1 '\n\t  ,.é中文。́ß Σ\xa0\x1c\x85ᲀ") + ["<|endoftext|>", "'ll", "  ", "don't", " x y z", "<|"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(300))) for _ in range(800)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("size", [7, 1 << 16])
def test_parts_add_up_to_the_whole(name, size, monkeypatch):
    monkeypatch.setattr(tokencount, "PART_CHARS", size)
    monkeypatch.setattr(tokencount, "UNBROKEN", 40)
    path = P.path(name)
    assert list(Counter(path).counts(texts())) == library(path, texts())


@pytest.mark.parametrize("name", FILES)
def test_long_texts(name):
    path = P.path(name)
    long = ["word and Other 12 " * 12_000, "日本語。" * 3000, "x" * 5000, "line\n" * 30_000, "  " * 3000]
    counter = Counter(path)
    assert list(counter.counts(long)) == library(path, long)
    assert max(len(p) for p in counter.parts(long[0])) < tokencount.PART_CHARS + 20


def test_table(spark):
    path = P.path(FILES[0])
    rows = [(1, None, "a"), (None, "", "b"), (3, "Grüße <|endoftext|> x", None), (3, "Grüße <|endoftext|> x", None), (5, "tok " * 1024, "c"), (6, "tok " * 1025, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("lengths", docs_extra())
    got = count_tokens(docs, path).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "lengths", "n_bytes", "n_tokens", "over_limit"}
    want = library(path, [t or "" for _, t, _ in rows])
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for _, t, _ in rows]
    assert [r.over_limit for r in got] == [n > 1024 for n in want]
    assert count_tokens(docs.limit(0), path).count() == 0


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit(7)


def test_only_text_goes_to_python(spark):
    docs = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, other string")
    plan = count_tokens(docs, P.path(FILES[0]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lengths(coalesce(text" in plan
