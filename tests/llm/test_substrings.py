"""Repeated word runs against a window count in plain Python."""

import random
import re
from collections import Counter

from busweave.llm.substrings import drop_repeats


def brute(texts, width):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "é", "Bb", "c", "dd"]
    phrase = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \n\t ", "x", "a " * 500, "b\xa0c " * 40, " ".join(["p", "q", "r"] * 200)]
    for _ in range(60):
        body = [rng.choice([*words, str(rng.randrange(10_000))]) for _ in range(rng.choice([5, 34, 35, 36, 90, 300]))]
        cut = rng.randrange(61)
        body[rng.randrange(len(body)) : 0] = phrase[cut : cut + rng.choice([10, 34, 35, 40, 60])]
        texts.append(rng.choice([" ", "\n", " \t"]).join(body))
    long = " ".join(str(rng.randrange(50)) for _ in range(120_000))
    texts += texts[-5:] + [long, long[:300_000] + "z"]
    rows = [(None if i == 3 else i // 2 if i < 8 else i, t, "n") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[20]], "doc_id long, text string, seed string")
    got = drop_repeats(docs)
    assert got.columns == ["doc_id", "text", "seed", "n_words", "n_removed", "kept_text"]
    want = Counter(zip([r[0] for r in [*rows, rows[20]]], brute([r[1] for r in [*rows, rows[20]]], 35)))
    assert Counter((r[0], (r.n_words, r.n_removed, r.kept_text)) for r in got.collect()) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeats(docs).count() == 0
