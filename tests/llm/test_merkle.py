"""Manifest trees against a plain recursive build, and tampering."""

import hashlib
import zlib

import pytest
from busweave.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(nodes, at, now):
    """(top, siblings, folded top) of node ``at``, whose value is taken to be ``now``."""
    seen = []
    while len(nodes) > 1:
        low = at // 16 * 16
        run = nodes[low : low + 16]
        seen += run[: at - low] + run[at - low + 1 :]
        now = h(*run[: at - low], now, *run[at - low + 1 :])
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return nodes[0], seen, now


def plain(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names]
    tops = [climb([leaf(r) for r in t], 0, "")[0] for t in trees]
    out = []
    for place, tree in enumerate(trees):
        leaves = [leaf(r) for r in tree]
        for i, r in enumerate(tree):
            now = leaf((*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if tampered(r) else leaves[i]
            subroot, below, folded = climb(leaves, i, now)
            root, above, folded = climb(tops, place, folded)
            out.append((r[0], leaves[i], subroot, root, h(*below, *above), folded, folded == root))
    return sorted(out, key=str)


def tampers(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 300], [1] * 40 + [33], [5000, 2]])
def test_agrees_with_a_plain_tree(spark, sizes):
    rows = [
        (7 * i - 3, f"s{g}" if g else None, None if i % 3 else "en", i, f"Text Ü {i % 9}" if i % 4 else None, "x", 1)
        for g, n in enumerate(sizes) for i in range(n)
    ]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    other = merkle.leaf_digest(
        *(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in merkle.FIELDS)
    )
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, other)
    got = merkle.verify(merkle.build(docs, changed=changed))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, tampers)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, None, None, None, None, None, None)] * 2 + [(None, "", "", 0, "", "t", 0), (3, "a", "en", 1, "B" * 200_000, "t", 0), (3, "a", "en", 1, "b", "t", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.verify(merkle.build(docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, lambda r: False)
    assert merkle.verify(merkle.build(docs.limit(0))).count() == 0


def test_fold_takes_right_siblings_only():
    parent = merkle.Parent([bytes([i]) * 32 for i in range(16)])
    texts = [(bytes([i]) * 32).hex() for i in range(16)]
    for slot in range(16):
        assert parent.fold(slot, texts[slot]) == parent.digest
        assert parent.fold(slot, "00" * 32) == h(*texts[:slot], "00" * 32, *texts[slot + 1 :])
