"""The secret scan against a plain regular-expression scan."""

import hashlib
import re

from busweave.llm import secrets
from pyspark.sql import functions as F

DOCS = [
    (1, 'x token = "abcdef0123" y', "k"), (2, None, "k"), (3, "", None), (None, "password:hunter22 é token=ab", "k"),
    (5, "é" * 40 + " AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2, "k"), (5, "Api_Key='zzzzzzz' apikey: q.w-e=r", "k"),
    (7, "token:token:abcdefgh secret = =====a", "k"), (8, "AKIAAKIAAKIAAKIAAKI AKIA1", "k"), (9, "toKEN:  0123456789abcdef0123456789abcdef!", "k"),
    (9, "toKEN:  0123456789abcdef0123456789abcdef!", "k"), (10, " ".join(f"token: value{i:06d} é" for i in range(700)), "k"),
    (11, "ghp_" + "a1B2" * 9 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890ab", "k"),
]


def plain(text):
    found = []
    for order, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, f"{rule.kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def test_matches_plain_scan(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, kind string")
    got = secrets.scan_secrets(docs).select("doc_id", "text", "kind", secrets.span_text(F.col("secret_spans"))).collect()
    assert sorted(map(str, got)) and len(got) == len(DOCS)
    for row in got:
        assert row[3] == plain(row[1])


def test_query_digest(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, kind string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = secrets.op9_secret_scan(spark, str(tmp_path)).filter("doc_id = 1").collect()
    assert rows[0].n_assign == 1 and rows[0].n_hex == 0
    assert rows[0].base_sha256 == hashlib.sha256(plain(DOCS[0][1]).encode()).hexdigest()


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert len(secrets.trigram_query(secrets.BASE_RULES[0].pattern)) == 6


def test_redaction(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, kind string")
    clean = secrets.scan_secrets(docs).select(secrets.redact(F.col("text"), F.col("secret_spans")).alias("text"))
    left = [r.text for r in clean.collect() if r.text]
    assert "x [SECRET]\" y" in left and "toKEN" not in "".join(left)
    assert not any("0123456789abcdef0123456789abcdef" in t for t in left)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, rules string")
    assert secrets.scan_secrets(docs).columns == ["doc_id", "text", "rules", "secret_spans"]
    assert secrets.scan_secrets(docs).count() == 0
