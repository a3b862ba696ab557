"""Archives: exact round trip, range borders, revisits."""

import base64
import hashlib
import io
import random

import pytest
from busweave.llm import warc
from pyspark.sql import functions as F


def pages(spark):
    rng = random.Random(1)
    rows = [(1, "u1", "same"), (2, None, "same"), (9, "u9", "same"), (3, "u\r\nX: y", None), (4, "e", ""), (None, "n", "same"),
            (5, "five", "\r\n\r\nWARC/1.1\r\n"), (6, "six", "".join(chr(rng.randrange(32, 0xD000)) for _ in range(300_000))), (7, "t", "tie"), (7, "t", "tie")]
    rows += [(100 + i, f"p{i}", f"<p>{'x' * rng.randrange(2000)}{i // 3}</p>") for i in range(300)]
    return rows, spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("span", [700, 1 << 20])
def test_round_trip(spark, tmp_path, span):
    rows, table = pages(spark)
    root = f"file://{tmp_path}/w"
    files = warc.write_archives(table, root, file_bytes=20_000)
    got = warc.without_nested(warc.read_archives(files, root, range_bytes=span)).collect()
    assert len(got) == len(rows)
    newest = {}
    for page, _, html in rows:
        newest[html or ""] = max(newest.get(html or "", -1), -1 if page is None else page)
    text = {}
    for page, _, html in rows:
        text.setdefault(page, html or "")
    for r in got:
        body = text[r.page_id].encode()
        want = "response" if newest[text[r.page_id]] == r.page_id else "revisit"
        assert (r.record_type, r.payload_bytes) == (want, len(body))
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.refers_to == (None if want == "response" else newest[text[r.page_id]])
        assert r.payload == (body if want == "response" else None)


def test_false_magic_and_nested_archive():
    inner = warc._member(warc._record(1, "i", b"inner", None, False))
    stored = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    outer = stored.compress(warc._record(2, "o", b"\x1f\x8b\x08junk" + inner, None, False)) + stored.flush()
    data = outer + warc._member(warc._record(3, "x", b"last", None, False))
    whole = [s for s, _, _ in warc._scan(io.BytesIO(data), 0, len(data))]
    assert whole == [0, len(outer)]
    middle = [s for s, _, _ in warc._scan(io.BytesIO(data), 50, len(data))]
    assert middle[-1] == len(outer) and len(middle) == 2


def test_nested_records_are_dropped(spark):
    rows = spark.createDataFrame([("a", 0, 90), ("a", 40, 60), ("a", 90, 95), ("b", 10, 20)], "path string, record_start long, record_end long")
    assert sorted(r.record_start for r in warc.without_nested(rows).collect()) == [0, 10, 90]


def test_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    assert warc.read_archives(warc.write_archives(table, root), root).count() == 0


def test_reading_spreads_over_tasks(spark, tmp_path):
    _, table = pages(spark)
    root = f"file://{tmp_path}/w"
    files = warc.write_archives(table, root, file_bytes=20_000)
    records = warc.read_archives(files, root, range_bytes=2000)
    tasks = records.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 8


def test_paths_without_a_scheme_belong_to_the_default_file_system(spark):
    assert warc._qualified(spark, "/some/folder") == "file:///some/folder"
    assert warc._qualified(spark, "file:/some/folder") == "file:///some/folder"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store")
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert warc._qualified(spark, "/in/folder") == "viewfs://store/in/folder"
    finally:
        conf.set("fs.defaultFS", before)
