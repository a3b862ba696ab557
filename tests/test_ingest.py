"""Growing files, killed and repeated runs, against one plain reading."""

import os
import random

import pytest
from busweave.sources import ingest


def plain(text):
    return [line.rstrip(b"\r").decode("utf-8", "replace") for line in text.split(b"\n")[:-1]]


def lines_of(spark, table):
    rows = ingest.read_ingested(spark, table).orderBy("file_path", "generation", "line_key").collect()
    out = {}
    for r in rows:
        out.setdefault((os.path.basename(r["file_path"]), r["generation"]), []).append(r["value"])
    return out


def same(lines):
    return lines


@pytest.mark.parametrize("range_bytes", [7, 100, 1 << 20])
def test_growing_files_and_killed_runs(spark, tmp_path, monkeypatch, range_bytes):
    rng = random.Random(range_bytes)
    folder, table = tmp_path / "logs", f"file://{tmp_path}/table"
    folder.mkdir()
    whole = {f"{n}.log": b"" for n in "abc"}
    commit = ingest._commit
    for step in range(4):
        for name in whole:
            piece = b"".join(bytes(rng.choice(b"xy \xc3\xbc\xff") for _ in range(rng.randrange(30))) + rng.choice([b"\n", b"\r\n", b""]) for _ in range(20))
            whole[name] += piece
            (folder / name).write_bytes(whole[name])
        if step in (0, 2):
            # dies after the data, before the ledger
            monkeypatch.setattr(ingest, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError):
                ingest.ingest(spark, str(folder), table, same, range_bytes=range_bytes)
            monkeypatch.setattr(ingest, "_commit", commit)
        if step != 1:
            assert ingest.ingest(spark, str(folder), table, same, range_bytes=range_bytes) > 0
        if step:
            got = lines_of(spark, table)
            if step != 1:
                assert got == {(n, 0): plain(t) for n, t in whole.items()}
    assert ingest.ingest(spark, str(folder), table, same, range_bytes=range_bytes) == 0


def test_limited_runs_and_long_lines(spark, tmp_path):
    folder, table = tmp_path / "logs", f"file://{tmp_path}/table"
    folder.mkdir()
    text = b"".join(b"%d " % i * (i % 9) + b"\n" for i in range(200)) + b"z" * 3000 + b"\nlast\nopen"
    (folder / "a.log").write_bytes(text)
    runs = 0
    while ingest.ingest(spark, str(folder), table, same, most_bytes=900):
        runs += 1
    assert runs > 2 and lines_of(spark, table) == {("a.log", 0): plain(text)}
    (folder / "a.log").write_bytes(text + b" end\n")
    ingest.ingest(spark, str(folder), table, same)
    assert lines_of(spark, table)["a.log", 0][-1] == "open end"


def test_replaced_file_is_read_anew(spark, tmp_path):
    folder, table = tmp_path / "logs", f"file://{tmp_path}/table"
    folder.mkdir()
    (folder / "a.log").write_bytes(b"one\ntwo\n")
    (folder / "b.log").write_bytes(b"stays\n")
    ingest.ingest(spark, str(folder), table, same)
    (folder / "a.log").write_bytes(b"new\n")
    ingest.ingest(spark, str(folder), table, same)
    assert lines_of(spark, table) == {("a.log", 0): ["one", "two"], ("a.log", 1): ["new"], ("b.log", 0): ["stays"]}


def test_uncommitted_batches_are_not_read(spark, tmp_path):
    with pytest.raises(ValueError):
        ingest.read_ingested(spark, f"file://{tmp_path}/none")
