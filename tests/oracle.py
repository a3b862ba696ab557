"""Run queries and their reference SQL side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, db, sf_dir, query, sql):
    """(rows, problem or None, seconds) of one query."""
    started = time.time()
    frame = query(spark, sf_dir)
    got = frame.collect()
    seconds = time.time() - started
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return len(got), f"columns {sorted(frame.columns)} != {sorted(columns)}", seconds
    left, right = _rows(got, frame.columns), _rows(want, columns)
    if left != right:
        extra = list((left - right).items())[:2]
        lack = list((right - left).items())[:2]
        return len(got), f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {lack}", seconds
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    odd = [
        f"{f.name}: {f.dataType.simpleString()} / {types[f.name]}" for f in frame.schema
        if names.get(f.dataType.simpleString()) != types[f.name]
    ]
    return len(got), (f"types {odd}" if odd else None), seconds


def main(argv):
    import __spark_entry__ as contract
    from busweave.session import local_session
    from pyspark.sql import SparkSession

    sf_dir = argv[0]
    wanted = argv[1:] or list(contract.queries())
    if argv[1:2] == ["--plain"]:
        spark, wanted = SparkSession.builder.master("local[8]").getOrCreate(), argv[2:] or list(contract.queries())
    else:
        spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    db = connect(sf_dir)
    sqls = contract.oracle_sql()
    bad = 0
    for name in wanted:
        try:
            if name in sqls:
                rows, problem, seconds = compare(spark, db, sf_dir, contract.queries()[name], sqls[name])
            else:
                rows, problem, seconds = contract.queries()[name](spark, sf_dir).count(), "no sql", 0
        except Exception as error:
            rows, problem, seconds = -1, f"{type(error).__name__}: {str(error)[:600]}", 0
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={rows} {seconds:.2f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
