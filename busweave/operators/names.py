"""Name search by an index of character runs.

The index holds, for every name, its distinct runs of one, two and three lower
case characters with the name's place in the list, sorted by run: a reader gets
only the row groups of the runs it asks for.  A table of runs with their number
of names tells which of a query's runs are rare.  A search intersects the
postings of the rarest ones, fetches the names left, and verifies the whole
query, so its rows are those of ``search_signal_names``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_LONGEST = 3
#: Postings intersected by one search; the others are left to verification.
_RAREST = 4


def _runs(text: str) -> list[str]:
    """The runs that any name with this text holds."""
    size = min(len(text), _LONGEST)
    return sorted({text[i : i + size] for i in range(len(text) - size + 1)})


def name_postings(names: DataFrame, order: str = "line_key") -> DataFrame:
    """``(run, place)`` for every distinct run of every name."""
    text = F.lower("name")
    at = F.sequence(F.lit(1), F.length(text))
    sizes = F.array(*[F.lit(n) for n in range(1, _LONGEST + 1)])
    runs = F.flatten(
        F.transform(sizes, lambda n: F.transform(at, lambda i: F.substr(text, i, n)))
    )
    held = names.filter(F.length("name") > 0)
    return held.select(F.explode(F.array_distinct(runs)).alias("run"), F.col(order).alias("place"))


def write_name_index(names: DataFrame, path: str, order: str = "line_key") -> None:
    """Postings, run counts and names below ``path``; ``order`` is unique per name row.

    Names are dealt out first: a scan task may hold any number of them, and each
    becomes dozens of postings, twice, since range partitioning takes a sample.
    """
    names = names.select(F.col(order), "name").repartition(order)
    postings = name_postings(names, order)
    spread = postings.repartitionByRange("run", "place").sortWithinPartitions("run", "place")
    spread.write.parquet(f"{path}/postings")
    written = names.sparkSession.read.parquet(f"{path}/postings")
    counts = written.groupBy("run").agg(F.count("*").alias("names"))
    counts.repartitionByRange("run").sortWithinPartitions("run").write.parquet(f"{path}/runs")
    listed = names.select(F.col(order).alias("place"), "name")
    listed.repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{path}/names")


def indexed_search(spark: SparkSession, path: str, query: str, limit: int, order: str = "line_key") -> DataFrame:
    """First ``limit`` names holding the query, any case, in list order; blank finds nothing."""
    listed = spark.read.parquet(f"{path}/names").withColumnRenamed("place", order)
    wanted = query.strip().lower()
    if not wanted:
        return listed.limit(0)
    runs = _runs(wanted)
    counts = spark.read.parquet(f"{path}/runs").filter(F.col("run").isin(runs))
    # at most one row per character of the query
    known = {r["run"]: r["names"] for r in counts.collect()}
    if len(known) < len(runs):
        return listed.limit(0)
    rare = sorted(runs, key=lambda run: (known[run], run))[:_RAREST]
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("run").isin(rare))
    both = postings.groupBy(F.col("place").alias(order)).agg(F.count("*").alias("_runs"))
    hits = listed.join(both.filter(F.col("_runs") == len(rare)), order).drop("_runs")
    return hits.filter(F.lower("name").contains(wanted)).orderBy(order).limit(limit)
