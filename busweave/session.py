"""Session helpers: a local session for tests and benches, and scratch folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cpus: int | str = 8, app: str = "busweave") -> SparkSession:
    """A local session sized for tests; on a cluster, bring your own session."""
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, or a temporary one in local mode only."""
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="busweave-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root; nothing is created there yet."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def fixed_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small constant table as literals, so that its size is known to the planner."""
    columns = [field.split() for field in schema.split(",")]

    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(value).lower() if isinstance(value, bool) else repr(value)

    values = ", ".join(f"({', '.join(map(literal, row))})" for row in rows)
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(columns))
    aliases = ", ".join(f"c{i}" for i in range(len(columns)))
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({aliases})")


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write an intermediate result to the shared scratch folder and read it back.

    For results that several branches of a plan use and that are costly to
    recompute.  Written files survive lost executors and cut the lineage, and
    their size is known to the planner.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
