"""Session settings and the small amount of state that jobs share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SCRATCH_KEY = "spark.checkpoint.dir"
_local_roots: dict[str, str] = {}

# Settings the plans rely on. Skew-join splitting and partition coalescing are
# left to adaptive execution; the sizes suit executors of a few GB per core.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.files.maxPartitionBytes": "128m",
    # the JIT never compiles methods beyond 8000 bytes; wide projections must split
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "auditloom", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut a lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, because no other machine reads it.
    """
    context = spark.sparkContext
    root = spark.conf.get(SCRATCH_KEY, None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {SCRATCH_KEY} to a folder that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="auditloom-")
    return _local_roots[context.applicationId]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later passes then see one fixed result: nothing is recomputed, a lost
    executor costs only its running tasks, and each pass reads just the columns
    it needs.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, columns: list[Column], write) -> dict:
    """Aggregates of ``df`` taken while ``write(df)`` writes it; no second pass reads the rows again.

    ``columns`` are named aggregates without distinct values; ``write`` runs one
    action. An empty table gives counts of 0.
    """
    seen = Observation()
    write(df.observe(seen, *columns))
    return seen.get


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint()
