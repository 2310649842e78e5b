"""Activity intervals from run metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions.text import epoch_us


def intervals_from_metadata(spark: SparkSession, root: str, file_name: str = "metadata.txt") -> DataFrame:
    """One row per metadata file below ``root`` that names both epochs, sorted by start.

    Files hold ``key=value`` lines; the last value of a key counts. Folders
    ``chains`` and ``capabilities`` directly below ``root`` are left out.
    """
    lines = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter=file_name).select(
        F.col("_metadata.file_path").alias("metadata_path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("line")).alias("pos"),
        F.regexp_extract("value", r"^([^=]*)=(?s:.*)$", 1).alias("name"),
        F.regexp_extract("value", r"^[^=]*=((?s:.*))$", 1).alias("setting"))
    # listed paths are URI-encoded; the root is compared as text, whatever characters it holds
    folder = root.rstrip("/").removeprefix("file://") + "/"
    after = F.substring_index(F.url_decode(F.regexp_replace("metadata_path", "\\+", "%2B")), folder, -1)
    lines = lines.where(~F.substring_index(after, "/", 1).isin("chains", "capabilities"))
    keys = S.INTERVAL_COLUMNS[:-1]
    runs = lines.where(F.col("name").isin(keys)).groupBy("metadata_path").pivot("name", keys).agg(
        F.max_by("setting", "pos"))
    runs = runs.na.fill("").where("target_start_epoch <> '' AND target_end_epoch <> ''")
    return runs.select(*S.INTERVAL_COLUMNS).orderBy(
        epoch_us(F.col("target_start_epoch")), "target_start_epoch", "metadata_path")
