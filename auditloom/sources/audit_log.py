"""Raw audit log lines with an order key that survives every shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_raw(spark: SparkSession, paths: str | list[str], source: str | Column = "",
             source_pattern: str | None = None) -> DataFrame:
    """Lines of plain or gzip logs as ``(source, pos, value)``.

    Invalid UTF-8 becomes replacement characters. ``pos`` orders lines by the age
    of their file, block and line; files of one age follow a hash of their path.
    It is made from what the reader knows of each line, so lines are neither
    joined nor moved. ``source`` names the host: a fixed name or, with
    ``source_pattern``, group 1 of that pattern on the file path.
    """
    path = F.col("_metadata.file_path")
    if source_pattern:
        host = F.regexp_extract(path, source_pattern, 1)
    else:
        host = F.lit(source) if isinstance(source, str) else source
    pos = F.struct(
        F.col("_metadata.file_modification_time").alias("modified"), F.xxhash64(path).alias("file_hash"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_no"))
    return spark.read.text(paths).select(host.alias("source"), pos.alias("pos"), F.make_valid_utf8("value").alias("value"))
