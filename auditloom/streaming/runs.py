"""Bounded streaming runs: everything that is there is processed, then the run ends and can be resumed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """What one bounded run did."""

    batches: int
    rows: int
    late: int        # rows that came after the watermark had passed them


def run_available(stream: DataFrame, sink: str, checkpoint: str, settings: dict[str, str] | None = None) -> Run:
    """Process all input that is there, append the rows that are final to the Parquet folder ``sink``, and end.

    ``checkpoint`` holds offsets and state. A later call with the same folder, and
    one after a failure, goes on where the last finished batch ended; the sink's
    log makes a repeated batch count once. Both folders must be shared by all
    executors. ``settings`` are session settings of this run alone.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for name, value in (settings or {}).items():
        spark.conf.set(name, value)
    try:
        query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    query.awaitTermination()
    progress = query.recentProgress
    return Run(len(progress), sum(p["numInputRows"] for p in progress),
               sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"]))


def cut_points(df: DataFrame, time: str, parts: int) -> list[int]:
    """Times that cut ``df`` into ``parts`` slices of about equal size, from one pass with a bounded sketch."""
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    return list(dict.fromkeys(df.agg(F.percentile_approx(time, shares, F.lit(10_000))).first()[0] or [])) if parts > 1 else []


def stage_slice(df: DataFrame, folder: str, time: str, low: int | None, high: int | None) -> None:
    """Append the rows with ``low < time <= high`` as files of one batch."""
    kept = F.lit(True) if low is None else F.col(time) > low
    df.where(kept & (F.lit(True) if high is None else F.col(time) <= high)).write.mode("append").parquet(folder)


def read_slices(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Files of ``folder`` as a stream, oldest first, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def event_time(us: str | Column) -> Column:
    return F.timestamp_micros(us)
