"""Overlap of streamed sequences and streamed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions import text as X
from auditloom.operators.fusion import window_scores
from auditloom.streaming.runs import event_time


def stream_overlap_scores(sequences: DataFrame, windows: DataFrame, window_us: int, max_duration_us: int,
                          threshold: float = S.IFOREST_THRESHOLD, low: float = 0.0, high: float = 1.0,
                          watermark: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """Sequences with the summary of all windows they overlap, closed at both ends, as both streams arrive.

    Both sides are held until the watermark shows that no partner can come: a
    window of ``window_us`` starts at most that long before a sequence, and a
    sequence lasts at most ``max_duration_us``; a longer row of either kind fails
    the run. A sequence without windows comes out with zeros. A stream knows no
    least and greatest score, so ``low`` and ``high`` are those of a baseline and
    the scaled score is cut to 0..1. Columns are those of ``fusion.overlap_scores``
    without the lists.
    """
    by = ["source"] if by is None else by

    def bounded(start: str, end: str, most: int, what: str):
        wrong = F.raise_error(F.concat(F.lit(f"{what} longer than {most} microseconds: "), (F.col(end) - F.col(start)).cast("string")))
        return F.when(F.col(end) - F.col(start) > most, wrong).otherwise(F.col(end))

    left = sequences.withColumns({"end_us": bounded("start_us", "end_us", max_duration_us, "sequence"), "_start": event_time("start_us")})
    left = left.withWatermark("_start", watermark)
    scored = window_scores(windows, threshold)
    right = scored.select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("window_start_us").alias("_ws"),
        bounded("window_start_us", "window_end_us", window_us, "window").alias("_we"), event_time("window_start_us").alias("_from"),
        F.col("iforest_anomaly_score").alias("_score"), F.col("iforest_threshold_alert").alias("_alert"), F.col("iforest_is_anomaly").alias("_native"))
    right = right.withWatermark("_from", watermark)
    met = (F.col("_ws") <= F.col("end_us")) & (F.col("_we") >= F.col("start_us"))
    met &= F.expr(f"_from >= _start - INTERVAL {window_us} MICROSECONDS AND _from <= _start + INTERVAL {max_duration_us} MICROSECONDS")
    for c in by:
        met &= F.col(c) == F.col(f"_{c}")
    span = high - low
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_score") - low) / span)) if span > 0 else F.lit(0.0)
    kept = [c for c in left.columns if c not in ("_start", "sequence_id", *by)]
    pairs = left.join(right, met, "left")
    # a sequence's own columns are equal in all its rows
    found = pairs.groupBy(*by, "sequence_id", "_start").agg(
        *[F.any_value(c).alias(c) for c in kept],
        F.count("_ws").alias("iforest_overlap_count"),
        F.coalesce(F.max("_score"), F.lit(0.0)).alias("iforest_max_anomaly_score"),
        F.coalesce(F.avg("_score"), F.lit(0.0)).alias("iforest_mean_anomaly_score"),
        F.coalesce(F.max(F.when(F.col("_ws").isNotNull(), scaled)), F.lit(0.0)).alias("iforest_max_anomaly_score_norm"),
        F.coalesce(F.max("_alert"), F.lit(0)).alias("iforest_any_anomaly"),
        F.coalesce(F.max("_native"), F.lit(0)).alias("iforest_model_any_anomaly"))
    return found.drop("_start").withColumn("iforest_threshold", F.lit(float(threshold)))
