"""Streaming form of the window features and the alert sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import MICROS
from auditloom.operators.windows import base_aggregates, prepare_events, window_label


def stream_window_features(df: DataFrame, size_us: int = 10 * MICROS, origin_us: int = 0,
                           watermark: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """Window features of a stream of events.

    A stream has no first event to count from, so ``origin_us`` is given. Rows
    later than the watermark are dropped. Distinct counts are approximate:
    streaming state stays bounded per window.
    """
    if size_us <= 0:
        raise ValueError("window size must be positive")
    by = ["source"] if by is None else by
    events = prepare_events(df).withColumn("event_time", F.timestamp_micros("ts_us"))
    span = F.window("event_time", f"{size_us} microseconds", startTime=f"{origin_us % size_us} microseconds")
    grouped = events.withWatermark("event_time", watermark).groupBy(*by, span.alias("_window"))
    rows = grouped.agg(*base_aggregates(approx_distinct=True))
    start = F.unix_micros("_window.start")
    labels = [F.col(f"label_{c}_count") for c in ("benign", "malicious", "ambiguous", "unlabeled")]
    return rows.withColumns({
        "window_id": F.floor((start - F.lit(origin_us)) / size_us).cast("bigint"),
        "window_start_us": start, "window_end_us": start + size_us,
        "window_label": window_label(*labels),
    }).drop("_window")


def stream_alert_sessions(df: DataFrame, gap_us: int = 5 * MICROS, watermark: str = "1 minute",
                          by: list[str] | None = None) -> DataFrame:
    """Alert intervals of a stream of scored sequences.

    Each sequence opens a session that lasts until its own end plus the gap, so
    merged sessions are the alerts of the batch operator. Event time counts half
    microseconds: the session of a sequence ends half a microsecond after the
    gap, so a start at the gap's end still joins, one a microsecond later does
    not, and a sequence without length or gap has a session too. ``watermark``
    is a whole number and a unit.
    """
    if gap_us < 0:
        raise ValueError("the alert gap must not be negative")
    by = ["source"] if by is None else by
    amount, unit = watermark.split()
    rows = df.where("combined_alert = 1").withColumn("event_time", F.timestamp_micros(2 * F.col("start_us")))
    hold = F.concat((2 * (F.col("end_us") - F.col("start_us") + gap_us) + 1).cast("string"), F.lit(" microseconds"))
    session = F.session_window("event_time", hold)
    first, last = F.struct("start_us", "sequence_id"), F.struct("end_us", "sequence_id")
    found = rows.withWatermark("event_time", f"{2 * int(amount)} {unit}").groupBy(*by, session.alias("_session")).agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.min_by("start_event_id", first).alias("start_event_id"), F.max_by("end_event_id", last).alias("end_event_id"),
        F.count(F.lit(1)).alias("sequence_count"),
        F.max("lstm_malicious_probability").alias("max_lstm_probability"),
        F.avg("lstm_malicious_probability").alias("mean_lstm_probability"),
        F.max("iforest_max_anomaly_score").alias("max_iforest_anomaly_score"),
        F.max("combined_score").alias("max_combined_score"),
        F.avg("combined_score").alias("mean_combined_score"),
        F.array_sort(F.collect_set("combined_reason")).alias("combined_reason_summary"))
    return found.withColumn("duration_seconds", (F.col("end_us") - F.col("start_us")) / MICROS).drop("_session")
