"""Window and sequence scores fused into one decision per sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions import text as X
from auditloom.operators.intervals import overlap_pairs
from auditloom.operators.small import attach, join_keys, solid_keys
from auditloom.sources.tables import require_columns


def minmax(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Scale a score to 0..1 per group; bad values count as 0, a constant column gives 0."""
    by = by or []
    df = solid_keys(df, by)
    value = X.number_or(F.col(column))
    bounds = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span > 0, (value - F.col("_low")) / F.when(span > 0, span)).otherwise(F.lit(0.0))
    return attach(df, bounds, by).withColumn(out, scaled).drop("_low", "_high")


def window_scores(df: DataFrame, threshold: float = S.IFOREST_THRESHOLD) -> DataFrame:
    """Scored windows ready to join: numeric bounds and scores, and the threshold flag."""
    require_columns(df, ["window_id", "window_start_us", "window_end_us", "iforest_anomaly_score",
                         "iforest_is_anomaly"], "scored windows")
    score = F.col("iforest_anomaly_score").try_cast("double")
    flag = F.coalesce(F.col("iforest_is_anomaly").try_cast("int"), F.lit(0))
    return df.withColumns({
        "window_start_us": F.col("window_start_us").try_cast("bigint"),
        "window_end_us": F.col("window_end_us").try_cast("bigint"),
        "iforest_anomaly_score": F.when(~F.isnan(score), score),
        "iforest_is_anomaly": flag,
        "iforest_threshold": F.lit(float(threshold)),
    }).dropna(subset=["window_start_us", "window_end_us", "iforest_anomaly_score"]).withColumn(
        "iforest_threshold_alert", (F.col("iforest_anomaly_score") >= threshold).cast("int"))


def overlap_scores(sequences: DataFrame, windows: DataFrame, norm: str = "window",
                   threshold: float = S.IFOREST_THRESHOLD, by: list[str] | None = None,
                   norm_by: list[str] | None = None, key: str = "sequence_id",
                   lists: bool = True) -> DataFrame:
    """Sequences with the summary of all windows they overlap, closed at both ends.

    ``norm="window"`` scales window scores before taking the maximum;
    ``norm="sequence"`` scales the maximum per sequence. Scaling spans all rows
    unless ``norm_by`` groups it. The id and label lists are as long as the
    overlap, so ``lists=False`` drops them.
    """
    by = ["source"] if by is None else by
    windows = window_scores(windows, threshold)
    if norm == "window":
        windows = minmax(windows, "iforest_anomaly_score", "_norm", norm_by)
    else:
        windows = windows.withColumn("_norm", F.lit(0.0))
    label = F.col("window_label") if "window_label" in windows.columns else F.lit("")
    right = windows.select(
        *by, F.col("window_start_us").alias("_ws"), F.col("window_end_us").alias("_we"),
        F.col("window_id").alias("_id"), F.col("iforest_anomaly_score").alias("_score"), "_norm",
        F.col("iforest_threshold_alert").alias("_alert"), F.col("iforest_is_anomaly").alias("_native"),
        label.cast("string").alias("_label"))
    keys = list(dict.fromkeys([*by, key]))
    sequences = solid_keys(sequences, keys)
    left = sequences.select(*keys, "start_us", "end_us")
    pairs = overlap_pairs(left, right, by, ("start_us", "end_us"), ("_ws", "_we"))
    found = [
        F.count(F.lit(1)).alias("iforest_overlap_count"),
        F.max("_score").alias("iforest_max_anomaly_score"),
        F.avg("_score").alias("iforest_mean_anomaly_score"),
        F.max("_norm").alias("iforest_max_anomaly_score_norm"),
        F.max("_alert").alias("iforest_any_anomaly"),
        F.max("_native").alias("iforest_model_any_anomaly"),
    ]
    if lists:
        found += [F.array_sort(F.collect_list("_id")).alias("iforest_window_ids"),
                  F.array_sort(F.collect_set("_label")).alias("iforest_overlapping_labels")]
    joined = join_keys(sequences, pairs.groupBy(*keys).agg(*found), keys)
    zeros = {
        "iforest_overlap_count": F.lit(0).cast("bigint"), "iforest_max_anomaly_score": F.lit(0.0),
        "iforest_mean_anomaly_score": F.lit(0.0), "iforest_max_anomaly_score_norm": F.lit(0.0),
        "iforest_any_anomaly": F.lit(0), "iforest_model_any_anomaly": F.lit(0),
    }
    if lists:
        id_type = windows.schema["window_id"].dataType.simpleString()
        zeros["iforest_window_ids"] = F.array().cast(f"array<{id_type}>")
        zeros["iforest_overlapping_labels"] = F.array().cast("array<string>")
    joined = joined.withColumns({c: F.coalesce(c, zero) for c, zero in zeros.items()})
    joined = joined.withColumn("iforest_threshold", F.lit(float(threshold)))
    if norm == "sequence":
        joined = joined.drop("iforest_max_anomaly_score_norm")
        joined = minmax(joined, "iforest_max_anomaly_score", "iforest_anomaly_score_norm", norm_by)
    return joined


def _in_unit(value: float, name: str) -> None:
    if not 0.0 <= value <= 1.0:
        raise ValueError(f"{name} must be between 0 and 1")


def weighted(norm: str, weight: float) -> Column:
    return F.lit(weight) * F.col("lstm_malicious_probability") + F.lit(1.0 - weight) * F.col(norm)


def combine(df: DataFrame, weight: float = S.SEQUENCE_WEIGHT, threshold: float = S.COMBINED_THRESHOLD,
            norm: str = "iforest_max_anomaly_score_norm") -> DataFrame:
    """Weighted score, its reason and the alert flag."""
    _in_unit(weight, "weight")
    _in_unit(threshold, "combined threshold")
    by_sequence, by_window = F.col("lstm_prediction") == 1, F.col("iforest_any_anomaly") == 1
    reason = (
        F.when(by_sequence & by_window, "lstm_and_iforest").when(by_sequence, "lstm_only")
        .when(by_window, "iforest_only").otherwise("low_score"))
    return df.withColumn("combined_score", weighted(norm, weight)).withColumns({
        "combined_reason": reason,
        "combined_alert": (F.col("combined_score") >= threshold).cast("int"),
        "combined_threshold": F.lit(float(threshold)),
    })


def decisions(df: DataFrame, sequence_threshold: float = S.SEQUENCE_THRESHOLD,
              combined_threshold: float = S.COMBINED_THRESHOLD, weight: float = S.SEQUENCE_WEIGHT,
              norm: str = "iforest_anomaly_score_norm") -> DataFrame:
    """Decision columns of the five detectors: sequence, window, either, both, weighted."""
    for value, name in ((sequence_threshold, "sequence threshold"), (weight, "weight"),
                        (combined_threshold, "combined threshold")):
        _in_unit(value, name)
    by_sequence = F.col("lstm_malicious_probability") >= sequence_threshold
    by_window = F.col("iforest_any_anomaly") == 1
    return df.withColumn("combined_score", weighted(norm, weight)).withColumns({
        "lstm_alert": by_sequence.cast("int"),
        "iforest_alert": by_window.cast("int"),
        "or_alert": (by_sequence | by_window).cast("int"),
        "and_alert": (by_sequence & by_window).cast("int"),
        "combined_alert": (F.col("combined_score") >= combined_threshold).cast("int"),
    })


def rank_alerts(df: DataFrame, n: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """Sequences by combined score, probability and window score, best first."""
    ranked = df.orderBy(
        F.desc("combined_score"), F.desc("lstm_malicious_probability"),
        F.desc("iforest_max_anomaly_score"), *(tie or ["sequence_id"]))
    return ranked if n is None else ranked.limit(n)
