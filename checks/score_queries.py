"""Fusion, alert and evidence queries (groups G and H) on stand-in scores that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import alerts as H
from auditloom.operators import fusion as G
from auditloom.operators import sequences as Q
from auditloom.operators import windows as W
from auditloom.session import materialise
from checks.audit_view import HOUR, audit_events
from checks.sequence_queries import INFERENCE_PARTS, LENGTH, STRIDE
from checks.window_queries import LABEL_SQL, WINDOWED_SQL, windowed

THRESHOLD, WEIGHT, COMBINED, SEQUENCE, GAP, TOP = 0.5, 0.7, 0.75, 0.8, HOUR // 2, 3


def score_windows(spark, sf_dir):
    """Windows scored by their largest value."""
    events = windowed(spark, sf_dir)
    labels = W.window_features(events).select("source", "window_id", "window_start_us", "window_end_us", "window_label")
    best = events.groupBy("source", "window_id").agg(
        (F.max("value") / 500).alias("iforest_anomaly_score"), (F.avg("value") > 55).cast("int").alias("iforest_is_anomaly"))
    return labels.join(best, ["source", "window_id"])


def score_sequences(spark, sf_dir):
    """Sequences with a probability computed from the number of their first event."""
    ordered = Q.order_events(Q.prepare_sequence_events(audit_events(spark, sf_dir)), ["source"])
    found = Q.sliding_sequences(ordered, LENGTH, STRIDE, None).withColumnRenamed("k", "sequence_id")
    probability = (F.col("start_event_id").cast("bigint") * 37 % 101) / 101
    return found.withColumn("lstm_malicious_probability", probability).withColumn(
        "lstm_prediction", (probability >= SEQUENCE).cast("int"))


def overlapped(spark, sf_dir, norm="window"):
    sequences = materialise(score_sequences(spark, sf_dir), "sequences")
    return G.overlap_scores(sequences, materialise(score_windows(spark, sf_dir), "windows"), norm, THRESHOLD)


def combined(spark, sf_dir):
    return materialise(G.combine(overlapped(spark, sf_dir), WEIGHT, COMBINED), "combined")


SCORES_SQL = f"""{WINDOWED_SQL},
{INFERENCE_PARTS},
wins AS (
  SELECT source, window_id, window_start_us AS ws, window_start_us + {6 * HOUR} AS we, max(value) / 500 AS score,
    (avg(value) > 55)::INT AS native, (max(value) / 500 >= {THRESHOLD})::INT AS alert, {LABEL_SQL}
  FROM windowed GROUP BY source, window_id, window_start_us
),
normed AS (SELECT *, (score - (SELECT min(score) FROM wins)) / ((SELECT max(score) FROM wins) - (SELECT min(score) FROM wins)) AS norm FROM wins),
probs AS (SELECT *, CAST(start_event_id AS BIGINT) * 37 % 101 / 101.0::DOUBLE AS p FROM seqs),
met AS (
  SELECT s.source, s.sequence_id, count(w.ws) AS n, coalesce(max(score), 0) AS mx, coalesce(avg(score), 0) AS mean,
    coalesce(max(norm), 0) AS nrm, coalesce(max(alert), 0) AS any_alert, coalesce(max(native), 0) AS any_native,
    coalesce(string_agg(CAST(window_id AS VARCHAR), '|' ORDER BY window_id), '') AS ids,
    coalesce(array_to_string(list_sort(list(DISTINCT window_label)), '|'), '') AS labels
  FROM seqs s LEFT JOIN normed w ON w.source = s.source AND w.ws <= s.end_us AND w.we >= s.start_us GROUP BY ALL
),
fused AS (
  SELECT *, {WEIGHT} * p + (1 - {WEIGHT}) * nrm AS score,
    CASE WHEN p >= {SEQUENCE} AND any_alert = 1 THEN 'lstm_and_iforest' WHEN p >= {SEQUENCE} THEN 'lstm_only'
      WHEN any_alert = 1 THEN 'iforest_only' ELSE 'low_score' END AS reason
  FROM probs JOIN met USING (source, sequence_id)
),
flagged AS (SELECT *, max(end_us) OVER (PARTITION BY source ORDER BY start_us, end_us, sequence_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fused WHERE score >= {COMBINED}),
members AS (SELECT *, CAST(sum(coalesce((start_us > reach + {GAP})::INT, 0)) OVER (PARTITION BY source
    ORDER BY start_us, end_us, sequence_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS alert_id FROM flagged),
alerts AS (
  SELECT source, alert_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS sequence_count,
    arg_min(start_event_id, (start_us, end_us, sequence_id)) AS start_event_id,
    arg_max(end_event_id, (start_us, end_us, sequence_id)) AS end_event_id,
    max(p) AS max_p, avg(p) AS mean_p, max(mx) AS max_if, max(score) AS max_c, avg(score) AS mean_c,
    array_to_string(list_sort(list(DISTINCT reason)), '|') AS reasons,
    string_agg(CAST(sequence_id AS VARCHAR), '|' ORDER BY start_us, end_us, sequence_id) AS ids
  FROM members GROUP BY source, alert_id
),
inside AS (SELECT e.*, a.alert_id FROM audit_paths e JOIN alerts a ON a.source = e.source AND e.ts_us BETWEEN a.start_us AND a.end_us)"""


def minmax_query(spark, sf_dir):
    found = G.minmax(score_windows(spark, sf_dir), "iforest_anomaly_score", "norm")
    return found.select("source", "window_id", F.round("norm", 6).alias("norm"))


def overlap_query(spark, sf_dir):
    return overlapped(spark, sf_dir).select(
        "source", "sequence_id", F.col("iforest_overlap_count").alias("n"),
        F.round("iforest_max_anomaly_score", 6).alias("mx"), F.round("iforest_mean_anomaly_score", 6).alias("mean"),
        F.round("iforest_max_anomaly_score_norm", 6).alias("norm"), F.col("iforest_any_anomaly").alias("any_alert"),
        F.col("iforest_model_any_anomaly").alias("any_native"),
        F.array_join(F.col("iforest_window_ids").cast("array<string>"), "|").alias("ids"))


def overlap_eval_query(spark, sf_dir):
    found = overlapped(spark, sf_dir, "sequence")
    return found.select("source", "sequence_id", F.round("iforest_anomaly_score_norm", 6).alias("norm"),
                        F.array_join("iforest_overlapping_labels", "|").alias("labels"))


def combined_query(spark, sf_dir):
    return combined(spark, sf_dir).select(
        "source", "sequence_id", F.round("combined_score", 6).alias("score"), "combined_reason", "combined_alert")


def decisions_query(spark, sf_dir):
    found = G.decisions(overlapped(spark, sf_dir, "sequence"), SEQUENCE, COMBINED, WEIGHT)
    return found.select("source", "sequence_id", "lstm_alert", "iforest_alert", "or_alert", "and_alert", "combined_alert")


def ranked_query(spark, sf_dir):
    return G.rank_alerts(combined(spark, sf_dir), 25, ["source", "sequence_id"]).select(
        "source", "sequence_id", F.round("combined_score", 6).alias("score"))


def members(spark, sf_dir, scored=None):
    return H.alert_sessions(combined(spark, sf_dir) if scored is None else scored, GAP)


def sessions_query(spark, sf_dir):
    return H.alert_members(members(spark, sf_dir))


def alerts_query(spark, sf_dir):
    found = H.summarise_alerts(members(spark, sf_dir))
    return found.select(
        "source", "alert_id", "start_us", "end_us", "start_event_id", "end_event_id", "sequence_count",
        *[F.round(c, 6).alias(c) for c in ("max_lstm_probability", "mean_lstm_probability", "max_iforest_anomaly_score",
                                           "max_combined_score", "mean_combined_score", "duration_seconds")],
        F.array_join("combined_reason_summary", "|").alias("reasons"),
        F.array_join(F.col("sequence_ids").cast("array<string>"), "|").alias("sequence_ids"))


def windows_query(spark, sf_dir):
    return H.alert_windows(members(spark, sf_dir))


def inside(spark, sf_dir):
    alerts = H.summarise_alerts(members(spark, sf_dir), lists=False)
    return H.alert_events(audit_events(spark, sf_dir), alerts)


def inside_query(spark, sf_dir):
    return inside(spark, sf_dir).select("event_id", "alert_id")


def values_query(spark, sf_dir):
    fields = {"command": "command", "key": "key", "exe": "exe", "comm": "comm", "syscall": "syscall"}
    return H.top_values(inside(spark, sf_dir), TOP, ["event_no"], fields=fields)


def paths_query(spark, sf_dir):
    return H.top_paths(inside(spark, sf_dir), TOP, ["event_no"]).drop("field")


VALUES_SQL = f"""SELECT source, alert_id, field, value, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, alert_id, field ORDER BY n DESC, seen) AS rank FROM (
    SELECT source, alert_id, field, value, count(*) AS n, min(event_no) AS seen FROM (
      SELECT source, alert_id, event_no, unnest(['command','key','exe','comm','syscall']) AS field,
        unnest([command, key, exe, comm, syscall]) AS value FROM inside) WHERE value <> '' GROUP BY ALL)) WHERE rank <= {TOP}"""
PATHS_SQL = f"""SELECT source, alert_id, value, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, alert_id ORDER BY n DESC, seen) AS rank FROM (
    SELECT source, alert_id, value, count(*) AS n, min((c, event_no, i)) AS seen FROM (
      SELECT source, alert_id, event_no, 0 AS c, 0 AS i, path AS value FROM inside
      UNION ALL SELECT source, alert_id, event_no, 1, 0, path FROM inside
      UNION ALL SELECT source, alert_id, event_no, 1, 1, '/lib64/ld.so' FROM inside WHERE event_no % 3 = 0) GROUP BY ALL)) WHERE rank <= {TOP}"""

QUERIES = {
    "score_normalisation": minmax_query,
    "overlap_scores": overlap_query,
    "overlap_scores_for_evaluation": overlap_eval_query,
    "combined_scores": combined_query,
    "detector_decisions": decisions_query,
    "ranked_alerts": ranked_query,
    "alert_members": sessions_query,
    "alert_intervals": alerts_query,
    "alert_windows": windows_query,
    "alert_events": inside_query,
    "alert_top_values": values_query,
    "alert_top_paths": paths_query,
}

ORACLES = {
    "score_normalisation": f"WITH {SCORES_SQL} SELECT source, window_id, round(norm, 6) AS norm FROM normed",
    "overlap_scores": f"""WITH {SCORES_SQL} SELECT source, sequence_id, n, round(mx, 6) AS mx, round(mean, 6) AS mean,
        round(nrm, 6) AS norm, any_alert, any_native, ids FROM met""",
    "overlap_scores_for_evaluation": f"""WITH {SCORES_SQL} SELECT source, sequence_id, labels,
        round((mx - (SELECT min(mx) FROM met)) / ((SELECT max(mx) FROM met) - (SELECT min(mx) FROM met)), 6) AS norm FROM met""",
    "combined_scores": f"""WITH {SCORES_SQL} SELECT source, sequence_id, round(score, 6) AS score, reason AS combined_reason,
        (score >= {COMBINED})::INT AS combined_alert FROM fused""",
    "detector_decisions": f"""WITH {SCORES_SQL}, d AS (SELECT source, sequence_id, (p >= {SEQUENCE})::INT AS l, any_alert AS i,
        {WEIGHT} * p + (1 - {WEIGHT}) * (mx - (SELECT min(mx) FROM met)) / ((SELECT max(mx) FROM met) - (SELECT min(mx) FROM met)) AS c FROM fused)
        SELECT source, sequence_id, l AS lstm_alert, i AS iforest_alert, greatest(l, i) AS or_alert, l * i AS and_alert,
        (c >= {COMBINED})::INT AS combined_alert FROM d""",
    "ranked_alerts": f"""WITH {SCORES_SQL} SELECT source, sequence_id, round(score, 6) AS score FROM fused
        ORDER BY fused.score DESC, p DESC, mx DESC, source, sequence_id LIMIT 25""",
    "alert_members": f"WITH {SCORES_SQL} SELECT source, alert_id, sequence_id FROM members",
    "alert_intervals": f"""WITH {SCORES_SQL} SELECT source, alert_id, start_us, end_us, start_event_id, end_event_id, sequence_count,
        round(max_p, 6) AS max_lstm_probability, round(mean_p, 6) AS mean_lstm_probability, round(max_if, 6) AS max_iforest_anomaly_score,
        round(max_c, 6) AS max_combined_score, round(mean_c, 6) AS mean_combined_score,
        round((end_us - start_us) / 1000000.0, 6)::DOUBLE AS duration_seconds, reasons, ids AS sequence_ids FROM alerts""",
    "alert_windows": f"""WITH {SCORES_SQL} SELECT DISTINCT m.source, m.alert_id, w.window_id FROM members m JOIN wins w
        ON w.source = m.source AND w.ws <= m.end_us AND w.we >= m.start_us""",
    "alert_events": f"WITH {SCORES_SQL} SELECT event_id, alert_id FROM inside",
    "alert_top_values": f"WITH {SCORES_SQL} {VALUES_SQL}",
    "alert_top_paths": f"WITH {SCORES_SQL} {PATHS_SQL}",
}
