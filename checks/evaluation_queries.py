"""Evaluation and calibration queries (group I, F6, F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import evaluation as E
from auditloom.operators import fusion as G
from auditloom.operators import sketches as K
from auditloom.operators.iforest import anomaly_rate
from auditloom.session import materialise
from checks.audit_view import audit_events
from checks.score_queries import COMBINED, SCORES_SQL, SEQUENCE, THRESHOLD, WEIGHT, overlapped, score_sequences, score_windows

RATES = [0.01, 0.05, 0.2]


def scored(spark, sf_dir):
    """Events as scored rows: is a purchase told by its value?"""
    return audit_events(spark, sf_dir).select(
        "event_no", F.col("value").alias("score"), (F.col("syscall") == "connect").cast("int").alias("y_true"),
        (F.col("value") >= 60).cast("int").alias("predicted"), "manual_label", "source")


def documents(spark, sf_dir):
    """Labelled documents: is quality told by length?"""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("y_true"))
    return docs.join(labels, "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), "y_true")


SCORED_SQL = "scored AS (SELECT event_id AS event_no, value AS score, (event_type = 'purchase')::INT AS y, 'host' || (user_id % 3) AS source FROM events)"
DOCUMENTS_SQL = "scored AS (SELECT doc_id, n_chars::DOUBLE AS score, quality AS y FROM documents JOIN labels USING (doc_id))"
PRECISION, RECALL = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tp / nullif(tp + fn, 0), 0)"
RATES_SQL = f"""round({PRECISION}, 6)::DOUBLE AS precision, round({RECALL}, 6)::DOUBLE AS recall,
  round(coalesce(2 * {PRECISION} * {RECALL} / nullif({PRECISION} + {RECALL}, 0), 0), 6)::DOUBLE AS f1,
  round(coalesce(fp / nullif(fp + tn, 0), 0), 6)::DOUBLE AS fpr,
  round(coalesce(tn / nullif(tn + fp, 0), 0), 6)::DOUBLE AS tnr, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6)::DOUBLE AS accuracy"""
COUNTS_SQL = """count(*) FILTER (y = 1 AND q = 1) AS tp, count(*) FILTER (y = 0 AND q = 0) AS tn,
  count(*) FILTER (y = 0 AND q = 1) AS fp, count(*) FILTER (y = 1 AND q = 0) AS fn"""
SWEEP_SQL = f""", steps AS (SELECT score AS threshold, sum(y) AS p, sum(1 - y) AS n FROM scored GROUP BY score),
sums AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
  CAST((SELECT sum(y) FROM scored) AS BIGINT) AS allp, CAST((SELECT sum(1 - y) FROM scored) AS BIGINT) AS alln
  FROM steps WINDOW w AS (ORDER BY threshold DESC)),
full_sums AS (SELECT *, allp - tp AS fn, alln - fp AS tn FROM sums),
swept AS (SELECT tp, tn, fp, fn, {RATES_SQL}, threshold, tp + fp AS predicted_positive FROM full_sums)"""


def rounded(df):
    names = [c for c in ("precision", "recall", "f1", "fpr", "tnr", "accuracy", "eval_fpr", "actual_fpr", "threshold", "roc_auc")
             if c in df.columns]
    return df.withColumns({c: F.round(c, 6) for c in names})


def confusion(spark, sf_dir):
    return rounded(E.confusion_metrics(scored(spark, sf_dir), "predicted", by=["source"]))


def sweep(rows):
    return lambda spark, sf_dir: rounded(E.threshold_sweep(rows(spark, sf_dir), "score"))


def best(spark, sf_dir):
    return rounded(E.best_threshold(E.threshold_sweep(scored(spark, sf_dir), "score")))


def binary(spark, sf_dir):
    return rounded(E.binary_metrics(scored(spark, sf_dir), "score", threshold=60.0))


def windows_frame(spark, sf_dir):
    return E.window_eval_frame(score_windows(spark, sf_dir)).select("source", "window_id", "window_label", "y_true", "y_pred_default")


def sequences_frame(spark, sf_dir):
    rows = _labelled_sequences(spark, sf_dir)
    return E.sequence_eval_frame(rows, bounds=True).select("source", "sequence_id", "sequence_label", "y_true")


def _labelled_sequences(spark, sf_dir):
    kind = F.col("start_event_id").cast("bigint") % 3
    return score_sequences(spark, sf_dir).withColumns({
        "sequence_label": F.when(kind == 0, " Malicious ").when(kind == 1, "benign").otherwise("other"),
        "y": F.when(kind == 0, "1").when(kind == 1, "0").otherwise("x"),
    })


def score_frame(spark, sf_dir):
    return E.window_score_frame(score_windows(spark, sf_dir), THRESHOLD).select(
        "source", "window_id", "iforest_threshold_alert", "iforest_threshold")


def rates_by_label(spark, sf_dir):
    return anomaly_rate(score_windows(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def evaluated(spark, sf_dir):
    return E.evaluate_at(E.sequence_eval_frame(_labelled_sequences(spark, sf_dir), bounds=True), SEQUENCE)


def results(spark, sf_dir):
    return evaluated(spark, sf_dir).select("source", "sequence_id", "eval_prediction_label", "eval_result", "error_type")


def error_rows(spark, sf_dir):
    return E.errors(evaluated(spark, sf_dir), 20, tie=["source", "sequence_id"]).select(
        "source", "sequence_id", "error_type", F.round("error_confidence", 6).alias("confidence"))


def detectors(spark, sf_dir):
    fused = G.decisions(overlapped(spark, sf_dir, "sequence"), SEQUENCE, COMBINED, WEIGHT)
    truth = (F.col("start_event_id").cast("bigint") % 3 == 0).cast("int")
    return rounded(E.compare_detectors(fused.withColumn("y_true", truth)))


def benign(spark, sf_dir):
    return scored(spark, sf_dir).where("y_true = 0").withColumnRenamed("score", "iforest_anomaly_score")


def calibration(spark, sf_dir):
    return rounded(E.calibrate(benign(spark, sf_dir), RATES))


def calibrated_eval(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumnRenamed("score", "iforest_anomaly_score")
    return rounded(E.evaluate_thresholds(E.calibrate(benign(spark, sf_dir), RATES), rows))


def sketched(spark, sf_dir):
    """Thresholds per host from sketches: what each flags lies within its stated bounds, and merged parts give the same sketch."""
    rows = scored(spark, sf_dir).where("y_true = 0").select("source", "event_no", F.col("score").alias("iforest_anomaly_score"))
    sketch = materialise(K.score_sketch(rows), "sketch")
    parts = [K.score_sketch(rows.where(F.col("event_no") % 3 == i).repartition(2 + i)) for i in range(3)]
    merged = K.merge_sketches(*parts).select("source", F.struct("cell", "n", "low", "high").alias("entry"), F.lit(-1).alias("side"))
    both = merged.unionByName(sketch.select("source", F.struct("cell", "n", "low", "high").alias("entry"), F.lit(1).alias("side")))
    same = both.groupBy("source", "entry").agg(F.sum("side").alias("side")).groupBy(F.col("source").alias("_s")).agg((F.max(F.abs("side")) == 0).cast("int").alias("merged_equal"))
    found = K.sketched_thresholds(sketch, RATES).withColumnRenamed("source", "_source")
    above = rows.join(F.broadcast(found), (F.col("source") == F.col("_source")) & (F.col("iforest_anomaly_score") >= F.col("threshold")))
    flagged = above.groupBy("source", "target_fpr", "rows", "flagged_least", "flagged_most", "rank_error").agg(F.count(F.lit(1)).alias("flagged"))
    share = F.abs(F.col("flagged") / F.col("rows") - F.col("target_fpr"))
    return flagged.join(same, F.col("source") == F.col("_s")).select(
        "source", "target_fpr", F.col("rows").alias("n_rows"), F.col("flagged").between(F.col("flagged_least"), F.col("flagged_most")).cast("int").alias("in_bounds"),
        (share <= F.col("rank_error") + 1e-12).cast("int").alias("in_rank_error"), (F.col("rank_error") <= 0.05).cast("int").alias("small_error"), "merged_equal")


def ranked(spark, sf_dir):
    return E.rank_by_score(score_windows(spark, sf_dir), "iforest_anomaly_score", 30, ["source", "window_id"]).select(
        "source", "window_id", F.round("iforest_anomaly_score", 6).alias("score"))


CALIBRATION_SQL = f"""{SCORED_SQL}, rates AS (SELECT unnest({RATES})::DOUBLE AS target_fpr),
cuts AS (SELECT target_fpr, (SELECT list(score ORDER BY score) FROM scored WHERE y = 0) AS v FROM rates),
spots AS (SELECT target_fpr, v, (len(v) - 1) * (1.0::DOUBLE - target_fpr) AS h FROM cuts),
thresholds AS (SELECT target_fpr, v[floor(h)::INT + 1] + (v[least(floor(h)::INT + 2, len(v))] - v[floor(h)::INT + 1]) * (h - floor(h)) AS threshold FROM spots),
calibrated AS (SELECT target_fpr, threshold, count(*) AS benign_windows, count(*) FILTER (score >= threshold) AS benign_flagged
  FROM thresholds JOIN scored ON y = 0 GROUP BY ALL)"""

EVALUATED_SQL = f"""{SCORES_SQL}, judged AS (SELECT source, sequence_id, p, CAST(start_event_id AS BIGINT) % 3 AS kind,
  CASE WHEN CAST(start_event_id AS BIGINT) % 3 = 0 THEN CASE WHEN p >= {SEQUENCE} THEN 'tp' ELSE 'fn' END
       ELSE CASE WHEN p >= {SEQUENCE} THEN 'fp' ELSE 'tn' END END AS result FROM probs WHERE CAST(start_event_id AS BIGINT) % 3 < 2)"""

QUERIES = {
    "window_evaluation_frame": windows_frame,
    "sequence_evaluation_frame": sequences_frame,
    "window_score_frame": score_frame,
    "confusion_metrics": confusion,
    "threshold_sweep": sweep(scored),
    "document_threshold_sweep": sweep(documents),
    "best_threshold": best,
    "sketched_thresholds": sketched,
    "binary_metrics": binary,
    "anomaly_rate_by_label": rates_by_label,
    "evaluation_results": results,
    "confident_errors": error_rows,
    "detector_comparison": detectors,
    "calibrated_thresholds": calibration,
    "calibrated_evaluation": calibrated_eval,
    "ranked_windows": ranked,
}

ORACLES = {
    "sketched_thresholds": f"""WITH {SCORED_SQL} SELECT source, unnest({RATES})::DOUBLE AS target_fpr, count(*) AS n_rows, 1 AS in_bounds,
        1 AS in_rank_error, 1 AS small_error, 1 AS merged_equal FROM scored WHERE y = 0 GROUP BY source""",
    "window_evaluation_frame": f"""WITH {SCORES_SQL} SELECT source, window_id, window_label, (window_label = 'malicious')::INT AS y_true,
        native AS y_pred_default FROM wins WHERE window_label <> 'ambiguous'""",
    "sequence_evaluation_frame": f"""WITH {EVALUATED_SQL} SELECT source, sequence_id,
        CASE kind WHEN 0 THEN 'malicious' ELSE 'benign' END AS sequence_label, (kind = 0)::INT AS y_true FROM judged""",
    "window_score_frame": f"""WITH {SCORES_SQL} SELECT source, window_id, alert AS iforest_threshold_alert,
        {THRESHOLD}::DOUBLE AS iforest_threshold FROM wins""",
    "confusion_metrics": f"""WITH {SCORED_SQL}, counts AS (SELECT source, {COUNTS_SQL} FROM (SELECT *, (score >= 60)::INT AS q FROM scored) GROUP BY source)
        SELECT *, {RATES_SQL} FROM counts""",
    "threshold_sweep": f"WITH {SCORED_SQL} {SWEEP_SQL} SELECT * FROM swept",
    "document_threshold_sweep": f"WITH {DOCUMENTS_SQL} {SWEEP_SQL} SELECT * FROM swept",
    "best_threshold": f"WITH {SCORED_SQL} {SWEEP_SQL} SELECT * FROM swept ORDER BY f1 DESC, recall DESC, precision DESC, threshold DESC LIMIT 1",
    "binary_metrics": f"""WITH {SCORED_SQL}, counts AS (SELECT {COUNTS_SQL} FROM (SELECT *, (score >= 60)::INT AS q FROM scored)),
        ranked AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM scored),
        auc AS (SELECT (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS a FROM ranked)
        SELECT accuracy, precision, recall, f1, round(a, 6) AS roc_auc FROM (SELECT *, {RATES_SQL} FROM counts), auc""",
    "anomaly_rate_by_label": f"""WITH {SCORES_SQL} SELECT window_label, count(*) AS windows, CAST(sum(native) AS BIGINT) AS anomalies,
        round(avg(native), 6) AS rate FROM wins GROUP BY window_label""",
    "evaluation_results": f"""WITH {EVALUATED_SQL} SELECT source, sequence_id, CASE WHEN p >= {SEQUENCE} THEN 'malicious' ELSE 'benign' END AS eval_prediction_label,
        result AS eval_result, CASE WHEN result IN ('fp', 'fn') THEN result ELSE '' END AS error_type FROM judged""",
    "confident_errors": f"""WITH {EVALUATED_SQL} SELECT source, sequence_id, result AS error_type,
        round(CASE result WHEN 'fp' THEN p ELSE 1 - p END, 6) AS confidence FROM judged WHERE result IN ('fp', 'fn')
        ORDER BY CASE result WHEN 'fp' THEN p ELSE 1 - p END DESC, source, sequence_id LIMIT 20""",
    "detector_comparison": f"""WITH {SCORES_SQL}, d AS (SELECT (CAST(start_event_id AS BIGINT) % 3 = 0)::INT AS y, (p >= {SEQUENCE})::INT AS l, any_alert AS i,
        ({WEIGHT} * p + (1 - {WEIGHT}) * (mx - (SELECT min(mx) FROM met)) / ((SELECT max(mx) FROM met) - (SELECT min(mx) FROM met)) >= {COMBINED})::INT AS c FROM fused),
        long AS (SELECT y, unnest(['LSTM only', 'Isolation Forest only', 'IF OR LSTM', 'IF AND LSTM', 'Weighted combined']) AS detector,
          unnest([l, i, greatest(l, i), l * i, c]) AS q FROM d),
        counts AS (SELECT detector, {COUNTS_SQL} FROM long GROUP BY detector) SELECT *, {RATES_SQL} FROM counts""",
    "calibrated_thresholds": f"""WITH {CALIBRATION_SQL} SELECT target_fpr, round(threshold, 6) AS threshold, benign_windows, benign_flagged,
        round(benign_flagged / benign_windows, 6)::DOUBLE AS actual_fpr FROM calibrated""",
    "calibrated_evaluation": f"""WITH {CALIBRATION_SQL}, counts AS (SELECT target_fpr, threshold, c.benign_windows, c.benign_flagged, count(*) AS eval_windows, {COUNTS_SQL}
        FROM (SELECT c.*, s.y, (s.score >= c.threshold)::INT AS q FROM calibrated c CROSS JOIN scored s) c GROUP BY ALL)
        SELECT target_fpr, round(threshold, 6) AS threshold, benign_windows, benign_flagged, round(benign_flagged / benign_windows, 6)::DOUBLE AS actual_fpr,
          eval_windows, tp, fp, tn, fn, precision, recall, f1, fpr AS eval_fpr, tp + fp AS eval_predicted_positive
        FROM (SELECT * EXCLUDE (accuracy, tnr) FROM (SELECT *, {RATES_SQL} FROM counts))""",
    "ranked_windows": f"WITH {SCORES_SQL} SELECT source, window_id, round(score, 6) AS score FROM wins ORDER BY wins.score DESC, source, window_id LIMIT 30",
}
