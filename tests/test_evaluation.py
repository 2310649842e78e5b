import pytest

from auditloom.operators import evaluation as E

SMALL = {"max_group_rows": 1, "chunk_rows": 1}
ROWS = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)]


def scored(spark, rows=ROWS):
    return spark.createDataFrame(rows, "s double, y_true int")


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_sweep(spark, limits):
    sweep = E.threshold_sweep(scored(spark), "s", **limits)
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"], round(r["f1"], 6)) for r in sweep.collect()}
    assert got == {0.9: (1, 0, 2, 1, 0.666667), 0.8: (2, 1, 1, 0, 0.8), 0.3: (2, 2, 0, 0, 0.666667)}
    assert E.best_threshold(sweep).first()["threshold"] == 0.8
    assert E.binary_metrics(scored(spark), "s", threshold=0.8, **limits).first()["roc_auc"] == 0.875


def test_one_class_has_no_auc(spark):
    row = E.binary_metrics(scored(spark, [(0.9, 0), (0.1, 0)]), "s").first()
    assert (row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (0.0, 0.0, 0.0, None)


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_calibration(spark, limits):
    benign = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "iforest_anomaly_score double")
    found = E.calibrate(benign, [0.1], **limits)
    row = found.first()
    assert (round(row["threshold"], 9), row["benign_flagged"], row["benign_windows"], row["actual_fpr"]) == (8.2, 1, 4, 0.25)
    labelled = spark.createDataFrame([(9.0, 1), (8.0, 1), (9.5, 0)], "iforest_anomaly_score double, y_true int")
    at = E.evaluate_thresholds(found, labelled).first()
    assert (at["tp"], at["fp"], at["tn"], at["fn"], at["eval_windows"], at["eval_predicted_positive"]) == (1, 1, 0, 1, 3, 2)
    with pytest.raises(ValueError, match="rates"):
        E.calibrate(benign, [0.0])


@pytest.mark.parametrize("limits", [{}, {"max_group_rows": 10, "chunk_rows": 9}])
def test_sweep_equals_brute_force(spark, limits):
    import random

    random.seed(11)
    rows = [(random.randint(0, 40) / 40, random.randint(0, 1)) for _ in range(300)]
    swept = {r["threshold"]: r for r in E.threshold_sweep(scored(spark, rows), "s", **limits).collect()}
    assert set(swept) == {s for s, _ in rows}
    for t, r in swept.items():
        tp = sum(y for s, y in rows if s >= t)
        fp = sum(1 - y for s, y in rows if s >= t)
        fn, tn = sum(y for s, y in rows if s < t), sum(1 - y for s, y in rows if s < t)
        assert (r["tp"], r["fp"], r["fn"], r["tn"], r["predicted_positive"]) == (tp, fp, fn, tn, tp + fp)
        assert r["precision"] == pytest.approx(tp / (tp + fp)) and r["accuracy"] == pytest.approx((tp + tn) / 300)
    won = sum((a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z)
    pairs = sum(y for _, y in rows) * sum(1 - y for _, y in rows)
    assert E.binary_metrics(scored(spark, rows), "s", **limits).first()["roc_auc"] == pytest.approx(won / pairs)


def test_frames_errors_and_detectors(spark):
    windows = spark.createDataFrame([("malicious", "0.5", "1"), ("ambiguous", "0.4", "0"), (None, "0.1", "x"), ("odd", "1", "1"),
                                     ("benign", "bad", "0")], "window_label string, iforest_anomaly_score string, iforest_is_anomaly string")
    got = sorted((r["window_label"], r["y_true"], r["y_pred_default"]) for r in E.window_eval_frame(windows).collect())
    assert got == [("malicious", 1, 1), ("unlabeled", 0, 0)]
    seqs = spark.createDataFrame([(1, " Malicious", "1", "0.2"), (2, "benign", "0", "0.9"), (3, "other", "1", "0.9"), (4, "benign", "2", "0.9"),
                                  (5, "benign", "0", ""), (6, "benign", "0", "0.6")],
                                 "sequence_id int, sequence_label string, y string, lstm_malicious_probability string")
    frame = E.sequence_eval_frame(seqs)
    assert sorted(r["sequence_id"] for r in frame.collect()) == [1, 2, 6]
    wrong = E.errors(E.evaluate_at(frame)).collect()
    assert [(r["sequence_id"], r["error_type"], round(r["error_confidence"], 6)) for r in wrong] == [
        (2, "fp", 0.9), (1, "fn", 0.8), (6, "fp", 0.6)]
    rows = spark.createDataFrame([(1, 1, 0, 1, 0, 1), (0, 0, 1, 1, 0, 0)],
                                 "y_true int, lstm_alert int, iforest_alert int, or_alert int, and_alert int, combined_alert int")
    table = {r["detector"]: (r["tp"], r["tn"], r["fp"], r["fn"]) for r in E.compare_detectors(rows).collect()}
    assert table["LSTM only"] == (1, 1, 0, 0) and table["IF OR LSTM"] == (1, 0, 1, 0) and table["IF AND LSTM"] == (0, 1, 0, 1)
    assert sorted(r["or_result"] for r in E.mark_all(rows).collect()) == ["fp", "tp"]
