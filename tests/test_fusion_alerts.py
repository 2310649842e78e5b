import pytest
from pyspark.sql import functions as F

from auditloom.operators import alerts as L
from auditloom.operators import fusion as G

WINDOW = "source string, window_id bigint, window_start_us bigint, window_end_us bigint, " \
         "iforest_anomaly_score double, iforest_is_anomaly int, window_label string"
SMALL = {"max_group_rows": 2, "chunk_rows": 2}


def windows(spark):
    return spark.createDataFrame([("h", i, i * 10, i * 10 + 10, s, int(s > 2), lab) for i, (s, lab) in enumerate(
        [(1.0, "benign"), (3.0, "malicious"), (2.0, "benign")])], WINDOW)


def sequences(spark):
    return spark.createDataFrame([("h", 0, 10, 12, 0.5), ("h", 1, 31, 32, 0.5)],
                                 "source string, sequence_id bigint, start_us bigint, end_us bigint, lstm_malicious_probability double")


def test_overlap_scores(spark):
    found = {r["sequence_id"]: r for r in G.overlap_scores(sequences(spark), windows(spark), threshold=2.5).collect()}
    hit = found[0]
    assert (hit["iforest_overlap_count"], hit["iforest_max_anomaly_score"], hit["iforest_mean_anomaly_score"]) == (2, 3.0, 2.0)
    assert (hit["iforest_max_anomaly_score_norm"], hit["iforest_any_anomaly"]) == (1.0, 1)
    assert (hit["iforest_window_ids"], hit["iforest_overlapping_labels"]) == ([0, 1], ["benign", "malicious"])
    assert found[1]["iforest_overlap_count"] == 0 and found[1]["iforest_max_anomaly_score_norm"] == 0.0
    by_sequence = G.overlap_scores(sequences(spark), windows(spark), norm="sequence").collect()
    assert sorted(r["iforest_anomaly_score_norm"] for r in by_sequence) == [0.0, 1.0]
    scored = G.overlap_scores(sequences(spark), windows(spark), threshold=2.5).withColumn("lstm_prediction", F.lit(0))
    out = {r["sequence_id"]: r for r in G.combine(scored, 0.7).collect()}
    assert out[0]["combined_score"] == pytest.approx(0.65) and out[0]["combined_reason"] == "iforest_only"
    assert out[1]["combined_reason"] == "low_score"
    with pytest.raises(ValueError, match="weight"):
        G.combine(scored, 1.5)


def test_minmax_of_constant_and_bad_values(spark):
    df = spark.createDataFrame([("2",), ("2",)], "v string")
    assert [r["n"] for r in G.minmax(df, "v", "n").collect()] == [0.0, 0.0]
    df = spark.createDataFrame([("4",), ("bad",)], "v string")
    assert sorted(r["n"] for r in G.minmax(df, "v", "n").collect()) == [0.0, 1.0]


def positives(spark, ranges):
    return spark.createDataFrame(
        [("h", i, a, b, f"s{i}", f"e{i}", 0.5, 0.1, 0.4, "lstm_only", [9, 10, 129], 1) for i, (a, b) in enumerate(ranges)],
        "source string, sequence_id bigint, start_us bigint, end_us bigint, start_event_id string, end_event_id string, "
        "lstm_malicious_probability double, iforest_max_anomaly_score double, combined_score double, "
        "combined_reason string, iforest_window_ids array<bigint>, combined_alert int")


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_alert_sessions(spark, limits):
    df = positives(spark, [(0, 100), (20, 40), (150, 160), (211, 220)])
    members = L.alert_sessions(df, 50, **limits)
    assert {r["sequence_id"]: r["alert_id"] for r in members.collect()} == {0: 0, 1: 0, 2: 0, 3: 1}
    rows = {r["alert_id"]: r for r in L.summarise_alerts(members).collect()}
    assert rows[0]["iforest_window_ids"] == ["10", "129", "9"]
    assert (rows[0]["sequence_ids"], rows[0]["start_event_id"], rows[0]["end_event_id"]) == ([0, 1, 2], "s0", "e2")
    assert L.alert_windows(members).count() == 6 and L.alert_members(members).count() == 4


def test_sessions_equal_sequential_rule(spark):
    import random

    random.seed(3)
    ranges = [(a := random.randint(0, 3000), a + random.choice([0, 2, 10, 200])) for _ in range(150)]
    members = L.alert_sessions(positives(spark, ranges), 5, max_group_rows=10, chunk_rows=7)
    got = {r["sequence_id"]: r["alert_id"] for r in members.collect()}
    alert, reach = -1, None
    for i in sorted(range(len(ranges)), key=lambda i: (*ranges[i], i)):
        if reach is None or ranges[i][0] > reach + 5:
            alert += 1
            reach = ranges[i][1]
        reach = max(reach, ranges[i][1])
        assert got[i] == alert


@pytest.mark.parametrize("limits", [{}, SMALL])
def test_evidence(spark, limits):
    rows = [(1, "x"), (2, "y"), (3, "y"), (4, "x"), (5, "z"), (6, " ")]
    events = spark.createDataFrame(
        [("h", t, str(t), v, "k", "", "", "", "/a", ["/a", "/b"] if t == 1 else []) for t, v in rows] +
        [("h", 99, "99", "late", "", "", "", "", "", [])],
        "source string, ts_us bigint, event_id string, command string, key string, exe string, comm string, "
        "syscall string, path string, paths array<string>")
    alerts = spark.createDataFrame([("h", 0, 1, 6), ("h", 1, 7, 8)], "source string, alert_id bigint, start_us bigint, end_us bigint")
    inside = L.alert_events(events, alerts, limit=0 if limits else 100, **limits)
    top = L.top_values(inside, 2, fields={"command": "command"}).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in top] == [("x", 2), ("y", 2)]
    paths = L.top_paths(inside.where("ts_us = 1"), 8).orderBy("rank").collect()
    assert [(r["value"], r["n"]) for r in paths] == [("/a", 2), ("/b", 1)]
    full = {r["alert_id"]: r for r in L.with_evidence(alerts, events, 2).collect()}
    assert full[0]["event_count"] == 6 and full[1]["event_count"] == 0
    assert [tuple(v) for v in full[0]["top_event_keys"]] == [("k", 6)] and full[1]["top_event_paths"] == []
