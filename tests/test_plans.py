"""Training round and scan on a small made-up host."""

import json
import random

import pytest
from pyspark.sql import functions as F

from auditloom.plans import report as J
from auditloom.plans.scan import ScanParameters, alert_list, scan, scan_events
from auditloom.plans.tune import tune
from auditloom.sources import tables as T

PARAMETERS = ScanParameters(sequence_length=10, stride=5, iforest_threshold=0.05, combined_threshold=0.4)


def host(spark, seed, bursts):
    """Quiet traffic with bursts of failing root commands."""
    random.seed(seed)
    rows, at, n = [], 1000.0, 0
    for block in range(24):
        bad = block % 4 == 3 and bursts
        for _ in range(40):
            at += 0.05 if bad else random.uniform(0.5, 3.0)
            n += 1
            rows.append(("h", f"{at:.3f}", str(n), "unlink" if bad else random.choice(["openat", "connect"]),
                         "no" if bad else "yes", "rm -rf /tmp/x" if bad else "", "/usr/bin/rm" if bad else "/usr/bin/cat",
                         "file_destroy" if bad else "access", "0" if bad else "1000", "malicious" if bad else "benign",
                         f"run{block // 4}"))
    return spark.createDataFrame(rows, "source string, timestamp string, event_id string, syscall string, success string, command string, "
                                       "exe string, key string, uid string, manual_label string, attack_run_id string")


@pytest.fixture(scope="module")
def models(spark):
    return tune(host(spark, 1, False), host(spark, 2, False), host(spark, 3, True), PARAMETERS, trees=40, top=10,
                vocab_size=32, min_malicious=5, validation_share=0.34)


def test_tune_separates_bursts(models):
    assert models.sequence_metrics.first()["roc_auc"] > 0.95
    assert models.calibration.count() == 6 and models.calibrated.count() == 6
    best = models.window_sweep.orderBy(F.desc("f1")).first()
    assert best["recall"] > 0.7
    assert {r["detector"] for r in models.detectors.collect()} == {
        "LSTM only", "Isolation Forest only", "IF OR LSTM", "IF AND LSTM", "Weighted combined"}
    assert models.combined_sweep.count() > 0 and "combined_result" in models.decisions.columns


def test_scan_finds_bursts_and_writes_all_stages(spark, models, tmp_path):
    events = host(spark, 4, True)
    found = scan_events(events, models.forest, models.model, models.vocab, PARAMETERS)
    alerts = found.alerts.orderBy("alert_id").collect()
    assert 5 <= len(alerts) <= 8
    assert all(a["top_event_commands"][0]["value"] == "rm -rf /tmp/x" for a in alerts)
    found.write(str(tmp_path / "out"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out/summary")).collect()]
    head = next(x for x in lines if "parameters" in x)
    assert head["alert_interval_count"] == len(alerts) == len(lines) - 1
    assert head["parameters"]["lstm_weight"] == 0.7
    report = [r[0] for r in spark.read.text(str(tmp_path / "out/report")).collect()]
    assert sum(x.startswith("### Alert") for x in report) == len(alerts) and any("rm -rf /tmp/x (" in x for x in report)
    assert report[0] == "# Triage Report" and f"- Alert intervals: `{len(alerts)}`" in report and "## Generated Files" in report
    quiet = [r["value"] for r in J.full_report(found.alerts.where("false"), found.combined, {"lstm_weight": 0.7}).collect()]
    assert J.EMPTY in quiet and "- LSTM weight: `0.7`" in quiet
    windows = spark.read.parquet(str(tmp_path / "out/alert_windows"))
    assert windows.select("alert_id").distinct().count() == len(alerts)
    assert spark.read.parquet(str(tmp_path / "out/ranked")).count() == found.combined.count()
    assert spark.read.parquet(str(tmp_path / "out/unscored")).count() == 0
    T.write_table(alert_list(found.alerts), str(tmp_path / "csv"), "csv")
    row = T.read_table(spark, str(tmp_path / "csv"), ["alert_id"]).orderBy("alert_id").first()
    assert row["top_event_keys"].startswith("file_destroy:")
    assert found.ranked(3).count() == 3
    small = found.alerts.select("*")
    again = scan_events(events.repartition(9), models.forest, models.model, models.vocab, PARAMETERS,
                        max_group_rows=100, chunk_rows=64).alerts
    keys = ["alert_id", "start_us", "end_us", "sequence_count", "event_count"]
    assert sorted(map(tuple, small.select(*keys).collect())) == sorted(map(tuple, again.select(*keys).collect()))


def test_scan_of_parsed_table_and_short_input(spark, models, tmp_path):
    T.write_table(host(spark, 4, True), str(tmp_path / "events"), "csv")
    assert scan(spark, models.forest, models.model, models.vocab, parsed=str(tmp_path / "events"), parameters=PARAMETERS).alerts.count() > 0
    with pytest.raises(ValueError, match="events that one sequence needs"):
        scan_events(host(spark, 4, True).limit(5), models.forest, models.model, models.vocab, PARAMETERS)


@pytest.mark.parametrize("name,value", [("window_us", 0), ("alert_gap_us", -1), ("lstm_weight", 1.1), ("combined_threshold", -0.1),
                                        ("iforest_threshold", -1.0), ("top_events", 0), ("lstm_threshold", 2.0), ("stride", 0)])
def test_parameter_guards(name, value):
    with pytest.raises(ValueError, match=name):
        ScanParameters(**{name: value})
