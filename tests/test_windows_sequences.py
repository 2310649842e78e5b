import math

import pytest
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.operators import sequences as Q
from auditloom.operators import windows as W
from auditloom.sources import tables as T

EVENT = "source string, timestamp string, event_id string, syscall string, key string, saddr string, exe string, manual_label string, " \
        "attack_run_id string"
SEC = 1_000_000


def events(spark, rows):
    base = ("h", "0", "0", "", "", "", "", "", "r")
    return spark.createDataFrame([tuple(r.get(n, b) for n, b in zip(
        ("source", "timestamp", "event_id", "syscall", "key", "saddr", "exe", "manual_label", "attack_run_id"), base, strict=True))
        for r in rows], EVENT)


def test_windows_count_from_first_event(spark):
    df = events(spark, [{"timestamp": t} for t in ("100.0", "109.999", "110.0", "131.0", "bad")])
    found = W.assign_windows(W.prepare_events(df), 10 * SEC).orderBy("ts_us").collect()
    assert [r["window_id"] for r in found] == [0, 0, 1, 3]
    assert (found[3]["window_start_us"], found[3]["window_end_us"]) == (130 * SEC, 140 * SEC)
    assert W.window_features(W.assign_windows(W.prepare_events(df), 10 * SEC)).count() == 3
    with pytest.raises(ValueError, match="positive"):
        W.assign_windows(W.prepare_events(df), 0)
    with pytest.raises(ValueError, match="timestamp"):
        W.prepare_events(df.drop("timestamp"))


@pytest.mark.parametrize("labels,expected", [
    (["benign", "benign"], "benign"), (["benign", ""], "weak_benign"), ([""], "unlabeled"),
    (["ambiguous", "benign"], "ambiguous"), (["malicious", "ambiguous"], "malicious"), (["other"], "unlabeled")])
def test_window_label(spark, labels, expected):
    df = W.assign_windows(W.prepare_events(events(spark, [{"manual_label": x} for x in labels])), SEC)
    assert W.window_features(df).first()["window_label"] == expected


def test_network_count_adds_three_tests(spark):
    df = events(spark, [{"syscall": "connect", "saddr": "02", "key": "network_connect"}, {"key": "Network_x"}])
    assert W.window_features(W.assign_windows(W.prepare_events(df), SEC)).first()["network_event_count"] == 3


def test_schema_is_learnt_then_applied(spark, tmp_path):
    train = events(spark, [{"key": "(null)"}, {"key": "null"}, {"key": "Exec"}, {"syscall": "open", "exe": "/bin/ls"}])
    found, schema = W.build_window_features(train, 10 * SEC, top=2)
    assert schema.values["key"] == ["null", "exec"] and schema.values["exe_basename"] == ["missing", "ls"]
    assert found.first()["cat_counts"]["key_null_count"] == 2
    assert len(found.first()["features"]) == len(schema.names) == len(S.BASE_FEATURES) + sum(map(len, schema.values.values()))
    T.save_schema(spark, schema, str(tmp_path / "schema"))
    loaded = T.load_schema(spark, str(tmp_path / "schema"))
    assert {k: v for k, v in loaded.values.items()} == {k: v for k, v in schema.values.items() if v}
    other, same = W.build_window_features(events(spark, [{"key": "new"}, {"key": "exec"}]), 10 * SEC, loaded)
    row = other.first()
    at = dict(zip(same.names, row["features"], strict=True))
    assert at["key_null_count"] == 0 and at["key_exec_count"] == 1 and at["event_count"] == 2
    wide = W.wide_features(other, same)
    assert wide.first()["key_exec_count"] == 1 and wide.first()["type_missing_count"] == 2


def test_approximate_distinct_counts_agree_on_small_windows(spark):
    df = W.assign_windows(W.prepare_events(events(spark, [{"syscall": f"s{i % 5}"} for i in range(50)])), SEC)
    assert W.window_features(df, distinct="approx").first()["unique_syscall_count"] == 5 == W.window_features(df).first()["unique_syscall_count"]


def steps(spark, n, run="r", labels=None, start=0):
    return [{"timestamp": str(start + i), "event_id": str(i), "attack_run_id": run,
             "manual_label": (labels[i] if labels else "benign")} for i in range(n)]


LIMITS = [{}, {"max_group_rows": 3, "chunk_rows": 2}]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("length,stride", [(5, 3), (4, 2), (3, 5), (1, 1), (6, 1)])
def test_sliding_windows(spark, limits, length, stride):
    sizes = {"a": 12, "b": 4, "c": 31, " ": 7}
    rows = [r for i, (run, n) in enumerate(sizes.items()) for r in steps(spark, n, run, start=1000 * i)]
    df = Q.prepare_sequence_events(events(spark, rows)).withColumn("segment", F.col("attack_run_id"))
    ordered = Q.order_events(df, ["segment"], **limits)
    assert ordered.spans == bool(limits)
    for chunk_blocks in (2, 3, 20_000):
        if chunk_blocks < -(-length // stride) - 1:
            continue
        found = Q.sliding_sequences(ordered, length, stride, None, chunk_blocks).collect()
        got = sorted((r["segment"], r["k"], int(r["start_event_id"]), int(r["end_event_id"])) for r in found)
        assert got == sorted((run, k, s, s + length - 1) for run, n in sizes.items()
                             for k, s in enumerate(range(0, n - length + 1, stride)))


@pytest.mark.parametrize("limits", LIMITS)
def test_sequence_ids_gaps_and_labels(spark, limits):
    rows = steps(spark, 3, "late", start=500) + steps(spark, 12, "first", ["malicious"] * 5 + ["benign"] * 7) + steps(spark, 2, "short", start=100)
    found, vocab = Q.build_sequences(events(spark, rows), length=3, stride=3, min_malicious=3, **limits)
    got = {r["sequence_id"]: r for r in found.collect()}
    assert [(i, got[i]["segment_id"], got[i]["y"], got[i]["malicious_event_count"]) for i in sorted(got)] == [
        (0, "first", 1, 3), (1, "first", 0, 2), (2, "first", 0, 0), (3, "first", 0, 0), (4, "late", 0, 0)]
    gaps = [[round(s[0], 5) for s in got[i]["x_num"]] for i in (0, 1)]
    one = round(math.log1p(1), 5)
    assert gaps == [pytest.approx([0, one, one], abs=1e-4), pytest.approx([one] * 3, abs=1e-4)]
    assert len(got[0]["x_cat"][0]) == 7 and len(got[0]["x_num"][0]) == 12


def test_gaps_are_clipped(spark):
    df = Q.prepare_sequence_events(events(spark, [{"timestamp": t, "event_id": t} for t in ("0", "30", "200")]))
    rows = Q.with_numeric_features(Q.order_events(df, ["source"])).df.orderBy("ts_us").collect()
    assert [r["numeric"][0] for r in rows] == [0.0, pytest.approx(math.log1p(30)), pytest.approx(math.log1p(60))]


@pytest.mark.parametrize("lookup_rows", [4000, 1])
def test_vocabulary_order_cap_and_encoding(spark, lookup_rows):
    rows = [{"key": k} for k in ["b"] * 3 + ["a"] * 3 + ["c"] + [" "] * 5]
    df = Q.prepare_sequence_events(events(spark, rows))
    vocab = Q.learn_vocab(df, 4)
    assert sorted((r["token"], r["id"]) for r in vocab.where("column = 'key'").collect()) == [("a", 2), ("b", 3)]
    ids = {(r["key"], r["tokens"][5]) for r in Q.encode(df, vocab, lookup_rows).collect()}
    assert ids == {("a", 2), ("b", 3), ("c", 1), (" ", 1)}


@pytest.mark.parametrize("path,key,saddr,expected", [
    ("/root/.ssh/x", "", "", "root_ssh"), ("/home/u/.ssh", "", "", "ssh"), ("/etc/sudoers.d", "", "", "sudoers"),
    ("/etc/hosts", "", "", "etc"), ("/usr/lib/systemd/x", "", "", "systemd"), ("/var/spool/cron/a", "", "", "cron"),
    ("", "Network", "", "network"), ("", "", "02", "network"), ("", "", " ", "none"), ("/proc/1", "", "", "proc")])
def test_path_category(spark, path, key, saddr, expected):
    df = spark.createDataFrame([("1", "1", path, key, saddr)], "timestamp string, event_id string, path string, key string, saddr string")
    assert Q.prepare_sequence_events(df).first()["path_category"] == expected


def test_too_few_events(spark):
    df = Q.prepare_sequence_events(events(spark, steps(spark, 4)))
    with pytest.raises(Exception, match="only 4 events available"):
        Q.require_sequences(df, 5).collect()
    with pytest.raises(ValueError, match="manual_label"):
        Q.prepare_sequence_events(df.drop("manual_label"), ["benign"])
