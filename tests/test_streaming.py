"""A replayed stream gives the batch result."""

import os

import pytest
from pyspark.sql import functions as F

from auditloom.operators import alerts as H
from auditloom.operators import windows as W
from auditloom.streaming import evidence as D
from auditloom.streaming import monitor as T
from auditloom.streaming import overlaps as O
from auditloom.streaming import runs as R
from auditloom.streaming import vectors as V


def replay(spark, tmp_path, df, plan, name):
    """Run ``plan`` over ``df`` as a stream of three files in time order."""
    source = tmp_path / name
    bounds = df.approxQuantile("ts_us", [0.0, 0.4, 0.8, 1.0], 0.0)
    for i, (low, high) in enumerate(zip(bounds, [*bounds[1:-1], float("inf")], strict=False)):
        part = df.where((F.col("ts_us") >= low) & (F.col("ts_us") < high))
        known = set(source.glob("*.parquet")) if source.exists() else set()
        part.coalesce(1).write.mode("append").parquet(str(source))
        for file in set(source.glob("*.parquet")) - known:
            os.utime(file, (1000 * (i + 1), 1000 * (i + 1)))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (plan(stream).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start())
    query.awaitTermination(300)
    return spark.table(name)


def test_windows_equal_batch(spark, tmp_path):
    rows = [("h", str(t), "execve" if t % 3 else "connect", "benign", t * 1_000_000) for t in range(0, 200, 2)]
    # one far later event closes every earlier window
    rows.append(("end", "9999", "x", "", 9_999_000_000))
    df = spark.createDataFrame(rows, "source string, event_id string, syscall string, manual_label string, ts_us bigint")
    found = replay(spark, tmp_path, df, lambda s: T.stream_window_features(s, 10_000_000, 0, "1 second"), "stream_windows")
    batch = W.window_features(W.assign_windows(W.prepare_events(df), 10_000_000)).where("source = 'h'")
    columns = ["window_id", "event_count", "execve_count", "network_event_count", "unique_syscall_count", "window_label",
               "window_start_us", "window_end_us"]
    assert sorted(map(tuple, found.where("source = 'h'").select(*columns).collect())) == sorted(
        map(tuple, batch.select(*columns).collect()))


def test_sessions_equal_batch(spark, tmp_path):
    import random

    random.seed(4)
    rows = [("h", i, a := random.randint(0, 10**9), a + random.choice([0, 10**6, 2 * 10**7]), 0.5, 0.25, 0.75, "s", "e",
             "lstm_only", int(i % 5 > 0)) for i in range(60)]
    rows.append(("end", 999, 10**12, 10**12, 0.1, 0.1, 0.1, "s", "e", "lstm_only", 1))
    df = spark.createDataFrame(rows, "source string, sequence_id bigint, start_us bigint, end_us bigint, "
                               "lstm_malicious_probability double, iforest_max_anomaly_score double, combined_score double, "
                               "start_event_id string, end_event_id string, combined_reason string, combined_alert int")
    df = df.withColumn("ts_us", F.col("start_us"))
    found = replay(spark, tmp_path, df, lambda s: T.stream_alert_sessions(s, 5_000_000, "2 minutes"), "stream_alerts")
    batch = H.summarise_alerts(H.alert_sessions(df, 5_000_000), lists=False).where("source = 'h'")
    columns = ["start_us", "end_us", "sequence_count", "max_combined_score"]
    assert sorted(map(tuple, found.where("source = 'h'").select(*columns).collect())) == sorted(
        map(tuple, batch.select(*columns).collect()))


def test_sessions_without_length_or_gap(spark, tmp_path):
    rows = [("h", i, t, t, 0.5, 0.25, 0.75, f"s{i}", f"e{i}", "lstm_only", 1) for i, t in enumerate([5, 5, 6, 8])]
    rows.append(("end", 999, 10**12, 10**12, 0.1, 0.1, 0.1, "s", "e", "lstm_only", 1))
    df = spark.createDataFrame(rows, "source string, sequence_id bigint, start_us bigint, end_us bigint, "
                               "lstm_malicious_probability double, iforest_max_anomaly_score double, combined_score double, "
                               "start_event_id string, end_event_id string, combined_reason string, combined_alert int")
    df = df.withColumn("ts_us", F.col("start_us"))
    found = replay(spark, tmp_path, df, lambda s: T.stream_alert_sessions(s, 0, "2 minutes"), "stream_points").where("source = 'h'")
    assert sorted((r["start_us"], r["sequence_count"], r["start_event_id"], r["end_event_id"], r["combined_reason_summary"]) for r in found.collect()) == [
        (5, 2, "s0", "e1", ["lstm_only"]), (6, 1, "s2", "e2", ["lstm_only"]), (8, 1, "s3", "e3", ["lstm_only"])]


def staged(spark, tmp_path, name, slices, schema):
    """One file a slice, aged in order."""
    folder = tmp_path / name
    for i, rows in enumerate(slices):
        known = set(folder.glob("*.parquet")) if folder.exists() else set()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for file in set(folder.glob("*.parquet")) - known:
            os.utime(file, (1000 * (i + 1), 1000 * (i + 1)))
    return R.read_slices(spark, str(folder), schema)


EVENTS = "source string, event_id string, event_no long, syscall string, key string, exe string, command string, comm string, manual_label string, ts_us long, path string, paths string"


def event(i, t, source="h", syscall="execve"):
    return (source, str(i), i, syscall, f"k{i % 3}", f"/bin/e{i % 4}", f"c{i % 5}", f"m{i % 2}", "benign", t, f"/tmp/p{i % 3}", f"/tmp/p{i % 3}|/etc/q{i % 2}")


def test_first_state_of_vectors_holds_one_number_a_row(spark, tmp_path):
    stream = staged(spark, tmp_path, "narrow", [[event(1, 0)]], EVENTS)
    found = V.stream_window_vectors(stream, W.FeatureSchema({}), 10_000_000, 0, "5 seconds")
    lowest = [line for line in found._jdf.queryExecution().analyzed().toString().split("\n") if "Aggregate [" in line][-1]
    assert "sum(n" in lowest and "execve_count" not in lowest and "record_count_sum" not in lowest


def test_vectors_equal_batch_and_can_be_scored(spark, tmp_path):
    from auditloom.operators.iforest import fit_iforest

    rows = [event(i, i * 700_000, syscall=["execve", "connect", "Open At"][i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, EVENTS)
    origin = spark.createDataFrame([("h", 0)], "source string, origin_us long")
    assigned = W.assign_windows(W.prepare_events(df), 10_000_000, origin=origin)
    values = W.value_counts(assigned, ["source"])
    schema = W.learn_schema(values, 2)
    stream = staged(spark, tmp_path, "vectors", [rows[:80], rows[80:160], rows[160:], [event(999, 10**12, "end")]], EVENTS)
    plan = V.stream_window_vectors(stream, schema, 10_000_000, 0, "5 seconds")
    done = R.run_available(plan, str(tmp_path / "sink"), str(tmp_path / "state"))
    assert done.rows == 201 and done.late == 0
    found = spark.read.parquet(str(tmp_path / "sink")).where("source = 'h'")
    maps = W.category_maps(W.category_counts(values, schema))
    batch = W.align_features(W.window_features(assigned, values=values).join(maps, ["source", "window_id"], "left").withColumn(
        "cat_counts", F.coalesce("cat_counts", F.create_map().cast("map<string,bigint>"))), schema)
    columns = ["window_id", "window_start_us", "window_end_us", "window_label", "unique_comm_count", "features"]
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    model = fit_iforest(batch, trees=5, schema=schema)
    score = "iforest_anomaly_score"
    assert sorted(r[0] for r in model.transform(found, 0.0).select(score).collect()) == sorted(r[0] for r in model.transform(batch, 0.0).select(score).collect())


def test_late_rows_are_counted_and_a_second_run_resumes(spark, tmp_path):
    schema = W.FeatureSchema({})
    first = [event(i, i * 1_000_000) for i in range(30)]
    stream = staged(spark, tmp_path, "late", [first], EVENTS)
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")
    done = R.run_available(V.stream_window_vectors(stream, schema, 10_000_000, 0, "1 second"), sink, state)
    assert done.rows == 30 and done.late == 0
    assert sorted(r["window_id"] for r in spark.read.parquet(sink).collect()) == [0, 1]
    # window 0 is closed; one row for it is late, one for window 2 is not
    folder = tmp_path / "late"
    spark.createDataFrame([event(90, 3_000_000), event(91, 29_000_000)], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([event(99, 10**12, "end")], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = R.read_slices(spark, str(folder), EVENTS)
    done = R.run_available(V.stream_window_vectors(stream, schema, 10_000_000, 0, "1 second"), sink, state)
    assert done.rows == 3 and done.late > 0
    assert {r["window_id"]: r["event_count"] for r in spark.read.parquet(sink).where("source = 'h'").collect()} == {0: 10, 1: 10, 2: 11}


def test_a_failed_run_goes_on_where_it_stopped(spark, tmp_path):
    """The second batch fails once; the next run repeats it and no window counts twice."""
    rows = [event(i, i * 1_000_000) for i in range(60)]
    stream = staged(spark, tmp_path, "failing", [rows[:30], rows[30:], [event(99, 10**12, "end")]], EVENTS)
    broken = stream.withColumn("syscall", F.when(F.col("ts_us") == 45_000_000, F.raise_error(F.lit("worker lost"))).otherwise(F.col("syscall")))
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")
    schema = W.FeatureSchema({})
    with pytest.raises(Exception, match="worker lost"):
        R.run_available(V.stream_window_vectors(broken, schema, 10_000_000, 0, "1 second"), sink, state)
    R.run_available(V.stream_window_vectors(stream, schema, 10_000_000, 0, "1 second"), sink, state)
    found = spark.read.parquet(sink).where("source = 'h'").collect()
    assert sorted((r["window_id"], r["event_count"]) for r in found) == [(i, 10) for i in range(6)]


def test_evidence_equals_batch(spark, tmp_path):
    """Sessions that merge across batches, events between them, groups apart, late rows counted."""
    import random

    random.seed(8)
    far = 10**12
    events = sorted((event(i, random.randint(0, 300_000_000), random.choice(["h", "g"])) for i in range(400)), key=lambda r: r[9])
    spans = sorted((random.choice(["h", "g"]), i, a := random.randint(0, 300_000_000), a + random.choice([0, 2_000_000, 9_000_000]), int(i % 6 > 0)) for i in range(60))
    spans = sorted(spans, key=lambda r: r[2])
    schema = "source string, sequence_id long, start_us long, end_us long, combined_alert int"
    cut = [100_000_000, 200_000_000]

    def slices(rows, at, last):
        return [[r for r in rows if r[at] <= cut[0]], [r for r in rows if cut[0] < r[at] <= cut[1]], [r for r in rows if r[at] > cut[1]], [last]]

    e = staged(spark, tmp_path, "events", slices(events, 9, event(9999, far, "end")), EVENTS)
    s = staged(spark, tmp_path, "spans", slices(spans, 2, ("end", 999, far, far, 1)), schema)
    plan = D.stream_alert_evidence(e, s, 4_000_000, 2, "event_no", "100 seconds")
    done = R.run_available(plan, str(tmp_path / "sink"), str(tmp_path / "state"), D.SETTINGS)
    found = spark.read.parquet(str(tmp_path / "sink")).where("source <> 'end'")
    members = H.alert_sessions(spark.createDataFrame(spans, schema), 4_000_000)
    alerts = members.groupBy("source", "alert_id").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    inside = H.alert_events(spark.createDataFrame(events, EVENTS), alerts)
    tops = H.top_values(inside, 2, ["event_no"]).unionByName(H.top_paths(inside, 2, ["event_no"]))
    want = tops.join(alerts, ["source", "alert_id"]).select("source", "field", "start_us", "end_us", "value", "n", "rank")
    got = found.where("field NOT IN ('sequence_ids', 'event_count')").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    ids = found.where("field = 'sequence_ids'").select("source", "start_us", "value").collect()
    assert sorted((r["source"], r["value"]) for r in ids) == sorted((r["source"], str(r["sequence_id"])) for r in members.collect())
    assert done.late == 0


class Held:
    """A state of one group and field, without a stream."""

    def __init__(self):
        self.rows, self.timers = {}, []

    def getListState(self, name, schema):
        rows = self.rows.setdefault(name, [])

        class State:
            get = staticmethod(lambda: iter(list(rows)))
            clear = staticmethod(rows.clear)
            appendValue = staticmethod(rows.append)
            put = staticmethod(lambda new: rows.__setitem__(slice(None), new))

        return State

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return 0


def test_evidence_of_a_busy_field_needs_little_memory():
    """Half a million rows of one group and field, all waiting for a session and then inside one."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    n, part = 500_000, 10_000
    held = Held()
    state = D.SessionEvidence(1_000_000, 3)
    state.init(held)

    def frames():
        for at in range(0, n, part):
            no = np.arange(at, at + part)
            yield pd.DataFrame({"start_us": no + 1, "end_us": no + 1, "value": [f"/var/log/{i % 1000}" for i in no], "is_event": True,
                                "at": [[2, int(i), 0] for i in no], "a0": 2, "a1": no, "a2": 0})

    span = pd.DataFrame({"start_us": [1], "end_us": [n], "value": ["7"], "is_event": [False], "at": [[1, n, 7]], "a0": [1], "a1": [n], "a2": [7]})
    tracemalloc.start()
    assert not list(state.handleInputRows(("h", "top_event_paths"), frames(), held))
    assert not list(state.handleInputRows(("h", "top_event_paths"), iter([span]), held))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not held.rows["pending"] and held.rows["sessions"] == [(1, n)] and held.timers
    assert peak < 40 << 20
    held.getCurrentWatermarkInMs = lambda: 10_000
    found = pd.concat(state.handleExpiredTimer(("h", "top_event_paths"), held, None))
    assert found[["value", "n", "rank"]].values.tolist() == [[f"/var/log/{i}", 500, i + 1] for i in range(3)]


def test_evidence_after_the_watermark_is_dropped_and_counted(spark, tmp_path):
    schema = "source string, sequence_id long, start_us long, end_us long, combined_alert int"
    far = 10**12
    e = staged(spark, tmp_path, "events", [[event(1, 5_000_000)], [event(2, 500_000_000)], [event(5, 501_000_000)], [event(3, 6_000_000)], [event(4, far, "end")]], EVENTS)
    s = staged(spark, tmp_path, "spans", [[("h", 1, 4_000_000, 9_000_000, 1)], [], [], [("h", 2, 5_000_000, 7_000_000, 1)], []], schema)
    done = R.run_available(D.stream_alert_evidence(e, s, 1_000_000, 2, "event_no", "1 second"), str(tmp_path / "sink"), str(tmp_path / "state"), D.SETTINGS)
    found = {(r["field"], r["value"]): r["n"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    assert found["event_count", ""] == 1 and ("sequence_ids", "2") not in found and found["sequence_ids", "1"] == 1
    assert done.late > 0


def test_overlaps_reject_longer_rows_and_keep_lone_sequences(spark, tmp_path):
    schema = "source string, sequence_id long, start_us long, end_us long"
    wins = "source string, window_id long, window_start_us long, window_end_us long, iforest_anomaly_score double, iforest_is_anomaly int"
    far, b = 10**13, 10**9
    s = staged(spark, tmp_path, "s", [[("h", 1, b, b + 5_000_000), ("h", 2, b + 90_000_000, b + 90_000_000), ("g", 3, b, b + 5_000_000)], [("end", 9, far, far)]], schema)
    w = staged(spark, tmp_path, "w", [[("h", 0, b, b + 10_000_000, 0.5, 1), ("h", 1, b + 5_000_000, b + 15_000_000, 0.25, 0)], [("end", 9, far, far, 0.0, 0)]], wins)
    plan = O.stream_overlap_scores(s, w, 10_000_000, 5_000_000, 0.3, 0.0, 0.5, "1 second")
    R.run_available(plan, str(tmp_path / "sink"), str(tmp_path / "state"))
    found = {r["sequence_id"]: r for r in spark.read.parquet(str(tmp_path / "sink")).where("source <> 'end'").collect()}
    assert {k: (r["iforest_overlap_count"], r["iforest_max_anomaly_score"], r["iforest_max_anomaly_score_norm"], r["iforest_any_anomaly"]) for k, r in found.items()} == {
        1: (2, 0.5, 1.0, 1), 2: (0, 0.0, 0.0, 0), 3: (0, 0.0, 0.0, 0)}
    with pytest.raises(Exception, match="sequence longer"):
        R.run_available(O.stream_overlap_scores(s, w, 10_000_000, 4_000_000, watermark="1 second"), str(tmp_path / "sink2"), str(tmp_path / "state2"))
