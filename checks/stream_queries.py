"""Streaming operators (group T) replayed from the tables: bounded runs whose result equals the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import windows as W
from auditloom.session import materialise
from auditloom.sources import tables as T
from auditloom.streaming import assembly, evidence, monitor, overlaps, runs, vectors
from checks.audit_view import HOUR, WINDOW_US, audit_events
from checks.log_queries import EVENTS_ORACLE, TEXTS, rendered
from checks.scratch import fresh
from checks.score_queries import GAP, SCORES_SQL, THRESHOLD, TOP, combined, score_sequences, score_windows
from checks.window_queries import ALIGNED_SQL, BASE_SQL_ORIGIN
from checks.window_queries import TOP as TOP_VALUES
from checks.window_queries import windowed

CLOSING = "closing"
PARTS, FILES, FILE_ROWS = 3, 2, 250_000


def replay(spark, inputs, plan, resumed=False, settings=None):
    """Run ``plan`` over tables as streams, cut into the same slices of time; returns the sink and the runs.

    ``inputs`` are ``(table, time column)``. Slices are staged in order of time,
    then a row of another source far in the future, which closes all that is
    open. With ``resumed`` the first run sees the first slice alone and ends; a
    second one starts from its checkpoint and finishes. Each table is computed
    once, and a slice has as many files as its rows need tasks.
    """
    inputs = [(materialise(df, "replay"), time) for df, time in inputs]
    files = max(FILES, *[-(-df.count() // (PARTS * FILE_ROWS)) for df, _ in inputs])
    cuts = runs.cut_points(inputs[0][0].select(inputs[0][1]), inputs[0][1], PARTS)
    folders = [fresh(spark, "stream") for _ in inputs]
    width = max([b - a for a, b in zip(cuts, cuts[1:], strict=False)] + [HOUR])
    ends = [df.agg(F.min(time), F.max(time)).first() for df, time in inputs]
    width = max([width, *[e[1] - cuts[-1] for e in ends if e[1] is not None], *[cuts[0] - e[0] for e in ends if e[0] is not None]])
    sink, state, done, found = fresh(spark, "sink"), fresh(spark, "state"), [], None
    bounds = [None, *cuts, None]
    for i, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        for folder, (df, time) in zip(folders, inputs, strict=True):
            runs.stage_slice(df.coalesce(files), folder, time, low, high)
        if found is None:
            streams = [runs.read_slices(spark, folder, df.schema, files) for folder, (df, _) in zip(folders, inputs, strict=True)]
            found = plan(*streams, f"{width} microseconds")
        if resumed and not i:
            done.append(runs.run_available(found, sink, state, settings))
    far = max(e[1] for e in ends if e[1] is not None) + 10 * width
    for folder, (df, time) in zip(folders, inputs, strict=True):
        moved = {c: F.lit(far).alias(c) for c in df.columns if c in (time, "start_us", "end_us", "window_start_us", "window_end_us", "ts_us")}
        moved |= {c: F.lit(1).alias(c) for c in df.columns if c == "combined_alert"}
        df.limit(1).withColumns({**moved, "source": F.lit(CLOSING)}).write.mode("append").parquet(folder)
    done.append(runs.run_available(found, sink, state, settings))
    return spark.read.schema(found.schema).parquet(sink).where(F.col("source") != CLOSING), done


def streamed_vectors(spark, sf_dir):
    """Feature vectors on a stream that is stopped after its first slice and resumed, under a saved schema."""
    path = fresh(spark, "schema")
    T.save_schema(spark, W.learn_schema(W.value_counts(windowed(spark, sf_dir), ["source"]), TOP_VALUES), path)
    schema = T.load_schema(spark, path)
    found, _ = replay(spark, [(audit_events(spark, sf_dir), "ts_us")],
                      lambda s, hold: vectors.stream_window_vectors(s, schema, WINDOW_US, 0, hold), resumed=True)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in schema.names]).alias("feature"), F.col("features").alias("value"))
    return found.select("source", "window_id", F.inline(named)).select("source", "window_id", "feature", F.round("value", 6).alias("value"))


def streamed_evidence(spark, sf_dir):
    """Top values, ids and event counts of alerts, from streams of events and scored sequences."""
    scored = combined(spark, sf_dir).select("source", "sequence_id", "start_us", "end_us", "combined_alert")
    found, _ = replay(
        spark, [(audit_events(spark, sf_dir), "ts_us"), (scored, "start_us")],
        lambda e, s, hold: evidence.stream_alert_evidence(e, s, GAP, TOP, "event_no", hold), settings=evidence.SETTINGS)
    return found.select("source", "field", "start_us", "end_us", "value", "n", "rank")


def streamed_overlaps(spark, sf_dir):
    """Sequences joined with the windows they overlap, both as streams."""
    windows = score_windows(spark, sf_dir)
    sequences = score_sequences(spark, sf_dir).select("source", "sequence_id", "start_us", "end_us")
    low, high = windows.agg(F.min("iforest_anomaly_score"), F.max("iforest_anomaly_score")).first()
    longest = sequences.agg(F.max(F.col("end_us") - F.col("start_us"))).first()[0]
    found, _ = replay(
        spark, [(sequences, "start_us"), (windows, "window_start_us")],
        lambda s, w, hold: overlaps.stream_overlap_scores(s, w, WINDOW_US, longest, THRESHOLD, low, high, hold))
    return found.select(
        "source", "sequence_id", F.col("iforest_overlap_count").alias("n"), F.round("iforest_max_anomaly_score", 6).alias("mx"),
        F.round("iforest_mean_anomaly_score", 9).alias("mean"), F.round("iforest_max_anomaly_score_norm", 6).alias("norm"),
        F.col("iforest_any_anomaly").alias("any_alert"), F.col("iforest_model_any_anomaly").alias("any_native"))


def streamed_sessions(spark, sf_dir):
    """Alert intervals of a stream of scored sequences."""
    scored = combined(spark, sf_dir)
    # session times count half microseconds, so the watermark does too
    found, _ = replay(spark, [(scored, "start_us")], lambda s, hold: monitor.stream_alert_sessions(s, GAP, hold))
    return found.select(
        "source", "start_us", "end_us", "start_event_id", "end_event_id", "sequence_count",
        *[F.round(c, 6).alias(c) for c in ("max_lstm_probability", "mean_lstm_probability", "max_combined_score", "mean_combined_score", "duration_seconds")],
        F.array_join("combined_reason_summary", "|").alias("reasons"))


def streamed_assembly(spark, sf_dir):
    """Events put together from log lines that arrive in several batches, stopped and resumed."""
    seconds = F.regexp_extract("value", r"audit\((\d+\.\d+):", 1).try_cast("decimal(20,6)")
    lines = rendered(spark, sf_dir).select("source", "pos", "value", (seconds * 1_000_000).cast("bigint").alias("ts_us")).where("ts_us IS NOT NULL")

    def plan(stream, hold):
        # the row that closes the replay has a late time in its text as well
        value = F.when(F.col("source") == CLOSING, F.regexp_replace("value", r"audit\(\d+\.\d+:", F.concat(F.lit("audit("), (F.col("ts_us") / 1_000_000).cast("decimal(20,6)"), F.lit(":")))).otherwise(F.col("value"))
        return assembly.stream_events(stream.withColumn("value", value), hold)

    found, _ = replay(spark, [(lines, "ts_us")], plan, resumed=True)
    return found.select(
        "source", "event_id", "ts_us", *TEXTS, "path_count", "record_count",
        F.array_join("paths", "|").alias("paths"), F.array_join("record_types", "|").alias("record_types"))


QUERIES = {
    "streamed_window_vectors": streamed_vectors,
    "streamed_alert_evidence": streamed_evidence,
    "streamed_overlap_scores": streamed_overlaps,
    "streamed_alert_sessions": streamed_sessions,
    "streamed_events_from_log": streamed_assembly,
}

_FIELDS = {"top_event_commands": "command", "top_event_keys": "key", "top_event_exes": "exe", "top_event_comms": "comm", "top_event_syscalls": "syscall"}

ORACLES = {
    "streamed_window_vectors": ALIGNED_SQL.replace(BASE_SQL_ORIGIN, "(SELECT DISTINCT source, 0::BIGINT AS origin_us FROM audit)"),
    "streamed_alert_evidence": f"""WITH {SCORES_SQL},
        field_rows AS (
          SELECT source, alert_id, event_no, 0 AS col, 0 AS i, unnest([{", ".join(f"'{f}'" for f in _FIELDS)}]) AS field, unnest([{", ".join(_FIELDS.values())}]) AS value FROM inside
          UNION ALL SELECT source, alert_id, event_no, 0, 0, 'top_event_paths', path FROM inside
          UNION ALL SELECT source, alert_id, event_no, 1, unnest(range(len(string_split(paths, '|')))), 'top_event_paths', unnest(string_split(paths, '|')) FROM inside),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY source, alert_id, field ORDER BY n DESC, seen, value) AS rank FROM (
            SELECT source, alert_id, field, value, count(*) AS n, min((col, event_no, i)) AS seen FROM field_rows WHERE value <> '' GROUP BY ALL)),
        found AS (
          SELECT source, alert_id, field, value, n, rank FROM ranked WHERE rank <= {TOP}
          UNION ALL SELECT source, alert_id, 'sequence_ids', CAST(sequence_id AS VARCHAR), 1,
            row_number() OVER (PARTITION BY source, alert_id ORDER BY start_us, end_us, sequence_id) FROM members
          UNION ALL SELECT source, alert_id, 'event_count', '', count(*), 1 FROM inside GROUP BY ALL)
        SELECT source, field, a.start_us, a.end_us, value, n, CAST(rank AS INTEGER) AS rank FROM found JOIN alerts a USING (source, alert_id)""",
    "streamed_overlap_scores": f"""WITH {SCORES_SQL} SELECT source, sequence_id, n, round(mx, 6) AS mx, round(mean, 9) AS mean,
        round(nrm, 6) AS norm, any_alert, any_native FROM met""",
    "streamed_alert_sessions": f"""WITH {SCORES_SQL} SELECT source, start_us, end_us, start_event_id, end_event_id, sequence_count,
        round(max_p, 6) AS max_lstm_probability, round(mean_p, 6) AS mean_lstm_probability, round(max_c, 6) AS max_combined_score,
        round(mean_c, 6) AS mean_combined_score, round((end_us - start_us) / 1000000.0::DOUBLE, 6) AS duration_seconds, reasons FROM alerts""",
    "streamed_events_from_log": EVENTS_ORACLE,
}
