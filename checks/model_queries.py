"""Model, summary and whole-plan queries (groups F and J).

Forest, classifier and whole plans draw at random; their queries return facts that any draw must meet.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.operators import alerts as H
from auditloom.operators import iforest as I
from auditloom.operators import seqmodel as M
from auditloom.operators import windows as W
from auditloom.operators.evaluation import DETECTORS
from auditloom.operators.intervals import overlap_pairs
from auditloom.operators.small import attach_row, join_keys
from auditloom.plans import report as J
from auditloom.plans.scan import ScanParameters, scan_events
from auditloom.plans.tune import tune
from auditloom.session import materialise
from checks.audit_view import WINDOW_US, audit_events
from checks.scratch import fresh
from checks.score_queries import GAP, SCORES_SQL, TOP, combined, members
from checks.sequence_queries import LENGTH, MIN_BAD, NUMERIC_SQL, SEQUENCES_SQL, STRIDE, build
from checks.window_queries import ALIGNED_SQL

SHARE = 0.25
PARAMETERS = ScanParameters(window_us=WINDOW_US, sequence_length=LENGTH, stride=STRIDE, iforest_threshold=0.0,
                            combined_threshold=0.5, alert_gap_us=GAP, top_events=TOP)


def features(spark, sf_dir):
    found, schema = W.build_window_features(audit_events(spark, sf_dir), WINDOW_US, top=4)
    return materialise(found, "features"), schema


def preprocessed(spark, sf_dir):
    """Median, mean and scale per window feature."""
    rows, schema = features(spark, sf_dir)
    p = I.fit_preprocessor(rows)
    found = spark.createDataFrame(list(zip(schema.names, p.median, p.mean, p.scale, strict=True)),
                                  "feature string, median double, mean double, scale double")
    return found.select("feature", *[F.round(c, 4).alias(c) for c in ("median", "mean", "scale")])


def forest_scores(spark, sf_dir):
    """Facts of every window's score; the forest learns from windows of benign events only."""
    rows, schema = features(spark, sf_dir)
    baseline = audit_events(spark, sf_dir).where("manual_label <> 'malicious'")
    benign, _ = W.build_window_features(baseline, WINDOW_US, schema)
    model = I.fit_iforest(materialise(benign, "baseline"), trees=50, schema=schema)
    path = fresh(spark, "forest")
    model.save(spark, path)
    loaded = I.IForestModel.load(spark, path)
    scored = loaded.transform(rows, 0.0).select("source", "window_id", "iforest_anomaly_score", "iforest_is_anomaly", "iforest_threshold_alert")
    # the model before saving, over other partitions
    again = model.transform(rows.repartition(5), 0.0).select(
        F.col("source").alias("_s"), F.col("window_id").alias("_w"), F.col("iforest_anomaly_score").alias("_again"))
    joined = scored.join(again, (F.col("source") == F.col("_s")) & (F.col("window_id") == F.col("_w")))
    score = F.col("iforest_anomaly_score")
    return joined.select(
        "source", "window_id", score.between(-0.5, 0.5).cast("int").alias("in_range"),
        ((F.col("iforest_is_anomaly") == 1) == (score > 0)).cast("int").alias("flag_agrees"),
        ((F.col("iforest_threshold_alert") == 1) == (score >= 0)).cast("int").alias("alert_agrees"),
        (F.abs(score - F.col("_again")) < 1e-12).cast("int").alias("same_after_reload"))


def embedding_forest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"))
    model = I.fit_iforest(rows, ["vec_id"], trees=50)
    far = rows.agg(F.max(F.array_max("features"))).first()[0] + 50.0
    size = len(model.preprocessor.median)
    planted = spark.range(3).select((-1 - F.col("id")).alias("vec_id"), F.array_repeat(F.lit(far), size).alias("features"))
    scored = model.transform(rows.unionByName(planted), 0.0).select("vec_id", F.col("iforest_anomaly_score").alias("score"))
    least = scored.where("vec_id < 0").agg(F.min("score").alias("_least"))
    return attach_row(scored, least).where("vec_id >= 0").select(
        "vec_id", F.col("score").between(-0.5, 0.5).cast("int").alias("in_range"), (F.col("score") <= F.col("_least")).cast("int").alias("below_planted"))


def split(spark, sf_dir):
    """Sizes of both sides: the share of groups is fixed whatever the draw."""
    marks = M.group_split(build(spark, sf_dir), label=None).select("segment_id", "is_validation").distinct()
    return marks.groupBy(F.col("is_validation").cast("int").alias("is_validation")).agg(F.count(F.lit(1)).alias("n_groups"))


def membership(spark, sf_dir):
    """Every group with its rows and sides under the class guard, which fails unless both sides hold both classes."""
    marks = materialise(M.group_split(build(spark, sf_dir), share=SHARE), "split")
    sides = marks.groupBy("is_validation").agg(F.count_distinct("segment_id").alias("groups"), F.count_distinct("y").alias("classes"))
    totals = sides.agg(F.max(F.when(F.col("is_validation"), F.col("groups"))).alias("validation_groups"), F.min("classes").alias("least_classes"))
    groups = marks.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("is_validation").alias("sides"))
    return attach_row(groups, totals)


def hooked(spark, sf_dir):
    """A fixed linear model through the hook for outside models: it sees every token id and number of a sequence."""
    def load():
        def predict(tokens, numbers):
            # shares of successful steps, of steps with a command, and of steps whose first token is a common one
            return 0.5 * numbers[:, :, 4].mean(axis=1) + 0.25 * numbers[:, :, 6].mean(axis=1) + 0.25 * (tokens[:, :, 0] == 2).mean(axis=1)
        return predict

    found = M.score_with(build(spark, sf_dir), load, LENGTH, 0.6)
    return found.select("sequence_id", F.round("lstm_malicious_probability", 6).alias("probability"))


def scaler(spark, sf_dir):
    rows = M.fit_scaler(build(spark, sf_dir))
    found = spark.createDataFrame([(n, m, s) for n, (m, s) in zip(S.NUMERIC_COLUMNS, rows, strict=True)],
                                  "feature string, mean double, scale double")
    return found.select("feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


def classified(spark, sf_dir):
    marks = M.group_split(build(spark, sf_dir), label=None)
    rows = materialise(marks, "split")
    model = M.fit_sequence_classifier(rows.where(~F.col("is_validation")))
    sides = rows.groupBy(F.col("segment_id").alias("_segment")).agg(F.count_distinct("is_validation").alias("_sides"))
    p = F.col("lstm_malicious_probability")
    return M.score_sequences(rows, model).join(sides, F.col("segment_id") == F.col("_segment")).select(
        "sequence_id", p.between(0.0, 1.0).cast("int").alias("in_range"),
        ((F.col("lstm_prediction_label") == "malicious") == (p >= model.threshold)).cast("int").alias("label_agrees"),
        (F.col("_sides") == 1).cast("int").alias("group_on_one_side"))


def alert_table(spark, sf_dir, scored=None):
    rows = H.summarise_alerts(members(spark, sf_dir, scored), lists=False)
    return H.with_evidence(rows, audit_events(spark, sf_dir), TOP, ["event_no"])


def summary(spark, sf_dir):
    """Counts of the summary document."""
    scored = combined(spark, sf_dir)
    found = J.triage_summary(alert_table(spark, sf_dir, scored), scored, {"alert_gap_us": GAP})
    return found.select("alert_interval_count", "sequence_alert_count")


def records(spark, sf_dir):
    found = J.alert_records(alert_table(spark, sf_dir), TOP)
    return found.select("source", "alert_id", "start_timestamp", "end_timestamp", "event_count",
                        *[F.array_join(c, "|").alias(c) for c in ("top_event_commands", "top_event_keys", "top_event_exes")])


REPORT_INPUTS = {"input": "events.parquet", "output_dir": "out"}
REPORT_PARAMETERS = {"iforest_threshold": 0.5, "combined_threshold": 0.75, "lstm_weight": 0.7}


def summary_document(spark, sf_dir):
    """Every line of the summary read back, the run's line without its clock."""
    scored = combined(spark, sf_dir)
    lines = J.summary_lines(alert_table(spark, sf_dir, scored), scored, REPORT_PARAMETERS, REPORT_INPUTS)
    lists = ["top_event_commands", "top_event_keys", "top_event_exes", "top_event_paths"]
    numbers = ["duration_seconds", "max_lstm_probability", "max_iforest_anomaly_score", "max_combined_score"]
    kinds = ", ".join([
        "generated_at_utc string, input string, output_dir string, alert_interval_count bigint, sequence_alert_count bigint, source string, alert_id bigint",
        "start_timestamp string, end_timestamp string, sequence_count bigint, event_count bigint, combined_reason_summary string",
        "parameters struct<iforest_threshold: double, combined_threshold: double, lstm_weight: double>",
        *[f"{c} array<string>" for c in lists], *[f"{c} double" for c in numbers]])
    read = lines.select(F.from_json("value", kinds).alias("v")).select("v.*")
    return read.select(
        F.col("generated_at_utc").isNotNull().cast("int").alias("has_clock"), "input", "output_dir", "alert_interval_count", "sequence_alert_count",
        F.col("parameters.combined_threshold").alias("combined_threshold"), F.col("parameters.lstm_weight").alias("lstm_weight"),
        "source", "alert_id", "start_timestamp", "end_timestamp", "sequence_count", "event_count", "combined_reason_summary",
        *[F.array_join(c, "|").alias(c) for c in lists], *[F.round(c, 6).alias(c) for c in numbers])


def report_document(spark, sf_dir):
    """Every line of the whole report but the clock."""
    scored = combined(spark, sf_dir)
    found = J.full_report(alert_table(spark, sf_dir, scored), scored, REPORT_PARAMETERS, REPORT_INPUTS)
    return found.where("value NOT LIKE '- Generated: %'").select("part", "value")


def report(spark, sf_dir):
    return J.triage_report(alert_table(spark, sf_dir)).select(
        "source", "alert_id", F.col("line_no").cast("bigint").alias("line_no"), "value").where("line_no < 3 OR line_no = 4")


def tuned(spark, sf_dir):
    """Three disjoint parts by user: benign baseline, benign hold-out, labelled events."""
    e = audit_events(spark, sf_dir)
    part, benign = F.col("uid").cast("int") % 4, F.col("manual_label") != "malicious"
    return tune(e.where(benign & (part == 0)), e.where(benign & (part == 1)), e.where(part > 1), PARAMETERS, trees=50, top=4, min_malicious=MIN_BAD, vocab_size=32, tie="event_no")


def tuning(spark, sf_dir):
    """Detector comparison of a whole training round."""
    round_ = tuned(spark, sf_dir)
    rows = round_.sequence_scores.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y_true") == 1).alias("_p"))
    found = attach_row(round_.detectors, rows)
    return found.select(
        "detector", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") == F.col("_n")).cast("int").alias("all_counted"),
        (F.col("tp") + F.col("fn") == F.col("_p")).cast("int").alias("positives_counted"),
        F.col("f1").between(0.0, 1.0).cast("int").alias("f1_in_range"))


def events_inside(alerts, events):
    """``source, alert_id, n`` of alerts that hold events; they meet in time buckets, not every event of a host beside every alert of it."""
    spans = alerts.select("source", "alert_id", "start_us", "end_us")
    points = events.select("source", F.col("ts_us").alias("_at"), F.col("ts_us").alias("_to"))
    return overlap_pairs(spans, points, ["source"], ("start_us", "end_us"), ("_at", "_to")).groupBy("source", "alert_id").agg(F.count(F.lit(1)).alias("n"))


def scanned(spark, sf_dir):
    """Facts of a whole scan with freshly trained models, one row per host."""
    models = tuned(spark, sf_dir)
    found = scan_events(audit_events(spark, sf_dir), models.forest, models.model, models.vocab, PARAMETERS, ["event_no"])
    events = found.events.groupBy("source").agg(F.count(F.lit(1)).alias("n_events"))
    flagged = found.combined.groupBy("source").agg(F.sum("combined_alert").alias("flagged"))
    members = found.members.groupBy("source").agg(F.count(F.lit(1)).alias("members"))
    before = Window.partitionBy("source").orderBy("start_us", "alert_id")
    apart = found.alerts.select("source", "sequence_count", (F.col("start_us") > F.coalesce(F.lag("end_us").over(before), F.lit(-(1 << 62)))).alias("apart"))
    alerts = apart.groupBy("source").agg(F.min("apart").alias("apart"), F.sum("sequence_count").alias("in_alerts"))
    inside = events_inside(found.alerts, found.events)
    counted = join_keys(found.alerts.select("source", "alert_id", "event_count"), inside, ["source", "alert_id"]).groupBy("source").agg(
        F.min((F.coalesce("n", F.lit(0)) == F.col("event_count")).cast("int")).alias("counted"))
    whole = events.join(flagged, "source", "left").join(members, "source", "left").join(alerts, "source", "left").join(counted, "source", "left")
    none = F.lit(0)
    return whole.select(
        "source", "n_events", F.coalesce("apart", F.lit(True)).cast("int").alias("alerts_apart"), F.coalesce("counted", F.lit(1)).alias("events_counted"),
        (F.coalesce("flagged", none) == F.coalesce("members", none)).cast("int").alias("members_flagged"),
        (F.coalesce("members", none) == F.coalesce("in_alerts", none)).cast("int").alias("members_in_alerts"))


QUERIES = {
    "window_preprocessing": preprocessed,
    "isolation_forest_scores": forest_scores,
    "embedding_forest_scores": embedding_forest,
    "group_split": split,
    "group_split_membership": membership,
    "hooked_model_scores": hooked,
    "summary_document": summary_document,
    "report_document": report_document,
    "sequence_scaler": scaler,
    "sequence_classifier": classified,
    "summary_counts": summary,
    "summary_records": records,
    "report_lines": report,
    "training_round": tuning,
    "log_scan": scanned,
}

EVIDENCE_SQL = """evidence AS (SELECT source, alert_id, field, string_agg(value || CASE field WHEN 'command' THEN ' (' || n || ')' ELSE ':' || n END, '|' ORDER BY rank) AS txt
  FROM tops GROUP BY ALL)"""
TOPS_SQL = f"""tops AS (SELECT source, alert_id, field, value, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, alert_id, field ORDER BY n DESC, seen) AS rank FROM (
    SELECT source, alert_id, field, value, count(*) AS n, min(event_no) AS seen FROM (
      SELECT source, alert_id, event_no, unnest(['command','key','exe']) AS field, unnest([command, key, exe]) AS value FROM inside)
    WHERE value <> '' GROUP BY ALL)) WHERE rank <= {TOP})"""


PATHS_SQL = f"""path_tops AS (SELECT source, alert_id, value, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source, alert_id ORDER BY n DESC, seen) AS rank FROM (
    SELECT source, alert_id, value, count(*) AS n, min((col, event_no, i)) AS seen FROM (
      SELECT source, alert_id, event_no, 0 AS col, 0 AS i, path AS value FROM inside
      UNION ALL SELECT source, alert_id, event_no, 1, unnest(range(len(string_split(paths, '|')))), unnest(string_split(paths, '|')) FROM inside)
    WHERE value <> '' GROUP BY ALL)) WHERE rank <= {TOP}),
every_top AS (SELECT source, alert_id, field, value, n, rank FROM tops UNION ALL SELECT source, alert_id, 'path', value, n, rank FROM path_tops),
every_evidence AS (SELECT source, alert_id, field, string_agg(value || CASE field WHEN 'command' THEN ' (' || n || ')' ELSE ':' || n END, '|' ORDER BY rank) AS txt
  FROM every_top GROUP BY ALL),
counted AS (SELECT a.*, (SELECT count(*) FROM inside i WHERE i.source = a.source AND i.alert_id = a.alert_id) AS event_count FROM alerts a)"""


def evidence(field):
    return f"coalesce((SELECT txt FROM every_evidence e WHERE e.source = a.source AND e.alert_id = a.alert_id AND field = '{field}'), '')"


def lines_sql(*values):
    return " UNION ALL ".join(f"SELECT 1 AS part, {v} AS value FROM counted" for v in values)


def section_sql(title, field):
    item = "value || CASE field WHEN 'command' THEN ' (' || n || ')' ELSE ':' || n END"
    held = f"FROM every_top WHERE field = '{field}'"
    return f"""SELECT 1, '{title}' FROM (SELECT DISTINCT source, alert_id {held}) UNION ALL SELECT 1, '' FROM (SELECT DISTINCT source, alert_id {held})
        UNION ALL SELECT 1, '- `' || CASE WHEN length(v) <= 220 THEN v ELSE left(v, 217) || '...' END || '`' FROM (SELECT {item} AS v {held})"""


def epoch(column):
    return f"({column} // 1000000) || '.' || lpad(CAST({column} % 1000000 AS VARCHAR), 6, '0')"


HEAD = ["# Triage Report", "", "- Input: `events.parquet`", "- Output directory: `out`", "- IF threshold: `0.5`", "- Combined threshold: `0.75`", "- LSTM weight: `0.7`",
        "", J.CAVEAT, ""]
TAIL = ["## Generated Files", "", *[f"- `{f}`" for f in J.FILES], ""]
NUMBERS = {"Max combined score": "max_c", "Max LSTM probability": "max_p", "Max IF anomaly score": "max_if"}


def texts_sql(part, lines):
    return f"""SELECT {part}, unnest([{", ".join("'" + x.replace("'", "''") + "'" for x in lines)}])"""


ORACLES = {
    "group_split_membership": f"""WITH {SEQUENCES_SQL}, g AS (SELECT attack_run_id AS segment_id, count(*) AS n_rows FROM numbered GROUP BY ALL)
        SELECT *, 1::BIGINT AS sides, CAST(ceil((SELECT count(*) FROM g) * {SHARE}) AS BIGINT) AS validation_groups, 2::BIGINT AS least_classes FROM g""",
    "hooked_model_scores": f"""WITH {SEQUENCES_SQL}, steps AS (
        SELECT n.sequence_id, (success = 'yes')::INT AS s, (command <> '')::INT AS c, (split_part(ids, ',', 1) = '2')::INT AS t
        FROM placed JOIN (SELECT attack_run_id, k, sequence_id FROM numbered) n USING (attack_run_id, k))
        SELECT sequence_id, round(0.5::DOUBLE * avg(s) + 0.25::DOUBLE * avg(c) + 0.25::DOUBLE * avg(t), 6) AS probability FROM steps GROUP BY sequence_id""",
    "summary_document": f"""WITH {SCORES_SQL}, {TOPS_SQL}, {PATHS_SQL}
        SELECT 1 AS has_clock, 'events.parquet' AS input, 'out' AS output_dir, (SELECT count(*) FROM alerts) AS alert_interval_count,
          (SELECT count(*) FROM members) AS sequence_alert_count, 0.75::DOUBLE AS combined_threshold, 0.7::DOUBLE AS lstm_weight,
          NULL AS source, NULL::BIGINT AS alert_id, NULL AS start_timestamp, NULL AS end_timestamp, NULL::BIGINT AS sequence_count, NULL::BIGINT AS event_count,
          NULL AS combined_reason_summary, NULL AS top_event_commands, NULL AS top_event_keys, NULL AS top_event_exes, NULL AS top_event_paths,
          NULL::DOUBLE AS duration_seconds, NULL::DOUBLE AS max_lstm_probability, NULL::DOUBLE AS max_iforest_anomaly_score, NULL::DOUBLE AS max_combined_score
        UNION ALL SELECT 0, NULL, NULL, NULL, NULL, NULL, NULL, a.source, a.alert_id, {epoch("a.start_us")}, {epoch("a.end_us")}, sequence_count, event_count, reasons,
          {evidence("command")}, {evidence("key")}, {evidence("exe")}, {evidence("path")},
          round((end_us - start_us) / 1000000.0::DOUBLE, 6), round(max_p, 6), round(max_if, 6), round(max_c, 6) FROM counted a""",
    "report_document": f"""WITH {SCORES_SQL}, {TOPS_SQL}, {PATHS_SQL},
        body AS ({lines_sql(
            "'### Alert ' || alert_id", "''", f"'- Time: `' || {epoch('start_us')} || '` to `' || {epoch('end_us')} || '`'",
            "'- Duration seconds: `' || ((end_us - start_us + 500) // 1000 // 1000) || '.' || lpad(CAST((end_us - start_us + 500) // 1000 % 1000 AS VARCHAR), 3, '0') || '`'",
            "'- Sequences/events: `' || sequence_count || '` / `' || event_count || '`'",
            *[f"'- {name}: `' || printf('%.6f', {c}) || '`'" for name, c in NUMBERS.items()], "'- Reason summary: `' || reasons || '`'", "''")}
          UNION ALL {" UNION ALL ".join(section_sql(t, f) for t, f in zip(J.REPORT_SECTIONS, ["command", "key", "exe", "path"], strict=True))}),
        n AS (SELECT (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM members) AS members)
        SELECT * FROM body UNION ALL {texts_sql(0, HEAD)} UNION ALL {texts_sql(2, TAIL)}
        UNION ALL SELECT 0, '- Alert intervals: `' || alerts || '`' FROM n UNION ALL SELECT 0, '- Positive sequences: `' || members || '`' FROM n
        UNION ALL SELECT 0, unnest(CASE WHEN alerts > 0 THEN ['## Alert Intervals', ''] ELSE ['## Alerts', '', '{J.EMPTY}', ''] END) FROM n""",
    "isolation_forest_scores": f"""SELECT DISTINCT source, window_id, 1 AS in_range, 1 AS flag_agrees, 1 AS alert_agrees, 1 AS same_after_reload
        FROM ({ALIGNED_SQL})""",
    "embedding_forest_scores": "SELECT vec_id, 1 AS in_range, 1 AS below_planted FROM embeddings",
    "sequence_classifier": f"WITH {SEQUENCES_SQL} SELECT sequence_id, 1 AS in_range, 1 AS label_agrees, 1 AS group_on_one_side FROM numbered",
    "training_round": f"""SELECT unnest([{", ".join(f"'{d}'" for d in DETECTORS)}]) AS detector, 1 AS all_counted, 1 AS positives_counted, 1 AS f1_in_range""",
    "log_scan": """SELECT 'host' || (user_id % 3) AS source, count(*) AS n_events, 1 AS alerts_apart, 1 AS events_counted,
        1 AS members_flagged, 1 AS members_in_alerts FROM events GROUP BY ALL""",
    "window_preprocessing": f"""SELECT feature, round(median(value), 4) AS median, round(avg(value), 4) AS mean,
        round(CASE WHEN stddev_pop(value) < 1e-9 THEN 1.0::DOUBLE ELSE stddev_pop(value) END, 4) AS scale FROM ({ALIGNED_SQL}) GROUP BY feature""",
    "sequence_scaler": f"""WITH {SEQUENCES_SQL}, steps AS (
        SELECT {", ".join(f"CAST({x} AS DOUBLE) AS c{i}" for i, x in enumerate(NUMERIC_SQL))} FROM placed WHERE k * {STRIDE} + {LENGTH} <= seg_n),
        stats AS (SELECT unnest([{", ".join(f"'{c}'" for c in S.NUMERIC_COLUMNS)}]) AS feature,
          unnest([{", ".join(f"avg(c{i})" for i in range(len(NUMERIC_SQL)))}]) AS mean,
          unnest([{", ".join(f"stddev_pop(c{i})" for i in range(len(NUMERIC_SQL)))}]) AS scale FROM steps)
        SELECT feature, round(mean, 4) AS mean, round(CASE WHEN scale < 1e-6 THEN 1.0::DOUBLE ELSE scale END, 4) AS scale FROM stats""",
    "group_split": f"""WITH {SEQUENCES_SQL}, g AS (SELECT count(DISTINCT attack_run_id) AS n FROM numbered)
        SELECT 1 AS is_validation, CAST(ceil(n * 0.25) AS BIGINT) AS n_groups FROM g
        UNION ALL SELECT 0, n - CAST(ceil(n * 0.25) AS BIGINT) FROM g""",
    "summary_counts": f"""WITH {SCORES_SQL} SELECT (SELECT count(*) FROM alerts) AS alert_interval_count,
        (SELECT count(*) FROM members) AS sequence_alert_count""",
    "summary_records": f"""WITH {SCORES_SQL}, {TOPS_SQL}, {EVIDENCE_SQL}
        SELECT a.source, a.alert_id, {epoch("a.start_us")} AS start_timestamp, {epoch("a.end_us")} AS end_timestamp,
          (SELECT count(*) FROM inside i WHERE i.source = a.source AND i.alert_id = a.alert_id) AS event_count,
          coalesce((SELECT txt FROM evidence e WHERE e.source = a.source AND e.alert_id = a.alert_id AND field = 'command'), '') AS top_event_commands,
          coalesce((SELECT txt FROM evidence e WHERE e.source = a.source AND e.alert_id = a.alert_id AND field = 'key'), '') AS top_event_keys,
          coalesce((SELECT txt FROM evidence e WHERE e.source = a.source AND e.alert_id = a.alert_id AND field = 'exe'), '') AS top_event_exes
        FROM alerts a""",
    "report_lines": f"""WITH {SCORES_SQL}, n AS (SELECT a.*, (SELECT count(*) FROM inside i WHERE i.source = a.source AND i.alert_id = a.alert_id) AS events FROM alerts a)
        SELECT source, alert_id, 0 AS line_no, '### Alert ' || alert_id AS value FROM n
        UNION ALL SELECT source, alert_id, 1, '' FROM n
        UNION ALL SELECT source, alert_id, 2, '- Time: `' || {epoch("start_us")} || '` to `' || {epoch("end_us")} || '`' FROM n
        UNION ALL SELECT source, alert_id, 4, '- Sequences/events: `' || sequence_count || '` / `' || events || '`' FROM n""",
}
