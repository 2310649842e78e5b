"""Summary records and readable report lines from alert intervals."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as X

EVIDENCE_ITEMS, REPORT_ITEMS, REPORT_WIDTH = 8, 5, 220
SUMMARY_FIELDS = [
    "alert_id", "start_timestamp", "end_timestamp", "duration_seconds", "sequence_count", "event_count",
    "max_lstm_probability", "max_iforest_anomaly_score", "max_combined_score", "combined_reason_summary",
]
SUMMARY_EVIDENCE = ["top_event_commands", "top_event_keys", "top_event_exes", "top_event_paths"]
REPORT_SECTIONS = {
    "Top commands:": "top_event_commands", "Top audit keys:": "top_event_keys",
    "Top executables:": "top_event_exes", "Top paths:": "top_event_paths",
}


def evidence_text(name: str, limit: int) -> Column:
    """First items as ``value:count``, commands as ``value (count)``."""
    def show(e):
        if name == "top_event_commands":
            return F.concat(e["value"], F.lit(" ("), e["n"].cast("string"), F.lit(")"))
        return F.concat(e["value"], F.lit(":"), e["n"].cast("string"))

    return F.transform(F.slice(name, 1, limit), show)


def _with_texts(alerts: DataFrame) -> DataFrame:
    return alerts.withColumns({
        "start_timestamp": X.seconds_text(F.col("start_us")),
        "end_timestamp": X.seconds_text(F.col("end_us")),
        "combined_reason_summary": F.array_join("combined_reason_summary", "|"),
    })


def alert_records(alerts: DataFrame, items: int = EVIDENCE_ITEMS) -> DataFrame:
    """One structured record per alert with its leading evidence."""
    rows = _with_texts(alerts)
    keys = [c for c in ("source",) if c in alerts.columns]
    return rows.select(*keys, *SUMMARY_FIELDS, *[evidence_text(c, items).alias(c) for c in SUMMARY_EVIDENCE])


def triage_summary(alerts: DataFrame, combined: DataFrame, parameters: dict, inputs: dict | None = None) -> DataFrame:
    """One row: parameters, run facts and counts. The alerts follow as :func:`alert_records`."""
    counts = combined.agg(F.coalesce(F.sum("combined_alert"), F.lit(0)).cast("bigint").alias("sequence_alert_count"))
    facts = {"generated_at_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                                               "yyyy-MM-dd'T'HH:mm:ss'+00:00'")}
    facts |= {k: F.lit(v) for k, v in (inputs or {}).items()}
    facts["parameters"] = F.parse_json(F.lit(json.dumps(parameters, sort_keys=True)))
    return counts.select(
        *[v.alias(k) for k, v in facts.items()],
        alerts.agg(F.count(F.lit(1)).alias("n")).scalar().alias("alert_interval_count"), "sequence_alert_count")


def summary_lines(alerts: DataFrame, combined: DataFrame, parameters: dict, inputs: dict | None = None) -> DataFrame:
    """The summary as JSON lines: the run first, then one line per alert in order.

    One line per alert keeps the document distributed, whatever the alert count.
    """
    head = triage_summary(alerts, combined, parameters, inputs)
    head = head.select(F.lit(0).alias("part"), F.lit("").alias("source"), F.lit(-1).cast("bigint").alias("alert_id"),
                       F.to_json(F.struct("*")).alias("value"))
    records = alert_records(alerts)
    source = F.col("source") if "source" in records.columns else F.lit("")
    body = records.select(F.lit(1).alias("part"), source.alias("source"), "alert_id", F.to_json(F.struct("*")).alias("value"))
    return head.unionByName(body).orderBy("part", "source", "alert_id").select("value")


def shortened(value: Column, limit: int = REPORT_WIDTH) -> Column:
    text = X.stripped(value)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def triage_report(alerts: DataFrame, items: int = REPORT_ITEMS) -> DataFrame:
    """Markdown lines of all alerts, strongest first, with the keys that order them."""
    if items <= 0:
        raise ValueError("the number of report items must be positive")
    rows = _with_texts(alerts)
    if "source" not in rows.columns:
        rows = rows.withColumn("source", F.lit(""))

    def fact(name: str, *values: Column) -> Column:
        return F.concat(F.lit(f"- {name}: "), *[F.lit(v) if isinstance(v, str) else v for v in values])

    def code(value: Column) -> Column:
        return F.concat(F.lit("`"), value.cast("string"), F.lit("`"))

    def number(name: str, digits: int) -> Column:
        return code(F.format_string(f"%.{digits}f", name))

    facts = F.array(
        F.concat(F.lit("### Alert "), F.col("alert_id").cast("string")), F.lit(""),
        fact("Time", code(F.col("start_timestamp")), " to ", code(F.col("end_timestamp"))),
        fact("Duration seconds", number("duration_seconds", 3)),
        fact("Sequences/events", code(F.col("sequence_count")), " / ", code(F.col("event_count"))),
        fact("Max combined score", number("max_combined_score", 6)),
        fact("Max LSTM probability", number("max_lstm_probability", 6)),
        fact("Max IF anomaly score", number("max_iforest_anomaly_score", 6)),
        fact("Reason summary", code(F.col("combined_reason_summary"))), F.lit(""))

    def section(title: str, name: str) -> Column:
        lines = F.transform(evidence_text(name, items), lambda v: F.concat(F.lit("- `"), shortened(v), F.lit("`")))
        shown = F.concat(F.array(F.lit(title)), lines, F.array(F.lit("")))
        return F.when(F.size(name) > 0, shown).otherwise(F.array().cast("array<string>"))

    lines = F.concat(facts, *[section(t, c) for t, c in REPORT_SECTIONS.items()])
    order = ["max_combined_score", "max_lstm_probability", "max_iforest_anomaly_score"]
    return rows.select(*order, "source", "alert_id", F.posexplode(lines).alias("line_no", "value")).orderBy(
        *[F.desc(c) for c in order], "source", "alert_id", "line_no")


CAVEAT = "> These scores rank what to look at first; they prove nothing by themselves. Check alerts against the events."
EMPTY = "Nothing to show: every sequence stayed below the combined threshold."
FILES = ["events", "windows", "sequences", "combined", "ranked", "alerts", "alert_members", "alert_windows", "unscored", "summary"]


def full_report(alerts: DataFrame, combined: DataFrame, parameters: dict, inputs: dict | None = None, items: int = REPORT_ITEMS) -> DataFrame:
    """The whole report as ordered lines ``(part, value)``: header, alerts, list of tables."""
    given = inputs or {}
    spark = alerts.sparkSession

    def fact(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"- {name}: `"), F.lit(value).cast("string") if not isinstance(value, Column) else value.cast("string"), F.lit("`"))

    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss 'UTC'")
    counts = alerts.agg(F.count(F.lit(1)).alias("n"))
    positive = combined.agg(F.coalesce(F.sum("combined_alert"), F.lit(0)).alias("n"))
    head = F.array(
        F.lit("# Triage Report"), F.lit(""), fact("Generated", now), fact("Input", str(given.get("input", ""))),
        fact("Output directory", str(given.get("output_dir", ""))), fact("Alert intervals", counts.scalar()),
        fact("Positive sequences", positive.scalar()), fact("IF threshold", str(parameters.get("iforest_threshold", ""))),
        fact("Combined threshold", str(parameters.get("combined_threshold", ""))), fact("LSTM weight", str(parameters.get("lstm_weight", ""))),
        F.lit(""), F.lit(CAVEAT), F.lit(""))
    title = F.when(counts.scalar() > 0, F.array(F.lit("## Alert Intervals"), F.lit(""))).otherwise(
        F.array(F.lit("## Alerts"), F.lit(""), F.lit(EMPTY), F.lit("")))
    tail = F.array(F.lit("## Generated Files"), F.lit(""), *[F.lit(f"- `{f}`") for f in FILES], F.lit(""))
    order = ["max_combined_score", "max_lstm_probability", "max_iforest_anomaly_score"]
    keys = [*order, "source", "alert_id"]
    body = triage_report(alerts, items).select(F.lit(1).alias("part"), *keys, "line_no", "value")
    kinds = body.schema

    def block(part: int, lines: Column) -> DataFrame:
        rows = spark.range(1).select(F.posexplode(lines).alias("line_no", "value"))
        return rows.select(F.lit(part).alias("part"), *[F.lit(None).cast(kinds[k].dataType).alias(k) for k in keys], "line_no", "value")

    every = block(0, F.concat(head, title)).unionByName(body).unionByName(block(2, tail))
    return every.orderBy("part", *[F.desc(k) for k in order], "source", "alert_id", "line_no").select("part", "value")
