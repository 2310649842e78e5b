"""Alert intervals from positive sequences, and the evidence inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditloom.functions import text as X
from auditloom.operators.intervals import lookup_segment
from auditloom.operators.ordering import order_rows
from auditloom.operators.small import join_keys

EVIDENCE = {
    "top_event_commands": "command", "top_event_keys": "key", "top_event_exes": "exe",
    "top_event_comms": "comm", "top_event_syscalls": "syscall",
}
PATH_EVIDENCE = "top_event_paths"
SEQUENCE_ORDER = ["start_us", "end_us", "sequence_id"]


def alert_sessions(df: DataFrame, gap_us: int = 5 * X.MICROS, by: list[str] | None = None,
                   **limits: int) -> DataFrame:
    """Positive sequences with the ``alert_id`` (from 0 per group) they merge into.

    A new alert begins when a sequence starts more than ``gap_us`` after the
    latest end so far; a distance equal to the gap still merges.
    """
    if gap_us < 0:
        raise ValueError("the alert gap must not be negative")
    by = ["source"] if by is None else by
    positives = df.where("combined_alert = 1").dropna(subset=["start_us", "end_us"])
    ordered = order_rows(positives, by, SEQUENCE_ORDER, **limits)
    ordered = ordered.running("max", F.col("end_us"), "_reach", before=True)
    opens = (F.col("start_us") > F.col("_reach") + gap_us).cast("bigint")
    ordered = ordered.running("sum", F.coalesce(opens, F.lit(0).cast("bigint")), "alert_id")
    return ordered.result().drop("_reach")


def summarise_alerts(members: DataFrame, by: list[str] | None = None, lists: bool = True) -> DataFrame:
    """One row per alert: bounds, first and last event, counts, scores and reasons.

    ``lists=True`` adds the sequence and window ids as arrays. Without it every
    aggregate has a fixed-size state; :func:`alert_members` and
    :func:`alert_windows` then give the same ids as rows.
    """
    by = ["source"] if by is None else by
    position = F.struct(*SEQUENCE_ORDER)
    found = [
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.min_by("start_event_id", position).alias("start_event_id"),
        F.max_by("end_event_id", position).alias("end_event_id"),
        F.count(F.lit(1)).alias("sequence_count"),
        F.max("lstm_malicious_probability").alias("max_lstm_probability"),
        F.avg("lstm_malicious_probability").alias("mean_lstm_probability"),
        F.max("iforest_max_anomaly_score").alias("max_iforest_anomaly_score"),
        F.max("combined_score").alias("max_combined_score"),
        F.avg("combined_score").alias("mean_combined_score"),
        F.array_sort(F.collect_set("combined_reason")).alias("combined_reason_summary"),
    ]
    if lists:
        found += [
            F.transform(F.array_sort(F.collect_list(position)), lambda p: p["sequence_id"]).alias("sequence_ids"),
            F.array_sort(F.flatten(F.collect_set(F.col("iforest_window_ids").cast("array<string>")))
                         ).alias("iforest_window_ids"),
        ]
    rows = members.groupBy(*by, "alert_id").agg(*found)
    if lists:
        # ids sort as text, as they do in the exported list
        rows = rows.withColumn("iforest_window_ids", F.array_distinct("iforest_window_ids"))
    return rows.withColumn(
        "duration_seconds", F.greatest(F.lit(0.0), (F.col("end_us") - F.col("start_us")) / F.lit(X.MICROS)))


def alert_members(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = ["source"] if by is None else by
    return members.select(*by, "alert_id", "sequence_id")


def alert_windows(members: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct windows behind each alert."""
    by = ["source"] if by is None else by
    return members.select(*by, "alert_id", F.explode("iforest_window_ids").alias("window_id")).distinct()


def alert_events(events: DataFrame, alerts: DataFrame, by: list[str] | None = None, **limits: int) -> DataFrame:
    """Events between the bounds of an alert, with its ``alert_id``.

    Alerts of one group never overlap, so each event belongs to one at most.
    """
    by = ["source"] if by is None else by
    bounds = alerts.select(*by, F.col("start_us").alias("_from"), F.col("end_us").alias("_to"), "alert_id")
    return lookup_segment(events, bounds, by, "ts_us", "_from", "_to", **limits).where("alert_id IS NOT NULL")


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Most frequent values per key, first appearance breaking ties."""
    if k <= 0:
        raise ValueError("the number of top values must be positive")
    counts = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    best_first = Window.partitionBy(*keys).orderBy(F.desc("n"), "at", "value")
    ranked = counts.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.drop("at")


def top_values(events: DataFrame, k: int = 8, order: list[str] | None = None, by: list[str] | None = None,
               fields: dict[str, str] | None = None) -> DataFrame:
    """Rows ``(by..., alert_id, field, value, n, rank)``; blanks do not count."""
    by = ["source"] if by is None else by
    position = F.struct(*(order or ["ts_us", "event_id"]))
    values = F.array(*[
        F.struct(F.lit(name).alias("field"), X.stripped(F.col(column).cast("string")).alias("value"))
        for name, column in (fields or EVIDENCE).items()])
    rows = events.select(*by, "alert_id", position.alias("at"), F.inline(values)).where("value <> ''")
    return _ranked(rows, [*by, "alert_id", "field"], k)


def top_paths(events: DataFrame, k: int = 8, order: list[str] | None = None,
              by: list[str] | None = None) -> DataFrame:
    """Like :func:`top_values` over both path columns; the first path counts in each.

    All first paths come before any path list when ties are broken.
    """
    by = ["source"] if by is None else by
    position = F.struct(*(order or ["ts_us", "event_id"]))

    def parts(name: str) -> Column:
        if name not in events.columns:
            return F.array().cast("array<string>")
        if events.schema[name].dataType.typeName() == "array":
            return F.flatten(F.transform(name, lambda v: F.split(v, r"\|")))
        return F.split(F.coalesce(name, F.lit("")), r"\|")

    def placed(name: str, column_no: int) -> Column:
        return F.transform(parts(name), lambda v, i: F.struct(
            F.struct(F.lit(column_no).alias("column_no"), position.alias("position"), i.alias("i")).alias("at"),
            X.stripped(v).alias("value")))

    rows = events.select(
        *by, "alert_id", F.lit(PATH_EVIDENCE).alias("field"),
        F.inline(F.concat(placed("path", 0), placed("paths", 1)))).where("value <> ''")
    return _ranked(rows, [*by, "alert_id", "field"], k)


def with_evidence(alerts: DataFrame, events: DataFrame, k: int = 8, order: list[str] | None = None,
                  by: list[str] | None = None, **limits: int) -> DataFrame:
    """Alerts with their event count and the top values as arrays of ``(value, n)``."""
    by = ["source"] if by is None else by
    inside = alert_events(events, alerts, by, **limits)
    counts = inside.groupBy(*by, "alert_id").agg(F.count(F.lit(1)).alias("event_count"))
    tops = top_values(inside, k, order, by).unionByName(top_paths(inside, k, order, by))
    names = [*EVIDENCE, PATH_EVIDENCE]

    def items(name: str) -> Column:
        entry = F.when(F.col("field") == name, F.struct("rank", "value", "n"))
        return F.transform(F.array_sort(F.collect_list(entry)),
                           lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n"))).alias(name)

    # at most k entries per field, so the arrays are bounded
    lists = tops.groupBy(*by, "alert_id").agg(*[items(n) for n in names])
    empty = F.array().cast("array<struct<value:string,n:bigint>>")
    keys = [*by, "alert_id"]
    joined = join_keys(join_keys(alerts, counts, keys), lists, keys)
    return joined.withColumns({
        "event_count": F.coalesce("event_count", F.lit(0).cast("bigint")),
        **{n: F.coalesce(n, empty) for n in names}})
