"""Feature vectors of windows on a stream, in the order of a saved schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions import text as X
from auditloom.operators.windows import (
    FAMILY_FIELDS,
    FeatureSchema,
    event_conditions,
    network_marks,
    prepare_events,
    window_label,
)
from auditloom.streaming.runs import event_time

VALUE_FIELDS = list(dict.fromkeys([*S.DISTINCT_FIELDS, *FAMILY_FIELDS.values()]))


def stream_window_vectors(df: DataFrame, schema: FeatureSchema, size_us: int = 10 * X.MICROS, origin_us: int = 0,
                          watermark: str = "1 minute", by: list[str] | None = None) -> DataFrame:
    """Base features, labels and ``features`` of every window once the watermark has passed it.

    The state has two levels. The first counts, for each window, field and value,
    the events that hold it; the sums over whole events are rows of the same form,
    one for each feature that an event adds to, so a row of the state holds one
    number however many features there are. The second brings a window's rows together: distinct values are
    counted exactly, and counts of the schema's categories go to their place in
    the vector, so a window ends as numbers of a fixed count whatever it saw.
    The columns are those of ``windows.build_window_features``; a stream has no
    first event to count windows from, so ``origin_us`` is given. Rows later than
    the watermark are dropped and counted in the run's progress.
    """
    if size_us <= 0:
        raise ValueError("window size must be positive")
    by = ["source"] if by is None else by
    length, shift = f"{size_us} microseconds", f"{origin_us % size_us} microseconds"
    events = prepare_events(df).withColumn("event_time", event_time("ts_us")).withWatermark("event_time", watermark)
    sums = {
        "event_count": F.lit(1), "record_count_sum": F.col("record_count_num"), "path_count_sum": F.col("path_count_num"),
        "network_event_count": network_marks(), **event_conditions()}

    def entry(field: str, value: Column, n: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"), n.cast("double").alias("n"))

    # what the whole event adds, under a blank field, then one row for each of its values
    added = F.filter(F.array(*[entry("", F.lit(name), n) for name, n in sums.items()]), lambda e: e["n"] != 0)
    rows = F.concat(added, F.array(*[entry(c, F.col(c), F.lit(1)) for c in VALUE_FIELDS]))
    spread = events.select(*by, "event_time", F.inline(rows))
    first = spread.groupBy(*by, F.window("event_time", length, startTime=shift), "field", "value").agg(F.sum("n").alias("n"))

    whole = F.col("field") == ""
    family = F.create_map(*[F.lit(x) for k, v in FAMILY_FIELDS.items() for x in (v, k)])[F.col("field")]
    raw = F.when(F.col("field") == "exe", X.basename(F.col("value"))).otherwise(F.col("value"))
    named = first.withColumns({"_time": F.window_time("window"), "_family": family, "_name": X.safe_name(raw)})
    totals = {c: F.coalesce(F.sum(F.when(whole & (F.col("value") == c), F.col("n"))), F.lit(0.0)) for c in sums}
    means = {f"{c}_mean": totals[f"{c}_sum"] / totals["event_count"] for c in ("record_count", "path_count")}
    distinct = {f"unique_{c}_count": F.count_if((F.col("field") == c) & (F.col("value") != "")) for c in S.DISTINCT_FIELDS}
    places = [(f, v) for f in S.CATEGORY_PREFIXES for v in schema.values.get(f, [])]
    counts = [F.sum(F.when((F.col("_family") == f) & (F.col("_name") == v), F.col("n"))).alias(f"_c{i}") for i, (f, v) in enumerate(places)]
    second = named.groupBy(*by, F.window("_time", length, startTime=shift).alias("_window")).agg(
        *[total.cast("bigint").alias(c) for c, total in totals.items()], *[column.alias(c) for c, column in {**means, **distinct}.items()], *counts)

    start = F.unix_micros("_window.start")
    labels = [F.col(f"label_{c}_count") for c in ("benign", "malicious", "ambiguous", "unlabeled")]
    base = [F.col(c).cast("double") for c in S.BASE_FEATURES]
    vector = F.array(*base, *[F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("double") for i in range(len(places))])
    return second.select(
        *by, F.floor((start - F.lit(origin_us)) / size_us).cast("bigint").alias("window_id"), start.alias("window_start_us"),
        (start + size_us).alias("window_end_us"), *S.BASE_FEATURES, *S.LABEL_FEATURES[:-1],
        window_label(*labels).alias("window_label"), vector.alias("features"))
